"""The entry point works, with the text operators and without them."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 60


def test_without_text_operators(tmp_path):
    for path in ("__spark_entry__.py", "tickloom"):
        subprocess.run(["cp", "-r", ROOT / path, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "tickloom" / "llm"], check=True)
    code = "import __spark_entry__ as e; assert e.queries() and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline'], e.queries().keys(); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
