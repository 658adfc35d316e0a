"""What the operators share: cutting lineage in the cluster's shared folder, names that don't clash, tables of a folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """Runs df once and keeps its rows in the folder of spark.checkpoint.dir, so that what follows neither repeats the work nor is lost with an executor.

    The folder is the session's. On local masters, where one process does it all, a temporary one is set if there is none;
    on a cluster that is an error, since executors could not read each other's folders.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if context.master.split("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tickloom-checkpoint-")
        context.setCheckpointDir(shared)
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores after it until no column of df has it (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def trimmed(word: Column, inside: str) -> Column:
    """word without what isn't in the class inside (as in a regular expression) at either end; each end in linear time."""
    edge = f"^[^{inside}]+"
    return F.reverse(F.regexp_replace(F.reverse(F.regexp_replace(word, edge, "")), edge, ""))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
