"""Running values by key that don't put a busy key into one task: a scan in two levels.

What runs along a key (a maximum, a sum, a last value) is associative. So a key of more than `hot` rows is cut, by
approximate quantiles of its order, into PARTS blocks; each block runs for itself, the blocks' totals (PARTS rows a key) run
once more, and what came before a block is combined with each of its rows. Cuts only decide who does the work: results are
those of one window over the key. Keys below hot, and all if none is above, take that window.

At most KEYS keys are cut, the largest; their cuts and totals are broadcast (KEYS * PARTS rows at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT, PARTS, KEYS = 2_000_000, 64, 4096


def cuts(rows: DataFrame, key: str, order: str, hot: int, parts: int) -> DataFrame | None:
    """(__key, __cuts) of the keys with more than hot rows; None if there are none."""
    busy = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > hot).orderBy(F.desc("__n")).limit(KEYS).collect()
    if not busy:
        return None
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    keys = spark.createDataFrame([(r[key],) for r in busy], f"__key {kind}")
    at = F.array(*(F.lit(k / parts) for k in range(1, parts)))
    own = rows.join(F.broadcast(keys), F.col(key).eqNullSafe(F.col("__key")))
    found = own.groupBy("__key").agg(F.percentile_approx(order, at, F.lit(10_000)).alias("__cuts"))
    # collected once, so that all that follows uses the same cuts
    return spark.createDataFrame(found.collect(), found.schema)


def prefix(rows: DataFrame, key: str, order: list[str], columns: dict[str, tuple[str, Column]], inclusive: bool = True, hot: int = HOT, parts: int = PARTS, *, like: DataFrame | None = None) -> DataFrame:
    """rows with columns (name: (kind, value)): of each key, up to each row in order (itself included, or not), the max, the sum, or the last value that isn't null. Null where there is none.

    like: rows of about the same keys and order that cost less to make; busy keys and their cuts are then found in these.
    """
    rows = rows.withColumns({f"__{name}": value for name, (_, value) in columns.items()})
    names = {name: f"__{name}" for name in columns}
    end = 0 if inclusive else -1
    run = {"max": F.max, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}
    found = cuts(rows if like is None else like, key, order[0], hot, parts)
    if found is None:
        own = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return rows.withColumns({name: run[kind](names[name]).over(own) for name, (kind, _) in columns.items()}).drop(*names.values())
    block = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(order[0]))), F.lit(0))
    cut = rows.join(F.broadcast(found), F.col(key).eqNullSafe(F.col("__key")), "left").withColumn("__block", block)
    total = {"max": F.max, "sum": F.sum, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))}
    totals = cut.where("__cuts is not null").groupBy(key, "__block").agg(*(total[kind](names[name]).alias(f"__t_{name}") for name, (kind, _) in columns.items()))
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # parts rows of a key
    offsets = totals.select(F.col(key).alias("__at"), F.col("__block").alias("__of"), *(run[kind](f"__t_{name}").over(before).alias(f"__o_{name}") for name, (kind, _) in columns.items()))
    own = Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    joined = cut.join(F.broadcast(offsets), F.col(key).eqNullSafe(F.col("__at")) & (F.col("__block") == F.col("__of")), "left")
    joined = joined.withColumns({f"__w_{name}": run[kind](names[name]).over(own) for name, (kind, _) in columns.items()})
    both = {
        "max": lambda w, o: F.greatest(w, o),
        "last": lambda w, o: F.coalesce(w, o),
        "sum": lambda w, o: F.when(w.isNotNull() | o.isNotNull(), F.coalesce(w, F.lit(0)) + F.coalesce(o, F.lit(0))),
    }
    out = {name: both[kind](F.col(f"__w_{name}"), F.col(f"__o_{name}")) for name, (kind, _) in columns.items()}
    helpers = [*names.values(), "__key", "__cuts", "__block", "__at", "__of", *(f"__{x}_{name}" for name in columns for x in "wo")]
    return joined.withColumns(out).drop(*helpers)
