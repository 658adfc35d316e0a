"""Instruments, statistics, reference data and news: last values, changes, and scoping by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.trades import as_of


def latest_definitions(rows: DataFrame, key: str, validity: str, order: str) -> DataFrame:
    """The last accepted row of each key: one whose validity doesn't advance on what was accepted before is skipped."""
    before = F.max(validity).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    accepted = rows.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(validity) > F.col("__before"))).drop("__before")
    columns = [c for c in accepted.columns if c != key]
    return accepted.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(key, "r.*")


def generations(rows: DataFrame, key: str, identity: list[str], order: str) -> DataFrame:
    """Adds generation: how often the identity has changed (null-safe) up to the row."""
    own = Window.partitionBy(key).orderBy(order)
    changed = F.when(F.row_number().over(own) == 1, 0).otherwise((~F.lag(F.struct(*identity)).over(own).eqNullSafe(F.struct(*identity))).cast("int"))
    return rows.withColumn("__changed", changed).withColumn("generation", F.sum("__changed").over(own)).drop("__changed")


def changes(rows: DataFrame, key: str, watched: list[str], order: str) -> DataFrame:
    """Rows whose watched values differ (null-safe) from those of the row before; the first row counts."""
    last = F.lag(F.struct(*watched)).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__last", last).where(F.col("__last").isNull() | ~F.col("__last").eqNullSafe(F.struct(*watched))).drop("__last")


def halts(rows: DataFrame) -> DataFrame:
    """Halts (event 1) and resumptions (event 2) with the status before, of rows (seq, security_id, status, event)."""
    before = F.lag("status").over(Window.partitionBy("security_id").orderBy("seq"))
    rows = rows.withColumn("previous_status", before).where("event in (1, 2)")
    return rows.select("seq", "security_id", "previous_status", F.col("status").alias("new_status"), F.when(F.col("event") == 1, "halted").otherwise("resumed").alias("transition"))


def session_last(rows: DataFrame, starts: Column, value: str) -> DataFrame:
    """(security_id, session, value): the last value in the last session; a session starts at each row for which starts holds."""
    session = F.sum(starts.cast("int")).over(Window.partitionBy("security_id").orderBy("seq"))
    rows = rows.withColumn("session", session)
    current = rows.groupBy("security_id", "session").agg(F.max_by(F.when(~starts, F.col(value)), F.when(~starts & F.col(value).isNotNull(), F.col("seq"))).alias(value))
    last = F.max("session").over(Window.partitionBy("security_id"))
    return current.withColumn("__last", last).where("session = __last").drop("__last")


def last_values(rows: DataFrame) -> DataFrame:
    """By security and kind the value of the highest report number; of equal numbers the first to arrive stays."""
    return rows.groupBy("security_id", "kind").agg(F.max_by("value", F.struct("rpt_seq", (-F.col("seq")).alias("s"))).alias("value"), F.max("rpt_seq").alias("rpt_seq"))


def group_phases(phases: DataFrame, members: DataFrame, block: int = 1024, lot: int = 8192) -> DataFrame:
    """Each change of a group's phase, for all its members: changes times members rows.

    A group's changes are dealt to blocks and its members to lots, of about these sizes, and each pair of them is joined for
    itself, so a large group is many tasks. A member meets a block's changes one after the other: repeated so shortly, columnar
    files hold them in a fraction of their bytes.
    """
    found = changes(phases, "security_group", ["status"], "seq")
    sizes = found.groupBy("security_group").agg(F.count("*").alias("__n")).join(members.groupBy("security_group").agg(F.count("*").alias("__m")), "security_group")
    sizes = sizes.select("security_group", F.ceil(F.col("__n") / block).alias("__blocks"), F.ceil(F.col("__m") / lot).alias("__lots"))
    # what is dealt out is small and what comes of it isn't, so the number of tasks is given: two pairs for each, or as many tasks as usual
    pairs = sizes.agg(F.sum(F.col("__blocks") * F.col("__lots"))).first()[0] or 0
    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(pairs // 2, 20_000))
    key = ["security_group", "__block", "__lot"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = members.join(sizes, "security_group").withColumn("__lot", F.pmod(F.xxhash64("security_id"), "__lots")).withColumn("__block", every("__blocks"))
    right = found.join(sizes, "security_group").withColumn("__block", F.pmod(F.xxhash64("seq"), "__blocks")).withColumn("__lot", every("__lots"))
    own = lambda rows: rows.drop("__blocks", "__lots").repartition(tasks, *key)
    columns = ["security_group", *(c for x in (found, members) for c in x.columns if c != "security_group")]
    return own(left).hint("merge").join(own(right), key).select(*columns)


def phase_intervals(phases: DataFrame) -> DataFrame:
    """(security_group, status, since, until): each phase of a group once, from one change (seq) to the next (until null: still). Members look it up; nothing is copied to them."""
    found = changes(phases, "security_group", ["status"], "seq")
    until = F.lead("seq").over(Window.partitionBy("security_group").orderBy("seq"))
    return found.select("security_group", "status", F.col("seq").alias("since"), until.alias("until"))


def phase_at(rows: DataFrame, members: DataFrame, phases: DataFrame) -> DataFrame:
    """rows (seq, security_id) with security_group, and the status that their group has by then: a lookup as of seq, by group."""
    grouped = rows.join(members.select("security_id", "security_group"), "security_id")
    return as_of(grouped, phases.select("seq", "security_group", "status"), ["status"], "security_group")


def search_symbols(instruments: DataFrame, column: str, text: str, limit: int = 20) -> DataFrame:
    """Case-insensitive contains, in order; 1 to 100 of them."""
    return instruments.where(F.contains(F.lower(column), F.lit(text.lower()))).orderBy(column).limit(min(max(limit, 1), 100))


def symbol_registry(rows: DataFrame) -> DataFrame:
    """(security_id, symbol) of rows (seq, security_id, symbol): the last symbol of each id, unless another id took it later."""
    last = rows.groupBy("security_id").agg(F.max_by(F.struct(F.upper("symbol").alias("symbol"), "seq"), "seq").alias("r")).select("security_id", "r.*")
    return last.groupBy("symbol").agg(F.max_by("security_id", "seq").alias("security_id")).select("security_id", "symbol")


def reassemble_news(parts: DataFrame) -> DataFrame:
    """Complete items of parts (seq, news_id, part_number, part_count, text): one for each number, joined in order.

    Parts out of bounds are dropped, of repeated numbers the first to arrive counts, and an item whose parts disagree on
    their count isn't complete. Single parts need no id.
    """
    sound = parts.where("part_number between 1 and part_count and part_count <= 64")
    single = sound.where("part_count = 1").select("news_id", F.lit(1).cast("bigint").alias("parts"), F.col("text"))
    many = sound.where("part_count > 1 and news_id <> 0").groupBy("news_id", "part_number").agg(F.min_by(F.struct("text", "part_count"), "seq").alias("p"))
    many = many.groupBy("news_id").agg(F.count("*").alias("parts"), F.min("p.part_count").alias("low"), F.max("p.part_count").alias("high"), F.array_sort(F.collect_list(F.struct("part_number", "p.text"))).alias("t"))
    many = many.where("low = high and parts = low")  # 64 parts at most
    return single.unionByName(many.select("news_id", "parts", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text")))


def current_generation(rows: DataFrame, definitions: DataFrame, identity: list[str]) -> DataFrame:
    """Rows (security_id, seq) that came after their security's identity changed last: a change wipes all state before it. Securities without definitions keep theirs."""
    found = generations(definitions, "security_id", identity, "seq")
    since = found.groupBy("security_id").agg(F.max(F.when(F.col("generation") > 0, F.struct("generation", (-F.col("seq")).alias("s")))).alias("g"))
    since = since.select("security_id", (-F.col("g.s")).alias("__since"))
    return rows.join(since, "security_id", "left").where("__since is null or seq > __since").drop("__since")


def members_of(rows: DataFrame, key: str, group: str, number: str) -> DataFrame:
    """One row for each member of a repeating group but those with number 0; a row without members stays, with null."""
    return rows.withColumn(group, F.explode_outer(F.filter(group, lambda x: x[number] != 0))).select(key, f"{group}.*")


def effective_status(own: DataFrame, phases: DataFrame, members: DataFrame) -> DataFrame:
    """(security_id, status, detached): a security follows its group's phase unless event 101 detached it; 102 lets it rejoin, with the phase of that moment.

    own: (seq, security_id, status, event); phases: (seq, security_group, status); members: (security_id, security_group).
    """
    state = own.groupBy("security_id").agg(F.max_by("event", F.when(F.col("event").isin(101, 102), F.col("seq"))).alias("way"), F.max_by(F.struct("seq", "status"), F.when(F.col("event") != 102, F.col("seq"))).alias("own"))
    group = phases.groupBy("security_group").agg(F.max_by(F.struct("seq", "status"), "seq").alias("phase"))
    rejoined = own.where("event = 102").groupBy("security_id").agg(F.max("seq").alias("rejoined"))
    found = members.join(group, "security_group", "left").join(state, "security_id", "left").join(rejoined, "security_id", "left")
    detached = F.coalesce(F.col("way") == 101, F.lit(False))
    joined = F.greatest(F.col("phase.seq"), F.col("rejoined"))  # the phase counts from then on
    follows = ~detached & F.col("phase").isNotNull() & (F.col("own").isNull() | (joined > F.col("own.seq")))
    return found.select("security_id", F.when(follows, F.col("phase.status")).otherwise(F.col("own.status")).alias("status"), detached.alias("detached"))


def lookup(instruments: DataFrame, column: str, symbol: str) -> DataFrame:
    """The instrument of a symbol, which may be in any case and have blanks around it."""
    return instruments.where(F.col(column) == F.upper(F.trim(F.lit(symbol))))


def within_life(parts: DataFrame, life: int, time: str) -> DataFrame:
    """Parts that come within life of the first of their item; later ones find it gone."""
    first = F.min(time).over(Window.partitionBy("news_id"))
    return parts.withColumn("__first", first).where(F.col(time) - F.col("__first") <= life).drop("__first")


def delisted(rows: DataFrame, active: DataFrame) -> DataFrame:
    """Subscriptions (security_id, ...) whose security isn't active any more: to be told and ended."""
    return rows.join(active.select("security_id").distinct(), "security_id", "left_anti")


def presence(columns: list[str]) -> Column:
    """A mask with a bit for each column, by position, that has a value."""
    out = F.lit(0).cast("bigint")
    for bit, name in enumerate(columns):
        out = out + F.when(F.col(name).isNotNull(), F.lit(1 << bit)).otherwise(0)
    return out


def versions(rows: DataFrame, key: str, groups: dict[str, list[str]], order: str) -> DataFrame:
    """Adds for each group of columns a counter of its changes (null-safe) up to the row, the first row being version 1; and any_version, of all of them."""
    own = Window.partitionBy(key).orderBy(order)
    for name, columns in {**groups, "any_version": [c for g in groups.values() for c in g]}.items():
        now = F.struct(*columns)
        rows = rows.withColumn(f"__{name}", F.when((F.row_number().over(own) == 1) | ~F.lag(now).over(own).eqNullSafe(now), 1).otherwise(0))
    return rows.withColumns({n: F.sum(f"__{n}").over(own) for n in (*groups, "any_version")}).drop(*(f"__{n}" for n in (*groups, "any_version")))


def last_values_by_epoch(rows: DataFrame) -> DataFrame:
    """As last_values, where report numbers start again with each epoch (its version): older values stay until the new epoch brings one."""
    newest = F.struct("epoch", "rpt_seq", (-F.col("seq")).alias("s"))
    return rows.groupBy("security_id", "kind").agg(F.max_by("value", newest).alias("value"), F.max("epoch").alias("epoch"), F.max_by("rpt_seq", newest).alias("rpt_seq"))


def latest_status(rows: DataFrame) -> DataFrame:
    """The last administrative status of each security, from rows (seq, security_id, status, event) with event 1 or 2, kept apart from its trading status."""
    return rows.where("event in (1, 2)").groupBy("security_id").agg(F.max_by("status", "seq").alias("admin_status"), F.max("seq").alias("seq"))
