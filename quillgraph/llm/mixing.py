"""Mixing of sources to target shares of the total size.

Each source's records are shuffled by a hash and cut into blocks of about equal
size. Golden-ratio points, mapped through the cumulative weights of the
sources, say which source each slot of the mix takes from; the slots of a
source are ranked and take its blocks in turn, as many times round as allowed.
Each source has a quota of slots: its share of the total in blocks, or all of
its blocks at every repeat if those are too few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sizing import durable

#: Points lie on a circle of so many places, and the next one is the golden section of it further (an odd number, so all
#: places are met before one recurs). In integers, so that no slot number is too great.
CIRCLE, GOLDEN = 1 << 31, 1_327_217_885

#: Records that a window over one part of a source holds, about.
ROWS_PER_PART = 20_000


def _offsets(rows: DataFrame, group: str, part: Column, order: list[Column], size: Column) -> DataFrame:
    """``rows`` with ``offset``, the sum of ``size`` over the rows of the group before this one.

    Rows are in order of ``part`` and then of ``order``. Rows are summed within
    their part; only the sums of parts are summed over a whole group (a number
    for each ROWS_PER_PART rows, so 10 billion rows are half a million numbers).
    """
    rows = rows.withColumns({"_part": part, "_size": size})
    inner = W.partitionBy(group, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(group, "_part").agg(F.sum("_size").alias("_sum"))
    before = sums.select(group, "_part", F.coalesce(F.sum("_sum").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    summed = rows.withColumn("_inner", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    return summed.join(before, [group, "_part"]).withColumn("offset", F.col("_base") + F.col("_inner")).drop("_part", "_size", "_base", "_inner")


def source_budget(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, own, total, wanted, reached, short) of each source of ``plan``.

    sizes: (source, size). total is the size of all records whose source is in
    the plan; wanted is target_share of it; reached is wanted, or own size
    times max_repeats where that is less (``short``). Sources without records
    have own 0; a null source takes no part; a source named twice counts once.
    The plan has a row for each source and is small.
    """
    plan = plan.where("source is not null").select("source", "target_share", "max_repeats").dropDuplicates(["source"])
    own = sizes.where("source is not null").groupBy("source").agg(F.sum("size").alias("own"))
    joined = plan.join(own, "source", "left").withColumn("own", F.coalesce("own", F.lit(0)).cast("long"))
    total = joined.agg(F.sum("own").alias("total"))
    most = F.col("own") * F.col("max_repeats")
    return (
        joined.crossJoin(F.broadcast(total))  # one row
        .withColumn("wanted", F.col("target_share") * F.col("total"))
        .withColumn("short", most < F.col("wanted"))
        .withColumn("reached", F.least(F.col("wanted"), most.cast("double")))
    )


def slots_of(spark: SparkSession, quotas: list[tuple[str, int]]) -> DataFrame:
    """(source, slot, rank): the slots of a mix, of each source as many as its quota, ranked from 0.

    Points are so even that each source has its quota by a few slots after the
    sum of all quotas; slots after a source's quota is full are dropped.
    """
    quotas = [(name, n) for name, n in quotas if n > 0]
    whole = sum(n for _, n in quotas)
    bounds, at = [], 0
    for name, n in quotas:
        bounds.append((name, at * CIRCLE // whole, (at + n) * CIRCLE // whole, n))
        at += n
    # An interval of the circle has its share of the points to within about the logarithm of their number.
    spare = (4 + whole.bit_length()) * whole // min((n for _, n in quotas), default=1) + 1
    shares = spark.createDataFrame(bounds, "source string, low long, high long, quota long")
    points = spark.range(whole + spare if quotas else 0).withColumn("point", F.pmod(F.pmod("id", F.lit(CIRCLE)) * GOLDEN, F.lit(CIRCLE)))
    slots = points.join(F.broadcast(shares), (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))  # a row for each source of the plan
    ranked = _offsets(slots, "source", F.floor(F.col("id") / ROWS_PER_PART), [F.col("id")], F.lit(1).cast("long"))
    return ranked.where("offset < quota").select("source", F.col("id").alias("slot"), F.col("offset").alias("rank"))


def mix(records: DataFrame, plan: DataFrame, key: str = "doc_id", block: int = 2_000, seed: int = 7) -> DataFrame:
    """(slot, key, source, repeat, tokens): the records of the mix in order of slots.

    records: (key, source, tokens). Each source gets ``reached`` of its budget,
    to within a block of ``block`` tokens; a source that is short gives each of
    its records exactly max_repeats times. repeat counts from 1 to at most
    max_repeats. Records without tokens take part in no block of their own and
    go with the block they fall into. Empty input gives an empty mix. Records,
    blocks and slots are placed by sums over parts of bounded size, so no
    source is gathered in one task.
    """
    spark = records.sparkSession
    records = durable(records.where("source is not null").select(key, "source", F.coalesce("tokens", F.lit(0)).alias("tokens")))
    budget = durable(source_budget(records.select("source", F.col("tokens").alias("size")), plan))
    parts = max(1, -(-records.count() // ROWS_PER_PART))
    rows = [r for r in budget.orderBy("source").collect() if r["reached"] > 0]  # a row for each source of the plan
    turns = [(r["source"], -(-r["own"] // block), r["max_repeats"], r["short"], r["reached"]) for r in rows]
    sizes = F.broadcast(spark.createDataFrame([t[:3] for t in turns], "source string, n_blocks long, max_repeats int"))
    shuffled = F.xxhash64(F.col(key), F.lit(seed))
    wanted = records.join(sizes.select("source", "n_blocks"), "source")
    placed = _offsets(wanted.withColumn("_hash", shuffled), "source", F.pmod(F.shiftright("_hash", 8), F.lit(parts)), [F.col("_hash"), F.col(key)], F.col("tokens"))
    blocks = placed.select(key, "source", "tokens", F.least(F.floor(F.col("offset") / block), F.col("n_blocks") - 1).alias("block"))

    quotas = [(name, n * most if short else min(n * most, max(1, round(reached / block)))) for name, n, most, short, reached in turns]
    slots = slots_of(spark, quotas).join(sizes, "source")
    taken = slots.select("source", "slot", F.pmod("rank", "n_blocks").alias("block"), (F.floor(F.col("rank") / F.col("n_blocks")) + 1).alias("repeat"))
    return blocks.join(taken, ["source", "block"]).select("slot", key, "source", F.col("repeat").cast("int").alias("repeat"), "tokens")


def shares_reached(mixed: DataFrame, records: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, own_tokens, mixed_tokens, share_of_total, share_of_mix, most_repeats, short) of each source of the plan.

    share_of_total is of the tokens of all records whose source is in the plan;
    this one is held at the target for every source that isn't short. If some
    are, the mix is smaller than the total, and the others' shares of the mix
    are over their targets. short, as the mix shows it: every record is taken
    max_repeats times, and the target isn't reached.
    """
    budget = source_budget(records.select("source", F.col("tokens").alias("size")), plan)
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.max("repeat").alias("most_repeats"))
    whole = mixed.agg(F.sum("tokens").alias("_all"))
    taken = F.coalesce("mixed_tokens", F.lit(0))
    return (
        budget.join(got, "source", "left")
        .crossJoin(F.broadcast(whole))  # one row
        .select(
            "source", "target_share", "max_repeats", F.col("own").alias("own_tokens"), taken.alias("mixed_tokens"),
            F.coalesce(F.try_divide(taken, "total"), F.lit(0.0)).alias("share_of_total"), F.coalesce(F.try_divide(taken, "_all"), F.lit(0.0)).alias("share_of_mix"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), ((taken == F.col("own") * F.col("max_repeats")) & (taken < F.col("wanted"))).alias("short"),
        )
    )
