"""Mixing sources to target weights by systematic sampling.

Targets: sources share the total size by weight; a target stops at ``most`` times its source's
size and the excess is reshared by weight.  The fixed point has a closed form: with
sources ordered by most * size / weight, the first k stop, and the rest get
weight * (total - their stops) / (their weights).  It is computed by a window over the
table of sources, one row for each.

Copies: within a source, documents are ordered by size, then id; the r = target / size expected
copies of each are prefix-summed (r * rank), one random offset is added, and a document is
emitted once for each integer boundary that its interval crosses.  Ordering by size
stratifies the sample, so the taken words come near the target.

Ranks without a hot task: the rows are range-partitioned by (source, size, id) and saved with their
partition's number; counts for each (source, partition) are prefix-summed, and ranks within a
(source, partition) are added.  A source with a third of all rows spans a third of the partitions.

Defined results.  Null text: size 0.  Null source: a source of its own, last.  Null or repeated ids and
repeated rows: each row is a document of its own.  A source without words: target 0, nothing
taken.  Empty table: empty result.  Extra columns: ignored by ``mix``, kept by ``expand``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, n_words, whole_row

#: Offsets are odd multiples of 2^-17, so that they stay clear of integer boundaries.
_OFFSET = "(conv(substr(md5(concat(coalesce(source, ''), '{seed}')), 1, 4), 16, 10) + 0.5D) / 65536.0D"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size -> and weight, target.  Weights repeat over the sources in code point order, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    values = F.array(*[F.lit(w).cast("long") for w in weights])
    rows = sizes.withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("weight", F.element_at(values, ((F.col("at") - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("stop", most * F.col("source_size"))
    by = Window.orderBy(F.col("stop") / F.col("weight"), "at")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "total": F.sum("source_size").over(everything),
        "stops": F.coalesce(F.sum("stop").over(before), F.lit(0)),
        "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # the level that holds if all before this one stop; the first that its level doesn't pass sets it
    rows = rows.withColumn("free", F.col("weight") * (F.col("total") - F.col("stops")) <= F.col("stop") * F.col("left"))
    first = F.min_by(F.struct("stops", "left"), F.when(F.col("free"), F.struct(F.col("stop") / F.col("weight"), F.col("at")))).over(everything)
    rows = rows.withColumn("set", first)
    level = (F.col("weight") * (F.col("total") - F.col("set.stops"))).cast("double") / F.col("set.left").cast("double")
    stopped = F.col("set").isNull() | (F.col("stop").cast("double") <= level)
    return rows.withColumn("target", F.when(stopped, F.col("stop").cast("double")).otherwise(level)).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 17, broadcast_sources: int = 100_000) -> DataFrame:
    """A row per row of docs: doc_id, source, size, source_size, target, copies, taken."""
    work = Workspace(docs.sparkSession, "mix")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"))
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")]
    rows = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    rows = work.save(rows, "rows")
    parts = work.save(rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "parts")
    goals = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    goals = goals.select(F.col("source").alias("s"), "source_size", "target")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", F.coalesce(before, F.lit(0))).join(goals, F.col("source").eqNullSafe(F.col("s")))
    parts = work.save(parts.select(F.col("part").alias("p"), "s", "before", "source_size", "target"), "goals")
    if parts.limit(broadcast_sources + 1).count() <= broadcast_sources:
        parts = F.broadcast(parts)
    rank = F.row_number().over(Window.partitionBy("source", "part").orderBy("size", "doc_id"))
    rows = rows.withColumn("rank", rank).join(parts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double"))
    rows = rows.withColumns({"k": (F.col("rank") + F.col("before")).cast("double"), "each": each, "u": F.expr(_OFFSET.replace("{seed}", str(seed)))})
    crossed = F.floor(F.col("u") + F.col("each") * F.col("k")) - F.floor(F.col("u") + F.col("each") * (F.col("k") - 1))
    copies = F.when(F.col("source_size") > 0, F.least(crossed, F.lit(most).cast("long"))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def expand(docs: DataFrame, *, id_col: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mixed documents, all their columns: each as often as it was taken."""
    work = Workspace(docs.sparkSession, "expand")
    key = F.xxhash64(F.col(id_col), F.col(source).cast("string"), n_words(F.col(text)))
    taken = mix(docs, id_col=id_col, source=source, text=text, **how)
    taken = taken.select(F.xxhash64("doc_id", "source", "size").alias("_key"), "copies")
    taken = taken.groupBy("_key").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).filter("_copies > 0")
    taken = work.save(taken, "taken")
    # by shuffle at every size, as one table has a row for nearly each row of the other
    rows = docs.select(whole_row(docs).alias("row"), key.alias("_own")).join(taken.hint("merge"), F.col("_own") == F.col("_key"))
    single = rows.filter("_rows = 1").withColumn("_n", F.col("_copies").cast("int"))
    if taken.filter("_rows > 1").isEmpty():
        return _repeated(single)
    # rows of one key share its copies as evenly as whole numbers allow, by ranks from range partitions: a key may have any number of rows
    many = rows.filter("_rows > 1").withColumn("_hash", F.xxhash64("row")).withColumn("_at", F.monotonically_increasing_id())
    many = work.save(work.save(many, "given").repartitionByRange("_own", "_hash", "_at").withColumn("_part", F.spark_partition_id()), "many")
    work.drop("given")
    parts = many.groupBy(F.col("_own").alias("_o"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_m"))
    before = F.sum("_m").over(Window.partitionBy("_o").orderBy("_p")) - F.col("_m")  # a row for each partition that holds the key
    many = many.join(parts.withColumn("_before", before), (F.col("_own") == F.col("_o")) & (F.col("_part") == F.col("_p")))
    turn = F.col("_before") + F.row_number().over(Window.partitionBy("_own", "_part").orderBy("_hash", "_at"))
    share = lambda k: F.floor(F.col("_copies") * k / F.col("_rows"))
    many = many.withColumn("_turn", turn).withColumn("_n", (share(F.col("_turn")) - share(F.col("_turn") - 1)).cast("int"))
    return _repeated(single.select("row", "_n").unionByName(many.select("row", "_n")))


def _repeated(rows: DataFrame) -> DataFrame:
    """The whole rows, ``_n`` times each."""
    return rows.filter("_n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("row.*")
