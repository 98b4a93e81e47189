"""Evaluates plan rows over the postings: one relational plan for a single query or a batch.

Rows meet on (query, document), by one shuffle; the aggregations to alternatives, clauses
and documents then need none.  Positions are read only for phrases and for the top hits that
proximity re-ranks.  Scores are rounded to 9 decimals, so that equal documents tie however their sums were
ordered.  Plan rows are broadcast up to SMALL, beyond which they are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import local_rows

PLAN = "query_id int, role string, clause int, alt int, slot int, slots int, term string, offset int"
RERANK, DEEPEST = 100, 10_000
SMALL = 200_000


def small(rows: DataFrame, n: int) -> DataFrame:
    """rows, of which there are n, as a side to broadcast where they are few."""
    return F.broadcast(rows) if n <= SMALL else rows


def slot_scores(postings: DataFrame, dictionary: DataFrame, plan: DataFrame, documents: int, average: float, boost: float, n: int, phrases: bool = True) -> DataFrame:
    """A row per (query, slot, document) with the BM25 score of the slot, and positions for phrases."""
    terms = plan.select("term").distinct()
    idf = F.log(1 + (F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    slots = plan.join(dictionary.join(small(terms, n), "term", "left_semi"), "term").withColumn("idf", idf).drop("df")
    tf = boost * F.col("title_tf") + F.col("body_tf")
    score = F.col("idf") * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * F.col("length") / F.lit(max(1e-6, average))))
    shifted = F.when(F.col("offset").isNotNull(), F.transform("positions", lambda p: p - F.col("offset"))) if phrases else F.lit(None).cast("array<int>")
    return postings.join(small(slots, n), "term").withColumns({"score": score, "starts": shifted})


def documents_of(slots: DataFrame) -> DataFrame:
    """query_id, doc_id, matched, score: documents that match a required clause and no excluded one."""
    rows = slots.select("query_id", "doc_id", "role", "clause", "alt", "slots", "score", "starts").repartition("query_id", "doc_id")
    alternatives = rows.groupBy("query_id", "doc_id", "role", "clause", "alt").agg(
        F.count(F.lit(1)).alias("present"), F.first("slots").alias("slots"), F.sum("score").alias("score"), F.collect_list("starts").alias("starts"))
    start = F.aggregate(F.slice("starts", 2, F.size("starts")), F.get("starts", F.lit(0)), F.array_intersect)
    holds = (F.col("present") == F.col("slots")) & ((F.size("starts") == 0) | (F.size(start) > 0))
    clauses = alternatives.filter(holds).groupBy("query_id", "doc_id", "role", "clause").agg(F.max("score").alias("score"))
    out = clauses.groupBy("query_id", "doc_id").agg(
        F.count_if(F.col("role") == "req").alias("matched"), F.count_if(F.col("role") == "exc").alias("excluded"),
        F.round(F.sum(F.when(F.col("role") == "req", F.col("score"))), 9).alias("score"))
    return out.filter((F.col("excluded") == 0) & (F.col("matched") > 0)).drop("excluded")


def proximity(postings: DataFrame, plan: DataFrame, hits: DataFrame, clauses: int, n: int) -> DataFrame:
    """query_id, doc_id, factor: how the closeness of the clauses raises the score of a top hit."""
    first = plan.filter((F.col("role") == "req") & (F.col("slot") == 0)).select("query_id", "clause", "term").distinct()
    wanted = hits.select("query_id", "doc_id").join(small(first, n), "query_id")
    events = postings.select("term", "doc_id", "positions").join(small(wanted, n * RERANK), ["term", "doc_id"])  # at most RERANK documents a query
    events = events.select("query_id", "doc_id", "clause", F.explode("positions").alias("at"))
    so_far = Window.partitionBy("query_id", "doc_id").orderBy("at", "clause").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("clause") == c, F.col("at"))).over(so_far).alias(f"c{c}") for c in range(clauses)]
    names = [F.col(f"c{c}") for c in range(clauses)]
    seen = sum((F.when(n.isNotNull(), 1).otherwise(0) for n in names), F.lit(0))
    every = Window.partitionBy("query_id", "doc_id")
    events = events.select("query_id", "doc_id", "clause", "at", *last)
    events = events.withColumn("k", F.size(F.collect_set("clause").over(every)))
    span = F.col("at") - F.least(*names)
    spans = events.filter((F.col("k") >= 2) & (seen == F.col("k"))).groupBy("query_id", "doc_id").agg(F.min(span).alias("span"), F.first("k").alias("k"))
    slack = F.greatest(F.lit(0), F.col("span") - (F.col("k") - 1))
    return spans.select("query_id", "doc_id", (1 + 0.5 / (1 + slack)).alias("factor"))


def evaluate(spark: SparkSession, postings: DataFrame, dictionary: DataFrame, rows: list[tuple], pages: list[tuple[int, int, int]], documents: int, average: float, boost: float) -> tuple[DataFrame, DataFrame]:
    """hits (query_id, rank, doc_id, matched, score) and totals (query_id, match_mode, total).

    rows: of plans; pages: (query_id, offset, limit) of all queries, those without a required clause included.
    """
    plan = local_rows(spark, rows, PLAN)
    terms = sorted({r[6] for r in rows})
    some = postings.filter(F.col("term").isin(terms)) if len(terms) <= 1000 else postings
    required: dict[int, int] = {}
    for r in rows:
        if r[1] == "req":
            required[r[0]] = max(required.get(r[0], 0), r[2] + 1)
    needs = local_rows(spark, [(q, required.get(q, 0), o, n, min(DEEPEST, max(o + n, RERANK))) for q, o, n in pages], "query_id int, required int, first int, size int, depth int")
    slots = slot_scores(some, dictionary, plan, documents, average, boost, len(rows), any(r[7] is not None for r in rows))
    found = documents_of(slots).join(small(needs, len(pages)), "query_id").withColumn("whole", F.col("matched") == F.col("required"))
    totals = found.groupBy("query_id").agg(F.count_if("whole").alias("whole"), F.count(F.lit(1)).alias("any"))
    totals = needs.select("query_id").join(totals, "query_id", "left")
    partial = (F.coalesce("any", F.lit(0)) > 0) & (F.col("whole") == 0)
    totals = totals.select("query_id", F.when(partial, "ANY").otherwise("ALL").alias("match_mode"), F.coalesce(F.when(partial, F.col("any")).otherwise(F.col("whole")), F.lit(0)).alias("total"))
    order = Window.partitionBy("query_id").orderBy(F.desc("matched"), F.desc("score"), "doc_id")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.col("depth")).filter(F.col("rank") <= DEEPEST)
    best = Window.partitionBy("query_id")
    top = top.withColumn("any_whole", F.max("whole").over(best)).filter(F.col("whole") | ~F.col("any_whole"))
    if any(n >= 2 for n in required.values()):
        near = proximity(some, plan, top.filter((F.col("rank") <= RERANK) & (F.col("required") >= 2)), max(required.values()), len(rows))
        top = top.join(near, ["query_id", "doc_id"], "left").withColumn("score", F.round(F.col("score") * F.coalesce("factor", F.lit(1.0)), 9))
        again = Window.partitionBy("query_id").orderBy(F.col("rank") > RERANK, F.when(F.col("rank") > RERANK, F.col("rank")), F.desc("matched"), F.desc("score"), "doc_id")
        top = top.withColumn("rank", F.row_number().over(again))
    hits = top.filter((F.col("rank") > F.col("first")) & (F.col("rank") <= F.col("first") + F.col("size")))
    return hits.select("query_id", (F.col("rank") - F.col("first")).cast("int").alias("rank"), "doc_id", F.col("matched").cast("int").alias("matched"), "score"), totals
