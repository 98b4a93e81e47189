"""Spelling corrections and word lookups over the lexicon tables, for a batch of words at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.distance import bigrams, confusable_variants, weighted
from .storage import local_rows


@F.pandas_udf(DoubleType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def candidates(spark: SparkSession, bigram_table: DataFrame, words: list[str]) -> DataFrame:
    """query, word, df, jaccard: lexicon words that share enough bigrams, of nearly the same length."""
    asked = local_rows(spark, [(w, len(w), len(g), x) for w in words for g in [bigrams(w)] for x in g], "query string, length int, asked int, bigram string")
    grams = sorted({g for w in words for g in bigrams(w)})
    some = bigram_table.filter(F.col("bigram").isin(grams)) if len(grams) <= 2000 else bigram_table
    met = some.join(F.broadcast(asked), "bigram").filter(F.abs(F.length("word") - F.col("length")) <= 2)
    shared = met.groupBy("query", "word").agg(F.count(F.lit(1)).alias("common"), F.first("df").alias("df"), F.first("n").alias("n"), F.first("asked").alias("asked"))
    jaccard = F.round(F.col("common") / (F.col("asked") + F.col("n") - F.col("common")), 9)
    return shared.select("query", "word", "df", jaccard.alias("jaccard")).filter("jaccard >= 0.3")


def corrections(spark: SparkSession, lexicon: DataFrame, bigram_table: DataFrame, words: list[str]) -> dict[str, tuple[str, str]]:
    """word -> (lexicon word, display) for words that aren't in the lexicon and have a correction."""
    words = [w for w in dict.fromkeys(words) if 2 <= len(w) <= 32 and any(c.isalpha() for c in w)]
    if not words:
        return {}
    variants = {w: confusable_variants(w) for w in words}
    looked = sorted({*words, *(v for x in variants.values() for v in x)})
    known = {r["word"]: (r["df"], r["display"]) for r in lookup(spark, lexicon, looked).collect()}  # at most one row for each word asked
    out, rest = {}, []
    for w in words:
        if w in known:
            continue
        best = min((v for v in variants[w] if v in known), key=lambda v: (-known[v][0], v), default=None)
        if best is None:
            rest.append(w)
        else:
            out[w] = (best, known[best][1])
    if rest:
        near = candidates(spark, bigram_table, rest).withColumn("distance", F.round(distance("query", "word"), 9))
        near = near.filter(F.col("distance") <= F.when(F.length("query") <= 4, 1.0).otherwise(2.0))
        best = near.groupBy("query").agg(F.min_by("word", F.struct("distance", -F.col("df"), -F.col("jaccard"), "word")).alias("word"))
        for r in best.join(lexicon.select("word", "display"), "word").collect():  # one row for each word asked
            out[r["query"]] = (r["word"], r["display"])
    return out


def lookup(spark: SparkSession, table: DataFrame, keys: list[str], column: str = "word") -> DataFrame:
    """The table's rows with the given keys: a pushed-down filter for a few, a join for many."""
    if len(keys) <= 1000:
        return table.filter(F.col(column).isin(keys))
    return table.join(F.broadcast(local_rows(spark, [(k,) for k in keys], f"{column} string")), column, "left_semi")


def with_prefix(spark: SparkSession, lexicon: DataFrame, prefixes: list[str], most: int, exact: bool = True) -> DataFrame:
    """prefix, rank, word, display: the most frequent words with each prefix; the prefix itself counts if ``exact``."""
    if len(prefixes) == 1:
        rows = lexicon.filter(F.col("word").startswith(prefixes[0])).withColumn("prefix", F.lit(prefixes[0]))
    else:
        rows = lexicon.join(F.broadcast(local_rows(spark, [(p,) for p in prefixes], "prefix string")), F.substring("word", 1, 2) == F.substring("prefix", 1, 2))
        rows = rows.filter(F.col("word").startswith(F.col("prefix")))
    rows = rows if exact else rows.filter("word <> prefix")
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("df"), "word"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= most).select("prefix", "rank", "word", "display")
