"""Language identification in two levels: the family first, then the language within it.

Features: hashed frequencies (square roots, so unit length) of byte pairs, byte triples and whole words of
the lower-cased text.  At each level one-versus-one linear support vector machines vote; a tie
goes to the larger sum of margins.  Training uses a bounded sample, ``sample`` rows, shared equally by
the languages (those with the smallest hashes of their ids); prediction reads every text whole.

Defined results.  Null text or one without a letter: ``und``, score 0.  Null labels: not learned from.  A label
without a known family is a family of its own.  Nothing to learn from: ``und`` for all.  Null or repeated
ids, repeated rows: each row has its own result.  Empty table: empty result.  Extra columns: kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import hashing
from .common import small_batches, whole_row

FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi", "romance": "fr es it pt ro ca gl oc rm",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk", "baltic": "lt lv", "celtic": "ga gd cy br",
    "uralic": "fi et hu", "turkic": "tr az kk uz ky tk", "indic": "hi bn ur mr gu pa ne si", "iranian": "fa ku ps tg",
    "semitic": "ar he am mt", "dravidian": "ta te kn ml", "sinitic": "zh yue", "japonic": "ja", "koreanic": "ko", "hellenic": "el",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BUCKETS = 4096
_U = np.uint64


def family(language: str) -> str:
    return _FAMILY.get(language.lower().split("-")[0].split("_")[0], f"only {language}")


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """First row and features (rows x BUCKETS) for some rows at a time."""
    for first, flat, bounds in hashing.pieces(texts, 1 << 19):
        low = hashing._LOWER[flat].astype(np.uint64)
        two = low[:-1] * _U(0x9E3779B97F4A7C15) + low[1:] * _U(0xC2B2AE3D27D4EB4F) if len(low) > 1 else low[:0]
        three = two[:-1] + low[2:] * _U(0x165667B19E3779F9) if len(low) > 2 else low[:0]
        codes = [((hashing.mix(x) >> _U(52)) & _U(BUCKETS - 1)).astype(np.int64) for x in (two, three + _U(1))]
        h, at = hashing.words(flat, bounds)
        own = (h >> _U(52)).astype(np.int64)
        for i in range(0, len(bounds) - 1, 256):
            n = min(256, len(bounds) - 1 - i)
            out = np.zeros((n, BUCKETS), np.float32)
            for r in range(n):
                a, b = bounds[i + r], bounds[i + r + 1]
                if b > a:
                    row = np.bincount(np.concatenate([codes[0][a : max(a, b - 1)], codes[1][a : max(a, b - 2)], own[at[i + r] : at[i + r + 1]]]), minlength=BUCKETS)
                    out[r] = np.sqrt(row / max(1, row.sum()))
            yield first + i, out


def svm(x: np.ndarray, y: np.ndarray, cost: float = 50.0, turns: int = 200) -> np.ndarray:
    """Weights, the last for a constant, of a linear machine with squared hinge loss; y is -1 or 1.  Classes weigh the same."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype) * cost
    w = old = np.zeros(x.shape[1], x.dtype)
    step, t = 1 / (1 + 2 * float((weight * (x * x).sum(axis=1)).sum())), 1.0
    for _ in range(turns):
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = w + x.dtype.type((t - 1) / t_next) * (w - old)
        slack = np.maximum(0, 1 - y * (x @ v))
        old, t = w, t_next
        w = v - x.dtype.type(step) * (v - 2 * (x.T @ (weight * slack * y)))
    return w


class OneVersusOne:
    def __init__(self, x: np.ndarray, labels: np.ndarray) -> None:
        self.classes = sorted(set(labels.tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        made = []
        for i, j in self.pairs:
            some = (labels == self.classes[i]) | (labels == self.classes[j])
            made.append(svm(x[some], np.where(labels[some] == self.classes[i], 1, -1).astype(x.dtype)))
        self.weights = np.array(made, np.float32).T if made else np.zeros((BUCKETS + 1, 0), np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers and scores, 0 to 1."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        votes = np.zeros((len(x), len(self.classes)))
        worst = np.full((len(x), len(self.classes)), 10.0)
        for p, (i, j) in enumerate(self.pairs):
            m = margin[:, p]
            for c, own in ((i, m), (j, -m)):
                votes[:, c] += (own > 0) + 1e-3 * np.tanh(own)
                worst[:, c] = np.minimum(worst[:, c], own)
        best = votes.argmax(axis=1)
        return best, 1 / (1 + np.exp(-3.0 * worst[np.arange(len(x)), best]))


class LanguageModel:
    def __init__(self, *, text: str = "text", id_col: str = "doc_id", sample: int = 4000, seed: int = 3) -> None:
        self.text, self.id_col, self.sample, self.seed = text, id_col, sample, seed
        self.families: OneVersusOne | None = None
        self.within: dict[str, OneVersusOne] = {}

    def fit_arrays(self, x: np.ndarray, labels: np.ndarray) -> LanguageModel:
        if len(labels):
            of = np.array([family(y) for y in labels])
            self.families = OneVersusOne(x, of)
            self.within = {f: OneVersusOne(x[of == f], labels[of == f]) for f in self.families.classes}
        return self

    def fit(self, docs: DataFrame, label: str = "lang") -> LanguageModel:
        """docs: rows to learn from."""
        small_batches(docs.sparkSession)
        rows = docs.select(F.col(self.id_col).alias("own"), F.col(label).cast("string").alias("lang"), F.col(self.text).cast("string").alias("text"))
        rows = rows.filter("own is not null and lang is not null and text is not null")
        n = max(1, rows.select("lang").distinct().count())
        each = max(1, self.sample // n)
        some = rows.select(F.col("own").alias("_id"), F.col("lang").alias("_lang"))
        # a language may have a third of all rows: first the smallest hashes of 64 shares of it, some eight times what a
        # share can expect to give, then the smallest of those
        some = some.withColumn("_h", F.xxhash64("_id", F.lit(self.seed))).withColumn("_share", F.pmod("_h", F.lit(64)))
        for by in (["_lang", "_share"], ["_lang"]):
            order = Window.partitionBy(*by).orderBy("_h", "_id")
            most = each if by == ["_lang"] else min(each, 64 + each // 8)
            some = some.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
        some = some.orderBy("_h", "_id").limit(self.sample).select("_id").distinct()  # more than these only if labels are more

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                packed = [r.astype(np.float16).tobytes() for _, x in features(batch.column(2)) for r in x]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["h", "lang", "x"])

        taken = rows.join(F.broadcast(some), F.col("own") == F.col("_id"), "left_semi").select(F.xxhash64("own", F.lit(self.seed)).alias("h"), "lang", "text")
        one = taken.mapInArrow(task, "h long, lang string, x binary").groupBy("h").agg(F.min(F.struct("lang", "x")).alias("r"))  # one row for a repeated id
        got = sorted(tuple(r) for r in one.select("h", "r.lang", "r.x").collect())  # at most ``sample`` rows
        x = np.array([np.frombuffer(g[2], np.float16) for g in got], np.float32).reshape(len(got), BUCKETS)
        return self.fit_arrays(x, np.array([g[1] for g in got]))

    def predict(self, docs: DataFrame) -> DataFrame:
        """docs with lang_pred and score."""
        small_batches(docs.sparkSession)
        families, within = self.families, self.within
        schema = StructType([StructField("row", docs.schema), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
        text = F.col(self.text).cast("string")
        rows = docs.select(whole_row(docs).alias("row"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                lang, score = np.full(n, "und", object), np.zeros(n)
                letter = batch.column("letter").to_numpy(zero_copy_only=False).astype(bool)
                if families is not None:
                    for first, x in features(batch.column("text")):
                        f, sure = families.predict(x)
                        for c in np.unique(f):
                            model = within[families.classes[c]]
                            own = np.flatnonzero(f == c)
                            best, more = model.predict(x[own])
                            lang[first + own] = np.array(model.classes, object)[best]
                            score[first + own] = np.minimum(sure[own], more)
                lang[~letter], score[~letter] = "und", 0.0
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

        return rows.mapInArrow(task, schema).select("row.*", "lang_pred", "score")
