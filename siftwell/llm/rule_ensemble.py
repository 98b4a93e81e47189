"""Quality scores from a sparse ensemble of rules.

Statistics of the whole text are Spark columns.  Boosted trees are grown on a bounded sample of
labelled rows; every path from a root is a conjunctive rule; a logistic model with an L1 penalty keeps
few of them; the kept rules are compiled to one Spark column expression, so scoring is a
projection without Python.

The sample: at most ``sample`` labelled rows, those with the smallest hashes of their ids.  It is the only
bounded part; every document is scored on all its text.

Defined results.  Null or empty text: all statistics 0, scored like any other.  Null or repeated ids, repeated
rows: each row has its own result.  Labels other than 0 and 1: ignored.  No usable label: score 0.5;
one class only: that class's label.  Empty table: empty result.  Extra columns: ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, whole_row

_COUNT = "(length(t) - length(regexp_replace(t, r'{0}', '')))"
#: name -> SQL over the text t, its words w and its lines ls
STATISTICS = {
    "words": "size(w)",
    "word_length": "length(array_join(w, '')) / greatest(1, size(w))",
    "distinct_words": "size(array_distinct(w)) / greatest(1, size(w))",
    "repeated_words": "size(filter(w, (x, i) -> i > 0 and x = w[i - 1])) / greatest(1, size(w))",
    "upper": _COUNT.format(r"\p{Lu}+") + " / greatest(1, length(t))",
    "digits": _COUNT.format("[0-9]+") + " / greatest(1, length(t))",
    "symbols": _COUNT.format(r"[#*$%&|<>~^=+@/{}_\\\\]+") + " / greatest(1, length(t))",
    "calls": _COUNT.format("[!?]+") + " / greatest(1, length(t))",
    "stops": _COUNT.format("[.,;:]+") + " / greatest(1, length(t))",
    "line_length": "length(t) / greatest(1, size(ls))",
    "repeated_lines": "(size(ls) - size(array_distinct(ls))) / greatest(1, size(ls))",
}
Rule = tuple[tuple[int, bool, float], ...]


def statistics(text: str) -> Column:
    """An array of all statistics, in the order of STATISTICS."""
    values = "array(" + ", ".join(f"double({x})" for x in STATISTICS.values()) + ")"
    return F.expr(let(f"coalesce(cast(`{text}` as string), '')", "t", let(f"regexp_extract_all(t, r'{WORD}', 0)", "w", let("split(t, '\\n')", "ls", values))))


def grow(x: np.ndarray, residual: np.ndarray, hessian: np.ndarray, depth: int, bins: int, least: int) -> list[tuple[Rule, np.ndarray, float]]:
    """A regression tree's nodes below the root: rule, rows, value."""
    out: list = []

    def split(rows: np.ndarray, rule: Rule, level: int) -> None:
        if level == depth or len(rows) < 2 * least:
            return
        best = None
        g, h = residual[rows], hessian[rows]
        whole = g.sum() ** 2 / (h.sum() + 1)
        for j in range(x.shape[1]):
            values = x[rows, j]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))
            for cut in cuts:
                left = values <= cut
                n = int(left.sum())
                if n < least or len(rows) - n < least:
                    continue
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - whole
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, j, float(cut), left)
        if best is None or best[0] <= 1e-6:
            return
        _, j, cut, left = best
        for side, own in ((True, rows[left]), (False, rows[~left])):
            more = (*rule, (j, side, cut))
            out.append((more, own, float(residual[own].sum() / (hessian[own].sum() + 1))))
            split(own, more, level + 1)

    split(np.arange(len(x)), (), 0)
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, below, cut in rule:
        out &= (x[:, j] <= cut) == below
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, turns: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; columns are scaled to unit variance for the penalty."""
    n, k = r.shape
    mean, scale = r.mean(axis=0), np.maximum(r.std(axis=0), 1e-9)
    z = (r - mean) / scale
    step = 4.0 / max(1.0, np.linalg.norm(z, 2) ** 2 / n)
    b = old_b = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    w, old, t = np.zeros(k), np.zeros(k), 1.0
    for _ in range(turns):
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = w + (t - 1) / t_next * (w - old), b + (t - 1) / t_next * (b - old_b)
        p = 1 / (1 + np.exp(-np.clip(z @ v + vb, -40, 40)))
        old, old_b, t = w, b, t_next
        w = v - step * (z.T @ (p - y) / n)
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * penalty)
        b = vb - min(step, 4.0) * float((p - y).mean())
    w = w / scale
    return float(b - mean @ w), w


class RuleEnsemble:
    def __init__(self, *, text: str = "text", id_col: str = "doc_id", sample: int = 12_000, trees: int = 12, depth: int = 3, bins: int = 24, rate: float = 0.4, penalty: float = 2e-3) -> None:
        self.text, self.id_col, self.sample = text, id_col, sample
        self.trees, self.depth, self.bins, self.rate, self.penalty = trees, depth, bins, rate, penalty
        self.rules: list[tuple[Rule, float]] = []
        self.intercept = 0.0

    def fit_arrays(self, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        self.rules = []
        if not len(y) or y.min() == y.max():
            self.intercept = 0.0 if not len(y) else (40.0 if y[0] else -40.0)
            return self
        at = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
        rules: dict[Rule, None] = {}
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-at))
            nodes = grow(x, y - p, p * (1 - p), self.depth, self.bins, max(5, len(y) // 500))
            parents = {rule[:-1] for rule, _, _ in nodes}
            for rule, rows, value in nodes:
                rules[rule] = None
                if rule not in parents:
                    at[rows] += self.rate * value
        kept: dict[bytes, Rule] = {}
        for rule in rules:
            kept.setdefault(holds(rule, x).tobytes(), rule)
        names = list(kept.values())
        if names:
            self.intercept, w = lasso_logistic(np.column_stack([holds(r, x) for r in names]).astype(float), y, self.penalty)
            self.rules = [(r, float(v)) for r, v in zip(names, w, strict=True) if abs(v) > 1e-6]
        return self

    def fit(self, docs: DataFrame, labels: DataFrame, label: str = "quality") -> RuleEnsemble:
        """labels: rows to learn from, with the id and the label.  An id with both labels counts as 1; of its texts the one with the least statistics counts."""
        some = labels.select(F.col(self.id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)")
        some = some.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(self.sample)
        rows = docs.select(F.col(self.id_col).alias("own"), F.col(self.text).alias("text"))
        rows = rows.join(F.broadcast(some), F.col("own") == F.col("_id")).select("_id", statistics("text").alias("x"), "_y")
        rows = rows.groupBy("_id").agg(F.min("x").alias("x"), F.first("_y").alias("_y"))  # one row for a repeated id
        got = sorted((r["_id"], list(r["x"]), r["_y"]) for r in rows.collect())  # at most ``sample`` rows
        return self.fit_arrays(np.array([g[1] for g in got]).reshape(len(got), len(STATISTICS)), np.array([g[2] for g in got], float))

    def score_sql(self, x: str = "x") -> str:
        """The rules, compiled: SQL for the score over an array of statistics."""
        terms = [f"if({' and '.join(f'{x}[{j}] {"<=" if below else ">"} {cut!r}D' for j, below, cut in rule)}, {w!r}D, 0D)" for rule, w in self.rules]
        return f"1D / (1D + exp(-greatest(-40D, least(40D, {' + '.join([f'{self.intercept!r}D', *terms])}))))"

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with a column score."""
        rows = docs.select(whole_row(docs).alias("row"), statistics(self.text).alias("given"))
        return rows.select("row.*", F.expr(let("given", "x", self.score_sql())).alias("score"))
