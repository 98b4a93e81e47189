"""Quality rules from cross-document line frequency, with DataFrame and SQL functions only.

Lines are normalised (lower case, white space collapsed) and hashed with
MD5.  For each host and line the *distinct documents* that hold it are counted; documents of a
host that have exactly the same set of lines count once, so that copies of one document
don't make its lines look like boilerplate.  Near copies count one each.  A line is frequent
where that count exceeds both an absolute limit and a share of the host's documents, or a
second, higher limit alone, so that boilerplate of a part of a very large host goes too.
Frequent lines are removed; a document that loses almost all of its text is rejected.

Plan: one pass over the texts computes all figures and line hashes and saves them (no
text).  Counting shuffles hashes by (host, line, digest of the line set), which spreads even a line that
stands in every document, then partial counts by (host, line).  The frequent lines are
broadcast if they are at most ``broadcast_lines``, and as lists by host if none has more than ``host_lines``; else hashes
are joined by shuffle, with adaptive splitting of hot keys.

Defined results.  Null text: no words, hence failed.  Null host: a host of its own.  Null or
repeated doc_id, repeated rows: each row gets its own result row; equal rows equal results.
Lines without a word are ignored.  Empty table: empty result.  Extra columns: ignored here,
kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Workspace, let, whole_row

_SYMBOLS = "#*$%&|<>"
_OTHER_SPACE = ("'\\t'", "'\\n'", "char(11)", "char(12)", "'\\r'")


def _replaced(text: str, what: tuple[str, ...], by: str) -> str:
    """Plain replacement, which takes a fraction of a regular expression's time."""
    for x in what:
        text = f"replace({text}, {x}, {by})"
    return text


#: Words in 8-word windows that are found twice or more in one text.
#: Windows are hashed by doubling: pairs of words, pairs of those, and again.
_REPEATED = let("transform(w, x -> xxhash64(x))", "h", let(
    "transform(h, (x, i) -> xxhash64(x, get(h, i + 1)))", "h2", let(
        "transform(h2, (x, i) -> xxhash64(x, get(h2, i + 2)))", "h4", let(
            "slice(transform(h4, (x, i) -> xxhash64(x, get(h4, i + 4))), 1, greatest(0, size(w) - 7))", "g",
            "if(size(array_distinct(g)) = size(g), 0, " + let(
                "array_sort(transform(g, (x, i) -> struct(x, i)))", "s", let(
                    "array_sort(filter(transform(s, (e, i) -> if((i > 0 and s[i - 1].x = e.x) or (i < size(s) - 1 and s[i + 1].x = e.x), e.i, -1)), p -> p >= 0))", "p",
                    "aggregate(p, struct(-8 as l, 0 as t), (a, x) -> struct(x as l, a.t + least(8, x - a.l) as t), a -> a.t)")) + ")"))))


def normalised(line: str) -> str:
    """SQL for a line's normal form: lower case, white space collapsed and trimmed."""
    rare = " or ".join(f"contains(o, {x})" for x in ("'  '", *_OTHER_SPACE))
    return let(f"lower({line})", "o", f"trim(if({rare}, regexp_replace(o, r'[\x20\x09-\x0D]+', ' '), o))")


def _figures() -> str:
    """SQL for the figures of a text, which is read once."""
    lines = let(
        f"filter(split(t, '\\n'), l -> l rlike r'{WORD}')", "ls",
        "struct(size(ls) - size(array_distinct(ls)) as dup, transform(ls, l -> "
        + let(normalised("l"), "n", "struct(unhex(md5(n)) as line, length(n) as chars)") + ") as lines)")
    symbols = _replaced("t", tuple(f"'{x}'" for x in _SYMBOLS), "''")
    return let(
        "coalesce(cast({text} as string), '')", "t", let(
            f"array_remove(split({_replaced('t', _OTHER_SPACE, chr(39) + ' ' + chr(39))}, ' '), '')", "w", let(
                lines, "d",
                "struct(cast(size(w) as bigint) as n_words, "
                f"cast(length({_replaced('t', (chr(39) + ' ' + chr(39), *_OTHER_SPACE), chr(39) * 2)}) as bigint) as word_chars, "
                f"cast(length(t) - length({symbols}) as bigint) as n_symbols, "
                f"cast(d.dup as bigint) as n_dup_lines, cast({_REPEATED} as bigint) as n_repeat_words, d.lines as lines)")))  # fmt: skip


def _key(id_col: str, text: str, host: str) -> str:
    return f"md5(concat(coalesce(cast(`{id_col}` as string), '~'), '|', coalesce(`{host}`, '~'), '|', coalesce(cast(`{text}` as string), '')))"


class LineRules:
    def __init__(self, *, text: str = "text", host: str = "source", id_col: str = "doc_id", min_words: int = 20, repeat_percent: int = 30,
                 max_documents: int = 20, max_percent: int = 2, always_documents: int = 1_000, depleted_percent: int = 80, depleted_chars: int = 100, broadcast_lines: int = 100_000, host_lines: int = 200) -> None:
        """A line is frequent above ``max_documents`` and above ``max_percent`` of its host's documents, or above
        ``always_documents`` whatever the share.  A document
        is depleted if at least ``depleted_percent`` of its characters go and fewer than ``depleted_chars`` stay."""
        self.text, self.host, self.id_col = text, host, id_col
        self.min_words, self.repeat_percent = min_words, repeat_percent
        self.max_documents, self.max_percent, self.always_documents = max_documents, max_percent, always_documents
        self.depleted_percent, self.depleted_chars = depleted_percent, depleted_chars
        self.broadcast_lines, self.host_lines = broadcast_lines, host_lines

    def figures(self, docs: DataFrame) -> DataFrame:
        """A row per document: id, host, key and the figures of the text, with its line hashes."""
        text = f"`{self.text}`"
        made = docs.select(
            F.col(self.id_col).alias("doc_id"), F.col(self.host).cast("string").alias("host"),
            F.expr(_key(self.id_col, self.text, self.host)).alias("key"), F.expr(_figures().replace("{text}", text)).alias("f"))
        return made.select("doc_id", "host", "key", "f.*")

    def frequent(self, work: Workspace, figures: DataFrame) -> tuple[DataFrame, int, int]:
        """The frequent lines (host, line, documents), saved, their number, and that of the host with most."""
        own = figures.select("host", F.array_sort(F.array_distinct("lines.line")).alias("own"))
        digest = F.expr("unhex(md5(cast(array_join(transform(own, x -> hex(x)), '') as binary)))")
        pairs = own.withColumn("digest", digest).select("host", F.explode("own").alias("line"), "digest")
        counts = pairs.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"))
        many = counts.filter(F.col("documents") > self.max_documents)
        hosts = work.save(figures.groupBy("host").agg(F.count(F.lit(1)).alias("host_documents")).withColumnRenamed("host", "h"), "hosts")
        if hosts.limit(self.broadcast_lines + 1).count() <= self.broadcast_lines:
            hosts = F.broadcast(hosts)
        out = many.join(hosts, F.col("host").eqNullSafe(F.col("h")))
        share = 100 * F.col("documents") > self.max_percent * F.col("host_documents")
        out = out.filter(share | (F.col("documents") > self.always_documents))
        out = work.save(out.select("host", "line", "documents"), "frequent")
        n = out.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        return out, n[0], n[1]

    def _mark(self, rows: DataFrame, frequent: DataFrame, n: int, most: int) -> DataFrame:
        """Adds ``gone``, the frequent lines of the row's document.  rows: with host, key and lines.

        A host's lines, if it has few, go onto its rows; else lines and frequent lines are joined.
        """
        if n <= self.broadcast_lines and most <= self.host_lines:
            by_host = frequent.groupBy(F.col("host").alias("h")).agg(F.collect_list("line").alias("gone"))
            return rows.join(F.broadcast(by_host), F.col("host").eqNullSafe(F.col("h")), "left").drop("h")
        each = rows.select("host", "key", F.explode(F.array_distinct("lines.line")).alias("line"))
        frequent = frequent.select(F.col("host").alias("h"), F.col("line").alias("l"))
        frequent = F.broadcast(frequent) if n <= self.broadcast_lines else frequent
        hit = each.join(frequent, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
        gone = hit.groupBy(F.col("key").alias("k")).agg(F.collect_set("line").alias("gone"))
        return rows.join(gone, F.col("key") == F.col("k"), "left").drop("k")

    def verdicts(self, docs: DataFrame) -> DataFrame:
        """A row per row of docs: doc_id, host, key, the figures, base_failed, n_removed_chars, kept."""
        work = Workspace(docs.sparkSession, "lines")
        figures = work.save(self.figures(docs), "figures")
        frequent, n, most = self.frequent(work, figures)
        removed = F.expr("cast(aggregate(filter(lines, l -> array_contains(gone, l.line)), 0, (a, l) -> a + l.chars) as bigint)")
        out = self._mark(figures, frequent, n, most).withColumn("n_removed_chars", F.coalesce(removed, F.lit(0).cast("long")))
        return self._judge(out).drop("lines", "gone")

    def _judge(self, out: DataFrame) -> DataFrame:
        failed = (F.col("n_words") < self.min_words) | (100 * F.col("n_repeat_words") > self.repeat_percent * F.col("n_words"))
        gone, chars = F.col("n_removed_chars"), F.expr("cast(aggregate(lines, 0, (a, l) -> a + l.chars) as bigint)")
        depleted = (gone > 0) & (100 * gone >= self.depleted_percent * chars) & (chars - gone < self.depleted_chars)
        return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)

    def clean(self, docs: DataFrame) -> DataFrame:
        """The kept documents, all their columns, the text without its frequent lines."""
        work = Workspace(docs.sparkSession, "lines")
        figures = work.save(self.figures(docs), "figures")
        frequent, n, most = self.frequent(work, figures)
        removed = F.expr("cast(aggregate(filter(lines, l -> array_contains(gone, l.line)), 0, (a, l) -> a + l.chars) as bigint)")
        marked = self._mark(figures, frequent, n, most).withColumn("n_removed_chars", F.coalesce(removed, F.lit(0).cast("long")))
        keys = self._judge(marked).filter("kept").select(
            F.col("key").alias("_key"), F.when(F.col("n_removed_chars") > 0, F.expr("array_intersect(lines.line, gone)")).alias("_gone"))
        keys = keys.groupBy("_key").agg(F.first("_gone").alias("_gone"))
        at = self.text
        rows = docs.select(whole_row(docs).alias("row"), F.expr(_key(self.id_col, at, self.host)).alias("_own")).join(keys, F.col("_own") == F.col("_key"))
        left = F.expr(f"array_join(filter(split(row.`{at}`, '\\n'), l -> not coalesce(array_contains(_gone, unhex(md5({normalised('l')}))), false)), '\\n')")
        text = F.when(F.col("_gone").isNull(), F.col(f"row.`{at}`")).otherwise(left)
        return rows.select(*[text.alias(c) if c == at else F.col(f"row.`{c}`") for c in docs.columns])
