"""Personal data: base patterns, and identifiers that bootstrapped contexts discover.  DataFrame and SQL functions only.

Base entities (email, ip, card, phone) are regular expressions with checks.  They are the seeds of the
bootstrapping: the last word, two and three words before a seed, or before an instance that a pattern has
discovered, are lexical patterns; the other tokens with a digit or @ that stand after the same patterns are candidate instances.  Patterns and instances form a bipartite graph, scored
iteratively: a pattern's score is the sum of its instances' scores over *all* occurrences of the pattern in
the corpus (so that a word like "the" scores next to nothing), an instance's the noisy-or of its
patterns'.  Patterns at ``accept`` or more, with ``support`` distinct instances at half or more, are trusted,
and every candidate after one becomes a span of kind ``id``.  Base spans always stay.  The rounds go on until no
instance comes in and the scores rise by no more than ``tolerance`` together.

The expressions are possessive and match a failing run as a whole, so their time is linear in the
text and they need no stack.  They run only on texts that hold an @ or a digit.

Patterns whose share of identifiers is below ``accept`` at best are left out of the graph before
the iterations: they can't be accepted, and with them go the hot keys.  Trusted patterns up to
``literal_patterns`` go into the plan as a literal; beyond that they are joined.

Defined results.  Null or empty text: no spans.  Null or repeated ids, repeated rows: each row has
its own result row.  Empty table: empty result.  Extra columns: ignored by ``spans``, kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, let

KINDS = ("email", "ip", "card", "phone", "id")
_SPACE = r"\x20\x09-\x0D"
#: (kind, what a text with a match holds, expression, the check of a match m).  Failing runs match too and are dropped.
_BASE = (
    (0, "contains(t, '@')", r"[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?+", "contains(m, '@')"),
    (1, "digit", r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?+", "contains(m, '.') and forall(split(m, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 and int('0' || right(p, 3)) <= 255)"),
    (2, "digit", r"[0-9]++(?:[\x20-][0-9]++)*+", "length(m) >= 12 and " + let("replace(replace(m, ' ', ''), '-', '')", "d",
        "length(d) between 12 and 19 and aggregate(sequence(1, least(length(d), 19)), 0, (a, i) -> a + " + let("int(substr(d, length(d) - i + 1, 1))", "v", "if(i % 2 = 1, v, if(v > 4, 2 * v - 9, 2 * v))") + ") % 10 = 0")),
    (3, "digit and contains(t, '+')", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15"),
)
_NONE = "cast(array() as array<struct<kind int, start bigint, stop bigint>>)"
#: Tokens with a digit or an @, from their first character on.
_CANDIDATE = rf"(?:^|(?<=[{_SPACE}]))[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"


def _matches(pattern: str, check: str, kind: int) -> str:
    """SQL for the spans of the matches in t that pass the check, in order."""
    walk = (
        "aggregate(zip_with(ms, slice(gs, 1, size(ms)), (m, g) -> struct(m, g)), "
        "struct(0L as at, cast(array() as array<struct<kind int, start bigint, stop bigint>>) as found), "
        "(a, x) -> struct(a.at + length(x.g) + length(x.m) as at, if(" + let("x.m", "m", check) + ", "
        f"array_append(a.found, named_struct('kind', {kind}, 'start', a.at + length(x.g), 'stop', a.at + length(x.g) + length(x.m))), a.found) as found), a -> a.found)"
    )
    return let(f"regexp_extract_all(t, r'{pattern}', 0)", "ms", f"if(size(ms) = 0, {_NONE}, " + let(f"split(t, r'{pattern}', -1)", "gs", walk) + ")")


def _base() -> str:
    each = [f"if({need}, {_matches(p, check, kind)}, {_NONE})" for kind, need, p, check in _BASE]
    return "array_sort(concat(" + ", ".join(each) + "), (x, y) -> case when x.start <> y.start then if(x.start < y.start, -1, 1) when x.kind <> y.kind then if(x.kind < y.kind, -1, 1) else 0 end)"


def _left(start: str) -> str:
    """SQL for the patterns before a place in t: its last word, last two and last three words, in lower case.

    A window with a fourth word holds the last three whole; only where none does, all that stands before is read.
    """
    window = lambda n: f"array_remove(split(lower(substring(t, int(greatest(1L, {start} - {n - 1})), int(least({start}, {n}L)))), r'[{_SPACE}]+'), '')"
    whole = f"array_remove(split(lower(substring(t, 1, int({start}))), r'[{_SPACE}]+'), '')"
    for n in (2400, 240):
        whole = let(window(n), f"w{n}", f"if({start} <= {n} or size(w{n}) > 3, w{n}, {whole})")
    return let(whole, "ws", "transform(sequence(1, 3), k -> if(k <= size(ws), array_join(slice(ws, -k, k), ' '), ''))")


def _found() -> str:
    """SQL for base, and mentions: words before, surface, whether it is a seed, the span."""
    some = _matches(_CANDIDATE, "true", 4)
    mention = lambda s, seed: f"named_struct('words', array_remove({_left(s + '.start')}, ''), 'surface', lower(substring(t, int({s}.start + 1), int({s}.stop - {s}.start))), 'seed', {seed}, 'start', {s}.start, 'stop', {s}.stop)"
    return let("coalesce(cast({text} as string), '')", "t", let("t rlike '[0-9]'", "digit", let(
        _base(), "base",
        "named_struct('base', base, 'mentions', if(digit or contains(t, '@'), concat("
        f"transform(base, s -> {mention('s', 'true')}), transform(filter({some}, c -> not exists(base, b -> b.start < c.stop and c.start < b.stop)), c -> {mention('c', 'false')})"
        "), cast(array() as array<struct<words array<string>, surface string, seed boolean, start bigint, stop bigint>>)))")))  # fmt: skip


def span_string(spans: Column | str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.stop)), ',')")


class PersonalData:
    def __init__(self, *, text: str = "text", id_col: str = "doc_id", tolerance: float = 1e-3, accept: float = 0.8, support: int = 3, literal_patterns: int = 5_000, broadcast_words: int = 200_000) -> None:
        self.text, self.id_col, self.tolerance = text, id_col, tolerance
        self.accept, self.support, self.literal_patterns, self.broadcast_words = accept, support, literal_patterns, broadcast_words

    def _occurrences(self, docs: DataFrame, words: DataFrame) -> DataFrame:
        """word, occurrences: how often the given patterns of one to three words stand in all texts."""
        t = f"lower(coalesce(cast(`{self.text}` as string), ''))"
        for x in ("'\\t'", "'\\n'", "char(11)", "char(12)", "'\\r'"):
            t = f"replace({t}, {x}, ' ')"
        every = docs.select(F.expr("inline(" + let(f"array_remove(split({t}, ' '), '')", "w", "transform(w, (x, i) -> struct(x as a, get(w, i - 1) as b, get(w, i - 2) as c))") + ")"))
        last = words.select(F.substring_index("word", " ", -1).alias("z")).distinct()
        few = words.limit(self.broadcast_words + 1).count() <= self.broadcast_words
        every = every.join(F.broadcast(last) if few else last, F.col("a") == F.col("z"), "left_semi")
        every = every.select(F.explode(F.expr("array(a, b || ' ' || a, c || ' ' || b || ' ' || a)")).alias("w")).filter("w is not null")
        if few:
            some = every.join(F.broadcast(words), F.col("w") == F.col("word"), "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("occurrences"))
        else:
            some = every.groupBy("w").agg(F.count(F.lit(1)).alias("occurrences")).join(words, F.col("w") == F.col("word"), "left_semi")
        return some.withColumnRenamed("w", "word")

    def patterns(self, work: Workspace, docs: DataFrame, found: DataFrame) -> DataFrame:
        """The trusted patterns: word, score, instances."""
        m = found.select(F.explode("mentions").alias("m")).select(F.explode("m.words").alias("word"), "m.surface", "m.seed")
        edges = work.save(m.groupBy("word", "surface").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n")), "edges")
        # a word with fewer distinct instances is never trusted and lends nothing; all others may join in any round
        able = edges.groupBy("word").agg(F.sum("n").alias("identifiers"), F.count(F.lit(1)).alias("surfaces")).filter(F.col("surfaces") >= self.support)
        able = work.save(able.select("word", "identifiers"), "able")
        counted = self._occurrences(docs, able.select("word"))
        usable = able.join(counted, "word").filter(F.col("identifiers") >= self.accept * F.col("occurrences"))
        usable = work.save(usable.select(F.col("word").alias("p"), "occurrences"), "usable")
        # instances that a usable pattern has, with those patterns only
        graph = work.save(edges.join(usable, F.col("word") == F.col("p")).drop("p"), "graph")
        seeds = edges.groupBy(F.col("surface").alias("s")).agg(F.max("seed").alias("known")).filter("known")
        score = work.save(graph.select("surface").distinct().join(seeds, F.col("surface") == F.col("s"), "left").select(
            F.col("surface").alias("i"), F.when(F.col("known"), 1.0).otherwise(0.0).alias("given")), "given")
        now = score.select("i", "given", F.col("given").alias("score"))
        turn, before = 0, None
        while True:
            joined = graph.join(now, F.col("surface") == F.col("i"))
            by = joined.groupBy("word").agg(
                (F.sum(F.col("n") * F.col("score")) / F.first("occurrences")).alias("score"),
                F.sum(F.when(F.col("score") >= 0.5, 1).otherwise(0)).alias("instances"))
            by = work.save(by, f"patterns{turn}")
            # scores only rise: the rounds end when they rise no more and no instance has come in
            total = by.agg(F.sum("score"), F.sum("instances")).first()
            if turn and (total[0] is None or total[1] == before[1] and total[0] - before[0] <= self.tolerance):
                break
            # a pattern with too few instances lends none of its score yet
            lent = F.when(F.col("instances") >= self.support, F.least("score", F.lit(0.999))).otherwise(0.0)
            belief = graph.select("word", "surface").join(by.withColumn("lent", lent).select(F.col("word").alias("p"), "lent"), F.col("word") == F.col("p"))
            # patterns that end in the same word are one witness
            belief = belief.groupBy("surface", F.substring_index("word", " ", -1).alias("last")).agg(F.max("lent").alias("lent"))
            belief = belief.groupBy(F.col("surface").alias("j")).agg((1 - F.exp(F.sum(F.log1p(-F.col("lent"))))).alias("belief"))
            now = work.save(score.join(belief, F.col("i") == F.col("j"), "left").select("i", "given", F.greatest("given", F.coalesce("belief", F.lit(0.0))).alias("score")), f"instances{turn}")
            work.drop(f"instances{turn - 1}", f"patterns{turn - 1}")
            turn, before = turn + 1, total
        trusted = by.filter((F.col("score") >= self.accept) & (F.col("instances") >= self.support))
        trusted = work.save(trusted, "trusted")
        work.drop("edges", "able", "usable", "graph", "given")
        return trusted

    def spans(self, docs: DataFrame, keep: bool = False) -> DataFrame:
        """A row per row of docs: doc_id, base and spans (kind, start, stop; code points), and with ``keep`` the row itself."""
        work = Workspace(docs.sparkSession, "pii")
        made = F.expr(_found().replace("{text}", f"`{self.text}`"))
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        found = docs.select(F.col(self.id_col).alias("doc_id"), *([row.alias("row")] if keep else []), made.alias("f"))
        found = found.select(*[c for c in found.columns if c != "f"], "f.base", "f.mentions").withColumn("at", F.monotonically_increasing_id())
        found = work.save(found, "found")
        trusted = self.patterns(work, docs, found)
        n = trusted.limit(self.literal_patterns + 1).count()
        as_span = "named_struct('kind', 4, 'start', m.start, 'stop', m.stop)"
        if n == 0:
            added = found.withColumn("added", F.expr(_NONE))
        elif n <= self.literal_patterns:
            words = [r[0] for r in trusted.select("word").collect()]
            some = F.filter("mentions", lambda m: ~m["seed"] & F.exists(m["words"], lambda w: w.isin(words)))
            added = found.withColumn("some", some).withColumn("added", F.expr(f"transform(some, m -> {as_span})")).drop("some")
        else:
            each = found.select("at", F.explode("mentions").alias("m")).filter("not m.seed").select("at", F.expr(as_span).alias("s"), F.explode("m.words").alias("p"))
            each = each.join(trusted.select("word"), F.col("p") == F.col("word"), "left_semi")
            each = each.groupBy(F.col("at").alias("k")).agg(F.collect_set("s").alias("added"))
            added = found.join(each, F.col("at") == F.col("k"), "left").withColumn("added", F.coalesce("added", F.expr(_NONE))).drop("k")
        spans = "array_sort(concat(base, transform(added, s -> named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop))), (x, y) -> case when x.start <> y.start then if(x.start < y.start, -1, 1) when x.kind <> y.kind then if(x.kind < y.kind, -1, 1) else 0 end)"
        return added.withColumn("spans", F.expr(spans)).drop("mentions", "added", "at")

    def redact(self, docs: DataFrame) -> DataFrame:
        """All rows and columns of docs, spans replaced by their kind in brackets.  Overlapping spans go as one."""
        names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
        text = f"row.`{self.text}`"
        out = (
            "aggregate(spans, struct(0L as at, '' as out), (a, s) -> if(s.start >= a.at, "
            f"struct(s.stop as at, concat(a.out, substring({text}, int(a.at + 1), int(s.start - a.at)), {names}[s.kind]) as out), "
            f"struct(greatest(a.at, s.stop) as at, a.out as out)), a -> concat(a.out, substring({text}, int(a.at + 1))))"
        )
        rows = self.spans(docs, keep=True)
        rows = rows.withColumn("_new", F.when(F.size("spans") == 0, F.expr(text)).otherwise(F.expr(out)))
        return rows.select(*[F.col("_new").alias(c) if c == self.text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
