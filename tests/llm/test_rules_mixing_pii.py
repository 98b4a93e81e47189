import hashlib
import re
from collections import Counter, defaultdict

import pytest

from siftwell.llm import mixing
from siftwell.llm.line_rules import LineRules
from siftwell.llm.pii import KINDS, PersonalData, span_string

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"
ODD = [(None, None, None), (1, "", "a"), (2, " \t\n ", "a"), (3, "word " * 3000, None), (4, "é😀 # $%\n\x0bé😀 # $%\né😀 # $%", "a"), (4, "é😀 # $%\n\x0bé😀 # $%\né😀 # $%", "a"), (5, " ".join(map(str, range(7))), "b")]


def texts_of(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()] + ODD


def figures(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_figures_of_quality_rules(spark):
    rows = texts_of(spark)
    docs = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, text string, source string, lines int, key string").repartition(3)
    got = LineRules().verdicts(docs).collect()
    want = Counter((i, *(f := figures(t)), f[0] < 20 or 100 * f[4] > 30 * f[0]) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])


@pytest.mark.parametrize("limits", [{}, {"host_lines": 0}, {"broadcast_lines": 0}])
def test_frequent_lines_go(spark, limits):
    body = lambda i: " ".join(f"w{i * 31 + j}" for j in range(30))
    rows = [(i, f"Common  Line here\n{body(i)}\nsee you", "h") for i in range(30)] + [(i, "common line HERE\n" + "see you " * 12, "h") for i in (50, 51)] + [(i, f"common line here\n{body(i)}", "g") for i in range(60, 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rules = LineRules(**limits)
    out = {r["doc_id"]: r["text"] for r in rules.clean(docs).collect()}
    assert out[0] == body(0) and out[60] == rows[-4][1]  # 4 documents of a host aren't many
    assert rules.clean(docs.limit(0)).count() == 0
    gone = {r["doc_id"]: r["n_removed_chars"] for r in rules.verdicts(docs).collect()}
    assert gone[0] == len("common line here") + len("see you") and gone[60] == 0


def fixed_point(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**held, **share}
        held |= {s: most * sizes[s] for s in over}


def test_mixing(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), s) for i, s in enumerate("aaaabbbbbbbbbbbbbbbbbbbcddddddddddd" * 20)] + [(None, None, None), (5, "x y", None), (6, "", "e")]
    docs = spark.createDataFrame([(*r, 1.0, "k") for r in rows], "doc_id long, text string, source string, rank double, key string").repartition(5)
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = fixed_point(sizes), defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 150 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))  # reruns agree
    out = mixing.expand(docs)
    assert out.columns == docs.columns and sum(len(WORD.findall(r["text"] or "")) for r in out.collect()) == sum(taken.values())
    same = spark.createDataFrame([(None, "x y", "s", i % 2) for i in range(60)] + [(7, "z", "t", 0)], "doc_id long, text string, source string, kind int").repartition(3)
    whole = mixing.mix(same).agg({"copies": "sum"}).first()[0]
    assert mixing.expand(same).count() == whole  # rows of one key share its copies
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.expand(docs.limit(0)).count() == 0


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    checks = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(checks) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


TRICKY = ["a@b.c", "x@y@z.com", "a.b@c..d e@f.g-h.i.", "1.2.3.4.5", "256.1.1.1 0.0.0.0", "1.2.3", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "+1 (555) 010-9999 x", "+12", "++49 30 123456",
          "é😀 a@b.cd 1.1.1.1", "5500005555555559 4111111111111111", "+4111111111111111", "@", "a@b", "a@-.-", "9" * 5000, "1." * 4000, "a@b." * 3000]


def test_base_entities(spark):
    rows = [(i, t) for i, t, _ in texts_of(spark)] + [(1000 + i, t) for i, t in enumerate(TRICKY)]
    docs = spark.createDataFrame([(*r, "b", 1) for r in rows], "doc_id long, text string, base string, word int").repartition(3)
    got = PersonalData().spans(docs).select("doc_id", span_string("base").alias("base"), span_string("spans").alias("spans")).collect()
    assert Counter((r["doc_id"], r["base"]) for r in got) == Counter((i, base_spans(t)) for i, t in rows)
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in got)


@pytest.mark.parametrize("literal_patterns", [5_000, 0])
def test_contexts_discover_identifiers(spark, literal_patterns):
    seeds = [(i, f"write to mailto a{i}@site.org now") for i in range(5)]
    more = [(10, "write to mailto bob9[at]site now"), (11, "mailto  kim7(at)site"), (12, "chapter 7 of the book, now 12")]
    docs = spark.createDataFrame(seeds + more, "doc_id long, text string")
    finder = PersonalData(literal_patterns=literal_patterns)
    spans = {r["doc_id"]: r["s"] for r in finder.spans(docs).select("doc_id", span_string("spans").alias("s")).collect()}
    assert spans[10] == "id:16:28" and spans[11] == "id:8:20" and spans[12] == ""
    out = {r["doc_id"]: r["text"] for r in finder.redact(docs).collect()}
    assert out[0] == "write to mailto [EMAIL] now" and out[10] == "write to mailto [ID] now" and out[12] == more[2][1]
    assert finder.redact(docs.limit(0)).count() == 0


def test_digest(spark):
    from siftwell.llm.queries import op8_personal_data

    rows = op8_personal_data(spark, DATA).collect()
    want = {r["doc_id"]: base_spans(r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r["doc_id"]: r["base_sha256"] for r in rows} == {i: hashlib.sha256(s.encode()).hexdigest() for i, s in want.items()}
    assert sum(r["n_email"] for r in rows) == sum(s.count("email:") for s in want.values())
