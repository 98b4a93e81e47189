import re

import numpy as np
import pytest

from siftwell.llm import hashing
from siftwell.llm.license_texts import TEMPLATES
from siftwell.llm.licenses import LicenseScan, _grams
from siftwell.llm.line_rules import LineRules
from siftwell.llm.pii import PersonalData, span_string


def test_lines_of_different_documents_count_each(spark):
    menu = "\n".join(f"menu entry number {i} of this site" for i in range(40))
    copied = "\n".join(" ".join(f"w{10 * i + j}" for j in range(10)) for i in range(5))
    rows = [(i, f"{menu}\ntitle {i}", "h") for i in range(500)] + [(1000 + i, copied, "c") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for r in LineRules().verdicts(docs).collect():
        if r["doc_id"] < 1000:
            assert r["n_removed_chars"] == sum(map(len, menu.split("\n"))) and not r["kept"]
        else:
            assert r["n_removed_chars"] == 0 and r["kept"]  # exact copies count once


def licences_of(text):
    scan = LicenseScan()
    flat = np.frombuffer(text.encode(), np.uint8)
    h = hashing.located_words(flat, np.array([0, len(flat)]), hashing.MARKS)[0]
    grams = _grams(h, scan.gram)
    at = np.array([j for j, g in enumerate(grams.tolist()) if g in scan.index], int)
    return [(scan.names[t], m, a, b) for t, m, a, b in scan.matches(h, at, grams)] if len(at) else []


def test_repeated_notices_are_matches_each():
    lines = "\n".join(f"Copyright {1900 + i} Bar. All rights reserved." for i in range(200))
    assert licences_of(lines) == [("All-rights-reserved", 3, 6 * i + 3, 6 * i + 5) for i in range(200)]
    twice = f"{TEMPLATES['ISC']} {TEMPLATES['ISC']} {TEMPLATES['MIT']} {TEMPLATES['ISC']}"
    assert [x[0] for x in licences_of(twice)] == ["ISC", "ISC", "MIT", "ISC"]


def test_insertions_do_not_part_a_licence():
    words = TEMPLATES["BSD-3-Clause"].split()
    holder = " ".join(f"name{i}" for i in range(9))
    text = " ".join(f"{w} {holder}" if i in (20, 45, 70) else w for i, w in enumerate(words))
    got = licences_of(f"before {text} after")
    assert [x[0] for x in got] == ["BSD-3-Clause"] and got[0][1] == len(re.findall("[A-Za-z0-9]+", TEMPLATES["BSD-3-Clause"]))


def test_spans_count_code_points(spark):
    docs = spark.createDataFrame([(1, "é😀 All rights reserved. é All rights reserved é")], "doc_id long, text string")
    assert [(r["start"], r["stop"]) for r in LicenseScan().scan(docs).collect()] == [(3, 22), (26, 45)]


def found_by(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = PersonalData(**options).spans(docs).select("doc_id", span_string("spans").alias("s")).collect()
    return {r["doc_id"]: r["s"] for r in rows}


def test_discovered_identifiers_induce_patterns(spark):
    texts = [f"mailto a{i}@site.org" for i in range(5)]
    for word, after in (("mailto", "handle"), ("handle", "nick"), ("nick", "alias"), ("alias", "login"), ("login", "user"), ("user", None)):
        texts += [f"{word} {word}{i}[at]site" for i in range(4)] + ([f"{after} {word}{i}[at]site" for i in range(4)] if after else [])
    got = found_by(spark, [*texts, "user zed9", "page 7", "page 8", "page 9"])
    n = len(texts)
    assert all(got[i] for i in range(n)) and got[n] == "id:5:9" and not any(got[n + i] for i in (1, 2, 3))


@pytest.mark.parametrize("limits", [{}, {"literal_patterns": 0, "broadcast_words": 0}])
def test_patterns_of_several_words_and_of_any_length(spark, limits):
    plain = ["the number is high", "a list is short and it is old", "this one is good"] * 20
    long, wide = "q" * 3000, " " * 5000
    texts = [f"my account number is a{i}@site.org" for i in range(4)] + [f"{long} b{i}@site.org" for i in range(4)] + [f"gapped{wide}c{i}@site.org" for i in range(4)]
    asked = [("My account\tnumber  is kx77", "id:22:26"), (f"{long} kx78", "id:3001:3005"), (f"gapped{wide}kx79", "id:5006:5010"), ("this is kx80", "")]
    got = found_by(spark, [*texts, *(x for x, _ in asked), *plain], **limits)
    assert [got[len(texts) + i] for i in range(4)] == [x for _, x in asked]


def test_each_template_is_found_as_itself():
    for name, text in TEMPLATES.items():
        assert [x[0] for x in licences_of(f"before {text} after")] == [name], name
    assert [x[0] for x in licences_of("Licensed under CC BY 4.0.")] == ["CC-BY-4.0-notice-short"]
    assert [x[0] for x in licences_of("Licensed under CC BY-SA 4.0.")] == ["CC-BY-SA-4.0-notice"]
    assert {"Apache-2.0-text", "GPL-2.0-text", "LGPL-2.1-text", "EPL-1.0-text", "CC0-1.0-text", "BSD-2-Clause-text", "ISC-text", "AGPL-3.0"} <= set(TEMPLATES)


def test_lines_of_a_part_of_a_large_host_go(spark):
    docs = spark.range(52_000).selectExpr("id as doc_id", "concat(if(id < 1001, 'menu of this part\\n', if(id < 2001, 'as often as allowed\\n', '')), 'title ', id) as text", "'h' as source")
    got = LineRules().verdicts(docs).filter("n_removed_chars > 0").select("doc_id").collect()
    assert {r[0] for r in got} == set(range(1001))  # below 2% of the host
