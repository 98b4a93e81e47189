import random
import re

import pytest

from siftwell.llm.minhash import MinHash
from siftwell.llm.stars import star_components


def shingles(text, k):
    words = [w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_force(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {(i, len(shingles(t, k)), find(i) if i is not None else None) for i, t in rows}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(8):
        base = rng.choices(vocabulary, k=rng.choice([30, 90, 200]))
        for _ in range(rng.choice([1, 4, 14])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                text[rng.randrange(len(text))] = rng.choice(["x1", "x2", "X3", *vocabulary])
            out.append(" ".join(text[: rng.choice([len(text), len(text), len(text) - len(text) // 10])]))
    out += ["", None, " \t ", "one two", "One  TWO", "one two three", out[0], out[0].upper()]
    return [*enumerate(out), (None, out[0]), (3, out[3]), (2, out[40])]  # a null id, a repeated row, an id with two texts


@pytest.mark.parametrize(("k", "percent", "rare"), [(3, 85, 32), (5, 80, 2)])
def test_equal_to_brute_force(spark, rows, k, percent, rare):
    docs = spark.createDataFrame([(i, t, 1, b"z", "n") for i, t in rows], "doc_id long, text string, cls int, bands binary, component string").repartition(3)
    got = MinHash(shingle=k, percent=percent, rare=rare).components_of(docs).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute_force(rows, k, percent)
    assert len(got) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_dedup_keeps_columns_and_one_of_each(spark):
    text = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "x"), (2, text + " b", "y"), (3, "other words", None), (None, text, "n")], "doc_id long, text string, kept string")
    out = MinHash().dedup(docs)
    assert out.columns == docs.columns
    assert {(r["doc_id"], r["kept"]) for r in out.collect()} == {(1, "x"), (3, None), (None, "n")}
    again = docs.unionByName(spark.createDataFrame([(3, "unlike the others by far", "z"), (3, "other words", "w")], docs.schema))
    got = [(r["doc_id"], r["text"][:6]) for r in MinHash().dedup(again).collect()]
    assert sorted(got, key=str) == sorted([(got[0][0] if got[0][0] in (1, 2) else next(i for i, t in got if i in (1, 2)), "a0 a1 "), (3, "other "), (3, "unlike"), (None, "a0 a1 ")], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert MinHash().components_of(docs).count() == 0


def test_components_of_a_long_chain(spark):
    from siftwell.llm.common import Workspace

    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in star_components(Workspace(spark, "chain"), links, "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
