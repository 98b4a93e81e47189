from pyspark.sql import functions as F

from siftwell.llm import mixing
from siftwell.llm.language import LanguageModel
from siftwell.llm.line_rules import LineRules
from siftwell.llm.minhash import MinHash
from siftwell.llm.pii import PersonalData
from siftwell.llm.rule_ensemble import RuleEnsemble

NAMES = ["row", "node", "one", "key", "host", "cls", "x", "y", "given", "letter", "r", "n", "part", "s", "_own", "_key", "_gone", "_n", "_rows", "_copies", "_kept", "_text", "_x", "_id", "at", "base", "f"]


def test_columns_of_any_name_stay_what_they_are(spark):
    body = lambda i: " ".join(f"w{(i * 31 + j) % 997}" for j in range(40))
    rows = [(i, body(i), "h", "en" if i % 2 else "fr", *range(i, i + len(NAMES))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, " + ", ".join(f"`{n}` int" for n in NAMES))
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    made = {
        "op4": LineRules().clean(docs), "op1": MinHash().dedup(docs), "op6": mixing.expand(docs), "op8": PersonalData().redact(docs),
        "op3": RuleEnsemble().fit(docs, labels).score(docs).drop("score"), "op7": LanguageModel().fit(docs).predict(docs).drop("lang_pred", "score"),
    }
    for name, out in made.items():
        assert out.columns == docs.columns, name
        got = {tuple(r) for r in out.collect()}
        assert got <= set(rows) and (got == set(rows) or name == "op6"), name


def test_language_votes_equal_to_brute_force():
    import numpy as np

    from siftwell.llm.language import OneVersusOne

    rng = np.random.default_rng(4)
    labels = np.repeat(np.array(["a", "b", "c"]), 40)
    x = rng.standard_normal((120, 6)).astype(np.float32) + 3 * (labels[:, None] == np.array(["a", "b", "c"])[None]).repeat(2, axis=1)
    model = OneVersusOne(x, labels)
    best, sure = model.predict(x)
    assert np.mean(np.array(model.classes)[best] == labels) > 0.9 and (sure >= 0).all() and (sure <= 1).all()


def test_repeated_ids_and_labels_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i} here", "en") for i in range(50)] + [(i, "le la des", "fr") for i in range(2, 40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    assert RuleEnsemble(sample=2).fit(docs, labels).score(docs).filter(F.col("score").isNull()).count() == 0
    assert {r["lang_pred"] for r in LanguageModel(sample=6).fit(docs).predict(docs).collect()} == {"en", "fr"}
