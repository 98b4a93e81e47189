"""Registered queries over small fixed corpora, for what the driver's tables don't hold: other scripts, stems, marks and files.

Where SQL can work a result out, it does; stems and what files hold are given as values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import build_index, open_index
from .operators.build import tokens_of
from .operators.storage import Files
from .sources import read_corpus

#: Texts, what a word of the script is, and SQL for a word's term; w is the word as it stands.
SCRIPTS: dict[str, tuple[list[str], str, str]] = {
    "CYRILLIC": (["Ёжик спит под ёлкой", "ПОЕЗД идёт в Орёл, а корабль — в Тверь", "Льды тают"], r"\p{Cyrillic}+", "replace(lower(w), 'ё', 'е')"),
    "GREEK": (["Ἀθῆναι καὶ Σπάρτη", "ὁ λόγος"], r"\p{Greek}+", "replace(strip_accents(lower(w)), 'ς', 'σ')"),
    "ARABIC": (["مكتبة أحمد الكبيرة", "قلب وإبريق", "كِتَاب يحيى"], r"[\p{Arabic}\p{M}]+", "regexp_replace(translate(w, 'كيىةأإ', 'کییهاا'), '\\p{M}', '', 'g')"),
    "HEBREW": (["שָׁלוֹם עולם", "ספר ישן"], r"[\p{Hebrew}\p{M}]+", "regexp_replace(w, '\\p{M}', '', 'g')"),
}
CJK = ["東京都は日本の首都です", "北京大学の歴史、学", "서울 東"]
#: Words and their stems, from the paper that describes the algorithm.
PORTER = (
    "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan "
    "falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit vietnamization vietnam predication predic "
    "operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous triplicate triplic formative form formalize formal electrical electr goodness good revival reviv allowance allow "
    "inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ "
    "homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas roll roll"
).split()
#: Persian words, joined (with a joiner) or attached endings, and their stems; the last two keep what only looks like an ending.
PERSIAN = {"خانه‌ها": "خانه", "درختهای": "درخت", "بزرگترین": "بزرگ", "کوچک‌تر": "کوچک", "دوست‌هایم": "دوست", "باغ‌هایی": "باغ", "شوهر": "شوهر", "تنها": "تنها"}
#: Short texts, and what is searched for in them.
MARKED = ["The otter swims", "Rivers and an Otter, an otter's den", "Ducks", "Ötter and otter"]
#: Files of every format: name, content, and the (url, title, body) that they hold.
FILES = [
    ("b/notes.txt", "\n  Bees  \n\n a\tswarm \n of bees\n", [("b/notes.txt", "Bees", "a swarm of bees")]),
    ("a.MD", "# Honey\ncomb", [("a.MD", "Honey", "comb")]),
    ("b/c/page.htm", "<title>Wax &amp; light</title><p>burns<br>slowly<script>no()</script>", [("b/c/page.htm", "Wax & light", "burns slowly")]),
    ("d.jsonl", '{"url": "u1", "title": "T", "body": "x \\n y"}\n\n{"id": 5, "content": "z"}\n{"broken\n{"id": 6, "text": "after"}\n', [("u1", "T", "x y"), ("5", "", "z")]),
    ("e.xml", "<A><DOC><URL>u2</URL><HTML><![CDATA[<title>Hive</title><p>full]]></HTML></DOC><doc><url>u3</url><html> </html></doc></A>", [("u2", "Hive", "full")]),
    ("f.bin", "left out", []),
]


def _rows(texts: list[str]) -> str:
    return ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(texts))


def _docs(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "doc_id long, title string, body string")


def _tokens(spark: SparkSession, texts: list[str], *more: str) -> DataFrame:
    return tokens_of(_docs(spark, texts), stemming=False).select("doc_id", "position", "term", "script", *more)


def _script_sql(script: str) -> str:
    texts, word, term = SCRIPTS[script]
    return f"""WITH d(doc_id, text) AS (VALUES {_rows(texts)}), l AS (SELECT doc_id, regexp_extract_all(text, '{word}') AS l FROM d),
r AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM l)
SELECT doc_id::BIGINT AS doc_id, (i - 1)::INT AS position, {term} AS term, '{script}' AS script FROM r"""


_CJK_SQL = rf"""WITH d(doc_id, text) AS (VALUES {_rows(CJK)}), l AS (SELECT doc_id, regexp_extract_all(text, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]+|\p{{Hangul}}+') AS l FROM d),
r AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM l),
g AS (SELECT doc_id, i, w, unnest(range(1, CASE WHEN regexp_matches(w, '\p{{Hangul}}') THEN 2 ELSE greatest(2, length(w)) END)) AS j FROM r)
SELECT doc_id::BIGINT AS doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS position,
CASE WHEN regexp_matches(w, '\p{{Hangul}}') THEN w ELSE substr(w, j, 2) END AS term, CASE WHEN regexp_matches(w, '\p{{Hangul}}') THEN 'HANGUL' ELSE 'CJK' END AS script FROM g"""


def _stems(spark: SparkSession, words: list[str]) -> DataFrame:
    rows = tokens_of(_docs(spark, words), stemming=True)
    return rows.groupBy("doc_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda x: x["term"])).alias("stems"))


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalog import shared_folder

    root = f"{shared_folder(spark)}/marks"
    build_index(_docs(spark, MARKED).selectExpr("doc_id", "'' as url", "body as title", "body"), root, stemming=False)
    hits, _ = open_index(spark, root).search_batch([(0, "otter", 0, 10, False)])
    flat = lambda c: F.concat_ws(",", F.transform(f"{c}.highlights", lambda h: F.concat(h["start"], F.lit("-"), h["end"])))
    return hits.select("doc_id", F.col("title.text").alias("title"), flat("title").alias("title_marks"), F.col("snippet.text").alias("snippet"), flat("snippet").alias("snippet_marks"))


_MARKS_SQL = rf"""WITH d(doc_id, text) AS (VALUES {_rows(MARKED)}),
l AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{{L}}'']+|[^\p{{L}}'']+') AS l FROM d), r AS (SELECT doc_id, text, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM l),
p AS (SELECT *, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) - length(w) AS start FROM r),
m AS (SELECT doc_id, text, string_agg(start::INT || '-' || (start + length(w))::INT, ',' ORDER BY i) AS marks FROM p WHERE regexp_replace(strip_accents(lower(w)), '''s$', '') = 'otter' GROUP BY doc_id, text)
SELECT doc_id::BIGINT AS doc_id, text AS title, marks AS title_marks, text AS snippet, marks AS snippet_marks FROM m"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of every format, read in the order of their names, up to a bad line."""
    from .catalog import shared_folder

    root, files = f"{shared_folder(spark)}/files", Files(spark)
    for name, content, _ in FILES:
        files.replace(f"{root}/{name}", content)
    rows = read_corpus(spark, [root], on_bad="skip").withColumn("at", F.monotonically_increasing_id())
    order = F.array_sort(F.collect_list(F.struct("at", "url", "title", "body")))
    return rows.groupBy().agg(order.alias("o")).select(F.posexplode("o").alias("n", "r")).select("n", "r.url", "r.title", "r.body")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **{f"tokenize_{s.lower()}": (lambda spark, _, s=s: _tokens(spark, SCRIPTS[s][0])) for s in SCRIPTS},
        "tokenize_cjk": lambda spark, _: _tokens(spark, CJK),
        "porter_stems": lambda spark, _: _stems(spark, PORTER[::2]),
        "persian_stems": lambda spark, _: _stems(spark, list(PERSIAN)),
        "marks": _marks,
        "read_files": _files,
    }


def oracle_sql() -> dict[str, str]:
    stems = lambda x: f"SELECT doc_id::BIGINT AS doc_id, stems FROM (VALUES {_rows(x)}) v(doc_id, stems)"
    held = [row for _, _, rows in sorted(FILES) for row in rows]
    listed = ", ".join("({}, '{}', '{}', '{}')".format(i, *row) for i, row in enumerate(held))
    return {
        **{f"tokenize_{s.lower()}": _script_sql(s) for s in SCRIPTS},
        "tokenize_cjk": _CJK_SQL,
        "porter_stems": stems(PORTER[1::2]),
        "persian_stems": stems(list(PERSIAN.values())),
        "marks": _MARKS_SQL,
        "read_files": f"SELECT n::INT AS n, url, title, body FROM (VALUES {listed}) v(n, url, title, body)",
    }
