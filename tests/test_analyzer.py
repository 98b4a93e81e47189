import pytest

from siftwell.functions.analyzer import analyze
from siftwell.functions.distance import bigrams, confusable_variants, weighted
from siftwell.functions.snippets import excerpt, highlight
from siftwell.functions.stemming import porter

STEMMED = {
    "The Running ENGINES computers": "the run engin comput",
    "کتاب‌ها": "کتاب", "کتاب ها": "کتاب", "کتابهای": "کتاب", "بزرگ‌ترین": "بزرگ", "گل‌ها": "گل", "تنها دختر انگشتر": "تنها دختر انگشتر",
}
PLAIN = {
    "The Running ENGINES": "the running engines",
    "Café naïve Straße İstanbul Œuvre": "cafe naive strasse istanbul oeuvre",
    "don't engine's o'clock": "dont engine oclock",
    "rock 'n' roll": "rock n roll",
    "MP3 3D 2024 ۱۴۰۲سال": "mp3 3d 2024 1402 سال",
    "كتابخانه ملي": "کتابخانه ملی",
    "کِتـــاب": "کتاب",
    "می خواهم": "میخواهم", "می‌خواهم": "میخواهم", "میخواهم": "میخواهم",
    "Ёлка Москва́": "елка москва", "за́мок": "замок",
    "東京大学": "東京 京大 大学", "学": "学",
    "שָׁלוֹם": "שלום", "Ἀθῆνα": "αθηνα", "हिन्दी": "हिन्दी",
    "  ،؟!…  ": "", "": "", "a" * 65 + " ok": "ok",
    "iPhoneهای": "iphone های",
}


@pytest.mark.parametrize(("text", "terms"), STEMMED.items())
def test_stemmed_terms(text, terms):
    assert [t.term for t in analyze(text)] == terms.split()


@pytest.mark.parametrize(("text", "terms"), PLAIN.items())
def test_plain_terms(text, terms):
    assert [t.term for t in analyze(text, 0, False)] == terms.split()


def test_null_is_empty():
    assert analyze(None) == []


def test_stop_words_are_flagged_and_kept():
    tokens = analyze("the cat and the hat")
    assert [t.stopword for t in tokens] == [True, False, True, True, False]
    assert analyze("iPhone های جدید", 0, False)[1].stopword  # a stranded affix


def test_offsets_and_positions():
    merged = analyze("کتاب ها")[0]
    assert (merged.start, merged.end) == (0, 7)
    assert [t.position for t in analyze("one two three", 10)] == [10, 11, 12]
    assert [t.position for t in analyze("東京大学")] == [0, 1, 2]
    text = "iPhone های جدید"
    first = analyze(text, 0, False)[0]
    assert text[first.start : first.end] == "iPhone"
    assert [t.position for t in analyze("a " + "b" * 70 + " c", 0, False)] == [0, 1]  # an overlong word takes no position


def test_thai_keeps_vowel_marks():
    terms = [t.term for t in analyze("ภาษาไทย")]
    assert len(terms) == 6 and terms[0] == "ภา"


def test_simple_texts_take_the_same_path_as_others():
    for text in ("don't 3D mp3x 12ab cd34 o’clock's", "Straße À-la-carte x'y'z '' 1'a"):
        more = analyze(text + " 東", 0, False)[:-1]
        assert more == analyze(text, 0, False)


@pytest.mark.parametrize(("word", "stem"), [x.split(":") for x in (
    "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size "
    "hopping:hop filing:file happy:happi relational:relat conditional:condit generalization:gener running:run searching:search engines:engin is:is "
    "possibly:possibl analogical:analog hopefulness:hope adjustment:adjust adoption:adopt controlling:control rate:rate cease:ceas").split()])  # fmt: skip
def test_porter(word, stem):
    assert porter(word) == stem


def test_distances():
    assert weighted("langauge", "language") == 1 and weighted("libary", "library") == 1 and weighted("ca", "abc") == 3
    assert weighted("کتاپ", "کتاب") == 0.5
    assert bigrams("ab") == ["\x02a", "ab", "b\x03"]
    assert "کتاب" in confusable_variants("کتاپ")


def test_highlights():
    text, marks = highlight("Running engines run", {"run"})
    assert [text[a:b] for a, b in marks] == ["Running", "run"]
    _, marks = highlight("東京大学", {"東京", "京大", "大学"})
    assert marks[-1][1] == 4 and all(x[1] <= y[0] for x, y in zip(marks, marks[1:], strict=False))


def test_excerpts():
    text, marks = excerpt("start " + "lorem " * 100 + "target word here " + "ipsum " * 100, {"target"})
    assert text[0] == text[-1] == "…" and len(text) <= 242 and text[slice(*marks[0])] == "target"
    text, marks = excerpt("alpha " + "beta " * 100, {"missing"})
    assert text.startswith("alpha") and not marks
    text, _ = excerpt("😀" * 300, set())
    assert set(text) == {"😀", "…"}
    assert excerpt("short body", set()) == ("short body", [])
    assert excerpt(None, {"x"}) == ("", [])


def test_highlights_count_utf16_units():
    text, marks = highlight("😀 run", {"run"})
    assert marks == [(3, 6)] and text.encode("utf-16-le")[6:12].decode("utf-16-le") == "run"
