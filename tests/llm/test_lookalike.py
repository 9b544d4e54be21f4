import unicodedata

import pytest

from assaylake.llm.lookalike import canonical_texts, look_alike_classes, look_alike_map, look_alike_pairs

ALIKE = [
    ["fix café", "fix café", "ﬁx café", "fıx".replace("fıx", "fix") + " café", "ｆｉｘ café", "fix café", "f​ix café", "f­ix café", "fіx café"],
    ["a-b", "a‐b", "a‑b", "а-b", "a－b"],
    ["ệ", "ệ", "ệ", "е̣̂"],
    ["한글", unicodedata.normalize("NFD", "한글")],
    ["ガ", unicodedata.normalize("NFD", "ガ"), "ｶﾞ"],
    ["ё", "ë", "ё"],
    ["Hello", "\U0001d407\U0001d41e\U0001d425\U0001d425\U0001d428", "\U0001d43b\u212f\U0001d459\U0001d459\U0001d45c", "\u210dello", "Неllо"],
]
APART = ["a b", "a\tb", "a\nb", "a\r\nb", "ab", "AB", "aB", "l", "I", "1", "|", "0", "O", "o", "e", "é", "è", "ss", "ß", "a\x01b", "a\x02b", "x²", "x2", "rn", "m", "a  b", "ａ b".replace("ａ", "à")]


def brute(rows):
    table = str.maketrans(look_alike_map())
    look = lambda t: unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).translate(table))
    keep = [(k, t, look(t)) for k, t in rows if t is not None and look(t).strip()]
    return {(min(a, b), max(a, b)) for i, (a, t, x) in enumerate(keep) for b, u, y in keep[i + 1 :] if x == y and t != u}


@pytest.fixture(scope="module")
def rows():
    texts = [t for g in ALIKE for t in g] + APART + ["", " ", "​", "​ ", None, None, "same", "same"]
    return list(enumerate(texts))


def test_pairs(spark, rows):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, _class string, class_id int")
    got = {tuple(r) for r in look_alike_pairs(df, "doc_id", "text").collect()}
    assert got == brute(rows)
    text = dict(rows)
    want = {frozenset((a, b)) for g in ALIKE for a in g for b in g if a != b}
    assert {frozenset((text[a], text[b])) for a, b in got} == want


def test_copies_and_hot_class(spark):
    rows = [(k, "Merge" if k % 3 else "Mеrge") for k in range(60)]
    df = spark.createDataFrame(rows + rows[:2] + [(None, "Merge")], "doc_id long, text string")
    got = [tuple(r) for r in look_alike_pairs(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_canonical(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.doc_id: r for r in canonical_texts(df, "doc_id", "text").collect()}
    assert len(by) == len(rows)
    text = dict(rows)
    for group in ALIKE:
        ids = [k for k, t in rows if t in group]
        assert len({by[k].canonical for k in ids}) == 1 and len({by[k].class_id for k in ids}) == 1
    assert by[0].canonical == "fix café"
    apart = [k for k, t in rows if t in APART]
    assert len({by[k].class_id for k in apart}) == len(apart)
    nulls = [k for k, t in rows if t is None]
    assert all(by[k].canonical is None and by[k].class_id is None for k in nulls)
    assert all(by[k].canonical == t for k, t in rows if t is not None and t.isascii() and "\x01" not in t and "\x02" not in t and t.strip()) or text


def test_empty_and_long(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert look_alike_pairs(df, "doc_id", "text").count() == 0 and canonical_texts(df, "doc_id", "text").count() == 0
    long = "x" * 400_000
    df = spark.createDataFrame([(1, long), (2, long + "​"), (3, long + "y")], "doc_id long, text string")
    assert [tuple(r) for r in look_alike_pairs(df, "doc_id", "text").collect()] == [(1, 2)]


def test_classes(spark, rows):
    df = spark.createDataFrame(rows + rows[:1] + [(None, "a-b")], "doc_id long, text string")
    found = look_alike_classes(df, "doc_id", "text")
    text = dict(rows)
    classes = {r.class_id: r for r in found.classes.collect()}
    assert len(classes) == len(ALIKE) and {r.canonical for r in classes.values()} >= {"fix café", "a-b", "Hello"}
    assert {r.class_id: r.n_spellings for r in classes.values()} == {c: len({text[r.doc_id] for r in found.members.where(found.members.class_id == c).collect()}) for c in classes}
    spellings = found.spellings.collect()
    assert len({text[r.representative] for r in spellings}) == len(spellings)
    members = found.members.collect()
    assert len({(r.doc_id) for r in members}) == len(members)
    canonical = {r.doc_id: r.canonical for r in canonical_texts(df, "doc_id", "text").collect() if r.doc_id is not None}
    assert all(canonical[r.doc_id] == classes[r.class_id].canonical for r in members)
