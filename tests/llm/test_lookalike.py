from collections import Counter

from orderloom.llm import queries
from orderloom.llm.lookalike import Reader, bigrams, fold, lookalike_classes, lookalike_pairs, looks, unified

SCHEMA = "doc_id long, text string, look string, same string"
SAME = [
    ("Torvexa pipe", "Tоrvехa pipe"), ("order 12-15", "order 12‑15"), ("ｏｒｄｅｒ　７", "order 7"), ("prêt", "prêt"), ("file", "ﬁle"), ("re­turn", "re​turn"),
    ("5 K", "5 \u212a"), ("А", "Α"), ("ёлка", "ёлка"), ("a﻿b", "ab"), ("VIII", "Ⅷ"),
]
OTHER = [
    ("m²", "m2"), ("Order", "order"), ("crème", "creme"), ("a b", "ab"), ("a  b", "a b"), ("12", "13"), ("①", "1"), ("a.b", "a,b"), ("½", "1/2"), ("З", "3"), ("a–b", "a-b"),
    ("می‌خواهم", "میخواهم"), ("🧑‍🏭", "🧑🏭"), ("к", "k"), ("a\nb", "a b"),
]


def test_keys():
    for a, b in SAME:
        assert looks(a) == looks(b), (a, b)
    for a, b in OTHER:
        assert looks(a) != looks(b), (a, b)


def test_readings_are_one_script_and_the_same_for_all_that_look_the_same():
    counts = bigrams("Torvexa Copper Elbow order path expose case " * 5 + "Заказ ещё не проверен оператором сорок сосна роса " * 5)
    reader = Reader(dict(counts))
    assert reader.text("Tоrvехa Соррer") == "Torvexa Copper"
    assert reader.text("пpовеpен oпepaтopом") == "проверен оператором"
    for a, b in SAME:
        assert reader.text(a) == reader.text(b)


def test_pairs(spark):
    texts = [t for pair in SAME for t in pair] + [None, "", "​", "  "] + [t for pair in OTHER for t in pair]
    texts += ["copy", "copy", "cоpy", "cоpy"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = {tuple(r) for r in lookalike_pairs(df).collect()}
    n = len(texts)
    want = {(2 * i, 2 * i + 1) for i in range(len(SAME))} | {(a, b) for a in (n - 4, n - 3) for b in (n - 2, n - 1)}
    first = {(i, j) for i in range(n) for j in range(i + 1, n) if texts[i] and texts[j] and texts[i] != texts[j] and looks(texts[i]).strip() and looks(texts[i]) == looks(texts[j])}
    assert got == first and want <= got


def test_unified_forms(spark):
    df = spark.createDataFrame([(1, None), (2, "​"), (3, "Ａ b"), (4, "x" * 50000)], "doc_id long, text string")
    got = {r.doc_id: (r.unified, r.look is None) for r in unified(df).collect()}
    assert got == {1: (None, True), 2: ("", True), 3: ("A b", False), 4: ("x" * 50000, False)}
    assert unified(df.limit(0)).count() == 0 and lookalike_pairs(df.limit(0)).count() == 0


def test_fold_keeps_what_is_seen():
    assert fold("a\tb\n²½①") == "a\tb\n²½①"
    assert fold("a\x00\x1fb\x7f\r") == "ab\r"


def test_capitals_and_old_letters():
    for a, b in (("QUWV", "ԚUԜѴ"), ("Yy", "Үү"), ("Il", "Ӏӏ"), ("Əə", "Әә")):
        assert looks(a) == looks(b), (a, b)


def test_classes_and_links(spark):
    texts = ["copy", "copy", "cоpy", "cоpy", "сopy", "alone", "alone", None, "", "\u200b", "ｃｏｐｙ"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = {(r.doc_id, r.class_id, r.links) for r in lookalike_classes(df).collect()}
    keys = {i: looks(t).strip() for i, t in enumerate(texts) if t and looks(t).strip()}
    assert got == {(i, min(j for j in keys if keys[j] == k), sum(keys[j] == k and texts[j] != texts[i] for j in keys)) for i, k in keys.items()}
    ends = Counter(d for r in lookalike_pairs(df).collect() for d in r)
    assert {d: n for d, _, n in got if n} == dict(ends)
    assert lookalike_classes(df.limit(0)).count() == 0


def test_the_query_of_forms_writes_each_word_in_the_script_that_the_corpus_has(spark, tmp_path):
    corpus = ["Torvexa Copper Elbow order path expose case"] * 5 + ["Заказ ещё не проверен оператором сорок сосна роса"] * 5
    mixed = ["Tоrvехa Соррer", "пpовеpен oпepaтopом", None, "\u200b"]
    df = spark.createDataFrame(list(enumerate(corpus + mixed)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.form for r in queries.p10_forms(spark, str(tmp_path)).collect()}
    # folding alone would write the second in Latin letters
    assert [got[10 + i] for i in range(4)] == ["Torvexa Copper", "проверен оператором", None, ""]
    assert looks("пpовеpен") != "проверен"
