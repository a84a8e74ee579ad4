from hypothesis import given
from hypothesis import strategies as st
from orderloom.functions import text as T
from orderloom.operators.fuzzy import common, partial_ratio, ratio, token_set_ratio, token_sort_ratio, weighted_ratio
from pyspark.sql import functions as F


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def test_texts(spark):
    cases = {
        "M8x50 Bolt": "m 8 x 50 bolt", "SS304 pipe": "stainless steel 304 pipe", "box20": "bo x 20", '1-1/2" elbow': "1 1 2 elbow", "2 ctn GALV": "2 carton galvanised", "Crème brûlée 1.5kg": "creme brulee 1.5 kilogram",
        "Ægir": "gir", "½ box": "12 box", "": "", None: "", "!!!": "", "pcs nos pkt zp": "piece piece packet zinc plated", "ｆｕｌｌ ﬁne": "full fine",
    }
    assert column(spark, list(cases), T.normalise_text) == list(cases.values())
    assert column(spark, ["pls send 2 BOLT", "urgent order", None], T.normalise_order_text) == ["2 bolt", "", ""]
    assert column(spark, ["AB-1 2/x", None, "é"], T.normalise_identifier) == ["ab12x", "", ""]
    assert column(spark, ["PCS", "Ctn", "Nos", "barrel", None], T.normalise_unit) == ["piece", "carton", "piece", "barrel", ""]
    assert column(spark, ["1 Please, send-it", "please send need x", "item A"], T.audit_text) == ["please send it", "need x", "a"]


def test_sets_and_predicates(spark):
    assert column(spark, ["b a b", ""], T.token_set) == [["a", "b"], []]
    assert column(spark, ["m 8 x 50 mm 5 kilogram", "bolt", ""], T.numeric_tokens) == [["5", "50", "50mm", "5kilogram", "8"], [], []]
    assert column(spark, ["", "sub subtotal x", "thanks", "thanks a lot", "total", "please confirm stock now", "bolt"], T.is_non_item) == [True, True, True, False, True, True, False]
    assert column(spark, ["a #ref! b", "#N/A", "fine", None], T.has_error_token) == [True, True, False, False]
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["b"]), (["a"], [])], "l array<string>, r array<string>")
    assert [r[0] for r in df.select(T.overlap(F.col("l"), F.col("r"))).collect()] == [0.5, 0.0, 0.0]


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b, 1):
            now.append(max(row[j], now[j - 1], row[j - 1] + (x == y)))
        row = now
    return row[-1]


@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_fuzzy_against_plain_forms(a, b):
    assert common(a, b) == slow_common(a, b)
    s, g = sorted((a, b), key=len)
    parts = [g[max(0, i) : i + len(s)] for i in range(1 - len(s), len(g))]
    assert abs(partial_ratio(a, b) - max((ratio(s, p) for p in parts), default=0.0)) < 1e-9
    assert 0 <= weighted_ratio(a, b) <= 100.0000001


def test_fuzzy_values():
    assert weighted_ratio("hex bolt", "hex bolt") == 100 and weighted_ratio("", "x") == 0 and weighted_ratio(None, "x") == 0
    assert token_sort_ratio("bolt hex", "hex bolt") == 100 and token_set_ratio("hex bolt", "hex bolt m8") == 100
    assert weighted_ratio("bolt hex", "hex bolt") == 95.0
