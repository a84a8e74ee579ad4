from hypothesis import given
from hypothesis import strategies as st
from orderloom.operators.units import number_of, quantities, quantities_in_stock_unit, unit_aliases, weighted_distance
from pyspark.sql import functions as F

CAT = "tenant string, item_code string, item_name string, stock_uom string, uom_conversions string, unit string"
LINES = "line_id string, tenant string, qty string, uom_text string, raw_text string, item_code string, place int"
ITEMS = [
    ("t", "BOLT", "Acme Bolt M8", "Nos", '[{"uom":"Nos","conversion_factor":1.0},{"uom":"ctn","conversion_factor":200.0}]', "x"),
    ("t", "FISH", "Acme Cod Loin 120g", "Kg", '[{"uom":"Kg","conversion_factor":1.0},{"uom":"Bag","conversion_factor":5.0}]', "x"),
    ("t", "TAPE", "Acme Tape 36mm", "Roll", '[{"uom":"Roll","conversion_factor":1.0},{"uom":"Mtr","conversion_factor":0.05}]', "x"),
    ("t", "RING", "Acme Shrimp Ring Cooked 40 pcs", "Nos", "", "x"),
    ("t", "RING", "Acme Shrimp Ring Cooked 40 pcs", "Nos", "", "x"),
]


def milli(spark, rows):
    """rows: item, qty, uom, text -> thousandths by row number."""
    lines = spark.createDataFrame([(str(i), "t", q, u, t, "other", 1) for i, (_, q, u, t) in enumerate(rows)], LINES)
    labels = spark.createDataFrame([(str(i), r[0]) for i, r in enumerate(rows)], "line_id string, item_code string")
    got = {int(r.line_id): r.qty_milli for r in quantities_in_stock_unit(lines, labels, spark.createDataFrame(ITEMS, CAT)).collect()}
    return [got.get(i) for i in range(len(rows))]


def test_cells(spark):
    cases = [
        (("BOLT", "12", "", None), 12000), (("BOLT", "2 x 4", "doz", None), 96000), (("BOLT", "4½", "gross", None), 648000), (("BOLT", "1,200", "EA", None), 1200000),
        (("BOLT", "3 ctn.", None, None), 600000), (("BOLT", "2", "box of 15", None), 30000), (("BOLT", "2", "ctn/6", None), 12000), (("BOLT", "2", "kg", None), None),
        (("BOLT", "tbc", "ctn", None), None), (("BOLT", None, "ctn", "5 pcs bolt"), None), (("BOLT", "twelve", "pr", None), 24000), (("BOLT", "1/2", "dz", None), 6000),
        (("FISH", "5", "LB", None), 2268), (("FISH", "750", "gm", None), 750), (("FISH", "2", "tonnes", None), 2000000), (("FISH", "1 1/2", "bags", None), 7500), (("FISH", "3", "pcs", None), None),
        (("TAPE", "250", "cm", None), 125), (("TAPE", "10", "metres", None), 500), (("TAPE", "0.5", "rl", None), 500), (("TAPE", "7", "BAG", None), None), (("BOLT", "3", "blorb", None), None),
    ]
    assert milli(spark, [c for c, _ in cases]) == [w for _, w in cases]


def test_free_text(spark):
    cases = [
        (("BOLT", "", None, "6 pair Acme Bolt M8"), 12000), (("BOLT", None, "", "Acme Bolt M8 (5 carton)"), 1000000), (("BOLT", None, None, "Acme Bolt, qty 2,400 Nos."), 2400000),
        (("BOLT", None, None, "Acme Bolt M8"), None), (("BOLT", None, None, None), None), (("RING", None, None, "Acme Shrimp Ring Cooked 40 pcs"), None),
        (("RING", None, None, "40 pcs Shrimp Ring Cooked Acme"), None), (("RING", None, None, "Acme Shrimp Ring Cooked 40 pcs - 25 pcs"), 25000),
        (("RING", None, None, "40 pcs of Acme Shrimp Ring Cooked 40 pcs"), 40000), (("FISH", None, None, "Acme Cod Loin 120g qty: 8kgs"), 8000),
    ]
    assert milli(spark, [c for c, _ in cases]) == [w for _, w in cases]


def test_missing_everything(spark):
    assert milli(spark, []) == []
    assert milli(spark, [("GONE", "1", "pcs", None), ("BOLT", None, None, None)]) == [None, None]


def test_numbers_as_words_in_free_text(spark):
    text = "two boxes of latex gloves"
    lines = spark.createDataFrame([("1", "t", None, None, text), ("2", "t", None, None, "latex gloves")], "line_id string, tenant string, qty string, uom_text string, raw_text string")
    got = [(r.line_id, float(r.number), r.spelling) for r in quantities(lines).collect()]
    assert got == [("1", 2.0, "boxes")]


def test_aliases_of_slips(spark):
    words = ["cartn", "cartonn", "kilogrm", "bxes", "pakcet", "zz", "boxer", "g", "x" * 60, None]
    got = {r.spelling: r.unit for r in unit_aliases(spark.createDataFrame([(w,) for w in words], "spelling string")).collect()}
    assert {k: got.get(k) for k in ("cartn", "cartonn", "kilogrm", "bxes", "pakcet", "zz", "g")} == {"cartn": "carton", "cartonn": "carton", "kilogrm": "kilogram", "bxes": "box", "pakcet": "packet", "zz": None, "g": "gram"}


def test_numbers(spark):
    cases = {"1,200.5": 1200.5, "1,5": 1.5, ".5": 0.5, "¾": 0.75, "3 1/4": 3.25, "1/0": None, "ten": 10.0, "": None, "x": None, "2 X 3": 6.0}
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", number_of(F.col("v")).alias("n")).collect()
    assert {r.v: r.n for r in got} == cases


@given(st.text("abcs", max_size=8), st.text("abcs", max_size=8))
def test_distance_is_zero_only_for_equal_words_and_at_most_all_letters(a, b):
    assert weighted_distance(a, b) <= len(a) + len(b)
    assert (weighted_distance(a, b) == 0) == (a == b)
