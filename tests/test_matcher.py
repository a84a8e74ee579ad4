import math

from orderloom.operators import evaluate as E
from orderloom.operators import evidence as EV
from orderloom.operators import fuzzy as Z
from orderloom.operators import lanes as L
from orderloom.operators import retrieval as RT
from orderloom.operators import tfidf as X
from pyspark.sql import functions as F

CONV = '[{"uom":"Pcs","conversion_factor":1.0},{"uom":"crate","conversion_factor":36.0}]'
#: tenant, code, name, barcode, part number, disabled
ITEMS = [
    ("reef", "RF-7001", "Ostrava Lamp Holder E27", "90210001", "LH/27", "0"), ("reef", "RF-7002", "Ostrava Lamp Holder E14", "90210002", "", "0"), ("reef", "RF-7003", "Ostrava Cable Gland 16mm", "90210002", None, "0"),
    ("reef", "RF-OFF9", "Ostrava Lamp Holder B22", "", "", "1"), ("dune", "DU-0450", "Ostrava Dimmer Knob", "90210001", "", "0"), ("reef", "RF-8800", "Ostrava Junction Lid", "", "", "0"), ("reef", "RF-8801", "Ostrava Junction Lid (Bulk)", "", "", "0"),
]
CAT = "tenant string, item_code string, item_name string, description string, brand string, item_group string, stock_uom string, uom_conversions string, barcode string, manufacturer_part_no string, disabled string"
LINE = "line_id string, tenant string, customer_id string, order_date string, raw_text string, buyer_sku string, raw_barcode string, uom_text string, notes string, key string"


def items(spark):
    rows = [(t, c, n, "", "Ostrava", "Electrical > Fittings", "Pcs", CONV, b, p, d) for t, c, n, b, p, d in ITEMS]
    rows.append(("reef", "RF-FEE", "ROUNDING LINE", "", "", "Electrical > Misc", "Pcs", "", "90210007", "", "0"))
    return L.catalogue(spark.createDataFrame(rows + rows[:2], CAT))


def lines(spark, rows):
    return spark.createDataFrame([(*r, "pcs", "", "k") for r in rows], LINE)


def test_exact_lanes_stay_in_the_tenant_and_off_dead_entries(spark):
    day = "2031-02-14"
    rows = [
        ("spaced", "reef", "B5", day, "lamp", "", "9021 0001"), ("shared", "reef", "B5", day, "see label 90210002 please", "", ""), ("typed", "reef", "B5", day, "x", "rf-7001", None), ("inside", "reef", "B5", day, "six of RF 7001, thanks", None, ""),
        ("part", "reef", "B5", day, "lh/27", "", ""), ("dead", "reef", "B5", day, "RF-OFF9 RF-FEE 90210007", "", ""), ("other", "dune", "B5", day, "90210001", "", ""), ("null", "reef", "B5", None, None, None, None),
    ]
    got = {tuple(r) for r in L.identifier_lanes(lines(spark, rows), items(spark)).collect()}
    assert got == {
        ("spaced", "RF-7001", "barcode"), ("shared", "RF-7002", "barcode"), ("shared", "RF-7003", "barcode"), ("typed", "RF-7001", "item_code"), ("inside", "RF-7001", "item_code"), ("part", "RF-7001", "part_number"), ("other", "DU-0450", "barcode"),
    }


SKU = "tenant string, customer_id string, customer_sku string, item_code string, valid_from string, valid_to string, source string, confidence double"


def test_aliases_conflicts_and_twins(spark):
    sku = spark.createDataFrame(
        [
            ("reef", "B5", "a1", "RF-7001", "2031-01-01", "", "ledger", 0.9), ("reef", "B5", "A-1", "RF-7001", "2031/01/05", None, "phone", 0.9), ("reef", "B5", "a2", "RF-7001", "2030-01-01", "2031-02-13", "ledger", 1.0),
            ("reef", "B6", "a3", "RF-7001", None, None, "ledger", 1.0), ("reef", "B5", "a4", "RF-OFF9", None, "2031-02-14", "ledger", 1.0), ("reef", "B5", "a5", "RF-7001", "20310214", None, "s", 0.4), ("reef", "B5", "a5", "RF-7002", "14.02.2031", None, "s", 0.5),
            ("reef", "B5", "a6", "RF-7001", None, "until further notice", "s", 1.0), ("reef", "B5", "a6", "RF-7002", "soon", None, "s", 1.0), ("reef", "B5", "a7", "DU-0450", None, None, "s", 1.0),
        ],
        SKU,
    )
    rows = [(k, "reef", "B5", "2031-02-14", "x", k, "") for k in ("a1", "a2", "a3", "a4", "a5", "a6", "a7")] + [("no day", "reef", "B5", "some day", "x", "a1", "")]
    alias = L.alias_lane(lines(spark, rows), sku, items(spark))
    # a6 has bounds that are no dates, a7 an item of another tenant
    assert {tuple(r) for r in alias.collect()} == {("a1", "RF-7001", True, 0.9, "phone"), ("a4", "RF-OFF9", False, 1.0, "ledger"), ("a5", "RF-7001", True, 0.4, "s"), ("a5", "RF-7002", True, 0.5, "s")}
    lanes = L.identifier_lanes(lines(spark, rows), items(spark))
    assert {tuple(r) for r in L.identifier_conflicts(lanes, alias).collect()} == {("a5", 2)}
    assert {r.item_code for r in L.active_twins(items(spark)).collect()} == {"RF-8800", "RF-8801"}
    codes = spark.createDataFrame([("reef", "B5", "z", "RF-7001", "2031-01-01", "", "s", 1.0), ("reef", "B5", "Z", "RF-7002", "2031-02-01", "2031-02-10", "s", 1.0)], SKU)
    assert {(r.key, r.codes, r.current_codes) for r in L.alias_collisions(codes, F.lit("2031-02-10")).collect()} == {("z", 2, 2)}
    assert {(r.key, r.codes, r.current_codes) for r in L.alias_collisions(codes, F.lit("2031-02-11")).collect()} == {("z", 2, 1)}


def test_grams(spark):
    df = spark.createDataFrame([("8 ab hex",)], "t string")
    r = df.select(X.word_grams(F.col("t")).alias("w"), X.char_grams(F.col("t")).alias("c")).first()
    assert sorted(r.w) == ["ab", "ab hex", "hex"]
    assert sorted(r.c) == sorted([" 8 ", " ab", "ab ", " ab ", " he", "hex", "ex ", " hex", "hex ", " hex "])


def test_tfidf_against_plain_python(spark):
    docs = {"A": "red hex bolt", "B": "blue hex nut", "C": "red red paint"}
    q = "red bolt zzz"
    grams = lambda t: [w for w in t.split() if len(w) > 1] + [" ".join(p) for p in zip(t.split(), t.split()[1:], strict=False)]
    df = {}
    for t in docs.values():
        for g in set(grams(t)):
            df[g] = df.get(g, 0) + 1
    idf = {g: math.log((1 + 3) / (1 + n)) + 1 for g, n in df.items()}

    def vector(t):
        v = {g: (1 + math.log(grams(t).count(g))) * idf[g] for g in set(grams(t)) if g in idf}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / n for g, x in v.items()}

    want = {d: round(sum(vector(q)[g] * w for g, w in vector(t).items() if g in vector(q)), 8) for d, t in docs.items()}
    corpus = spark.createDataFrame([("t", d, t) for d, t in docs.items()], "tenant string, item_code string, text string")
    asked = spark.createDataFrame([("t", q), ("t", q), ("t", ""), ("u", q), ("t", None)], "tenant string, q string")
    got = {r.item_code: r.score for r in X.top_k(asked, corpus, X.word_grams, 5).collect()}
    assert got == {d: s for d, s in want.items() if s > 0}


def test_evidence_ranks_the_named_item_first(spark):
    rows = [("named", "reef", "B5", "2031-02-14", "ostrava lamp holder 16 e27", "", ""), ("coded", "reef", "B5", "2031-02-14", "ostrava lamp", "", "90210001"), ("sized", "reef", "B5", "2031-02-14", "ostrava cable gland 16mm", "", ""), ("knob", "dune", "B5", "2031-02-14", "dimmer knob", "", "")]
    found = EV.hybrid_candidates(lines(spark, rows), items(spark), spark.createDataFrame([], SKU))
    placed = EV.ranked(EV.evidence(found, lines(spark, rows), items(spark)))
    top = {r.line_id: r for r in placed.where("place = 1").collect()}
    assert top["named"].item_code == "RF-7001" and top["named"].unit_match and top["named"].brand_match
    assert top["coded"].item_code == "RF-7001" and top["coded"].barcode_exact and top["coded"].score == 1.0 and top["coded"].margin > 0
    assert top["sized"].item_code == "RF-7003" and top["sized"].size_overlap == 1.0 and not top["sized"].attribute_conflict
    assert top["knob"].item_code == "DU-0450"
    texts = {r.line_id: r.candidates for r in EV.prediction_rows(placed).collect()}
    assert texts["sized"].startswith("RF-7003:0.") and texts["sized"].count("|") == 2


def test_measures(spark):
    def value(c):
        return spark.range(1).select(c).first()[0]

    ten, hundred = (value(E.wilson_lower(F.lit(n), F.lit(n))) for n in (10, 100))
    assert ten < 0.927 < hundred and value(E.wilson_lower(F.lit(0), F.lit(0))) == 0.0
    df = spark.createDataFrame([("g", "a", 0.9), ("g", "b", 0.7), ("h", "c", 0.4), ("h", "d", 0.4)], "g string, i string, s double")
    assert {(r.g, r.i, r.place, round(r.margin, 6)) for r in E.ranked_margin(df, "g", "s", "i").collect()} == {("g", "a", 1, 0.2), ("g", "b", 2, 0.0), ("h", "c", 1, 0.0), ("h", "d", 2, 0.0)}
    assert {(r.g, r.i, round(r.margin, 6)) for r in E.top_two(df, "g", "s", "i").collect()} == {("g", "a", 0.2), ("h", "c", 0.0)}
    d = spark.createDataFrame([(0.96, 0.1, True), (0.55, 0.0, False), (1.0, 0.3, True), (0.2, 0.5, True)], "confidence double, margin double, correct boolean")
    points = E.sweep(d)
    got = {(r.confidence_limit, r.margin_limit): (r.passed, r.correct) for r in points.collect()}
    for c in E.CONFIDENCES:
        for m in E.MARGINS:
            hit = [k for a, b, k in [(0.96, 0.1, 1), (0.55, 0.0, 0), (1.0, 0.3, 1), (0.2, 0.5, 1)] if a >= c and b >= m]
            assert got[c, m] == (len(hit), sum(hit))
    best = E.best_point(points, 1.0).first()
    assert (best.passed, best.confidence_limit, best.margin_limit) == (2, 0.96, 0.0)
    bins = E.calibration(spark, spark.createDataFrame([(0.98, 1), (1.0, 0), (0.5, 1)], "confidence double, correct int")).orderBy("low").collect()
    assert [(b.n, b.mean_confidence, b.share_correct) for b in bins] == [(0, 0, 0), (1, 0.5, 1.0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (2, 0.99, 0.5)]


def test_gates_and_chart_points(spark):
    m = spark.createDataFrame([(0.9, 0.4, None)], "precision double, coverage double, cost double")
    got = {tuple(r) for r in E.gates(m, {"precision": 0.95, "coverage": 0.3}, {"cost": 1.0, "coverage": 0.3, "other": 1.0}).collect()}
    assert got == {("below_minimum", "precision", "0.9"), ("above_maximum", "cost", "missing"), ("above_maximum", "coverage", "0.4"), ("above_maximum", "other", "missing")}
    assert E.gates(m, {"precision": 0.9}, {}).count() == 0
    p = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.2, 3.0)], "x double, y double")
    assert {tuple(r) for r in E.chart_points(p, "x", "y").collect()} == {(0.1, 2.0), (0.2, 3.0)}


def test_bootstrap_and_folds(spark):
    g = spark.createDataFrame([(0, 9, 10), (1, 5, 10), (2, 8, 10)], "slot long, hits long, total long")
    a, b = (E.bootstrap(g, 300).first() for _ in range(2))
    assert a == b and 0.5 <= a.low <= a.high <= 0.9
    rows = spark.createDataFrame([(k,) for k in "aaaaabbbbcccdde"], "k string")
    got = {r.k: r.fold for r in E.folds(rows, "k", 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 1}
    assert E.folds(rows.limit(0), "k", 3).count() == 0


def test_bootstrap_draws_with_replacement(spark):
    # 41 groups, a prime: a slot linear in the draw would take every group exactly once
    rows = E.draws(spark, 41, 200, 1729).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("kinds"), F.min("slot").alias("low"), F.max("slot").alias("high")).collect()
    assert len(rows) == 200 and all(r.n == 41 and r.low >= 0 and r.high < 41 for r in rows)
    assert max(r.kinds for r in rows) < 41 and 25 < sum(r.kinds for r in rows) / 200 < 27.1  # 41 * (1 - (1 - 1/41) ** 41) = 26.1
    g = spark.createDataFrame([(i, i * i % 97, 100) for i in range(41)], "slot long, hits long, total long")
    b = E.bootstrap(g, 400).first()
    mean = sum(i * i % 97 for i in range(41)) / 4100
    sd = (sum((i * i % 97 / 100 - mean) ** 2 for i in range(41)) / 41) ** 0.5 / 41**0.5
    assert abs((b.high - b.low) / (2 * 1.96 * sd) - 1) < 0.2 and b.low < mean < b.high


def test_bootstrap_of_a_tenant_without_any_answer_equals_its_sql(spark, tmp_path):
    import duckdb
    from orderloom.plans import ledger

    # with one tenant every way to draw gives the same sample, so query and SQL must agree
    rows = [(i, "t", "L", "X", "s", 0.5, 1, None, 5, "2026-01-01T00:00:00Z") for i in range(3)]
    schema = "event_id long, tenant_id string, line_id string, item_code string, stage string, score double, rank int, accepted int, latency_ms int, created_at string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "match_event.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW match_event AS SELECT * FROM '{tmp_path}/match_event.parquet/*.parquet'")
    assert [tuple(r) for r in ledger.bootstrap_ci(spark, str(tmp_path)).collect()] == con.execute(ledger.SQL["bootstrap_ci"]).fetchall() == [(0.0, 0.0)]


def test_fuzzy_lane_is_the_brute_force_one(spark):
    words = "gate valve brass pipe clamp rubber lined hex bolt steel frozen fish cooked made for sold by the piece workshop".split()
    texts = [" ".join(words[(i * k + k) % len(words)] for k in range(1, 2 + i % 13)) for i in range(60)] + ["", "gate", "xxxx"]
    asked = ["gaet vlave brss", "clamp", "bolt hex stel m", "zq", "frozen fish cooked made for sold by the piece workshop frozen fish cooked made for sold", "pipe clamp rubber lined hex bolt", ""]
    docs = spark.createDataFrame([("t", f"C{i:02}", x) for i, x in enumerate(texts)] + [("u", "A", "gate valve")], "tenant string, item_code string, text string")
    queries = spark.createDataFrame([(t, q) for q in asked * 2 for t in ("t", "u")], "tenant string, q string")
    want = {q: sorted((-round(Z.weighted_ratio(q, x) / 100, 8), f"C{i:02}") for i, x in enumerate(texts))[:20] for q in asked if q}
    for block_entries in (1000, 25):
        got = {}
        for r in Z.top_k(queries, docs, 20, block_entries).where("tenant = 't'").orderBy("q", "place").collect():
            got.setdefault(r.q, []).append((-r.score, r.item_code))
        assert got == want
    assert Z.top_k(queries, docs, 20).where("tenant = 'u'").count() == len(asked) - 1


def test_fuzzy_lane_alone_gives_candidates(spark):
    cat = items(spark)
    # shares no gram with any entry, so only the fuzzy lane has candidates: all live ones of the tenant
    line = spark.createDataFrame([("1", "dune", "c", "2026-01-01", "nzrf", "", "", "", "", "1")], LINE)
    aliases = spark.createDataFrame([], "tenant string, customer_id string, customer_sku string, item_code string, valid_from string, valid_to string, source string, confidence double")
    found = EV.hybrid_candidates(line, cat, aliases)
    got = EV.evidence(found, line, cat).collect()
    assert [(r.item_code, r.word, r.char) for r in got] == [("DU-0450", 0.0, 0.0)] and got[0].fuzzy == round(Z.weighted_ratio(got[0].q, cat.where("tenant = 'dune'").first().search_text) / 100, 8) > 0


def test_fuzzy_search_compares_few_texts_and_misses_none(spark, monkeypatch):
    # 300 texts that share a word with the query; only near copies of it are compared, and long queries against texts of their length too
    sizes, kinds = ["M6x25", "M8x30", "M10x60", "M12x80", "12mm", "0.75kg"], ["hex bolt", "carriage screw", "wood screw", "cable tie", "copper elbow"]
    texts = [f"ostrava {kinds[i % 5]} {sizes[i % 6].lower()} grade {i % 10} {kinds[i % 5]} {sizes[i % 6].lower()} made for ostrava sold by the nos lot {i} workshop {kinds[i % 5]}" for i in range(300)]
    asked = ["ostrava hex bolt m6x25 grade 0", "ostrva carriage screw m8x30 grad 1", "for", "bo", "xyz ostrava q", "nos lot 77 workshop wood screw ostrava m10x60 grade 7 wood screw m10x60 made for ostrava", "st ma", "hex lot 5 bolt m12x80 grade 5 ostrava hex bolt made for ostrava sold by the nos"]
    entries, calls = Z.Entries([(f"C{i:03}", t) for i, t in enumerate(texts)]), []
    real = Z.Entries._exact
    monkeypatch.setattr(Z.Entries, "_exact", lambda self, q, shapes, rows, shares: (calls.append(len(rows)), real(self, q, shapes, rows, shares))[1])
    for q in asked:
        want = sorted((-round(Z.weighted_ratio(q, t) / 100, 8), f"C{i:03}") for i, t in enumerate(texts))[:20]
        assert [(-v, c) for c, v in entries.top(q, 20)] == want
    calls.clear()
    entries.top(asked[1], 20)
    assert sum(calls) < 100


def test_candidates_of_all_blocks_equal_those_of_one(spark):
    docs = L.catalogue(spark.createDataFrame([("t", f"C{i:02}", f"lamp holder {i % 7} e{i % 4} {'ring' * (i % 3)}", "", "B", "g", "Pcs", "", "", "", "0") for i in range(40)], CAT)).select("tenant", "item_code", F.col("search_text").alias("text"))
    asked = spark.createDataFrame([("t", q) for q in ("lamp holder 3", "holder e2 ringring", "lmap hodler", "zz", "")] + [("u", "lamp")], "tenant string, q string")
    lanes = {"word": X.word_grams, "char": X.char_grams}

    def rows(block_entries):
        return {(r.q, tuple(sorted(map(tuple, r.found)))) for r in RT.search(asked, docs, lanes, 5, fuzzy=True, block_entries=block_entries).collect()}

    # a ratio that only a lexical lane asked for is the same in whichever block
    assert rows(1000) == rows(15) and {q for q, _ in rows(1000)} == {"lamp holder 3", "holder e2 ringring", "lmap hodler", "zz"}
