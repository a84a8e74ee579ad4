from orderloom.llm.canonical import NOTHING, UNMATCHED, Matcher, _decided, items_of_lines, learned, map_to_list, plain, split

LIST = [
    ("V15", "Stavrik Gate Valve DN15 Brass", "Stavrik", "Gate Valve"), ("V20", "Stavrik Gate Valve DN20 Brass", "Stavrik", "Gate Valve"), ("V20B", "Stavrik Gate Valve DN20 Brass (Bulk)", "Stavrik", "Gate Valve"),
    ("V20Z", "Stavrik  GATE VALVE DN20 Bronze", "Stavrik", "Gate Valve"), ("T20", "Torvexa Gate Valve DN20 Brass", "Torvexa", "Gate Valve"), ("C1", "Torvexa Pipe Clamp 1-1/4\" Rubber Lined", "Torvexa", "Pipe Clamp"),
    ("C2", "Torvexa Pipe Clamp 1/4\" Rubber Lined", "Torvexa", "Pipe Clamp"), ("S1", "Kålvik Shrimp Ring Cooked 40 pcs", "Kålvik", "Shrimp Ring"), ("S2", "Kålvik Shrimp Ring Cooked 28 pcs", "Kålvik", "Shrimp Ring"),
    ("D1", "Stavrik Chain Link 3mm Long", "Stavrik", "Chain Link"), ("D2", "Stavrik Chain Link 3mm Long", "Stavrik", "Chain Link"), ("B1", "Kålvik Cod Loin 0.75kg Breaded", "Kålvik", "Cod Loin"),
    ("C3", "Stavrik Pipe Clamp 2\" Unlined", "Stavrik", "Pipe Clamp"),
]
FILLERS = frozenset(["pls", "send", "urgent", "code", "as", "per", "our"])


def test_values():
    m = Matcher(LIST, {"injap": {"valve": 0.95}}, FILLERS)
    cases = {
        "Stavrik Gate Valve DN20 Brass": "V20", "urgent!! stavirk GATE VLV dn-20 brass pls": "V20", "STAVRIK gate injap NB20 Brass": "V20", "Stavrik Gate Valve DN20 Brass bulk": "V20B",
        "Stav. Gate Valve DN 20 bronze (5 ctn)": "V20Z", "Gate Valve DN20 Brass": UNMATCHED, "Torvexa Gate Valve DN15 Brass": UNMATCHED, "Torvexa Gate Valve DN20 Bronze": UNMATCHED,
        "Torvexa/Pipe/Clamp/1-1/4\"/Rubber/Lined": "C1", "Torvexa pipe clamp 1 1/4 inch RBR LND": "C1", "Torvexa Pipe Clamp 1/4” rubber lined": "C2", "Torvexa Pipe Clamp": UNMATCHED,
        "Kalvik Shrimp Ring Cooked 40 pcs - 25 pcs": "S1", "40 pcs Shrimp Ring Cooked Kålvik": "S1", "KÅLV1K SHR1MP RING 28 pcs": "S2", "Stavrik Chain Link 3mm Long": UNMATCHED,
        "Torvexa Pipe Clamp 1/4\" Unlined": UNMATCHED, "Stavrik pipe clamp 2 inch unlned": "C3",
        "Stavrik Chain Link 0.3cm Short": UNMATCHED, "Kålvik CodLoin 750g Breaded": "B1", "Zorblax Gate Valve DN20 Brass": UNMATCHED, "as per our code": NOTHING, "": NOTHING, None: NOTHING, "----": NOTHING,
        "Kålvik Cod Loin 0.75kg Breaded" + " pls" * 3000: "B1",
    }
    assert {k: m.match(k) for k in cases} == cases


def test_measures_in_one_unit():
    assert split(plain("M6*45 0.52KG 500 ml 2.5L dn-50 Sz.9 gr8.8 3/4\""))[0] == split(plain("m6x45 520g 0.5l 2500ml DN50 size 9 grade 8.8 0.75 inch"))[0]


def test_words_are_learned_from_confirmed_values():
    counts = [("injap", None, 10), ("injap", "valve", 9), ("tq", None, 20), ("tq", "", 19), ("rare", None, 2), ("rare", "valve", 2), ("mixed", None, 9), ("mixed", "a", 3), ("mixed", "b", 2)]
    aliases, fillers = learned(counts, 100)
    assert set(aliases) == {"injap"} and aliases["injap"].keys() == {"valve"} and fillers == {"tq"}


CAT = "tenant string, item_code string, item_name string, brand string, item_group string, disabled string, code string, value string"


def frames(spark, lines, labels):
    cat = [("t", c, n, b, f"W > {k}", "0", "x", "y") for c, n, b, k in LIST]
    cat += [("t", "OLD", "Torvexa Gate Valve DN15 Brass", "Torvexa", "W > Gate Valve", "1", "x", "y"), ("t", "M", "PALLET DEPOSIT", "", "W > Misc", "0", "x", "y"), ("u", "V20", None, None, None, None, "x", "y")] + cat[:3]
    return (
        spark.createDataFrame([(*x, "z") for x in lines], "line_id string, tenant string, raw_text string, item_code string"),
        spark.createDataFrame(labels, "line_id string, item_code string"), spark.createDataFrame(cat, CAT),
    )


def test_lines(spark):
    lines = [("1", "t", "Stavrik Gate Valve DN20 Brass"), ("1", "t", "Stavrik Gate Valve DN20 Brass"), ("2", "t", None), ("3", "t", "as per our code"), ("4", "t", "Torvexa Gate Valve DN15 Brass"), ("5", "u", "Stavrik Gate Valve DN20 Brass"), ("6", None, "x"), (None, "t", "x"), ("7", "t", "Torvexa Gate Valve DN20 Brass"), ("8", "t", "")]
    data = frames(spark, lines, [("7", "T20"), ("7", "T20"), (None, "x"), ("99", None)])
    by_code = spark.createDataFrame([("2", "C1"), ("3", "C2"), ("1", "C2")], "line_id string, item_code string")
    got = {r.line_id: r.item_code for r in items_of_lines(*data, by_code).collect()}
    assert got == {"1": "V20", "2": "C1", "3": "C2", "4": UNMATCHED, "5": UNMATCHED, "6": UNMATCHED, "8": UNMATCHED}


def test_empty(spark):
    lines, labels, cat = frames(spark, [], [])
    none = spark.createDataFrame([], "line_id string, item_code string")
    assert items_of_lines(lines, labels, cat, none).count() == 0
    one = frames(spark, [("1", "t", "Stavrik Gate Valve DN20 Brass")], [])[0]
    assert [r.item_code for r in items_of_lines(one, labels, cat.limit(0), none).collect()] == [UNMATCHED]


def test_what_is_learned_does_not_depend_on_how_much_is_confirmed(spark):
    counts = [("injap", None, 3), ("injap", "valve", 3), ("tq", None, 3), ("tq", "", 2), ("rare", None, 2), ("rare", "valve", 2)]
    aliases, fillers = learned(counts, 3_000_000)
    assert (aliases, fillers) == learned(counts, 100) and aliases.keys() == {"injap"} and fillers == {"tq"}
    counts += [("two", None, 10), ("two", "a", 8), ("two", "b", 7), ("far", None, 10), ("far", "a", 9), ("far", "b", 5), ("mixed", None, 9), ("mixed", "a", 3)]
    df = spark.createDataFrame([(t, *c) for c in counts for t in ("t", "u")], "tenant string, word string, target string, n long")
    for single in (True, False):
        rows = _decided(df, single).where("tenant = 't'").collect()
        aliases, fillers = learned(counts, 0, single)
        assert {r.word for r in rows} == aliases.keys() | fillers and len(rows) == len(fillers) + sum(map(len, aliases.values()))
        assert learned([x for r in rows for x in ((r.word, None, r["all"]), (r.word, r.target, r.n))], 0, single) == (aliases, fillers)


def test_a_list_in_parts_gives_what_the_whole_one_gives(spark):
    values = [n for _, n, _, _ in LIST] + ["Stav. Gate Valve DN 20 bronze (5 ctn)", "Gate Valve DN20 Brass", "Torvexa Gate Valve DN15 Brass", "Kalvik Shrimp Ring - 28 pcs", "as per our code", "Torvexa Pipe Clamp", "  "]
    df = spark.createDataFrame([(t, v) for v in values * 2 for t in ("t", "u", "none")], "tenant string, value string")
    entries = spark.createDataFrame([("t", *e) for e in LIST] + [("u", *e) for e in LIST[:3]], "tenant string, code string, name string, brand string, kind string")
    taught = spark.createDataFrame([("t", f"injap Stavrik Gate DN20 Brass {i}", "V20") for i in range(4)], "tenant string, value string, code string")
    every = []
    for block_entries in (1000, 13, 4, 1):
        rows = map_to_list(df, entries, taught, block_entries)
        every.append(sorted((r.tenant, r.value, r.code) for r in rows.where("tenant != 'none'").collect()))
        assert rows.columns == ["tenant", "value", "code"]
    assert len(every[0]) == 2 * (len(values) - 1 - 1) and every[0] == every[1] == every[2] == every[3]  # one name twice, one blank
    assert {c for t, v, c in every[0] if t == "t"} >= {"V15", "V20", "V20Z", "S2", UNMATCHED, NOTHING}


def test_the_cosine_has_both_norms():
    m = Matcher(LIST)
    short, full = m.candidates("Stavrik Gate Valve DN20")[2], m.candidates("Stavrik Gate Valve DN20 Brass")[2]
    assert {c for _, c, _, ok in full if ok} == {"V20"} and {c for s, c, _, _ in short if s == 1.0} == {"V20", "V20Z"}
    m.COSINE = 0.999  # of an entry with a word that is not written it is below 1
    assert not any(ok for *_, ok in m.candidates("Stavrik Gate Valve DN20")[2]) and any(ok for *_, ok in m.candidates("Stavrik Gate Valve DN20 Brass")[2])
