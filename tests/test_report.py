from orderloom.operators import report as R

LINE = "line_id string, tenant_id string, customer_id string, channel string, created_at string, raw_text string"
EVENT = "event_id long, tenant_id string, line_id string, item_code string, stage string, score double, rank int, accepted int, latency_ms int, created_at string"
ITEM = "tenant_id string, item_code string, item_name string, item_group string, disabled int"


def frames(spark, lines, events, items):
    return spark.createDataFrame(lines, LINE), spark.createDataFrame(events, EVENT), spark.createDataFrame(items, ITEM)


def ledger():
    """Two tenants and one without name over four days; a line without events; twenty latencies of which the 19th and 20th are equal."""
    lines = [(f"harbour-{i}", "kelpworks", f"buyer{i % 3}", "portal" if i % 2 else "fax", f"2031-11-{8 + i // 5:02d}T0{i % 5}:30:00Z", None) for i in range(10)]
    lines += [("quiet", "kelpworks", "buyer9", "fax", "2031-11-09T23:59:59Z", "no event names it"), ("nameless", None, None, None, "2031-11-09T12:00:00Z", "")]
    lines += [("solo", "mosswell", "m1", "portal", "2031-11-10T00:00:00Z", "x")]
    events = [(i, "kelpworks", f"harbour-{i % 5}", f"K{i % 4}", "word", (i % 10) / 10, i, int(i % 5 == 0), 700 if i >= 18 else 3 * i, "2031-11-08T05:00:00Z") for i in range(20)]
    events += [(100 + i, "kelpworks", f"harbour-{5 + i % 5}", f"K{2 + i % 3}", "char", 0.25, 1, int(i == 2), None if i == 4 else 11, "2031-11-09T06:00:00Z") for i in range(5)]
    events += [(200, None, "nameless", "K0", "word", 0.5, 1, 1, 9, "2031-11-09T12:00:00Z"), (201, "mosswell", "solo", "K9", "word", 1.0, 1, 1, 0, "2031-11-10T01:00:00Z"), (202, "mosswell", "unreported", "K9", "word", 1.0, 1, 1, 5000, "2031-11-10T01:00:00Z")]
    items = [("kelpworks", "K0", "", "", 1), ("kelpworks", "K4", "", "", 1), ("mosswell", "K0", "", "", 1), ("mosswell", "K9", "", "", 0)]
    return lines, events, items


def by_hand(lines, events, items):
    """The same measures by plain loops."""
    lines = {x[0]: x for x in lines}
    events = list({x[0]: x for x in events}.values())
    off = {(t, i) for t, i, _, _, d in items if d == 1}
    day = lambda x: x[-1][:10]
    out = {}
    for tenant, channel, on in {(x[1], x[3], x[4][:10]) for x in lines.values()}:
        own = [x for x in lines.values() if (x[1], x[3], x[4][:10]) == (tenant, channel, on)]
        of_day = [e for e in events if tenant and (e[1], day(e)) == (tenant, on) and e[2] in lines]  # no tenant equals no other
        here = [e for e in of_day if lines[e[2]][3] == channel]
        lat, scores = sorted(e[8] for e in of_day if e[8] is not None and e[8] >= 0), [e[5] for e in of_day if e[7] == 1]
        today, before = ({e[3] for e in events if tenant and (e[1], day(e)) == (tenant, d)} for d in (on, f"2031-11-{int(on[8:]) - 1:02d}"))
        out[tenant, channel, on] = (
            len(own), len({e[2] for e in here if e[7] == 1}), len(here), round(sum(scores) / len(scores), 6) if scores else None, lat[-1] if lat else None, lat[-(-95 * len(lat) // 100) - 1] if lat else None,
            round(sum(lat) / len(lat), 6) if lat else None, len({x[2] for x in own if x[2]}), len(today & before), sum(e[7] == 1 and (e[1], e[3]) in off for e in of_day),
        )
    return out


def test_the_report_against_plain_loops(spark):
    lines, events, items = ledger()
    places = lambda v: None if v is None else round(v, 6)
    got = {
        (r.tenant_id, r.channel, r.day): (
            r.lines_total, r.lines_accepted, r.candidates_considered, places(r.avg_accept_score), r.max_latency_ms, r.p95_latency_ms, places(r.avg_latency_ms), r.distinct_customers, r.repeat_items_prev_day, r.accepted_disabled
        )
        for r in R.health_report(*frames(spark, lines + lines[3:5], events + events[7:9], items)).collect()
    }
    want = by_hand(lines, events, items)
    assert got == want
    first = want["kelpworks", "fax", "2031-11-08"]
    assert first[5] == 700 and first[9] == 1 and want["kelpworks", "fax", "2031-11-09"][8] == 2 and want[None, None, "2031-11-09"][:3] == (1, 0, 0)


def test_the_window_of_the_report_still_sees_the_day_before_it(spark):
    got = R.health_report(*frames(spark, *ledger()), "2031-11-09", "2031-11-09").collect()
    assert {r.day for r in got} == {"2031-11-09"} and {r.repeat_items_prev_day for r in got if r.tenant_id} == {2}


def test_impossible_days_and_empty_tables(spark):
    lines = [("X", "T", "C", "c", "2026-04-31T00:00:00Z", None), ("Y", None, None, None, None, None)]
    events = [(1, "T", "X", "A", "s", float("nan"), None, 1, -5, "2026-04-31T00:00:00Z"), (2, None, None, None, None, None, None, None, None, None)]
    got = {r.tenant_id: r for r in R.health_report(*frames(spark, lines, events, [])).collect()}
    assert got["T"].avg_accept_score is None and got["T"].max_latency_ms is None and got["T"].lines_accepted == 1 and got[None].lines_total == 1
    assert R.health_report(*frames(spark, [], [], [])).count() == 0


def test_p95_is_nearest_rank(spark):
    for n in (1, 7, 20, 41, 100):
        df = spark.createDataFrame([("g", i) for i in range(1, n + 1)], "g string, v int")
        assert R.p95(df, ["g"], "v", "p").first().p == max(1, -(-95 * n // 100))
