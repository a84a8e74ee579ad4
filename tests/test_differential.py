"""The same results by other plans: correlated subqueries, a window, other partitionings."""

import random

import pytest
from orderloom.operators import report as R
from orderloom.operators import tfidf as X


def ledger(spark, seed=11):
    rng = random.Random(seed)
    day = lambda: f"2026-05-{rng.randrange(1, 7):02d}T{rng.randrange(24):02d}:00:00Z"
    lines = [(f"L{i}", f"T{i % 3}", f"C{rng.randrange(9)}", rng.choice(["mail", "chat"]), day(), "") for i in range(120)]
    events = [(i, lines[(k := rng.randrange(120))][1], lines[k][0], f"I{rng.randrange(15)}", "s", round(rng.random(), 4), None, rng.randrange(2), rng.randrange(-5, 400), lines[k][4]) for i in range(900)]
    items = [(f"T{t}", f"I{i}", "", "", int(i % 5 == 0)) for t in range(3) for i in range(15)]
    make = spark.createDataFrame
    return (
        make(lines, "line_id string, tenant_id string, customer_id string, channel string, created_at string, raw_text string"),
        make(events, "event_id long, tenant_id string, line_id string, item_code string, stage string, score double, rank int, accepted int, latency_ms int, created_at string"),
        make(items, "tenant_id string, item_code string, item_name string, item_group string, disabled int"),
    )


def rows(df):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in df.collect())


def test_report_against_correlated_subqueries(spark):
    lines, events, items = ledger(spark)
    for name, df in (("o", lines), ("m", events), ("it", items)):
        df.createOrReplaceTempView(name)
    slow = spark.sql("""
        WITH g AS (SELECT tenant_id, channel, substr(created_at, 1, 10) AS day, count(DISTINCT line_id) AS lines_total, count(DISTINCT customer_id) AS distinct_customers FROM o GROUP BY 1, 2, 3)
        SELECT tenant_id, channel, day, lines_total,
            (SELECT count(DISTINCT m.line_id) FROM m JOIN o ON o.line_id = m.line_id WHERE m.accepted = 1 AND m.tenant_id = g.tenant_id AND o.channel = g.channel AND substr(m.created_at, 1, 10) = g.day) AS lines_accepted,
            (SELECT count(*) FROM m JOIN o ON o.line_id = m.line_id WHERE m.tenant_id = g.tenant_id AND o.channel = g.channel AND substr(m.created_at, 1, 10) = g.day) AS candidates,
            (SELECT max(m.latency_ms) FROM m WHERE m.tenant_id = g.tenant_id AND substr(m.created_at, 1, 10) = g.day AND m.latency_ms >= 0) AS max_latency_ms,
            (SELECT count(*) FROM m JOIN it ON it.tenant_id = m.tenant_id AND it.item_code = m.item_code WHERE m.accepted = 1 AND it.disabled = 1 AND m.tenant_id = g.tenant_id AND substr(m.created_at, 1, 10) = g.day) AS accepted_disabled,
            distinct_customers FROM g""")
    fast = R.health_report(lines, events, items).selectExpr("tenant_id", "channel", "day", "lines_total", "lines_accepted", "candidates_considered", "cast(max_latency_ms AS int)", "accepted_disabled", "distinct_customers")
    assert rows(slow) == rows(fast)


def test_percentile_against_the_cumulative_window(spark):
    _, events, _ = ledger(spark)
    events.createOrReplaceTempView("m")
    window = spark.sql("""
        SELECT tenant_id, min(CASE WHEN f >= 0.95 THEN latency_ms END) AS p FROM
        (SELECT tenant_id, latency_ms, cume_dist() OVER (PARTITION BY tenant_id ORDER BY latency_ms) AS f FROM m WHERE latency_ms >= 0) GROUP BY 1""")
    assert rows(window) == rows(R.p95(events.where("latency_ms >= 0"), ["tenant_id"], "latency_ms", "p"))


def test_repeat_items_against_exists(spark):
    _, events, _ = ledger(spark)
    events = events.withColumn("day", R.day_of("created_at"))
    events.createOrReplaceTempView("m")
    slow = spark.sql("""
        SELECT tenant_id, day, count(*) AS n FROM (SELECT DISTINCT tenant_id, day, item_code FROM m) c
        WHERE EXISTS (SELECT 1 FROM m p WHERE p.tenant_id = c.tenant_id AND p.item_code = c.item_code AND p.day = date_format(date_sub(to_date(c.day), 1), 'yyyy-MM-dd')) GROUP BY 1, 2""")
    assert rows(slow) == rows(R.repeat_items(events))


@pytest.mark.parametrize("partitions", [1, 7])
def test_other_partitionings_give_the_same_rows(spark, partitions):
    lines, events, items = ledger(spark)
    docs = spark.createDataFrame([("t", f"d{i}", f"hex bolt m{i % 4} x {i % 3} steel") for i in range(30)], "tenant string, item_code string, text string")
    asked = spark.createDataFrame([("t", f"bolt m{i}") for i in range(4)], "tenant string, q string")
    want = rows(R.health_report(lines, events, items)), rows(X.top_k(asked, docs, X.char_grams, 5))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        again = [df.repartition(partitions) for df in (lines, events, items)]
        assert (rows(R.health_report(*again)), rows(X.top_k(asked, docs.repartition(3), X.char_grams, 5))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
