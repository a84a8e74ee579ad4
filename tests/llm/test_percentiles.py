import math
import random

from orderloom.llm.percentiles import from_parts, multi_select, part_summary, weigh, wide
from pyspark.sql import functions as F

Q = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
SCHEMA = "tenant string, day string, v double, w long, g string, q double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "g", 0.1) for r in rows], SCHEMA)


def exact(rows):
    groups = {}
    for t, _, v in rows:
        if v is not None and not math.isnan(v) and v >= 0:
            groups.setdefault(t, []).append(v)
    return {t: tuple(sorted(vs)[max(1, math.ceil(p * len(vs))) - 1] for p in Q.values()) for t, vs in groups.items()}


def sample():
    rng = random.Random(2)
    rows = [("hot", f"d{i % 5}", rng.paretovariate(0.7) * 10) for i in range(5000)]
    rows += [(rng.choice(["a", "b", None]), "d1", float(rng.randrange(40))) for _ in range(700)]
    return rows + [("c", "d", 7.0), ("c", "d", None), ("c", "d", -1.0), ("e", "d", None), ("e", "d", float("nan")), ("f", "d", 0.0)]


def test_multi_select_is_exact_whether_it_pivots_or_finishes(spark):
    rows = sample()
    for finish in (1, 64, 100000):
        got = wide(multi_select(weigh(frame(spark, rows), "tenant", "v"), list(Q.values()), finish=finish), "tenant", Q)
        assert {r.tenant: (r.p50, r.p95, r.p99) for r in got.collect()} == exact(rows)


def test_parts_join_within_the_stated_error(spark):
    rows = sample()
    df = frame(spark, rows)
    parts = part_summary(df, "tenant", F.col("day"), "v", 0.005)
    one, two = parts.where("part <= 'd2'"), parts.where("part > 'd2'")
    for summary in (parts, one.unionByName(two)):
        got = {r.tenant: (r.p50, r.p95, r.p99) for r in from_parts(summary, "tenant", Q, 0.005).collect()}
        want = exact(rows)
        assert got.keys() == want.keys()
        for t in want:
            for a, b in zip(got[t], want[t], strict=True):
                assert abs(a - b) <= 0.005 * b + 1e-9


def test_empty(spark):
    df = frame(spark, [])
    assert wide(multi_select(weigh(df, "tenant", "v"), list(Q.values())), "tenant", Q).count() == 0
    assert from_parts(part_summary(df, "tenant", F.col("day"), "v"), "tenant", Q).count() == 0


def test_infinite_values_count(spark):
    rows = [("t", "d", 1.0), *[("t", "d", math.inf)] * 3, ("u", "d", math.inf), ("v", "d", 2.0)]
    got = wide(multi_select(weigh(frame(spark, rows), "tenant", "v"), list(Q.values())), "tenant", Q)
    assert {r.tenant: (r.p50, r.p99) for r in got.collect()} == {"t": (math.inf, math.inf), "u": (math.inf, math.inf), "v": (2.0, 2.0)}
    parts = from_parts(part_summary(frame(spark, rows), "tenant", F.col("day"), "v"), "tenant", Q).collect()
    assert {r.tenant: (r.p50 if math.isinf(r.p50) else round(r.p50, 1), r.n) for r in parts} == {"t": (math.inf, 4), "u": (math.inf, 1), "v": (2.0, 1)}


def test_every_answer_comes_from_pivots(spark, monkeypatch):
    from orderloom.llm import percentiles as P

    rounds, inner = [], P._pivots
    monkeypatch.setattr(P, "_pivots", lambda possible: rounds.append(1) or inner(possible))
    rows = [("t", "d", float(i)) for i in range(40)] + [("u", "d", 5.0)]
    got = wide(multi_select(weigh(frame(spark, rows), "tenant", "v"), list(Q.values())), "tenant", Q)
    assert {r.tenant: (r.p50, r.p95, r.p99) for r in got.collect()} == exact(rows)
    assert 2 <= len(rounds) <= 12
