import math
import random

from orderloom.llm.topn import band_edges, top_n
from pyspark.sql import functions as F

SCHEMA = "line_id string, item_code string, score double, rank int, place int, group_id string, b string"


def brute(rows, n=3):
    best = {}
    for line, item, score, rank in rows:
        if line is None or item is None or score is None or math.isnan(score) or not 0 <= score <= 1:
            continue
        key = (-score, rank is None, rank or 0)
        if (line, item) not in best or key < best[line, item]:
            best[line, item] = key
    out = set()
    for line in {k[0] for k in best}:
        order = sorted((v, i) for (g, i), v in best.items() if g == line)
        out |= {(line, i, p) for p, (_, i) in enumerate(order[:n], 1)}
    return out


def run(spark, rows, n=3):
    df = spark.createDataFrame([(*r, 9, "g", "b") for r in rows], SCHEMA)
    return {tuple(r) for r in top_n(df, "line_id", "item_code", "score", "rank", n).collect()}


def test_against_brute_force_with_a_huge_line_ties_and_odd_scores(spark):
    rng = random.Random(1)
    score = lambda: rng.choice([None, float("nan"), -0.1, 1.2, 0.0, 1.0, *[round(rng.random(), 2) for _ in range(12)]])
    rows = [("huge", f"i{rng.randrange(300)}", score(), rng.choice([None, *range(5)])) for _ in range(4000)]
    rows += [(f"l{rng.randrange(300)}", f"i{rng.randrange(20)}", score(), rng.choice([None, *range(5)])) for _ in range(2500)]
    rows += [(None, "x", 0.5, 1), ("l1", None, 0.5, 1)] + rows[:100]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, 1) == brute(rows, 1)
    assert run(spark, rows, 50) == brute(rows, 50)


def test_several_bands_are_used(spark):
    df = spark.range(20000).select(F.lit("g").alias("group_id"), (F.col("id") / 20000).alias("score"))
    edges = band_edges(df, 3)
    assert len(edges) > 3 and edges == sorted(edges, reverse=True) and edges[-1] == 0.0
    rows = [(f"g{i % 4}", f"i{i}", i / 4000, None) for i in range(4000)]
    assert run(spark, rows) == brute(rows)


def test_all_ties_and_empty(spark):
    rows = [("g", f"i{i}", 0.5, None) for i in range(30)]
    assert run(spark, rows) == {("g", "i0", 1), ("g", "i1", 2), ("g", "i10", 3)}
    assert run(spark, []) == set()
    assert run(spark, [("g", "i", None, 1)]) == set()


def test_groups_of_a_few_rows_have_two_bands(spark):
    # ten rows a group, three wanted: twice what is needed is 0.6 of the rows
    df = spark.range(20000).select((F.col("id") % 2000).alias("group_id"), (F.col("id") / 20000).alias("score"))
    edges = band_edges(df, 3)
    assert len(edges) == 2 and 0.3 < edges[0] < 0.45
