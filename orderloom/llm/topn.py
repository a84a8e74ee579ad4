"""The N best items of every group, by descending score bands.

Rows are cut into bands of score whose edges come from the score's own
distribution, and written once, partitioned by band. Bands are processed from
the top: a band's rows are combined with what unfilled groups have so far, groups
that are already filled are removed by an anti-join, and groups that now have N
items are finished by an exact ranking. Equal scores always lie in one band, so nothing below an edge can come
before anything above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.session import cut

#: The first band ends at one of these shares of the rows, from the top; each further one has as many rows as all before it.
SHARES = [2.0 ** (-k / 4) for k in range(80, 0, -1)]


def band_edges(scored: DataFrame, n: int, low: float = 0.0) -> list[float]:
    """Lower edges of the bands, from the top; the last is ``low``.

    The first band holds at least twice the rows that N per group need, each
    further one as many as all before it, so there are only a few bands however
    large the groups are. One pass, one row of bounded size to the driver.
    Numbers are approximate, which moves edges and no results.
    """
    found = scored.agg(
        F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("group_id", 0.05).alias("groups"), F.percentile_approx("score", [1 - x for x in SHARES], 100_000).alias("at")
    ).first()
    if not found["rows"]:
        return [low]
    target = 2.0 * n * (found["groups"] or 1) / found["rows"]
    enough = [e for x, e in zip(SHARES, found["at"], strict=True) if x >= target]
    edges = [e for e in enough[::4] if e > low]
    return sorted(set(edges), reverse=True) + [low]


def _rank(best: DataFrame, n: int) -> DataFrame:
    """Adds place and keeps places up to n.

    Spark keeps n rows of a group in each task before the shuffle (window group
    limit), so a huge group reaches its task as n rows per task, not as all.
    """
    w = Window.partitionBy("group_id").orderBy(F.desc("score"), F.asc_nulls_last("rank"), F.asc("item"))
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def top_n(rows: DataFrame, group: str, item: str, score: str, rank: str, n: int = 3, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(group, item, place): the n best items of each group.

    An item stands for its best row: highest score, then lowest rank, null last.
    Places follow score descending, rank ascending with null last, item
    ascending; all three together are a total order, so ties don't depend on the
    order of rows. Rows whose score is null, NaN or outside [low, high], or whose
    group or item is null, don't count; a group without any other row is absent,
    one with fewer than n items gives what it has. Further columns are ignored.
    """
    scored = rows.select(
        F.col(group).alias("group_id"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"), F.col(rank).cast("int").alias("rank")
    ).where(F.col("score").between(low, high) & ~F.isnan("score") & F.col("group_id").isNotNull() & F.col("item").isNotNull())
    edges = band_edges(scored, n, low)
    if len(edges) > 1:
        band_of = F.lit(len(edges) - 1)
        for k in range(len(edges) - 2, -1, -1):
            band_of = F.when(F.col("score") >= edges[k], k).otherwise(band_of)
        scored = cut(scored.withColumn("band", band_of), "bands", ["band"])

    finished: list[DataFrame] = []
    filled = carried = None
    for k in range(len(edges)):
        band = scored.where(F.col("band") == k).drop("band") if len(edges) > 1 else scored
        if carried is not None:
            band = band.unionByName(carried)
        # the best row of an item first: a map-side combine on (group, item) that splits a huge group;
        # then n rows per group and task, so that what meets the filled groups is small however large the group
        key = F.struct("score", F.coalesce(-F.col("rank").cast("long"), F.lit(-(2**40))).alias("low_rank"))
        best = band.groupBy("group_id", "item").agg(F.max(key).alias("b")).select(
            "group_id", "item", "b.score", F.when(F.col("b.low_rank") > -(2**40), -F.col("b.low_rank")).cast("int").alias("rank")
        )
        top = _rank(best, n)
        if filled is not None:
            top = top.join(filled, "group_id", "left_anti")
        if k == len(edges) - 1:
            finished.append(top)
            break
        size = F.count(F.lit(1)).over(Window.partitionBy("group_id"))
        top = cut(top.withColumn("full", size >= n), f"band{k}")
        finished.append(top.where("full"))
        done = top.where("full AND place = 1").select("group_id")
        filled = done if filled is None else filled.unionByName(done)
        carried = top.where("NOT full").select("group_id", "item", "score", "rank")
    out = finished[0].select("group_id", "item", "place")
    for part in finished[1:]:
        out = out.unionByName(part.select("group_id", "item", "place"))
    return out.select(F.col("group_id").alias(group), F.col("item").alias(item), F.col("place").cast("int").alias("place"))
