"""Percentiles per group over very large columns: exact by distributed multi-select,
and bounded in error from parts that can be joined.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.session import cut

#: A multi-select state of at most this many rows may be held by the driver and broadcast (some 100 bytes each).
BROADCAST_STATES = 20_000
#: Fewer values than these are not rewritten when half are ruled out: a pass over them costs less than the write.
REWRITE = 500_000


def weigh(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group_id, v, w): each distinct measurement and how often it occurs.

    Folds copies before anything is shuffled and splits a hot group by value.
    Null, NaN and negative values are no measurements; null is a group.
    """
    v = F.col(value).cast("double")
    return rows.select(F.col(group).alias("group_id"), v.alias("v")).where((v >= 0) & ~F.isnan(v)).groupBy("group_id", "v").agg(F.count(F.lit(1)).alias("w"))


def multi_select(weighted: DataFrame, quantiles: list[float], finish: int = 1, max_rounds: int = 200) -> DataFrame:
    """(group_id, q, v): the exact nearest-rank quantiles of each group.

    Each round every partition proposes the weighted median of the values that
    are still possible for a (group, quantile); the weighted median of the
    proposals is the pivot; weights below, at and above it are counted; the range
    that can't hold the wanted rank is discarded; and so on until each is found.
    A pivot discards a quarter of the possible weight or more, so rounds grow
    with the logarithm of the weight alone. A round is one pass over the values
    that are left, which are rewritten whenever half of many are ruled out. With
    ``finish`` above 1, one running sum ends the search as soon as no (group,
    quantile) has more distinct values left. Infinity is a value like any other.
    """
    if not quantiles:
        raise ValueError("no quantiles")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    values = cut(weighted.select(F.col("group_id").alias("g"), "v", "w"), "weights")
    totals = values.groupBy("g").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("left"))
    q = F.explode(F.array(*(F.lit(float(x)) for x in quantiles))).alias("q")
    none = F.lit(None).cast("double")  # no bound
    states = totals.select(F.col("g").alias("sg"), "n", "left", q).select(
        "sg", "q", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("long").alias("k"), none.alias("lo"), none.alias("hi"), "left"
    )
    states = cut(states, "states")
    count, most, total = states.agg(F.count(F.lit(1)), F.max("left"), F.sum("left")).first()
    small = count <= BROADCAST_STATES  # rounds only ever settle states
    spark = values.sparkSession

    def kept(df: DataFrame, label: str) -> DataFrame:
        """A table of one row per state, on the driver where there are few, else in the shared folder."""
        if not small:
            return cut(df, label)
        table = df.toArrow()
        return F.broadcast(spark.createDataFrame(table, df.schema)) if table.num_rows else df.limit(0)

    if small:
        states = kept(states, "states")
    within = same("g", "sg") & (F.col("lo").isNull() | (F.col("v") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") < F.col("hi")))
    # the columns of a round are made once: they name columns only
    below, at, above = F.col("v") < F.col("p"), F.col("v") == F.col("p"), F.col("v") > F.col("p")
    counts = [F.sum(F.when(c, F.col("w")).otherwise(0)).alias(n) for c, n in ((below, "below"), (at, "at"))] + [F.count(F.when(c, 1)).alias(n) for c, n in ((below, "lower"), (above, "upper"))]
    left_of = F.col("k") <= F.col("below")
    found = ~left_of & (F.col("k") <= F.col("below") + F.col("at"))
    judged = [F.col("*"), found.alias("found"), left_of.alias("left_of"), F.when(left_of, F.col("lower")).otherwise(F.col("upper")).alias("left")]
    answer = [F.col("sg").alias("group_id"), F.col("q"), F.col("p").alias("v")]
    narrowed = [
        F.col("sg"), F.col("q"), F.when(F.col("left_of"), F.col("k")).otherwise(F.col("k") - F.col("below") - F.col("at")).alias("k"),
        F.when(F.col("left_of"), F.col("lo")).otherwise(F.col("p")).alias("lo"), F.when(F.col("left_of"), F.col("p")).otherwise(F.col("hi")).alias("hi"), F.col("left"),
    ]
    remaining = [F.count(F.lit(1)), F.max("left"), F.sum("left")]
    meets = same("sg", "pg") & (F.col("q") == F.col("pq"))
    columns = ["sg", "q", "k", "lo", "hi", "v", "w"]
    live, answers, held = values, [], total
    for _ in range(max_rounds):
        if not count:
            break
        possible = live.join(states, within).select(*columns)
        if 1 < most <= finish:
            w = Window.partitionBy("sg", "q").orderBy("v")
            run = possible.withColumn("run", F.sum("w").over(w))
            answers.append(run.where((F.col("run") >= F.col("k")) & (F.col("run") - F.col("w") < F.col("k"))).select(F.col("sg").alias("group_id"), "q", "v"))
            break
        if total <= held // 2 and held >= REWRITE:
            live, held = cut(live.join(states, within, "left_semi"), "live"), total
            possible = live.join(states, within).select(*columns)
        pivot = _pivots(possible)
        if small:
            pivot = kept(pivot, "pivots")
        counted = kept(possible.join(pivot, meets).groupBy("sg", "q", "k", "lo", "hi", "p").agg(*counts).select(*judged), "counted")
        answers.append(counted.where("found").select(*answer))
        states = counted.where("NOT found").select(*narrowed)
        count, most, total = states.agg(*remaining).first()
        if small:
            states = F.broadcast(states)
    else:
        raise RuntimeError(f"multi-select did not end in {max_rounds} rounds")
    if not answers:
        return values.select(F.col("g").alias("group_id"), F.lit(0.0).alias("q"), "v").limit(0)
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted median and weight of each (sg, q) within each batch of a partition (columns sg, q, v, w)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, kinds = pd.factorize(batch.column(0).to_pandas(), use_na_sentinel=False)[0], pd.factorize(batch.column(1).to_numpy())[0]
        key = groups.astype(np.int64) * (kinds.max() + 1) + kinds
        order = np.lexsort((batch.column(2).to_numpy(), key))
        run = np.cumsum(batch.column(3).to_numpy()[order])
        last = np.flatnonzero(np.append(np.diff(key[order]) != 0, True))
        before = np.append(0, run[last[:-1]])
        weight = run[last] - before
        # the first value at which the running weight reaches half of its group's
        middle = order[np.searchsorted(run, before + (weight + 1) // 2)]
        at = pa.array(middle)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(weight)], names=["sg", "q", "v", "w"])


def _pivots(possible: DataFrame) -> DataFrame:
    """(pg, pq, p): the weighted median of the medians that partitions propose.

    Proposals are made where the values lie, so only they are shuffled: one per
    (group, quantile) and batch.
    """
    rows = possible.select("sg", "q", "v", "w")
    proposed = rows.mapInArrow(_propose, rows.schema)
    w = Window.partitionBy("sg", "q").orderBy("v", "w").rowsBetween(Window.unboundedPreceding, 0)
    ranked = proposed.withColumn("run", F.sum("w").over(w)).withColumn("all", F.sum("w").over(Window.partitionBy("sg", "q")))
    return ranked.where(F.col("run") * 2 >= F.col("all")).groupBy(F.col("sg").alias("pg"), F.col("q").alias("pq")).agg(F.min("v").alias("p"))


def wide(selected: DataFrame, group: str, quantiles: dict[str, float], kind: str = "double") -> DataFrame:
    """One row per group, a column per quantile."""
    picks = [F.max(F.when(F.col("q") == v, F.col("v"))).cast(kind).alias(name) for name, v in quantiles.items()]
    return selected.groupBy("group_id").agg(*picks).withColumnRenamed("group_id", group)


def _bucket(v: Column, error: float) -> Column:
    """Index of the logarithmic bucket of a value; 0 and infinity have buckets of their own."""
    gamma = (1 + error) / (1 - error)
    return F.when(v == math.inf, F.lit(2**31 - 1)).when(v > 0, F.ceil(F.log(v) / math.log(gamma)).cast("int")).otherwise(F.lit(-(2**31)))


def part_summary(rows: DataFrame, group: str, part: Column, value: str, error: float = 0.005) -> DataFrame:
    """(group, part, bucket, n): a summary of each part that can be joined to others by adding n.

    Buckets grow by (1 + error) / (1 - error), so a quantile read from any sum of
    summaries differs from the exact one by at most ``error`` of its value; for
    values from 1e-3 to 1e12 a summary has at most some 3,500 rows however many
    values it stands for.
    """
    v = F.col(value).cast("double")
    real = rows.where((v >= 0) & ~F.isnan(v))
    return real.groupBy(F.col(group), part.alias("part"), _bucket(v, error).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def from_parts(summary: DataFrame, group: str, quantiles: dict[str, float], error: float = 0.005) -> DataFrame:
    """Quantiles of the joined parts of a summary, within ``error`` of the exact values."""
    gamma = (1 + error) / (1 - error)
    joined = summary.groupBy(group, "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(group)
    run = joined.withColumn("run", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    middle = F.when(F.col("bucket") == -(2**31), 0.0).when(F.col("bucket") == 2**31 - 1, math.inf).otherwise(2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1))
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("all")))
    picks = [F.min(F.when(F.col("run") >= rank(q), F.struct("bucket", middle.alias("m")))).getField("m").alias(name) for name, q in quantiles.items()]
    return run.groupBy(group).agg(F.max("all").alias("n"), *picks)
