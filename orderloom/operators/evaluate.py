"""Measures of ranked decisions: recall, precision, thresholds, bins, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The grid of limits that is swept.
CONFIDENCES = [0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.925, 0.95, 0.96, 0.97, 0.98, 0.985, 0.99, 0.995, 1.0]
MARGINS = [0.0, 0.02, 0.05, 0.08, 0.1, 0.15, 0.2]
#: Lower edges of the calibration bins; each is half open, the last takes 1.
BINS = [0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 0.98]


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def wilson_lower(hits: Column, total: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval; 0 for no trials."""
    n = total.cast("double")
    p = hits / n
    value = (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    return F.when(total > 0, value).otherwise(0.0)


def ranked_margin(candidates: DataFrame, group: str, score: str, item: str) -> DataFrame:
    """Adds place (by score, then item) and margin: the first place's lead over the second, 0 elsewhere.

    With one candidate the lead is its whole score.
    """
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(item))
    after = F.coalesce(F.lead(score).over(w), F.lit(0.0))
    place = F.row_number().over(w)
    return candidates.withColumn("place", place).withColumn("margin", F.when(F.col("place") == 1, F.col(score) - after).otherwise(0.0))


def top_two(candidates: DataFrame, group: str, score: str, item: str, *more: str) -> DataFrame:
    """(group, item, score, margin, more...) of each group's first place.

    Tasks keep two rows of a group before the shuffle (window group limit), so a
    huge group is never gathered.
    """
    w = Window.partitionBy(group).orderBy(F.desc(score), F.asc(item))
    two = candidates.withColumn("_place", F.row_number().over(w)).where("_place <= 2")
    first = F.max(F.when(F.col("_place") == 1, F.struct(item, score, *more))).alias("f")
    second = F.max(F.when(F.col("_place") == 2, F.col(score))).alias("s")
    out = two.groupBy(group).agg(first, second)
    return out.select(group, *(F.col(f"f.{c}").alias(c) for c in (item, score, *more)), (F.col(f"f.{score}") - F.coalesce("s", F.lit(0.0))).alias("margin"))


def sweep(decisions: DataFrame, confidences: list[float] | None = None, margins: list[float] | None = None) -> DataFrame:
    """One row per pair of limits: how many decisions pass both, how many of those are right.

    decisions: confidence, margin, correct (boolean). Each decision is counted in
    the cell of the highest limits it passes; a cell (there are at most as many as
    pairs) then counts for every pair below it, so decisions are read once.
    """
    spark = decisions.sparkSession
    cs, ms = confidences or CONFIDENCES, margins or MARGINS
    cell = lambda c, edges: F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: F.col(c) >= e))
    cells = decisions.groupBy(cell("confidence", cs).alias("ci"), cell("margin", ms).alias("mi")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("right"))
    steps = lambda c: F.explode(F.sequence(F.lit(1), F.col(c)))
    passed = cells.where("ci > 0 AND mi > 0").select("n", "right", "mi", steps("ci").alias("gi")).select("n", "right", "gi", steps("mi").alias("gj"))
    sums = passed.groupBy("gi", "gj").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    grid = spark.createDataFrame([(i + 1, j + 1, c, m) for i, c in enumerate(cs) for j, m in enumerate(ms)], "gi int, gj int, confidence_limit double, margin_limit double")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    out = grid.join(sums, ["gi", "gj"], "left").select("confidence_limit", "margin_limit", zero("n", "passed"), zero("right", "correct"))
    return out.withColumn("precision", safe_divide(F.col("correct"), F.col("passed")))


def best_point(points: DataFrame, minimum_precision: float) -> DataFrame:
    """The pair of limits to use: of those precise enough the one that passes most, else the most precise.

    Ties go to the higher confidence limit, then to the lower margin limit.
    """
    enough = F.col("precision") >= minimum_precision
    return points.orderBy(F.desc(enough), F.desc(F.when(enough, F.col("passed")).otherwise(0)), F.desc("precision"), F.desc("passed"), F.desc("confidence_limit"), F.asc("margin_limit")).limit(1)


def gates(metrics: DataFrame, minima: dict[str, float], maxima: dict[str, float]) -> DataFrame:
    """(check, key, detail) of measures that fall below a least value or rise above a greatest one.

    metrics: one row with a column per measure. A measure that is missing or
    null fails its gate; an empty result passes.
    """
    have = set(metrics.columns)
    tests = []
    for name, limits, below in (("below_minimum", minima, True), ("above_maximum", maxima, False)):
        for column, limit in limits.items():
            v = F.col(column).cast("double") if column in have else F.lit(None).cast("double")
            fails = v.isNull() | ((v < limit) if below else (v > limit))
            tests.append(F.when(fails, F.struct(F.lit(name).alias("check"), F.lit(column).alias("key"), F.coalesce(v.cast("string"), F.lit("missing")).alias("detail"))))
    return metrics.select(F.inline(F.filter(F.array(*tests), lambda t: t.isNotNull())))


def chart_points(points: DataFrame, x: str, y: str, highest: bool = True) -> DataFrame:
    """One point per x: the highest y of it, or the lowest."""
    return points.groupBy(x).agg((F.max(y) if highest else F.min(y)).alias(y))


def calibration(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """(low, high, n, mean_confidence, share_correct) per bin of confidence; empty bins have zeros.

    scored: confidence from 0 to 1 and correct (0 or 1). Means are of
    ten-thousandths, so they don't depend on the order of rows.
    """
    edges = [*BINS, 1.0]
    bins = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    at = F.size(F.filter(F.array(*(F.lit(e) for e in BINS)), lambda e: F.col("confidence") >= e)) - 1
    sums = scored.where(F.col("confidence").between(0, 1)).groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("confidence") * 10000).cast("long")).alias("c"), F.sum(F.col("correct").cast("long")).alias("k")
    )
    zero = F.lit(0.0)
    return bins.join(sums, "bin", "left").select(
        "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(F.col("c") / F.col("n") / 10000, zero).alias("mean_confidence"), F.coalesce(F.col("k") / F.col("n"), zero).alias("share_correct")
    )


def draws(spark: SparkSession, size: int, samples: int, seed: int) -> DataFrame:
    """(s, slot): size slots of 0 to size - 1 drawn with replacement for each sample s, by hash."""
    every = spark.range(samples).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, size - 1)).cast("long"))).alias("d"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("s").cast("string"), F.col("d").cast("string")))
    return every.select("s", (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % max(1, size)).alias("slot"))


def bootstrap(groups: DataFrame, samples: int = 2000, seed: int = 1729) -> DataFrame:
    """95 % interval of hits / total when whole groups are drawn again with replacement.

    groups: slot (0, 1, ... without gaps), hits, total; one row per group. Sample
    s draws as many groups as there are, its draw d being the slot that the first
    15 hex digits of md5('seed|s|d') give modulo the number of groups: any engine
    computes the same. Draws are made per slot, so the work is samples x groups,
    not samples x rows.
    """
    spark = groups.sparkSession
    size = groups.count()
    per = draws(spark, size, samples, seed).join(groups, "slot").groupBy("s").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"))
    rate = per.select(safe_divide(F.col("hits"), F.col("total")).alias("r"))
    w = Window.orderBy("r")
    ranked = rate.withColumn("k", F.row_number().over(w) - 1)  # samples rows, a parameter
    lo, hi = int(0.025 * (samples - 1)), int(0.975 * (samples - 1))
    return ranked.agg(F.max(F.when(F.col("k") == lo, F.col("r"))).alias("low"), F.max(F.when(F.col("k") == hi, F.col("r"))).alias("high"))


def folds(rows: DataFrame, group: str, count: int = 5) -> DataFrame:
    """(group, n, fold): whole groups dealt to folds by size, the largest first, each to the lightest so far.

    There is one row per group; ties by name. Dealing is sequential, so it runs
    over the group sizes (not the rows) in one task.
    """
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))

    def deal(batches):
        import pandas as pd

        every = pd.concat(list(batches), ignore_index=True)
        every = every.sort_values(["n", group], ascending=[False, True], kind="stable")
        load, out = [0] * count, []
        for n in every["n"]:
            k = min(range(count), key=load.__getitem__)
            load[k] += n
            out.append(k)
        yield every.assign(fold=out)

    kind = rows.schema[group].dataType.simpleString()
    return sizes.coalesce(1).mapInPandas(deal, f"{group} {kind}, n long, fold int")
