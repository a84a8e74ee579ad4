"""Queries of the hybrid candidates, their evidence and the ranker (no SQL: fuzzy ratios and fitted models)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.operators import evidence as ev
from orderloom.operators import ranker
from orderloom.operators.lanes import catalogue
from orderloom.session import cut, table


def _evidence(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Ranked candidates of all lines, or of those in ``only``: a line's rows depend on no other line."""
    lines, items = table(spark, sf_dir, "order_lines_holdout").distinct(), catalogue(table(spark, sf_dir, "catalogue_item"))
    lines = cut(lines if only is None else lines.join(only, "line_id", "left_semi"), "lines")
    found = ev.hybrid_candidates(lines, items, table(spark, sf_dir, "customer_sku_map"))
    return ev.ranked(ev.evidence(found, lines, items))


def hybrid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("line_id", "item_code", "place", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"))


def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.prediction_rows(_evidence(spark, sf_dir))


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of labelled lines, 1 for the confirmed item; grouped by customer."""
    label = table(spark, sf_dir, "order_line_label").groupBy("line_id").agg(F.min("item_code").alias("truth"))
    lines = table(spark, sf_dir, "order_lines_holdout").select("line_id", F.concat_ws("|", "tenant", "customer_id").alias("group_key")).distinct()
    rows = _evidence(spark, sf_dir, label).join(label, "line_id").join(lines, "line_id")
    return cut(rows.select("line_id", "item_code", "group_key", *ev.FEATURES, (F.col("item_code") == F.col("truth")).cast("int").alias("label")), "training")


def lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities of every candidate of the labelled lines."""
    scored = ranker.out_of_fold(_training(spark, sf_dir), ev.FEATURES, "group_key", count=5)
    return scored.select("line_id", "item_code", F.round("probability", 6).alias("probability"), "label")


def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probabilities of the same candidates by the final ranker."""
    rows = _training(spark, sf_dir)
    model, calibration = ranker.fit_calibrated(rows, ev.FEATURES, "group_key")
    return ranker.predict(model, rows, ev.FEATURES, calibration).select("line_id", "item_code", F.round("probability", 6).alias("probability"), "label")


QUERIES = {f.__name__: f for f in (hybrid_candidates, prediction_rows, lr_scores, isotonic_calibration)}
