import math
import random

from orderloom.operators import ranker as R
from pyspark.sql import functions as F


def data(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        x, y = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((f"g{i % 12}", x, y, int(rng.random() < 1 / (1 + math.exp(-(2 * x - y - 1))))))
    return rows, spark.createDataFrame(rows, "grp string, x double, y double, label int")


def test_logistic_solves_the_balanced_penalised_problem(spark):
    rows, df = data(spark)
    w = [float(v) for v in R.fit_logistic(df, ["x", "y"]).coefficients]
    n1 = sum(r[3] for r in rows)
    weight = {1: len(rows) / (2 * n1), 0: len(rows) / (2 * (len(rows) - n1))}
    gradient = list(w)
    for _, x, y, k in rows:
        p = 1 / (1 + math.exp(-(w[0] * x + w[1] * y + w[2])))
        for i, v in enumerate((x, y, 1.0)):
            gradient[i] += weight[k] * (p - k) * v
    assert max(abs(g) for g in gradient) < 0.01


def test_out_of_fold_and_calibration(spark):
    _, df = data(spark)
    held = R.out_of_fold(df, ["x", "y"], "grp", count=3)
    assert held.count() == 400 and held.groupBy("grp").agg({"fold": "max"}).count() == 12
    model, calibration = R.fit_calibrated(df, ["x", "y"], "grp")
    out = R.predict(model, df, ["x", "y"], calibration).select("x", "probability").toPandas()
    assert out.probability.between(0, 1).all() and out.probability.nunique() > 3


def test_one_class_is_refused(spark):
    import pytest

    with pytest.raises(ValueError):
        R.fit_logistic(data(spark)[1].where("label = 1"), ["x", "y"])


def test_folds_are_fitted_together_in_few_jobs(spark):
    rows, df = data(spark)
    spark.sparkContext.setJobGroup("folds", "folds")
    held = R.out_of_fold(df, ["x", "y"], "grp", count=5).cache()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("folds")) < 40
    spark.sparkContext.setJobGroup("", "")
    # each model is the exact optimum over the rows outside its fold
    one = held.where("fold = 0").first()
    alone = R.fit_logistic(held.where("fold <> 0").select("x", "y", "label"), ["x", "y"])
    z = alone.coefficients[0] * one.x + alone.coefficients[1] * one.y + alone.coefficients[2]
    assert abs(one.probability - 1 / (1 + math.exp(-z))) < 1e-9


def test_only_lines_with_a_label_are_looked_up(spark, monkeypatch, tmp_path):
    from orderloom.plans import ranking

    line = "line_id string, tenant string, customer_id string"
    spark.createDataFrame([(f"L{i}", "t", f"c{i % 3}") for i in range(30)], line).write.parquet(f"{tmp_path}/order_lines_holdout.parquet")
    spark.createDataFrame([("L1", "A"), ("L2", "B")], "line_id string, item_code string").write.parquet(f"{tmp_path}/order_line_label.parquet")
    spark.createDataFrame([("t", "A")], "tenant string, item_code string").write.parquet(f"{tmp_path}/catalogue_item.parquet")
    spark.createDataFrame([("t", "A")], "tenant string, item_code string").write.parquet(f"{tmp_path}/customer_sku_map.parquet")
    asked = []

    def found(lines, items, aliases):
        asked.extend(sorted(r.line_id for r in lines.collect()))
        return lines

    monkeypatch.setattr(ranking, "catalogue", lambda items: items)
    monkeypatch.setattr(ranking.ev, "hybrid_candidates", found)
    monkeypatch.setattr(ranking.ev, "evidence", lambda found, lines, items: found)
    rows = lambda found: found.select("line_id", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("item_code"), *(F.lit(0.0).alias(c) for c in ranking.ev.FEATURES))
    monkeypatch.setattr(ranking.ev, "ranked", rows)
    got = {(r.line_id, r.item_code): r.label for r in ranking._training(spark, str(tmp_path)).collect()}
    assert asked == ["L1", "L2"] and got == {("L1", "A"): 1, ("L1", "B"): 0, ("L2", "A"): 0, ("L2", "B"): 1}
