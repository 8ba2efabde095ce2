"""Plans that hold up on larger tables."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlpit.functions import register
from marlpit.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_theta_join_gives_all_tasks_work(spark, sf_dir):
    rows = catalogue.QUERIES["join_theta_range"](spark, sf_dir)
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(counts) > 4 and max(counts) < sum(counts) / 2


def test_window_aggregate_runs_on_batches_of_frames(spark, sf_dir):
    steps = plan(catalogue.QUERIES["win_user_aggregate"](spark, sf_dir))
    assert "WindowPython" not in steps and "WindowInPandas" not in steps
    f = register.frame_aggregate(spark, "t_total", lambda values, starts: np.add.reduceat(values, starts), "double")
    rows = spark.createDataFrame([(1, 1, None), (1, 2, 2.0), (1, 3, 3.0), (2, 1, 5.0), (3, 1, None), (3, 2, None)], "k int, i int, x double")
    w = Window.partitionBy("k").orderBy("i").rowsBetween(-1, 0)
    found = rows.select("k", "i", f("x", w).alias("s")).collect()
    assert {(r.k, r.i): r.s for r in found} == {(1, 1): None, (1, 2): 2.0, (1, 3): 5.0, (2, 1): 5.0, (3, 1): None, (3, 2): None}
    assert rows.where("k > 3").select(f("x", w)).collect() == []


def test_json_changes_share_a_worker(spark, sf_dir):
    assert plan(catalogue.QUERIES["json_set"](spark, sf_dir)).count("ArrowEvalPython") == 1
