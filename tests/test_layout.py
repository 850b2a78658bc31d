"""Pairs of boxes against all pairs, ranks of series with far outliers, phrases inside others."""

import math
import random

from evidentia.operators.layout import overlaps
from evidentia.operators.phrases import count_phrases, slug_conflicts, validate_map
from evidentia.operators.series import nearest_rank


def test_overlaps_by_all_pairs(spark):
    draw = random.Random(5)
    boxes = [(k % 2, k, draw.uniform(-50, 50), draw.uniform(-50, 50), draw.choice((0.0, 1.0, 4.0, 90.0)), draw.choice((0.0, 2.0, 60.0))) for k in range(120)]
    boxes += [(2, 0, 1.0, 1.0, 0.0, 0.0), (2, 1, 1.0, 1.0, 0.0, 0.0), (2, 2, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "chart int, idx int, x double, y double, w double, h double")
    for gap in (0.0, 2.5):
        whole = [b for b in boxes if b[2] is not None]
        want = {
            (a[0], a[1], b[1]) for a in whole for b in whole
            if a[0] == b[0] and a[1] < b[1] and all(a[i] < b[i] + b[j] + gap and b[i] < a[i] + a[j] + gap for i, j in ((2, 4), (3, 5)))
        }
        got = overlaps(df, ["chart"], gap).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_overlaps_of_a_crowded_cell(spark, monkeypatch):
    from pyspark.sql import functions as F

    from evidentia.operators import layout

    boxes = spark.range(400).selectExpr("'c' as chart", "id as idx", "cast(id % 3 as double) as x", "cast(id % 5 as double) as y", "9d as w", "9d as h")
    want = {(i, j) for i in range(400) for j in range(i + 1, 400)}
    monkeypatch.setattr(layout, "SHARE", 32, raising=False)
    monkeypatch.setattr(layout, "TASK_PAIRS", 4000, raising=False)
    got = overlaps(boxes, ["chart"]).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == len(want) and {(r.i, r.j) for r in got} == want
    # One place of all boxes is no task's alone.
    tasks = [r.task for r in got]
    assert len(set(tasks)) > 20 and max(tasks.count(k) for k in set(tasks)) < len(tasks) / 5


def test_rank_beside_an_outlier(spark):
    values = spark.range(200_000).selectExpr("cast(id % 2 as int) as k", "case when id = 0 then 1e300 else cast((id * 7919) % 200003 as double) end as v")
    got = {r.k: r.rank_value for r in nearest_rank(values, ["k"], "v", 0.95).collect()}
    for k in (0, 1):
        own = sorted(1e300 if i == 0 else float(i * 7919 % 200003) for i in range(k, 200_000, 2))
        assert got[k] == own[math.ceil(0.95 * len(own)) - 1]


def test_phrases_in_their_own_case(spark):
    texts = spark.createDataFrame([("EV_01 and ev_02",), (None,), ("",)], "text string")
    entries = spark.createDataFrame([("Ann", "EV_01"), ("Ann Lee", "EV_02"), ("ann", "ev_3"), ("", "")], "phrase string, slug string")
    assert [r.slug for r in slug_conflicts(texts, entries).collect()] == ["EV_01"]
    assert {r.phrase: r.occurrences for r in count_phrases(texts, entries.selectExpr("slug as phrase")).collect()} == {"EV_01": 1, "EV_02": 1, "ev_3": 0, "": 0}
    assert [r.phrase for r in validate_map(entries).where("problem = 'inside another phrase'").collect()] == ["Ann"]
