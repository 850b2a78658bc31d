import re

from evidentia.plans.charts import bar_chart, line_chart


def test_bars_stack_to_the_frame(spark):
    rows = [(1, 0, 0, "a <b>", 30.0), (1, 0, 1, "a <b>", 70.0), (1, 1, 0, "c", 50.0), (2, 0, 0, "zero", 0.0)]
    got = {r.case: r.svg for r in bar_chart(spark.createDataFrame(rows, "case int, bar int, ord int, label string, value double"), ["case"]).collect()}
    rects = [tuple(map(float, m)) for m in re.findall(r'<rect x="([\d.]+)" y="([\d.]+)" width="[\d.]+" height="([\d.]+)"', got[1])]
    assert rects == [(40.0, 236.0, 84.0), (40.0, 40.0, 196.0), (320.0, 180.0, 140.0)]
    assert got[1].count("<text") == 2 and "a &lt;b&gt;" in got[1] and 'height="0.0"' in got[2]


def test_lines(spark):
    rows = [(1, "a", year, 100.0 * year) for year in (3, 1, 2)] + [(1, "b", 1, 0.0), (2, "one", 5, 0.0)]
    got = {r.case: r.svg for r in line_chart(spark.createDataFrame(rows, "case int, line string, x int, y double"), ["case"]).collect()}
    assert 'points="40.0,226.7 320.0,133.3 600.0,40.0"' in got[1] and got[1].count("<polyline") == 2 and "40.0,320.0" in got[2]
