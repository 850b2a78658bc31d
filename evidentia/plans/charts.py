"""Charts as SVG text, one row per case, from the tables that hold their data."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import escape_html

WIDTH, HEIGHT, MARGIN = 640, 360, 40
COLOURS = ("#30475e", "#7a9e9f", "#c9d6df", "#e2b33c")
#: Mean width of a character as a share of its height. Fixed value.
CHARACTER = 0.6


def text_width(text: Column, size: float) -> Column:
    return F.length(text) * size * CHARACTER


def _svg(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, svg) of shapes (keys, rank, shape); a chart has few shapes."""
    rows = shapes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "shape"))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["shape"]), "")
    return rows.select(*keys, F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}">'), body, F.lit("</svg>")).alias("svg"))


def _n(x: Column) -> Column:
    return F.round(x, 1).cast("string")


def bar_chart(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Stacked bars of segments (keys, bar, ord, label, value): the tallest fills the frame, each bar stands above its label."""
    stack = Window.partitionBy(*keys, "bar").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    case = Window.partitionBy(*keys)
    rows = segments.withColumn("top", F.sum("value").over(stack))
    rows = rows.withColumns({"largest": F.max("top").over(case), "bars": F.max("bar").over(case) + 1})
    scale = F.coalesce(F.try_divide(F.lit(float(HEIGHT - 2 * MARGIN)), F.col("largest")), F.lit(0.0))
    step = (WIDTH - 2 * MARGIN) / F.col("bars")
    x, tall = MARGIN + step * F.col("bar"), F.col("value") * scale
    colour = F.element_at(F.array(*map(F.lit, COLOURS)), (F.col("ord") % len(COLOURS) + 1).cast("int"))
    rect = F.format_string('<rect x="%s" y="%s" width="%s" height="%s" fill="%s"/>', _n(x), _n(HEIGHT - MARGIN - F.col("top") * scale), _n(step * 0.7), _n(tall), colour)
    label = F.format_string('<text x="%s" y="%s" font-size="12">%s</text>', _n(x), F.lit(str(HEIGHT - MARGIN // 2)), escape_html(F.col("label")))
    shapes = rows.select(*keys, F.struct("bar", "ord").alias("rank"), F.when(F.col("ord") == F.min("ord").over(Window.partitionBy(*keys, "bar")), F.concat(rect, label)).otherwise(rect).alias("shape"))
    return _svg(shapes, keys)


def line_chart(points: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of points (keys, line, x, y), one per value of ``line``, in one frame from zero to the largest y."""
    case = Window.partitionBy(*keys)
    wide, tall = WIDTH - 2 * MARGIN, HEIGHT - 2 * MARGIN
    at_x = MARGIN + wide * F.coalesce(F.try_divide(F.col("x") - F.min("x").over(case), F.max("x").over(case) - F.min("x").over(case)), F.lit(0.0))
    at_y = HEIGHT - MARGIN - tall * F.coalesce(F.try_divide(F.col("y"), F.max("y").over(case)), F.lit(0.0))
    placed = points.select(*keys, "line", "x", F.concat_ws(",", _n(at_x), _n(at_y)).alias("at"))
    lines = placed.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct("x", "at"))).alias("p"))
    path = F.array_join(F.transform("p", lambda p: p["at"]), " ")
    shapes = lines.select(*keys, F.col("line").alias("rank"), F.format_string('<polyline fill="none" stroke="%s" points="%s"><title>%s</title></polyline>', F.lit(COLOURS[0]), path, escape_html(F.col("line").cast("string"))).alias("shape"))
    return _svg(shapes, keys)
