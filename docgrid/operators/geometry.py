"""Lines and rows of a table from observed places: spacing, regularity, fits, nearest lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgrid.operators.matching import nearest

# Shares of the spacing within which gaps are regular and a fit may lie, and what a fit pays for.
EVEN = (0.55, 1.45)
SPACINGS, STRETCH, SHIFT, STEP = 31, 0.15, 0.45, 0.5
DOUBLE, MISSED, AWAY, HELD = 0.35, 0.25, 0.03, 0.02
COLUMN_GAP = 24
# The table's top and width on the page that tables are brought to, and the margin below it.
TABLE_TOP, TABLE_WIDTH, BELOW = 124, 1153, 24


def moving_sum(values: DataFrame, key: str, place: str, value: str, width: int) -> DataFrame:
    """key, place, total: sums over ``width`` places, centered; places without a value count as 0."""
    near = Window.partitionBy(key).orderBy(place).rangeBetween(-(width // 2), width // 2)
    return values.select(key, place, F.sum(value).over(near).alias("total"))


def gaps(lines: DataFrame, key: str, place: str) -> DataFrame:
    """key, top, bottom of each interval between neighbouring lines."""
    following = F.lead(place).over(Window.partitionBy(key).orderBy(place))
    return lines.select(key, F.col(place).alias("top"), following.alias("bottom")).where("bottom is not null")


def spacing(lines: DataFrame, key: str, place: str) -> DataFrame:
    """key, n (gaps), middle (their median), regular (all within ``EVEN`` of it)."""
    between = gaps(lines, key, place).withColumn("gap", F.col("bottom") - F.col("top"))
    each = between.groupBy(key).agg(F.count("*").alias("n"), F.median("gap").alias("middle"), F.min("gap").alias("least"), F.max("gap").alias("most"))
    return each.select(key, "n", "middle", ((F.col("least") >= F.col("middle") * EVEN[0]) & (F.col("most") <= F.col("middle") * EVEN[1])).alias("regular"))


def nearest_line(lines: DataFrame, targets: DataFrame, key: str, place: str, target: str) -> DataFrame:
    """key, target, line: the place nearest to each target, the smaller of equals."""
    wanted = targets.select(key, target).distinct()
    return nearest(wanted, lines, [key], target, place, [place]).where("near is not null").select(key, target, F.col(f"near.{place}").alias("line"))


def edge_at(ends: DataFrame, key: str, least: int = 4) -> DataFrame:
    """key, edge: x at the height ``at`` of a straight line through the end points (key, x, y, target,
    at), or the target where there are fewer than ``least``."""
    fit = ends.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope("x", "y").alias("slope"), F.regr_intercept("x", "y").alias("base"), F.first("target").alias("target"), F.first("at").alias("at"))
    return fit.select(key, F.when((F.col("n") >= least) & F.col("slope").isNotNull(), F.col("slope") * F.col("at") + F.col("base")).otherwise(F.col("target").cast("double")).alias("edge"))


def segments(columns: DataFrame, key: str, order: str, width: str) -> DataFrame:
    """key, order, start, end of columns laid side by side with ``COLUMN_GAP`` between."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col(width) + COLUMN_GAP).over(w), F.lit(0))
    return columns.select(key, order, start.alias("start"), (start + F.col(width)).alias("end"))


def centers(observed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Centers of rows, as many as ``slots``, from sorted places ``observed`` of some of their values.

    As many observed as slots, evenly apart: these. Else the regular sequence, of 31 spacings within 15 percent of
    the slots' and first places half a unit apart, that leaves least: the mean distance of values to their row,
    and charges for two in one row, for values beyond the rows, for moving away, less a bonus for rows held.
    With fewer than three values, slots too near each other or too few rows held: the slots."""
    n, seen = len(slots), len(observed)
    base = float(np.median(np.diff(slots))) if n > 1 else 0.0
    if seen < 3 or base < 10:
        return slots
    own = np.diff(observed)
    middle = float(np.median(own))
    if seen == n and middle >= 10 and (own >= middle * EVEN[0]).all() and (own <= middle * EVEN[1]).all():
        return observed
    size = (base * (1 - STRETCH) + np.arange(SPACINGS) * (base * 2 * STRETCH / (SPACINGS - 1)))[:, None]
    first = (slots[0] - base * SHIFT + np.arange(int(np.ceil(base * SHIFT * 2 / STEP + 1))) * STEP)[None, :]
    # one value at a time over all fits (spacing, first place); values ascend, so those of one row follow each other
    held, unique, off, last = np.zeros((size.size, first.size), np.int64), np.zeros((size.size, first.size), np.int64), np.zeros((size.size, first.size)), None
    for y in observed:
        at = np.rint((y - first) / size)
        inside = (at >= 0) & (at < n)
        held += inside
        unique += inside if last is None else inside & (at != last)
        off += np.where(inside, np.abs(y - (first + at * size)), 0)
        last = at
    with np.errstate(invalid="ignore", divide="ignore"):
        score = off / held + (held - unique) * base * DOUBLE + (seen - held) * base * MISSED + np.abs(first - slots[0]) * AWAY - unique * HELD
    score = np.where(unique >= min(3, n), np.round(score, 9), np.inf)
    i, j = np.unravel_index(int(score.argmin()), score.shape)
    if not np.isfinite(score[i, j]) or unique[i, j] < max(3, int(min(n, seen) * 0.55)):
        return slots
    return first[0, j] + np.arange(n) * size[i, 0]


def fitted(columns: DataFrame, key: str) -> DataFrame:
    """key, centers of each column (key: long; seen, slots: arrays of doubles) by ``centers``; the grid of
    fits is one array a column, and columns of a batch with the same places are fitted once. Null arrays are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(np.sort(np.array(seen or [], float)), np.array(slots or [], float)) for seen, slots in zip(batch.column("seen").to_pylist(), batch.column("slots").to_pylist())]
            alike = [(seen.tobytes(), slots.tobytes()) for seen, slots in both]
            fits = {k: centers(*pair) for k, pair in dict(zip(alike, both)).items()}
            found = [fits[k] for k in alike]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.list_(pa.float64()))], [key, "centers"])

    doubles = [F.col(c).cast("array<double>").alias(c) for c in ("seen", "slots")]
    return columns.select(F.col(key).cast("long"), *doubles).mapInArrow(run, f"{key} long, centers array<double>")


def on_page(tables: DataFrame) -> DataFrame:
    """``tables`` (corners: four points x, y, clockwise from the upper left; top_y, bottom_y, header_y, lines: array of heights) with
    scale (to the page's width, by the mean of the upper and lower edge), table_bottom, height (of the page), page_header and
    page_lines (all but the first line), in whole pixels, halves to even. A table without an extent has nulls."""
    x, y = (lambda k, n=n: F.get(F.get("corners", F.lit(k)), F.lit(n)) for n in (0, 1))  # noqa: B023
    edge = lambda a, b: F.sqrt((x(b) - x(a)) * (x(b) - x(a)) + (y(b) - y(a)) * (y(b) - y(a)))
    width, extent = (edge(0, 1) + edge(3, 2)) / 2, F.col("bottom_y") - F.col("top_y")
    out = tables.withColumn("scale", F.when((width > 0) & (extent > 0), F.lit(float(TABLE_WIDTH)) / width))
    out = out.withColumn("_tall", F.greatest(F.lit(1), F.rint(extent * F.col("scale")).cast("int")))
    out = out.withColumn("_tall", F.when(F.col("scale").isNotNull(), F.col("_tall")))
    put = lambda h: (F.lit(TABLE_TOP) + F.rint((h - F.col("top_y")) / extent * F.col("_tall"))).cast("int")
    lines = F.transform(F.slice("lines", F.lit(2), F.greatest(F.size("lines"), F.lit(0))), put)
    return out.withColumns({"table_bottom": F.col("_tall") + TABLE_TOP, "height": F.col("_tall") + (TABLE_TOP + BELOW), "page_header": put(F.col("header_y")), "page_lines": F.when(F.col("scale").isNotNull(), lines)}).drop("_tall")
