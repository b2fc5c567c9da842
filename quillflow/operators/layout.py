"""Reading order of boxes on pages: recursive cuts along gaps, a row a box, a round of windows a level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

LEVELS = 3
TASK_BOXES = 100_000  # that one task orders, but for those of one page
GAP_X, GAP_Y = 12.0, 10.0  # least width of a gap between columns, least height of one between blocks


def _islands(low: str, high: str, least: float, name: str):
    """(part number, gap before it) of boxes along an axis: a part begins where none before reaches within `least`."""
    group = Window.partitionBy("_key", "_path")
    order = group.orderBy(low, high, "_id")
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(F.col(low) - reach >= least, F.col(low) - reach)
    return {f"_{name}_gap": gap}, {f"_{name}": F.count(f"_{name}_gap").over(order.rowsBetween(Window.unboundedPreceding, 0)), f"_{name}_most": F.max(f"_{name}_gap").over(group)}


def dealt(rows: DataFrame, n_rows: int, page: str) -> DataFrame:
    """rows dealt out by page to as many tasks as their number asks for, so that no task's share grows with the table. One
    shuffle serves what groups and windows by page follow."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TASK_BOXES))
    return rows.repartition(tasks, page)


def reading_order(boxes: DataFrame, page: str, box: str, gap_x: float = GAP_X, gap_y: float = GAP_Y, levels: int = LEVELS) -> DataFrame:
    """Adds `region` (where a box stands after the cuts, as part numbers from the outside in) and `number` (from 1, in reading
    order). boxes has x0, y0, x1, y1 in points, y growing downwards.

    Every level cuts each region once more, into all parts that gaps of one direction leave: the direction of its widest gap,
    columns if both are as wide. Columns are read from left to right, blocks from the top; within a region that is cut no
    further boxes are read by their upper edge, then from the left, then by id, which is unique on a page. Boxes without a place
    come last, in no region.
    """
    placed = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    b = boxes.withColumns({"_key": F.col(page), "_id": F.col(box), "_placed": placed, "_path": F.when(placed, F.array().cast("array<int>"))})
    for _ in range(levels):
        (gx, nx), (gy, ny) = _islands("x0", "x1", gap_x, "x"), _islands("y0", "y1", gap_y, "y")
        b = b.withColumns({**gx, **gy}).withColumns({**nx, **ny})
        wide, high = F.coalesce("_x_most", F.lit(0.0)), F.coalesce("_y_most", F.lit(0.0))
        part = F.when((wide > 0) & (wide >= high), F.col("_x")).when(high > 0, F.col("_y"))
        b = b.withColumn("_path", F.when(F.col("_placed") & part.isNotNull(), F.concat("_path", F.array(part.cast("int")))).otherwise(F.col("_path")))
        b = b.drop(*[f"_{d}{s}" for d in "xy" for s in ("", "_gap", "_most")])
    order = Window.partitionBy("_key").orderBy(F.desc("_placed"), "_path", "y0", "x0", "_id")
    return b.withColumn("number", F.row_number().over(order)).withColumn("region", F.col("_path")).drop("_key", "_id", "_placed", "_path")


def headings(boxes: DataFrame, page: str, size: str, larger: float = 1.2) -> DataFrame:
    """Adds heading_level: 1 to 6 for boxes whose letters are at least `larger` times the page's usual size (that of most
    characters, ties to the smaller), the largest size being 1; null for others."""
    per = Window.partitionBy(page)
    chars = boxes.groupBy(F.col(page).alias("_p"), F.col(size).alias("_s")).agg(F.sum(F.length("text")).alias("_n")).filter("_s is not null")
    usual = chars.groupBy("_p").agg(F.max_by("_s", F.struct("_n", -F.col("_s"))).alias("_usual"))
    out = boxes.join(usual, F.col(page).eqNullSafe(F.col("_p")), "left")
    big = F.col(size) >= F.col("_usual") * larger
    rank = F.dense_rank().over(Window.partitionBy(page, big).orderBy(F.desc(size)))
    return out.withColumn("heading_level", F.when(big, F.least(rank, F.lit(6)))).drop("_p", "_usual")
