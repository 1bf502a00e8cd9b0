"""Rectangles of tiled planes, at a level of their pyramid.

Tiles are rows (keys, x, y, width, height, pixels row by row), regions rows (keys, x, y, width, height); keys name the plane, its level
among them. Both are dealt to the cells of a grid they touch and meet by cell, so a tile is looked at for the regions near it alone; a
pair is taken in the cell that holds the first pixel of its overlap. Rows of pixels are cut out of tiles as array slices and put
together by region and row, so no region is ever whole in one place.

Defined results: what no tile covers is 0; of overlapping tiles the one further down, then further right wins; a tile that is cut short is
pasted as far as it goes; tiles may begin left of or above the plane; a null corner or size touches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UsageError

#: Side of a grid cell: about that of a tile.
CELL = 512


def parse(text: str) -> tuple[int, int, int, int]:
    """X,Y,WIDTH,HEIGHT."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != 4 or not all(p.isdigit() for p in parts) or 0 in map(int, parts[2:]):
        raise UsageError(f"region {text!r}: expected X,Y,WIDTH,HEIGHT in pixels", "width and height are 1 at least")
    return tuple(map(int, parts))


def outside(regions: DataFrame, planes: DataFrame, keys: list[str]) -> DataFrame:
    """Regions that are empty, extend past their plane (plane_width, plane_height), or name none: with ``problem``."""
    j = regions.join(planes.select(*keys, "plane_width", "plane_height"), keys, "left")
    past = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("width") > F.col("plane_width")) | (F.col("y") + F.col("height") > F.col("plane_height"))
    problem = F.when(F.col("plane_width").isNull(), "no such plane").when((F.col("width") < 1) | (F.col("height") < 1), "empty").when(past, "extends past the plane")
    return j.withColumn("problem", problem).where("problem IS NOT NULL")


def best_level(levels: DataFrame, image: list[str], longest: int) -> DataFrame:
    """Of each image the smallest level whose longer side has ``longest`` pixels or more, or else the largest: image, level, plane_width, plane_height."""
    side = F.greatest("plane_width", "plane_height")
    fits = F.when(side >= longest, -side).otherwise(F.lit(None))
    best = F.max_by(F.struct("level", "plane_width", "plane_height"), F.struct(fits.isNotNull(), F.coalesce(fits, side), -F.col("level")))
    return levels.groupBy(*image).agg(best.alias("b")).select(*image, "b.*")


def rescaled(x: Column, size: Column, have: Column, want: Column) -> tuple[Column, Column]:
    """A span of a plane's side of ``have`` pixels on one of ``want``: the smallest that covers it, never empty; (start, size)."""
    exact = lambda c: c.cast("decimal(20,0)")
    by = F.nullif(exact(have), F.lit(0).cast("decimal(20,0)"))
    whole = lambda a: ((a - a % by) / by).cast("long")
    start, end = whole(exact(x) * exact(want)), whole(exact(x + size) * exact(want) + by - 1)
    start, end = F.coalesce(start, F.lit(0)), F.coalesce(end, F.lit(0))
    end = F.least(F.greatest(end, start + 1), want)
    start = F.least(start, F.greatest(want - 1, F.lit(0)))
    return start, F.greatest(end - start, F.lit(1))


def _in_cells(df: DataFrame, cell: int) -> DataFrame:
    span = lambda at, size: F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(size) - 1) / cell))
    some = df.where((F.col("width") > 0) & (F.col("height") > 0))
    return some.withColumn("cell_x", F.explode(span("x", "width"))).withColumn("cell_y", F.explode(span("y", "height")))


def overlaps(tiles: DataFrame, regions: DataFrame, keys: list[str], region: list[str], cell: int = CELL) -> DataFrame:
    """Each region with each tile that it meets: region, keys, the tile's pixels, corner (tx, ty) and width (tw), the region's corner and size (rx, ry, rw, rh), and x0, y0, x1, y1 of the overlap."""
    t = _in_cells(tiles.select(*keys, "x", "y", "width", "height", "pixels"), cell).withColumnsRenamed({"x": "tx", "y": "ty", "width": "tw", "height": "th"})
    r = _in_cells(regions.select(*region, *keys, "x", "y", "width", "height"), cell).withColumnsRenamed({"x": "rx", "y": "ry", "width": "rw", "height": "rh"})
    # pixels go to the tile's cells: a region's cells are many where it is large, and hold numbers alone
    j = t.join(r, [*keys, "cell_x", "cell_y"])
    j = j.withColumns({"x0": F.greatest("tx", "rx"), "y0": F.greatest("ty", "ry"), "x1": F.least(F.col("tx") + F.col("tw"), F.col("rx") + F.col("rw")), "y1": F.least(F.col("ty") + F.col("th"), F.col("ry") + F.col("rh"))})
    first = (F.floor(F.col("x0") / cell) == F.col("cell_x")) & (F.floor(F.col("y0") / cell) == F.col("cell_y"))
    return j.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & first).drop("cell_x", "cell_y", "th")


def read(tiles: DataFrame, regions: DataFrame, keys: list[str], region: list[str], cell: int = CELL) -> DataFrame:
    """The pixels of the regions: region, row (from the region's top), values. Rows that no tile touches are 0, too."""
    kind = tiles.schema["pixels"].dataType.elementType.simpleString()
    cut = overlaps(tiles, regions, keys, region, cell).withColumn("py", F.explode(F.expr("sequence(y0, y1 - 1)")))
    piece = F.expr("slice(pixels, cast((py - ty) * tw + (x0 - tx) + 1 as int), cast(x1 - x0 as int))")
    cut = cut.select(*region, (F.col("py") - F.col("ry")).cast("long").alias("row"), F.struct(F.col("ty"), F.col("tx"), (F.col("x0") - F.col("rx")).cast("int").alias("off"), piece.alias("piece")).alias("p")).where("size(p.piece) > 0")
    # as many pieces as tiles side by side
    pieces = cut.groupBy(*region, "row").agg(F.array_sort(F.collect_list("p")).alias("pieces"))
    rows = regions.where((F.col("width") > 0) & (F.col("height") > 0)).select(*region, F.col("width").cast("int").alias("rw"), F.explode(F.expr("sequence(0L, cast(height as long) - 1)")).alias("row"))
    pasted = f"aggregate(coalesce(pieces, array()), array_repeat(cast(0 as {kind}), rw), (a, p) -> concat(slice(a, 1, p.off), p.piece, slice(a, p.off + size(p.piece) + 1, rw)))"
    return rows.join(pieces, [*region, "row"], "left").select(*region, "row", F.expr(pasted).alias("values"))
