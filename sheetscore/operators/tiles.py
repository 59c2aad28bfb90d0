"""Tiles of large pictures and the merge of their boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import tile_origins
from .assign import nms


def tile_grid(images: DataFrame, tile: int = 1024, overlap: float = 0.2) -> DataFrame:
    """-> (image, tile_idx, x0, y0, x1, y1); rows first, left to right."""
    ys, xs = (tile_origins(F.col(c), tile, overlap) for c in ("height", "width"))
    grid = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x0"), y.alias("y0")))))
    rows = images.select("image", "width", "height", F.posexplode(grid).alias("tile_idx", "o"))
    return rows.select(
        "image",
        "tile_idx",
        "o.x0",
        "o.y0",
        F.least(F.col("o.x0") + tile, F.col("width")).alias("x1"),
        F.least(F.col("o.y0") + tile, F.col("height")).alias("y1"),
    )


def tile_to_image(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile boxes in picture coordinates.

    Spark's size estimate of a grid knows nothing of the tiles an image is cut into, so the join is told not to broadcast.
    """
    origin = tiles.select("image", "tile_idx", F.col("x0").alias("_ox"), F.col("y0").alias("_oy"))
    return _moved(boxes.join(origin.hint("merge"), ["image", "tile_idx"]))


def tile_to_picture(boxes: DataFrame, images: DataFrame, tile: int = 1024, overlap: float = 0.2) -> DataFrame:
    """`tile_to_image` over `tile_grid` of the images, without a row for every tile: an origin follows from the tile's number.

    Boxes of a tile that the image does not have go.
    """
    ys, xs = (tile_origins(F.col(c), tile, overlap) for c in ("height", "width"))
    starts = images.select("image", xs.alias("_xs"), ys.alias("_ys"))
    wide, idx = F.size("_xs"), F.col("tile_idx").cast("int")
    rows = boxes.join(starts.hint("merge"), "image").filter((F.col("tile_idx") >= 0) & (F.col("tile_idx") < wide * F.size("_ys")))
    rows = rows.withColumns({"_ox": F.get("_xs", idx % wide), "_oy": F.get("_ys", F.floor(idx / wide).cast("int"))})
    return _moved(rows.drop("_xs", "_ys"))


def _moved(rows: DataFrame) -> DataFrame:
    moved = {c: F.col(c) + F.col("_ox" if c[0] == "x" else "_oy") for c in ("x1", "y1", "x2", "y2")}
    return rows.withColumns(moved).drop("_ox", "_oy")


def merge_tiles(tile_boxes: DataFrame, full_boxes: DataFrame | None, thr: float = 0.5, **bounds) -> DataFrame:
    """All tile boxes plus the whole-picture pass, duplicates suppressed.

    Both sides carry (run_id, image, class, pred_idx, x1, y1, x2, y2, score) in
    picture coordinates; tiles come first among equal scores.
    """
    cols = ["run_id", "image", "class", "pred_idx", "x1", "y1", "x2", "y2", "score"]
    boxes = tile_boxes.select(*cols).withColumn("pred_idx", F.col("pred_idx").cast("long"))
    if full_boxes is not None:
        late = F.lit(1 << 40) + F.col("pred_idx")
        boxes = boxes.unionByName(full_boxes.select(*cols).withColumn("pred_idx", late))
    return nms(boxes, thr, **bounds)
