"""Answer keys: projections of the annotation table.

annotations: image, path, width, height, status, meta, regions, features
(map of name to {value, text, bbox}).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import box_area, corners, has_box
from ..functions.dims import parse_normalized
from ..functions.numbers import pred_present
from ..functions.text import has_text, normalize_text, strip
from ..schemas import CATEGORIES
from ..session import cut
from .prefix import sequential_ids

TASK_CLASSES = {"tables": ["table"], "dimensions": ["dimension"], "both": ["table", "dimension"]}


def drop_drafts(annotations: DataFrame) -> DataFrame:
    """Unfinished records are not part of any key; a missing status counts as complete."""
    return annotations.filter(F.coalesce("status", F.lit("complete")) != "draft")


def filter_class(df: DataFrame, task: str) -> DataFrame:
    return df.filter(F.col("class").isin(TASK_CLASSES.get(task, ["dimension"])))


def region_rows(annotations: DataFrame) -> DataFrame:
    """One row per region in reading order -> (image, pos, class, bbox, text, parsed)."""
    rows = annotations.select("image", F.posexplode("regions").alias("pos", "r"))
    return rows.select(
        "image",
        "pos",
        F.coalesce("r.class", F.lit("dimension")).alias("class"),
        F.coalesce("r.bbox", F.array(*[F.lit(0.0)] * 4)).alias("bbox"),
        strip(F.coalesce("r.text", F.lit(""))).alias("text"),
        "r.parsed",
    )


def detection_truth(annotations: DataFrame, task: str = "both") -> DataFrame:
    """Truth boxes as the detection scorer sees them: any listed box, as corners."""
    rows = drop_drafts(annotations).select("image", F.posexplode("regions").alias("gt_idx", "r"))
    rows = rows.select("image", "gt_idx", F.col("r.class").alias("class"), F.col("r.bbox").alias("bbox"))
    return filter_class(rows, task).filter(F.size("bbox") > 0).select("image", "class", "gt_idx", *corners(F.col("bbox")))


def image_ids(annotations: DataFrame) -> DataFrame:
    """Image ids are positions in the sorted file list, drafts included."""
    files = cut(annotations.select("image", "path", "width", "height", "status"))  # counted, then numbered
    return sequential_ids(files, [F.asc("path")], "image_id")


def _category(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, c), F.lit(CATEGORIES["dimension"]))


def box_key(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, boxes): every region with a real box, numbered over the corpus."""
    images = cut(drop_drafts(image_ids(annotations)))
    # by path: two masters may name one image
    numbers = images.select("path", "image_id")
    return images.select("image_id", "image", "width", "height"), numbered_boxes(box_rows(annotations), numbers, "path")


def box_rows(annotations: DataFrame) -> DataFrame:
    """(path, image, pos, category_id, bbox, area): every region with a real box; needs no other image."""
    rows = drop_drafts(annotations)
    path = F.col("path" if "path" in rows.columns else "image").alias("path")
    by_path = region_rows(rows.select(F.struct(path, "image").alias("image"), "regions")).filter(has_box(F.col("bbox")))
    return by_path.select(
        "image.*", "pos", _category(F.col("class")).alias("category_id"), "bbox", box_area(F.col("bbox")).alias("area")
    )


def numbered_boxes(rows: DataFrame, numbers: DataFrame, on: str) -> DataFrame:
    """Boxes numbered over the corpus, in order of image_id and place."""
    boxes = cut(rows.join(numbers, on).select("image_id", "image", "pos", "category_id", "bbox", "area"))
    return sequential_ids(boxes, [F.asc("image_id"), F.asc("pos")], "id")


def text_key(annotations: DataFrame, task: str | None = None) -> DataFrame:
    """Non-blank region texts in reading order; `task` None is the whole page.

    -> (image, gt_idx, text)
    """
    rows = region_rows(drop_drafts(annotations)).filter(has_text(F.col("text")))
    if task is not None:
        rows = rows.filter(F.col("class") == ("table" if task == "tables" else "dimension"))
    return rows.select("image", F.col("pos").alias("gt_idx"), "text")


def feature_value(value: Column) -> Column:
    """'' is no value."""
    return F.when(~F.coalesce((value["kind"] == "str") & (value["text"] == ""), F.lit(False)), value)


def field_key(annotations: DataFrame) -> DataFrame:
    """Field values per image; absent values stay as NULL entries. -> (image, fields)"""
    return (
        drop_drafts(annotations)
        .filter(F.size("features") > 0)
        .select("image", F.transform_values("features", lambda _, f: feature_value(f["value"])).alias("fields"))
    )


def parsed_dimensions(annotations: DataFrame) -> DataFrame:
    """Dimension regions with their parsed callout; a stored parse is kept."""
    rows = region_rows(drop_drafts(annotations)).filter((F.col("class") == "dimension") & has_text(F.col("text")))
    rows = rows.withColumn("_norm", normalize_text(F.col("text")))  # read by every part, so kept as a column
    parsed = F.coalesce("parsed", parse_normalized(F.col("_norm"), F.col("text")))
    return rows.select("image", "pos", "bbox", "text", parsed.alias("parsed"))


def answer_keys(annotations: DataFrame) -> dict[str, DataFrame]:
    images, boxes = box_key(annotations)
    return {
        "images": images,
        "boxes": boxes,
        "dimension_texts": text_key(annotations, "dimensions"),
        "table_texts": text_key(annotations, "tables"),
        "whole_texts": text_key(annotations),
        "fields": field_key(annotations),
        "parsed_dimensions": parsed_dimensions(annotations),
    }


# --- counts ------------------------------------------------------------------


def _of_class(cls: str) -> Column:
    return F.filter(F.coalesce("regions", F.array()), lambda r: r["class"] == cls)


def _with_text(regions: Column) -> Column:
    return F.size(F.filter(regions, lambda r: has_text(r["text"])))


def _filled() -> Column:
    return F.size(F.filter(F.map_values("features"), lambda f: feature_value(f["value"]).isNotNull()))


def annotation_coverage(annotations: DataFrame) -> DataFrame:
    """One row: how much of the corpus is annotated."""
    dims, tables = _of_class("dimension"), _of_class("table")
    per_image = annotations.select(
        F.size(dims).alias("dims"),
        _with_text(dims).alias("dim_text"),
        F.size(tables).alias("tables"),
        _with_text(tables).alias("table_text"),
        F.coalesce(F.size("features"), F.lit(0)).alias("features"),
        F.coalesce(_filled(), F.lit(0)).alias("filled"),
    )
    return per_image.agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("dims") > 0).alias("images_with_dimension"),
        F.count_if(F.col("tables") > 0).alias("images_with_table"),
        F.sum("dims").alias("dimension_regions"),
        F.sum("dim_text").alias("dimension_texts"),
        F.sum("tables").alias("table_regions"),
        F.sum("table_text").alias("table_texts"),
        F.sum("features").alias("features_total"),
        F.sum("filled").alias("features_filled"),
        F.count_if(F.col("filled") > 0).alias("images_with_features"),
    )


def images_without_table(annotations: DataFrame) -> DataFrame:
    """Images that have dimensions but no table region yet."""
    return annotations.filter((F.size(_of_class("dimension")) > 0) & (F.size(_of_class("table")) == 0)).select("image")


def annotation_counts(annotations: DataFrame, image_files: DataFrame | None = None) -> DataFrame:
    """Per image: regions, regions with text, filled features, status, picture at hand."""
    regions = F.coalesce("regions", F.array())
    out = annotations.select(
        "image",
        F.size(regions).alias("regions"),
        _with_text(regions).alias("with_text"),
        F.coalesce(_filled(), F.lit(0)).alias("features"),
        F.coalesce("status", F.lit("complete")).alias("status"),
    )
    if image_files is None:
        return out
    have = image_files.select("image").distinct().withColumn("has_image", F.lit(True))
    return out.join(have, "image", "left").withColumn("has_image", F.coalesce("has_image", F.lit(False)))


def category_counts(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))


def present_fields(fields: DataFrame) -> DataFrame:
    """How many images have a value for each field."""
    rows = fields.select(F.explode("fields").alias("field", "value"))
    return rows.groupBy("field").agg(F.count_if(pred_present(F.col("value"))).alias("n"))
