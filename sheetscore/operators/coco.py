"""COCO relations: clean-up and export forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import yolo_box
from ..functions.numbers import fixed
from ..functions.text import stem
from .groups import checked_broadcast


def known(found: Column) -> Column:
    """What a box's category leads to; without any the job stops, and no box is lost in silence."""
    name = F.coalesce(F.col("category_id").cast("string"), F.lit("null"))
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("box of unknown category "), name))).otherwise(found)


def remap_categories(categories: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lower-case the names, keep the first id of equal ones, point annotations at it.

    `categories` carries `pos`, its place in the document. A box of an unknown category is an error.
    """
    named = categories.withColumn("name", F.lower("name"))
    first = named.groupBy("name").agg(F.min_by("id", "pos").alias("id"), F.min("pos").alias("pos"))
    moved = named.select(F.col("id").alias("category_id"), "name").join(first.select("name", F.col("id").alias("_to")), "name")
    moved = checked_broadcast(moved.select("category_id", "_to"))
    kept = annotations.join(moved, "category_id", "left").withColumn("category_id", known(F.col("_to"))).drop("_to")
    return first.select("id", "name", "pos"), kept


def drop_category(categories: DataFrame, annotations: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Remove a class and its annotations."""
    junk = categories.filter(F.col("name") == name).select(F.col("id").alias("category_id"))
    return (
        categories.filter(F.col("name") != name),
        annotations.join(checked_broadcast(junk), "category_id", "left_anti"),
    )


def class_index(categories: DataFrame) -> DataFrame:
    """Dense zero-based index by id; categories are a short table."""
    return categories.withColumn("class_index", F.dense_rank().over(Window.orderBy("id")) - 1)


def shift_labels(df: DataFrame, by: int = -1) -> DataFrame:
    return df.withColumn("label", F.col("label") + by)


def keep_labels(df: DataFrame, *names: str) -> DataFrame:
    """Detections whose class name, trimmed and lower-cased, is one of `names`."""
    return df.filter(F.lower(F.trim("label")).isin(*(names or ("table",))))


def label_path(file_name: Column) -> Column:
    return F.concat(F.regexp_extract(file_name, r"^(.*/)?", 0), stem(file_name))


def label_files(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """(label_path, text) of every picture, lines by box id; a picture without boxes has an empty file."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("id", "line"))), lambda r: r["line"])
    text = yolo_rows(images, annotations, categories).groupBy("label_path").agg(F.array_join(lines, "\n").alias("text"))
    paths = images.select(label_path(F.col("file_name")).alias("label_path")).distinct()
    return paths.join(text, "label_path", "left").withColumn("text", F.coalesce("text", F.lit("")))


def yolo_rows(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """One label line per box with a positive size -> (stem, label_path, id, line).

    label_path is the picture's path without its extension: pictures of one name in two folders stay apart.
    A box of an unknown category is an error.
    """
    index = checked_broadcast(class_index(categories).select(F.col("id").alias("category_id"), "class_index"))
    sized = images.select(F.col("id").alias("image_id"), stem(F.col("file_name")).alias("stem"), label_path(F.col("file_name")).alias("label_path"), "width", "height")
    real = annotations.filter((F.col("bbox")[2] > 0) & (F.col("bbox")[3] > 0))
    rows = real.join(index, "category_id", "left").withColumn("class_index", known(F.col("class_index"))).join(sized, "image_id")
    shares = yolo_box(F.col("bbox"), F.col("width"), F.col("height"))
    return rows.select("stem", "label_path", "id", F.concat_ws(" ", F.col("class_index").cast("string"), *[fixed(c, 6) for c in shares]).alias("line"))


def coco_documents(images: DataFrame, boxes: DataFrame, categories: DataFrame, boxes_per_document: int = 50_000) -> DataFrame:
    """The relations as complete COCO documents -> (document, json).

    Boxes are dealt by their corpus number, so a document stays bounded however
    many boxes one image holds; every document lists the images it refers to.
    Images without boxes are dealt by their id.
    """
    document = F.floor(F.col("id") / boxes_per_document).alias("document")
    numbered = boxes.select(document, "id", "image_id", "category_id", "bbox", "area")
    used = numbered.select("document", "image_id").distinct()
    empty = images.join(boxes.select("image_id").distinct(), "image_id", "left_anti").select(
        F.floor(F.col("image_id") / boxes_per_document).alias("document"), "image_id"
    )
    listed = used.unionByName(empty).join(images, "image_id")
    image = F.struct(F.col("image_id").alias("id"), F.col("image").alias("file_name"), "width", "height")
    box = F.struct("id", "image_id", "category_id", "bbox", "area", F.lit(0).alias("iscrowd"), F.array().cast("array<double>").alias("segmentation"))
    i = listed.groupBy("document").agg(F.sort_array(F.collect_list(image)).alias("images"))
    a = numbered.groupBy("document").agg(F.sort_array(F.collect_list(box)).alias("annotations"))
    names = [r.asDict() for r in categories.select("id", "name").orderBy("id").collect()]  # the class list
    listed_names: Column = F.array(*[F.struct(F.lit(n["id"]).alias("id"), F.lit(n["name"]).alias("name")) for n in names])
    both = i.join(a, "document", "full")
    return both.select(
        "document",
        F.to_json(
            F.struct(
                listed_names.alias("categories"),
                F.coalesce("images", F.array().cast(i.schema["images"].dataType)).alias("images"),
                F.coalesce("annotations", F.array().cast(a.schema["annotations"].dataType)).alias("annotations"),
            )
        ).alias("json"),
    )
