"""Readers for annotation documents, results, keys, training logs and pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import VALUE, variant_value
from ..functions.text import stem
from ..operators.prefix import sequential_ids
from ..schemas import ANNOTATION_JSON, COCO_JSON, FEATURE, FEATURE_SCHEMA, OCR_JSON, VLM_JSON
from .headers import header_sizes
from .pieces import json_members


def _feature(v: Column) -> Column:
    """A stored feature is a bare value or an object around it."""
    wrapped = F.schema_of_variant(v).startswith("OBJECT")
    inner = F.when(wrapped, F.try_variant_get(v, "$.value", "variant")).otherwise(v)
    return F.struct(
        variant_value(inner).alias("value"),
        F.coalesce(F.when(wrapped, F.try_variant_get(v, "$.text", "string")), F.lit("")).alias("text"),
        F.when(wrapped, F.try_variant_get(v, "$.bbox", "array<double>")).alias("bbox"),
    ).cast(FEATURE)


def _masters(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(ANNOTATION_JSON + ", _corrupt_record string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "[!_]*.json")
        .json(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def unreadable_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the masters that are no JSON documents of this kind."""
    return _masters(spark, path).filter(~_readable()).select("path").distinct()


def _readable() -> Column:
    # A row is whole or has its text in the corrupt column. The second part never holds; it names a further
    # column, since Spark does not answer from the corrupt one alone, as in a count.
    return F.col("_corrupt_record").isNull() | F.coalesce(F.col("image") == F.col("_corrupt_record"), F.lit(False))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """All masters of a folder. Names starting with `_` are templates; `unreadable_annotations` lists what is left out."""
    rows = _masters(spark, path)
    return rows.filter(_readable()).select(
        F.coalesce(F.nullif("image", F.lit("")), stem(F.url_decode("path"))).alias("image"),
        "path", "width", "height", "status", "meta",
        F.coalesce("regions", F.array().cast(rows.schema["regions"].dataType)).alias("regions"),
        F.coalesce(
            F.transform_values("features", lambda _, v: _feature(v)), F.create_map().cast(f"map<string,{FEATURE}>")
        ).alias("features"),
    )


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of one or more COCO documents."""
    doc = spark.read.schema(COCO_JSON).option("multiLine", True).json(path)
    images = doc.select(F.explode("images").alias("i")).select("i.*")
    boxes = doc.select(F.explode("annotations").alias("a")).select("a.*")
    classes = doc.select(F.posexplode("categories").alias("pos", "c")).select("c.*", "pos").dropDuplicates(["id", "name"])
    return images.withColumn("extra_name", F.col("extra.name")).drop("extra"), boxes, classes


_TAGGED = r"^(tables|dimensions|all|both)_(.+?)_(full|gtcrop|crop|crop-[^/]*)_results\.json$"
_PLAIN = r"^(tables|dimensions|all|both)_(.+)_results\.json$"


def read_ocr_results(spark: SparkSession, root: str) -> DataFrame:
    """Combined result files; task, model and label come from the file name.

    Untagged names are detector crops of old and count only where no tagged
    file of the same task and model exists.
    """
    rows = (
        spark.read.schema(OCR_JSON).option("multiLine", True).option("pathGlobFilter", "*_results.json").json(root)
        .withColumn("_name", F.url_decode(F.col("_metadata.file_name")))
    )
    tagged = F.col("_name").rlike(_TAGGED)

    def part(i: int) -> Column:
        return F.when(tagged, F.regexp_extract("_name", _TAGGED, i)).otherwise(F.regexp_extract("_name", _PLAIN, i))

    rows = rows.select(
        "image", "detections",
        part(1).alias("task"),
        part(2).alias("ocr_model"),
        F.when(tagged, F.regexp_extract("_name", _TAGGED, 3)).otherwise("crop").alias("label"),
        tagged.alias("_tagged"),
    )
    have = rows.filter("_tagged AND label = 'crop'").select("task", "ocr_model").distinct()
    old = rows.filter(~F.col("_tagged")).join(have, ["task", "ocr_model"], "left_anti")
    return rows.filter("_tagged").unionByName(old).drop("_tagged")


def ocr_texts(results: DataFrame, non_empty: bool = True) -> DataFrame:
    from ..operators.context import ocr_rows

    rows = ocr_rows(results)
    return rows.filter(F.col("text") != "") if non_empty else rows


def read_vlm_results(spark: SparkSession, path: str, task: str | None = None, mode: str | None = None) -> DataFrame:
    """Accumulated extraction results with their file order, fields as tagged values.

    seq: files by path, rows by their place in the file. One task reads a file, so the task's running number
    less the file's first one is that place, whatever order the files were dealt in.
    """
    rows = (
        spark.read.schema(VLM_JSON).option("multiLine", True).json(path)
        .withColumns({"_path": F.col("_metadata.file_path"), "_id": F.monotonically_increasing_id()})
    )
    files = sequential_ids(rows.groupBy("_path").agg(F.min("_id").alias("_first")), [F.asc("_path")], "_file")
    place = F.col("_id") - F.col("_first")
    rows = rows.join(files, "_path").withColumn("seq", F.col("_file") * F.lit(1 << 33) + place)
    if task:
        rows = rows.filter(F.col("task") == task)
    if mode:
        rows = rows.filter(F.col("mode") == mode)
    return rows.select(
        "seq", "image", "task", "mode", "vlm_model", "usage", "context",
        F.try_variant_get("extracted", "$.error", "string").alias("error"),
        fields_of(F.col("extracted")).alias("fields"),
    )


def fields_of(extracted: Column) -> Column:
    """An extracted JSON object as a map of tagged values; anything else gives no fields."""
    entries = F.try_variant_get(extracted, "$", "map<string,variant>")
    return F.coalesce(
        F.transform_values(entries, lambda _, v: variant_value(v)), F.create_map().cast(f"map<string,{VALUE}>")
    )


def _documents(spark: SparkSession, path: str) -> tuple[DataFrame, Column]:
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    return doc, F.schema_of_variant("v").startswith("ARRAY")


def _row_name(v: Column) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in ("image", "image_id", "id")])


def _key_rows(spark: SparkSession, path: str, split: bool) -> tuple[DataFrame, DataFrame]:
    """(rows of list documents: r; entries of the others: image, t). `split` reads one document in many tasks."""
    if split:
        members = json_members(spark, path)
        named = members.filter(F.col("member").startswith('"')).select(F.try_parse_json(F.concat(F.lit("{"), "member", F.lit("}"))).alias("v"))
        listed = members.filter(F.col("member").startswith("{")).select(F.try_parse_json("member").alias("r"))
    else:
        doc, is_list = _documents(spark, path)
        listed = doc.filter(is_list).select(F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("r"))
        named = doc.filter(~is_list)
    return listed, named.select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("image", "t"))


def read_text_key(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Text key as a name-to-texts object or a list of rows -> (image, gt_idx, text).

    With `split` the members of a large document are read by many tasks; one that does not parse is left out alone.
    """
    rows, named = _key_rows(spark, path, split)
    listed = rows.select(
        _row_name(F.col("r")).alias("image"),
        F.coalesce(F.try_variant_get("r", "$.texts", "variant"), F.try_variant_get("r", "$.text", "variant")).alias("t"),
    ).filter(F.col("image").isNotNull())
    texts = F.when(
        F.schema_of_variant("t").startswith("ARRAY"), F.try_variant_get("t", "$", "array<string>")
    ).otherwise(F.array(F.try_variant_get("t", "$", "string")))
    both = named.unionByName(listed)
    return both.select("image", F.posexplode(texts).alias("gt_idx", "text"))


def read_field_key(spark: SparkSession, *paths: str, split: bool = False) -> DataFrame:
    """Field key in either shape -> (image, fields). The first path that holds any record is used; `split` as in `read_text_key`."""
    for path in paths:
        try:
            rows, entries = _key_rows(spark, path, split)
            listed = rows.select(_row_name(F.col("r")).alias("image"), fields_of(F.col("r")).alias("fields")).filter(
                F.col("image").isNotNull()
            )
            listed = listed.withColumn(
                "fields", F.map_filter("fields", lambda k, _: ~k.isin("image", "image_id", "id"))
            )
            named = entries.select("image", fields_of(F.col("t")).alias("fields"))
            key = named.unionByName(listed)
            if key.take(1):
                return key
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
    return spark.createDataFrame([], f"image string, fields map<string,{VALUE}>")


def read_training_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Every run's results.csv -> (run_dir, pos, map50, precision, recall).

    Columns go by the names in each file's own header; logs differ in their columns. Cells beyond the header
    (a trailing comma) are cut off, missing ones are null.
    """
    files = (
        spark.read.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", "results.csv")
        .text(root, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    )
    cells = lambda line: F.transform(F.split(line, ","), lambda x: F.trim(x))
    lines = files.select("_path", F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    rows = lines.select("_path", cells(F.col("l")[0]).alias("head"), F.explode(F.slice("l", 2, F.size("l"))).alias("line"))
    by_name = F.map_from_entries(F.arrays_zip("head", F.slice(cells(F.col("line")), F.lit(1), F.size("head"))))
    rows = rows.select("_path", by_name.alias("m"))
    number = lambda c: F.coalesce(F.col("m")[f"metrics/{c}(B)"].try_cast("double"), F.lit(0.0))
    return rows.select(
        F.regexp_extract("_path", r"^(.*)/results\.csv$", 1).alias("run_dir"),
        F.col("m")["epoch"].try_cast("int").alias("pos"),
        number("mAP50").alias("map50"), number("precision").alias("precision"), number("recall").alias("recall"),
    )


def read_weights(spark: SparkSession, root: str) -> DataFrame:
    """Every best.pt below `root`, by listing only -> (run_dir, path, modified)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "best.pt").load(root)
    return files.select(
        F.regexp_extract("path", r"^(.*)/weights/best\.pt$", 1).alias("run_dir"), "path",
        F.col("modificationTime").alias("modified"),
    ).filter(F.col("run_dir") != "")


def read_image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures of a folder -> (image, path, width, height), from their headers; files that are no pictures go."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")  # no content is read here
    sizes = header_sizes(files.filter(F.lower("path").rlike(r"\.(jpg|jpeg|png)$")))
    return sizes.select(stem("path").alias("image"), "path", "width", "height")


def read_feature_schema(spark: SparkSession, path: str) -> list[dict]:
    """The declared fields of a JSON file, in its order: a list of {name, type, unit, description}."""
    rows = spark.read.schema("name string, type string, unit string, description string").option("multiLine", True).json(path).collect()
    names = [r["name"] for r in rows]  # one row for each field of a prompt
    if len(set(names)) < len(names) or None in names:
        raise ValueError(f"{path} names a feature twice or not at all")
    return [r.asDict() for r in rows]


def feature_schema(spark: SparkSession, features: list[dict] | None = None) -> DataFrame:
    """The declared fields as a short relation."""
    rows = [(i, f["name"], f["type"], f.get("unit"), f.get("description")) for i, f in enumerate(features or FEATURE_SCHEMA)]
    return spark.createDataFrame(rows, "pos int, name string, type string, unit string, description string")


def add_feature(features: list[dict], feature: dict) -> list[dict]:
    """A new field at the end; names stay unique."""
    if any(f["name"] == feature["name"] for f in features):
        raise ValueError(f"feature {feature['name']} exists")
    return [*features, feature]


def drop_feature(features: list[dict], name: str) -> list[dict]:
    return [f for f in features if f["name"] != name]
