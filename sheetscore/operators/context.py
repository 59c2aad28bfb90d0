"""Text that goes into a prompt, assembled per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import feature_line, render_prompt
from ..functions.text import crop_source_name, strip
from .groups import small_table


def ocr_rows(results: DataFrame) -> DataFrame:
    """OCR results as one row per detection, in listed order."""
    keep = [c for c in ("run_id", "image", "task", "ocr_model", "label") if c in results.columns]
    rows = results.select(*keep, F.posexplode("detections").alias("pos", "d"))
    return rows.select(*keep, "pos", F.col("d.id").alias("det_id"), "d.confidence", "d.bbox", F.coalesce("d.text", F.lit("")).alias("text"))


def _joined(df: DataFrame, keys: list[str], order: list[str], line: Column, out: str) -> DataFrame:
    """Lines of one page in order; a page is one value by nature."""
    rows = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["_line"]), "\n").alias(out))


def page_text(texts: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Non-empty texts of an image, one per line. -> (keys, text_context)"""
    return _joined(texts.filter(F.col("text") != ""), keys or ["image"], order or ["pos"], F.col("text"), "text_context")


def crop_line(bbox: Column, text: Column) -> Column:
    """`[box x1, y1, x2, y2] text`, halves rounded to even; `[box n/a]` without a box."""
    rounded = F.transform(bbox, lambda v: F.bround(v, 0).cast("long").cast("string"))
    coord = F.when(F.size(bbox) > 0, F.concat(F.lit("[box "), F.array_join(rounded, ", "), F.lit("]")))
    return strip(F.concat(F.coalesce(coord, F.lit("[box n/a]")), F.lit(" "), text))


def crop_lines(texts: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    return _joined(texts, keys or ["image"], order or ["pos"], crop_line(F.col("bbox"), F.col("text")), "text_context")


def patch_lines(texts: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The command-line form: `[patch id] text`."""
    line = F.concat(F.lit("[patch "), F.col("det_id").cast("string"), F.lit("] "), F.col("text"))
    return _joined(texts.filter(F.col("text") != ""), keys or ["image"], order or ["pos"], line, "text_context")


def merge_crop_texts(tables: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Crop texts of both tasks, tables first. -> input plus `part`"""
    return tables.withColumn("part", F.lit(0)).unionByName(dimensions.withColumn("part", F.lit(1)))


def anti_drafts(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return images.join(annotations.filter(F.col("status") == "draft").select("image"), "image", "left_anti")


def context_join(images: DataFrame, context: DataFrame | None) -> DataFrame:
    """Attach the context; images without one get an empty text."""
    if context is None:
        return images.withColumn("text_context", F.lit(""))
    return images.join(context, "image", "left").withColumn("text_context", F.coalesce("text_context", F.lit("")))


def reply_templates(features: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """-> (keys, template): the reply that a schema expects, for every run (`keys`) with a schema of its own.

    features: (keys, pos, name, type, unit, description), as `feature_schema` gives them; a null unit is left out.
    Without keys there is one row, also for no fields at all. A schema is one text by nature.
    """
    keys = keys or []
    place = Window.partitionBy(*keys).orderBy("pos") if keys else Window.partitionBy(F.lit(0)).orderBy("pos")
    last = F.lead("pos").over(place).isNull()
    lines = features.select(*keys, "pos", feature_line(*(F.col(c) for c in ("name", "type", "unit", "description")), last).alias("line"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"])
    return lines.groupBy(*keys).agg(F.concat(F.lit("{\n"), F.array_join(body, "\n"), F.lit("\n}")).alias("template"))


def prompts(
    images: DataFrame, context: DataFrame | None, mode: str, features: DataFrame, intro: str | None = None, keys: list[str] | None = None
) -> DataFrame:
    """images plus text_context, mode and prompt.

    `features` is the schema relation; with `keys` (columns of both) each run asks for its own fields, and
    images of a run without a schema stop the job.
    """
    custom = F.lit(intro) if intro is not None else None
    templates, asked = reply_templates(features, keys), context_join(images, context)
    if keys:
        asked = asked.join(small_table(templates.withColumnRenamed("template", "_template")), keys, "left")
        template = F.coalesce("_template", F.raise_error(F.lit("no features are declared for a run")))
    else:
        template = F.lit(templates.first()["template"])  # one text
    return asked.withColumn("mode", F.lit(mode)).withColumn("prompt", render_prompt(template, F.lit(mode), F.col("text_context"), custom)).drop("_template")


def available_contexts(results: DataFrame, task: str = "both") -> tuple[DataFrame, DataFrame]:
    """(OCR models with page results, (OCR model, crop source) pairs with crop results)."""
    whole = results.filter((F.col("task") == "all") & (F.col("label") == "full")).select("ocr_model").distinct()
    tasks = ["tables", "dimensions"] if task == "both" else [task]
    source = crop_source_name(F.col("label"))
    crops = (
        results.filter(F.col("task").isin(tasks) & source.isNotNull())
        .select("ocr_model", source.alias("crop_detector"))
        .distinct()
    )
    return whole, crops


def crop_listing(results: DataFrame, label: str = "crop") -> DataFrame:
    """Every crop of a drawing with text, confidence, box and file name."""
    rows = ocr_rows(results.filter(F.col("label") == label))
    name = F.format_string("crop_%03d.jpg", F.col("det_id"))
    return rows.select("image", "task", "ocr_model", F.col("det_id").alias("id"), "text", "confidence", "bbox",
                       F.concat_ws("/", F.lit(label), "task", "image", name).alias("path"))


def ocr_run_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share of detections with text, mean confidence and number of patches."""
    from ..functions.text import has_text

    return rows.groupBy(*keys).agg(
        F.avg(has_text(F.col("text")).cast("double")).alias("coverage"),
        F.avg(F.coalesce("confidence", F.lit(0.0))).alias("avg_confidence"),
        F.count(F.lit(1)).alias("total_patches"),
    )
