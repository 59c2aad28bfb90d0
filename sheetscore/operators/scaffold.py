"""New annotation records and clean-up of saved ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import place, round_box
from ..functions.numbers import no_value
from ..functions.text import has_text, stem
from ..schemas import FEATURE, META, REGION
from ..session import cut

# What a record starts with.
META_DEFAULT = {"standard": "unknown", "source_type": "unknown", "clutter": "med", "has_gdt": False, "difficulty": "med"}


def meta_default() -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in META_DEFAULT.items()]).cast(META)


def blank_features(schema: list[dict]) -> Column:
    """Every declared field without a value."""
    blank = F.struct(no_value().alias("value"), F.lit("").alias("text"), F.lit(None).cast("array<double>").alias("bbox"))
    return F.map_from_arrays(
        F.array(*[F.lit(f["name"]) for f in schema]), F.array(*[blank for _ in schema])
    ).cast(f"map<string,{FEATURE}>")


def resolve_ids(requests: DataFrame, images: DataFrame) -> DataFrame:
    """Each requested id to exactly one image.

    requests (req); images (image_id, file_name, extra_name). An exact name
    wins over a prefix; more than one candidate of the winning kind is
    ambiguous. Prefixes are cut to the lengths that were asked for and
    joined by equality. -> (req, outcome, image_id)
    """
    asked = requests.select("req", stem(F.col("req")).alias("name")).distinct()
    lengths = [r["n"] for r in asked.select(F.length("name").alias("n")).distinct().collect()]  # a few small numbers
    names = images.select(
        "image_id",
        F.explode(F.array_distinct(F.array_compact(F.array(stem(F.col("file_name")), F.nullif(stem(F.col("extra_name")), F.lit("")))))).alias("full"),
    )
    cuts = names.select(
        "image_id",
        "full",
        F.explode(
            F.transform(
                F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("full")),
                lambda n: F.substring("full", F.lit(1), n),
            )
        ).alias("name"),
    )
    hits = (
        asked.join(cuts, "name")
        .groupBy("req", "image_id")
        .agg(F.max(F.col("full") == F.col("name")).alias("exact"))
        .groupBy("req")
        .agg(
            F.count_if("exact").alias("n_exact"),
            F.count(F.lit(1)).alias("n_all"),
            F.min(F.when(F.col("exact"), F.col("image_id"))).alias("exact_id"),
            F.min("image_id").alias("any_id"),
        )
    )
    out = asked.join(hits, "req", "left")
    one = (F.col("n_exact") == 1) | ((F.col("n_exact") == 0) & (F.col("n_all") == 1))
    return out.select(
        "req",
        F.when(F.col("n_all").isNull(), "missing").when(one, "matched").otherwise("ambiguous").alias("outcome"),
        F.when(one, F.coalesce("exact_id", "any_id")).alias("image_id"),
    )


def carry_text(new_regions: DataFrame, prior: DataFrame) -> DataFrame:
    """Give new boxes the text an earlier annotation had at the same place.

    prior (image, source, pos, bbox, text): lower `source` wins, then position.
    Both sides move once, by image; earlier rows come before the new ones of their place.
    """
    at = place(F.col("bbox"), 1)
    earlier = prior.filter(has_text(F.col("text"))).select(
        "image", at.alias("_at"), F.lit(False).alias("_new"), F.col("source").alias("_source"), F.col("pos").alias("_pos"), F.col("text").alias("_text")
    )
    rows = new_regions.withColumns({"_at": at, "_new": F.lit(True)}).unionByName(earlier, allowMissingColumns=True)
    so_far = (
        Window.partitionBy("image", "_at").orderBy("_new", "_source", "_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    known = F.col("image").isNotNull() & F.col("_at").isNotNull()
    return (
        rows.repartition("image")
        .withColumn("_text", F.first("_text", ignorenulls=True).over(so_far))
        .filter("_new")
        .withColumn("text", F.coalesce(F.when(known, F.col("_text")), F.lit("")))
        .drop("_at", "_new", "_source", "_pos", "_text")
    )


def scaffold_records(images: DataFrame, boxes: DataFrame, prior: DataFrame, schema: list[dict], legacy: DataFrame | None = None) -> DataFrame:
    """Annotation rows for the chosen images; earlier work is never lost.

    images (image, image_id, width, height) with NULL image_id when nothing was
    resolved; boxes (image_id, id, class, bbox); prior and legacy are annotation
    tables. Resolved images get their boxes pre-filled; text at the same place,
    table regions, features and meta are kept from before.
    """
    new = (
        images.filter(F.col("image_id").isNotNull())
        .select("image", "image_id")
        .join(boxes, "image_id")
        .select("image", "id", F.coalesce("class", F.lit("dimension")).alias("class"), round_box(F.col("bbox"), 2).alias("bbox"))
    )
    earlier = None
    for rank, table in enumerate(x for x in (prior, legacy) if x is not None):
        rows = table.select("image", F.lit(rank).alias("source"), F.posexplode("regions").alias("pos", "r"))
        rows = rows.select("image", "source", "pos", "r.bbox", "r.text")
        earlier = rows if earlier is None else earlier.unionByName(rows)
    region = F.struct(
        F.lit(None).cast("int").alias("id"), "class", "bbox", "text",
        F.lit(None).cast("array<string>").alias("cells"), F.lit(None).alias("parsed"),
    ).cast(REGION)
    # an image's regions form one record by definition of the format; what each step has shuffled goes before the next
    filled = cut(carry_text(cut(new), earlier).groupBy("image").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("id", region.alias("r")))), lambda x: x["r"]).alias("_new")
    ))
    kept = prior.select(
        "image",
        F.filter("regions", lambda r: r["class"] == "table").alias("_tables"),
        F.col("features").alias("_features"),
        F.col("meta").alias("_meta"),
    )
    none = F.array().cast(f"array<{REGION}>")
    regions = F.transform(
        F.concat(F.coalesce("_new", none), F.coalesce("_tables", none)), lambda r, i: r.withField("id", i)
    )
    features = F.when(F.size("_features") > 0, F.col("_features")).otherwise(blank_features(schema))
    return (
        images.join(filled, "image", "left")
        .join(kept, "image", "left")
        .select(
            "image", "width", "height",
            F.coalesce("_meta", meta_default()).alias("meta"),
            regions.alias("regions"),
            features.alias("features"),
        )
    )


def missing_records(wanted: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """The per-task form: rows that exist already are skipped unless forced."""
    return wanted if force else wanted.join(existing.select("image"), "image", "left_anti")


def canonical_record(saved: DataFrame) -> DataFrame:
    """What is stored on save: ids by position, whole-pixel boxes, cells for tables only."""

    def region(r: Column, i: Column) -> Column:
        cls = F.coalesce(r["class"], F.lit("dimension"))
        box = F.slice(F.coalesce(r["bbox"], F.array(*[F.lit(0.0)] * 4)), 1, 4)
        return F.struct(
            i.alias("id"),
            cls.alias("class"),
            F.transform(box, lambda v: F.bround(v, 0)).alias("bbox"),
            F.coalesce(r["text"], F.lit("")).alias("text"),
            F.when(cls == "table", F.coalesce(r["cells"], F.array().cast("array<string>"))).alias("cells"),
            F.lit(None).alias("parsed"),
        ).cast(REGION)

    return saved.withColumns(
        {
            "image": F.trim("image"),
            "status": F.when(F.col("status") == "draft", "draft").otherwise("complete"),
            "meta": F.coalesce("meta", meta_default()),
            "regions": F.transform("regions", region),
            "features": F.transform_values(
                "features",
                lambda _, f: F.struct(
                    f["value"].alias("value"), F.coalesce(f["text"], F.lit("")).alias("text"), f["bbox"].alias("bbox")
                ).cast(FEATURE),
            ),
        }
    )
