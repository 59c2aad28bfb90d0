"""Key queries: an order is an annotated drawing, its lines are regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import number_value, text_value
from ..operators.coco import class_index, coco_documents, drop_category, remap_categories, yolo_rows
from ..operators.keys import (
    annotation_counts, annotation_coverage, box_key, category_counts, detection_truth, field_key, images_without_table, parsed_dimensions,
    present_fields, text_key,
)
from ..operators.scaffold import canonical_record, carry_text, missing_records, resolve_ids, scaffold_records
from ..schemas import FEATURE, FEATURE_SCHEMA, META, REGION
from .box_queries import SIZES
from .registry import Source, query, with_inputs

REGIONS = """
SELECT CAST(l_orderkey AS STRING) AS image, l_orderkey AS k,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS pos,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'table' ELSE 'dimension' END AS class,
  CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_quantity + 0.26 END AS x, CASE WHEN l_linenumber = 7 THEN 0.0 ELSE CAST(l_suppkey AS DOUBLE) END AS y,
  CASE WHEN l_linenumber = 7 THEN 0.0 ELSE l_quantity END AS w, CASE WHEN l_linenumber = 7 THEN 0.0 ELSE CAST(l_partkey % 31 + 10 AS DOUBLE) END AS h,
  CASE WHEN l_partkey % 6 = 0 THEN '  ' WHEN l_partkey % 6 = 1 THEN NULL ELSE CONCAT(' dia ', CAST(l_quantity AS STRING), ' ') END AS text
FROM {lineitem}"""
STATUS = "CASE WHEN k % 10 = 0 THEN 'draft' WHEN k % 10 = 1 THEN NULL ELSE 'complete' END"
LIVE = f"({STATUS}) IS DISTINCT FROM 'draft'"
BOX = "x <> 0 OR y <> 0 OR w <> 0 OR h <> 0"
TEXT = "trim(coalesce(text, ''))"


def annotations(s: Source) -> DataFrame:
    region = F.struct(
        F.col("pos").cast("int").alias("id"), "class", F.array("x", "y", "w", "h").alias("bbox"), "text",
        F.lit(None).cast("array<string>").alias("cells"), F.lit(None).alias("parsed"),
    ).cast(REGION)
    rows = s.sql(REGIONS).groupBy("image", "k").agg(F.sort_array(F.collect_list(F.struct("pos", region.alias("r")))).alias("_r"))

    def feature(v):
        return F.struct(v.alias("value"), F.lit("").alias("text"), F.lit(None).cast("array<double>").alias("bbox")).cast(FEATURE)

    features = F.create_map(
        F.lit("length"), feature(F.when(F.col("k") % 4 > 0, number_value(F.col("k")))),
        F.lit("material"), feature(text_value(F.when(F.col("k") % 3 == 0, "").otherwise("Steel"))),
    )
    return rows.select(
        "image", F.concat(F.lpad("image", 12, "0"), F.lit(".json")).alias("path"),
        F.lit(1000).alias("width"), F.lit(800).alias("height"), F.expr(STATUS).alias("status"), F.lit(None).cast(META).alias("meta"),
        F.transform("_r", lambda e: e["r"]).alias("regions"), features.alias("features"), "k",
    )


IMAGES = f"images AS (SELECT image, k, row_number() OVER (ORDER BY lpad(image, 12, '0')) - 1 AS image_id FROM (SELECT DISTINCT image, k FROM r) AS d)"
BOXES = f"""{IMAGES}, boxes AS (SELECT row_number() OVER (ORDER BY i.image_id, r.pos) - 1 AS id, i.image_id, r.image, r.pos,
CASE WHEN r.class = 'table' THEN 2 ELSE 1 END AS category_id, x, y, w, h, CAST(printf('%.2f', w * h) AS DOUBLE) AS area
FROM r JOIN images i USING (image) WHERE ({LIVE.replace('k %', 'r.k %')}) AND ({BOX}))"""


def _keys(body: str, more: str = "") -> str:
    return with_inputs("", r=REGIONS) + more + body


@query("key_images", _keys(f" SELECT image_id, image, CAST(1000 AS BIGINT) AS width, CAST(800 AS BIGINT) AS height FROM images WHERE {LIVE}", "," + IMAGES))
def key_images(s: Source):
    return box_key(annotations(s))[0]


@query("key_boxes", _keys(" SELECT id, image_id, image, pos, CAST(category_id AS BIGINT) AS category_id, x, y, w, h, area FROM boxes", "," + BOXES))
def key_boxes(s: Source):
    boxes = box_key(annotations(s))[1]
    return boxes.select("id", "image_id", "image", "pos", "category_id", *[F.col("bbox")[i].alias(c) for i, c in enumerate("xywh")], "area")


@query("category_counts", _keys(" SELECT CAST(category_id AS BIGINT) AS category_id, count(*) AS n FROM boxes GROUP BY ALL", "," + BOXES))
def categories(s: Source):
    return category_counts(box_key(annotations(s))[1])


@query("detection_truth", _keys(f" SELECT image, class, pos AS gt_idx, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM r WHERE {LIVE} AND class IN ('table', 'dimension')"))
def truth(s: Source):
    return detection_truth(annotations(s))


for _name, _task, _class in (("key_dimension_texts", "dimensions", "coalesce(class, 'dimension') = 'dimension'"), ("key_table_texts", "tables", "class = 'table'"), ("key_whole_texts", None, "TRUE")):
    query(_name, _keys(f" SELECT image, pos AS gt_idx, {TEXT} AS text FROM r WHERE {LIVE} AND {_class} AND {TEXT} <> ''"))(
        lambda s, task=_task: text_key(annotations(s), task)
    )


@query("key_fields", _keys(f""" SELECT image, f.field, CASE WHEN f.field = 'length' AND k % 4 > 0 THEN CAST(k AS VARCHAR) WHEN f.field = 'material' AND k % 3 <> 0 THEN 'Steel' END AS value
FROM (SELECT DISTINCT image, k FROM r WHERE {LIVE}) AS d, (SELECT unnest(['length', 'material']) AS field) AS f"""))
def fields(s: Source):
    return field_key(annotations(s)).select("image", F.explode("fields").alias("field", "v")).select("image", "field", F.col("v.text").alias("value"))


@query("present_fields", _keys(f" SELECT f.field, count(*) FILTER (CASE WHEN f.field = 'length' THEN k % 4 > 0 ELSE k % 3 <> 0 END) AS n FROM (SELECT DISTINCT image, k FROM r WHERE {LIVE}) AS d, (SELECT unnest(['length', 'material']) AS field) AS f GROUP BY ALL"))
def present(s: Source):
    return present_fields(field_key(annotations(s)))


@query("key_parsed_dimensions", _keys(f" SELECT image, pos, {TEXT} AS text, 'diam' AS symbol, CAST(regexp_extract(text, '[0-9.]+') AS DOUBLE) AS value FROM r WHERE {LIVE} AND coalesce(class, 'dimension') = 'dimension' AND {TEXT} <> ''"))
def dimensions(s: Source):
    return parsed_dimensions(annotations(s)).select("image", "pos", "text", "parsed.symbol", "parsed.value")


@query("annotation_coverage", _keys(f""" SELECT count(*) AS images, count(*) FILTER (d > 0) AS images_with_dimension, count(*) FILTER (t > 0) AS images_with_table,
CAST(sum(d) AS BIGINT) AS dimension_regions, CAST(sum(dt) AS BIGINT) AS dimension_texts, CAST(sum(t) AS BIGINT) AS table_regions, CAST(sum(tt) AS BIGINT) AS table_texts,
count(*) * 2 AS features_total, CAST(sum(f) AS BIGINT) AS features_filled, count(*) FILTER (f > 0) AS images_with_features
FROM (SELECT image, count(*) FILTER (class = 'dimension') AS d, count(*) FILTER (class = 'table') AS t, count(*) FILTER (class = 'dimension' AND {TEXT} <> '') AS dt,
count(*) FILTER (class = 'table' AND {TEXT} <> '') AS tt, (k % 4 > 0)::INT + (k % 3 <> 0)::INT AS f FROM r GROUP BY image, k) AS q"""))
def coverage(s: Source):
    return annotation_coverage(annotations(s))


@query("annotation_counts", _keys(f""" SELECT r.image, count(*) AS regions, count(*) FILTER ({TEXT} <> '') AS with_text, CAST((k % 4 > 0)::INT + (k % 3 <> 0)::INT AS BIGINT) AS features,
coalesce({STATUS}, 'complete') AS status, bool_or(o.o_orderkey IS NOT NULL) AS has_image FROM r LEFT JOIN orders o ON o.o_orderkey = r.k GROUP BY r.image, k"""))
def counts(s: Source):
    return annotation_counts(annotations(s), s.sql(SIZES))


@query("images_without_table", _keys(" SELECT image FROM r GROUP BY image HAVING count(*) FILTER (class = 'dimension') > 0 AND count(*) FILTER (class = 'table') = 0"))
def no_table(s: Source):
    return images_without_table(annotations(s))


@query("canonical_record", _keys(f""" SELECT image, CASE WHEN {STATUS} = 'draft' THEN 'draft' ELSE 'complete' END AS status, pos AS id, coalesce(class, 'dimension') AS class,
round_even(x, 0) AS x, round_even(w, 0) AS w, coalesce(text, '') AS text, class IS NOT DISTINCT FROM 'table' AS has_cells, 'unknown' AS standard FROM r"""))
def canonical(s: Source):
    rows = canonical_record(annotations(s)).select("image", "status", F.col("meta.standard").alias("standard"), F.explode("regions").alias("r"))
    return rows.select("image", "status", "r.id", "r.class", F.col("r.bbox")[0].alias("x"), F.col("r.bbox")[2].alias("w"), "r.text", F.col("r.cells").isNotNull().alias("has_cells"), "standard")


@query("coco_documents", _keys(f""" SELECT id // 5000 AS document, count(*) AS n_boxes, count(DISTINCT image_id) AS n_images, CAST(sum(id) AS BIGINT) AS ids, CAST(2 AS BIGINT) AS n_categories FROM boxes GROUP BY ALL""", "," + BOXES))
def documents(s: Source):
    """The documents are read back, so that the text itself is checked; boxless images are left out of the counts."""
    a = annotations(s)
    images, boxes = box_key(a)
    classes = s.spark.createDataFrame([(1, "dimension"), (2, "table")], "id int, name string")
    docs = coco_documents(images, boxes, classes, boxes_per_document=5000)
    parsed = F.from_json("json", "categories array<struct<id:int>>, images array<struct<id:bigint>>, annotations array<struct<id:bigint,image_id:bigint>>")
    d = docs.select("document", parsed.alias("d"))
    return d.filter(F.size("d.annotations") > 0).select(
        "document", F.size("d.annotations").alias("n_boxes"), F.size(F.array_distinct(F.transform("d.annotations", lambda x: x["image_id"]))).alias("n_images"),
        F.aggregate("d.annotations", F.lit(0).cast("bigint"), lambda acc, x: acc + x["id"]).alias("ids"), F.size("d.categories").alias("n_categories"),
    )


COCO = """
SELECT event_id AS id, user_id AS image_id, CAST(event_id % 5 AS INT) AS category_id, value AS x, CAST(user_id AS DOUBLE) AS y, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS w, CAST(event_id % 40 + 1 AS DOUBLE) AS h FROM {events}"""
CATS = "(VALUES (0, 'Table', 0), (1, 'table', 1), (2, 'New-Drawings', 2), (3, 'dimension', 3), (4, 'DIMENSION', 4)) AS c(id, name, pos)"


def _coco(s: Source):
    cats = s.spark.createDataFrame([(0, "Table", 0), (1, "table", 1), (2, "New-Drawings", 2), (3, "dimension", 3), (4, "DIMENSION", 4)], "id int, name string, pos int")
    boxes = s.sql(COCO).select("id", "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"))
    images = boxes.select(F.col("image_id").alias("id")).distinct().select(
        "id", F.concat(F.lit("scans/img."), "id", F.lit(".png")).alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return cats, boxes, images


@query("remap_categories", with_inputs("SELECT id, CASE category_id WHEN 1 THEN 0 WHEN 4 THEN 3 ELSE category_id END::BIGINT AS category_id FROM b", b=COCO))
def remapped(s: Source):
    cats, boxes, _ = _coco(s)
    return remap_categories(cats, boxes)[1].select("id", "category_id")


@query("drop_category", with_inputs("SELECT id, category_id::BIGINT AS category_id FROM b WHERE category_id <> 2", b=COCO))
def dropped(s: Source):
    cats, boxes, _ = _coco(s)
    return drop_category(cats, boxes, "New-Drawings")[1].select("id", "category_id")


@query("yolo_lines", with_inputs("""SELECT concat('img.', image_id) AS stem, id,
printf('%d %.6f %.6f %.6f %.6f', category_id, (x + w / 2) / 640, (y + h / 2) / 480, w / 640, h / 480) AS line FROM b WHERE w > 0 AND h > 0""", b=COCO))
def yolo(s: Source):
    cats, boxes, images = _coco(s)
    return yolo_rows(images, boxes, class_index(cats).drop("class_index")).drop("label_path")


REQUESTS = "SELECT CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN SUBSTRING(c_name, 1, 17) ELSE CONCAT(c_name, 'x') END AS req FROM {customer}"
NAMES = "SELECT c_custkey AS image_id, CONCAT('in/', c_name, '.png') AS file_name, CASE WHEN c_custkey % 4 = 0 THEN CONCAT(c_name, 'x.jpg') ELSE NULL END AS extra_name FROM {customer}"


@query("resolve_ids", with_inputs("""SELECT q.req, CASE WHEN ne = 1 OR (ne = 0 AND na = 1) THEN 'matched' WHEN na = 0 THEN 'missing' ELSE 'ambiguous' END AS outcome,
CASE WHEN ne = 1 THEN ei WHEN ne = 0 AND na = 1 THEN ai END AS image_id FROM (
SELECT q.req, count(*) FILTER (hit AND e) AS ne, count(*) FILTER (hit) AS na, min(image_id) FILTER (hit AND e) AS ei, min(image_id) FILTER (hit) AS ai FROM (
SELECT q.req, n.image_id, n.a = q.req OR coalesce(n.b = q.req, FALSE) AS e, starts_with(n.a, q.req) OR coalesce(starts_with(n.b, q.req), FALSE) AS hit
FROM (SELECT DISTINCT req FROM q) q, (SELECT image_id, regexp_extract(file_name, 'in/(.*)\\.png', 1) AS a, regexp_extract(extra_name, '(.*)\\.jpg', 1) AS b FROM n) n) AS q GROUP BY q.req) AS q""", q=REQUESTS, n=NAMES))
def resolved(s: Source):
    return resolve_ids(s.sql(REQUESTS), s.sql(NAMES))


PRIOR = f"SELECT image, 0 AS source, pos, x + 0.02 AS x, y, w, h, text FROM ({REGIONS}) AS r UNION ALL SELECT image, 1 AS source, pos, x, y, w, h, CONCAT('old ', pos) AS text FROM ({REGIONS}) AS r"


@query("carry_text", with_inputs("", r=REGIONS, p=PRIOR) + """, kept AS (
SELECT image, concat_ws(',', printf('%.1f', x), printf('%.1f', y), printf('%.1f', w), printf('%.1f', h)) AS at, arg_min(text, (source, pos)) AS t FROM p WHERE trim(coalesce(text, '')) <> '' GROUP BY ALL)
SELECT r.image, r.pos, coalesce(k.t, '') AS text FROM r LEFT JOIN kept k ON k.image = r.image AND k.at = concat_ws(',', printf('%.1f', r.x), printf('%.1f', r.y), printf('%.1f', r.w), printf('%.1f', r.h))""")
def carried(s: Source):
    new = s.sql(REGIONS).select("image", "pos", F.array("x", "y", "w", "h").alias("bbox"))
    # the rows of PRIOR, with the lines numbered once for both sources
    moved = F.struct(F.lit(0).alias("source"), F.array(F.col("x") + 0.02, "y", "w", "h").alias("bbox"), "text")
    kept = F.struct(F.lit(1).alias("source"), F.array("x", "y", "w", "h").alias("bbox"), F.concat(F.lit("old "), "pos").alias("text"))
    old = s.sql(REGIONS).select("image", "pos", F.explode(F.array(moved, kept)).alias("r")).select("image", "r.source", "pos", "r.bbox", "r.text")
    return carry_text(new, old).select("image", "pos", "text")


@query("scaffold_records", with_inputs("", r0=REGIONS, s=SIZES) + f""", r AS (SELECT *, bool_or({TEXT} <> '') OVER (PARTITION BY image, x, y, w, h) AS found FROM r0)
SELECT s.image, coalesce(count(r.image), 0) + count(r.image) FILTER (r.class = 'table') AS n_regions, CAST(CASE WHEN count(r.image) > 0 THEN 2 ELSE 15 END AS BIGINT) AS n_features,
count(r.image) FILTER (found) + count(r.image) FILTER (r.class = 'table' AND {TEXT} <> '') AS n_texts
FROM s LEFT JOIN r USING (image) GROUP BY s.image""")
def scaffolded(s: Source):
    """Every order becomes a record; lines are both its resolved boxes and its earlier annotation.; equal places share their text."""
    images = s.sql(SIZES).withColumn("image_id", F.col("image"))
    boxes = s.sql(REGIONS).select(F.col("image").alias("image_id"), F.col("pos").alias("id"), "class", F.array("x", "y", "w", "h").alias("bbox"))
    out = scaffold_records(images, boxes, annotations(s), FEATURE_SCHEMA)
    filled = F.filter("regions", lambda r: F.trim(F.coalesce(r["text"], F.lit(""))) != "")
    return out.select("image", F.size("regions").alias("n_regions"), F.size("features").alias("n_features"), F.size(filled).alias("n_texts"))


@query("missing_records", with_inputs("SELECT image FROM s WHERE image NOT IN (SELECT image FROM r)", r=REGIONS, s=SIZES))
def missing(s: Source):
    return missing_records(s.sql(SIZES), annotations(s)).select("image")
