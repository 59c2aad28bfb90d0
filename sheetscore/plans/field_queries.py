"""Field queries: an order is a drawing, its columns are the fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import VALUE, coerce_value, list_value, number_value, text_value, verdict
from ..functions.replies import norm_usage
from ..operators.fields import (
    best_mode, compare_modes, field_scores, fill_rate, first_per_image, image_scores, per_field_accuracy, resource_usage, score_fields,
)
from .registry import Source, query, r6, with_inputs

# An order becomes six results of five tagged values each.
ORDERS_PER_TASK = 50_000
FIELDS = ("price", "holes", "priority", "customer", "status")
GT = """
SELECT CAST(o_orderkey AS STRING) AS image,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey % 5 AS STRING) END AS h1,
       CAST(o_custkey % 7 AS STRING) AS h2, CAST(o_orderkey % 3 AS STRING) AS h3,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority,
       CONCAT(CAST(o_custkey AS STRING), ',25') AS customer,
       CAST(NULL AS STRING) AS status
FROM {orders}
"""
# three modes; the first result of some images is an error and the next one counts
RESULTS = """
SELECT 'r1' AS run_id, mode, CAST(o_orderkey AS STRING) AS image, seq,
       CASE WHEN o_orderkey % 50 = 0 AND seq = 1 THEN 'timeout' ELSE NULL END AS error,
       CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_totalprice * (1 + (o_orderkey % 5 - 1) * scale / 100) END AS price,
       CASE WHEN (o_orderkey + seq) % 17 = 0 THEN NULL ELSE CAST((o_custkey + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) % 5 AS STRING) END AS h1,
       CAST(o_custkey % 7 AS STRING) AS h2, CAST(o_orderkey % 3 AS STRING) AS h3,
       CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 6 = 1 THEN 'unknown' ELSE CONCAT(' ', LOWER(o_orderpriority), '  ') END AS priority,
       CASE WHEN o_custkey % 8 = 0 THEN 'none' ELSE CAST(o_custkey + seq - 1 AS STRING) END AS customer,
       CASE WHEN o_orderkey % 3 = scale THEN o_orderstatus ELSE NULL END AS status,
       o_custkey AS tokens_in, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey % 500 END AS tokens_out
FROM (SELECT *, CASE mode WHEN 'whole_image' THEN 1 WHEN 'whole_image_ocr' THEN 0 ELSE 2 END AS scale
      FROM (SELECT *, EACH('whole_image', 'whole_image_ocr', 'cropped_ocr') AS mode FROM (SELECT *, EACH(1, 2) AS seq FROM {orders}) AS a) AS b) AS c
"""


def _map(df: DataFrame, holes, keep: list[str]) -> DataFrame:
    values = {"price": number_value(F.col("price")), "holes": holes, "priority": text_value(F.col("priority")),
              "customer": text_value(F.col("customer")), "status": text_value(F.col("status"))}
    entries = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return df.select(*keep, entries.cast(f"map<string,{VALUE}>").alias("fields"))


def answer_key(s: Source) -> DataFrame:
    """Lists where the first hole is known, nothing otherwise."""
    holes = F.when(F.col("h1").isNotNull(), list_value(F.array("h1", "h2", "h3")))
    return _map(s.sql(GT, heavy=True, rows=ORDERS_PER_TASK), holes, ["image"])


def results(s: Source) -> DataFrame:
    """Lists arrive in another order, as arrays or as text."""
    reply = (
        F.when(F.col("h1").isNull(), F.lit(None).cast(VALUE))
        .when(F.col("seq") == 1, list_value(F.array("h3", "h1", "h2")))
        .otherwise(text_value(F.concat_ws(", ", "h2", "h3", "h1")))
    )
    usage = F.struct(
        (F.col("tokens_in") / 100).alias("latency_s"), F.col("tokens_in").alias("input_tokens"), F.col("tokens_out").alias("output_tokens"),
        (F.col("tokens_in") + F.col("tokens_out")).alias("total_tokens"), (F.col("tokens_in") / 1000).alias("cost_usd"),
    ).alias("usage")
    return _map(s.sql(RESULTS, heavy=True, rows=ORDERS_PER_TASK), reply, ["run_id", "mode", "image", "seq", "error", usage])


SCORED = """
firsts AS (SELECT run_id, mode, image, min(seq) AS seq FROM res WHERE error IS NULL GROUP BY ALL),
p AS (SELECT r.* FROM res r JOIN firsts f USING (run_id, mode, image, seq)),
rows AS (
  SELECT p.run_id, p.mode, image, 'price' AS field, gt.price AS gn, NULL AS gs, p.price AS pn, NULL AS ps, gt.price IS NOT NULL AS has, p.price IS NOT NULL AS got FROM p JOIN gt USING (image)
  UNION ALL SELECT p.run_id, p.mode, image, 'customer', CAST(replace(gt.customer, ',', '.') AS DOUBLE), NULL, try_cast(p.customer AS DOUBLE), NULL, TRUE, TRUE FROM p JOIN gt USING (image)
  UNION ALL SELECT p.run_id, p.mode, image, 'priority', NULL, lower(gt.priority), NULL, trim(p.priority), gt.priority IS NOT NULL, p.priority <> '' FROM p JOIN gt USING (image)
  UNION ALL SELECT p.run_id, p.mode, image, 'status', NULL, NULL, NULL, p.status, FALSE, p.status IS NOT NULL FROM p JOIN gt USING (image)
  UNION ALL SELECT p.run_id, p.mode, image, 'holes', NULL, CAST(list_sort([gt.h1, gt.h2, gt.h3]) AS VARCHAR), NULL, CAST(list_sort([p.h1, p.h2, p.h3]) AS VARCHAR), gt.h1 IS NOT NULL, p.h1 IS NOT NULL FROM p JOIN gt USING (image)
),
scored AS (
  SELECT run_id, mode, image, field,
    CASE WHEN NOT has THEN CASE WHEN got THEN 'hallucinated' ELSE 'abstained' END
         WHEN got AND CASE WHEN gn IS NOT NULL THEN coalesce(abs(pn - gn) <= greatest(0.5, 0.02 * abs(gn)), FALSE) ELSE ps = gs END THEN 'correct'
         WHEN NOT got THEN 'missed' ELSE 'wrong' END AS verdict,
    CASE WHEN has AND got AND gn IS NOT NULL AND pn IS NOT NULL THEN least(abs(pn - gn) / greatest(abs(gn), 1e-9), 2.0) END AS ape, has
  FROM rows),
img AS (
  SELECT run_id, mode, image, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong') AS wrong,
    count(*) FILTER (verdict = 'missed') AS missed, count(*) FILTER (verdict = 'hallucinated') AS hallucinated, count(*) FILTER (verdict = 'abstained') AS abstained,
    count(*) FILTER (has) AS present_fields, count(*) FILTER (NOT has) AS absent_fields, sum(ape) AS ape_sum, count(ape) AS numeric_scored
  FROM scored GROUP BY ALL),
tot AS (
  SELECT run_id, mode, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(wrong) AS BIGINT) AS wrong, CAST(sum(missed) AS BIGINT) AS missed,
    CAST(sum(hallucinated) AS BIGINT) AS hallucinated, CAST(sum(abstained) AS BIGINT) AS abstained, CAST(sum(present_fields) AS BIGINT) AS present_fields,
    CAST(sum(absent_fields) AS BIGINT) AS absent_fields, sum(ape_sum) AS ape_sum, CAST(sum(numeric_scored) AS BIGINT) AS numeric_scored,
    count(*) AS evaluated_images, count(*) FILTER (wrong + missed + hallucinated = 0) AS exact_images
  FROM img GROUP BY ALL)
"""


def _scored(body: str) -> str:
    return with_inputs("", gt=GT, res=RESULTS) + "," + SCORED + body


@query("field_scores", _scored("""
SELECT run_id, mode, correct, wrong, missed, hallucinated, abstained, evaluated_images, exact_images, numeric_scored,
  round(correct / present_fields, 6) AS field_accuracy, round(wrong / present_fields, 6) AS error_rate, round(missed / present_fields, 6) AS miss_rate,
  round(hallucinated / absent_fields, 6) AS hallucination_rate, round(ape_sum / numeric_scored, 6) AS numeric_mape,
  round((correct + abstained) / (present_fields + absent_fields), 6) AS overall_accuracy, round(exact_images / evaluated_images, 6) AS exact_match
FROM tot"""))
def scores(s: Source):
    out = field_scores(score_fields(answer_key(s), results(s)))
    return out.select(
        "run_id", "mode", "correct", "wrong", "missed", "hallucinated", "abstained", "evaluated_images", "exact_images", "numeric_scored",
        *r6("field_accuracy", "error_rate", "miss_rate", "hallucination_rate", "numeric_mape", "overall_accuracy", "exact_match"),
    )


@query("field_verdicts", _scored("SELECT run_id, mode, image, field, verdict, round(ape, 6) AS ape FROM scored"))
def verdicts(s: Source):
    return score_fields(answer_key(s), results(s)).select("run_id", "mode", "image", "field", "verdict", *r6("ape"))


@query("image_field_scores", _scored("""SELECT run_id, mode, image, correct, wrong, missed, hallucinated, abstained,
round(correct / nullif(present_fields, 0), 6) AS field_accuracy, round(hallucinated / nullif(absent_fields, 0), 6) AS hallucination_rate,
wrong + missed + hallucinated = 0 AS exact FROM img"""))
def per_image(s: Source):
    out = image_scores(score_fields(answer_key(s), results(s)))
    return out.select("run_id", "mode", "image", "correct", "wrong", "missed", "hallucinated", "abstained", *r6("field_accuracy", "hallucination_rate"), "exact")


@query("per_field_accuracy", _scored("""SELECT run_id, mode, field, count(*) FILTER (verdict = 'correct') AS correct, count(*) AS present,
round(count(*) FILTER (verdict = 'correct') / count(*), 6) AS accuracy FROM scored WHERE has GROUP BY ALL"""))
def per_field(s: Source):
    return per_field_accuracy(score_fields(answer_key(s), results(s))).select("run_id", "mode", "field", "correct", "present", *r6("accuracy"))


USAGE = """usage AS (SELECT run_id, mode, round(avg(tokens_in), 6) AS avg_input_tokens, round(avg(tokens_out), 6) AS avg_output_tokens,
round(avg(tokens_in + tokens_out), 6) AS avg_total_tokens, round(avg(tokens_in / 100), 6) AS avg_latency_s, round(sum(tokens_in / 1000), 4) AS total_cost_usd,
count(*) AS n_calls FROM res WHERE error IS NULL GROUP BY ALL)"""


def _usage(df: DataFrame) -> DataFrame:
    return df.select("run_id", "mode", *r6("avg_input_tokens", "avg_output_tokens", "avg_total_tokens", "avg_latency_s"),
                     F.round("total_cost_usd", 4).alias("total_cost_usd"), "n_calls")


@query("resource_usage", with_inputs("", res=RESULTS) + "," + USAGE + " SELECT * FROM usage")
def usage(s: Source):
    return _usage(resource_usage(results(s).filter(F.col("error").isNull())))


@query("compare_modes", _scored("") + "," + USAGE + """
SELECT t.run_id, t.mode, evaluated_images, round(correct / present_fields, 6) AS field_accuracy, avg_total_tokens, n_calls,
  correct / present_fields = max(correct / present_fields) OVER (PARTITION BY t.run_id) AS best
FROM tot t JOIN usage u USING (run_id, mode)""")
def modes(s: Source):
    out = best_mode(compare_modes(answer_key(s), results(s)))
    return out.select("run_id", "mode", "evaluated_images", *r6("field_accuracy", "avg_total_tokens"), "n_calls", "best")


@query("fill_rate", with_inputs("""
SELECT run_id, mode, count(*) * 5 AS total_fields,
  CAST(sum((price IS NOT NULL)::INT + (h1 IS NOT NULL)::INT + 2 + (status IS NOT NULL)::INT) AS BIGINT) AS filled_fields,
  round(sum((price IS NOT NULL)::INT + (h1 IS NOT NULL)::INT + 2 + (status IS NOT NULL)::INT) / (count(*) * 5), 6) AS fill_rate
FROM res WHERE error IS NULL GROUP BY ALL""", res=RESULTS))
def filled(s: Source):
    return fill_rate(results(s)).select("run_id", "mode", "total_fields", "filled_fields", *r6("fill_rate"))


@query("first_per_image", with_inputs("SELECT run_id, mode, image, arg_min(customer, seq) AS customer FROM res WHERE error IS NULL GROUP BY ALL", res=RESULTS))
def first(s: Source):
    return first_per_image(results(s), ["run_id", "mode"]).select("run_id", "mode", "image", F.col("fields")["customer"]["text"].alias("customer"))


ENTRIES = """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'list' WHEN 1 THEN 'number' WHEN 2 THEN 'integer' ELSE 'string' END AS kind,
  CASE o_orderkey % 4 WHEN 0 THEN CONCAT('d', CAST(o_custkey AS STRING), ',5; x ;', CAST(o_custkey % 10 AS STRING), ' mm')
    WHEN 1 THEN CASE WHEN o_custkey % 5 = 0 THEN '1,5' ELSE CAST(o_totalprice AS STRING) END
    WHEN 2 THEN CONCAT(CAST(o_custkey AS STRING), '.5') ELSE CASE WHEN o_custkey % 5 = 0 THEN '' ELSE o_orderpriority END END AS entry
FROM {orders}"""


@query("coerce_entries", with_inputs("""
SELECT o_orderkey, CASE WHEN entry = '' THEN NULL WHEN kind = 'list' THEN 'list' WHEN kind = 'number' AND entry <> '1,5' THEN 'num' WHEN kind = 'integer' THEN 'num' ELSE 'str' END AS kind,
  CASE WHEN kind = 'integer' THEN floor(CAST(entry AS DOUBLE) + 0.5) WHEN kind = 'number' AND entry <> '1,5' THEN CAST(entry AS DOUBLE) WHEN entry = '1,5' THEN 1.5 END AS num,
  CASE WHEN kind = 'list' THEN concat(regexp_extract(entry, 'd([0-9]+)', 1), '.5|x|', regexp_extract(entry, ';([0-9]) mm', 1), '.0') END AS items
FROM e""", e=ENTRIES))
def coerced(s: Source):
    v = coerce_value(F.col("entry"), F.col("kind"))
    rows = s.sql(ENTRIES).select("o_orderkey", v.alias("v"))
    return rows.select("o_orderkey", "v.kind", F.when(F.col("v.kind") != "list", F.when(~F.col("v.text").rlike("^[0-9]-"), F.col("v.num"))).alias("num"),
                       F.when(F.col("v.kind") == "list", F.array_join(F.transform("v.items", lambda i: i["text"]), "|")).alias("items"))


@query("token_usage", """SELECT event_id, user_id AS input_tokens, CAST(json_extract(props, '$.k') AS BIGINT) AS output_tokens,
CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) ELSE user_id + CAST(json_extract(props, '$.k') AS BIGINT) END AS total_tokens FROM events""")
def tokens_used(s: Source):
    k = F.get_json_object("props", "$.k").cast("bigint")
    total = F.when(F.col("event_type") == "view", F.floor("value").cast("bigint"))
    old, none = F.col("event_type") == "click", F.lit(None).cast("bigint")
    u = norm_usage(F.when(~old, F.col("user_id")), F.when(old, F.col("user_id")), F.when(~old, k), F.when(old, k), total)
    return s.table("events").select("event_id", u.alias("u")).select("event_id", "u.*")
