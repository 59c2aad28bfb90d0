"""One query per operator, over its whole table with production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, shared_folder
from .decontaminate import contaminated
from .fill_middle import fill_in_middle, restored
from .html_extract import extract_text
from .language import identify, train
from .licenses import license_scan
from .line_dedup import line_dedup
from .neighbours import nearest_neighbours
from .packing import pack_documents
from .simhash import simhash_groups
from .spelling import spelling_variants
from .suffix_dedup import suffix_dedup
from .token_files import read_token_files, write_token_files
from .urls import url_verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    """Registers a function of (the table, a reader of further tables)."""

    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
            return build(read(table), read)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query(
    "op1_line_dedup",
    "documents",
    """
WITH lines AS (
  SELECT doc_id, text, lang, source, n_chars, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents
), windows AS (
  SELECT doc_id, s, l[s] || chr(10) || l[s + 1] || chr(10) || l[s + 2] AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS s FROM lines WHERE len(l) >= 3)
), counted AS (
  SELECT doc_id, s, trim(w, chr(32) || chr(9) || chr(10) || chr(13)) = '' AS blank,
         row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS nth
  FROM windows
), covered AS (
  SELECT DISTINCT doc_id, s + k AS p FROM counted, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1 AND NOT blank
), spans AS (
  SELECT doc_id, list(p) AS gone, count(*) AS n_removed,
         count(*) FILTER (WHERE before IS NULL OR before < p - 1) AS n_spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM covered) GROUP BY doc_id
)
SELECT doc_id,
       CASE WHEN gone IS NULL THEN text
            ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]), chr(10)), '') END AS text,
       lang, source, n_chars, CAST(len(l) AS BIGINT) AS n_lines,
       coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans
FROM lines LEFT JOIN spans USING (doc_id)
""",
)
def op1(docs, read):
    return line_dedup(docs)


@query("op10_simhash", "documents")
def op10(docs, read):
    return simhash_groups(docs)


@query("op3_best_fit_packing", "documents")
def op3(docs, read):
    return pack_documents(docs)


@query("op5_token_files", "documents")
def op5(docs, read):
    folder = shared_folder(docs.sparkSession)
    write_token_files(docs, folder)
    return read_token_files(docs.sparkSession, folder, with_ids=False)


@query("op2_suffix_dedup", "documents")
def op2(docs, read):
    return suffix_dedup(docs).drop("spans")


@query("op6_language", "documents")
def op6(docs, read):
    return identify(docs, train(docs))


@query("op8_decontamination", "documents")
def op8(docs, read):
    return contaminated(docs, read("benchmark"))


@query("op9_url_verdicts", "pages")
def op9(docs, read):
    return url_verdicts(docs).drop("words")


@query("op4_license_scan", "documents")
def op4(docs, read):
    return license_scan(docs)


@query("op7_nearest_neighbours", "embeddings")
def op7(rows, read):
    return nearest_neighbours(rows)


@query("op11_spelling_variants", "documents")
def op11(docs, read):
    return spelling_variants(docs)


@query(
    "op12_fill_in_middle",
    "documents",
    """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
  SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS UBIGINT) % (n + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS UBIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS UBIGINT) % 100 AS d
  FROM drawn
), formed AS (
  SELECT doc_id, t, n, CAST(least(a, b) AS BIGINT) AS p, CAST(greatest(a, b) AS BIGINT) AS q,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), parts AS (
  SELECT *, '<P>' || substr(t, 1, p) AS prefix, '<M>' || substr(t, p + 1, q - p) AS middle, '<S>' || substr(t, q + 1) AS suffix FROM formed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN prefix || suffix || middle ELSE suffix || prefix || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
""",
)
def op12(docs, read):
    made = fill_in_middle(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"),
    )


@query("op13_html_text", "pages")
def op13(pages, read):
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))
