"""Text queries: lines and parts give callouts, parts give strings, chats and documents give pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import dims_equal, parse_normalized
from ..functions.numbers import first_number, numbers_equal
from ..functions.text import fold, normalize_text, tokens
from ..operators.strings import char_overlap, detection_cost, result_images, string_detail, string_scores, token_flags, whole_text_scores, word_overlap
from .registry import Source, query, r6, with_inputs

CALLOUTS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE l_linenumber % 7 WHEN 0 THEN CONCAT('R', CAST(l_quantity AS STRING)) WHEN 1 THEN CONCAT('DIA ', CAST(l_quantity AS STRING), ' +/- ', CAST(l_tax AS STRING), ' mm')
    WHEN 2 THEN CONCAT(CAST(l_quantity AS STRING), ' +', CAST(l_tax AS STRING), ' -', CAST(l_discount AS STRING))
    WHEN 3 THEN CONCAT(CAST(l_suppkey AS STRING), ',5  Degrees') WHEN 4 THEN CONCAT('Phi', ' ', CAST(l_suppkey AS STRING), ' IN')
    WHEN 5 THEN CONCAT('-', CAST(l_suppkey AS STRING)) ELSE CONCAT('  radius ', CAST(l_partkey AS STRING), 'mm ') END AS a,
  CASE l_linenumber % 7 WHEN 0 THEN CONCAT('rad ', CAST(l_quantity AS STRING)) WHEN 1 THEN CONCAT('diameter ', CAST(l_quantity + 0.25 AS STRING), '+-', CAST(l_tax AS STRING), ' MM')
    WHEN 2 THEN CONCAT(CAST(l_quantity + 2 AS STRING), ' +', CAST(l_tax AS STRING), ' -', CAST(l_discount AS STRING))
    WHEN 3 THEN CONCAT(CAST(l_suppkey AS STRING), '.5 deg') WHEN 4 THEN CONCAT('dia. ', CAST(l_suppkey AS STRING), ' in')
    ELSE CONCAT(CAST(l_suppkey AS STRING), ' mm') END AS b
FROM {lineitem}"""
ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
IDS = ", ".join(ID)


def _norm(c: str) -> str:
    for pattern, to in (("\\bdia\\b\\.?", " diam "), ("\\bphi\\b", " diam "), ("\\bdiameter\\b", " diam "), ("\\bradius\\b", " rad "), ("\\brad\\b\\.?", " rad ")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'gi')"
    # no look-ahead in this dialect: the digit is put back
    c = f"regexp_replace({c}, '\\br\\s*(\\d)', ' rad \\1', 'gi')"
    c = f"regexp_replace({c}, '\\bdegrees?\\b', ' deg ', 'gi')"
    c = f"regexp_replace(regexp_replace({c}, '\\s*\\+/-\\s*', '±', 'g'), '\\s*\\+-\\s*', '±', 'g')"
    return f"trim(regexp_replace(lower(replace({c}, ',', '.')), '\\s+', ' ', 'g'))"


def _parsed(n: str, to: str) -> str:
    num = lambda src, pattern, group: f"try_cast(nullif(regexp_extract({src}, '{pattern}', {group}), '') AS DOUBLE)"
    nominal = f"regexp_replace(regexp_replace({n}, '±\\s*\\d*\\.?\\d+', ' ', 'g'), '[+\\-]\\s*\\d*\\.?\\d+', ' ', 'g')"
    symbol = f"CASE WHEN contains({n}, 'diam') THEN 'diam' WHEN contains({n}, 'rad') THEN 'rad' WHEN contains({n}, 'deg') THEN 'deg' END"
    both = num(n, "±\\s*(\\d*\\.?\\d+)", 1)
    return f"""{symbol} AS {to}symbol, coalesce({num(nominal, '\\d*\\.?\\d+', 0)}, {num(n, '[-+]?\\d*[.,]?\\d+', 0)}) AS {to}value,
coalesce({both}, {num(n, '\\+\\s*(\\d*\\.?\\d+)', 1)}) AS {to}tol_plus, coalesce({both}, {num(n, '-\\s*(\\d*\\.?\\d+)', 1)}) AS {to}tol_minus,
coalesce(nullif(regexp_extract({n}, '\\b(mm|cm|m|in|inch|deg)\\b', 1), ''), CASE WHEN NOT contains({n}, 'diam') AND NOT contains({n}, 'rad') AND contains({n}, 'deg') THEN 'deg' END) AS {to}unit"""


NORMED = f"n AS (SELECT {IDS}, a, b, {_norm('a')} AS na, {_norm('b')} AS nb FROM c)"


@query("normalize_text", with_inputs("", c=CALLOUTS) + f", {NORMED} SELECT {IDS}, na, nb, na = nb AS equal FROM n")
def normalized(s: Source):
    return s.sql(CALLOUTS, heavy=True).select(*ID, normalize_text(F.col("a")).alias("na"), normalize_text(F.col("b")).alias("nb")).withColumn("equal", F.col("na") == F.col("nb"))


@query("parse_dimension", with_inputs("", c=CALLOUTS) + f", {NORMED} SELECT {IDS}, {_parsed('na', '')} FROM n")
def parsed(s: Source):
    rows = s.sql(CALLOUTS, heavy=True).select(*ID, "a", normalize_text(F.col("a")).alias("n"))
    rows = rows.select(*ID, parse_normalized(F.col("n"), F.col("a")).alias("d"))
    return rows.select(*ID, "d.symbol", "d.value", "d.tol_plus", "d.tol_minus", "d.unit")


def _part(c: str) -> str:
    return f"CASE WHEN g{c} IS NULL THEN p{c} IS NULL ELSE coalesce(abs(p{c} - g{c}) <= greatest(0.5, 0.02 * abs(g{c})), FALSE) END"


@query("dims_equal", with_inputs("", c=CALLOUTS) + f""", {NORMED}, d AS (SELECT {IDS}, {_parsed('na', 'p')}, {_parsed('nb', 'g')} FROM n),
e AS (SELECT {IDS}, {_part('value')} AS value, {_part('tol_plus')} AND {_part('tol_minus')} AS tolerance, psymbol IS NOT DISTINCT FROM gsymbol AS symbol FROM d)
SELECT *, value AND tolerance AND symbol AS exact FROM e""")
def compared(s: Source):
    rows = s.sql(CALLOUTS, heavy=True).select(*ID, normalize_text(F.col("a")).alias("na"), normalize_text(F.col("b")).alias("nb"), "a", "b")
    rows = rows.select(*ID, parse_normalized(F.col("na"), F.col("a")).alias("p"), parse_normalized(F.col("nb"), F.col("b")).alias("g"))
    return rows.select(*ID, dims_equal(F.col("p"), F.col("g")).alias("e")).select(*ID, "e.*")


@query("numbers_in_text", with_inputs(f"""SELECT {IDS}, x AS number, coalesce(abs(x - y) <= greatest(0.5, 0.02 * abs(y)), FALSE) AS equal FROM (
SELECT *, try_cast(replace(nullif(regexp_extract(a, '[-+]?\\d*[.,]?\\d+'), ''), ',', '.') AS DOUBLE) AS x,
try_cast(replace(nullif(regexp_extract(b, '[-+]?\\d*[.,]?\\d+'), ''), ',', '.') AS DOUBLE) AS y FROM c) AS q""", c=CALLOUTS))
def numbers(s: Source):
    return s.sql(CALLOUTS, heavy=True).select(*ID, first_number(F.col("a")).alias("number"), numbers_equal(F.col("a"), F.col("b")).alias("equal"))


# --- strings: brand and type are an image, part names its texts ----------------

IMAGE = "CONCAT(p_brand, '/', p_type)"
STRING_GT = f"SELECT {IMAGE} AS image, p_partkey AS gt_idx, CONCAT(p_name, ' ', CAST(p_size AS STRING)) AS text FROM {{part}}"
STRING_PRED = f"""
SELECT 'a' AS run_id, {IMAGE} AS image, p_partkey AS pred_idx, CASE WHEN p_size = 7 THEN '' ELSE CONCAT(UPPER(p_name), '  ', CAST(p_size + p_partkey % 3 AS STRING)) END AS text FROM {{part}}
UNION ALL
SELECT 'b' AS run_id, {IMAGE} AS image, p_partkey AS pred_idx, CASE WHEN p_size > 40 THEN ' ' ELSE CONCAT(REPLACE(p_name, 'e', 'o'), ' ', CAST(p_retailprice AS STRING)) END AS text FROM {{part}}
"""
# turns over truth strings; equal distances go to the earliest prediction
TEXT_MATCH = """
preds AS (SELECT run_id, image, pred_idx, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM pred WHERE trim(text) <> ''),
seen AS (SELECT DISTINCT run_id, image FROM pred),
turns AS (SELECT s.run_id, g.image, g.gt_idx, g.text, trim(regexp_replace(lower(g.text), '\\s+', ' ', 'g')) AS norm,
          row_number() OVER (PARTITION BY s.run_id, g.image ORDER BY gt_idx) AS turn FROM gt g JOIN seen s USING (image)),
cand AS (SELECT t.run_id, t.image, t.turn, p.pred_idx, levenshtein(t.norm, p.norm) AS d FROM turns t JOIN preds p USING (run_id, image)),
walk AS (
  SELECT run_id, image, CAST(0 AS BIGINT) AS turn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pred_idx FROM seen
  UNION ALL
  SELECT w.run_id, w.image, w.turn + 1, CASE WHEN max(c.pred_idx) IS NULL THEN w.used ELSE list_append(w.used, arg_min(c.pred_idx, (c.d, c.pred_idx))) END,
         arg_min(c.pred_idx, (c.d, c.pred_idx))
  FROM walk w JOIN turns t ON t.run_id = w.run_id AND t.image = w.image AND t.turn = w.turn + 1
  LEFT JOIN cand c ON c.run_id = w.run_id AND c.image = w.image AND c.turn = w.turn + 1 AND NOT list_contains(w.used, c.pred_idx)
  GROUP BY w.run_id, w.image, w.turn, w.used),
m0 AS (SELECT t.run_id, t.image, t.gt_idx, t.text, t.norm, w.pred_idx, coalesce(p.text, '') AS match, coalesce(p.norm, '') AS match_norm
  FROM turns t JOIN walk w USING (run_id, image, turn) LEFT JOIN preds p ON p.run_id = w.run_id AND p.image = w.image AND p.pred_idx = w.pred_idx),
m AS (SELECT *, levenshtein(norm, match_norm) AS dist, length(norm) AS chars,
  levenshtein(norm, match_norm) / length(norm) <= 0.5 AS found, norm = match_norm AS exact FROM m0),
tot AS (
  SELECT run_id, CAST(sum(least(dist, chars)) AS BIGINT) AS char_edits, CAST(sum(greatest(1, chars)) AS BIGINT) AS gt_chars,
    count(*) FILTER (exact) AS exact, count(*) FILTER (found) AS found, count(*) AS n_gt, count(*) FILTER (found AND pred_idx IS NOT NULL) AS matched_pred
  FROM m GROUP BY run_id),
sc AS (SELECT t.*, (SELECT count(*) FROM preds p WHERE p.run_id = t.run_id) AS n_pred, (SELECT count(*) FROM seen s WHERE s.run_id = t.run_id) AS evaluated_images FROM tot t)
"""


def _match(body: str) -> str:
    return with_inputs("", True, gt=STRING_GT, pred=STRING_PRED) + "," + TEXT_MATCH + body


@query("string_scores", _match("""SELECT run_id, char_edits, gt_chars, exact, found, n_gt, matched_pred, n_pred, evaluated_images,
round(char_edits / gt_chars, 6) AS cer, round(exact / n_gt, 6) AS exact_match, round(matched_pred / n_pred, 6) AS precision, round(found / n_gt, 6) AS recall,
round(2 * (matched_pred / n_pred) * (found / n_gt) / (matched_pred / n_pred + found / n_gt), 6) AS f1 FROM sc"""))
def strings(s: Source):
    out = string_scores(s.sql(STRING_GT, heavy=True), s.sql(STRING_PRED, heavy=True), result_images(s.sql(STRING_PRED)))
    return out.select("run_id", "char_edits", "gt_chars", "exact", "found", "n_gt", "matched_pred", "n_pred", "evaluated_images",
                      *r6("cer", "exact_match", "precision", "recall", "f1"))


# words as single ASCII letters, numbered over both sides of a pair: then its distance of bytes is that of words
_LETTERS = "array_to_string(list_transform({0}, lambda w: chr(CAST(63 + list_position(list_distinct(list_concat({1}, {2})), w) AS INTEGER))), '')"
_GW, _MW = "list_filter(string_split(norm, ' '), lambda w: w <> '')", "list_filter(string_split(match_norm, ' '), lambda w: w <> '')"
WORD_EDITS = f"""SELECT run_id, CAST(sum(least(levenshtein({_LETTERS.format("g", "g", "p")}, {_LETTERS.format("p", "g", "p")}), len(g))) AS BIGINT) AS word_edits,
CAST(sum(greatest(1, len(g))) AS BIGINT) AS gt_words, round(sum(least(levenshtein({_LETTERS.format("g", "g", "p")}, {_LETTERS.format("p", "g", "p")}), len(g))) / sum(greatest(1, len(g))), 6) AS wer
FROM (SELECT run_id, {_GW} AS g, {_MW} AS p FROM m) AS q GROUP BY run_id"""


@query("string_word_errors", _match(WORD_EDITS))
def word_errors(s: Source):
    return string_scores(s.sql(STRING_GT, heavy=True), s.sql(STRING_PRED, heavy=True), result_images(s.sql(STRING_PRED))).select("run_id", "word_edits", "gt_words", *r6("wer"))


@query("string_detail", _match("SELECT run_id, image, gt_idx, text, match, found, round(least(dist, chars) / greatest(1, chars), 6) AS cer FROM m"))
def truth_detail(s: Source):
    return string_detail(s.sql(STRING_GT, heavy=True), s.sql(STRING_PRED, heavy=True), result_images(s.sql(STRING_PRED)))[0].select("run_id", "image", "gt_idx", "text", "match", "found", *r6("cer"))


@query("string_extras", _match("""SELECT p.run_id, p.image, p.pred_idx, p.text, m.pred_idx IS NOT NULL AS matched FROM preds p
LEFT JOIN m ON m.run_id = p.run_id AND m.image = p.image AND m.pred_idx = p.pred_idx AND m.found"""))
def extras(s: Source):
    return string_detail(s.sql(STRING_GT, heavy=True), s.sql(STRING_PRED, heavy=True), result_images(s.sql(STRING_PRED)))[1]


# a run that left every image with a large part number empty, with its list of results
SHORT_PRED = f"SELECT run_id, image, pred_idx, text FROM ({STRING_PRED}) AS q WHERE length(image) % 10 > 0"
SCORED = with_inputs("", True, gt=STRING_GT, pred=SHORT_PRED, res=STRING_PRED) + "," + TEXT_MATCH.replace("seen AS (SELECT DISTINCT run_id, image FROM pred)", "seen AS (SELECT DISTINCT run_id, image FROM res)")


@query("string_scores_empty_results", SCORED + """SELECT run_id, char_edits, gt_chars, found, n_gt, matched_pred, n_pred, evaluated_images,
round(char_edits / gt_chars, 6) AS cer, round(found / n_gt, 6) AS recall FROM sc""")
def strings_with_empty_results(s: Source):
    out = string_scores(s.sql(STRING_GT), s.sql(SHORT_PRED), result_images(s.sql(STRING_PRED)))
    return out.select("run_id", "char_edits", "gt_chars", "found", "n_gt", "matched_pred", "n_pred", "evaluated_images", *r6("cer", "recall"))


# --- whole pages: a document against its neighbour, a chat's two sides ----------

PAGE_GT = "SELECT CAST(doc_id AS STRING) AS image, CAST(0 AS BIGINT) AS gt_idx, text FROM {documents}"
PAGE_PRED = "SELECT source AS run_id, CAST(doc_id + 1 AS STRING) AS image, CAST(0 AS BIGINT) AS pred_idx, text FROM {documents}"
CHAT_GT = "SELECT CAST(conv_id AS STRING) AS image, turn AS gt_idx, text FROM {conversations} WHERE role = 'user'"
CHAT_PRED = "SELECT role AS run_id, CAST(conv_id AS STRING) AS image, turn AS pred_idx, text FROM {conversations} WHERE role <> 'user'"
_WS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
EDGES = "'.,;:()[]{}\"''`°|'"
TOKENS = f"list_filter(list_transform(string_split(regexp_replace(lower(text), '{_WS}', ' ', 'g'), ' '), lambda t: trim(replace(t, ',', '.'), {EDGES})), lambda t: t <> '')"
BAGS = f"""
gtok AS (SELECT image, gt_idx, unnest({TOKENS}) AS token, unnest(range(len({TOKENS}))) AS pos FROM gt),
ptok AS (SELECT run_id, image, unnest({TOKENS}) AS token FROM pred),
seen AS (SELECT DISTINCT run_id, image FROM pred),
gc AS (SELECT image, token, count(*) AS cg FROM gtok GROUP BY ALL), pc AS (SELECT run_id, image, token, count(*) AS cp FROM ptok GROUP BY ALL),
pages AS (SELECT s.run_id, s.image FROM seen s SEMI JOIN gt g ON s.image = g.image),
bag AS (
  SELECT a.run_id, a.image, CAST(coalesce((SELECT sum(cg) FROM gc WHERE gc.image = a.image), 0) AS BIGINT) AS n_gt_words,
    CAST(coalesce((SELECT sum(cp) FROM pc WHERE pc.image = a.image AND pc.run_id = a.run_id), 0) AS BIGINT) AS n_pred_words,
    CAST(coalesce((SELECT sum(least(cg, cp)) FROM gc JOIN pc USING (token) WHERE gc.image = a.image AND pc.image = a.image AND pc.run_id = a.run_id), 0) AS BIGINT) AS matched_words
  FROM pages a)
"""


def _bags(body: str, gt: str = PAGE_GT, pred: str = PAGE_PRED) -> str:
    return with_inputs("", gt=gt, pred=pred) + "," + BAGS + body


@query("word_overlap_documents", _bags("SELECT * FROM bag"))
def page_words(s: Source):
    return word_overlap(s.sql(PAGE_GT, heavy=True), s.sql(PAGE_PRED, heavy=True), result_images(s.sql(PAGE_PRED)))


@query("word_coverage_documents", _bags("""SELECT run_id, count(*) AS evaluated_images, CAST(sum(n_gt_words) AS BIGINT) AS n_gt_words, CAST(sum(matched_words) AS BIGINT) AS matched_words,
round(sum(matched_words) / sum(n_gt_words), 6) AS word_coverage, round(sum(matched_words) / sum(n_pred_words), 6) AS word_precision FROM bag GROUP BY run_id"""))
def page_coverage(s: Source):
    out = word_overlap(s.sql(PAGE_GT, heavy=True), s.sql(PAGE_PRED, heavy=True), result_images(s.sql(PAGE_PRED))).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("evaluated_images"), *[F.sum(c).alias(c) for c in ("n_gt_words", "n_pred_words", "matched_words")])
    return out.select("run_id", "evaluated_images", "n_gt_words", "matched_words", F.round(F.col("matched_words") / F.col("n_gt_words"), 6).alias("word_coverage"),
                      F.round(F.col("matched_words") / F.col("n_pred_words"), 6).alias("word_precision"))


LEFT_EMPTY = f"SELECT run_id, image, pred_idx, text FROM ({PAGE_PRED}) AS q WHERE length(text) % 10 > 0"


@query("word_overlap_empty_results", with_inputs("", gt=PAGE_GT, pred=LEFT_EMPTY, res=PAGE_PRED) + ","
       + BAGS.replace("seen AS (SELECT DISTINCT run_id, image FROM pred)", "seen AS (SELECT DISTINCT run_id, image FROM res)") + "SELECT * FROM bag")
def page_words_with_empty_results(s: Source):
    return word_overlap(s.sql(PAGE_GT, heavy=True), s.sql(LEFT_EMPTY, heavy=True), result_images(s.sql(PAGE_PRED)))


@query("word_overlap_chats", _bags("SELECT * FROM bag", CHAT_GT, CHAT_PRED))
def chat_words(s: Source):
    return word_overlap(s.sql(CHAT_GT, heavy=True), s.sql(CHAT_PRED, heavy=True), result_images(s.sql(CHAT_PRED)))


@query("token_flags", _bags("""SELECT s.run_id, g.image, g.gt_idx, g.pos, g.token,
row_number() OVER (PARTITION BY s.run_id, g.image, g.token ORDER BY g.gt_idx, g.pos) <= coalesce(p.cp, 0) AS matched
FROM gtok g JOIN seen s USING (image) LEFT JOIN pc p ON p.run_id = s.run_id AND p.image = g.image AND p.token = g.token""", CHAT_GT, CHAT_PRED))
def flags(s: Source):
    return token_flags(s.sql(CHAT_GT, heavy=True), s.sql(CHAT_PRED, heavy=True), result_images(s.sql(CHAT_PRED)))


@query("tokens", with_inputs(f"SELECT image, gt_idx, array_to_string({TOKENS}, ' ') AS tokens FROM gt", gt=PAGE_GT))
def token_rows(s: Source):
    return s.sql(PAGE_GT, heavy=True).select("image", "gt_idx", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


@query("fold_text", with_inputs(f"SELECT image, trim(regexp_replace(lower(text), '{_WS}', ' ', 'g')) AS norm FROM gt", gt=PAGE_GT))
def folded(s: Source):
    return s.sql(PAGE_GT, heavy=True).select("image", fold(F.col("text")).alias("norm"))


@query("char_overlap_documents")
def page_chars(s: Source):
    """Longest common subsequence over whole pages; tested against a table method."""
    return char_overlap(s.sql(PAGE_GT, heavy=True), s.sql(PAGE_PRED, heavy=True), result_images(s.sql(PAGE_PRED)))


@query("whole_text_scores")
def whole(s: Source):
    """Word and character coverage with the string metrics, per run."""
    out = whole_text_scores(s.sql(CHAT_GT, heavy=True), s.sql(CHAT_PRED, heavy=True), result_images(s.sql(CHAT_PRED)))
    return out.select("run_id", "evaluated_images", "n_gt_words", "n_pred_words", "matched_words", "lcs", "gt_chars",
                      *r6("word_coverage", "char_coverage", "word_precision", "cer", "wer", "exact_match"))


APPROACHES = """SELECT CASE turn % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'crop' ELSE 'gtcrop' END AS run_id, CAST(conv_id AS STRING) AS image, turn AS pred_idx, text FROM {conversations}"""


@query("detection_cost", _bags("""SELECT 'ocr' AS ocr_model, round(max(c) FILTER (run_id = 'full'), 6) AS "full", round(max(c) FILTER (run_id = 'gtcrop'), 6) AS gtcrop,
round(max(c) FILTER (run_id = 'crop'), 6) AS crop, round(max(c) FILTER (run_id = 'gtcrop') - max(c) FILTER (run_id = 'crop'), 6) AS detection_cost,
arg_max(run_id, (c, run_id)) AS best_approach FROM (SELECT run_id, sum(matched_words) / sum(n_gt_words) AS c FROM bag GROUP BY run_id) AS q""", CHAT_GT, APPROACHES))
def cost(s: Source):
    per_run = word_overlap(s.sql(CHAT_GT, heavy=True), s.sql(APPROACHES, heavy=True), result_images(s.sql(APPROACHES))).groupBy("run_id").agg((F.sum("matched_words") / F.sum("n_gt_words")).alias("word_coverage"))
    out = detection_cost(per_run.select(F.lit("ocr").alias("ocr_model"), F.col("run_id").alias("approach"), "word_coverage"))
    return out.select("ocr_model", *r6("full", "gtcrop", "crop", "detection_cost"), "best_approach")
