"""URL verdicts: fixed rules first, then host words under multinomial naive Bayes.

Host names are split into words by the most likely way under a unigram model of the corpus's own words
(Viterbi). Naive Bayes learns tokens of hosts and paths from all pages: a url whose host holds one of the seed words
is an example to block, any other one to allow; its counts then judge every url that no rule decides.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

# (action, host and path)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SEEDS = ("spam", "ads", "bets", "casino", "porn", "xxx", "poker", "pills", "viagra", "malware", "phishing", "torrent", "warez")
LONGEST = 20  # letters of a word
SLOTS = 1 << 18  # of the table of token counts
MOST_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Then up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_fit(rules: Sequence[tuple[str, str]], host: Column, path: Column, part: int) -> Column:
    """Part of the longest rule whose host is the url's or a parent of it, and whose path begins the url's."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        name, slash, rest = rule[1].partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule[part])).otherwise(found)
    return found


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): letters between tags of all pages; two to LONGEST of them, A-Z in lower case."""
    text = F.regexp_replace(F.translate("html", UPPER, LOWER), r"(?s)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(rf"(?<![a-z])([a-z]{{2,{LONGEST}}})(?![a-z])"), F.lit(1))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def segment(text: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely words of a run of letters. Unknown words lose a factor of ten with each letter; ties: the longer last word."""
    best, last = [0.0], [0]
    for end in range(1, len(text) + 1):
        score, begin = -math.inf, end - 1
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(text[start:end])
            p = math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)
            if best[start] + p > score:
                score, begin = best[start] + p, start
        best.append(score)
        last.append(begin)
    words, end = [], len(text)
    while end:
        words.append(text[last[end] : end])
        end = last[end]
    return words[::-1]


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) of distinct hosts: each run of letters in words, the rest of the name as it is.

    The model comes to the names, not to the tasks: every part of a run meets its count by a join, so no
    vocabulary is held by anyone.
    """
    total = counts.agg(F.sum("n")).first()[0] or 1
    parts = hosts.select("host", F.explode(F.split("host", r"[^a-z]+")).alias("name")).filter("name <> ''")
    names = parts.select("name").distinct()
    pieces = names.select("name", F.explode(F.expr(f"sequence(1, length(name))")).alias("i")).select(
        "name", F.explode(F.expr(f"array_distinct(transform(sequence(1, least({LONGEST}, length(name) - i + 1)), k -> substring(name, i, k)))")).alias("word")
    )
    known = pieces.distinct().join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for name, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out.append(segment(name, {k["word"]: k["n"] for k in found or ()}, total))
        return {"name": batch.column(0), "words": out}

    split = arrow_map(names.join(known, "name", "left"), run, "name string, words array<string>")
    return parts.join(split, "name").groupBy("host").agg(F.flatten(F.collect_list("words")).alias("words"))


def tokens(words: Column, path: Column) -> Column:
    """What naive Bayes counts: host words, and path words with their numbers alike."""
    names = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w))
    rest = F.filter(F.split(F.regexp_replace(F.lower(path), r"[0-9]+", "0"), r"[^\p{L}0]+"), lambda w: w != "")
    return F.concat(names, F.transform(rest, lambda w: F.concat(F.lit("p:"), w)))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """-> (page_id, host, path, rule, verdict, score, words) of every page of (page_id, url, html, ...).

    rule: the longest fitting rule, else null. verdict: the rule's action, else `block` where the log odds
    `score` of blocking are above zero and `allow` otherwise. words: the segmented host. A null url, or one
    without ://, has an empty host and path and is judged like any other; null pages have no words; an empty
    table gives no rows.
    """
    rows = pages.select("page_id", F.col("url").alias("_url"), "html").select("page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    split = written(host_words(rows.select("host").distinct(), word_counts(pages)))
    judged = written(rows.join(split, "host", "left").select("page_id", "host", "path", "words", tokens(F.col("words"), F.col("path")).alias("tokens")))
    bad = F.arrays_overlap(F.coalesce("words", F.array().cast("array<string>")), F.array(*map(F.lit, seeds)))
    slot = F.pmod(F.xxhash64("t"), F.lit(SLOTS)).alias("slot")
    by_class = judged.select(F.coalesce(bad, F.lit(False)).alias("bad"), "tokens")
    counts = np.zeros((2, SLOTS))
    for is_bad, place, n in by_class.select("bad", F.explode("tokens").alias("t")).groupBy("bad", slot).count().toLocalIterator():
        counts[int(is_bad), place] = n  # at most 2 * SLOTS rows
    urls = {r["bad"]: r["count"] for r in by_class.groupBy("bad").count().collect()}
    used = counts.any(axis=0).sum()  # add-one smoothing over the tokens that occur
    odds = np.log((counts[1] + 1) / (counts[1].sum() + used + 1)) - np.log((counts[0] + 1) / (counts[0].sum() + used + 1))
    prior = math.log((urls.get(True, 0) + 1) / (urls.get(False, 0) + 1))
    table = pages.sparkSession.sparkContext.broadcast(odds)  # SLOTS numbers

    def run(batch: pa.RecordBatch) -> dict:
        lists = batch.column("tokens").to_pylist()
        scores = [prior + float(table.value[[slot_of(t) for t in sorted(x)]].sum()) if x else prior for x in lists]
        return {n: batch.column(n) for n in ("page_id", "host", "path", "words")} | {"score": scores}

    scored = arrow_map(judged, run, "page_id long, host string, path string, words array<string>, score double")
    fit = lambda part: first_fit(rules, F.col("host"), F.col("path"), part)
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", fit(1).alias("rule"), F.coalesce(fit(0), method).alias("verdict"), "score", "words")


def slot_of(token: str) -> int:
    """As Spark's xxhash64 modulo SLOTS."""
    return xxhash.xxh64_intdigest(token.encode(), 42) % SLOTS
