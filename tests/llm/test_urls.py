import itertools
import math
import re

from pyspark.sql import functions as F

from sheetscore.llm import urls as u
from sheetscore.llm.common import prepare

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(h + p), a, h + p) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def brute_segment(text, counts, total):
    best = None
    for cuts in itertools.product([0, 1], repeat=max(0, len(text) - 1)):
        words, at = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                words.append(text[at:i])
                at = i
        score = sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in words)
        if best is None or score > best[0] + 1e-9:
            best = (score, words)
    return best


def test_segment_is_the_best_of_all_splits():
    counts = {"the": 50, "re": 9, "there": 30, "a": 20, "her": 5, "spam": 4, "farm": 3, "far": 2, "m": 1}
    total = sum(counts.values())
    for text in ("there", "thereafarm", "spamfarm", "xq", "herthe", "m", "zzthezz"):
        words = u.segment(text, counts, total)
        assert "".join(words) == text
        score = sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in words)
        assert math.isclose(score, brute_segment(text, counts, total)[0])
    assert u.segment("spamfarm", counts, total) == ["spam", "farm"]


URLS = [
    None, "", "no scheme", "http://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net/", "http://xnet/", "https://net/a", "http://org/fr/1",
    "http://b.org/fr", "http://example.com/de/?q", "http://www.example.com/DE/", "x://y://z/p", "http://h?p=/a", "http://h#/a", "://", "http:///p", "http://É.COM/é",
    "http://line\nbreak.net/en/", "http://spam-farm.org/en/1", "http://spamfarm.com/en/2", "http://farmstead.com/en/2",
]


def pages(spark, urls, html="<p>spam the farm words example farm</p>"):
    prepare(spark)
    return spark.createDataFrame([(i, x, html) for i, x in enumerate(urls)], "page_id long, url string, html string")


def test_hosts_paths_rules(spark):
    table = pages(spark, URLS).withColumn("host", F.lit("x")).withColumn("words", F.lit("x")).withColumn("rule", F.lit("x"))
    out = {r.page_id: r for r in u.url_verdicts(table).collect()}
    assert len(out) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = plain_parts(url)
        rule = plain_rule(host, path)
        assert (out[i].host, out[i].path) == (host, path), url
        assert out[i].rule == (rule[1] if rule else None), url
        assert out[i].verdict == (rule[0] if rule else "block" if out[i].score > 0 else "allow")


def plain_bayes(rows, seeds):
    counts, n = [{}, {}], [0, 0]
    toks = {}
    for r in rows:
        t = ["h:" + w for w in r.words or []] + ["p:" + w for w in re.split(r"[\W_1-9]+", re.sub("[0-9]+", "0", r.path.lower())) if w]
        toks[r.page_id] = t
        bad = int(any(w in seeds for w in r.words or []))
        n[bad] += 1
        for x in t:
            s = u.slot_of(x)
            counts[bad][s] = counts[bad].get(s, 0) + 1
    size = [sum(c.values()) + len(counts[0].keys() | counts[1].keys()) + 1 for c in counts]
    lp = lambda c, x: math.log((counts[c].get(u.slot_of(x), 0) + 1) / size[c])
    return {p: math.log((n[1] + 1) / (n[0] + 1)) + sum(lp(1, x) - lp(0, x) for x in t) for p, t in toks.items()}


def test_whole_table_matches_plain_naive_bayes(spark):
    prepare(spark)
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = u.url_verdicts(table).collect()
    want = plain_bayes(rows, u.SEEDS)
    assert len(rows) == table.count()
    for r in rows:
        assert abs(r.score - want[r.page_id]) < 1e-6
        rule = plain_rule(r.host, r.path)
        assert r.verdict == (rule[0] if rule else "block" if want[r.page_id] > 0 else "allow")
    method = [r for r in rows if r.rule is None]
    assert any("spam" in r.host and r.verdict == "block" for r in method) and any(r.verdict == "allow" for r in method)
    counts = {r.word: r.n for r in u.word_counts(table).collect()}
    total = sum(counts.values())
    for r in rows[:60]:
        assert sorted(r.words) == sorted(w for name in re.split("[^a-z]+", r.host) if name for w in u.segment(name, counts, total))


def test_word_counts_and_empty_table(spark):
    html = '<script>var abc</script>The <b class="cls">the</b> cat<style>p{}</style> a ' + "z" * 30
    assert {r.word: r.n for r in u.word_counts(pages(spark, ["x"], html)).collect()} == {"the": 2, "cat": 1}
    assert u.url_verdicts(pages(spark, [])).count() == 0
    assert {r.verdict for r in u.url_verdicts(pages(spark, [None, "http://a/b"], None)).collect()} == {"allow"}
    twice = u.url_verdicts(pages(spark, ["http://spam-spam.org/a", "http://" + "long" * 500 + "/x"] * 3)).collect()
    assert len(twice) == 6 and sum(r.verdict == "block" for r in twice) == 3
