import random

import pytest
import xxhash
from pyspark.sql import functions as F

from sheetscore.llm import simhash
from sheetscore.llm.common import components, prepare
from sheetscore.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts):
    prepare(spark)
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], SCHEMA)


def brute_lines(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        l = [] if t is None else t.split("\n")
        gone = set()
        for s in range(len(l) - 2):
            w = tuple(l[s : s + 3])
            if not "".join(w).strip(" \t\r"):
                continue
            if w in seen:
                gone |= {s, s + 1, s + 2}
            seen.add(w)
        kept = t if not gone else "\n".join(x for p, x in enumerate(l) if p not in gone)
        out[i] = (kept, len(l), len(gone), sum(p - 1 not in gone for p in gone))
    return out


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(3)
    pool = ["a", "b", "c", "", " ", "dé", "x" * 5000]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randrange(12))) for _ in range(60)]
    texts += [None, "", "a", "a\nb", "a\na\na\na\na", "\n\n\n\n\n", "q\nr\ns", "q\nr\ns", "q\nr\ns\nt\nq\nr\ns", "y\n" * 3000]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_spans) for r in line_dedup(table(spark, texts)).collect()}
    assert got == brute_lines(texts)


def test_line_dedup_columns_and_empty_table(spark):
    docs = table(spark, ["a\nb\nc", "a\nb\nc"]).withColumn("starts", F.lit(1)).withColumn("h", F.lit(2)).withColumn("start", F.lit(3))
    out = line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed", "n_spans"]
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["a\nb\nc", ""]
    assert line_dedup(table(spark, [])).count() == 0
    for name in ("N_LINES", "n_spans", "_gone", "_lines", "_id", "gone", "lines", "doc", "a.b"):
        clash = docs.withColumn(name, F.lit("own"))
        out = line_dedup(clash)
        assert out.columns[: len(clash.columns)] == clash.columns and len(out.columns) == len(clash.columns) + 3 - (name.lower() in ("n_lines", "n_spans"))
        assert sorted((r["text"], r[name], r["n_removed"]) for r in out.collect()) == [("", "own", 3), ("a\nb\nc", "own", 0)]


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, radius=2):
    n = len(fps)
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    return root


def near_texts(n=160, seed=5):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    base = [[r.choice(words) for _ in range(r.choice([1, 2, 3, 30, 200, 900]))] for _ in range(20)]
    texts = []
    for _ in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(r.choice([" ", "\n", "\t "]).join(w).replace("w1", "W1"))
    return texts + [None, "", " \t", "é É", "é É", "É é", "one two", "One  Two"]


@pytest.mark.parametrize("partitions, bucket_rows", [(None, 2000), (None, 3), (2, 2000), (4, 3)])
def test_simhash_matches_brute_force(spark, partitions, bucket_rows):
    texts = near_texts()
    fps = [plain_fingerprint(t) for t in texts]
    out = simhash.simhash_groups(table(spark, texts), partitions=partitions, bucket_rows=bucket_rows).collect()
    assert {r.doc_id: r.fingerprint for r in out} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    want = brute_groups(fps)
    assert {r.doc_id: r.component_id for r in out} == dict(enumerate(want))
    assert len(set(want)) < len(want) - 20


@pytest.mark.parametrize("radius", [1, 3])
def test_simhash_links_random_codes(spark, radius):
    prepare(spark)
    r = random.Random(radius)
    fps = [r.getrandbits(64) for _ in range(30)]
    fps = list({f ^ sum(1 << b for b in r.sample(range(64), k)) for f in fps for k in (0, 1, 1, 2, 3, 4)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, node long")
    for rows in (2000, 2):
        found = {x.node: x.root for x in components(simhash.links(nodes, radius, bucket_rows=rows)).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == brute_groups(fps, radius)


def test_simhash_empty_table_extra_columns_long_text(spark):
    assert simhash.simhash_groups(table(spark, [])).count() == 0
    docs = table(spark, ["a b c d", "a b c d"]).withColumn("fp", F.lit("x")).withColumn("node", F.lit(1)).withColumn("component_id", F.lit(1))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [0]
    long = " ".join(str(i % 977) for i in range(200_000))
    assert simhash.fingerprint(long.encode()) == simhash.fingerprint(long.encode(), block=1 << 30)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 5), (200, 201), (202, 201), (7, 7), (300, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}
