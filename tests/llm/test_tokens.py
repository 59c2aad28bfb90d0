import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetscore.llm import packing, token_files as tf, tokens
from sheetscore.llm.common import prepare
from sheetscore.llm.tokens import Encoder, ids_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "\n\n", "It's THE end, isn't it?", "á ë́x", "x y z\x1cw\x85v", "日本語 テスト１２3", "<|endoftext|> tail<|startoftext|>",
    "Grüße, ÀÉÎ ŒUVRE… don't 'S it'LL", "ΑΣ ΑΣ. İstanbul ﬁn ßẞ", "a" * 3000, "👍🏽 ok\t\ttab\r\nline", "é\ń b", "___x_y--z 1st 22nd", "word. WORD, word! word",
]


def whole(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def table(spark, texts):
    prepare(spark)
    return spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)


def docs_of(folder="/root/testdata/sf0.001"):
    import duckdb

    return [r[0] for r in duckdb.sql(f"SELECT text FROM '{folder}/documents.parquet' ORDER BY doc_id").fetchall()]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    texts = ODD + docs_of()
    raw = [(t or "").encode() for t in texts]
    want = whole(texts)
    assert [x.tolist() for x in ids_of(raw)] == want
    monkeypatch.setattr(tokens, "SLICE", 5)
    small = Encoder(most=50)
    for at in range(0, len(raw), 7):
        got = small.encode(raw[at : at + 7])
        assert [np.frombuffer(x, "<u4").tolist() + [1] for x in got] == want[at : at + 7]
    assert len(small.known) <= 50 and small.encode([]) == [] and small.encode([b"", b"\n \n"]) == [b"", b""]


def brute_bound(lengths, capacity):
    return -(-sum(lengths) // capacity)


def test_best_fit_and_bound():
    r = random.Random(1)
    for _ in range(60):
        capacity = r.choice([7, 20, 64])
        lengths = sorted((r.randint(1, capacity) for _ in range(r.randrange(1, 40))), reverse=True)
        bins, offsets, room = packing.best_fit(lengths, capacity)
        fill = [0] * len(room)
        free = []
        for n, b, o in zip(lengths, bins, offsets):  # plain best fit, by search
            fits = [x for x in free if x >= n]
            assert (min(fits) if fits else capacity) == capacity - o
            free = free + [capacity] if not fits else free
            free.remove(capacity - o)
            free.append(capacity - o - n)
            assert fill[b] == o
            fill[b] += n
        assert [capacity - f for f in fill] == room
        bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1))
        assert brute_bound(lengths, capacity) <= bound <= len(room)
    assert packing.lower_bound(np.bincount([6, 6, 6], minlength=11)) == 3  # two never fit together


def check_packing(rows, want_pieces, capacity):
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want_pieces
    assert len(rows) == len(want_pieces)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("part_rows", [50_000, 40])
def test_pack_documents(spark, part_rows):
    texts = ODD + docs_of() + ["same text"] * 50
    want = {}
    for i, ids in enumerate(whole(texts)):
        for k, at in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[at : at + 512], "<u4")
            want[i, k] = (at, len(part), zlib.crc32(part))
    docs = table(spark, texts).withColumn("piece", F.lit(1)).withColumn("length", F.lit(1)).withColumn("part", F.lit(1)).withColumn("open", F.lit(1))
    out = packing.pack_documents(docs, capacity=512, part_rows=part_rows)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n = check_packing(out.collect(), want, 512)
    whole_corpus = len(packing.best_fit(sorted((v[1] for v in want.values()), reverse=True), 512)[2])
    assert n <= whole_corpus + (0 if part_rows > 1000 else 4)
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_exchange_removes_the_gaps_of_partitions(spark):
    prepare(spark)
    rows = spark.range(900).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "30 + pmod(id * 7, 40) AS length", "0L AS ids_crc32")
    lengths = [r.length for r in rows.collect()]
    out = packing.pack(rows, capacity=100, part_rows=30).collect()
    n = check_packing(out, {(r.doc_id, 0): (0, r.length, 0) for r in rows.collect()}, 100)
    first = packing.packed(rows, 30, 0, 100, 0.05).filter("offset = 0").count()
    bound = packing.lower_bound(np.bincount(lengths, minlength=101))
    assert bound <= n < first


def kraft(lengths):
    return sum(2.0 ** -int(n) for n in lengths if n)


def test_code_lengths_are_optimal_and_limited():
    import heapq

    r = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 300):
        counts = r.integers(0, 2, n) + (1.4 ** np.arange(n)).clip(max=1e12).astype(np.int64)
        free = tf.code_lengths(counts, 60 if n < 60 else 64)
        heap = sorted(counts[counts > 0].tolist())
        cost = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        assert n == 1 or int((free * counts).sum()) == cost
        tight = tf.code_lengths(counts, 9)
        assert tight.max() <= 9 and kraft(tight) <= 1
        assert n < 2 or kraft(tight) == 1
    five = np.array([1, 1, 2, 3, 5, 8])
    best = min(
        sum(c * n for c, n in zip(five, ns))
        for ns in __import__("itertools").product(range(1, 4), repeat=6)
        if sum(2.0**-n for n in ns) <= 1
    )
    assert int((tf.code_lengths(five, 3) * five).sum()) == best


def test_encode_decode_round_trip():
    r = np.random.default_rng(5)
    for n, symbols in ((0, 5), (1, 1), (5, 1), (127, 9), (128, 300), (129, 300), (50_000, 3000)):
        ids = np.minimum(r.geometric(0.01, n), symbols - 1).astype("<u4")
        lengths = tf.code_lengths(np.bincount(ids, minlength=symbols + 2), 14)
        payload, marks = tf.encode(ids, tf.canonical(lengths), lengths)
        got = tf.Decoder(lengths).decode(payload, marks, tf.lanes(np.array([n])[: n > 0]))
        assert got.tolist() == ids.tolist()
        assert len(payload) == -(-int(lengths[ids].astype(int).sum()) // 8)


def test_token_files(spark, tmp_path, monkeypatch):
    texts = ODD + docs_of() + ["same"] * 30
    want, start = {}, 0
    for i, ids in enumerate(whole(texts)):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4")), ids)
        start += len(ids)
    monkeypatch.setattr(tf, "BLOCK_TOKENS", 5000)
    docs = table(spark, texts).withColumn("n", F.lit("x")).withColumn("shard", F.lit(2)).withColumn("ids", F.lit(2))
    tf.write_token_files(docs, f"{tmp_path}/a")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32, r.ids) for r in tf.read_token_files(spark, f"{tmp_path}/a").collect()}
    assert got == want
    stored = spark.read.parquet(f"{tmp_path}/a/blocks").orderBy("shard", "block").collect()
    assert [d for b in stored for d in b.doc_ids] == sorted(want) and len(stored) > 5
    tf.write_token_files(table(spark, []), f"{tmp_path}/b")
    assert tf.read_token_files(spark, f"{tmp_path}/b").count() == 0
