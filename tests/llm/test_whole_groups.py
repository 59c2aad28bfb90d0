"""Groups of near copies in full, and tables of words that are not broadcast."""

import random

from test_dedup import table
from test_near_copies import near_pairs
from test_spelling import SMALL

from sheetscore.llm import spelling
from sheetscore.llm.common import prepare
from sheetscore.llm.minhash import near_copies
from sheetscore.llm.simhash import drop_near_duplicates, simhash_groups


def one_group(n=40, seed=2):
    """Texts of one line repeated, by which their fingerprints are alike, and tails that share half of their words or less."""
    r = random.Random(seed)
    line = " ".join(f"l{i}" for i in range(11))  # an odd number of shingles leaves no bit undecided
    tails = [[f"t{r.randrange(10**6)}" for _ in range(30)] for _ in range(6)]
    return [" ".join([line] * 400 + r.choice(tails)[: r.randrange(8, 30)]) for _ in range(n)]


def test_all_of_a_simhash_group_meet(spark):
    """only pairs with a group's smallest document were looked at, and of these only those whose minima agreed."""
    prepare(spark)
    texts = one_group()
    docs = table(spark, texts)
    assert simhash_groups(docs, 5).select("component_id").distinct().count() == 1
    for similarity in (0.3, 0.5):
        pairs, want = near_pairs(texts, similarity)
        assert pairs > 20
        assert sorted(r.doc_id for r in drop_near_duplicates(docs, similarity=similarity).collect()) == want


def test_given_groups_are_compared_in_full(spark):
    """pairs of a given group link by their shingles, whatever the bands and minima say."""
    prepare(spark)
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(9)}" for _ in range(7)) for _ in range(60)]
    docs = table(spark, texts)
    groups = docs.select("doc_id").selectExpr("doc_id", "0L AS component")
    _, want = near_pairs(texts, 0.2)
    found = near_copies(docs, 5, 0.2, groups=groups).collect()
    assert sorted(x.doc_id for x in found if x.doc_id == x.root) == want
    few = near_copies(docs, 5, 0.2, groups=groups, most_rows=8, most_grams=30).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, found))


def test_tables_of_words_are_not_broadcast(spark):
    """a packed table of words is many times its file in memory; joins with it move both sides."""
    prepare(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    vocabulary = spelling.word_counts(docs)
    for df in (spelling.near_words(vocabulary), spelling.spelling_variants(docs), spelling.roots(vocabulary.selectExpr("word", "concat(word, 'x') AS form"))):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
