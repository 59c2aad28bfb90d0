import pytest
from pyspark.sql import functions as F

from sheetscore.sources.keyed import Conflict, KeyedTable, Snapshot, delete_annotation


def rows(spark, n, extra=0):
    return spark.range(n).select(F.concat(F.lit("i"), F.col("id") % (n // 2 or 1)).alias("image"), F.expr("id % 2").alias("k"), (F.col("id") + extra).alias("v"), F.lit(extra).alias("seq"))


def content(df):
    return sorted((r.image, r.k, r.v) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"))
    t.create(rows(spark, 402), ["image", "k"], ["image"], buckets=32)
    return t


def expected(spark, *sides):
    out = {}
    for side in sides:
        for r in side.collect():
            out[r.image, r.k] = r.v
    return sorted((i, k, v) for (i, k), v in out.items())


def test_upsert_rewrites_only_its_buckets(spark, table):
    first = table.snapshot()
    new = rows(spark, 402, 1000).filter("image IN ('i3', 'i7')").unionByName(spark.createDataFrame([("new", 0, 5, 1), ("new", 0, 6, 2)], "image string, k long, v long, seq int"))
    touched = table.upsert(new, ["seq"])
    assert 1 <= len(touched) <= 3
    now = table.snapshot()
    assert {b for b in now.folders if now.folders[b] != first.folders.get(b)} == {str(b) for b in touched}
    assert content(table.read()) == expected(spark, rows(spark, 402), new.orderBy("seq"))
    assert content(table.read(first.version)) == expected(spark, rows(spark, 402))
    assert content(table.lookup(spark.createDataFrame([("new",), ("none",)], "image string"))) == [("new", 0, 6)]
    assert table.upsert(new.limit(0), ["seq"]) == [] and table.versions() == [1, 2]


def test_a_lost_writer_changes_nothing(spark, table, monkeypatch):
    before = content(table.read())
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", lambda self, new: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.upsert(rows(spark, 402, 7), ["seq"])
    assert content(table.read()) == before and table.versions() == [1]


def test_readers_keep_their_snapshot_until_it_is_cleared(spark, table):
    held = table.read()
    before = content(held)
    table.delete(spark.createDataFrame([("i3",)], "image string"))
    table.delete(spark.createDataFrame([("i4", 0)], "image string, k long"))
    assert content(held) == before
    left = [r for r in before if r[0] != "i3" and r[:2] != ("i4", 0)]
    assert content(table.read()) == left
    assert table.clear(keep=1) == 2 and table.versions() == [3]
    assert content(table.read()) == left


def test_two_writers(spark, table, monkeypatch):
    one, two = rows(spark, 402, 100).filter("image = 'i1'"), rows(spark, 402, 200).filter("image = 'i1'")
    other = KeyedTable(spark, table.path)
    publish, seen = KeyedTable._publish, []

    def late(self, new):
        if self is table and not seen:  # the other writer is faster, on the same bucket
            seen.append(1)
            other.upsert(two, ["seq"])
        publish(self, new)

    monkeypatch.setattr(KeyedTable, "_publish", late)
    table.upsert(one, ["seq"])
    assert seen and table.versions() == [1, 2, 3]
    assert content(table.read()) == expected(spark, rows(spark, 402), two, one)
    state = table.snapshot()
    with pytest.raises(Conflict):
        publish(table, Snapshot(state.version, *list(state.__dict__.values())[1:]))


def test_delete_annotation(spark, tmp_path):
    tables = [KeyedTable(spark, str(tmp_path / n)) for n in ("masters", "texts")]
    tables[0].create(spark.createDataFrame([("a", "x"), ("b", "y")], "image string, status string"), ["image"])
    tables[1].create(spark.createDataFrame([("a", 0, "t"), ("a", 1, "u"), ("b", 0, "v")], "image string, gt_idx int, text string"), ["image", "gt_idx"], ["image"])
    delete_annotation(tables, "a")
    assert [t.read().select("image").distinct().collect()[0].image for t in tables] == ["b", "b"]
    tables[1].replace(spark.createDataFrame([("b", 0, "w")], "image string, gt_idx int, text string"))
    assert [tuple(r) for r in tables[1].read().collect()] == [("b", 0, "w")]
    delete_annotation(tables, "b")
    assert [t.read().count() for t in tables] == [0, 0]
