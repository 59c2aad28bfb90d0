import json
import random

import pytest

from sheetscore.sources import readers
from sheetscore.sources.pieces import json_members

ODD = ['plain', 'a, b', 'quote " here', 'back\\', '\\", {', '}]', '⌀5, "x"', '', '[[{', ',,,', 'line\nend']


def make(r, listed):
    texts = lambda: [r.choice(ODD) + str(r.random()) for _ in range(r.randrange(0, 6))]
    if listed:
        return [{"image": f"i{n}", "texts": texts(), "deep": [[{"a": [1, 2]}]]} for n in range(400)]
    return {f'i{n}{r.choice(ODD)}': texts() if n % 3 else r.choice(ODD) for n in range(400)}


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred bytes, so that most of them begin inside a member or a string."""
    settings = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k in settings:
        spark.conf.unset(k)


@pytest.mark.parametrize("listed", [False, True])
def test_split_key_equals_the_small_reader(small_ranges, tmp_path, listed):
    spark, r = small_ranges, random.Random(listed)
    folder = tmp_path / "keys"
    folder.mkdir()
    for i, indent in enumerate((None, 2)):
        (folder / f"{i}.json").write_text(json.dumps(make(r, listed), indent=indent, ensure_ascii=bool(i)))
    assert spark.read.option("lineSep", ",").text(str(folder)).rdd.getNumPartitions() > 50
    plain, split = (sorted(map(tuple, readers.read_text_key(spark, str(folder), split=s).collect())) for s in (False, True))
    assert split == plain and len(plain) > 500


def test_members_of_odd_documents(small_ranges, tmp_path):
    docs = {"empty": "", "object": "{}", "list": " [ ] ", "one": '{"a": 1}', "two": '[1, {"b": [2, 3]}]\n', "long": json.dumps(["x, " * 2000, "y"]), "deep": json.dumps({"k": {"l": ["m,"] * 500}})}
    for name, text in docs.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {}
    for row in json_members(small_ranges, str(tmp_path)).collect():
        got.setdefault(row.path.rsplit("/", 1)[1][:-5], []).append(row.member)
    assert {k: sorted(v) for k, v in got.items()} == {
        "one": ['"a": 1'], "two": ["1", '{"b": [2, 3]}'], "long": sorted([json.dumps("x, " * 2000), '"y"']), "deep": [docs["deep"][1:-1]]
    }


def test_split_field_key(small_ranges, tmp_path):
    path = tmp_path / "fields.json"
    path.write_text(json.dumps({f"i{n}": {"length": n, "material": 'steel, "45"', "holes": [n, "8,5"]} for n in range(200)}))
    one, other = ({r.image: r.fields for r in readers.read_field_key(small_ranges, str(tmp_path / "none.json"), str(path), split=s).collect()} for s in (False, True))
    assert one == other and len(one) == 200
