import random
from collections import Counter

from pyspark.sql import functions as F

from sheetscore.llm import licenses as lc
from sheetscore.llm.common import prepare


def brute(text, templates, threshold):
    words, found = lc.words_of(text), []
    for t, (name, template) in enumerate(templates):
        w = lc.words_of(template)
        want = Counter(zip(w, w[1:]))
        size = len(w) - 1
        for a in range(len(words) - 1):
            best = None
            for e in range(a + 2, min(len(words), a + 1 + int(size * (2 / threshold - 1)) + 2) + 1):
                got = Counter(zip(words[a : e - 1], words[a + 1 : e]))
                best = max(best or (0, 0), (2 * sum((got & want).values()) / (e - a - 1 + size), e - a - 1))
            if best and best[0] >= threshold:
                found.append((-best[0], -best[1], a, t, name))
    out, spans = [], [m.span() for m in lc.WORD.finditer(text)]
    taken = []
    for d, n, a, _, name in sorted(found):
        e = a - n + 1
        if all(e <= x or a >= y for x, y in taken):
            taken.append((a, e))
            out.append((name, -d, spans[a][0], spans[e - 1][1]))
    return sorted(out, key=lambda m: m[2])


def make(seed):
    r = random.Random(seed)
    filler = ["Some other words here.", "the license of the software", "a b; c d", "x", "to the, extent possible. under law"]
    out = []
    for _ in range(r.randrange(1, 7)):
        name, text = r.choice(lc.TEMPLATES)
        w = text.split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = r.choice(["foo", "the", "of.", "bar\nbaz"])
        out += [" ".join(w) if r.random() < 0.7 else text.upper(), r.choice(filler)]
    return r.choice(["\n", " ", ". ", "\n\n"]).join(out)


def test_scan_matches_brute_force():
    scanner, some = lc.Scanner(), 0
    for seed in range(25):
        text = make(seed)
        got = scanner.scan(text)
        assert got == brute(text, lc.TEMPLATES, lc.THRESHOLD), seed
        some += len(got)
    assert some > 25
    for threshold in (0.5, 1.0):
        assert lc.Scanner(threshold=threshold).scan(make(3)) == brute(make(3), lc.TEMPLATES, threshold)


def test_embedded_short_and_reworded_notices():
    cases = {
        "This software is released under the MIT License.": ["MIT"],
        "All of the code that we wrote is, unless noted, Licensed under the Apache License 2.0 and free": ["Apache-2.0"],
        "// SPDX-License-Identifier: MIT": ["MIT"],
        "# SPDX-License-Identifier: LGPL-2.1-only\nimport x": ["LGPL-2.1"],
        "see (this work is licensed under the GNU General Public License) for it": ["GPL"],
        "it is licensed under the GNU General Public License, version 2, since then": ["GPL-2.0"],
        "Text. Permission is hereby granted, free of charge, to any person who obtains " + lc._MIT.split("obtaining ")[1] + " And on it goes": ["MIT"],
        "one under the MIT License and one under the ISC License": ["MIT", "ISC"],
        "Licensed under CC BY-NC-SA 4.0": ["CC-BY-NC-SA-4.0"],
        "The license of the software is under review, MIT says.": [],
        "They granted him permission, free of charge, to copy the software.": [],
    }
    scanner = lc.Scanner()
    for text, names in cases.items():
        assert [m[0] for m in scanner.scan(text)] == names, text
        assert scanner.scan(text) == brute(text, lc.TEMPLATES, lc.THRESHOLD)


def test_every_template_is_found_as_itself():
    scanner = lc.Scanner()
    for name, text in lc.TEMPLATES:
        padded = f"Words before, no notice.\n{text}\nWords after it."
        (found,) = scanner.scan(padded)
        assert found[:2] == (name, 1.0) and lc.words_of(padded[found[2] : found[3]]) == lc.words_of(text)


def test_tables(spark):
    prepare(spark)
    texts = [None, "", "plain", "MIT", "Licensed under CC BY-NC 4.0.\n" * 3, "İİ. Released under the MIT License.", "w " * 100_000 + "\nReleased under the MIT License."]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("license", F.lit("x")).withColumn("first", F.lit("x"))
    rows = lc.license_scan(docs).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == [(4, "CC-BY-NC-4.0")] * 3 + [(5, "MIT"), (6, "MIT")]
    assert all(lc.words_of(texts[r.doc_id][r.first : r.last])[0] in ("licensed", "released") for r in rows)
    assert lc.license_scan(docs.limit(0)).count() == 0


def test_whole_table_against_plain_search(spark):
    prepare(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {(r.doc_id, r.license) for r in lc.license_scan(docs).collect()}
    lines = {lc_line: name for name, lc_line in (("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."))}
    want = {(r.doc_id, lines[line]) for r in docs.select("doc_id", "text").collect() for line in r.text.split("\n") if line in lines}
    assert rows == want and len(want) > 5
