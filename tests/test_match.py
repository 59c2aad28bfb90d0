import random

import pytest
from pyspark.sql import functions as F

import brute
from sheetscore.functions.text import lcs_length, word_distance
from sheetscore.operators.assign import greedy_box_match, greedy_text_match, nms
from sheetscore.operators.detection import ap_11_point, curve, evaluate_detection, truth_counts
from sheetscore.operators.overlap import argmax_box_match, gt_hit, overlap_pairs
from sheetscore.operators.prefix import sequential_ids
from sheetscore.operators.strings import char_overlap, match_strings, result_images, string_detail, string_scores, token_flags, whole_text_scores, word_overlap

PRED = "run_id string, image string, class string, pred_idx int, x1 double, y1 double, x2 double, y2 double, score double"
GT = "image string, class string, gt_idx int, x1 double, y1 double, x2 double, y2 double"
SMALL = {}
BLOCKS = {"max_rows": 3, "max_cells": 6}


def boxes(spark, seed=3, images=6, per_image=16, spread=60):
    """Crowded images with copies and equal scores; one image has no prediction, one no truth."""
    rng = random.Random(seed)

    def box():
        x, y = rng.randrange(spread), rng.randrange(spread)
        return (float(x), float(y), float(x + rng.randrange(5, 30)), float(y + rng.randrange(5, 30)))

    gt, pred = [], []
    for i in range(images):
        n = per_image if i else 3 * per_image
        for cls in ("dimension", "table"):
            rows = [box() for _ in range(n)]
            rows[1:3] = [rows[0], rows[0]]
            if i != 4:
                gt += [(f"i{i}", cls, j, *b) for j, b in enumerate(rows)]
            if i != 5:
                for run in ("a", "b"):
                    near = [tuple(v + rng.choice((0, 0, 1, -1)) for v in b) for b in rows] + [box() for _ in range(5)]
                    near += [rows[0]] * 3
                    pred += [(run, f"i{i}", cls, j, *b, rng.randrange(1, 10) / 10) for j, b in enumerate(near)]
    return spark.createDataFrame(pred, PRED), spark.createDataFrame(gt, GT), pred, gt


def grouped(pred, gt):
    groups = {}
    for run, image, cls, i, *box, score in pred:
        groups.setdefault((run, image, cls), ([], []))[0].append((i, tuple(box), score))
    for (run, image, cls), (_, g) in groups.items():
        g += [(j, tuple(b)) for im, c, j, *b in gt if (im, c) == (image, cls)]
    return groups


@pytest.mark.parametrize("bounds", [SMALL, {**BLOCKS, "block": 24}])
def test_box_match(spark, bounds):
    p, g, pred, gt = boxes(spark)
    got = {(r.run_id, r.image, r["class"], r.pred_idx): (r.gt_idx, r.scored) for r in greedy_box_match(p, g, **bounds).collect()}
    assert len(got) == len(pred)
    for key, (ps, gs) in grouped(pred, gt).items():
        for i, j in brute.box_match(ps, gs).items():
            assert got[(*key, i)] == (j, bool(gs))


@pytest.mark.parametrize("bounds", [SMALL, {"max_rows": 3, "block": 30}])
def test_nms(spark, bounds):
    p, _, pred, gt = boxes(spark)
    got = {}
    for r in nms(p, **bounds).collect():
        got.setdefault((r.run_id, r.image, r["class"]), set()).add(r.pred_idx)
    for key, (ps, _) in grouped(pred, gt).items():
        assert got[key] == brute.suppress(ps)


@pytest.mark.parametrize("bounds", [SMALL, BLOCKS])
@pytest.mark.parametrize("thr", [0.5, 0.3, 0.8])
def test_overlap_joins(spark, bounds, thr):
    p, g, pred, gt = boxes(spark)
    want, hit = set(), set()
    for key, (ps, gs) in grouped(pred, gt).items():
        for i, a, score in ps:
            for j, b in gs:
                if brute.iou(a, b) >= thr:
                    want.add((*key, i, j))
                    if score >= 0.25:
                        hit.add((*key, j))
    pairs = [tuple(r)[:5] for r in overlap_pairs(p, g, thr, **bounds).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    hits = [tuple(r) for r in gt_hit(p, g, 0.25, thr, **bounds).select("run_id", "image", "class", "gt_idx").collect()]
    assert len(hits) == len(set(hits)) and set(hits) == hit


@pytest.mark.parametrize("bounds", [SMALL, BLOCKS])
def test_argmax_match(spark, bounds):
    p, g, pred, gt = boxes(spark)
    got = {tuple(r)[:3] + (r.pred_idx,): (r.is_tp, r.gt_idx) for r in argmax_box_match(p, g, **bounds).collect()}
    for key, (ps, gs) in grouped(pred, gt).items():
        used = set()
        for i, a, _ in sorted(ps, key=lambda x: (-x[2], x[0])):
            best, j = max(((brute.iou(a, b), -k) for k, b in gs), default=(0, 0))
            first = best >= 0.5 and -j not in used
            if best >= 0.5:
                used.add(-j)
            assert got[(*key, i)] == (int(first), -j if best >= 0.5 else None)


@pytest.mark.parametrize("max_rows", [10**6, 10])
def test_detection_scores(spark, max_rows):
    from sheetscore.operators.detection import detection_rollup, detection_scores

    p, g, pred, gt = boxes(spark)
    marks = greedy_box_match(p, g)
    got = {(r.run_id, r["class"]): r for r in detection_scores(marks, p, g, 0.25, max_rows).collect()}
    for run in "ab":
        for cls in ("dimension", "table"):
            rows, n_gt = [], sum(1 for r in gt if r[1] == cls)
            for key, (ps, gs) in grouped(pred, gt).items():
                if (key[0], key[2]) == (run, cls) and gs:
                    m = brute.box_match(ps, gs)
                    rows += [(-s, key[1], i, int(m[i] is not None)) for i, _, s in ps]
            rows.sort()
            hits = [r[3] for r in rows]
            r = got[(run, cls)]
            assert r.map50 == pytest.approx(brute.average_precision(hits, n_gt))
            sure = [r_[3] for r_ in rows if -r_[0] >= 0.25]
            assert (r.tp, r.fp, r.fn) == (sum(sure), len(sure) - sum(sure), n_gt - sum(sure))
            best, conf, tp = 0.0, 0.25, 0
            for n, row in enumerate(rows, 1):
                tp += row[3]
                pr, rc = tp / n, tp / n_gt
                f = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
                if f > best:
                    best, conf = f, -row[0]
            assert r.best_f1 == pytest.approx(best) and r.best_conf == conf
            assert r.n_pred == sum(1 for x in pred if (x[0], x[2]) == (run, cls))
    roll = detection_rollup(spark.createDataFrame(list(got.values()))).collect()
    assert {r.run_id for r in roll} == {"a", "b"}


def test_hand_case_detection(spark):
    g = spark.createDataFrame([("i", "table", 0, 0.0, 0.0, 10.0, 10.0)], GT)
    p = spark.createDataFrame(
        [("r", "i", "table", 0, 0.0, 0.0, 10.0, 10.0, 0.9), ("r", "i", "table", 1, 0.0, 0.0, 10.0, 9.0, 0.8)], PRED
    )
    r = evaluate_detection(p, g).first()
    assert (r.tp, r.fp, r.fn, r.map50, r.precision, r.recall) == (1, 1, 0, 1.0, 0.5, 1.0)
    assert r.f1 == pytest.approx(2 / 3) and (r.best_f1, r.best_conf) == (1.0, 0.9)
    two = spark.createDataFrame([("i", "table", j, 0.0, 0.0, 10.0, 10.0) for j in (0, 1)], GT)
    assert greedy_box_match(p.limit(1), two).first().gt_idx == 1


@pytest.mark.parametrize("max_rows", [10**6, 10])
def test_ap_11_point(spark, max_rows):
    p, g, pred, gt = boxes(spark)
    got = {(r.run_id, r["class"]): r.ap for r in ap_11_point(p, g, max_rows=max_rows).collect()}
    marks = argmax_box_match(p, g).collect()
    for (run, cls), ap in got.items():
        rows = sorted((-m.score, m.image, m.pred_idx, m.is_tp) for m in marks if (m.run_id, m["class"]) == (run, cls))
        n_gt, tp, pts = sum(1 for r in gt if r[1] == cls), 0, []
        for n, row in enumerate(rows, 1):
            tp += row[3]
            pts.append((tp / (n_gt + 1e-6), tp / (n + 1e-6)))
        want = sum(max((q for rec, q in pts if rec >= t / 10), default=0) for t in range(11)) / 11
        assert ap == pytest.approx(want)


def test_sequential_ids(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "k int")
    for bound in (1000, 10):
        assert all(r.k == r.n for r in sequential_ids(df, [F.asc("k")], "n", max_rows=bound).collect())


# --- strings -----------------------------------------------------------------

TEXT_GT = "image string, gt_idx int, text string"
TEXT_PRED = "run_id string, image string, pred_idx int, text string"


def texts(spark, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aBc1") for _ in range(rng.randrange(1, 7)))
    line = lambda: " ".join(word() for _ in range(rng.randrange(1, 4)))
    gt, pred = [], []
    for i in range(5):
        lines = [line() for _ in range(30 if i == 0 else 8)]
        lines[1] = lines[0]
        if i != 3:
            gt += [(f"i{i}", j, t) for j, t in enumerate(lines)]
        if i != 4:
            for run in "ab":
                out = [t[1:] or "x" for t in lines[: rng.randrange(3, len(lines))]] + [line(), " "]
                pred += [(run, f"i{i}", j, t) for j, t in enumerate(out)]
    return spark.createDataFrame(gt, TEXT_GT), spark.createDataFrame(pred, TEXT_PRED), gt, pred


@pytest.mark.parametrize("bounds", [SMALL, {**BLOCKS, "block": 12}])
def test_text_match(spark, bounds):
    g, p, gt, pred = texts(spark)
    got = {(r.run_id, r.image, r.gt_idx): r for r in match_strings(g, p, result_images(p), **bounds).collect()}
    n = 0
    for run in "ab":
        for i in range(5):
            gs = [(j, " ".join(t.lower().split())) for im, j, t in gt if im == f"i{i}"]
            ps = {j: " ".join(t.lower().split()) for r, im, j, t in pred if (r, im) == (run, f"i{i}") and t.strip()}
            if not gs or not ps:
                continue
            for j, k in brute.text_match(gs, list(ps.items())).items():
                row, norm, best = got[(run, f"i{i}", j)], dict(gs)[j], ps.get(k, "")
                n += 1
                assert row.pred_idx == k and row.dist == brute.edit(norm, best)
                assert row.word_edits == min(brute.edit(norm.split(), best.split()), len(norm.split()))
    assert n == len(got)


def test_hand_case_strings(spark):
    g = spark.createDataFrame([("i", 0, "abc"), ("i", 1, "abd"), ("skipped", 0, "x")], TEXT_GT)
    p = spark.createDataFrame([("r", "i", 0, "abd")], TEXT_PRED)
    r = string_scores(g, p, result_images(p)).first()
    assert (r.char_edits, r.gt_chars, r.exact, r.found, r.n_gt, r.evaluated_images) == (4, 6, 0, 1, 2, 1)
    assert r.cer == pytest.approx(2 / 3) and r.wer == 1.0 and (r.recall, r.precision) == (0.5, 1.0)
    truth, extra = string_detail(g, p, result_images(p))
    assert [x.found for x in truth.orderBy("gt_idx").collect()] == [True, False]
    assert [x.matched for x in extra.collect()] == [True]


def test_hand_case_whole_text(spark):
    g = spark.createDataFrame([("i", 0, "A b"), ("i", 1, "b")], TEXT_GT)
    p = spark.createDataFrame([("r", "i", 0, "b c")], TEXT_PRED)
    r = whole_text_scores(g, p, result_images(p)).first()
    assert (r.n_gt_words, r.n_pred_words, r.matched_words, r.lcs, r.gt_chars) == (3, 2, 1, 2, 5)
    assert r.word_coverage == pytest.approx(1 / 3) and r.char_coverage == 0.4 and r.word_precision == 0.5
    flags = token_flags(g, p, result_images(p)).orderBy("gt_idx", "pos").collect()
    assert [x.matched for x in flags] == [False, True, False]


def test_whole_text_against_brute_force(spark):
    from collections import Counter

    g, p, gt, pred = texts(spark)
    over = {(r.run_id, r.image): r for r in word_overlap(g, p, result_images(p)).collect()}
    chars = {(r.run_id, r.image): r for r in char_overlap(g, p, result_images(p)).collect()}
    for (run, image), r in over.items():
        a = " ".join(t for im, _, t in gt if im == image).lower().split()
        b = " ".join(t for q, im, _, t in pred if (q, im) == (run, image)).lower().split()
        assert (r.n_gt_words, r.n_pred_words) == (len(a), len(b))
        assert r.matched_words == sum((Counter(a) & Counter(b)).values())
        assert chars[(run, image)].lcs == brute.lcs(" ".join(a), " ".join(b))
    for bound in (10**6, 2):
        flags = token_flags(g, p, result_images(p), max_rows=bound).groupBy("run_id", "image").agg(F.count_if("matched").alias("n"))
        assert {(r.run_id, r.image): r.n for r in flags.collect()} == {k: r.matched_words for k, r in over.items()}


def test_distances(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abcé ") for _ in range(rng.randrange(40))), "".join(rng.choice("abcé ") for _ in range(rng.randrange(40)))) for _ in range(80)]
    df = spark.createDataFrame([(a, b, a.split(), b.split()) for a, b in rows], "a string, b string, wa array<string>, wb array<string>")
    for r in df.select("*", lcs_length("a", "b").alias("l"), word_distance(F.col("wa"), F.col("wb")).alias("w")).collect():
        assert r.l == brute.lcs(r.a, r.b) and r.w == brute.edit(r.wa, r.wb)
