"""Greedy matching and suppression of crowded images against the sequential loops."""

import random

import pytest

import brute
from sheetscore.operators import crowded
from sheetscore.operators.assign import greedy_box_match, nms
from test_match import GT, PRED, boxes, grouped

PLANS = [({"max_rows": 3}, crowded.MEETINGS), ({"max_rows": 3, "walk": 4}, crowded.MEETINGS), ({"max_rows": 3}, -1)]  # walk, rounds, dense
CELLS = {"max_cells": 6}


@pytest.mark.parametrize("bounds, meetings", PLANS)
def test_match(spark, monkeypatch, bounds, meetings):
    monkeypatch.setattr(crowded, "MEETINGS", meetings)
    p, g, pred, gt = boxes(spark)
    got = {(r.run_id, r.image, r["class"], r.pred_idx): (r.gt_idx, r.scored) for r in greedy_box_match(p, g, **bounds, **CELLS).collect()}
    assert len(got) == len(pred)
    for key, (ps, gs) in grouped(pred, gt).items():
        for i, j in brute.box_match(ps, gs).items():
            assert got[(*key, i)] == (j, bool(gs))


@pytest.mark.parametrize("bounds, meetings", PLANS)
def test_suppression(spark, monkeypatch, bounds, meetings):
    monkeypatch.setattr(crowded, "MEETINGS", meetings)
    p, _, pred, gt = boxes(spark)
    got = {}
    for r in nms(p, **bounds).collect():
        got.setdefault((r.run_id, r.image, r["class"]), []).append(r.pred_idx)
    for key, (ps, _) in grouped(pred, gt).items():
        assert sorted(got[key]) == sorted(brute.suppress(ps))


def field(n, seed=9):
    """A large image: boxes on a wide sheet, each near one or two others, with odd ones mixed in."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, s = r.randrange(0, 20 * int(n**0.5)), r.randrange(0, 20 * int(n**0.5)), r.choice([20, 30, 45])
        rows.append((i, (float(x), float(y), float(x + s), float(y + s)), r.randrange(1, 50) / 50))
    rows[5] = (5, (3.0, 3.0, 3.0, 9.0), 0.9)
    rows[6] = (6, (1.0, float("nan"), 3.0, 9.0), 0.9)
    rows[7] = (7, rows[8][1], rows[8][2])
    return rows


@pytest.mark.parametrize("walk", [crowded.WALK, 300])
def test_one_large_image(spark, walk):
    rows, truth = field(1500), field(1200, 10)
    p = spark.createDataFrame([("r", "i", "c", i, *b, s) for i, b, s in rows], PRED).repartition(4)
    g = spark.createDataFrame([("i", "c", i, *b) for i, b, _ in truth], GT).repartition(4)
    odd = {5, 6}
    want = brute.box_match([x for x in rows if x[0] not in odd], [(i, b) for i, b, _ in truth if i not in odd])
    got = {r.pred_idx: r.gt_idx for r in greedy_box_match(p, g, max_rows=100, walk=walk).collect()}
    assert got == want | {i: None for i in odd} and sum(j is not None for j in want.values()) > 100
    kept = [r.pred_idx for r in nms(p, 0.3, max_rows=100, walk=walk).collect()]
    assert sorted(kept) == sorted(brute.suppress([x for x in rows if x[0] not in odd], 0.3) | odd)
