"""The grid of an overlap join: few copies, no pair lost."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from sheetscore.operators.overlap import _grid, grid_join

BOX = "struct<idx:long,x1:double,y1:double,x2:double,y2:double>"


@pytest.mark.parametrize("thr,copies", [(0.5, 26), (0.25, 140), (1.0, 1.5)])
def test_grid_meets_all_partners(spark, thr, copies):
    rng = random.Random(11)

    def box():
        x, y, s = rng.uniform(0, 30), rng.uniform(0, 30), 2 ** rng.uniform(-1, 5)
        return (x, y, x + s * rng.uniform(0.5, 2), y + s * rng.uniform(0.5, 2))

    ps = [box() for _ in range(250)]
    # partners whose overlap lies close to the threshold along one axis, beside and inside
    ts = [(p[0] + k * (p[2] - p[0]), p[1], p[2] + k * (p[2] - p[0]), p[3]) for p in ps for k in [(1 - thr) / (1 + thr) * (1 - 1e-12)]]
    ts += [(p[0], p[1] + (p[3] - p[1]) * (1 - thr) * (1 - 1e-12), p[2], p[3]) for p in ps] + [box() for _ in range(100)] + ps[:50]
    side = lambda rows, name: spark.createDataFrame([("i", (j, *b)) for j, b in enumerate(rows)], f"image string, {name} {BOX}")
    p, t = side(ps, "p"), side(ts, "t")
    got = sorted(tuple(r) for r in grid_join(p, t, ["image"], thr).select("p.idx", "t.idx").collect())
    assert got == sorted((i, j) for i, a in enumerate(ps) for j, b in enumerate(ts) if brute.iou(a, b) >= thr)
    assert _grid(p, t, ["image"], thr)[1].count() <= copies * len(ts)
