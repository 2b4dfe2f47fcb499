"""Many rings cut at once, against one at a time."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa

from displace.operators import geom


def test_many_rings_are_cut_as_one_is():
    rng = random.Random(3)

    def ring(n, closed, back):
        turns = sorted(rng.random() * 2 * math.pi for _ in range(n))
        cx, cy, r = rng.random() * 3, rng.random() * 3, 1 + rng.random()
        p = [{"x": cx + r * math.cos(t), "y": cy + r * math.sin(t)} for t in turns][:: -1 if back else 1]
        return p + p[:1] if closed else p

    some = [(ring(rng.randrange(3, 8), i % 2, i % 3 == 0), ring(rng.randrange(3, 7), i % 5 < 2, i % 4 == 0)) for i in range(200)]
    box = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))]
    some += [(box, box), (box, [{"x": v["x"] + 2, "y": v["y"]} for v in box]), ([], box)]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    p, n = geom._cut(*(pa.array([s[k] for s in some], kind) for k in (0, 1)))
    for (a, b), q, m in zip(some, p, n, strict=True):
        want = geom.clip_ring(geom._open(geom._points(a)), geom._anticlockwise(geom._open(geom._points(b))))
        assert len(want) == m and np.allclose(want, q[:m], atol=1e-12)
