"""Spanning edges of large cells against brute force."""

import random

import numpy as np
import pytest

from quillrank.llm.cells import spanning
from quillrank.llm.components import components


@pytest.mark.parametrize("kind", ["copies", "paths", "apart", "mixed"])
def test_no_link_of_a_large_cell_is_lost(spark, kind):
    """Points on a line are linked at a distance of 1; cells of up to 400 rows, chunks of 16."""
    rng = random.Random(kind)
    make = {
        "copies": lambda k: 1000 * (k % 3) + rng.randrange(2),
        "paths": lambda k: k + k // 100 * 50,
        "apart": lambda k: 3 * k,
        "mixed": lambda k: rng.choice([5, rng.randrange(3000), 5000 + k]),
    }[kind]
    rows = [(cell, 1000 * cell + k, make(k)) for cell, n in ((1, 400), (2, 3), (3, 40)) for k in range(n)]
    rng.shuffle(rows)

    def near(c):
        x = c["x"]
        return lambda i, j: np.abs(x[i] - x[j]) <= 1

    frame = spark.createDataFrame(rows, "cell long, node long, x long").repartition(5)
    got = {r.node: r.root for r in components(spanning(frame, ["x"], near, 16)).collect()}
    want = {}
    for cell in (1, 2, 3):
        points = sorted((x, node) for c, node, x in rows if c == cell)
        group = [points[0][1]]
        for (x, _), (y, node) in zip(points, [*points[1:], (1 << 40, None)], strict=True):
            if y - x > 1:
                want |= {n: min(group) for n in group if n != min(group)}
                group = []
            group.append(node)
    assert got == want
