import random

import numpy as np
import pytest

from tessera.operators import rolling

UNITS = "repo string, kind string, unit_id string, bytes int"


def plain(rows, most, size):
    out, groups = {}, {}
    for repo, kind, unit, length in rows:
        groups.setdefault((repo, kind), []).append((unit, length))
    for key, own in groups.items():
        n = filled = number = 0
        for unit, length in sorted(own):
            if n and (filled + length > size or n >= most):
                n, filled, number = 0, 0, number + 1
            n, filled = n + 1, filled + length
            out[*key, unit] = number
    return out


@pytest.mark.parametrize(("most", "size", "fan", "chunk"), [(4, 60, 2, 2), (7, 10**9, 3, 1), (5, 1, 64, 8), (10, 100, 4, 8), (200, 5000, 64, 8)])
def test_equals_one_walk_a_group(spark, most, size, fan, chunk):
    r = random.Random(most)
    rows = [(repo, kind, f"u{i:05d}", r.choice([0, 1, r.randrange(30), 90])) for repo, n in (("big", 700), ("one", 1), ("small", 33), (None, 50)) for kind in ("doc", None) for i in r.sample(range(10**5), n)]
    units = spark.createDataFrame(rows, UNITS).repartition(7)
    found = rolling.rolled(units, most, size, fan, chunk).collect()
    assert len(found) == len(rows) and {(x.repo, x.kind, x.unit_id): x.number for x in found} == plain(rows, most, size)


def test_maps_lead_where_the_walk_leads():
    r = np.random.default_rng(4)
    for _ in range(60):
        most, size, own = int(r.integers(1, 9)), int(r.integers(1, 60)), int(r.integers(9, 30))
        lengths = r.integers(0, 25, own + most)
        exits, counts = rolling.chunk_map(lengths, own, most, size)
        for e in range(most):
            at, starts = e, 0
            while at < own:
                n = filled = 0
                while at < len(lengths) and (not n or (filled + lengths[at] <= size and n < most)):
                    n, filled, at = n + 1, filled + lengths[at], at + 1
                starts += 1
            assert (exits[e], counts[e]) == (at - own, starts)


def test_no_units(spark):
    assert rolling.rolled(spark.createDataFrame([], UNITS), 5, 5).collect() == []
