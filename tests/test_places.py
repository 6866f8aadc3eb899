import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import places


@pytest.fixture
def rows(spark):
    # one group holds most rows; one is null; column names that sound like the operator's own
    told = [("hot" if i % 10 else None if i % 20 else "b", (i * 7919) % 1000, i) for i in range(1000)]
    return spark.createDataFrame(told, "g string, at int, place0 int").repartition(7)


def test_places_are_those_of_a_sorted_list(rows):
    got = {(r.g, r.at): r.nth for r in places.numbered(rows, ["g"], ["at"], "nth").collect()}
    want = {}
    for g, at in sorted(got, key=lambda x: x[1]):
        want[g] = want.get(g, 0) + 1
        assert got[g, at] == want[g]
    assert len(got) == 1000


def test_parts_are_dealt_in_turn(rows):
    counts = {(r.g, r.part): r["count"] for r in places.parts(rows, ["at"], ["g"], 3).groupBy("g", "part").count().collect()}
    assert all(counts["hot", p] == 300 for p in range(3))


def test_no_rows_and_equal_rows(spark, rows):
    assert places.numbered(rows.where("false"), ["g"], ["at"], "nth").collect() == []
    same = spark.createDataFrame([("a", 1)] * 5, "g string, at int")
    assert sorted(r.nth for r in places.numbered(same, ["g"], ["at"], "nth").collect()) == [1, 2, 3, 4, 5]


def test_digest_is_that_of_blocks(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level = [sha(str(at)) for at in sorted(range(1000))]
    for _ in range(2):
        level = [sha("\n".join(level[a : a + 16])) for a in range(0, len(level), 16)]
    got = places.block_digest(rows, ["at"], F.col("at").cast("string"), block=16).first().digest
    assert got == sha("\n".join(level))
    assert places.block_digest(rows.where("false"), ["at"], F.col("at").cast("string")).first().digest == sha("")


def test_values_carried_along_an_order(spark):
    """Sums and last values of a group that lies in many partitions, beside columns of clashing names."""
    r = random.Random(8)
    rows = [(r.choice(["a", "a", "a", None, "b"]), i, r.choice([None, None, f"v{i}"]), r.randrange(9), 7) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, t int, v string, n int, at_part int").repartition(6)
    got = {x.t: (x.total, x.latest, x.at_part) for x in places.running(df, ["g"], ["t"], {"total": "n"}, {"latest": "v"}).collect()}
    want, state = {}, {}
    for g, t, v, n, _ in rows:
        total, latest = state.get(g, (0, None))
        state[g] = (total + n, v or latest)
        want[t] = (*state[g], 7)
    assert got == want
