"""As-of joins against brute force."""

import random

import pytest

from framelake.operators.asof import asof_join
from framelake.operators.dataset import Dataset


def tables(spark, seed, hot):
    r = random.Random(seed)
    key = lambda: 1 if r.random() < hot else r.choice([1, 2, 3, 4, None])
    left = [(i, key(), r.choice([None, *range(60)]), r.choice("xyz")) for i in range(300)]
    right = [(key(), r.choice([None, *range(60)]), r.choice([None, 1, 2, 3]), r.choice("pq")) for _ in range(200)]
    return left, right, spark.createDataFrame(left, "id long, k int, t int, v string"), spark.createDataFrame(right, "k int, t int, n int, v string")


@pytest.mark.parametrize("hot", [0.0, 0.9])
@pytest.mark.parametrize("ranges", [1, 7])
def test_the_latest_row_before(spark, hot, ranges):
    left, right, a, b = tables(spark, 3, hot)
    order = lambda x: tuple((v is not None, v) for v in x)  # noqa: E731  nulls are least
    want = []
    for i, k, t, v in left:
        fits = [(rt, n, rv) for rk, rt, n, rv in right if None not in (k, t, rt) and rk == k and rt <= t]
        want.append((i, k, t, v, *max(fits, key=order, default=(None, None, None))))
    out = asof_join(a.repartition(3), b.repartition(2), ["k"], "t", ranges=ranges)
    assert out.columns == ["id", "k", "t", "v", "right_t", "n", "right_v"]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert Dataset(a).asof_join(Dataset(b), ["k"], "t").count() == 300
    assert asof_join(a.limit(0), b, ["k"], "t").count() == 0
    assert {r["n"] for r in asof_join(a, b.limit(0), ["k"], "t").collect()} == {None}
