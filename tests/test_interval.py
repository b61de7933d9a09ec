import datetime
import random

import pytest
from pyspark.sql import functions as F

from framelake.operators.dataset import Dataset
from framelake.operators.interval import interval_join


def pairs(a, b):
    met = lambda x, y: None not in (*x[1:4], *y[1:4]) and x[2] <= x[3] and y[2] <= y[3] and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]
    return sorted((x[0], y[0]) for x in a for y in b if met(x, y))


@pytest.mark.parametrize("seed", range(4))
def test_pairs_of_long_and_short_intervals(spark, seed):
    r = random.Random(seed)

    def some(n, longest):
        out = []
        for i in range(n):
            start = r.randint(-3000, 3000)
            out.append((i, r.choice(["hot", "hot", "cold", None]), start, start + (0 if r.random() < 0.3 else int(longest ** r.random()))))
        return [*out, (n, "hot", 5, 4), (n + 1, "hot", None, 4), (n + 2, "hot", -(1 << 63), (1 << 63) - 1), out[0], out[0]]

    a, b = some(60, 9), some(60, 5000)
    df = lambda rows: spark.createDataFrame(rows, "id long, key string, s long, e long").withColumns({"_start": F.lit(1), "_bin": F.lit(2)})
    out = interval_join(df(a), df(b), ["key"], ("s", "e"))
    assert out.columns == ["id", "key", "s", "e", "_start", "_bin", "right_id", "right_s", "right_e", "right__start", "right__bin"]
    assert sorted((x["id"], x["right_id"]) for x in out.collect()) == pairs(a, b)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert interval_join(df(a).limit(0), df(b), ["key"], ("s", "e")).count() == 0 == interval_join(df(a), df(b).where("key IS NULL"), ["key"], ("s", "e")).count()


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "double", "decimal(12,2)", "int"])
def test_points_in_intervals_of_any_kind(spark, kind):
    r = random.Random(kind)
    day = datetime.date(2021, 3, 1)
    value = {
        "date": lambda x: day + datetime.timedelta(days=int(x)),
        "double": lambda x: x / 7,
        "decimal(12,2)": lambda x: __import__("decimal").Decimal(int(x)) / 100,
        "int": int,
    }.get(kind, lambda x: datetime.datetime(1969, 12, 31, 23) + datetime.timedelta(seconds=x))
    points = [(i, 1, p, p) for i, p in enumerate(value(r.uniform(0, 900)) for _ in range(50))]
    spans = [(i, 1, value(x), value(x + r.uniform(1, 90))) for i, x in enumerate(r.uniform(0, 900) for _ in range(40))]
    left = spark.createDataFrame([(i, k, p) for i, k, p, _ in points], f"id long, key int, at {kind}")
    right = spark.createDataFrame(spans, f"no long, key int, since {kind}, till {kind}")
    out = Dataset(left).interval_join(Dataset(right), ["key"], ("at", "at"), ("since", "till"))
    assert out.df.columns == ["id", "key", "at", "no", "since", "till"]
    assert sorted((x["id"], x["no"]) for x in out) == pairs(points, spans)
    assert Dataset(left).interval_join(Dataset(right), [], ("at", "at"), ("since", "till")).count() == out.count()
