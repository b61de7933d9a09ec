"""Event-time windows of a stream against a row-by-row reckoning in Python."""

import datetime
import json
import random

import pytest

from framelake.sources import storage
from framelake.streaming import windows
from framelake.streaming.windows import EventWindows

AT = datetime.datetime(2023, 4, 5, 6)
EPOCH = datetime.datetime(1970, 1, 1)
SECOND = datetime.timedelta(seconds=1)
SCHEMA = "id long, k string, t {}, v double"
AGGS = {"n": ("count", None), "n_v": ("count", "v"), "total": ("sum", "v"), "least": ("min", "v"), "most": ("max", "v"), "mean": ("avg", "v")}


def batches(seed, n=5):
    """Rows whose times go on from batch to batch, some of them far behind; a hot key, nulls, ties."""
    r, out, i = random.Random(seed), [], 0
    for b in range(n):
        rows = []
        for _ in range(r.choice([0, 1, 30, 60])):
            t = b * 100 + r.randint(0, 120) - (r.random() < 0.2) * r.randint(0, 300)
            rows.append((i, r.choice(["hot", "hot", "hot", "b", None]), None if r.random() < 0.05 else max(t, 0), r.choice([None, 1.0, -2.5, 4.0])))
            i += 1
        out.append(rows)
    return out


def reckoned(parts, size, sessions, delay):
    """Late ids and the windows of all other rows."""
    late, kept, mark = [], [], None
    for rows in parts:
        for i, k, t, v in rows:
            over = t is None or (mark is not None and (t < mark if sessions else t // size * size + size <= mark))
            late.append(i) if over else kept.append((k, t, v))
        times = [t for _, _, t, _ in rows if t is not None]
        mark = max((x for x in (mark, max(times) - delay if times else None) if x is not None), default=None)
    found = []
    for k in {k for k, _, _ in kept}:
        rows = sorted(((t, v) for q, t, v in kept if q == k), key=lambda x: x[0])
        groups = []
        for t, v in rows:
            same = groups and (t - groups[-1][-1][0] <= size if sessions else t // size == groups[-1][-1][0] // size)
            groups[-1].append((t, v)) if same else groups.append([(t, v)])
        for g in groups:
            first, last = (g[0][0], g[-1][0] + size) if sessions else (g[0][0] // size * size, g[0][0] // size * size + size)
            vs = [v for _, v in g if v is not None]
            found.append((k, first, last, len(g), len(vs), sum(vs) if vs else None, min(vs, default=None), max(vs, default=None), sum(vs) / len(vs) if vs else None))
    return sorted(late), sorted(found, key=repr), mark


def seconds(x):
    return int((x.replace(tzinfo=None) - EPOCH).total_seconds())


@pytest.mark.parametrize("kind,sessions,delay,seed", [("timestamp_ntz", False, 20, 1), ("timestamp", False, 0, 2), ("timestamp_ntz", True, 30, 3), ("timestamp", True, 0, 4)])
def test_windows_are_those_of_all_rows_but_late_ones(spark, tmp_path, kind, sessions, delay, seed):
    src, out, marks = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    parts, size = batches(seed), 25
    span = {"gap" if sessions else "length": size * SECOND}
    spec = EventWindows("t", ["k"], AGGS, delay=delay * SECOND, **span)
    stream = lambda: spark.readStream.schema(SCHEMA.format(kind)).json(str(src))
    fields = lambda t: None if t is None else (EPOCH + t * SECOND).isoformat() + ("Z" if kind == "timestamp" else "")
    for n, rows in enumerate(parts):  # a stream that is started anew for each batch
        (src / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "k": k, "t": fields(t), "v": v}) for i, k, t, v in rows))
        windows.start(stream(), spec, f"{out}/{{date}}", marks, clock=lambda: AT, format="parquet").awaitTermination()
    late, found, mark = reckoned(parts, size, sessions, delay)
    read = lambda p: spark.read.parquet(*f) if (f := [x for x in storage.files(spark, out) if p in x and x.endswith(".parquet")]) else None
    aside = read("/BACKOUT/")
    assert late and sorted(r["id"] for r in aside.collect()) == late
    given, still = read("/2023-04-05/"), windows.open_windows(spark, spec, marks)
    rows = lambda df: [(r["k"], seconds(r["window_start"]), seconds(r["window_end"]), *(r[a] for a in AGGS)) for r in df.collect()]
    assert sorted(rows(given) + rows(still), key=repr) == found
    is_over = lambda w: w[2] < mark if sessions else w[2] <= mark
    assert all(map(is_over, rows(given))) and not any(map(is_over, rows(still)))


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    spec = EventWindows("t", ["k"], {"n": ("count", None)}, length=10 * SECOND)
    row = lambda i, t: (i, "a", EPOCH + t * SECOND, 1.0)
    make = lambda *rows: spark.createDataFrame(list(rows), SCHEMA.format("timestamp_ntz"))
    state, template = str(tmp_path / "state"), f"{tmp_path}/out/{{date}}"
    with pytest.raises(ValueError):
        windows.write_batch(make(row(0, 1)), 3, spec, template, state, AT, "parquet")
    for i, df in ((0, make(row(0, 1), row(1, 2))), (1, make(row(2, 3), row(3, 25), row(3, 25))), (1, make(row(2, 3), row(3, 25), row(3, 25))), (2, make(row(4, 4))), (2, make(row(4, 4))), (3, make())):
        windows.write_batch(df, i, spec, template, state, AT, "parquet")
    files = [f for f in storage.files(spark, f"{tmp_path}/out") if f.endswith(".parquet")]
    read = lambda p: spark.read.parquet(*[f for f in files if p in f]).collect()
    assert [(seconds(r["window_start"]), r["n"]) for r in read("/2023-04-05/")] == [(0, 3)]
    assert [r["id"] for r in read("/BACKOUT/")] == [4]


def test_bad_windows_are_refused():
    for wrong in ({}, {"length": SECOND, "gap": SECOND}, {"length": 0 * SECOND}, {"gap": SECOND, "delay": -SECOND}):
        with pytest.raises(ValueError):
            EventWindows("t", [], {"n": ("count", None)}, **wrong)
    with pytest.raises(ValueError):
        EventWindows("t", [], {"n": ("median", "v")}, length=SECOND)
    with pytest.raises(ValueError):
        EventWindows("t", ["n"], {"n": ("count", None)}, length=SECOND)
