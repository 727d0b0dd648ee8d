"""State machines, versions and policies against plain folds, restarts and hand-made cases."""

import datetime
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from wayfold.operators import policy
from wayfold.sources import versions
from wayfold.streaming import bounded, proximity

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REQUEST = "owner long, request_id long, ts timestamp, key string, ok boolean"


def _requests(n, owners, seed=1):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    return [(rng.randrange(owners), i, start + datetime.timedelta(seconds=i // 3), rng.choice("abcdefg"), rng.random() > 0.1) for i in range(n)]


def _by_hand(rows, limit):
    caches, out = {}, []
    for owner, request, _, key, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        held = caches.setdefault(owner, [])
        outcome, evicted = "hit" if key in held else "stored" if ok else "failed", None
        if outcome == "stored":
            held.append(key)
            if len(held) > limit:
                evicted = held.pop(0)
        out.append((owner, request, outcome, evicted, len(held)))
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_cache_by_hand(spark, limit):
    rows = _requests(900, 5)
    df = spark.createDataFrame([*rows, (1, 5000, rows[0][2], None, True)], REQUEST).repartition(6)
    assert sorted(tuple(r) for r in bounded.batch(df, limit).collect()) == _by_hand(rows, limit)
    assert bounded.batch(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="at least one"):
        bounded.batch(df, 0)


def test_cache_entries_grow_old():
    entries, told = [], []
    for at, key in ((0, "a"), (5, "b"), (9, "a"), (10, "a"), (14, "b"), (16, "b")):
        entries, outcome, _ = bounded.serve(entries, key, at, True, 2, 10)
        told.append(outcome)
    assert told == ["stored", "stored", "hit", "stored", "hit", "stored"] and entries == [("a", 10), ("b", 16)]


def test_cache_streams_like_its_batch_across_restarts(spark, tmp_path):
    rows = _requests(400, 4, seed=7)
    parts = [rows[i : i + 80] for i in range(0, 400, 80)]
    source, place, out = tmp_path / "in", tmp_path / "check", tmp_path / "out"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for few in (parts[:2], parts[2:3], parts[3:]):  # a query that is stopped and goes on from its checkpoint
            for part in few:
                spark.createDataFrame(part, REQUEST).coalesce(1).write.mode("append").parquet(str(source))
            read = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(str(source))
            q = bounded.stream(read, 3).writeStream.format("parquet").option("checkpointLocation", str(place)).option("path", str(out)).trigger(availableNow=True).start()
            q.awaitTermination(180)
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(tuple(r) for r in spark.read.parquet(str(out)).collect()) == _by_hand(rows, 3)


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/layers"
    one, two, three = (spark.range(n).toDF("id") for n in (1, 2, 3))
    assert versions.current(spark, root) is None
    first = versions.upgrade({"a": one}, root, None)
    assert versions.current(spark, root) == first and first.number == 0
    # written but never activated: nobody sees it
    crashed = versions.write({"a": three}, root)
    assert versions.current(spark, root) == first
    # two writers that began with the same version
    second = versions.upgrade({"a": two, "b": one}, root, 0)
    with pytest.raises(versions.Conflict):
        versions.upgrade({"a": three}, root, 0)
    # the second of two claims of one number loses, although both looked at the log before
    real, versions._log = versions._log, lambda *_: [0]
    try:
        with pytest.raises(versions.Conflict, match="meanwhile"):
            versions.activate(spark, root, crashed, ("a",), 0)
    finally:
        versions._log = real
    assert versions.current(spark, root) == second and second.read(spark, "a").count() == 2 and first.read(spark, "a").count() == 1
    assert sorted(p.name for p in pathlib.Path(tmp_path / "layers" / "_log").iterdir() if p.suffix == ".json" and not p.name.startswith(".")) == ["000000000000.json", "000000000001.json"]
    with pytest.raises(KeyError):
        second.read(spark, "c")
    gone = versions.drop_old(spark, root)
    assert len(gone) == 2 and crashed.rpartition("/")[2] in gone and versions.current(spark, root).read(spark, "a").count() == 2
    assert versions.drop_old(spark, root) == [] and versions.upgrade({"a": three}, root, 1).number == 2


VIEW = "entity string, distance_m double, in_view boolean, full_m double, cue_m double, hide_m double, selected string, focused string, reduced_motion boolean, low_power boolean"


@pytest.mark.parametrize(
    ("view", "mode", "reason"),
    [
        ((60.0, True, 60.0, 120.0, 200.0, None, None, False, False), "full", "within-full"),
        ((60.5, True, 60.0, 120.0, 200.0, None, None, False, False), "cue", "within-cue"),
        ((150.0, True, 60.0, 120.0, 200.0, None, None, False, False), "hidden", "culled-fringe"),
        ((150.0, True, 60.0, 120.0, 200.0, "e", None, False, False), "cue", "interaction-retained-cue"),
        ((200.5, True, 60.0, 120.0, 200.0, "e", "e", False, False), "hidden", "beyond-hard-cap"),
        ((1.0, False, 60.0, 120.0, 200.0, "e", None, False, False), "hidden", "outside-view"),
        ((None, None, 60.0, 120.0, 200.0, None, None, False, False), "full", "distance-unavailable-preserve-full"),
        ((float("nan"), True, 60.0, 120.0, 200.0, None, None, True, True), "cue", "power-downgrade"),
        ((-4.0, True, 0.0, None, None, None, None, True, None), "cue", "reduced-motion-downgrade"),
        ((70.0, True, 80.0, 20.0, 10.0, None, None, False, False), "full", "within-full"),  # bands are made ascending
        ((90.0, True, 80.0, 20.0, 10.0, "e", None, False, False), "hidden", "beyond-hard-cap"),
        ((5.0, True, None, None, None, "", "", False, False), "hidden", "beyond-hard-cap"),
    ],
)
def test_policy(spark, view, mode, reason):
    row = policy.decide(spark.createDataFrame([("e", *view)], VIEW)).first()
    assert (row.mode, row.reason) == (mode, reason)


def test_only_what_looks_different_is_told(spark):
    far = [10.0, 20.0, 100.0, 100.0, 500.0, 900.0, None]
    df = spark.createDataFrame([(i, "e", x, True, 60.0, 120.0, 200.0, "e" if i == 3 else None, None, False, False) for i, x in enumerate(far)], f"frame int, {VIEW}")
    assert [(r.frame, r.signature, r.before) for r in policy.changes(df, ["entity"], ["frame"]).orderBy("frame").collect()] == [
        (0, "full:none:1.0000", None), (2, "cue:none:0.7200", "full:none:1.0000"), (3, "cue:selected:0.7776", "cue:none:0.7200"), (4, "hidden", "cue:selected:0.7776"), (6, "full:none:1.0000", "hidden"),
    ]


def _fixes(spark, monkeypatch, rows):
    """proximity.batch() of fixes whose places within reach are given: (user, event, usable, within, entered)."""
    start = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(u, e, start + datetime.timedelta(seconds=e), ok, near, into) for u, e, ok, near, into in rows], "user_id long, event_id long, ts timestamp, usable boolean, within array<long>, entered long")
    monkeypatch.setattr(proximity, "reachable", lambda fixes, places: fixes)
    return proximity.batch(df.repartition(5), None)


def _folded(rows):
    out, active = [], {}
    for u, e, ok, near, into in sorted(rows, key=lambda r: (r[0], r[1])):
        active[u], status, left = proximity.transition(active.get(u), ok, near or [], into)
        out.append((u, e, status, active[u], left))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [1, 2, 7, 512])
def test_pieces_of_runs_fold_like_the_whole(spark, monkeypatch, piece):
    rng = random.Random(piece)
    rows = []
    for user in range(12):
        for e in range(rng.randrange(1, 60)):
            ok = rng.random() < (0.3 if user < 4 else 0.9)
            near = sorted(rng.sample(range(4), rng.choice([0, 1, 2, 2, 3, 4]) if user % 2 else rng.choice([2, 3]))) if ok else None
            into = rng.choice([None, *near]) if near else None
            rows.append((user, e, ok, near, into))
    monkeypatch.setattr(proximity, "PIECE", piece)
    got = [tuple(r) for r in _fixes(spark, monkeypatch, rows).select("user_id", "event_id", "status", "place", "left_place").collect()]
    assert sorted(got, key=str) == _folded(rows)


def test_a_long_history_without_a_usable_fix(spark, monkeypatch):
    n = 60_000
    df = spark.range(n).selectExpr("1L user_id", "id event_id", "timestamp_seconds(id) ts", "id = 3 usable", "case when id = 3 then array(5L, 6L) end within", "case when id = 3 then 5L end entered")
    monkeypatch.setattr(proximity, "reachable", lambda fixes, places: fixes)
    told = proximity.batch(df, None).groupBy("status", "place").count().collect()
    assert {(r.status, r.place, r["count"]) for r in told} == {("uncertain", None, 3), ("entered", 5, 1), ("uncertain", 5, n - 4)}
