"""Features, links, published layers, looked-up values, wiki tables and pushed positions by hand-made cases."""

import datetime
import json
import pathlib

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfold.functions import features
from wayfold.plans import catalog
from wayfold.sources import collections, files, lookups, publishing, wiki
from wayfold.streaming import positions


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_features_by_hand(spark):
    n = lambda x: F.lit(x).cast("double")
    props = F.struct(F.lit("a").alias("id"))
    assert json.loads(_one(spark, features.point_feature(props, n(9.4), n(51.3)))) == {"type": "Feature", "properties": {"id": "a"}, "geometry": {"type": "Point", "coordinates": [9.4, 51.3]}}
    for lng, lat in ((None, 51.3), (9.4, float("nan")), (float("inf"), 1.0)):
        assert _one(spark, features.point_feature(props, n(lng), n(lat))) is None
    line = F.array(*(F.struct(n(x).alias("lng"), n(y).alias("lat")) for x, y in ((1, 2), (None, 3), (4, 5))))
    assert json.loads(_one(spark, features.line_feature(props, line)))["geometry"] == {"type": "LineString", "coordinates": [[1, 2], [4, 5]]}
    assert _one(spark, features.line_feature(props, F.slice(line, 1, 2))) is None
    ring = _one(spark, features.accuracy_ring(n(51.3), n(9.4), n(500.0)))
    assert len(ring) == 33 and ring[0] == pytest.approx(ring[-1]) and ring[8][1] - 51.3 == pytest.approx(150 / 111_195.08, rel=1e-4)
    for fix in ((51.3, 9.4, 0.0), (51.3, 9.4, -1.0), (51.3, 9.4, None), (None, 9.4, 9.0)):
        assert _one(spark, features.accuracy_ring(*map(n, fix))) is None
    assert json.loads(_one(spark, features.polygon_feature(props, features.accuracy_ring(n(1), n(2), n(3)))))["geometry"]["type"] == "Polygon"


def test_profiles_by_hand(spark):
    array = lambda *x: F.array(*(F.lit(v).cast("double") for v in x))
    assert _one(spark, features.profile_points(array(0, 50, 100), array(10, 20, 15))) == "0.0,51.0 120.0,5.0 240.0,28.0"
    assert _one(spark, features.profile_points(array(5, 5), array(7, 7))) == "0.0,51.0 0.0,51.0"
    for d, e in ((array(1), array(1, 2)), (array(1, None), array(1, 2)), (array(1, 2), array(1, float("nan"))), (F.lit(None).cast("array<double>"), array(1))):
        assert _one(spark, features.profile_points(d, e)) == ""


@pytest.mark.parametrize("target", ["löwe", "a b/c?d&e=f#g", "100%", "+", "~'()*!-._", "日本", "%41", "a"])
def test_links_come_back(spark, target):
    link = _one(spark, features.deep_link(F.lit("tree"), F.lit(target)))
    assert link.startswith("#tree=") and all(c not in link[6:] for c in " &#?/")
    assert tuple(_one(spark, features.parsed_link(F.lit(link)))) == ("tree", target)


def test_what_is_no_link(spark):
    for link in ("", "#road=a", "#tree=", "tree=a", "#tree=%E", "#tree=%zz", None):
        assert _one(spark, features.parsed_link(F.lit(link).cast("string"))) is None
    assert tuple(_one(spark, features.parsed_link(F.lit("#place=a%20b&more=1")))) == ("place", "a b")
    assert _one(spark, features.deep_link(F.lit("road"), F.lit("a"))) is None and _one(spark, features.deep_link(F.lit("tree"), F.lit(""))) is None


def test_narrations(spark):
    said = lambda title, **s: _one(spark, features.narration(F.lit(title), {k: F.lit(v) for k, v in s.items()}))
    assert said("T", history=" H ", description="D") == "T. D. H" and said("T") is None and said("T", history="  ") is None and said("", history="H") == "H"


def test_collections_are_bounded(spark, tmp_path):
    rows = spark.range(997).select("id", F.when(F.col("id") < 900, 1).otherwise(F.col("id") % 3).alias("x"), features.point_feature(F.struct(F.col("id").cast("string").alias("id")), F.col("id"), F.lit(1)).alias("feature"))
    collections.write_collections(rows.union(spark.createDataFrame([(-1, 7, None)], rows.schema)), str(tmp_path / "c"), ["x"], "id", 50)
    back = collections.read_collections(spark, str(tmp_path / "c"))
    assert back.select(F.col("properties")["id"].cast("int")).distinct().count() == 997 == back.count()
    assert back.agg(F.max("n_features")).first()[0] <= 50 and back.groupBy("path").count().join(back.select("path", "n_features").distinct(), "path").filter("count <> n_features").count() == 0
    for path in pathlib.Path(tmp_path / "c").rglob("*.geojson"):
        assert json.loads(path.read_text())["type"] == "FeatureCollection"
    files.write_files(spark.createDataFrame([("a.geojson", bytearray(b'{"type":"Feature"}'))], "path string, content binary"), str(tmp_path / "d"))
    with pytest.raises(Exception, match="no feature collection: a.geojson"):
        collections.read_collections(spark, str(tmp_path / "d")).collect()


LAYERS = [publishing.Layer("a", "id", ("id", "v")), publishing.Layer("b", "id", ("id",), required=False, phase="hydrate")]


def test_publishing(spark, tmp_path):
    a, b = spark.range(25).selectExpr("id", "case when id % 2 = 0 then concat('x', id) end v", "9 extra"), spark.range(3).toDF("id")
    one = publishing.publish(spark, {LAYERS[0]: a.repartition(5), LAYERS[1]: b}, str(tmp_path / "one"), 10)
    two = publishing.publish(spark, {LAYERS[0]: a.orderBy(F.desc("id")), LAYERS[1]: b}, str(tmp_path / "two"), 10)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()} and one.count() == 4
    assert publishing.stale(publishing.input_set(one), publishing.input_set(two)).collect() == []
    assert json.loads((tmp_path / "one/a/2.json").read_text()) == {"layer": "a", "schema_version": 1, "rows": [{"id": i, "v": f"x{i}" if i % 2 == 0 else None} for i in range(20, 25)]}
    schema = {"a": "id: bigint, v: string", "b": "id: bigint"}
    loaded = publishing.load(spark, str(tmp_path / "one"), LAYERS, "initial", schema)
    assert list(loaded) == ["a"] and {tuple(r) for r in loaded["a"].collect()} == {(r.id, r.v) for r in a.collect()}
    newer = [publishing.Layer("a", "id", ("id", "v"), schema_version=2)]
    with pytest.raises(Exception, match="not a document of its layer and version: a/0.json|not a document of its layer and version: a/"):
        publishing.load(spark, str(tmp_path / "one"), newer, "initial", schema)["a"].collect()
    fails = lambda layers=LAYERS, most=10_000, forbidden=(): {r.rule: r.failures for r in publishing.gate(one, files.contents(spark, str(tmp_path / "one")), layers, most_bytes=most, forbidden=forbidden).collect() if not r.ok}
    assert fails() == {} and fails(most=10) == {"budget": 1} and fails(forbidden=("b/*",)) == {"forbidden": 1}
    assert fails([*LAYERS, publishing.Layer("c", "id", ("id",))]) == {"required_layers": 1} and fails(LAYERS[:1]) == {"outside_contract": 1}
    with pytest.raises(ValueError, match="required layer could not be published: a"):
        publishing.publish(spark, {LAYERS[0]: None}, str(tmp_path / "three"))
    none = publishing.publish(spark, {LAYERS[1]: None}, str(tmp_path / "four"))
    assert none.count() == 0 and {(r.layer, r.available, r.bytes) for r in publishing.layer_sums(none, LAYERS).collect()} == {("a", False, 0), ("b", False, 0)}


def _service(folder, fail=(), short=(), times=10**9):
    """A service that writes down what it is asked, fails for some places, and is silent about others."""

    def service(places):
        log = pathlib.Path(str(folder)) / f"{round(places[0][0] * 1e7)}.log"
        with log.open("a") as f:
            f.write("asked\n")
        if any(round(lat) in fail for lat, _ in places) and len(log.read_text().splitlines()) <= times:
            raise OSError("no answer")
        return [lat + lng for lat, lng in places[: len(places) - 1 if any(round(lat) in short for lat, _ in places) else None]]

    return service


def test_lookups_resume(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    places = spark.createDataFrame([(f"p{i}", float(i), 0.5) for i in range(20)] + [("again", 3.0, 0.5)], "id string, lat double, lng double")
    asks = lambda: {p.name: len(p.read_text().splitlines()) for p in log.iterdir()}
    run = lambda service, **o: lookups.lookup(places, service, str(tmp_path / "j"), batch=5, delay=0.0, **o)
    with pytest.raises(Exception, match="a batch failed after 2 attempts: no answer"):
        run(_service(log, fail=[12]), retries=2).collect()
    before = asks()
    done = {p.name for p in (tmp_path / "j").glob("batch-*.json")}
    assert sum(n > 1 for n in before.values()) == 1 and len(done) < 4
    got = {r.id: (r.value, r.source) for r in run(_service(log)).collect()}
    assert got == {f"p{i}": (i + 0.5, "fetched") for i in range(20)} | {"again": (3.5, "fetched")}
    more = {k: n - before.get(k, 0) for k, n in asks().items()}
    assert sum(more.values()) == 4 - len(done) and len(list((tmp_path / "j").glob("batch-*.json"))) == 4
    assert run(_service(log, fail=range(20))).count() == 21  # all from the journal
    with pytest.raises(ValueError, match="another selection"):
        lookups.lookup(places.filter("id <> 'p1'"), _service(log), str(tmp_path / "j"), batch=5)
    assert lookups.lookup(places.filter("id <> 'p1'"), _service(log), str(tmp_path / "j"), batch=5, force=True).filter("value = lat + 0.5").count() == 20


def test_lookups_reuse_and_refuse(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    places = spark.createDataFrame([(i, float(i), 0.5) for i in range(6)], "id int, lat double, lng double")
    old = {"one": places.filter("id < 2").selectExpr("lat", "lng", "7e0 value"), "two": places.filter("id between 1 and 3").selectExpr("lat", "lng", "7e0 value")}
    rows = lookups.lookup(places, _service(log, fail=[5], times=2), str(tmp_path / "a"), known=old, delay=0.0).collect()
    assert {(r.id, r.value, r.source, r.origin if r.source == "reused" else "") for r in rows} == {(0, 7.0, "reused", "one"), (1, 7.0, "reused", "one"), (2, 7.0, "reused", "two"), (3, 7.0, "reused", "two"), (4, 4.5, "fetched", ""), (5, 5.5, "fetched", "")}
    with pytest.raises(Exception, match="earlier layers disagree"):
        lookups.lookup(places, _service(log), str(tmp_path / "b"), known=old | {"three": places.selectExpr("lat", "lng", "8e0 value")}).collect()
    with pytest.raises(Exception, match="values for 6 places"):
        lookups.lookup(places, _service(log, short=[5]), str(tmp_path / "c"), retries=1).collect()
    with pytest.raises(Exception, match="no coordinates: 9"):
        lookups.lookup(places.union(spark.createDataFrame([(9, None, 1.0)], places.schema)), _service(log), str(tmp_path / "d")).collect()
    assert lookups.lookup(places.limit(0), _service(log), str(tmp_path / "e")).collect() == []


WIKI = """Intro
{| class="wikitable"
|+ Trees
! No !! Kind !! colspan="2" | Size
|-
| 1 || rowspan="2" | [[Oak|an ''oak'']] || 3 || {{unit|m}}
|- style="x"
| 2
| 4
| [https://a.b/c a link]<ref>gone</ref>
more of it
|-
|}
{|
stray
| a | b || c
{| nested
| x
|}
| colspan="3000" | d
"""


def test_wiki_tables_by_hand(spark):
    pages = spark.createDataFrame([("p", WIKI), ("q", None), ("r", "no table"), ("s", "")], "page string, text string")
    rows = {(r.table, r.row, r.col): (r.header, r.text, r.target, r.spanned) for r in wiki.cells(pages).collect()}
    assert rows == {
        (0, 0, 0): (True, "No", None, False), (0, 0, 1): (True, "Kind", None, False), (0, 0, 2): (True, "Size", None, False), (0, 0, 3): (True, "Size", None, True),
        (0, 1, 0): (False, "1", None, False), (0, 1, 1): (False, "an oak", "Oak", False), (0, 1, 2): (False, "3", None, False), (0, 1, 3): (False, "m", None, False),
        (0, 2, 0): (False, "2", None, False), (0, 2, 1): (False, "an oak", "Oak", True), (0, 2, 2): (False, "4", None, False), (0, 2, 3): (False, "a link more of it", "https://a.b/c", False),
        (1, 0, 0): (False, "a | b", None, False), (1, 0, 1): (False, "c", None, False), (1, 0, 2): (False, "d", None, False),
    }
    assert {(r.table, r.fault) for r in wiki.faults(pages).collect()} == {(1, "text outside cells"), (1, "nested table"), (1, "span out of range"), (1, "table without end")}
    for text, fault in (("{|\n| rowspan=3 | a\n|}", "span beyond the table's end"), ("{|\n| a || rowspan=2 | b\n|-\n| colspan=2 | c\n|}", "cells overlap")):
        assert [r.fault for r in wiki.faults(spark.createDataFrame([("p", text)], "page string, text string")).collect()] == [fault]
    assert wiki.cells(pages.limit(0)).collect() == []


def _segment(folder, number, rows):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"user_id": 1, "event_id": e, "ts": t * 1_000_000, "arrived": a * 1_000_000, "lat": 51.0, "lng": 9.0, "accuracy": 5.0, "more": "x"}) for e, t, a in rows]
    (folder / f"{number:04d}.jsonl").write_text("\n".join(lines))


def test_positions_stream_like_their_batch_across_restarts(spark, tmp_path):
    log, check, out = tmp_path / "log", tmp_path / "check", tmp_path / "out"
    fixes = [(i, i * 10, i * 10 + i % 6) for i in range(60)]  # a third arrive too old
    assert positions.read(spark, str(tmp_path / "nothing")).collect() == []
    at = 0
    for segments in (2, 3, 0, 7):
        for _ in range(segments):
            _segment(log, at, fixes[at * 5 : at * 5 + 5])
            at += 1
        for _ in range(4):
            q = positions.read_stream(spark, str(log), segments_per_batch=2, progress=str(tmp_path / "progress")).writeStream.format("parquet").option("checkpointLocation", str(check)).option("path", str(out)).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
            assert max([0, *(p["sources"][0]["numInputRows"] for p in q.recentProgress)]) <= 10
    _segment(log, 99, [])
    want = [(e, a) for e, t, a in fixes if a - t <= 4]
    assert sorted(r.event_id for r in spark.read.parquet(str(out)).collect()) == [e for e, _ in want]
    batch = positions.read(spark, f"file://{log}")
    assert sorted((r.event_id, r.arrived.replace(tzinfo=datetime.UTC).timestamp()) for r in batch.collect()) == want
    assert positions.read(spark, str(log), max_age_ms=0).count() == 10
    told = positions.silences(batch, 12_000).collect()
    gaps = [(e, a + 12) for (e, a), (_, b) in zip(want, want[1:], strict=False) if b - a > 12]
    assert sorted((r.after_event, r.at.replace(tzinfo=datetime.UTC).timestamp()) for r in told) == gaps and gaps
    with pytest.raises(Exception, match="needs a folder for progress"):
        positions.read_stream(spark, str(log), segments_per_batch=2).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination(60)


@pytest.mark.parametrize(("error", "attempts"), [(lookups.StatusError(503), 3), (lookups.StatusError(404), 1), (TimeoutError(), 3), (ConnectionResetError(), 3), (KeyError(), 1)])
def test_only_passing_failures_are_tried_again(error, attempts):
    tried = []

    def service(places):
        tried.append(places)
        raise error

    with pytest.raises(RuntimeError, match=f"after {attempts} attempts"):
        lookups.asked(service, [(1.0, 2.0)], 3, 0.0, lookups.passing)
    assert len(tried) == attempts


def test_profile_lines_round_as_sql(spark, tmp_path):
    """Every height between every lowest and highest that parts can have."""
    sizes = [(1, 1 + k, 1 + m) for m in range(50) for k in range(m + 1)]
    parts = [(50 * row + col, size) for row, three in enumerate(sizes) for col, size in enumerate(three)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = {r.row: r.points for r in catalog.queries()["profile_lines"](spark, str(tmp_path)).collect()}
    with duckdb.connect() as con:
        con.sql(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
        want = dict(con.sql(catalog.oracle_sql()["profile_lines"]).fetchall())
    assert len(got) == 1275 and got == want
