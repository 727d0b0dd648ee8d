"""The proximity state machine with hysteresis over position fixes, and windows over events.

What a fix needs to know of the places, those within reach, is a column before any state comes in. The state itself is one place a user.
In batch, a user's fixes are cut wherever a fix settles the state whatever it was before; only between such cuts is anything folded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayfold.operators import spatial

#: Metres to enter and to leave, and the largest usable accuracy.
ENTER_M, EXIT_M, MAX_ACCURACY_M = 30.0, 45.0, 50.0
#: Fixes that are folded in one row.
PIECE = 512
SCHEMA = "user_id long, event_id long, status string, place long, left_place long"


def exit_radius(enter_m: Column) -> Column:
    """The distance at which a place of a given radius is left: 15 metres or half the radius beyond it, whichever is more."""
    return F.greatest(enter_m + 15, enter_m * 1.5)


def usable(accuracy: Column) -> Column:
    """Whether a fix says where it was: an accuracy that is known, finite, not negative and not too large."""
    return F.coalesce(~F.isnan(accuracy) & accuracy.between(0.0, MAX_ACCURACY_M), F.lit(False))


def reachable(fixes: DataFrame, places: DataFrame) -> DataFrame:
    """``fixes`` with usable, within (places that the fix can't rule out having stayed at) and entered (the nearest place, if the fix is certainly inside)."""
    at = spatial.with_near(fixes, places, EXIT_M + MAX_ACCURACY_M, out="_near").withColumn("usable", usable(F.col("accuracy")))
    within = F.transform(F.filter("_near", lambda p: p["distance_m"] - F.col("accuracy") <= EXIT_M), lambda p: p["place"])
    first = F.get("_near", F.lit(0))
    entered = F.when(first["distance_m"] + F.col("accuracy") <= ENTER_M, first["place"])
    return at.withColumn("within", F.when(F.col("usable"), within)).withColumn("entered", F.when(F.col("usable"), entered)).drop("_near")


def transition(active: int | None, is_usable: bool, within: list[int], entered: int | None) -> tuple[int | None, str, int | None]:
    """(active place, status, place left) after a fix.

    A fix without usable accuracy is uncertain and changes nothing. An active place is retained while the fix may be within EXIT_M of
    it; else it is left. Then the nearest place is entered if the fix is certainly within ENTER_M.
    """
    if not is_usable:
        return active, "uncertain", None
    if active is not None and active in within:
        return active, "retained", None
    return entered, "outside" if entered is None else "entered", active


def batch(fixes: DataFrame, places: DataFrame) -> DataFrame:
    """Statuses of all fixes (user_id, event_id, ts, lat, lng, accuracy), each user's in order of time, ties by event_id.

    A usable fix near no place, or certainly inside the only one that it may have stayed at, settles the state after it. So the fixes up to and with
    such a one are folded together, beginning with what the settled fix before them left, in pieces of PIECE fixes: never a user's history,
    even if none of its fixes settles anything.
    """
    at = reachable(fixes, places)
    single = (F.size("within") == 1) & F.col("entered").isNotNull()
    at = at.select("user_id", "event_id", "ts", "usable", "within", "entered", (F.col("usable") & ((F.size("within") == 0) | single)).alias("settled"))
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    run = F.coalesce(F.sum(F.col("settled").cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = F.when(F.lag("settled").over(by), F.lag("entered").over(by))
    at = at.withColumn("run", run).withColumn("before", before)
    # whatever a run's length, its fixes are folded in pieces of a fixed number
    at = at.withColumn("piece", F.floor((F.row_number().over(W.partitionBy("user_id", "run").orderBy("ts", "event_id")) - 1) / PIECE))
    fix = F.struct("ts", "event_id", "usable", "within", "entered", "before")
    pieces = at.groupBy("user_id", "run", "piece").agg(F.array_sort(F.collect_list(fix)).alias("fixes"))
    starts = _starts(pieces)

    state = "struct<active:bigint,out:array<struct<event_id:bigint,status:string,place:bigint,left_place:bigint>>>"
    start = F.struct(F.col("start").alias("active"), F.array().alias("out")).cast(state)

    def step(acc: Column, f: Column) -> Column:
        active, retained = acc["active"], _retained(acc["active"], f)
        status = F.when(~f["usable"], "uncertain").when(retained, "retained").when(f["entered"].isNotNull(), "entered").otherwise("outside")
        after = _after(active, f)
        left = F.when(f["usable"] & ~retained, active)
        row = F.struct(f["event_id"].alias("event_id"), status.alias("status"), after.alias("place"), left.alias("left_place"))
        return F.struct(after.alias("active"), F.concat(acc["out"], F.array(row)).alias("out")).cast(state)

    told = pieces.join(starts, ["user_id", "run", "piece"])
    return told.select("user_id", F.explode(F.aggregate("fixes", start, step, lambda acc: acc["out"])).alias("x")).select("user_id", "x.*")


def _retained(active: Column, f: Column) -> Column:
    return F.coalesce(F.array_contains(f["within"], active), F.lit(False))


def _after(active: Column, f: Column) -> Column:
    """The active place after a fix: a fix keeps a place that is still near, and forgets any other for the one it enters."""
    return F.when(~f["usable"] | _retained(active, f), active).otherwise(f["entered"])


def _starts(pieces: DataFrame) -> DataFrame:
    """(user_id, run, piece, start): the active place that each piece of a run begins with.

    A piece is a map from place to place: its first usable fix keeps only the places near it, so what the piece makes of each of these and of
    any other is all there is to know. A run's maps, a few numbers for every PIECE fixes, are applied one after another.
    """
    first = F.get(F.filter("fixes", lambda f: f["usable"]), F.lit(0))["within"]
    end = lambda place: F.aggregate("fixes", place, _after)
    near = F.coalesce(first, F.array().cast("array<bigint>"))
    maps = pieces.select("user_id", "run", "piece", F.get("fixes", F.lit(0))["before"].alias("before"), near.alias("near"), F.exists("fixes", lambda f: f["usable"]).alias("moves"), "fixes")
    maps = maps.withColumn("ends", F.transform("near", end)).withColumn("other", end(F.lit(None).cast("bigint")))
    chain = maps.groupBy("user_id", "run").agg(F.array_sort(F.collect_list(F.struct("piece", "before", "near", "moves", "ends", "other"))).alias("chain"))
    state = "struct<active:bigint,out:array<struct<piece:bigint,start:bigint>>>"
    begin = F.struct(F.get("chain", F.lit(0))["before"].alias("active"), F.array().alias("out")).cast(state)

    def step(acc: Column, m: Column) -> Column:
        active = acc["active"]
        at = F.array_position(m["near"], active)
        after = F.when(~m["moves"], active).when(F.coalesce(at, F.lit(0)) > 0, F.get(m["ends"], (at - 1).cast("int"))).otherwise(m["other"])
        return F.struct(after.alias("active"), F.concat(acc["out"], F.array(F.struct(m["piece"].alias("piece"), active.alias("start")))).alias("out")).cast(state)

    return chain.select("user_id", "run", F.explode(F.aggregate("chain", begin, step, lambda acc: acc["out"])).alias("x")).select("user_id", "run", "x.piece", "x.start")


def arrivals(statuses: DataFrame) -> DataFrame:
    """(user_id, event_id, seq, event, place): what batch() or stream() rows announce; where a fix leaves one place and enters another, the exit comes first."""
    left = F.when(F.col("left_place").isNotNull(), F.struct(F.lit("exit").alias("event"), F.col("left_place").alias("place")))
    came = F.when(F.col("status") == "entered", F.struct(F.lit("enter").alias("event"), F.col("place").alias("place")))
    return statuses.select("user_id", "event_id", F.posexplode(F.array_compact(F.array(left, came))).alias("seq", "x")).select("user_id", "event_id", "seq", "x.event", "x.place")


def stream(fixes: DataFrame, places: DataFrame) -> DataFrame:
    """batch() on a stream of fixes against a static table of places: a user's active place is the only state. Fixes of a micro-batch are taken in order of time."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, rows = state.get[0] if state.exists else None, []
        for f in pd.concat(list(parts), ignore_index=True).sort_values(["ts", "event_id"]).itertuples():
            within = [] if f.within is None else [int(x) for x in f.within]
            active, status, left = transition(active, f.usable, within, None if pd.isna(f.entered) else int(f.entered))
            rows.append((f.user_id, f.event_id, status, active, left))
        state.update((active,))
        out = pd.DataFrame(rows, columns=["user_id", "event_id", "status", "place", "left_place"])
        yield out.astype({"place": "Int64", "left_place": "Int64"})

    return reachable(fixes, places).groupBy("user_id").applyInPandasWithState(step, SCHEMA, "active long", "append", GroupStateTimeout.NoTimeout)


def route_progress(fixes: DataFrame, line: list[tuple[float, float]]) -> DataFrame:
    """(user_id, event_id, state, progress_m, remaining_m, off_m, end_m): how far each user has come along a fixed line of (lat, lng).

    The same fixes and distances as for places. A fix certainly near the line puts a user on it, one certainly far from it off it; any other leaves
    it at that, so the last fix that was certain says which it is: a window, no fold. On the line the state is on-route or retained, off
    it outside or uncertain. An unusable fix is uncertain and changes nothing. progress_m is the last one reached.
    """
    lat, lng = F.col("lat"), F.col("lng")
    at = fixes.withColumn("_ok", usable(F.col("accuracy")) & lat.isNotNull() & lng.isNotNull()).withColumn("_at", spatial.along_line(lat, lng, line))
    at = at.withColumn("_in", F.col("_at.off_m") + F.col("accuracy") <= ENTER_M).withColumn("_out", F.col("_at.off_m") - F.col("accuracy") > EXIT_M)
    by = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    known = F.when(F.col("_ok") & F.col("_in"), True).when(F.col("_ok") & F.col("_out"), False)
    at = at.withColumn("_active", F.coalesce(F.last(known, ignorenulls=True).over(by), F.lit(False)))
    moving = F.col("_ok") & F.col("_active")
    progress = F.last(F.when(moving, F.col("_at.along_m")), ignorenulls=True).over(by)
    state = F.when(~F.col("_ok"), "uncertain").when(F.col("_active"), F.when(F.col("_in"), "on-route").otherwise("retained")).otherwise(F.when(F.col("_out"), "outside").otherwise("uncertain"))
    end = F.round(spatial.geo.haversine(lat, lng, F.lit(line[-1][0]), F.lit(line[-1][1])), 3)
    remaining = F.round(F.greatest(F.col("_at.length_m") - F.col("_at.along_m"), F.lit(0.0)), 3)
    return at.select("user_id", "event_id", state.alias("state"), F.round(progress, 3).alias("progress_m"), F.when(moving, remaining).alias("remaining_m"), F.when(F.col("_ok"), F.round("_at.off_m", 3)).alias("off_m"), F.when(moving, end).alias("end_m"))


def tumbling(events: DataFrame, width: str, *, late: str | None = None) -> DataFrame:
    """Counts and sums by event type and tumbling window; with ``late``, a watermark for streams (an extension)."""
    events = events.withWatermark("ts", late) if late else events
    out = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(events: DataFrame, gap: str, *, late: str | None = None) -> DataFrame:
    """Counts by user and session (an extension)."""
    events = events.withWatermark("ts", late) if late else events
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), "n")
