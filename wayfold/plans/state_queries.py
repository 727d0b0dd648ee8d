"""Bounded state, versions and presentation policy over the event stream and the layers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import policy
from wayfold.plans import bindings as B
from wayfold.plans.registry import query
from wayfold.sources import versions
from wayfold.sources.layers import table
from wayfold.sources.scratch import shared_dir
from wayfold.streaming import bounded, positions

_REQUEST = ["user_id owner", "event_id request_id", "ts", "concat(event_type, '-', cast(floor(value) as bigint) % 7) key", "event_id % 10 <> 0 ok"]
_HELD = 4


@query(f"""with recursive q as materialized (select *, row_number() over (partition by owner order by ts, request_id) pos from (select {", ".join(_REQUEST)} from events) where key is not null),
 r(owner, pos, request_id, entries, outcome, evicted) as (select distinct owner, 0::bigint, null::bigint, []::varchar[], null::varchar, null::varchar from q union all
  select q.owner, q.pos, q.request_id, case when list_contains(entries, key) or not ok then entries when len(entries) < {_HELD} then entries || [key] else entries[2:] || [key] end,
   case when list_contains(entries, key) then 'hit' when ok then 'stored' else 'failed' end, case when not list_contains(entries, key) and ok and len(entries) = {_HELD} then entries[1] end
  from r join q on q.owner = r.owner and q.pos = r.pos + 1)
 select owner, request_id, outcome, evicted, len(entries)::int held from r where pos > 0""")
def cache_outcomes(spark, d):
    """A first-in-first-out cache of four entries for each user, over all events."""
    return bounded.batch(table(spark, d, "events").selectExpr(*_REQUEST), _HELD)


_EARLY = "o_orderdate < '1995-01-01'"


@query(f"""with n as (select (select count(*) from orders where {_EARLY}) early, (select count(*) from orders) whole, (select count(*) from nation) nations)
 select 'before' step, 0 number, 'orders' layer, early n_rows from n union all select 'held reader', 0, 'orders', early from n union all select 'after', 1, 'orders', whole from n
 union all select 'after', 1, 'nation', nations from n union all select 'after a conflict', 1, 'orders', whole from n""")
def upgraded_layers(spark, d):
    """Layers upgraded as a whole. A reader keeps the version that it began with; a writer whose version isn't the active one any more changes nothing."""
    root = f"{shared_dir(spark)}/scratch/versions-{uuid.uuid4().hex}"
    orders, nation = table(spark, d, "orders"), table(spark, d, "nation")
    versions.upgrade({"orders": orders.filter(_EARLY)}, root, None)
    held = versions.current(spark, root)
    versions.upgrade({"orders": orders, "nation": nation}, root, held.number)
    after = versions.current(spark, root)
    try:
        versions.upgrade({"orders": orders.limit(1)}, root, held.number)
        raise AssertionError("a writer based on an old version must fail")
    except versions.Conflict:
        pass
    count = lambda step, v, layer: v.read(spark, layer).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(step).alias("step"), F.lit(v.number).alias("number"), F.lit(layer).alias("layer"), "n_rows")
    first = versions.current(spark, root, 0)
    rows = [count("before", first, "orders"), count("held reader", held, "orders"), count("after", after, "orders"), count("after", after, "nation"), count("after a conflict", versions.current(spark, root), "orders")]
    return reduce(DataFrame.union, rows)


_VIEW = [
    "user_id", "event_id", "ts", "concat('e', user_id % 50) entity", "case when event_id % 7 <> 0 then value * 2 - 10 end distance_m", "event_id % 9 <> 0 in_view", "60e0 full_m", "case when user_id % 3 = 0 then 20e0 else 120e0 end cue_m",
    "case when user_id % 4 <> 0 then 200e0 end hide_m", "case when event_id % 4 = 0 then concat('e', user_id % 50) else '' end selected", "case when event_id % 5 = 0 then concat('e', user_id % 50) end focused", "user_id % 17 = 0 reduced_motion", "user_id % 13 = 0 low_power",
]
_DECISION = f"""(select *, case when mode <> 'hidden' then concat(mode, ':', highlight, ':', format('{{:.4f}}', scale)) else 'hidden' end signature from (select *, case mode when 'cue' then 0.72e0 else 1e0 end * case highlight when 'selected' then 1.08e0 when 'focused' then 1.14e0 when 'selected-focused' then 1.2e0 else 1e0 end scale
 from (select *, case when reason in ('outside-view', 'beyond-hard-cap', 'culled-fringe') then 'hidden' when reason in ('within-cue', 'interaction-retained-cue', 'power-downgrade', 'reduced-motion-downgrade') then 'cue' else 'full' end mode
 from (select *, case when seen not in ('within-full', 'distance-unavailable-preserve-full') then seen when low_power then 'power-downgrade' when reduced_motion then 'reduced-motion-downgrade' else seen end reason
 from (select *, case when not in_view then 'outside-view' when far is null then 'distance-unavailable-preserve-full' when far <= 60 then 'within-full' when far <= cue then 'within-cue' when far > hide then 'beyond-hard-cap' when highlight <> 'none' then 'interaction-retained-cue' else 'culled-fringe' end seen
 from (select *, case when distance_m is not null then greatest(distance_m, 0) end far, case when user_id % 3 = 0 then 60 else 120 end cue, case when user_id % 4 <> 0 then 200 when user_id % 3 = 0 then 60 else 120 end hide, case when selected = entity and focused = entity then 'selected-focused' when focused = entity then 'focused' when selected = entity then 'selected' else 'none' end highlight
 from (select {", ".join(_VIEW)} from events)))))))"""


@query(f"select event_id, entity, mode, reason, highlight, round(scale, 4) scale from {_DECISION}")
def view_decisions(spark, d):
    """What of an entity is shown in every frame, by distance, view and attention."""
    return policy.decide(table(spark, d, "events").selectExpr(*_VIEW)).select("event_id", "entity", "mode", "reason", "highlight", F.round("scale", 4).alias("scale"))


@query(f"select * from (select user_id, event_id, signature, lag(signature) over (partition by user_id order by ts, event_id) \"before\" from {_DECISION}) where signature is distinct from \"before\"")
def view_changes(spark, d):
    """The frames of each user in which an entity begins to look different."""
    return policy.changes(table(spark, d, "events").selectExpr(*_VIEW), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "signature", "before")


_PUSHED = ["user_id", "event_id", "cast(ts as timestamp) ts", "event_id % 7 delay", "51.3e0 + value / 1e5 lat", "9.4e0 + value / 1e5 lng", "cast(event_id % 40 as double) accuracy"]


def _log(spark, d) -> str:
    rows = table(spark, d, "events").selectExpr(*_PUSHED)
    rows = rows.select("user_id", "event_id", F.unix_micros("ts").alias("ts"), (F.unix_micros("ts") + F.col("delay") * 1_000_000).alias("arrived"), "lat", "lng", "accuracy")
    folder = f"{shared_dir(spark)}/scratch/positions-{uuid.uuid4().hex}"
    rows.repartitionByRange(4, "arrived").write.json(folder)
    return folder


@query("select user_id, event_id, epoch_us(ts) ts_us, epoch_us(ts) + event_id % 7 * 1000000 arrived_us, 51.3e0 + value / 1e5 lat, cast(event_id % 40 as double) accuracy from events where event_id % 7 <= 4")
def pushed_fixes(spark, d):
    """Fixes from a log of segments, without those that were over four seconds old when they arrived."""
    return positions.read(spark, _log(spark, d)).select("user_id", "event_id", F.unix_micros("ts").alias("ts_us"), F.unix_micros("arrived").alias("arrived_us"), "lat", "accuracy")


@query("""with f as (select user_id, event_id, epoch_us(ts) + event_id % 7 * 1000000 arrived from events where event_id % 7 <= 4), n as (select *, lead(arrived) over (partition by user_id order by arrived, event_id) following from f)
 select user_id, event_id after_event, arrived + 12000000 at_us from n where following > arrived + 12000000""")
def device_silences(spark, d):
    """Where no fix came from a device for twelve seconds."""
    return positions.silences(positions.read(spark, _log(spark, d))).select("user_id", "after_event", F.unix_micros("at").alias("at_us"))


_SEEN = ["id", "case when id % 13 <> 0 then lat end lat", "lng", "case when id % 11 <> 0 then 51.3e0 end center_lat", "9.4e0 center_lng", "case when id % 7 = 0 then 170e0 when id % 5 <> 0 then 9.39e0 end west", "51.29e0 south", "case when id % 7 = 0 then 9.405e0 when id % 9 = 0 then 400e0 else 9.41e0 end east", "case when id % 17 = 0 then 51e0 else 51.31e0 end north"]


@query(f"""select id, case when lat is not null and center_lat is not null then round(6371008.8e0 * 2 * asin(least(1, sqrt(pow(sin(radians(lat - center_lat) / 2), 2) + cos(radians(center_lat)) * cos(radians(lat)) * pow(sin(radians(lng - center_lng) / 2), 2)))), 3) end distance_m,
 lat is null or west is null or south > north or lat between south and north and (east - west >= 360 or case when id % 7 = 0 then lng >= 170 or lng <= 9.405e0 else lng between west and case when east = 400 then 40 else east end end) in_view from (select {", ".join(_SEEN)} from {B.sql('customers')}) v""")
def host_views(spark, d):
    """Distance from the camera and whether an entity is in view, also across the antimeridian; what isn't known hides nothing."""
    return policy.host_views(B.customers(spark, d).selectExpr(*_SEEN)).select("id", F.round("distance_m", 3).alias("distance_m"), "in_view")


_DEVICE = ["c_custkey id", "case c_custkey % 3 when 0 then 'terrain' when 1 then 'auto' end preference", "c_custkey % 5 = 0 reduced_power", "case when c_custkey % 4 <> 0 then c_custkey % 7 <> 0 end webgl2", "c_custkey % 8 <> 1 terrain"]


@query(f"select id, case when preference = 'terrain' and not reduced_power and coalesce(webgl2, false) and terrain then 'terrain' else 'leaflet' end renderer, case when preference = 'terrain' then case when reduced_power then 'reduced-power' when webgl2 is null or not webgl2 then 'webgl2-unavailable' when not terrain then 'terrain-renderer-unavailable' end end fallback from (select {', '.join(_DEVICE)} from customer)")
def renderers(spark, d):
    """Which renderer a device gets, and why not the one that it asks for."""
    r = policy.renderer(*(F.col(c) for c in ("preference", "reduced_power", "webgl2", "terrain")))
    return table(spark, d, "customer").selectExpr(*_DEVICE).select("id", r.alias("r")).select("id", "r.*")
