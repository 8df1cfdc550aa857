"""The registered queries of the hit-stream operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave import fixtures, sinks, sources, streaming
from hitweave import functions as H
from hitweave.functions.onnx import linear_model
from hitweave.model import JOIN_TICKS, REORDER_TICKS, SLICE_NS, SLICE_TICKS, WINDOW_TICKS, Settings
from hitweave.operators import analysis, clustering, preprocess, rates, slices, triggers, windows
from hitweave.operators.ordered import numbered, shared_file
from hitweave.plans.graph import Context, Graph, build, recipe

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

ORDER = ["tick", "lin", "part", "supp", "tot"]
#: Window width on the dense tracks' and the sparse stream's time scale.
W2 = WINDOW_TICKS


def query(sql: str | None = None, ctes: str = ""):
    """Registers a query under its function's name; ``sql`` may use f1, f2, e1, e2 and what ``ctes`` adds."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = f"with recursive {fixtures.CTES}{', ' + ctes if ctes else ''} {sql}"
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.calibrate(fixtures.track_hits(spark, sf_dir), fixtures.calibration(spark))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.calibrate(fixtures.stream_hits(spark, sf_dir), fixtures.calibration(spark))


def r4(c):
    return F.round(c, 4)


def r6(c):
    """For means over a few dozen hits, whose exact fractions can end in a 5 at the fifth place."""
    return F.round(c, 6)


# --- preprocessing -----------------------------------------------------------------------------


@query("select lin as linear_coord, toa, fast_toa, tick, lin % 256 as x, lin // 256 as y, tick * cast(1.5625 as double) as toa_ns from f1")
def hit_ns_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.track_hits(spark, sf_dir).select(F.col("lin").alias("linear_coord"), "toa", "fast_toa", "tot")
    return preprocess.decode(preprocess.valid(raw)).select("linear_coord", "toa", "fast_toa", "tick", "x", "y", "toa_ns")


@query(
    """select lin as linear_coord, cast(ceil(ns / 25) as bigint) as toa, cast(round((ceil(ns / 25) * 25 - ns) / 1.5625) as int) as fast_toa, 1 as tot
    from (select lin, tick * cast(1.5625 as double) as ns from f1)"""
)
def hit_inverse_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fixtures.track_hits(spark, sf_dir).select("x", "y", (F.col("tick") * F.lit(1.5625)).alias("toa_ns"))
    return preprocess.to_raw(hits)


@query("select lin % 256 as x, lin // 256 as y, count(*) as hits, cast(sum(tot) as bigint) as tot from f1 group by all")
def pixel_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.track_hits(spark, sf_dir).select(F.col("lin").alias("linear_coord"), "toa", "fast_toa", "tot")
    return preprocess.decode(raw).groupBy("x", "y").agg(F.count("*").alias("hits"), F.sum("tot").alias("tot"))


@query("select lin, tick, tot, round(e, 4) as e from e1")
def energy_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select("lin", "tick", "tot", r4("e").alias("e"))


_BAD = {"a": "case when (x + y) % 7 = 0 then cast(0 as double) else {v} end", "c": "case when x % 5 = 0 then cast(-100000 as double) else {v} end"}


def _bad_energy() -> str:
    c = {k: f"({_BAD.get(k, '{v}').format(v=v)})" for k, v in fixtures.CALIB.items()}
    p = f"(-{c['a']} * {c['t']} + {c['b']} - tot)"
    root = f"({p} * {p} - 4 * {c['a']} * (tot * {c['t']} - {c['b']} * {c['t']} - {c['c']}))"
    return f"case when {c['a']} = 0 or {root} < 0 then cast(0.1 as double) else greatest((-{p} + sqrt(greatest({root}, 0))) / (2 * {c['a']}), cast(0.1 as double)) end"


@query(f"select lin, tick, tot, round(e, 4) as e from (select *, {_bad_energy()} as e from f1)")
def energy_invalid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    calib = fixtures.calibration(spark)
    calib = calib.withColumn("a", F.when((F.col("x") + F.col("y")) % 7 == 0, 0.0).otherwise(F.col("a")))
    calib = calib.withColumn("c", F.when(F.col("x") % 5 == 0, -100000.0).otherwise(F.col("c")))
    return preprocess.calibrate(fixtures.track_hits(spark, sf_dir), calib).select("lin", "tick", "tot", r4("e").alias("e"))


@query("select lin, tick, round(cast(tot as double), 4) as e from f1")
def uncalibrated_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.uncalibrated(fixtures.track_hits(spark, sf_dir)).select("lin", "tick", "e")


@query(
    """select tick, lin, tot, area from (select *, row_number() over (partition by run order by tick, lin, part, supp, tot) as n from (
      select *, sum(new) over (order by tick, lin, part, supp, tot rows unbounded preceding) as run from (
        select *, case when lag(area) over (order by tick, lin, part, supp, tot) = area then 0 else 1 end as new
        from (select *, cast((x // 128) * 2 + y // 128 as int) as area from f1)))) where n <= 3"""
)
def faulty_pixel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than three hits in a row from one quadrant; production uses ten hits and pixels."""
    area = (F.floor(F.col("x") / 128) * 2 + F.floor(F.col("y") / 128)).cast("int")
    hits = fixtures.track_hits(spark, sf_dir).withColumn("area", area)
    return preprocess.drop_faulty(hits, ORDER, repeats=3, pixel="area").select("tick", "lin", "tot", "area")


@query("select tick, lin, tot, row_number() over (order by tick, lin, part, supp, tot) as row_no from f1")
def time_sorted_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.time_sorted(fixtures.track_hits(spark, sf_dir), ORDER).select("tick", "lin", "tot", "row_no")


@query("select count(*) as hits, cast(sum(toa) as bigint) as toa_sum, cast(sum(fast_toa) as bigint) as fast_sum from f2 where toa >= 0")
def valid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.valid(fixtures.stream_hits(spark, sf_dir)).agg(F.count("*").alias("hits"), F.sum("toa").alias("toa_sum"), F.sum("fast_toa").alias("fast_sum"))


@query(
    """select cast(r as int) as repetition, lin, toa + r * (hi - lo) as toa, fast_toa from f1, (select min(toa) as lo, max(toa) as hi from f1), (select unnest(range(3)) as r)"""
)
def replay_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fixtures.track_hits(spark, sf_dir).select("lin", "toa", "fast_toa")
    first, last = raw.agg(F.min("toa"), F.max("toa")).first()
    return preprocess.replay(raw, 3, first, last).select("repetition", "lin", "toa", "fast_toa")


# --- clustering --------------------------------------------------------------------------------

TEMPORAL = """s1 as (select *, case when tick - lag(tick) over (order by tick, lin) < 128 then 0 else 1 end as brk from e1),
t1 as (select *, sum(brk) over (order by tick, lin rows unbounded preceding) as sid from s1),
tc as (select *, min(tick * 65536 + y * 256 + x) over (partition by sid) as cluster_id from t1)"""


def _spatial(tile: int) -> str:
    x, y = (f"{c} // {tile}" if tile > 1 else c for c in "xy")
    return f"""{TEMPORAL}, n as (select distinct sid, {x} as u, {y} as v from t1),
r as (select sid, u, v, u as pu, v as pv from n union
      select r.sid, r.u, r.v, n.u, n.v from r join n on n.sid = r.sid and abs(n.u - r.pu) <= 1 and abs(n.v - r.pv) <= 1),
lab as (select sid, u, v, min(pu * 256 + pv) as comp from r group by all),
pl as (select t1.*, min(tick * 65536 + y * 256 + x) over (partition by t1.sid, comp) as cluster_id
       from t1 join lab on lab.sid = t1.sid and lab.u = {x} and lab.v = {y})"""


STATS = """select cluster_id, count(*) as hit_count, cast(greatest(max(x) - min(x) + 1, max(y) - min(y) + 1) as bigint) as diameter,
 (max(tick) - min(tick)) * cast(1.5625 as double) as timespan, round(sum(e), 4) as total_energy, round(avg(x), 4) as center_x, round(avg(y), 4) as center_y from {t} group by cluster_id"""


def stats(clustered: DataFrame) -> DataFrame:
    out = analysis.properties(clustered)
    return out.withColumns({c: r4(c) for c in ("total_energy", "center_x", "center_y")})


@query("select tick, lin, cluster_id from tc", TEMPORAL)
def temporal_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.temporal(tracks(spark, sf_dir)).select("tick", "lin", "cluster_id")


@query(STATS.format(t="tc"), TEMPORAL)
def temporal_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(clustering.temporal(tracks(spark, sf_dir)))


@query(STATS.format(t="pl"), _spatial(1))
def pixel_list_clusters_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(clustering.pixel_list(tracks(spark, sf_dir)))


@query(STATS.format(t="pl"), _spatial(4))
def tiled_clusters_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(clustering.pixel_list(tracks(spark, sf_dir), tile=4))


TWO_STEP = """g0 as (select *, case when tick - lag(tick) over (order by tick, lin) < 20 then 0 else 1 end as brk from e1),
g1 as (select *, sum(brk) over (order by tick, lin rows unbounded preceding) as sid from g0),
g2 as (select *, (least(max(x) over w + 1, 255) - greatest(min(x) over w - 1, 0)) * (least(max(y) over w + 1, 255) - greatest(min(y) over w - 1, 0)) as area
       from g1 window w as (partition by sid)),
h as (select distinct sid, tick, x, y from g2 where area > 25),
hr as (select sid, tick, x, y, tick as pt, x as px, y as py from h union
       select hr.sid, hr.tick, hr.x, hr.y, h.tick, h.x, h.y from hr join h on h.sid = hr.sid and abs(h.x - hr.px) <= 1 and abs(h.y - hr.py) <= 1 and abs(h.tick - hr.pt) < 20),
hl as (select sid, tick, x, y, min(pt * 65536 + py * 256 + px) as cluster_id from hr group by all),
ts as (select g2.*, coalesce(hl.cluster_id, min(g2.tick * 65536 + g2.y * 256 + g2.x) over (partition by g2.sid)) as cluster_id
       from g2 left join hl on hl.sid = g2.sid and hl.tick = g2.tick and hl.x = g2.x and hl.y = g2.y)"""


@query(STATS.format(t="ts"), TWO_STEP)
def two_step_clusters_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(clustering.two_step(tracks(spark, sf_dir)))


@query()
def halo_bb_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the energy, so that the tracks have hot hits."""
    hits = tracks(spark, sf_dir).withColumn("e", F.col("e") * 2)
    return stats(clustering.halo_boxes(hits))


@query(STATS.format(t="(select * from pl where cluster_id in (select cluster_id from pl where e > 70))"), _spatial(1))
def energy_filtered_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(clustering.energy_filtered(clustering.pixel_list(tracks(spark, sf_dir))))


@query(
    """select lin, cast(ceil(ns / 25) as bigint) as toa, cast(round((ceil(ns / 25) * 25 - ns) / 1.5625) as int) as fast_toa
    from (select *, min(tick) over (partition by cluster_id) * cast(1.5625 as double) / 2 + (tick - min(tick) over (partition by cluster_id)) * cast(1.5625 as double) as ns from tc)""",
    TEMPORAL,
)
def replay_freq_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocess.scale_frequency(clustering.temporal(tracks(spark, sf_dir)), 2.0).select("lin", "toa", "fast_toa")


# --- slices and borders ------------------------------------------------------------------------


@query(f"select slice, cast(slice % 4 as int) as lane, count(*) as hits from (select cast(floor(floor(tick * 1.5625 + 0.5) / {SLICE_NS}) as bigint) as slice from f1) group by all")
def slice_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.slice_of(fixtures.track_hits(spark, sf_dir)).groupBy("slice", "lane").agg(F.count("*").alias("hits"))


BOUNDS = """b as (select cluster_id, min(tick) as first_tick, max(tick) as last_tick, count(*) as hit_count,
 cast(greatest(min(x) - 1, 0) as int) as "left", cast(least(max(x) + 1, 255) as int) as "right",
 cast(greatest(min(y) - 1, 0) as int) as top, cast(least(max(y) + 1, 255) as int) as bottom from tc group by cluster_id)"""


@query(
    f"""select *, first_tick % {SLICE_TICKS} < 128 or first_tick % {SLICE_TICKS} > {SLICE_TICKS - 128} or last_tick % {SLICE_TICKS} < 128
    or last_tick % {SLICE_TICKS} > {SLICE_TICKS - 128} or last_tick - first_tick > {SLICE_TICKS} as border from b""",
    f"{TEMPORAL}, {BOUNDS}",
)
def border_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.with_border(slices.cluster_bounds(clustering.temporal(tracks(spark, sf_dir))))


def _border(every: int) -> str:
    n = every * SLICE_TICKS
    return f"(first_tick % {n} < 128 or first_tick % {n} > {n - 128} or last_tick % {n} < 128 or last_tick % {n} > {n - 128} or last_tick - first_tick > {n})"


@query(f"select cluster_id, case when not {_border(1)} then 0 when not {_border(2)} then 1 when not {_border(4)} then 2 else 3 end as level from b", f"{TEMPORAL}, {BOUNDS}")
def border_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.with_level(slices.cluster_bounds(clustering.temporal(tracks(spark, sf_dir))), levels=3).select("cluster_id", "level")


@query(
    f"""select cluster_id, case when ns % {SLICE_NS} < {SLICE_NS // 2} then 0 else 1 end as pipe, cast(floor((ns + {SLICE_NS // 2}) / {SLICE_NS}) as bigint) as border_id
    from (select *, cast(floor(first_tick * 1.5625 + 0.5) as bigint) as ns from b)""",
    f"{TEMPORAL}, {BOUNDS}",
)
def two_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.two_way(slices.cluster_bounds(clustering.temporal(tracks(spark, sf_dir)))).select("cluster_id", "pipe", "border_id")


@query(STATS.format(t="pl"), _spatial(1))
def border_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices clustered by themselves and merged across borders; on these tracks the same as without slices."""
    return stats(slices.merge_borders(slices.sliced_clusters(tracks(spark, sf_dir))))


@query(
    """select cluster_id, first_tick, lane, row_number() over (order by first_tick, cluster_id) as row_no from (
    select cluster_id, first_tick, 0 as lane from b where "left" < 128 union all select cluster_id, first_tick, 1 from b where "left" >= 128)""",
    f"{TEMPORAL}, {BOUNDS}",
)
def combined_time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = slices.cluster_bounds(clustering.temporal(tracks(spark, sf_dir))).select("cluster_id", "first_tick", "left")
    parts = [both.filter(F.col("left") < 128).withColumn("lane", F.lit(0)), both.filter(F.col("left") >= 128).withColumn("lane", F.lit(1))]
    return slices.ranked_union(parts, ["first_tick", "cluster_id"]).select("cluster_id", "first_tick", "lane", "row_no")


# --- windows -----------------------------------------------------------------------------------

_EDGES = ", ".join(f"{float(x)}" for x in H.ENERGY_EDGES)
_SD = "case when n < 2 then cast('nan' as double) else sqrt(greatest(cast({c}{c} as double) / n - ({c} / n) * ({c} / n), 0)) end"
WINDOWS = f"""w0 as (select *, case when tick % {W2} = 0 and tick > 0 and (tick = {W2} or exists (
    select 1 from e2 q where q.tick // {W2} = e2.tick // {W2} - 1 and q.tick % {W2} > 0)) then tick // {W2} - 1 else tick // {W2} end as win from e2),
w1 as (select *, case when tick - lag(tick, 1, 0) over (partition by win order by tick, y, x) > 128 then 1 else 0 end as opens,
       len(list_filter([{_EDGES}], lambda v: v <= e)) as bin from w0),
w2 as (select win, count(*) as n, sum(e) as se, max(e) as me, cast(sum(x) as double) as x, cast(sum(y) as double) as y, sum(x * x) as xx, sum(y * y) as yy, sum(opens) as c,
       max(tick) as last_tick from w1 group by win),
w3 as (select win, win * {W2} * cast(1.5625 as double) as start_toa_ns, x / n as mean_x, y / n as mean_y, {_SD.format(c="x")} as std_x, {_SD.format(c="y")} as std_y,
       cast(n as double) as hit_count, se as total_energy, greatest(me, 0) as max_energy_hit, cast(case when c > 0 then n // c else 0 end as double) as mean_temp_cluster_size,
       case when c > 0 then se / c else 0 end as mean_temp_cluster_energy, last_tick from w2),
spine as (select unnest(range(cast((select max(win) from w3) as bigint))) as win),
w4 as (select spine.win, spine.win * {W2} * cast(1.5625 as double) as start_toa_ns, coalesce(mean_x, cast('nan' as double)) as mean_x, coalesce(mean_y, cast('nan' as double)) as mean_y,
       coalesce(std_x, cast('nan' as double)) as std_x, coalesce(std_y, cast('nan' as double)) as std_y, coalesce(hit_count, 0) as hit_count, coalesce(total_energy, 0) as total_energy,
       coalesce(max_energy_hit, 0) as max_energy_hit, coalesce(mean_temp_cluster_size, 0) as mean_temp_cluster_size,
       coalesce(mean_temp_cluster_energy, 0) as mean_temp_cluster_energy from spine left join w3 on w3.win = spine.win)"""
_ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in ("mean_x", "mean_y", "std_x", "std_y", "hit_count", "total_energy", "max_energy_hit", "mean_temp_cluster_size", "mean_temp_cluster_energy"))


def _rounded(df: DataFrame) -> list:
    return [r6(c).alias(c) for c in windows.SCALARS]


@query(f"select win, start_toa_ns, {_ROUNDED}, last_tick from w3", WINDOWS)
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.aggregate(windows.assign(stream(spark, sf_dir)))
    return out.select("win", "start_toa_ns", *_rounded(out), "last_tick")


@query(
    """select w1.win, cast(b.bin as int) as bin, round(count(*) filter (w1.bin = b.bin) / count(*), 6) as share
    from w1, (select unnest(range(17)) as bin) b group by w1.win, b.bin""",
    WINDOWS,
)
def window_energy_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.histogram_long(windows.aggregate(windows.assign(stream(spark, sf_dir))))
    return out.select("win", "bin", r6("share").alias("share"))


@query("select max(hit_count) * 1e9 / 2e8 as max_frequency from w4", WINDOWS)
def window_max_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.max_frequency(windows.features(stream(spark, sf_dir)))


@query(f"select win, start_toa_ns, {_ROUNDED} from w4", WINDOWS)
def window_empty_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.features(stream(spark, sf_dir))
    return out.select("win", "start_toa_ns", *_rounded(out))


_EMPTY = {c: "cast('nan' as double)" if c in ("mean_x", "mean_y", "std_x", "std_y") else "cast(0 as double)" for c in windows.SCALARS}
_MEDIANS = ", ".join(
    f"round({c} - list_sort(list_concat(list({c}) over h, [{_EMPTY[c]} for i in range(greatest(5 - win, 0))]))[3], 6) as {c}" for c in windows.SCALARS
)


@query(f"select win, start_toa_ns, {_MEDIANS} from w4 window h as (order by win rows between 5 preceding and 1 preceding)", WINDOWS)
def window_median_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.median_difference(windows.features(stream(spark, sf_dir)), 5)
    return out.select("win", "start_toa_ns", *_rounded(out))


#: All 27 features of every closed window in long form: win, place in the vector, feature, v.
VECTORS = f"""{WINDOWS}, v0 as (select win, [start_toa_ns, {", ".join(windows.SCALARS)}] as v from w4),
v1 as (select win, cast(unnest(range(10)) as int) as place, unnest(['start_toa_ns', {", ".join(f"'{c}'" for c in windows.SCALARS)}]) as feature, unnest(v) as v from v0
  union all select spine.win, cast(10 + b.bin as int), 'h' || b.bin, coalesce(count(*) filter (w1.bin = b.bin) / nullif(count(w1.win), 0), 0)
  from spine cross join (select unnest(range(17)) as bin) b left join w1 on w1.win = spine.win group by spine.win, b.bin),
vl as (select win, place, feature, case when isnan(v) then 0 else v end as v from v1)"""


@query("select win, place, round(v, 6) as v from vl", VECTORS)
def window_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.to_vector(windows.features(stream(spark, sf_dir)), replace_nan=True)
    return out.select("win", F.posexplode("vector").alias("place", "v")).select("win", "place", r6("v").alias("v"))


@query(
    "select win, feature, round(v, 6) as v from (unpivot (select win, hit_count, total_energy, max_energy_hit from w4) on hit_count, total_energy, max_energy_hit into name feature value v)", WINDOWS
)
def window_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features written as text lines and read back."""
    lines = windows.to_lines(windows.features(stream(spark, sf_dir)))
    back = windows.from_lines(lines.select("value")).withColumn("win", F.round(F.col("start_toa_ns") / F.lit(W2 * 1.5625)).cast("long"))
    return back.unpivot(["win"], ["hit_count", "total_energy", "max_energy_hit"], "feature", "v").select("win", "feature", r6("v").alias("v"))


# --- triggers ----------------------------------------------------------------------------------

INTERVALS = "hit_count[1] mean_x[px] max_energy_hit[keV]\n[36:*] [*:72.5] [200:*]\n[*:18] [*:*] [*:*]"
_FIRES = "((hit_count >= 36 and (isnan(mean_x) or mean_x <= 72.5) and max_energy_hit >= 200) or hit_count <= 18)"


@query(f"select win, {_FIRES} as fires from w4", WINDOWS)
def interval_trigger_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.features(stream(spark, sf_dir))
    return out.select("win", triggers.fires_interval(triggers.parse_intervals(INTERVALS)).alias("fires"))


@query("select win, hit_count > 30.5 as fires from w4", WINDOWS)
def onnx_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network of one neuron that looks at the hit count."""
    weights = [1.0 if c == "hit_count" else 0.0 for c in [*windows.SCALARS, *range(windows.BINS)]]
    return triggers.fires_model(windows.features(stream(spark, sf_dir)), linear_model(weights, -30.5)).select("win", "fires")


GATE = f"""{WINDOWS}, g0 as (select *, row_number() over (partition by win order by tick, y, x) > 1 or win = 0 as counted from w0),
g1 as (select win, count(*) as hit_count, max(e) as max_energy_hit, avg(x) as mean_x, max(tick) as last_tick from g0 where counted group by win),
g2 as (select *, {_FIRES} as fires from g1),
g3 as (select *, last_value(case when fires then last_tick end ignore nulls) over (order by win rows unbounded preceding) as lt from g2),
g4 as (select *, coalesce(last_tick - lt <= 96000000, false) as active from g3),
g5 as (select *, coalesce(lag(active) over (order by win), false) as was_active from g4)"""


@query(
    f"""select tick, lin, win from g0 where coalesce((select arg_max(active, win) from g5 where g5.win < g0.win), false)
    or exists (select 1 from g5 where fires and not was_active and (g5.win = g0.win or (g5.win > g0.win and g5.win <= g0.win + 2 and g0.tick + {W2} >= g5.win * {W2})))""",
    GATE,
)
def trigger_gate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that pass an interval trigger which holds for 150 ms."""
    hits = triggers.gate_windows(stream(spark, sf_dir))
    seen = windows.aggregate(hits.filter("counted"))
    states = triggers.activity(seen.withColumn("fires", triggers.fires_interval(triggers.parse_intervals(INTERVALS))), 96_000_000)
    return triggers.gate(hits, states).select("tick", "lin", "win")


@query(
    """select win, hit_count, coalesce(hit_count / p > 1.5 or p / hit_count > 1.5, true) as fires
    from (select win, cast(count(*) as double) as hit_count, lag(cast(count(*) as double)) over (order by win) as p from (select tick // 32000000 as win from f2) group by win)"""
)
def frequency_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate changes between 50 ms windows by half; production asks for twice the rate."""
    out = triggers.frequency_windows(stream(spark, sf_dir))
    return out.select("win", "hit_count", triggers.fires_frequency(1.5).alias("fires"))


#: The chain of rate windows, hit after hit, with the state that each leaves: 50 ms spans, held for two.
RATES = f"""d0 as (select tick, sum(count(*)) over (order by tick) as cum from e2 where tick > 0 group by tick union all select 0, 0),
d1 as materialized (select a.tick, b.tick as nxt, cast(b.cum - a.cum + case when a.tick > 0 then 1 else 0 end as double) / (b.tick - a.tick) as rate
       from d0 a asof join d0 b on a.tick + {rates.SPAN} < b.tick),
ch as (select cast(0 as bigint) as tick, false as before, false as flush, false as held, cast(-1 as double) as old, cast(0 as bigint) as fired
  union all select nxt, held, flush, (held or flush) and nxt - since <= {2 * rates.SPAN}, case when held then old else rate end, since from (
    select *, case when flush and old >= 0 then nxt else fired end as since from (
      select d1.nxt, d1.rate, ch.held, ch.old, ch.fired,
        not ch.held and (ch.old < 0 or (ch.old > 0 and d1.rate / ch.old > 2) or (d1.rate > 0 and ch.old / d1.rate > 2)) as flush from ch join d1 on d1.tick = ch.tick))),
kept as (select e2.* from e2 asof left join (select * from ch where tick > 0) c on e2.tick <= c.tick
  where c.before or (c.flush and e2.tick >= c.tick - {rates.SPAN}) or (c.tick is null and (select arg_max(held, tick) from ch)))"""


@query("select tick, lin, tot from kept", RATES)
def triggered_rate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.triggered_hits(stream(spark, sf_dir)).select("tick", "lin", "tot")


@query(STATS.format(t="pl"), f"{RATES}, {_spatial(1).replace('from e1', 'from kept')}")
def triggered_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(clustering.pixel_list(rates.triggered_hits(stream(spark, sf_dir))))


@query("select feature, round(avg(v), 4) as mean, round(case when stddev_pop(v) < 1e-7 then 1 else stddev_pop(v) end, 4) as std from vl where place > 0 group by feature", VECTORS)
def std_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.scaler(windows.features(stream(spark, sf_dir))).select("feature", r4("mean").alias("mean"), r4("std").alias("std"))


# --- analysis, validation, files ---------------------------------------------------------------


@query("select cluster_id, diameter, timespan from (" + STATS.format(t="tc") + ")", TEMPORAL)
def cluster_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.properties(clustering.temporal(tracks(spark, sf_dir))).select("cluster_id", "diameter", "timespan")


@query("select cluster_id, center_x, center_y from (" + STATS.format(t="pl") + ")", _spatial(1))
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(clustering.pixel_list(tracks(spark, sf_dir))).select("cluster_id", "center_x", "center_y")


@query("select diameter, count(*) as clusters, round(avg(timespan), 4) as mean_timespan from (" + STATS.format(t="pl") + ") group by diameter", _spatial(1))
def diameter_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.properties(clustering.pixel_list(tracks(spark, sf_dir)))
    return out.groupBy("diameter").agg(F.count("*").alias("clusters"), r4(F.avg("timespan")).alias("mean_timespan"))


@query("select hit_count, round(sum(total_energy), 2) as energy, round(max(total_energy), 4) as top from (" + STATS.format(t="tc") + ") group by hit_count", TEMPORAL)
def cluster_energy_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats(clustering.temporal(tracks(spark, sf_dir)))
    return out.groupBy("hit_count").agg(F.round(F.sum("total_energy"), 2).alias("energy"), r4(F.max("total_energy")).alias("top"))


@query(
    """select a, b, n / max(n) over () as share from (select cast(least(floor((hit_count - lo1) / ((hi1 - lo1) / 10)), 9) as int) as a,
    cast(least(floor((diameter - lo2) / ((hi2 - lo2) / 10)), 9) as int) as b, count(*) as n
    from s, (select min(hit_count) as lo1, cast(max(hit_count) as double) as hi1, min(diameter) as lo2, cast(max(diameter) as double) as hi2 from s) group by all)""",
    f"{TEMPORAL}, s as ({STATS.format(t='tc')})",
)
def attribute_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.histogram_2d(analysis.properties(clustering.temporal(tracks(spark, sf_dir))), "hit_count", "diameter")
    return out.select(F.col("a_bucket").alias("a"), F.col("b_bucket").alias("b"), "share")


@query("select hit_count, round(avg(total_energy), 4) as mean, round(stddev_pop(total_energy), 4) as std from (" + STATS.format(t="tc") + ") group by hit_count", TEMPORAL)
def mean_std_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analysis.mean_std(stats(clustering.temporal(tracks(spark, sf_dir))), "total_energy", "hit_count")
    return out.select("hit_count", r4("mean").alias("mean"), r4("std").alias("std"))


_RING = """(select count(*) + count(*) filter (q.x = a.x - {r} and q.y = a.y - {r}) from (select distinct x, y from pl p where p.cluster_id = a.cluster_id) q
      where greatest(abs(q.x - a.x), abs(q.y - a.y)) = {r}) / (8.0 * {r}) as ring{r}"""


@query(
    f"""select cluster_id, round(e, 4) as e, case when ring1 < 0.74 then 0 when ring2 < 0.74 then 1 end as halo from (select a.cluster_id, a.e, {_RING.format(r=1)}, {_RING.format(r=2)}
      from pl a where a.e > 50 and a.cluster_id not in (select cluster_id from pl where x in (0, 255) or y in (0, 255)))""",
    _spatial(1),
)
def halo_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No cluster of these tracks fills a second ring, which the SQL checks."""
    return analysis.halo_widths(clustering.pixel_list(tracks(spark, sf_dir))).select("cluster_id", r4("e").alias("e"), "halo")


@query(
    """select matched, na - matched as only_first, nb - matched as only_second, cast(matched as double) / (na + nb - matched) as iou from (
    select count(*) as matched from sa join sb on sa.sig = sb.sig), (select count(*) as na from sa), (select count(*) as nb from sb)""",
    f"""{_spatial(1)}, sa as (select cluster_id, list_sort(list((tick, x, y))) as sig from tc group by cluster_id),
    sb as (select cluster_id, list_sort(list((tick, x, y))) as sig from pl group by cluster_id)""",
)
def clustering_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = tracks(spark, sf_dir)
    return analysis.iou(clustering.temporal(hits), clustering.pixel_list(hits))


@query(
    """select cluster_id, first_toa, hit_count, cast(coalesce(sum(hit_count + 1) over o, 0) as bigint) as line_start, cast(coalesce(sum(bytes) over o, 0) as bigint) as byte_start
    from (select cluster_id, min(tick) * cast(1.5625 as double) as first_toa, count(*) as hit_count,
          sum(length(printf('%d %d %.6f %.2f', x, y, tick * cast(1.5625 as double), e)) + 1) + 2 as bytes from tc group by cluster_id)
    window o as (order by first_toa, cluster_id rows between unbounded preceding and 1 preceding)""",
    TEMPORAL,
)
def mm_cl_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sinks.cluster_offsets(clustering.nested(clustering.temporal(tracks(spark, sf_dir))))
    return out.drop("text")


@query("select lin as linear_coord, toa, fast_toa, tot % 1024 as tot from f1")
def frame_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits encoded as readout frames and decoded again."""
    hits = fixtures.track_hits(spark, sf_dir).withColumn("linear_coord", F.col("lin"))
    return sources.decode_frames(sources.encode_frames(hits, ["toa", *ORDER])).drop("frame_no")


@query("select count(*) as hits, cast(0 as bigint) as announced, cast(0 as bigint) as lost_frames, false as ended from f1")
def frame_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fixtures.track_hits(spark, sf_dir).withColumn("linear_coord", F.col("lin"))
    return sources.frame_summary(sources.encode_frames(hits, ["toa", *ORDER]))


@query("select lin as linear_coord, toa, fast_toa, tot from f2")
def text_hit_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits written as text lines and parsed."""
    raw = fixtures.stream_hits(spark, sf_dir).select(F.concat_ws(" ", "lin", "toa", "fast_toa", "tot").alias("value"))
    out = sources.parse_hits(raw)
    return out.select("linear_coord", "toa", F.col("fast_toa").cast("int").alias("fast_toa"), F.col("tot").cast("int").alias("tot"))


@query("select lin as linear_coord, toa, fast_toa, tot from f2")
def text_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits written to a text file and read from it."""
    path = shared_file(spark, "hits")
    sinks.write_raw(fixtures.stream_hits(spark, sf_dir).withColumn("linear_coord", F.col("lin")), path)
    return sources.text_hits(spark, path).select("linear_coord", "toa", F.col("fast_toa").cast("int").alias("fast_toa"), F.col("tot").cast("int").alias("tot"))


@query(
    """select cast(cluster_no as bigint) as cluster_no, first_toa, hit_count, x, y, tick * cast(1.5625 as double) as toa, round(e, 1) as e from tc join (
    select cluster_id, n as hit_count, first * cast(1.5625 as double) as first_toa, coalesce(sum(n + 1) over (order by first, cluster_id rows between unbounded preceding and 1 preceding), 0) as cluster_no
    from (select cluster_id, count(*) as n, min(tick) as first from tc group by cluster_id)) h using (cluster_id)""",
    TEMPORAL.replace("from e1", "from (select * replace (cast(tot as double) as e) from e1)"),
)
def cluster_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clustered dataset written and read; energies are times over threshold, as the file has two decimals."""
    hits = preprocess.uncalibrated(fixtures.track_hits(spark, sf_dir))
    ini = sinks.write_clusters(clustering.nested(clustering.temporal(hits)), shared_file(spark, "clusters"), "tracks")
    out = sources.clusters(spark, ini)
    return out.select("cluster_no", "first_toa", "hit_count", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "toa", F.round("e", 1).alias("e"))


# --- plans and streams -------------------------------------------------------------------------


def _planned(spark: SparkSession, sf_dir: str, text: str, settings: Settings | None = None) -> DataFrame:
    raw = fixtures.track_hits(spark, sf_dir).select(F.col("lin").alias("linear_coord"), "toa", "fast_toa", "tot")
    return next(iter(build(Graph.parse(text), Context(spark, settings or Settings(), {"r1": raw}, fixtures.calibration(spark))).values()))


@query(STATS.format(t="pl"), _spatial(1))
def plan_tree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lanes joined pair by pair, from the options' recipe."""
    out = _planned(spark, sf_dir, recipe("standard", "tree", 4, "cp"))
    return out.withColumns({c: r4(c) for c in ("total_energy", "center_x", "center_y")})


@query(STATS.format(t="pl"), _spatial(1))
def plan_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for dense data: slices of time, joined at their borders."""
    settings = Settings.parse(["clustering", "-sliced:true"])
    out = _planned(spark, sf_dir, recipe("standard", "single_layer", 4, "cp"), settings)
    return out.withColumns({c: r4(c) for c in ("total_energy", "center_x", "center_y")})


@query(STATS.format(t="tc"), TEMPORAL)
def plan_parallel_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal clusters in lanes split after sorting."""
    out = _planned(spark, sf_dir, recipe("temporal", "single_layer", 3, "cp", "sorter"))
    return out.withColumns({c: r4(c) for c in ("total_energy", "center_x", "center_y")})


@query(
    """select matched, cast(matched as double) / (na + nb - matched) as iou from (
    select count(*) as matched from sa join sb on sa.sig = sb.sig), (select count(*) as na from sa), (select count(*) as nb from sb)""",
    f"""{_spatial(1)}, sa as (select cluster_id, list_sort(list((tick, x, y, tot))) as sig from tc group by cluster_id),
    sb as (select cluster_id, list_sort(list((tick, x, y, tot))) as sig from pl group by cluster_id)""",
)
def tolerant_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One side is shifted by less than the tolerance."""
    hits = tracks(spark, sf_dir)
    near = F.transform("hits", lambda h: F.struct("cluster_id", h["x"].alias("x"), h["y"].alias("y"), (h["toa"] + 0.001).alias("toa"), (h["e"] + 0.001).alias("e")))
    shifted = clustering.nested(clustering.pixel_list(hits)).withColumn("hits", near)
    return analysis.approx_iou(clustering.nested(clustering.temporal(hits)), shifted)


@query(f"select tick // {W2} as win, count(*) as hit_count, round(sum(e), 4) as energy, round(max(e), 4) as max_energy from e2 group by all")
def event_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming plan of tumbling windows, on a table."""
    out = streaming.window_counts(streaming.with_event_time(stream(spark, sf_dir)))
    return out.select("win", "hit_count", r4("energy").alias("energy"), r4("max_energy").alias("max_energy"))


@query("select min(tick) as first_tick, max(tick) as last_tick, count(*) as hit_count, round(sum(e), 4) as energy from tc group by cluster_id", TEMPORAL)
def event_time_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming plan of temporal clusters, on a table of one lane."""
    out = streaming.temporal_clusters(streaming.with_event_time(tracks(spark, sf_dir).withColumn("lane", F.lit(0))))
    return out.select("first_tick", "last_tick", "hit_count", r4("energy").alias("energy"))


@query(
    f"""select grp, part, supp, tick from (select *, max(tick) over (order by arrival rows between unbounded preceding and 1 preceding) as seen
    from (select *, row_number() over (order by (grp * 7919) % 10007, {", ".join(ORDER)}) as arrival from f1)) where seen - tick > {REORDER_TICKS}"""
)
def late_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in a mixed order of arrival; those later than the watermark allows."""
    hits = numbered(fixtures.track_hits(spark, sf_dir), ["tick", "lin", "part", "supp", "tot"], F.col("grp") * 7919 % 10007, "arrival")
    return streaming.late_rows(hits, "arrival").select("grp", "part", "supp", "tick")


assert JOIN_TICKS == 128, "the SQL above spells the join distance out"
