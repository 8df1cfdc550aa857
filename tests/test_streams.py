"""Windows, triggers, files, plans and streaming."""

from __future__ import annotations

import random
import socket
import struct
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hitweave import sinks, sources, streaming
from hitweave.model import Settings
from hitweave.operators import analysis, clustering, kernels, preprocess, rates, slices, triggers, windows
from hitweave.plans import cli
from hitweave.plans.graph import Context, Graph, build, cluster_slices, recipe

HIT = "tick long, x int, y int, e double"


def window_model(ticks, width):
    """Windows by the book: a hit up to the end of the open window belongs to it."""
    start, out, closing = 0, [], []
    for t in ticks:
        closing.append(t > start + width)
        if closing[-1]:
            start = t // width * width
        out.append(start // width)
    return out, closing


@pytest.mark.parametrize("seed", range(6))
def test_window_assignment(spark, seed):
    rng = random.Random(seed)
    ticks = sorted({rng.choice([rng.randint(0, 1500), 100 * rng.randint(0, 15)]) for _ in range(25)})
    df = spark.createDataFrame([(t, 1, 1, 1.0) for t in ticks], HIT)
    got = {r["tick"]: r["win"] for r in windows.assign(df, 100).collect()}
    assert [got[t] for t in ticks] == window_model(ticks, 100)[0]


def gate_model(ticks, width, fires, hold):
    """The trigger node by the book: fires(window's hits) decides; statistics miss the closing hit."""
    start, own, buffer, out = 0, [], [], []
    active, last_fired = False, None
    for t in ticks:
        if t > start + width:
            if own:
                if fires(own):
                    last_fired = own[-1]
                    if not active:
                        buffer = [b for b in buffer if b + width >= start]
                        out += buffer
                        buffer, active = [], True
                if active and own[-1] - last_fired > hold:
                    active = False
            while t > start + width:
                start += width
            own = []
        else:
            own.append(t)
        (out if active else buffer).append(t)
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_gate(spark, seed):
    rng = random.Random(seed)
    ticks = sorted({rng.randint(0, 3000) for _ in range(rng.randint(20, 90))} - set(range(0, 3001, 100)))
    df = spark.createDataFrame([(t, 1, 1, 1.0) for t in ticks], HIT)
    hits = triggers.gate_windows(df, 100)
    seen = windows.aggregate(hits.filter("counted"), 100).withColumn("fires", F.col("hit_count") >= 4)
    last_open = max(t // 100 for t in ticks)  # never closed, so never shown to the trigger
    states = triggers.activity(seen.filter(F.col("win") < last_open), 150)
    got = sorted(r["tick"] for r in triggers.gate(hits, states, 100).collect())
    assert got == gate_model(ticks, 100, lambda own: len(own) >= 4, 150)


def rate_model(ticks, span, hold):
    """The triggered clustering by the book, for distinct ticks."""
    first, n, fired, old, processing = 0, 0, 0, None, False
    buffer, out = [], []
    for t in ticks:
        n += 1
        end = t - first > span
        buffer = [b for b in buffer if b >= t - span]
        (out if processing else buffer).append(t)
        if end:
            if not processing:
                rate, hit = n / (t - first), old is None
                if old is not None and (rate / old > 2 or old / rate > 2):
                    hit, fired = True, t
                old = rate
                if hit:
                    out, buffer, processing = out + buffer, [], True
            if t - fired > hold:
                processing = False
            first, n = t, 1
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_triggered_hits(spark, seed):
    rng = random.Random(seed)
    t, ticks = 0, []
    for _ in range(400):
        t += max(1, round(rng.expovariate(1 / rng.choice([3, 3, 40]) if (t // 1500) % 2 else 1 / 12)))
        ticks.append(t)
    df = spark.createDataFrame([(t, 1, 1, 1.0) for t in ticks], HIT)
    windowed = rates.rate_windows(df, 100, per_piece=rng.choice([1, 3, 1000]))
    ends, x = [], 100
    for t in ticks:
        if t > x:
            ends.append(t)
            x = t + 100
    got = {r["tick"]: r["end"] for r in windowed.collect()}
    assert got == {t: min([e for e in ends if e >= t], default=None) for t in ticks}
    assert sorted(r["tick"] for r in rates.triggered_hits(df, 100, 200).collect()) == rate_model(ticks, 100, 200)


@pytest.mark.parametrize("seed", range(2))
def test_rate_windows_in_small_blocks(spark, seed):
    rng = random.Random(seed)
    df = spark.createDataFrame([(t, 1, 1, 1.0) for t in sorted({rng.randint(0, 5000) for _ in range(300)})], HIT)
    windowed = rates.rate_windows(df, 100)
    small = rates.rate_windows(df, 100, per_piece=rng.choice([1, 3]), per_block=rng.choice([1, 2, 5]))
    assert {r["tick"]: r["end"] for r in small.collect()} == {r["tick"]: r["end"] for r in windowed.collect()}
    keys = ["end", "before", "flush", "after"]
    assert sorted(rates.rate_states(small, 100, 200, per_block=1).select(keys).collect()) == sorted(rates.rate_states(windowed, 100, 200).select(keys).collect())


@pytest.mark.parametrize("seed", range(300))
def test_rate_states_from_every_state(seed):
    """The state a block is left in is always among the ones the next block is tried with."""
    rng = random.Random(seed)
    hold = rng.choice([0, 150, 200, 450, 1000])
    reach, end, rows = hold // 100 + 3, 0, []
    for _ in range(40):
        end += rng.choice([101, 110, 300, 2000])
        rows.append((end, rng.choice([1.0, 5.0, 30.0]), 100.0))
    table = pd.DataFrame(rows, columns=["end", "n", "width"])
    for cut in range(reach, 40):
        _, state = rates.follow_rates(table[:cut], hold)
        assert state in rates.possible(table[cut - reach : cut], hold)


@pytest.mark.parametrize("seed", range(50))
def test_passages_compose(seed):
    rng = random.Random(seed)
    per, ticks = rng.choice([1, 2, 4]), sorted({rng.randint(0, 6000) for _ in range(rng.choice([5, 40, 400]))})
    own = {}
    for t in ticks:
        own.setdefault(t // (100 * per), []).append(t)
    parts = [(p, *rates.passage(np.array(t), 100, p * 100 * per)) for p, t in own.items()]
    table = pd.concat([pd.DataFrame({"piece": p, "entry": e, "bound": b}) for p, e, b in parts])
    start = parts[0][0] * 100 * per
    entry, bound = rates.compose(table, start + 100)
    for x in range(start, start + 101):
        want = x
        for _, e, b in parts:
            want = int(rates.through(e, b, np.array([want]))[0])
        assert int(rates.through(entry, bound, np.array([x]))[0]) == want


def test_intervals(spark):
    rows = triggers.parse_intervals("hit_count[1] mean_x[px]\n[1:5] [*:10]\n")
    df = spark.createDataFrame([(1.0, 10.0), (5.0, 10.5), (6.0, 1.0), (3.0, float("nan"))], "hit_count double, mean_x double")
    assert [r[0] for r in df.select(triggers.fires_interval(rows)).collect()] == [True, False, False, True]
    with pytest.raises(ValueError):
        triggers.parse_intervals("e_distrib[[1]]\n[0:1]")


def test_model_files(spark, tmp_path):
    from hitweave.functions.onnx import linear_model

    rows = [(t, 1, 1, 1.0) for w in range(6) for t in range(100 * w + 1, 100 * w + 2 + 2 * w)]
    df = spark.createDataFrame(rows, HIT)
    weights = [1.0 if c == "hit_count" else 0.0 for c in [*windows.SCALARS, *range(windows.BINS)]]
    (tmp_path / "m.nnt").write_bytes(linear_model(weights, -6.5))
    model = triggers.read_model(spark, str(tmp_path / "m.nnt"))
    seen = windows.aggregate(windows.assign(df, 100), 100)
    assert {r["win"]: r["fires"] for r in triggers.fires_model(seen, model).collect()} == {w: 1 + 2 * w > 6.5 for w in range(6)}
    assert not any(r["fires"] for r in triggers.fires_model(seen, model, one_class=True).collect())
    settings = Settings()
    settings.values["trigger"] |= {"trigger_file": str(tmp_path / "m.nnt"), "window_size": 156.25, "trigger_time": 0.0}
    out = build(Graph.parse("r1tr1"), Context(spark, settings, {"r1": df}))["tr1"]
    assert 0 < out.count() < len(rows)


def test_empty_windows_and_first_window(spark):
    df = spark.createDataFrame([(250, 1, 1, 1.0), (260, 1, 1, 700.0), (900, 1, 1, 1.0)], HIT)
    out = {r["win"]: r for r in windows.features(df, 100).collect()}
    assert sorted(out) == list(range(9)) and out[2]["hit_count"] == 2 and out[0]["hit_count"] == 0
    assert out[2]["h15"] == 0.5 and out[0]["mean_x"] != out[0]["mean_x"]
    assert 9 in {r["win"] for r in windows.features(df, 100, emit_open=True).collect()}


def test_calibration_edges(spark):
    hits = spark.createDataFrame([(1, 1, 50), (2, 2, 50), (3, 3, 50)], "x int, y int, tot int")
    calib = spark.createDataFrame([(1, 1, 0.0, 20.0, 100.0, 1.0), (2, 2, 1.6, 20.0, -1e6, 1.0), (3, 3, 1.6, 20.0, 100.0, 1.0)], "x int, y int, a double, b double, c double, t double")
    e = {r["x"]: r["e"] for r in preprocess.calibrate(hits, calib).collect()}
    assert e[1] == 0.1 and e[2] == 0.1
    assert 1.6 * e[3] + 20 - 100 / (e[3] - 1) == pytest.approx(50)


def test_text_hits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿# head\n\n513 1000 3 20\n7  -1 0 0\n65535\t2000\t15\t1\nbad\n", encoding="utf-8")
    rows = preprocess.decode(sources.text_hits(spark, str(tmp_path / "a.txt"))).orderBy("toa").collect()
    assert [(r["x"], r["y"], r["tick"]) for r in rows] == [(1, 2, 15_997), (255, 255, 31_985)]


def test_repeated_recording(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# x\n1 100 0 5\n2 90 0 5\n3 130 0 5\n4 500 0 5\n")
    raw = sources.text_hits(spark, str(tmp_path / "a.txt"), numbered=True)
    assert [r["line"] for r in raw.orderBy("line").collect()] == [1, 2, 3, 4]
    out = preprocess.repeat(raw, 3, size=3)  # first and last in file order: a shift of 30
    assert sorted(r["toa"] for r in out.collect()) == sorted(t + 30 * k for t in (100, 90, 130) for k in range(3))
    assert preprocess.repeat(raw.limit(0), 3).count() == 0
    settings = Settings()
    settings.values["reader"] |= {"repetition_count": 2, "freq_multiplier": 2.0}
    twice = build(Graph.parse("r1rr1"), Context(spark, settings, {"r1": raw}))["rr1"]
    assert sorted(r["toa"] for r in twice.collect()) == sorted(twice_model([100, 90, 130, 500], 400))


def twice_model(toas, span):
    """No two hits are one cluster, so all times are halved."""
    return [-(-(t + k * span) // 2) for t in toas for k in range(2)]


def test_throughput():
    rows = [{"numInputRows": n, "processedRowsPerSecond": r} for n, r in ((0, 0.0), (10, 5.0), (30, 7.0), (20, 9.0))]
    assert streaming.throughput(rows) == {"rows": 60.0, "mean": 7.0, "median": 7.0}
    assert streaming.throughput([])["mean"] == 0


def test_calibration_files(spark, tmp_path):
    for n, name in enumerate("abct"):
        (tmp_path / f"{name}.txt").write_text("\n".join(" ".join(str(n + x + 1000 * y) for x in range(256)) for y in range(256)) + "\n")
    out = sources.calibration(spark, str(tmp_path))
    row = out.filter("x = 3 and y = 7").first()
    assert out.count() == 65_536 and (row["a"], row["t"]) == (7003.0, 7006.0)
    assert sources.calibration_for("x/run_F4-W1_2.txt", ["c/F4-W1", "c/F5"]) == "c/F4-W1"
    with pytest.raises(ValueError):
        sources.calibration_for("x/run.txt", ["c/F4-W1"])
    files = ["a_F1.txt", "b_F2.txt"]
    assert sources.calibrations(files, ["F2", "F1"]) == {"a_F1.txt": "F1", "b_F2.txt": "F2"}
    assert sources.calibrations(files, ["x", "y"], "manual") == {"a_F1.txt": "x", "b_F2.txt": "y"}
    assert set(sources.calibrations(files, ["x"], "same").values()) == {"x"} and set(sources.calibrations(files, [], "none").values()) == {None}
    with pytest.raises(ValueError):
        sources.calibrations(files, ["x"], "manual")


def test_cluster_files_round_trip(spark, tmp_path):
    hits = [(t, x, y, 12.25) for t, x, y in [(16, 5, 5), (17, 6, 5), (4000, 9, 9), (900_000, 1, 2)]]
    clustered = clustering.pixel_list(spark.createDataFrame(hits, HIT))
    ini = sinks.write_clusters(clustering.nested(clustered), str(tmp_path), "run")
    back = sources.clusters(spark, ini)
    assert back.count() == 4 and {r["hit_count"] for r in back.collect()} == {1, 2}
    again = back.selectExpr("cluster_no as cluster_id", "x", "y", "cast(round(toa / 1.5625) as bigint) as tick")
    assert analysis.iou(clustered, again).first()["iou"] == 1


def test_frames(spark):
    hits = spark.createDataFrame([(513, 5, 3, 20), (7, 16_390, 0, 1), (65_535, 40_000, 15, 1023)], "linear_coord int, toa long, fast_toa int, tot int")
    out = sources.decode_frames(sources.encode_frames(hits, ["toa"]), block=2).orderBy("toa").drop("frame_no")
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in hits.collect()]
    frame = (4 << 44) | (513 << 28) | (5 << 14) | (20 << 4) | 3
    data = spark.createDataFrame([(0, struct.pack("<Q", frame)[:6] * 2)], "datagram_no long, payload binary")
    assert [r["frame"] for r in sources.split_datagrams(data).collect()] == [frame, frame]
    word = spark.createDataFrame([(0x00_12_34,)], "w long").select(sources.chip_id(F.col("w"))).first()[0]
    assert word == "D3-W00018"


def test_raw_text_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([(513, 5, 3, 20), (7, 900, 0, 1)], "linear_coord int, toa long, fast_toa int, tot int")
    sinks.write_raw(raw, str(tmp_path / "raw"))
    assert sorted(map(tuple, sources.text_hits(spark, str(tmp_path / "raw")).collect())) == sorted(map(tuple, raw.collect()))


def test_lanes_and_unions(spark, tmp_path):
    df = spark.createDataFrame([(t, 5, 5, 1.0) for t in (0, 200_000, 700_000)], HIT)
    slices.write_lanes(slices.slice_of(df, 4), str(tmp_path / "lanes"))
    back = spark.read.parquet(str(tmp_path / "lanes"))
    assert {r["tick"]: r["lane"] for r in back.collect()} == {0: 0, 200_000: 1, 700_000: 0}
    both = slices.time_union([df.filter("tick > 0"), df.filter("tick = 0")], ["tick"])
    assert [r["tick"] for r in both.collect()] == [0, 200_000, 700_000]
    assert cluster_slices(df, 128).select("cluster_id").distinct().count() == 3


def test_log_values_and_discarded(spark):
    lines = spark.createDataFrame([("rate 10 x",), ("rate 20",), ("other 5",)], "value string")
    row = analysis.log_values(lines, r"rate (\d+)").first()
    assert (row["mean"], row["n"]) == (15.0, 2)
    df = spark.createDataFrame([(t, 5, 5, 1.0) for t in range(4)], HIT)
    assert triggers.discarded_share(df, df.filter("tick < 1")).first()["discarded"] == 0.75


def test_udp_stream(spark, tmp_path):
    """Datagrams sent to the source arrive as rows."""
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as probe:
        probe.bind(("127.0.0.1", 0))
        port = probe.getsockname()[1]
    spark.dataSource.register(streaming.UdpDatagrams)
    read = spark.readStream.format("hit_udp").option("port", port).load()
    q = read.writeStream.format("memory").queryName("datagrams").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for _ in range(300):
                s.sendto(b"\1" * 12, ("127.0.0.1", port))
                time.sleep(0.05)
                if spark.table("datagrams").count() >= 3:
                    break
        assert spark.table("datagrams").count() >= 3
    finally:
        q.stop()


def test_settings():
    s = Settings.parse(["", "clustering", "-tile_size:4", "-max_dt:100", "reader", "-split:false"])
    assert s.get("clustering", "tile_size") == 4 and s.get("clustering", "max_dt") == 100.0 and s.get("reader", "split") is False
    with pytest.raises(ValueError):
        Settings.parse(["-tile_size:4"])


def test_graph(spark):
    g = Graph.parse(recipe("temporal", "single_layer", 3, "cp"))
    assert set(g.collapsed().edges) == {("r1", "bm1"), ("bm1", "tc1"), ("tc1", "m1"), ("m1", "co1"), ("co1", "cp1")}
    raw = spark.createDataFrame([(513, 5, 3, 20), (514, 6, 3, 20), (7, 900, 0, 1)], "linear_coord int, toa long, fast_toa int, tot int")
    out = build(g, Context(spark, Settings(), {"r1": raw}))["cp1"]
    assert sorted(r["hit_count"] for r in out.collect()) == [1, 2]
    for merge in ("none", "simple", "tree", "multioutput"):
        assert Graph.parse(recipe("standard", merge, 4, "p")).order()[-1].startswith("p")
    with pytest.raises(ValueError):
        Graph.parse("r1->s1")
    with pytest.raises(ValueError):
        Graph.parse("s1m1,m1s1").order()
    two = build(Graph.parse("r1cv1,r2cv1"), Context(spark, Settings(), {f"r{i}": clustering.pixel_list(spark.createDataFrame([(1, 2, 3, 1.0)], HIT)) for i in (1, 2)}))
    assert two["cv1"].first()["iou"] == 1


def test_command_line(spark, tmp_path):
    (tmp_path / "in.txt").write_text("513 5 3 20\n514 6 3 20\n7 900 0 1\n")
    ini = cli.main(["--output", f"{tmp_path}/", str(tmp_path / "in.txt")], spark)
    assert sources.clusters(spark, ini).count() == 3
    assert float(cli.main(["--mode", "compare", ini, ini], spark)) == 1
    assert "Mhit/s" in cli.main(["--mode", "benchmark", str(tmp_path / "in.txt")], spark)
    lanes = cli.main(["--merge_type", "multioutput", "--n_workers", "3", "--output", f"{tmp_path}/lanes/", str(tmp_path / "in.txt")], spark).split(",")
    n = sources.clusters(spark, ini).select("cluster_no").distinct().count()
    assert len(lanes) == 3 and sum(sources.clusters(spark, p).select("cluster_no").distinct().count() for p in lanes) == n
    lines = cli.main(["--mode", "window_features", "--output", f"{tmp_path}/", str(tmp_path / "in.txt")], spark)
    assert spark.read.text(lines).count() == 0  # the only window is still open


def test_sliced_plan(spark, tmp_path):
    """Hits that never pause for 200 ns, in separate spots: slices joined at their borders give the serial kernel's clusters."""
    rng = random.Random(5)
    hits = set()
    for n in range(6000):
        t, x, y = n * 60 + rng.randint(0, 20), (n * 37) % 240 + 4, (n * 101) % 240 + 4
        hits |= {(t + rng.randint(0, 30), x + i, y) for i in range(2)}
    hits = sorted(hits)
    assert max(b[0] - a[0] for a, b in zip(hits, hits[1:], strict=False)) < 128
    df = spark.createDataFrame([(*h, 1.0) for h in hits], HIT)
    t, x, y = (np.array(c) for c in zip(*hits, strict=True))
    label = np.array(kernels.pixel_list(t, x, y))
    first = {}
    for h, c in zip(hits, label.tolist(), strict=True):
        first[c] = min(first.get(c, 1 << 62), h[0] * 65536 + h[2] * 256 + h[1])
    got = {(r["tick"], r["x"], r["y"]): r["cluster_id"] for r in cluster_slices(df, 128).collect()}
    assert got == {h: first[c] for h, c in zip(hits, label.tolist(), strict=True)}
    assert len({t // 163_840 for t, _, _ in hits}) > 2
    (tmp_path / "in.txt").write_text("513 5 3 20\n514 6 3 20\n7 900 0 1\n")
    ini = cli.main(["--sliced", "--output", f"{tmp_path}/", str(tmp_path / "in.txt")], spark)
    assert sources.clusters(spark, ini).count() == 3


def run_stream(spark, hits, tmp_path, plan, name):
    """Feeds hits file by file, in order, and returns what the stream emits."""
    folder = tmp_path / "in"
    for i, part in enumerate([hits[:40], hits[40:80], hits[80:], [(10**9, 1, 1, 0.0)], [(2 * 10**9, 1, 1, 0.0)]]):
        spark.createDataFrame(part, HIT).coalesce(1).write.mode("append").parquet(str(folder / f"n={i}"))
    read = spark.readStream.schema("tick long, x int, y int, e double, n int").option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = plan(streaming.with_event_time(read))
    q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return [r for r in spark.table(name).collect()]


def stream_hits(seed):
    rng = random.Random(seed)
    t, out = 0, []
    for _ in range(120):
        t += rng.choice([1, 5, 127, 128, 500])
        out.append((t, rng.randint(1, 5), rng.randint(1, 5), 1.5))
    return out


def test_streaming_sessions(spark, tmp_path):
    hits = stream_hits(1)
    got = run_stream(spark, hits, tmp_path, lambda h: streaming.temporal_clusters(h.withColumn("lane", F.col("n") * 0)), "sessions")
    batch = clustering.temporal(spark.createDataFrame(hits, HIT)).groupBy("cluster_id").agg(F.min("tick").alias("a"), F.count("*").alias("n"))
    assert {(r["first_tick"], r["hit_count"]) for r in got if r["first_tick"] < 10**9} == {(r["a"], r["n"]) for r in batch.collect()}


def test_streaming_windows(spark, tmp_path):
    hits = stream_hits(2)
    got = run_stream(spark, hits, tmp_path, lambda h: streaming.window_counts(h, 1_000_000), "windows")
    assert sum(r["hit_count"] for r in got if r["win"] < 1000) == len(hits)


def test_streaming_pixel_list(spark, tmp_path):
    hits = stream_hits(3)
    got = run_stream(spark, hits, tmp_path, lambda h: streaming.pixel_list_clusters(h.withColumn("lane", F.lit(0))), "pixels")
    batch = clustering.pixel_list(spark.createDataFrame(hits, HIT)).groupBy("cluster_id").agg(F.count("*").alias("n"))
    assert {(r["cluster_id"], r["hit_count"]) for r in got if r["cluster_id"] < 10**9 * 65536} == {(r["cluster_id"], r["n"]) for r in batch.collect()}


def test_late_rows(spark):
    df = spark.createDataFrame([(0, 0), (1, 1_000_000), (2, 680_001), (3, 679_999), (4, 2_000_000)], "no long, tick long")
    assert [r["no"] for r in streaming.late_rows(df, "no", block=2).collect()] == [3]


def test_udp_reader():
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as probe:
        probe.bind(("127.0.0.1", 0))
        port = probe.getsockname()[1]
    reader = streaming.UdpReader("127.0.0.1", port, 10)
    start = reader.initialOffset()
    assert list(reader.read(start)[0]) == []
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for i in range(3):
            s.sendto(bytes([i]) * 6, ("127.0.0.1", port))
    rows, end = reader.read(start)
    assert [b for _, b in rows] == [b"\0" * 6, b"\1" * 6, b"\2" * 6] and end == {"n": 3}
    assert len(list(reader.readBetweenOffsets(start, end))) == 3
    reader.commit(end)
    assert list(reader.readBetweenOffsets(start, end)) == []
    reader.socket.close()


def test_names():
    assert sinks.output_name("a/b.txt", "out/", number=2).startswith("out/clustered_b2_")
    assert sinks.output_name("a/b.txt", "out/x_", "window_features").startswith("out/x_window_features_b_")


def test_frame_numbers_of_large_datagrams(spark):
    """Frames of a datagram of any size stand before those of the next one."""
    payload = b"".join((4 << 44 | i).to_bytes(6, "little") for i in range(10_922))
    frames = sources.split_datagrams(spark.createDataFrame([(0, payload), (1, payload[:12])], "datagram_no long, payload binary"))
    numbers = sorted(r["frame_no"] for r in frames.collect())
    assert len(set(numbers)) == 10_924 and numbers[10_921] < 1 << 14 <= numbers[10_922]


def test_uncalibrated_pixels_stay(spark):
    hits = preprocess.decode(spark.createDataFrame([(513, 5, 3, 20), (7, 900, 0, 1)], "linear_coord int, toa long, fast_toa int, tot int"))
    calib = spark.createDataFrame([(1, 2, 1.6, 20.0, 100.0, 1.0)], "x int, y int, a double, b double, c double, t double")
    out = {(r["x"], r["y"]): r["e"] for r in preprocess.calibrate(hits, calib).collect()}
    assert len(out) == 2 and out[7, 0] == 0.1 and out[1, 2] >= 0.1


def test_median_of_a_long_history(spark):
    """A history over several blocks gives what a single block gives."""
    from hitweave.operators import windows

    rows = spark.range(60).select(F.col("id").alias("win"), *(((F.col("id") * 7919 + i) % 101).cast("double").alias(c) for i, c in enumerate(windows.SCALARS)))
    got, want = (windows.median_difference(rows, 21, block=b).orderBy("win").collect() for b in (4, 4096))
    assert list(map(repr, got)) == list(map(repr, want))  # NaN equals itself here


def test_nothing_stays_cached(spark):
    hits = spark.createDataFrame([(t * 40, t % 5, 1, 1.0) for t in range(100)], "tick long, x int, y int, e double")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    clustering.pixel_list(hits).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
