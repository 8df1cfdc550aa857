"""Plans as graphs of named nodes.

An architecture string lists edges ``<kind><number><kind><number>``, comma-separated, such as
``r1bm1,bm1s1,s1sc1``.  Numbers tell nodes of one kind apart; parallel lanes that only divide the
work collapse into one DataFrame, as Spark divides it by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from hitweave import sources
from hitweave.model import Settings, ticks
from hitweave.operators import analysis, clustering, preprocess, rates, slices, triggers, windows

EDGE = re.compile(r"([a-z]+)(\d+)([a-z]+)(\d+)")


@dataclass
class Graph:
    edges: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Graph:
        out = cls()
        for part in filter(None, text.replace(" ", "").split(",")):
            m = EDGE.fullmatch(part)
            if not m:
                raise ValueError(f"{part}: expected two nodes, as in r1bm1")
            out.edges.append((m[1] + m[2], m[3] + m[4]))
        return out

    def kinds(self) -> list[tuple[str, str]]:
        """Edges between kinds of nodes, without lanes, each once."""
        return list(dict.fromkeys((re.sub(r"\d", "", a), re.sub(r"\d", "", b)) for a, b in self.edges))

    def collapsed(self) -> Graph:
        """Lanes joined: readers keep their numbers, as they have sources of their own."""
        name = lambda n: n if n.startswith("r") else re.sub(r"\d", "", n) + "1"
        return Graph(list(dict.fromkeys((name(a), name(b)) for a, b in self.edges if name(a) != name(b))))

    def order(self) -> list[str]:
        """Nodes, each after all that feed it."""
        nodes = list(dict.fromkeys(n for e in self.edges for n in e))
        done: list[str] = []
        while len(done) < len(nodes):
            ready = [n for n in nodes if n not in done and all(a in done for a, b in self.edges if b == n)]
            if not ready:
                raise ValueError("the nodes feed one another in a circle")
            done += ready
        return done


Node = Callable[["Context", list[DataFrame]], DataFrame]


@dataclass
class Context:
    spark: SparkSession
    settings: Settings
    inputs: dict[str, DataFrame]
    calibration: DataFrame | None = None


def _one(inputs: list[DataFrame]) -> DataFrame:
    if len(inputs) != 1:
        raise ValueError(f"a node with one input got {len(inputs)}")
    return inputs[0]


def _max_dt(c: Context) -> int:
    return ticks(c.settings.get("clustering", "max_dt"))


def _pixel_list(c: Context, inputs: list[DataFrame]) -> DataFrame:
    """By sessions, exactly; by slices of time joined at their borders where the settings say that sessions never end."""
    if c.settings.get("clustering", "sliced"):
        return cluster_slices(_one(inputs), _max_dt(c))
    return clustering.pixel_list(_one(inputs), _max_dt(c))


def _adapt(c: Context, inputs: list[DataFrame]) -> DataFrame:
    hits = preprocess.decode(preprocess.valid(_one(inputs)))
    return preprocess.uncalibrated(hits) if c.calibration is None else preprocess.calibrate(hits, c.calibration)


def _gate(c: Context, inputs: list[DataFrame]) -> DataFrame:
    """The trigger is an interval table (.ift), a network (.nnt), a classifier (.svmt) or a one-class model (.osvmt); without a file, a rate change."""
    width = ticks(c.settings.get("trigger", "window_size"))
    hits = triggers.gate_windows(_one(inputs), width)
    seen = windows.aggregate(hits.filter("counted"), width)
    path = c.settings.get("trigger", "trigger_file")
    if path.endswith((".nnt", ".svmt", ".osvmt")):
        fired = triggers.fires_model(seen, triggers.read_model(c.spark, path), path.endswith(".osvmt"))
    elif path:
        rows = triggers.parse_intervals("\n".join(r[0] for r in c.spark.read.text(path).collect()))
        fired = seen.withColumn("fires", triggers.fires_interval(rows))
    else:
        fired = seen.withColumn("fires", triggers.fires_frequency())
    states = triggers.activity(fired, ticks(c.settings.get("trigger", "trigger_time")))
    return triggers.gate(hits, states, width).drop("win", "counted")


def _repeat(c: Context, inputs: list[DataFrame]) -> DataFrame:
    """Raw hits with their line; with a frequency factor, the time between temporal clusters is scaled first."""
    size, factor = c.settings.get("reader", "repetition_size"), c.settings.get("reader", "freq_multiplier")
    raw = preprocess.repeat(_one(inputs), c.settings.get("reader", "repetition_count"), size).drop("repetition")
    if factor == 1:
        return raw
    hits = clustering.pixel_list(preprocess.uncalibrated(preprocess.decode(raw)), _max_dt(c))
    return preprocess.scale_frequency(hits, factor).select("line", "linear_coord", "toa", "fast_toa", "tot")


def _windows(c: Context, inputs: list[DataFrame]) -> DataFrame:
    width = ticks(c.settings.get("window_computer", "window_size"))
    out = windows.features(_one(inputs), width)
    diff = ticks(c.settings.get("window_computer", "diff_window_size"))
    return windows.median_difference(out, -(-diff // width)) if diff >= width else out


#: What each kind of node makes of its inputs; every one is lazy.
NODES: dict[str, Node] = {
    "bm": _adapt,
    "s": lambda c, i: preprocess.range_sorted(_one(i)),
    "sc": _pixel_list,
    "tic": lambda c, i: clustering.pixel_list(_one(i), _max_dt(c), c.settings.get("clustering", "tile_size")),
    "ppc": _pixel_list,
    "tc": lambda c, i: clustering.temporal(_one(i), _max_dt(c)),
    "cs": lambda c, i: clustering.two_step(_one(i)),
    "bbc": lambda c, i: clustering.halo_boxes(_one(i), c.settings.get("halo_clustering", "window_size")),
    "ec": lambda c, i: clustering.energy_filtered(clustering.pixel_list(_one(i), _max_dt(c))),
    "trc": lambda c, i: clustering.pixel_list(rates.triggered_hits(_one(i)), _max_dt(c)),
    "tr": _gate,
    "m": lambda c, i: _one(i),  # sessions are exact, and slices come joined: nothing is left to merge
    "co": lambda c, i: _one(i),
    "cow": lambda c, i: _one(i),
    "rr": _repeat,
    "wfc": _windows,
    "wp": lambda c, i: windows.to_lines(_one(i)),
    "cp": lambda c, i: analysis.properties(_one(i)),
    "cv": lambda c, i: analysis.iou(*i),
    "p": lambda c, i: clustering.nested(_one(i)),
}


def build(graph: Graph, context: Context) -> dict[str, DataFrame]:
    """The DataFrame of every node that feeds no other."""
    graph = graph.collapsed()
    made: dict[str, DataFrame] = {}
    for node in graph.order():
        kind = re.sub(r"\d", "", node)
        feeds = [made[a] for a, b in graph.edges if b == node]
        if not feeds:
            if node not in context.inputs:
                raise ValueError(f"{node}: no source of that name")
            made[node] = context.inputs[node]
        elif kind not in NODES:
            raise ValueError(f"{kind}: no such kind of node")
        else:
            made[node] = NODES[kind](context, feeds)
    fed = {a for a, _ in graph.edges}
    return {n: d for n, d in made.items() if n not in fed}


CLUSTERINGS = {"standard": "sc", "tiled": "tic", "temporal": "tc", "temporal_full": "cs", "halo_bb": "bbc"}
MERGES = ("none", "simple", "single_layer", "tree", "multioutput")


def recipe(clustering_type: str = "standard", merge: str = "single_layer", workers: int = 4, sink: str = "", split_at: str = "reader", gated: bool = False) -> str:
    """The architecture string for options: ``workers`` lanes from the split on, joined as ``merge`` says."""
    if clustering_type not in CLUSTERINGS or merge not in MERGES:
        raise ValueError(f"{clustering_type}, {merge}: unknown clustering or merge type")
    own = CLUSTERINGS[clustering_type]
    chain = ["r", "bm", *(["s"] if split_at == "sorter" else []), *(["tr"] if gated else []), own]
    first = {"reader": 1, "calibrator": 2, "sorter": chain.index("s") + 1 if "s" in chain else 2}.get(split_at, 1)
    n = 1 if merge == "none" else workers
    edges = []
    for lane in range(1, n + 1):
        lanes = [1 if i < first else lane for i in range(len(chain))]
        edges += [f"{a}{lanes[i]}{b}{lanes[i + 1]}" for i, (a, b) in enumerate(zip(chain, chain[1:], strict=False))]
    if merge == "simple":
        edges += [f"{own}{i}m1" for i in range(1, n + 1)]
    elif merge in ("single_layer", "multioutput"):
        edges += [f"{own}{i}m{j}" for i in range(1, n + 1) for j in dict.fromkeys((i, i % n + 1))]
        edges += [f"m{i}co1" for i in range(1, n + 1)] if merge == "single_layer" else []
    elif merge == "tree":
        edges += [f"{own}{i}m{(i + 1) // 2}" for i in range(1, n + 1)] + [f"m{i}co1" for i in range(1, (n + 1) // 2 + 1)]
    last = {"none": own, "simple": "m", "multioutput": "m"}.get(merge, "co")
    if sink:
        edges.append(f"{last}1{sink}1")
    return ",".join(dict.fromkeys(edges))


def cluster_slices(hits: DataFrame, max_dt: int) -> DataFrame:
    """The plan for sessions without end: slices, then borders; no task holds more than a slice."""
    return slices.merge_borders(slices.sliced_clusters(hits, max_dt), max_dt).drop("slice")


def text_source(spark: SparkSession, path: str) -> DataFrame:
    return sources.clusters(spark, path) if path.endswith(".ini") else sources.text_hits(spark, path)
