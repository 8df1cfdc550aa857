"""The gate of the triggered clustering: windows that end with the first hit later than a span, and what their rates let through.

Such windows form a chain, each starting where the one before ended.  The chain is followed in
parallel: a piece of time tells, for every hit at which the chain may enter, the bound with which
it leaves; as chains run together quickly, these tables are short.  Tables of a block of pieces are
composed into one, a pass over the blocks links them, and each piece then lists its own windows.
The states that the windows' rates lead to are found the same way.

Hits of one tick are taken together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.model import WINDOW_TICKS
from hitweave.operators.ordered import BLOCK, cut, last_before, numbered

SPAN = WINDOW_TICKS // 4
PIECE = 64


def passage(ticks: np.ndarray, span: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, bound): a chain whose next window ends after x enters at the first entry above x and leaves with its bound.

    ``ticks``: the distinct, sorted ticks of a piece that begins at ``start``.
    """
    first = np.flatnonzero(ticks <= start + span)
    later = np.searchsorted(ticks, start + span, side="right")
    entry = np.append(first, later) if later < len(ticks) else first
    follow = np.searchsorted(ticks, ticks + span, side="right")
    at = entry.copy()
    while (go := follow[at] < len(ticks)).any():
        at = np.where(go, follow[np.minimum(at, len(ticks) - 1)], at)
    bound = ticks[at] + span
    last = np.append(bound[1:] != bound[:-1], True)  # of entries that leave alike the last one speaks for all
    return ticks[entry[last]], bound[last]


def ends_after(ticks: np.ndarray, span: int, x: int) -> list[int]:
    """The window ends in a piece for a chain that comes in with bound x."""
    out: list[int] = []
    i = int(np.searchsorted(ticks, x, side="right"))
    while i < len(ticks):
        out.append(int(ticks[i]))
        i = int(np.searchsorted(ticks, ticks[i] + span, side="right"))
    return out


def through(entry: np.ndarray, bound: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The bounds with which chains that come in with ``x`` leave a piece of this table."""
    at = np.searchsorted(entry, x, side="right")
    return np.where(at < len(entry), bound[np.minimum(at, len(entry) - 1)], x)


def in_order(tables: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for piece, own in tables.sort_values(["piece", "entry"]).groupby("piece", sort=True):
        yield int(piece), own["entry"].to_numpy("int64"), own["bound"].to_numpy("int64")


def compose(tables: pd.DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """One table for several pieces in a row, for chains that come in with at most ``limit``.

    A chain enters at the first piece, or passes hits that end before the limit and enters at a later one.
    """
    entry = bound = None
    for _, own, left in in_order(tables):
        if entry is None:
            entry, bound = own, left
            continue
        bound = through(own, left, bound)
        if entry[-1] <= limit:
            later = own > entry[-1]
            entry, bound = np.append(entry, own[later]), np.append(bound, left[later])
    last = np.append(bound[1:] != bound[:-1], True)
    return entry[last], bound[last]


def link(tables: pd.DataFrame, x: int) -> pd.DataFrame:
    """The bound with which a chain that starts with ``x`` comes into each piece."""
    out = []
    for piece, entry, bound in in_order(tables):
        out.append((piece, x))
        x = int(through(entry, bound, np.array([x]))[0])
    return pd.DataFrame(out, columns=["piece", "x"]).astype("int64")


def incoming(found: DataFrame, span: int, per_piece: int, per_block: int) -> DataFrame:
    """piece and x, its incoming bound; blocks of pieces are linked first, by one table for each."""
    block = F.floor(F.col("piece") / per_block).alias("block")

    def one(t: pd.DataFrame) -> pd.DataFrame:
        number = int(t["block"].iloc[0])
        entry, bound = compose(t, number * per_block * per_piece * span + span)
        return pd.DataFrame({"piece": number, "entry": entry, "bound": bound})

    def inside(key: tuple, t: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        return link(t, int(top["x"].iloc[0])) if len(t) else pd.DataFrame({"piece": [], "x": []}).astype("int64")

    pieces = found.select(block, "piece", "entry", "bound")
    blocks = pieces.groupBy("block").applyInPandas(one, "piece long, entry long, bound long")
    tops = blocks.groupBy(F.lit(1).alias("all")).applyInPandas(lambda t: link(t, span), "piece long, x long")
    tops = tops.withColumnRenamed("piece", "block")
    return pieces.groupBy("block").cogroup(tops.groupBy("block")).applyInPandas(inside, "piece long, x long")


State = tuple[bool, float, int]
#: Processing or not, the rate seen last (below 0: none yet), the tick of the last change.
START: State = (False, -1.0, 0)


def follow_rates(windows: pd.DataFrame, hold: int, ratio: float = 2.0, state: State = START) -> tuple[pd.DataFrame, State]:
    """end, before, flush, after: whether the window's hits pass anyway, whether its end lets the buffer out, whether later hits pass.

    Also the state it leaves.
    """
    processing, old, fired = state
    out = []
    for end, n, width in windows[["end", "n", "width"]].itertuples(index=False):
        before, flush = processing, False
        if not processing:
            rate = n / width
            if old < 0:
                flush = True
            else:
                flush = (old > 0 and rate / old > ratio) or (rate > 0 and old / rate > ratio)
                fired = int(end) if flush else fired
            old = rate
            processing = flush
        if end - fired > hold:
            processing = False
        out.append((end, before, flush, processing))
    table = pd.DataFrame(out, columns=["end", "before", "flush", "after"]).astype({"end": "int64", "before": bool, "flush": bool, "after": bool})
    return table, _plain((processing, old, fired if processing else 0))


def _plain(state: State) -> State:
    """The tick of the last change matters only while processing."""
    return bool(state[0]), float(state[1]), int(state[2]) if state[0] else 0


def possible(tail: pd.DataFrame, hold: int) -> list[State]:
    """The states in which the windows of ``tail``, the last ones so far, can leave the chain.

    The window looked at last decides: it is the very last one, or changed the state at most
    ``hold`` before the very last but one, through which the state then held.
    """
    end = tail["end"].to_numpy("int64")
    rate = (tail["n"] / tail["width"]).to_numpy()
    out = [(False, rate[-1], 0)]
    for j in range(len(end)):
        if j == len(end) - 1 or end[-2] - end[j] <= hold:
            out.append((bool(end[-1] - end[j] <= hold), rate[j], end[j]))
    if end[-1] <= hold:  # since the start, whose first window counts as a change at 0
        out.append((True, rate[0], 0))
    elif len(end) > 1 and end[-2] <= hold:
        out.append((False, rate[0], 0))
    return list(dict.fromkeys(_plain(s) for s in out))


def _pieces(ticks: DataFrame, run, schema: str) -> DataFrame:
    """``run(piece, ticks, x)`` on each piece's ticks, which come sorted; many pieces in a task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def done(parts: list[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
            for piece, own in pd.concat(parts).groupby("piece") if parts else ():
                out = run(int(piece), own["tick"].to_numpy(), int(own["x"].iloc[0]))
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

        for batch in batches:
            part = batch.to_pandas()
            if len(part) and held and held[-1]["piece"].iloc[-1] != part["piece"].iloc[-1]:
                last = part["piece"].iloc[-1]
                yield from done([*held, part[part["piece"] != last]])
                held = [part[part["piece"] == last]]
            elif len(part):
                held.append(part)
        yield from done(held)

    return ticks.repartition(F.col("piece")).sortWithinPartitions("piece", "tick").mapInArrow(each, schema)


def rate_windows(hits: DataFrame, span: int = SPAN, per_piece: int = PIECE, per_block: int = BLOCK) -> DataFrame:
    """``hits`` with column end: the tick of the hit that ends their window; null after the last one."""
    size = span * per_piece
    piece = F.floor(F.col("tick") / size)
    ticks = hits.select(piece.alias("piece"), "tick").distinct()

    def tables(p: int, own: np.ndarray, _: int) -> pd.DataFrame:
        entry, bound = passage(own, span, p * size)
        return pd.DataFrame({"piece": p, "entry": entry, "bound": bound})

    def list_ends(p: int, own: np.ndarray, x: int) -> pd.DataFrame:
        return pd.DataFrame({"piece": p, "end": np.array(ends_after(own, span, x), dtype="int64")})

    found = cut(_pieces(ticks.withColumn("x", F.lit(0).cast("long")), tables, "piece long, entry long, bound long"))
    ends = _pieces(ticks.join(incoming(found, span, per_piece, per_block), "piece"), list_ends, "piece long, end long")
    # An end serves the hits of its own block and of the one before: within a block of one span there is at most one end.
    ends = ends.select(F.col("end").alias("own"), F.floor(F.col("end") / span).alias("block"))
    rows = hits.withColumn("block", F.floor(F.col("tick") / span))
    blocks = cut(rows.select("block").distinct().join(ends, "block", "full"))
    # The next block with an end is the last one before in the order of falling numbers.
    blocks = last_before(blocks.withColumn("back", -F.col("block")), "back", "own").select("block", "own", F.col("own_before").alias("next"))
    rows = rows.join(blocks, "block")
    return rows.withColumn("end", F.when(F.col("tick") <= F.col("own"), F.col("own")).otherwise(F.col("next"))).drop("block", "own", "next")


def rate_states(windowed: DataFrame, span: int = SPAN, hold: int = 2 * SPAN, ratio: float = 2.0, per_block: int = BLOCK) -> DataFrame:
    """end, before, flush and after of every window; a window's first hit is also the last of the one before.

    Blocks of windows are followed from every state they can be entered in, which are few; the
    blocks are linked by these tables, and each is followed once more from its true state.
    """
    reach = hold // span + 3  # ends are over ``span`` apart: so many windows decide the states possible
    per_block = max(per_block, reach)
    sizes = cut(windowed.filter("end is not null").groupBy("end").agg(F.count("*").alias("n")))
    sizes = last_before(sizes.withColumn("key", F.floor(F.col("end") / span)), "key", "end")
    sizes = sizes.withColumn("start", F.coalesce("end_before", F.lit(0))).withColumn("n", F.col("n") + (F.col("start") > 0).cast("long"))
    sizes = numbered(sizes, ["end"], F.floor(F.col("key") / BLOCK))
    at = F.col("row_no") - 1
    rows = sizes.select(F.floor(at / per_block).alias("block"), "end", F.col("n").cast("double").alias("n"), (F.col("end") - F.col("start")).cast("double").alias("width"), (at % per_block).alias("place"))
    rows = cut(rows)
    tail = rows.filter(F.col("place") >= per_block - reach).withColumn("block", F.col("block") + 1).withColumn("own", F.lit(False))
    rows = rows.withColumn("own", F.lit(True)).unionByName(tail)

    def exits(t: pd.DataFrame) -> pd.DataFrame:
        t, block = t.sort_values("end"), int(t["block"].iloc[0])
        own, before = t[t["own"]], t[~t["own"]]
        out = [(block, *s, *follow_rates(own, hold, ratio, s)[1]) for s in (possible(before, hold) if block else [START])]
        return pd.DataFrame(out, columns=["block", "p", "old", "fired", "p2", "old2", "fired2"])

    def entries(t: pd.DataFrame) -> pd.DataFrame:
        state, out = START, []
        for block, own in t.groupby("block", sort=True):
            out.append((block, *state))
            ways = {(bool(p), old, int(f)): (bool(p2), old2, int(f2)) for _, p, old, f, p2, old2, f2 in own.itertuples(index=False)}
            if state in ways:  # only the tail of the last block, without windows of its own, has none
                state = ways[state]
        return pd.DataFrame(out, columns=["block", "p", "old", "fired"])

    def final(key: tuple, t: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        own = t[t["own"]].sort_values("end") if len(t) else t
        state = _plain(tuple(entry[["p", "old", "fired"]].iloc[0])) if len(entry) else START
        return follow_rates(own, hold, ratio, state)[0]

    ways = rows.groupBy("block").applyInPandas(exits, "block long, p boolean, old double, fired long, p2 boolean, old2 double, fired2 long")
    known = ways.groupBy(F.lit(1).alias("all")).applyInPandas(entries, "block long, p boolean, old double, fired long")
    return cut(rows.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(final, "end long, before boolean, flush boolean, after boolean"))


def triggered_hits(hits: DataFrame, span: int = SPAN, hold: int = 2 * SPAN, ratio: float = 2.0) -> DataFrame:
    """The hits that a change of rate lets through: the last ``span`` before it, and those until ``hold`` after it."""
    windowed = rate_windows(hits, span)
    states = rate_states(windowed, span, hold, ratio)
    # After the last end the state stays as it was left.
    left = states.select(F.max_by("after", "end").alias("left"))  # one row
    rows = windowed.join(states, "end", "left")
    kept = rows.filter(F.col("before") | (F.col("flush") & (F.col("tick") >= F.col("end") - span)))
    rest = rows.filter("end is null").crossJoin(F.broadcast(left)).filter("left")
    return kept.select(hits.columns).unionByName(rest.select(hits.columns))
