"""Units, schemas and settings of hit streams.

Time is kept in whole ticks of 1.5625 ns (``tick = 16 * toa - fast_toa``), so that every gap and
boundary test is exact; nanoseconds are derived at the edge.
"""

from __future__ import annotations

from dataclasses import dataclass, field

TICK_NS = 1.5625
CHIP = 256


def ticks(ns: float) -> int:
    """The number of whole ticks in a span of nanoseconds."""
    return int(ns / TICK_NS)


#: Hits of a gap below this many ticks can be one cluster (200 ns).
JOIN_TICKS = ticks(200)
#: First gap, in ticks, that separates groups of the two-step clustering (30 ns).
SPLIT_TICKS = ticks(30) + 1
SLICE_NS = 256_000
SLICE_TICKS = ticks(SLICE_NS)
WINDOW_TICKS = ticks(2e8)
REORDER_TICKS = ticks(500_000)


@dataclass
class Settings:
    """Node settings with their defaults; ``get`` parses values that come as text."""

    values: dict[str, dict[str, object]] = field(
        default_factory=lambda: {
            "reader": {"split": True, "repetition_count": 300, "repetition_size": 1_000_000, "freq_multiplier": 1.0, "sleep_duration_full_memory": 100},
            "calibrator": {"split": False},
            "sorter": {"split": False},
            "clustering": {"tile_size": 1, "max_dt": 200.0, "type": "standard", "sliced": False},
            "trigger": {"window_size": 2e8, "diff_window_size": 1e9, "trigger_time": 5e8, "trigger_file": "", "split": True, "use_trigger": False},
            "halo_clustering": {"window_size": 1000.0},
            "window_computer": {"window_size": 2e8, "diff_window_size": 0.0},
        }
    )

    def get(self, node: str, key: str):
        return self.values[node][key]

    def set(self, node: str, key: str, text: str) -> None:
        own = self.values.setdefault(node, {})
        now = own.get(key, text)
        if isinstance(now, bool):
            own[key] = text.strip().lower() in ("1", "true")
        elif isinstance(now, int):
            own[key] = int(text)
        elif isinstance(now, float):
            own[key] = float(text)
        else:
            own[key] = text

    @classmethod
    def parse(cls, lines: list[str]) -> Settings:
        """From lines of ``node`` followed by ``-key:value``; blank lines are skipped."""
        out, node = cls(), None
        for number, line in enumerate(lines, 1):
            line = line.strip()
            if not line:
                continue
            if not line.startswith("-"):
                node = line
            elif node is None:
                raise ValueError(f"line {number}: a property before any node")
            else:
                key, found, value = line[1:].partition(":")
                if not found:
                    raise ValueError(f"line {number}: expected -key:value")
                out.set(node, key, value)
        return out
