"""Code that runs in Python workers: the state of the streaming scan.

It is sent to the workers with the query, so executors need no copy of this package.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = "ts array<bigint>, close array<double>, volume array<bigint>"
SCORE = (
    "company_id string, n_bars bigint, anchor_ms bigint, latest_close double, latest_return double, "
    "z_score double, volume_ratio double, direction string, status string, flagged boolean"
)


#: Bars of all companies that a task holds before it sends them on.
HELD_ROWS = 1 << 19


def newest_bars(n: int, held_rows: int = HELD_ROWS):
    """Cuts each partition to the newest n bars per company, before any shuffle, whatever its batches are.

    Only the newest n can end up in a company's state, so a hot company sends n rows a task on
    and not all it has. A partition of very many companies is sent on in pieces.
    """
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame])
            ordered = rows.sort_values(["company_id", "ts_ms"], kind="stable")
            held = ordered.drop_duplicates(["company_id", "ts_ms"]).groupby("company_id").tail(n)
            if len(held) > held_rows:
                yield held
                held = None
        if held is not None:
            yield held
    return cut


class NewestBarsScan(StatefulProcessor):
    """State per company: its newest n bars by time. Each batch that touches a company gives
    its score over the state after the batch, as a batch scan of all bars would."""

    def __init__(self, n: int, z: float, vol: float, min_bars: int):
        self.n, self.z, self.vol, self.min_bars = n, z, vol, min_bars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getValueState("bars", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = self.bars.get()
        # stored bars come first: a copy of a stored time stamp is ignored
        seen = {t: (c, v) for t, c, v in zip(*stored)} if stored else {}
        for frame in rows:
            for t, c, v in zip(frame["ts_ms"].tolist(), frame["close"].tolist(), frame["volume"].tolist()):
                seen.setdefault(int(t), (None if pd.isna(c) else float(c), None if pd.isna(v) else int(v)))
        ts = sorted(seen)[-self.n:]
        close, volume = [seen[t][0] for t in ts], [seen[t][1] for t in ts]
        self.bars.update((ts, close, volume))
        if len(ts) >= self.min_bars:
            yield pd.DataFrame([score_row(key[0], ts, close, volume, self.z, self.vol)])

    def close(self) -> None:
        pass


def score_row(company: str, ts: list, close: list, volume: list, z: float, vol: float) -> dict:
    """``score_watchlist`` for one company's bars in time order."""
    row = {
        "company_id": company, "n_bars": len(ts), "anchor_ms": ts[-1], "latest_close": close[-1],
        "latest_return": None, "z_score": None, "volume_ratio": None, "direction": None,
        "status": "bad_data", "flagged": False,
    }
    if None in close or None in volume or 0 in close[:-1]:
        return row
    row["status"] = "ok"
    if len(ts) < 2:
        return row
    c = np.array(close)
    returns = c[1:] / c[:-1] - 1
    spread, mean_volume = returns.std(), float(np.mean(volume))
    score = (returns[-1] - returns.mean()) / spread if spread else 0.0
    ratio = volume[-1] / mean_volume if mean_volume else 0.0
    row.update(
        latest_return=float(returns[-1]), z_score=float(score), volume_ratio=float(ratio),
        direction="up" if returns[-1] > 0 else "down",
        flagged=bool(abs(score) >= z or ratio >= vol),
    )
    return row
