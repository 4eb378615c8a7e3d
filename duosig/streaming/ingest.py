"""Collapsing events as they arrive: each read's open run is state, closed by the next key or by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ["t_id", "pos", "kmer"]
OPEN = "t_id string, pos long, kmer string, n long, k double, km double, kss double, kmm double, duration double, mean double, std double, row_no long"
RUN = "r_id string, t_id string, pos long, kmer string, n long, mean double, std double, duration double, row_no long"
#: The store that keeps state of this kind.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _part(rows: pd.DataFrame) -> dict:
    """Adjacent rows with one key, as a run: sums, and the first row's own values."""
    k, m, s = (np.nan_to_num(rows[c].to_numpy(float)) for c in ("points", "mean", "std"))
    first = rows.iloc[0]
    sums = {"n": len(rows), "k": k.sum(), "km": (k * m).sum(), "kss": (k * s * s).sum(), "kmm": (k * m * m).sum(), "duration": rows["duration"].sum()}
    return {c: first[c] for c in KEY} | sums | {"mean": first["mean"], "std": first["std"], "row_no": int(first["row_no"])}


def _joined(one: dict, two: dict) -> dict:
    return one | {c: one[c] + two[c] for c in ("n", "k", "km", "kss", "kmm", "duration")}


def _closed(read: str, runs: list[dict]) -> pd.DataFrame:
    out = []
    for r in runs:
        mean, std = r["mean"], r["std"]
        if r["n"] > 1:
            mean = r["km"] / r["k"] if r["k"] else None
            std = np.sqrt(max(r["kss"] / r["k"] + r["kmm"] / r["k"] - mean * mean, 0.0)) if r["k"] else None
        out.append({"r_id": read, **{c: r[c] for c in KEY}, "n": r["n"], "mean": mean, "std": std, "duration": r["duration"], "row_no": r["row_no"]})
    return pd.DataFrame(out, columns=["r_id", *KEY, "n", "mean", "std", "duration", "row_no"])


class RunCollapse(StatefulProcessor):
    """The open run of one read. Rows of a batch are taken in order of row_no."""

    def __init__(self, late_ms: int):
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(rows, ignore_index=True).sort_values("row_no", ignore_index=True)
        names = [c for c in OPEN.replace(",", "").split()[::2]]
        held = dict(zip(names, self.open.get(), strict=True)) if self.open.exists() else None
        same = (every[KEY].eq(every[KEY].shift()) | (every[KEY].isna() & every[KEY].shift().isna())).all(axis=1)
        same.iloc[0] = False
        runs = [_part(part) for _, part in every.groupby((~same).cumsum())]
        if held is not None:
            runs = [_joined(held, runs[0]), *runs[1:]] if all(held[c] == runs[0][c] for c in KEY) else [held, *runs]
        last = runs[-1]
        self.open.update(tuple(None if isinstance(last[c], float) and last[c] != last[c] else (last[c].item() if hasattr(last[c], "item") else last[c]) for c in names))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        latest = every["at_ms"].max() if "at_ms" in every else timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(int(latest) + self.late_ms)
        yield _closed(key[0], runs[:-1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = [c for c in OPEN.replace(",", "").split()[::2]]
        if self.open.exists():
            held = dict(zip(names, self.open.get(), strict=True))
            self.open.clear()
            yield _closed(key[0], [held])

    def close(self) -> None:
        pass


def collapse_stream(events: DataFrame, time: str | None = "ts", late: str = "10 minutes", late_ms: int = 600_000) -> DataFrame:
    """Runs of adjacent events of each read: r_id, t_id, pos, kmer, n, mean, std (pooled), duration, row_no of the first.

    The result is that of the batch collapse, however the events are cut into micro-batches, as long as a read's events come in order of row_no from batch to
    batch. A run goes out once its read has an event of another key. A read's last run goes out late_ms after its latest event: by column time, whose
    watermark is `late` and beyond which rows are left out, or, without one, by the clock. Keys may be null, and null keys are equal.
    A missing value counts as zero where events are pooled. Events without points weigh one each, and without row_no they are in order of time; t_id and std may
    be left out. State is one run for each read that is open; the session's state store is set to PROVIDER, which such state needs.
    """
    if not time and "row_no" not in events.columns:
        raise KeyError("row_no is needed where there is no time")
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = events.withWatermark(time, late).withColumn("at_ms", F.unix_millis(time)) if time else events
    more = ["at_ms", time] if time else []
    given = {"r_id": F.lit(None), "t_id": F.lit(None), "kmer": F.lit(None), "points": F.lit(1), "std": F.lit(None), "row_no": F.col("at_ms") if time else None}
    kinds = {"r_id": "string", "t_id": "string", "kmer": "string", "pos": "long", "points": "long", "mean": "double", "std": "double", "duration": "double", "row_no": "long"}
    rows = timed.select(*[(F.col(c) if c in events.columns else given[c]).cast(t).alias(c) for c, t in kinds.items()], *more)
    return rows.groupBy("r_id").transformWithStateInPandas(RunCollapse(late_ms), RUN, "Append", "EventTime" if time else "ProcessingTime")
