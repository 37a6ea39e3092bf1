"""Slow consumers that fall back on the store: LIVE -> DRAINING -> CATCHING_UP -> LIVE, as a fold over control samples.

A file stream never drops rows, so nothing has to be offloaded here; the state machine is kept for queries that explain
what such a consumer did."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

OUT = "consumer string, ts timestamp_ntz, event string, state string, behind long"


def offload_steps(samples: list[tuple], fullness: float, lag: int, debounce_us: int, near: int) -> list[tuple]:
    """(time, event, state, behind) lifecycle events from (time_us, fullness, lag) samples in order.

    LIVE turns DRAINING when a sample lies over a limit for longer than the debounce; DRAINING turns CATCHING_UP at the
    next sample whose channel is empty; CATCHING_UP turns LIVE once the lag is `near` or less."""
    state, since, out = "LIVE", None, []
    for at, full, behind in samples:
        over = full > fullness or behind > lag
        if state == "LIVE":
            since = (at if since is None else since) if over else None
            if since is not None and at - since > debounce_us:
                state, since = "DRAINING", None
                out.append((at, "lag_detected", state, behind))
        elif state == "DRAINING" and full == 0:
            state = "CATCHING_UP"
            out.append((at, "drained", state, behind))
        elif state == "CATCHING_UP" and behind <= near:
            state = "LIVE"
            out.append((at, "caught_up", state, behind))
    return out


def offload_events(samples: DataFrame, fullness: float = 0.8, lag: int = 10_000, debounce_us: int = 2_000_000, near: int = 100) -> DataFrame:
    """Lifecycle events of all consumers from samples (consumer, ts, fullness, lag); one task holds one consumer's samples."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        us = pdf["ts"].astype("datetime64[us]").astype("int64")
        steps = offload_steps(list(zip(us, pdf["fullness"], pdf["lag"], strict=True)), fullness, lag, debounce_us, near)
        rows = [(pdf["consumer"].iloc[0], pd.Timestamp(at, unit="us"), e, s, int(b)) for at, e, s, b in steps]
        return pd.DataFrame(rows, columns=["consumer", "ts", "event", "state", "behind"])

    return samples.select("consumer", "ts", "fullness", "lag").groupBy("consumer").applyInPandas(fold, OUT)
