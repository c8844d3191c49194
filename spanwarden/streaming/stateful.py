"""Streams: session decisions and incremental text scanning with state for each key."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanwarden.operators import session
from spanwarden.operators.scanners import DEFAULT, chosen, scan_one

OVERLAP, LEAST_STEP = 256, 64
SCAN = "stream_id string, upto long, action string, risk double, n_findings int"


def session_decisions(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """SS-06: the fold of :mod:`spanwarden.operators.session` on a stream; idle sessions are dropped.

    Rows of a micro-batch are sorted by (ts, seq); the stream is taken in the order of its batches.
    """
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = pickle.loads(state.get[0]) if state.exists else session.new_state()
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = []
        for e in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            held, d = session.step(held, e)
            out.append({"session_id": key[0], "seq": e["seq"], **d})
        state.update((pickle.dumps(held),))
        state.setTimeoutDuration(ms)
        yield pd.DataFrame(out)

    return events.groupBy("session_id").applyInPandasWithState(run, session.DECISION, "held binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def feed(held: dict, chunk: str, last: bool, trust: str, scanners, step: int, overlap: int) -> dict | None:
    """SS-01, SS-02, SS-04: adds a chunk; scans from the safe prefix less the overlap once enough is new, or at the end.

    The safe prefix moves on only where the scan allows; what lies before it, less the
    overlap, is let go.
    """
    held["tail"] += chunk
    end = held["start"] + len(held["tail"])
    if not (end - held["scanned"] >= step or last and end > held["scanned"]):
        return None
    found = scan_one(held["tail"], trust, scanners)
    risk = max((f[5] for f in found), default=0.0)
    act = session.decide(risk)
    held["scanned"] = end
    if act == "allow":
        cut = max(0, len(held["tail"]) - overlap)
        held["start"], held["tail"] = held["start"] + cut, held["tail"][cut:]
    return {"upto": end, "action": act, "risk": risk, "n_findings": len(found)}


def incremental_scan(chunks: DataFrame, scanners=DEFAULT, step: int = 1024, overlap: int = OVERLAP, trust: str = "unknown", short_overlap: bool = False) -> DataFrame:
    """Results on streams of (stream_id, seq, chunk, last) as their text grows.

    An overlap below 256 characters may split a pattern and is refused unless asked for (SS-05).
    """
    if overlap < OVERLAP and not short_overlap:
        raise ValueError(f"overlap is below {OVERLAP}")
    names, step = chosen(scanners), max(LEAST_STEP, step)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {"tail": "", "start": 0, "scanned": 0}
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").to_dict("records"):
            if (d := feed(held, r["chunk"] or "", bool(r["last"]), trust, names, step, overlap)) is not None:
                out.append({"stream_id": key[0], **d})
        state.update((pickle.dumps(held),))
        yield pd.DataFrame(out, columns=["stream_id", "upto", "action", "risk", "n_findings"])

    return chunks.groupBy("stream_id").applyInPandasWithState(run, SCAN, "held binary", "append", GroupStateTimeout.NoTimeout)
