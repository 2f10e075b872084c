"""Plain restatements of the sequential rules, for comparison on small traces."""

from __future__ import annotations


def intervals(times, window):
    """Interval number of each time: a new one once more than ``window`` past its opener."""
    out, opener, number = [], None, 0
    for t in times:
        if opener is None or t - opener > window:
            opener, number = t, number + 1
        out.append(number)
    return out


def right_closed(times, window):
    """As above, but whoever opens an interval still counts in the one before (except the first)."""
    plain = intervals(times, window)
    return [
        n - 1 if i and n != plain[i - 1] else n for i, n in enumerate(plain)
    ]


def end_seconds(times, epochs, window):
    """Per interval: second of the next opener, or of the last packet."""
    plain = intervals(times, window)
    ends = {plain[i] - 1: epochs[i] // 1_000_000 for i in range(1, len(times)) if plain[i] != plain[i - 1]}
    ends[plain[-1]] = epochs[-1] // 1_000_000
    return ends


def frames(sizes, depth, tolerance=2, include_first=False):
    """Frame number of each size under the look-back rule."""
    lowest = 0 if include_first else 1
    number, out = 0, []
    for i, s in enumerate(sizes):
        candidates = [sizes[j] for j in range(max(lowest, i - depth), i)]
        if not any(abs(c - s) <= tolerance for c in candidates):
            number += 1
        out.append(number)
    return out


def header_windows(rows, window):
    """Header features per right-closed interval, from dicts in trace order."""
    import numpy as np

    number = right_closed([r["t_us"] for r in rows], window)
    last_of = {r["rtp_ts"]: i for i, r in enumerate(rows)}
    arrival = {}
    for r in rows:
        arrival[r["rtp_ts"]] = max(arrival.get(r["rtp_ts"], 0), r["t_us"])
    ts0 = min(arrival)
    out = {}
    for n in sorted(set(number)):
        here = [i for i, m in enumerate(number) if m == n]
        role = {k: [i for i in here if rows[i]["p_type"] == p] for k, p in (("v", "98"), ("r", "99"))}
        vid = {rows[i]["rtp_ts"] for i in role["v"]}
        rtx = {rows[i]["rtp_ts"] for i in role["r"]}
        stamps = sorted(vid | rtx)
        buffer = 90 / np.diff(stamps) if len(stamps) > 1 else np.array([0.0])
        lags = [
            (arrival[ts] - arrival[ts0]) / 1e6 - (ts - ts0) / 90000
            for ts in stamps
            if last_of[ts] in here
        ] or [100000.0]
        spans = []
        for ts in stamps:
            at = [i for i in here if rows[i]["rtp_ts"] == ts]
            spans.append(max(at) - min(at))
        out[n] = {
            "vid_ts_unique": len(vid),
            "rtx_ts_unique": len(rtx),
            "common_vid_rtx_ts_unique": len(vid & rtx),
            "union_ts_unique": len(stamps),
            "vid_marker_sum": sum(rows[i]["marker"] for i in role["v"]),
            "rtx_marker_sum": sum(rows[i]["marker"] for i in role["r"]),
            "ooo_seqno_vid": sum(
                1 for i in role["v"] if i and rows[i]["seq"] - rows[i - 1]["seq"] != 1
            ),
            "buffer_time_mean": float(np.mean(buffer)),
            "buffer_time_q1": float(np.percentile(buffer, 25)),
            "rtp_lag_mean": float(np.mean(lags)),
            "rtp_lag_std": float(np.std(lags)),
            "rtp_lag_q3": float(np.percentile(lags, 75)),
            "n_pkt_diff_mean": float(np.mean(spans)),
            "n_pkt_diff_max": float(np.max(spans)),
        }
    return out
