import random

import numpy as np
import pytest

import loops
from framelens.operators import windows
from framelens.operators.windows import assign_windows, chunk_anchors, chunk_steps

GOLDEN = [0, 400_000, 1_000_000, 1_100_000, 2_050_000, 2_200_000, 3_300_000]


def placed(df, closed="left", window=1_000_000):
    rows = assign_windows(df, window, closed).orderBy("t_us", "pkt_ord").collect()
    return [r["interval"] for r in rows], [r["et"] for r in rows]


@pytest.mark.parametrize("span", [300_000, 1_000_000, 10_000_000])
def test_golden_intervals(make_packets, span):
    pk = make_packets([{"t_us": t} for t in GOLDEN], span)
    number, et = placed(pk)
    assert number == [1, 1, 1, 2, 2, 3, 4]
    assert et == [101, 101, 101, 102, 102, 103, 103]


def test_golden_right_closed(make_packets):
    number, et = placed(make_packets([{"t_us": t} for t in GOLDEN], 700_000), "right")
    assert number == [1, 1, 1, 1, 2, 2, 3]
    assert et == [101, 101, 101, 101, 102, 102, 103]


def random_times(rng, n, step):
    t, out = 0, []
    for _ in range(n):
        t += rng.choice([0, 1, step // 3, step, step, 2 * step])
        if rng.random() < 0.02:
            t += 40 * step
        out.append(t)
    return out


@pytest.mark.parametrize(
    "seed,span,window",
    [(1, 150_000, 1_000_000), (2, 400_000, 100_000), (3, 5_000_000, 100_000), (4, 9_000, 1_000_000)],
)
def test_against_loop(make_packets, seed, span, window):
    rng = random.Random(seed)
    traces = {k: random_times(rng, 150, 40_000) for k in (1, 2, 3)}
    rows, ord_ = [], 0
    for k, times in traces.items():
        for t in times:
            rows.append({"trace_id": k, "t_us": t, "pkt_ord": ord_})
            ord_ += 1
    pk = make_packets(rows, span)
    for closed, rule in (("left", loops.intervals), ("right", loops.right_closed)):
        got = {
            (r["trace_id"], r["pkt_ord"]): (r["interval"], r["et"])
            for r in assign_windows(pk, window, closed).collect()
        }
        for k, times in traces.items():
            number = rule(times, window)
            ends = loops.end_seconds(times, [100_000_000 + t for t in times], window)
            mine = [got[(k, r["pkt_ord"])] for r in rows if r["trace_id"] == k]
            assert [m[0] for m in mine] == number
            assert [m[1] for m in mine] == [ends[n] for n in number]


def test_step_function_equals_walk():
    rng = random.Random(5)
    for _ in range(50):
        times = np.unique([rng.randrange(0, 5000) for _ in range(rng.randrange(1, 200))])
        limits, exits = chunk_steps(times, 100)
        for entry in range(-250, 0):
            walk = chunk_anchors(times, entry, 100)
            at = int(np.searchsorted(limits, entry + 100, side="right"))
            if at < len(limits):
                assert exits[at] == times[walk[-1]]
            else:
                assert not walk or times[0] + 100 < entry + 100


def test_chunk_summary_is_short():
    """Paths merge: far fewer steps than packets leave a chunk."""
    rng = np.random.default_rng(0)
    times = np.unique(np.cumsum(rng.integers(1, 4000, 15_000)))
    limits, _ = chunk_steps(times, 1_000_000)
    assert len(limits) < len(times) / 50


def cuts_of(rng, times):
    """Times in neighbouring pieces; a time may lie on both sides of a cut."""
    at = sorted({0, len(times), *(rng.randrange(len(times)) for _ in range(5))})
    return [times[a - (a > 0 and rng.random() < 0.3) : b] for a, b in zip(at, at[1:])]


def test_composed_functions_equal_a_walk():
    rng = random.Random(6)
    for _ in range(60):
        window = rng.choice([1, 30, 100, 2_000, 9_000])
        times = np.unique([rng.randrange(0, 5000) for _ in range(rng.randrange(1, 200))])
        pieces = cuts_of(rng, times)
        functions = [chunk_steps(p, window) for p in pieces]
        limits, exits = windows.composed(functions, window)
        assert (np.diff(limits) > 0).all() and len(limits) <= min(len(times), window + 2)
        for entry in [None, *range(-window - 50, int(times[0]), max(1, window // 40))]:
            walk = chunk_anchors(times, entry, window)
            reach = windows.BEFORE_ALL if entry is None else entry + window
            at = int(np.searchsorted(limits, reach, side="right"))
            assert (int(exits[at]) if at < len(limits) else None) == (int(times[walk[-1]]) if walk else None)
            # What every piece is entered with.
            last, found = entry, windows.entered_with(functions, entry, window)
            for piece, mine in zip(pieces, found):
                assert mine == last
                own = chunk_anchors(piece, last, window)
                last = int(piece[own[-1]]) if own else last


@pytest.mark.parametrize("budget,span,window", [(4, 9_000, 1_000_000), (40, 150_000, 1_000_000), (60, 400_000, 100_000)])
def test_tree_against_loop(make_packets, monkeypatch, budget, span, window):
    monkeypatch.setattr(windows, "STEPS_PER_GROUP", budget)
    monkeypatch.setattr(windows, "FUNCTIONS_PER_GROUP", 4)
    rng = random.Random(budget)
    times = {k: random_times(rng, n, 40_000) for k, n in ((1, 400), (2, 30), (3, 1))}
    rows = [{"trace_id": k, "t_us": t, "pkt_ord": i} for k, ts in times.items() for i, t in enumerate(ts)]
    got = assign_windows(make_packets(rows, span), window).orderBy("trace_id", "pkt_ord").collect()
    for k, ts in times.items():
        assert [r["interval"] for r in got if r["trace_id"] == k] == loops.intervals(ts, window)


def test_groups_of_the_tree_are_bounded(spark):
    """A dense trace with windows far wider than its chunks: all times are steps of some chunk."""
    rows = [(1, c, list(range(c * 50, c * 50 + n)), [0] * n) for c in range(300) for n in (50 if c % 3 else 1,)]
    functions = spark.createDataFrame(rows, "trace_id bigint, chunk bigint, limits array<bigint>, exits array<bigint>")
    budget = 200
    sizes = (
        windows.with_nodes(functions, budget)
        .selectExpr("node", "chunk", "size(limits) as n")
        .groupBy("node")
        .agg({"n": "sum", "chunk": "count"})
        .collect()
    )
    assert len(sizes) > 10 and sum(r["sum(n)"] for r in sizes) == 10_100
    assert max(r["sum(n)"] for r in sizes) <= budget * 3 // 2
