import random

import pytest

import loops
from framelens.operators import frames
from framelens.operators.assembly import sweep_frames

SIZES = [1000, 1001, 500, 501, 1003, 1002, 500]


def numbers(df):
    return [r["frame_num"] for r in df.orderBy("trace_id", "t_us", "pkt_ord").collect()]


def packets_of(make_packets, sizes, span):
    return make_packets([{"length": s, "t_us": 10_000 * i} for i, s in enumerate(sizes)], span)


@pytest.mark.parametrize("span", [10_000, 25_000, 10_000_000])
def test_golden(make_packets, span):
    pk = packets_of(make_packets, SIZES, span)
    assert numbers(frames.assign_frames(pk, 1)) == [1, 2, 3, 3, 4, 4, 5]
    assert numbers(frames.assign_frames(pk, 2)) == [1, 2, 3, 3, 4, 4, 5]
    assert numbers(frames.assign_frames(pk, 3)) == [1, 2, 3, 3, 3, 3, 3]


@pytest.mark.parametrize("seed,span", [(1, 10_000), (2, 35_000), (3, 90_000), (4, 10_000_000)])
def test_against_loop(make_packets, seed, span):
    rng = random.Random(seed)
    sizes = [rng.choice([500, 501, 502, 503, 700, 701, 900]) for _ in range(120)]
    pk = packets_of(make_packets, sizes, span)
    for depth in (1, 2, 3):
        for first in (False, True):
            got = numbers(frames.assign_frames(pk, depth, include_first=first))
            assert got == loops.frames(sizes, depth, include_first=first)
    swept = sweep_frames(pk, range(1, 6)).collect()
    for depth in range(1, 6):
        mine = sorted((r["pkt_ord"], r["frame_num"]) for r in swept if r["depth"] == depth)
        assert [m[1] for m in mine] == loops.frames(sizes, depth)


def test_depth_follows_application(make_packets):
    rows = []
    for k, vca in enumerate(["meet", "teams", "webex"]):
        rows += [
            {"trace_id": k, "vca": vca, "length": s, "t_us": 10_000 * i, "pkt_ord": 100 * k + i}
            for i, s in enumerate(SIZES)
        ]
    got = frames.assign_frames(make_packets(rows, 20_000)).orderBy("trace_id", "pkt_ord").collect()
    by = {v: [r["frame_num"] for r in got if r["vca"] == v] for v in ("meet", "teams", "webex")}
    assert by == {v: loops.frames(SIZES, d) for v, d in (("meet", 3), ("teams", 2), ("webex", 1))}


def frame_table(spark, ends, width):
    rows = [(1, "meet", i + 1, e, e, 1000, 1, e // width) for i, e in enumerate(ends)]
    return spark.createDataFrame(
        rows,
        "trace_id bigint, vca string, frame_num bigint, frame_st bigint, frame_et bigint, "
        "frame_size bigint, n_pkts bigint, chunk bigint",
    )


@pytest.mark.parametrize("width", [50_000, 400_000, 10_000_000])
def test_durations_and_mean(spark, width):
    rng = random.Random(9)
    ends, t = [], 0
    for _ in range(80):
        t += rng.randrange(10_000, 60_000)
        ends.append(t)
    rows = (
        frames.frame_durations(frame_table(spark, ends, width), "frame_num")
        .orderBy("frame_num")
        .collect()
    )
    durs = [0] + [b - a for a, b in zip(ends, ends[1:])]
    assert [r["frame_dur_us"] for r in rows] == durs
    for i, r in enumerate(rows):
        mean = sum(durs[i - 29 : i + 1]) / 30 if i >= 30 else 0
        assert abs(r["avg_frame_dur_us"] - mean) < 1e-6


def test_warm_up_cut_at_first_gap_only(spark):
    ends = [0, 100_000, 8_200_000, 8_300_000, 17_000_000, 17_100_000]
    timed = frames.frame_durations(frame_table(spark, ends, 1_000_000), "frame_num")
    left = sorted(r["frame_num"] for r in frames.drop_warm_up(timed).collect())
    assert left == [4, 5, 6]


def test_freeze_rule(spark):
    df = spark.createDataFrame(
        [(200_000, 0.0), (200_000, 100_000.0), (301_000, 100_000.0)],
        "frame_dur_us bigint, avg_frame_dur_us double",
    )
    assert [r["is_freeze"] for r in frames.with_freezes(df).collect()] == [1, 0, 1]


def test_rtp_frames_need_one_marker(make_packets):
    pk = make_packets(
        [
            {"rtp_ts": 1, "marker": 0, "length": 500},
            {"rtp_ts": 1, "marker": 1, "length": 600, "t_us": 5},
            {"rtp_ts": 2, "marker": 0},
            {"rtp_ts": 3, "marker": 1},
            {"rtp_ts": 3, "marker": 1},
        ]
    )
    rows = frames.rtp_frames(pk).collect()
    assert [(r["rtp_ts"], r["frame_size"], r["n_pkts"]) for r in rows] == [(1, 1100, 2)]


def test_one_frame_second_has_no_jitter(spark):
    timed = frames.frame_durations(frame_table(spark, [100_000], 1_000_000), "frame_num")
    row = frames.per_second(frames.with_freezes(timed)).first()
    assert row["predicted_frame_jitter"] is None and row["ft_end"] == 1


@pytest.mark.parametrize("span", [50_000, 300_000, 30_000_000])
def test_clock_runs_on_over_turns(make_packets, span):
    size = frames.CLOCK_RANGE
    rng = random.Random(span)
    true, t = size - 40_000, 0
    rows = []
    for _ in range(200):
        # Ticks of a third of the range turn the counter many times; some packets are late.
        true += rng.choice([0, 3_000, size // 3])
        t += rng.randrange(1, 40_000)
        rows.append((t, true - rng.choice([0, 0, 0, 90_000])))
    pk = make_packets([{"t_us": t, "rtp_ts": x % size} for t, x in rows], span)
    got = [r["rtp_ts"] for r in frames.unwrap_clock(pk).orderBy("t_us").collect()]
    first = rows[0][1] - rows[0][1] % size
    assert got == [x - first for _, x in rows]


def test_empty_seconds_are_filled(spark):
    df = spark.createDataFrame(
        [(1, "meet", 5, 3, 800, 1.5, 1, 0.2), (1, "meet", 9_000, 2, 80, None, 0, 0.0), (2, "meet", 7, 1, 8, None, 0, 0.0)],
        "trace_id long, vca string, ft_end long, predicted_framesReceivedPerSecond long, predicted_bitrate long, "
        "predicted_frame_jitter double, freeze_count long, freeze_dur double",
    )
    full = {(r["trace_id"], r["ft_end"]): r for r in frames.fill_empty_seconds(df).collect()}
    assert sorted(full) == [(1, s) for s in range(5, 9_001)] + [(2, 7)]
    assert tuple(full[1, 5])[3:] == (3, 800, 1.5, 1, 0.2)
    assert tuple(full[1, 6])[3:] == (0, 0, None, 0, 0.0)
    assert frames.fill_empty_seconds(df.limit(0)).isEmpty()
