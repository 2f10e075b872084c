import random

import pytest
from pyspark.sql import functions as F

import loops
from framelens.operators import clean, features
from framelens.operators.windows import assign_windows


def test_statistics(spark):
    df = spark.createDataFrame([(v,) for v in (400, 402, 800, 1200)], "v long")
    row = df.agg(*features.statistics("v", "l")).first()
    assert (row["l_q1"], row["l_q2"], row["l_q3"], row["l_mean"]) == (401.5, 601, 900, 700.5)
    assert row["l_std"] == pytest.approx(331.2110354)
    empty = df.where("v < 0").agg(*features.statistics("v", "l", -1.0)).first()
    assert set(empty) == {-1.0}


def test_retransmissions_and_bursts(make_packets):
    sizes, times = [400, 402, 402, 800], [0, 10_000, 40_000, 85_000]
    pk = make_packets([{"length": s, "t_us": t} for s, t in zip(sizes, times)])
    windowed = features.windowed_packets(pk)
    assert features.retransmission_count(windowed).first()["num_rtx"] == 2
    row = features.window_features(windowed).first()
    assert row["t_burst_count"] == 2 and row["l_num_unique"] == 3
    single = features.windowed_packets(make_packets([{"t_us": 50_000}]))
    assert features.window_features(single).first()["t_burst_count"] == 0


def test_first_iat_is_own_time_and_crosses_windows(make_packets):
    pk = make_packets([{"t_us": 7_000}, {"t_us": 407_000}, {"t_us": 2_000_000}], 100_000)
    rows = features.with_iat(pk).orderBy("t_us").collect()
    assert [r["iat"] for r in rows] == [7.0, 400.0, 1593.0]
    ahead = features.with_next_iat(pk).orderBy("t_us").collect()
    assert [r["next_iat"] for r in ahead] == [0.4, 1.593, None]


def test_vectors_are_padded_and_cut(make_packets):
    pk = make_packets([{"length": 400 + i % 3, "t_us": 100 * i} for i in range(700)])
    row = features.window_features(
        features.windowed_packets(pk), ("SIZE", "IAT", "LSTATS")
    ).first()
    assert len(row["sizes"]) == 600 and row["sizes"][:4] == [400, 401, 402, 400]
    assert row["l_num_pkts"] == 700 and row["iats"][1] == pytest.approx(0.1)
    short = features.window_features(
        features.windowed_packets(make_packets([{"vca": "teams", "length": 500}])), ("SIZE",)
    ).first()
    assert len(short["sizes"]) == 800 and short["sizes"][:2] == [500, 0]
    wide = features.spread(spark_df := features.window_features(
        features.windowed_packets(make_packets([{"length": 500}])), ("SIZE",)), "sizes", "size", 600)
    assert "size_600" in wide.columns and spark_df.count() == 1


def test_unknown_group(make_packets):
    with pytest.raises(ValueError):
        features.window_features(make_packets([{}]), ("NOPE",))


@pytest.mark.parametrize("seed,span", [(1, 200_000), (2, 700_000), (3, 30_000_000)])
def test_header_features_against_loop(make_packets, ptypes, seed, span):
    rng = random.Random(seed)
    rows, t, ts, seq = [], 0, 90_000, 10
    for _ in range(150):
        t += rng.choice([0, 3_000, 20_000, 60_000])
        ts += rng.choice([0, 0, 3000, 6000])
        seq += rng.choice([1, 1, 1, 2])
        rows.append(
            {
                "t_us": t,
                "rtp_ts": ts - rng.choice([0, 0, 0, 9000]),
                "seq": seq,
                "marker": rng.choice([0, 1]),
                "p_type": rng.choice(["98", "98", "99"]),
            }
        )
    pk = clean.with_role(make_packets(rows, span), ptypes).select(*features.RTP_COLUMNS)
    got = {r["interval"]: r for r in features.rtp_features(pk).collect()}
    want = loops.header_windows(rows, 1_000_000)
    assert set(got) == set(want)
    for n, expected in want.items():
        for name, value in expected.items():
            assert got[n][name] == pytest.approx(value, abs=1e-9), (n, name)


def test_compat_span_is_constant(make_packets, ptypes):
    pk = clean.with_role(make_packets([{}, {"t_us": 5}]), ptypes).select(*features.RTP_COLUMNS)
    row = features.rtp_features(pk, compat=True).first()
    assert row["n_pkt_diff_mean"] == -1 and row["rtp_lag_min"] == 0


def test_invariants(make_packets):
    rng = random.Random(3)
    t, rows = 0, []
    for _ in range(300):
        t += rng.randrange(0, 30_000)
        rows.append({"t_us": t, "length": rng.randrange(310, 1200)})
    feats = features.window_features(features.windowed_packets(make_packets(rows, 500_000)))
    assert feats.agg(F.sum("l_num_pkts")).first()[0] == 300
    numbers = sorted(r["interval"] for r in feats.select("interval").collect())
    assert numbers == list(range(1, len(numbers) + 1))


def test_feature_columns_leave_out_keys_and_targets(make_packets):
    feats = features.window_features(features.windowed_packets(make_packets([{}])))
    names = features.feature_columns(feats.withColumn("bitrate", F.lit(1.0)), ["bitrate"])
    assert names[0] == "l_max" and not {"et", "interval", "trace_id", "bitrate"} & set(names)


def test_shared_end_second_multiplies(make_packets, spark):
    # The last packet both opens and ends a window: two windows share their end second.
    pk = make_packets([{"t_us": 0}, {"t_us": 2_050_000}, {"t_us": 3_300_000}])
    feats = features.window_features(features.windowed_packets(pk))
    labels = spark.createDataFrame([(1, 103, 30.0)], "trace_id bigint, ts bigint, bitrate double")
    joined = features.join_labels(feats, labels, ["bitrate"])
    assert joined.count() == 2
    assert assign_windows(pk).where("et = 103").count() == 2
