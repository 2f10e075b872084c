import random

import numpy as np
import pytest

from framelens.operators.ranks import ecdf, positions, quantiles, value_ranks


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [("hot", rng.gauss(0, 1) if rng.random() < 0.8 else 1e12) for _ in range(3000)]
    rows += [("hot", 0.5)] * 500 + [("cold", float(i)) for i in range(7)] + [("cold", None)]
    return spark.createDataFrame(rows, "k string, v double"), rows


def test_quantiles_match_numpy(skewed):
    df, rows = skewed
    probs = {"a": 0.1, "b": 0.25, "c": 0.5, "d": 0.96, "e": 1.0, "z": 0.0}
    got = {r["k"]: r for r in quantiles(df, ["k"], "v", probs).collect()}
    for k in ("hot", "cold"):
        values = [v for kk, v in rows if kk == k and v is not None]
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_ecdf_and_counts(skewed):
    df, rows = skewed
    values = sorted(v for k, v in rows if k == "hot")
    got = {r["v"]: r["cume"] for r in ecdf(df, ["k"], "v").where("k = 'hot'").collect()}
    assert got[0.5] == np.searchsorted(values, 0.5, side="right") / len(values)
    assert max(got.values()) == 1.0


def test_pieces_do_not_change_ranks(skewed):
    df, _ = skewed
    few = value_ranks(df, ["k"], "v", pieces=1).collect()
    many = value_ranks(df, ["k"], "v", pieces=2000).collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, many))


def test_whole_table_and_text_order(spark):
    df = spark.createDataFrame([(w,) for w in "delta alpha charlie bravo".split()], "w string")
    pos = {r["w"]: r["pos"] for r in positions(df, [], "w").collect()}
    assert pos == {"alpha": 0, "bravo": 1, "charlie": 2, "delta": 3}


def test_null_groups_keep_their_rows(spark):
    rows = [(None, 1.0), (None, 2.0), ("a", 1.0), ("a", 1.5), (None, None)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert {(r["k"], r["v"], r["upto"]) for r in value_ranks(df, ["k"], "v").collect()} == {
        (None, 1.0, 1),
        (None, 2.0, 2),
        ("a", 1.0, 1),
        ("a", 1.5, 2),
    }
    assert positions(df.where("v is not null"), ["k"], "v").count() == 4
