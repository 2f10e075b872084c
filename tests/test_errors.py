import hashlib
import math

import numpy as np
import pytest

from framelens.operators import errors

SCHEMA = "metric string, method string, vca string, trace_id long, ts long, pred double, gt double, loss int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_poisson_cuts():
    cuts = [c / 2**32 for c in errors.poisson_cuts()]
    shares = [math.exp(-1) / math.factorial(k) for k in range(len(cuts))]
    assert cuts == pytest.approx(np.cumsum(shares), abs=1e-9)


def test_bootstrap_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = [
        ("bitrate", "m", "meet", i % 7, i, float(p), float(g), i % 2)
        for i, (p, g) in enumerate(rng.normal(100, 20, (120, 2)))
    ]
    means = {0: [], 1: []}
    for turn in range(1, 101):
        weights = []
        for r in rows:
            place = "|".join(map(str, [*r[:5], turn]))
            number = int(hashlib.md5(place.encode()).hexdigest()[:8], 16)
            # The draw: the smallest k whose cumulated Poisson(1) probability is above the number.
            k, share, total = 0, math.exp(-1), math.exp(-1)
            while number / 2**32 >= total:
                k += 1
                share /= k
                total += share
            weights.append(k)
        for side in means:
            here = [(w, abs(r[5] - r[6])) for w, r in zip(weights, rows) if r[7] == side]
            means[side].append(sum(w * d for w, d in here) / sum(w for w, _ in here))
    got = {r["setting"]: r for r in errors.bootstrap_sensitivity(table(spark, rows), ["loss"]).collect()}
    for side, values in means.items():
        plain = [abs(r[5] - r[6]) for r in rows if r[7] == side]
        assert got[side]["n"] == 60 and got[side]["mae"] == pytest.approx(np.mean(plain))
        assert got[side]["ci_low"] == pytest.approx(np.quantile(values, 0.025))
        assert got[side]["ci_high"] == pytest.approx(np.quantile(values, 0.975))
        assert got[side]["ci_low"] < got[side]["mae"] < got[side]["ci_high"]


def test_bootstrap_draws_once_for_all_parameters(spark):
    """Rounds times seconds are drawn and hashed, however many parameters there are."""
    rows = table(spark, [("bitrate", "m", "meet", i % 3, i, 1.0 * i, 2.0, i % 2) for i in range(40)])
    profile = ["loss", "lat", "th"]
    one = rows.withColumns({"lat": rows.loss, "th": rows.loss})
    found = errors.bootstrap_sensitivity(one, profile)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    at = {k: min(i for i, line in enumerate(plan.splitlines()) if k in line) for k in ("md5(", "Expand")}
    # Plans are printed from the result down to the input.
    assert at["Expand"] < at["md5("]
    got = {tuple(r)[3:] for r in found.collect()}
    assert {g[0] for g in got} == set(profile) and len({g[1:] for g in got}) == 2


def test_accuracy_of_every_frame_metric(spark):
    rows = [(m, "m", "meet", 1, t, float(t), 3.0, 0) for m in (*errors.FRAME_METRICS, "bitrate") for t in range(10)]
    got = {r["metric"]: r["accuracy"] for r in errors.macro_scores(table(spark, rows)).collect()}
    assert got.pop("bitrate") is None
    assert got == {m: pytest.approx(0.5) for m in errors.FRAME_METRICS}


def test_predictions_and_truth_are_described_apart(spark):
    rows = [("bitrate", "m", "meet", 1, t, float(t), 2.0 * t, 0) for t in range(11)]
    got = {r["side"]: r for r in errors.describe_both(table(spark, rows), ["metric"]).collect()}
    assert (got["pred"]["p90"], got["gt"]["p90"], got["gt"]["n"]) == (9, 18, 11)
