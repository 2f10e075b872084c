import random

import pytest

from framelens.operators import errors
from framelens.plans.experiment import Experiment
from framelens.sources import tables


@pytest.fixture(scope="module")
def inputs(spark, make_packets):
    rng = random.Random(4)
    rows, labels, ord_ = [], [], 0
    for trace in range(4):
        t = 0
        for second in range(12):
            n = rng.randrange(5, 30)
            for i in range(n):
                t = second * 1_000_000 + i * (1_000_000 // n)
                rows.append(
                    {
                        "trace_id": trace, "t_us": t, "pkt_ord": ord_, "rtp_ts": t * 9 // 100,
                        "length": 500 + 10 * (i % 7), "marker": 1, "seq": ord_,
                    }
                )
                ord_ += 1
            labels.append((trace, 100 + second + 1, float(n), n * 4000.0, 1000.0 / n, 180 if n < 15 else 360))
    return (
        make_packets(rows, 5_000_000),
        spark.createDataFrame(
            labels,
            "trace_id bigint, ts bigint, framesReceivedPerSecond double, bitrate double, "
            "frame_jitter double, frameHeight int",
        ),
        spark.createDataFrame([(i, "meet") for i in range(4)], "trace_id bigint, vca string"),
    )


def test_grid_writes_everything(spark, inputs, ptypes, tmp_path):
    packets, labels, traces = inputs
    exp = Experiment(
        packets, labels, traces, ptypes, str(tmp_path), folds=2,
        metrics=("framesReceivedPerSecond", "frameHeight"),
        methods=("rtp-heuristic", "ip-udp-ml"),
        forest={"trees": 10, "depth": 5},
    )
    found = exp.run().cache()
    done = {(r["metric"], r["method"]) for r in found.select("metric", "method").distinct().collect()}
    assert done == {
        ("framesReceivedPerSecond", "rtp-heuristic"),
        ("framesReceivedPerSecond", "ip-udp-ml"),
        ("frameHeight", "ip-udp-ml"),
    }
    assert found.select("trace_id").distinct().count() == 4
    scores = spark.read.parquet(f"{tmp_path}/importances")
    top = errors.top_importances(scores, 3)
    assert top.where("metric = 'framesReceivedPerSecond'").count() == 3
    log = spark.read.parquet(f"{tmp_path}/run_metrics")
    trial = "framesReceivedPerSecond_ip-udp-ml_LSTATS-TSTATS_dataset_cv_1"
    line = log.where(log.trial == trial).first()
    spread = labels.selectExpr("avg(abs(framesReceivedPerSecond - 17))").first()[0]
    assert line["mae_avg"] < spread, "better than predicting the mean"
    assert log.where("trial like 'frameHeight%' and mae_avg is not null").count() == 0
    from pyspark.ml import PipelineModel

    PipelineModel.load(f"{tmp_path}/models/frameHeight/ip-udp-ml/1/meet")
    assert tables.read_predictions(spark, f"{tmp_path}/predictions", metric="frameHeight").count() > 0


def test_fits_repeat(spark, inputs):
    from framelens.operators import features, learn

    packets, labels, _ = inputs
    rows = features.join_labels(features.ip_udp_features(packets), labels, ["bitrate"]).cache()
    preds = [
        sorted(
            r["pred"]
            for r in learn.predict(
                learn.fit(rows, "bitrate", trees=5, depth=4), rows, "bitrate", "ip-udp-ml"
            ).collect()
        )
        for _ in range(2)
    ]
    assert preds[0] == pytest.approx(preds[1])
    vectors = features.join_labels(
        features.ip_udp_features(packets, groups=("SIZE",)), labels, ["bitrate"]
    )
    assert learn.fit(vectors, "bitrate", trees=2, depth=2) is not None
    assert learn.fit(rows.limit(0), "bitrate") is None
