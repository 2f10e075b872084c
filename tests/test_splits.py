import pytest

from framelens.operators import splits


@pytest.fixture(scope="module")
def traces(spark):
    rows = [
        ("d", "meet", f"t{i:02d}", f"/x/meet-chrome-{100 * (i % 2)}_{i}_5_0_1-17{i:02d}.csv")
        for i in range(13)
    ]
    return spark.createDataFrame(
        rows, "dataset string, vca string, trace_id string, csv_path string"
    )


def test_kfold_is_contiguous(traces):
    folds = [r["fold"] for r in splits.kfold(traces, 5).orderBy("trace_id").collect()]
    assert folds == [1] * 3 + [2] * 3 + [3] * 3 + [4] * 2 + [5] * 2


def test_kfold_with_fewer_traces_than_folds(traces):
    folds = [r["fold"] for r in splits.kfold(traces.limit(3), 5).orderBy("trace_id").collect()]
    assert folds == [1, 2, 3]


def test_random_split_is_exact_and_repeatable(traces):
    one = splits.split_traces(traces, "random", 0.7, seed=3)
    two = splits.split_traces(traces, "random", 0.7, seed=3)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert one.where("split = 'train'").count() == int(0.7 * 13)


def test_network_split_takes_the_first_of_each_profile(spark):
    rows = [
        ("meet", f"t{i}", f"meet-chrome-{100 * (i % 2)}_0_5_0_1_{i}-1700.csv") for i in range(6)
    ]
    df = spark.createDataFrame(rows, "vca string, trace_id string, csv_path string")
    got = {r["trace_id"]: r["split"] for r in splits.split_traces(df, "network-condition", 0.5).collect()}
    assert got == {"t0": "train", "t1": "train", "t2": "test", "t3": "test", "t4": "test", "t5": "test"}


def test_throughput_split_at_the_median(traces):
    got = splits.split_traces(traces, "throughput-std")
    assert got.where("split = 'train'").count() == 7
    with pytest.raises(ValueError):
        splits.split_traces(traces, "other")


def test_held_out_complements(traces):
    train = splits.fold_split(splits.kfold(traces), 1).where("split = 'train'")
    assert splits.held_out(traces, train).count() + train.count() == 13


@pytest.mark.parametrize("criterion", ["random", "network-condition", "throughput-std"])
def test_no_trace_is_lost_without_profile_or_application(spark, traces, criterion):
    odd = spark.createDataFrame(
        [("d", "meet", "u1", "/x/plain.csv"), ("d", None, "u2", "/x/y.csv"), ("d", "solo", "u3", "/x/z.csv")],
        traces.schema,
    )
    rows = traces.unionByName(odd)
    got = splits.split_traces(rows, criterion)
    assert sorted(r["trace_id"] for r in got.collect()) == sorted(r["trace_id"] for r in rows.collect())
    assert splits.kfold(rows, 5).count() == rows.count()
