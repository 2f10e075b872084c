import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import check, duck
from conftest import SF

from framelens.plans import registry

QUICK = [
    "top_receiver", "lookback_frames", "anchor_windows", "rtp_frame_sizes", "kfold_split",
    "payload_type_ecdf", "dump_labels", "micro_mae",
]


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_registry_is_consistent():
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert len(queries) >= 60 and set(sqls) <= set(queries)
    # The text queries are listed and tested in tests/llm.
    without = set(registry.QUERIES) - set(registry.SQL)
    assert set(registry.QUERIES) <= set(queries) and without == {
        "ip_udp_ml_frame_rate", "rtp_ml_bitrate", "ip_udp_ml_resolution",
        "top_feature_importances", "window_size_sweep",
    }


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, name):
    line = check(spark, duck(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert line.startswith("OK"), line


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_packet_window_runs_over_a_whole_trace(spark):
    """Windows by trace alone may only see one row per chunk; packet windows name the chunk."""
    from framelens.operators.heuristics import ip_udp_heuristic
    from framelens.sources import sample_view as view

    text = plan(ip_udp_heuristic(view.packets(spark, SF, 30_000_000)))
    for line in re.findall(r"Window \[.*", text):
        if "lag(" in line or "row_number" in line:
            assert re.search(r"windowspecdefinition\(trace_id#\d+L, chunk#\d+L", line), line


def test_scans_are_pruned_and_python_stays_out_of_heuristics(spark):
    from framelens.operators.heuristics import ip_udp_heuristic
    from framelens.sources import sample_view as view

    text = plan(ip_udp_heuristic(view.packets(spark, SF, 30_000_000)))
    assert "props" not in text and "event_type" not in text
    assert "Python" not in text and "InPandas" not in text


def test_filters_reach_stored_packets(spark, tmp_path):
    from pyspark.sql import functions as F

    from framelens.operators.heuristics import ip_udp_heuristic
    from framelens.sources import packets as store
    from framelens.sources import sample_view as view

    pk = view.packets(spark, SF, 30_000_000).withColumn("dataset", F.lit("d"))
    store.write_packets(pk, str(tmp_path / "pk"))
    text = plan(ip_udp_heuristic(spark.read.parquet(str(tmp_path / "pk")).where("vca = 'meet'")))
    assert "GreaterThan(length,306)" in text
    assert "PartitionFilters: [isnotnull(vca" in text
    assert "rtp_ts" not in text


def test_vectors_are_limited_before_the_shuffle(spark):
    from framelens.operators import features
    from framelens.sources import sample_view as view

    kept = features.model_packets(view.packets(spark, SF, 30_000_000))
    text = plan(features.window_features(features.windowed_packets(kept), ("SIZE",)))
    assert "WindowGroupLimit" in text


def test_crowded_stretches_are_cut_by_counts(spark):
    from framelens.operators import chunks

    # A third of all rows in one dense trace, half of them at nearly one time, and a burst at one time.
    calm = spark.range(30_000).selectExpr("1L as trace_id", "id * 20 as t_us", "id as pkt_ord")
    burst = spark.range(30_000).selectExpr("1L as trace_id", "600000 + id as t_us", "id as pkt_ord")
    once = spark.range(50_000).selectExpr("1L as trace_id", "700000L as t_us", "id as pkt_ord")
    thin = spark.range(120_000).selectExpr(
        "2 + id % 400 as trace_id", "id * 1000 as t_us", "id as pkt_ord"
    )
    rows = calm.unionByName(burst).unionByName(once).unionByName(thin)
    cut = chunks.assign_chunks(rows, rows_per_chunk=2_000).persist()
    sizes = cut.groupBy("trace_id", "chunk").count()
    assert cut.count() == 230_000
    assert sizes.where("trace_id = 1").agg({"count": "max"}).first()[0] <= 2_000
    assert sizes.where("trace_id = 1").count() < 600
    assert sizes.where("trace_id = 2").count() == 4, "ordinary traces keep wide chunks"
    assert chunks.longest_trace(cut.where("pkt_ord > 5")) == 110_000
    # Chunks are runs of the trace in time and packet order.
    ends = cut.groupBy("trace_id", "chunk").agg(
        F.min(F.struct("t_us", "pkt_ord")).alias("first"), F.max(F.struct("t_us", "pkt_ord")).alias("last")
    )
    before = F.lag("last").over(Window.partitionBy("trace_id").orderBy("chunk"))
    assert ends.withColumn("before", before).where("before >= first").isEmpty()
    empty = chunks.assign_chunks(rows.limit(0))
    assert empty.isEmpty() and chunks.longest_trace(empty) == 0
    cut.unpersist()


def test_a_burst_on_one_time_gives_the_same_frames(spark):
    from framelens.operators import chunks, frames

    rows = spark.range(500_000).selectExpr(
        "1L as trace_id", "'meet' as vca", "id as pkt_ord", "5L as t_us", "5L as epoch_us",
        "400 + (id * id) % 7 * 3 as length",
    )
    cut = chunks.assign_chunks(rows)
    assert cut.select("chunk").distinct().count() > 3
    ends = [
        frames.assign_frames(p).agg(F.max("frame_num"), F.sum(F.col("frame_num") % 1009)).first()
        for p in (cut, chunks.assign_chunks(rows, span_us=10))
    ]
    assert ends[0] == ends[1]


def test_dense_trace_gives_the_same_result(spark):
    from framelens.operators import chunks, features
    from framelens.sources import sample_view as view

    wide = view.packets(spark, SF, 10**9)
    cut = chunks.assign_chunks(wide.drop("chunk"), rows_per_chunk=50)
    assert cut.select("chunk").distinct().count() > 10
    one, two = (
        sorted(map(str, features.ip_udp_features(p).collect())) for p in (wide, cut)
    )
    assert one == two
