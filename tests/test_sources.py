import pytest
from pyspark.sql import functions as F

from framelens.functions import first_payload_type, round_half_even
from framelens.operators import clean
from framelens.operators.heuristics import ip_udp_heuristic
from framelens.sources import catalog, packets, settings, tables

ROW = "0.5,1684231200.5,s,d,17,100,1,2,{n},0x1,9000,7,{p},1"
HEAD = ",".join(packets.CAPTURE_COLUMNS)


@pytest.fixture()
def in_lab(tmp_path):
    root = tmp_path / "in_lab_data"
    for name in ("0516_meet_a", "0516_teams_b", "0516_webex_c"):
        (root / name).mkdir(parents=True)
        lines = [HEAD, ROW.format(n=900, p="98.0"), ROW.format(n=400, p='"98,111"')]
        (root / name / "x.csv").write_text("\n".join(lines) + "\n")
        if "webex" not in name:
            (root / name / "x.json").write_text("{}")
    return str(root)


def test_in_lab_catalog_drops_incomplete(spark, in_lab):
    rows = catalog.trace_catalog(spark, [in_lab]).orderBy("vca").collect()
    assert [r["vca"] for r in rows] == ["meet", "teams"]
    assert rows[0]["csv_path"].endswith("0516_meet_a/x.csv")
    assert rows[0]["json_path"].endswith("0516_meet_a/x.json")


def test_real_world_catalog_links_stems(spark, tmp_path):
    device = tmp_path / "real_world_data" / "dev1"
    device.mkdir(parents=True)
    for stem, both in (("a-meet-1", True), ("a-webex-2", False)):
        (device / f"{stem}.csv").write_text(HEAD)
        if both:
            (device / f"{stem}.json").write_text("{}")
    rows = catalog.trace_catalog(spark, [str(tmp_path / "real_world_data")]).collect()
    assert [(r["dataset"], r["vca"]) for r in rows] == [("real_world_data", "meet")]
    assert catalog.trace_catalog(spark, ["/nowhere/other"]).count() == 0


def test_csv_packets(spark, in_lab):
    pk = packets.read_packets(spark, f"{in_lab}/*/*.csv", "in_lab_data")
    rows = pk.where("vca = 'meet'").orderBy("length").collect()
    assert [(r["length"], r["t_us"], r["epoch_us"]) for r in rows] == [
        (400, 500_000, 1684231200500000),
        (900, 500_000, 1684231200500000),
    ]
    assert {r["p_type"] for r in clean.normal_payload_type(pk).collect()} == {"98"}
    assert ip_udp_heuristic(pk).count() == 3


def test_tsv_packets_without_header(spark, tmp_path):
    body = ROW.format(n=500, p="98").replace(",", "\t")
    bad = body.replace("0.5\t", "x\t", 1)
    (tmp_path / "a-teams-1.csv").write_text(body + "\n" + bad + "\n")
    pk = packets.read_packets(spark, str(tmp_path), "real_world_data", headered=False)
    rows = pk.collect()
    assert len(rows) == 1 and rows[0]["vca"] == "teams" and rows[0]["length"] == 500
    packets.write_packets(pk, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("vca = 'teams'").count() == 1


def test_profile_width_varies(spark):
    names = ["/a/meet-chrome-500_20_50_5_2-1700.csv", "x/teams-chrome-1_2_3_4_5_6_7-1.csv"]
    df = spark.createDataFrame([(n,) for n in names], "csv_path string")
    rows = catalog.with_profile(df).select(catalog.PROFILE).collect()
    assert [tuple(r) for r in rows] == [(500, 20, 50, 5, 2), (1, 2, 3, 4, 5)]


def test_trial_id(spark):
    row = spark.range(1).select(
        catalog.trial_id(*[F.lit(x) for x in ("m", "e", "LSTATS-TSTATS", "d")], F.lit(2)).alias("t")
    )
    assert row.first()["t"] == "m_e_LSTATS-TSTATS_d_cv_2"


def test_small_expressions(spark):
    df = spark.createDataFrame([(None, 2.5), ("102.0", 3.5), ("102,111", -0.5)], "p string, x double")
    rows = df.select(first_payload_type("p").alias("p"), round_half_even("x").alias("x")).collect()
    assert [r["p"] for r in rows] == [None, "102", "102"]
    assert [r["x"] for r in rows] == [2, 4, 0]


def test_payload_settings(spark):
    t = settings.payload_types(spark)
    video = t.where("dataset = 'in_lab_data' and vca = 'meet' and role = 'video'")
    assert sorted(r["p_type"] for r in video.collect()) == ["96", "98"]
    assert t.where("vca = 'webex' and role = 'rtx'").count() == 0
    same = t.where("dataset = 'hashed_in_lab' and vca = 'teams' and role = 'video'").collect()
    assert [r["p_type"] for r in same] == ["102"]


def test_cleaning_and_receiver(make_packets):
    pk = make_packets(
        [
            {"ip_proto": None}, {"ip_proto": "1,17"}, {"ip_proto": "17.0", "ip_dst": "b", "length": 900},
            {"ip_proto": "6", "ip_dst": "a", "length": 5000, "t_us": 3_000_000},
            {"ip_proto": "17", "ip_dst": "b", "length": 306, "t_us": 9_000_000},
        ]
    )
    cleaned = clean.clean_protocol(pk)
    assert sorted(r["ip_proto"] for r in cleaned.collect()) == [6, 17, 17]
    udp = clean.udp_only(cleaned)
    assert {r["ip_dst"] for r in clean.keep_busiest(udp).collect()} == {"b"}
    # Deciding over all clean rows, the TCP-like flow wins and no UDP row is left.
    assert clean.keep_busiest(udp, population=cleaned).count() == 0
    assert clean.video_sized(udp).count() == 1


def test_equal_bytes_take_the_smallest_address(make_packets):
    pk = make_packets([{"ip_dst": "b"}, {"ip_dst": "a", "t_us": 5_000_000}, {"ip_dst": None, "length": 9000}])
    assert [r["ip_dst"] for r in clean.keep_busiest(pk).collect()] == ["a"]


def test_prediction_store_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    cols = "metric string, method string, fold int, vca string, trace_id bigint, pred double"
    one = spark.createDataFrame([("m", "e", 1, "meet", 1, 1.0), ("m", "e", 2, "meet", 2, 2.0)], cols)
    tables.write_predictions(one, path)
    tables.write_predictions(spark.createDataFrame([("m", "e", 1, "meet", 3, 9.0)], cols), path)
    got = tables.read_predictions(spark, path)
    assert sorted((r["fold"], r["trace_id"]) for r in got.collect()) == [(1, 3), (2, 2)]
    assert tables.read_predictions(spark, path, fold=2).count() == 1
    tables.write_results(one, str(tmp_path / "csv"))
    assert tables.read_results(spark, str(tmp_path / "csv"), cols).count() == 2
    folds = spark.createDataFrame([("meet", 1), ("teams", 1), ("meet", 2)], "vca string, fold int")
    assert tables.call_logs(folds, 1).count() == 2 and tables.call_logs(folds, 1, "meet").count() == 1


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    """Spark starts a task a folder otherwise, and each trace has its own."""
    for i in range(100):
        folder = tmp_path / "in_lab_data" / f"0_meet_{i}"
        folder.mkdir(parents=True)
        (folder / "a.csv").write_text("x")
        (folder / "a.json").write_text("{}")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    sc = spark.sparkContext
    sc.setJobGroup("listing", "listing")
    traces = catalog.trace_catalog(spark, [str(tmp_path / "in_lab_data")])
    tracker = sc.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
    tasks = [tracker.getStageInfo(s).numTasks for job in jobs for s in job.stageIds]
    sc.setJobGroup("", "")
    assert len(tasks) >= 2 and max(tasks) <= 4 * sc.defaultParallelism
    assert traces.count() == 100 and spark.conf.get(key) == before
