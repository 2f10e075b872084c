import json
import random

import pytest
from pyspark.sql import functions as F

from framelens.plans.folder_run import FolderRun
from framelens.sources import dumps, linked
from framelens.sources.packets import CAPTURE_COLUMNS

START = 1_700_000_000
PTYPES = {("in_lab_data", "meet"): "98", ("real_world_data", "teams"): "100"}


def capture(rng, seconds, p_type, separator=","):
    """Ten to thirty packets a second, a frame being two packets; times to the nanosecond."""
    lines, number = [separator.join(CAPTURE_COLUMNS)], 0
    for second in range(seconds):
        n = rng.randrange(10, 30)
        for i in range(n):
            t = second + i / n
            row = [f"{t:.9f}", f"{START + t:.9f}", "s", "d", "17", "920", "1", "2", 400 + 10 * (number // 2 % 9), "0x1", number // 2 * 3000, number, p_type, number % 2]
            lines.append(separator.join(map(str, row)))
            number += 1
    return "\n".join(lines) + "\n"


def dump(rng, seconds, missing=None):
    def stat(values):
        times = {"startTime": f"{_iso(START + 1)}", "endTime": f"{_iso(START + 1 + seconds)}"}
        return {**times, "values": json.dumps(values)}

    stats = {}
    for name in dumps.STATS:
        values = ["VP9"] * seconds if name in dumps.TEXT else [rng.randrange(5, 15) for _ in range(seconds)]
        if name != missing:
            stats[f"IT01V77-{name}"] = stat(values)
    return json.dumps({"PeerConnections": {"1": {"stats": stats}}})


def _iso(second):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(second, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    """Two data sets below a folder with a blank and a plus sign; one trace of each is not usable."""
    top, rng = tmp_path_factory.mktemp("data") / "my data+more", random.Random(8)
    lab, world = top / "in_lab_data", top / "real_world_data"
    for k in range(5):
        folder = lab / f"05 16_meet_run {k}"
        folder.mkdir(parents=True)
        (folder / "pcap %41.csv").write_text(capture(rng, 12, "98"))
        (folder / "internals.json").write_text(dump(rng, 11, "qpSum" if k == 4 else None))
    (lab / "05 16_meet_run 0" / "zz later.csv").write_text(capture(rng, 3, "98"))
    for device in ("dev 1", "dev 2"):
        (world / device).mkdir(parents=True)
        for k in range(3):
            (world / device / f"a-teams-{k}.csv").write_text(capture(rng, 12, "100"))
            if (device, k) != ("dev 2", 2):
                (world / device / f"a-teams-{k}.json").write_text(dump(rng, 11))
    return [str(lab), str(world)]


def test_captures_dumps_and_catalog_share_ids(spark, roots):
    traces = linked.linked_traces(spark, roots)
    ids = {r["trace_id"]: r["vca"] for r in traces.collect()}
    assert len(ids) == 10 and ids["in_lab_data/05 16_meet_run 0/pcap %41"] == "meet"
    assert ids["real_world_data/dev 2/a-teams-1"] == "teams"
    packets = linked.linked_packets(spark, roots, traces)
    assert {r["trace_id"] for r in packets.select("trace_id").distinct().collect()} == set(ids)
    bodies = linked.linked_dumps(spark, roots, traces)
    assert {r["trace_id"] for r in bodies.collect()} == set(ids)
    # A file by another scheme is the same trace.
    again = linked.linked_packets(spark, [f"file://{roots[0]}"], traces)
    assert {r["trace_id"] for r in again.select("trace_id").distinct().collect()} == {i for i in ids if "in_lab" in i}


def test_order_below_the_microsecond(spark, tmp_path):
    folder = tmp_path / "in_lab_data" / "a_meet_b"
    folder.mkdir(parents=True)
    times = ["0.000001499", "0.000001001", "0.000000700", "0.0000012"]
    rows = [",".join([t, "1700000000", "s", "d", "17", "1", "1", "2", str(500 + i), "", "", "", "", ""]) for i, t in enumerate(times)]
    (folder / "x.csv").write_text("\n".join([",".join(CAPTURE_COLUMNS), *rows]) + "\n")
    (folder / "x.json").write_text("{}")
    root = [str(tmp_path / "in_lab_data")]
    got = linked.linked_packets(spark, root, linked.linked_traces(spark, root)).orderBy("t_us", "pkt_ord").collect()
    assert {r["t_us"] for r in got} == {1}
    assert [r["length"] for r in got] == [502, 501, 503, 500]


def modified(folder):
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("part-*")}


def test_run_from_folders(spark, roots, tmp_path):
    options = {
        "metrics": ("framesReceivedPerSecond", "bitrate"),
        "methods": ("ip-udp-heuristic", "ip-udp-ml"),
        "folds": 2,
        "forest": {"trees": 3, "depth": 3},
    }
    run = FolderRun(spark, roots, str(tmp_path), options=options)
    found = run.run()
    counts = {(r["dataset"], r["vca"], r["metric"], r["method"]): r["count"] for r in found.groupBy("dataset", "vca", "metric", "method").count().collect()}
    assert set(counts) == {
        (d, v, m, e)
        for d, v in PTYPES
        for m in options["metrics"]
        for e in options["methods"]
    }
    assert found.where("gt is null or pred is null").isEmpty()
    # The trace without a statistic gives no labels, and says why.
    bad = "in_lab_data/05 16_meet_run 4/pcap %41"
    assert found.where(F.col("trace_id") == bad).isEmpty()
    assert run.verdicts().where(F.col("trace_id") == bad).first()["reason"] == "no labels"
    assert run.dump_status().where(F.col("trace_id") == bad).first()["reason"] == "statistic missing"
    assert found.select("trace_id").distinct().count() == 9
    # A second run finds every stage in place.
    before = modified(tmp_path)
    assert sorted(map(str, FolderRun(spark, roots, str(tmp_path), options=options).run().collect())) == sorted(map(str, found.collect()))
    assert modified(tmp_path) == before
