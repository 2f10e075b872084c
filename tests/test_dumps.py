import json

import pytest

from framelens.operators.validate import validate
from framelens.sources import dumps

START, END = "2023-05-16T10:00:00.500Z", "2023-05-16T10:00:03.200Z"
T0 = 1684231200


def entry(values, start=START, end=END):
    return {"startTime": start, "endTime": end, "values": json.dumps(values)}


def stats(ssrc="7", fps=(20, 21, 22, 23, 24), **changes):
    out = {}
    for name in dumps.STATS:
        values = list(range(5))
        if name == "[codec]":
            values = ["VP9"] * 5
        elif name == "trackIdentifier":
            values = ["a-b"] * 5
        elif name == "framesPerSecond":
            values = list(fps)
        elif name == "framesReceived":
            values = [10, 13, 13, 20, 30]
        out[f"IT01V{ssrc}-{name}"] = entry(values)
    for name, value in changes.items():
        key = f"IT01V{ssrc}-{name}"
        if value is None:
            out.pop(key)
        else:
            out[key] = value
    return out


def dump(*connections):
    return json.dumps({"PeerConnections": {f"c{i}": {"stats": s} for i, s in enumerate(connections)}})


@pytest.fixture(scope="module")
def table(spark):
    quiet = stats("9", fps=(1, 1, 1, 1, 1))
    rows = {
        "valid": dump(stats()),
        "two": dump({**quiet, **stats("8")}),
        "empty_first": dump({}, stats("5")),
        "tie": dump({**stats("4"), **stats("3")}),
        "missing": dump(stats(qpSum=None)),
        "null_value": dump(stats(frameHeight=entry([180, None, 180, 180, 180]))),
        "no_stream": dump({"OT01V1-framesPerSecond": entry([1])}),
        "no_frames": dump({"IT01V1-qpSum": entry([1])}),
        "broken": "{not json",
    }
    return spark.createDataFrame(list(rows.items()), "trace_id string, body string")


def test_status(table):
    got = {r["trace_id"]: r["reason"] for r in dumps.dump_status(table).collect()}
    assert got == {
        "valid": None,
        "two": None,
        "empty_first": None,
        "tie": None,
        "missing": "statistic missing",
        "null_value": "statistic unreadable",
        "no_stream": "no inbound stream",
        "no_frames": "no frames seen",
        "broken": "unreadable dump",
    }


def test_stream_choice(table):
    rows = dumps.stat_rows(table)
    got = {r["trace_id"]: r["stream"] for r in dumps.most_active(rows).collect()}
    assert got == {
        "valid": "7", "two": "8", "empty_first": "5", "tie": "4", "missing": "7", "null_value": "7",
    }
    two = dumps.active_streams(rows).where("trace_id = 'two'").collect()
    assert sorted(r["stream"] for r in two) == ["8", "9"]


def test_labels(table):
    got = dumps.read_labels(table)
    assert {r["trace_id"] for r in got.select("trace_id").distinct().collect()} == {
        "valid", "two", "empty_first", "tie",
    }
    rows = got.where("trace_id = 'valid'").orderBy("ts").collect()
    assert [r["ts"] for r in rows] == [T0, T0 + 1, T0 + 2, T0 + 3]
    assert [r["framesReceived"] for r in rows] == [10, 3, 0, 7]
    assert [r["framesReceivedPerSecond"] for r in rows] == [0, 1, 2, 3]
    assert [r["bitrate"] for r in rows] == [0, 1, 2, 3]
    assert rows[0]["[codec]"] == "VP9"
    assert rows[0]["duration"] == pytest.approx(2.7) and rows[0]["num_vals"] == 4


def test_files(spark, table, tmp_path):
    (tmp_path / "a.json").write_text(dump(stats()))
    read = dumps.read_dumps(spark, str(tmp_path))
    assert dumps.read_labels(read).count() == 4


def test_validation_reasons(spark, make_packets):
    second = 1_000_000
    plain = {"epoch_us": 100 * second}
    rows = [
        {**plain, "trace_id": 1},
        {**plain, "trace_id": 2, "ip_proto": None},
        {**plain, "trace_id": 3, "length": 200},
        {**plain, "trace_id": 4, "p_type": None},
        {**plain, "trace_id": 5},
        {**plain, "trace_id": 6},
        {**plain, "trace_id": 7},
        {**plain, "trace_id": 8, "ssrc": None},
        {**plain, "trace_id": 9},
        {**plain, "trace_id": 9, "ip_proto": "1,17"},
    ]
    ranges = spark.createDataFrame(
        [(k, 90, 110, 20.7, 20) for k in (1, 2, 3, 4, 8, 9)]
        + [(6, 200, 210, 10.0, 10), (7, 90, 110, 21.0, 20)],
        "trace_id bigint, label_first bigint, label_last bigint, duration double, num_vals bigint",
    )
    got = {r["trace_id"]: r["reason"] for r in validate(make_packets(rows), ranges).collect()}
    assert got == {
        1: None,
        2: "malformed protocol",
        3: "no video packets",
        4: "no RTP packets",
        5: "no labels",
        6: "times do not overlap",
        7: "fewer samples than seconds",
        8: "no video packets",
        9: None,
    }


def test_labels_parse_every_dump_once(spark):
    """The chosen stream comes from the same parsed statistics, not from a second pass joined to them."""
    bodies = spark.range(2).selectExpr("id as trace_id", "'{}' as body")
    plan = dumps.chosen_stats(dumps.stat_rows(bodies))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Range (") == 1
