import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from framelens.operators.chunks import assign_chunks  # noqa: E402
from framelens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("4")


@pytest.fixture(scope="session")
def make_packets(spark):
    """Packets from dicts; missing columns get plain values."""

    def make(rows, span_us=1_000_000):
        full = [
            {
                "trace_id": 1,
                "vca": "meet",
                "pkt_ord": i,
                "t_us": 0,
                "ip_src": "s1",
                "ip_dst": "d1",
                "ip_proto": "17",
                "length": 1000,
                "ssrc": "0x1",
                "p_type": "98",
                "rtp_ts": 9000,
                "seq": i,
                "marker": 0,
                **r,
            }
            for i, r in enumerate(rows)
        ]
        for r in full:
            r.setdefault("epoch_us", 100_000_000 + r["t_us"])
        schema = (
            "trace_id bigint, vca string, pkt_ord bigint, t_us bigint, epoch_us bigint, "
            "ip_src string, ip_dst string, ip_proto string, length bigint, ssrc string, "
            "p_type string, rtp_ts bigint, seq bigint, marker int"
        )
        names = [f.split()[0] for f in schema.split(", ")]
        return assign_chunks(
            spark.createDataFrame([tuple(r[n] for n in names) for r in full], schema), span_us
        )

    return make


@pytest.fixture(scope="session")
def ptypes(spark):
    return spark.createDataFrame(
        [("d", v, r, p) for v in ("meet", "teams", "webex") for r, p in (("video", "98"), ("rtx", "99"))],
        "dataset string, vca string, role string, p_type string",
    )
