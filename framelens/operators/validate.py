"""Which traces are fit for training and scoring, and why the others are not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelens.functions import SECOND_US, first_payload_type
from framelens.operators import clean
from framelens.sources.settings import VIDEO_BYTES

# Reasons, in the order they are tested.
REASONS = [
    "malformed protocol",
    "no video packets",
    "no RTP packets",
    "no labels",
    "times do not overlap",
    "fewer samples than seconds",
]


def capture_facts(packets: DataFrame, over: int = VIDEO_BYTES) -> DataFrame:
    """Per trace, what the tests need from the packets: one aggregate with map-side combine."""
    received = clean.keep_busiest(clean.rtp_only(packets), population=packets)
    kept = received.where(~F.coalesce(F.col("ip_proto").contains(","), F.lit(False)))
    proto = F.col("ip_proto").try_cast("double").cast("int")
    has_type = first_payload_type("p_type").isNotNull()
    facts = kept.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(proto.isNull()).alias("n_malformed"),
        F.count_if((proto == 17) & (F.col("length") > over)).alias("n_video"),
        F.count_if(has_type).alias("n_rtp"),
        F.min(F.when(has_type, F.col("epoch_us"))).alias("first_us"),
        F.max(F.when(has_type, F.col("epoch_us"))).alias("last_us"),
    )
    traces = packets.select("trace_id").distinct()
    return traces.join(facts, "trace_id", "left")


def validate(packets: DataFrame, ranges: DataFrame) -> DataFrame:
    """(trace_id, reason); a null reason means the trace is valid.

    ``ranges`` has one row per trace with labels: label_first, label_last, duration, num_vals.
    """
    facts = capture_facts(packets).join(ranges, "trace_id", "left")
    disjoint = (F.col("label_last") * SECOND_US < F.col("first_us")) | (
        F.col("last_us") < F.col("label_first") * SECOND_US
    )
    tests = [
        F.col("n_malformed") > 0,
        F.coalesce("n_video", F.lit(0)) == 0,
        F.coalesce("n_rtp", F.lit(0)) == 0,
        F.col("label_first").isNull(),
        disjoint,
        F.floor("duration") > F.col("num_vals"),
    ]
    reason = F.lit(None).cast("string")
    for test, text in reversed(list(zip(tests, REASONS))):
        reason = F.when(test, text).otherwise(reason)
    return facts.select("trace_id", reason.alias("reason"))


def valid_traces(traces: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The catalog without the rejected traces."""
    good = verdicts.where(F.col("reason").isNull()).select("trace_id")
    return traces.join(good, "trace_id", "left_semi")
