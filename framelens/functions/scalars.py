"""Column expressions shared by the operators. All stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_US = 1_000_000

# Display names of the applications.
APP_LABELS = {"meet": "Meet", "teams": "Teams", "webex": "Webex"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def idiv(a, b) -> Column:
    """Integer division of whole numbers (no detour over doubles)."""
    b = F.lit(b) if isinstance(b, int) else _col(b)
    return F.call_function("div", _col(a), b)


def all_of(conditions) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def second_of(us) -> Column:
    """Whole second holding a microsecond time."""
    return idiv(us, SECOND_US)


def second_after(us) -> Column:
    """The second a frame is reported in: the one after the second it ends in."""
    return second_of(us) + 1


def first_payload_type(c) -> Column:
    """'102', '102.0' and '102,111' all become '102'; null stays null."""
    first = F.split(_col(c), ",").getItem(0)
    return first.try_cast("double").cast("int").cast("string")


def round_half_even(c) -> Column:
    return F.bround(_col(c), 0)


def is_freeze(dur, avg) -> Column:
    """A frame freezes when it lasts over three mean durations and over mean + 150 ms (seconds)."""
    return (_col(dur) > F.greatest(3 * _col(avg), _col(avg) + F.lit(0.150))).cast("int")


def app_label(c) -> Column:
    c = _col(c)
    out = c
    for key, label in APP_LABELS.items():
        out = F.when(c == key, label).otherwise(out)
    return out


def resolution_bin(height) -> Column:
    h = _col(height)
    return (
        F.when((h > 0) & (h <= 240), "low")
        .when((h > 240) & (h <= 480), "medium")
        .when((h > 480) & (h <= 720), "high")
    )


SAMPLING_BINS = ["le_0_8", "le_1_2", "le_2", "gt_2"]


def sampling_bin(seconds) -> Column:
    """Seconds between label samples: up to 0.8, 1.2, 2, or more."""
    s = _col(seconds)
    return (
        F.when(s <= 0.8, "le_0_8")
        .when(s <= 1.2, "le_1_2")
        .when(s <= 2, "le_2")
        .when(s > 2, "gt_2")
    )
