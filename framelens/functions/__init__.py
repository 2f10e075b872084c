from framelens.functions.scalars import (
    SAMPLING_BINS,
    SECOND_US,
    all_of,
    app_label,
    first_payload_type,
    idiv,
    is_freeze,
    resolution_bin,
    round_half_even,
    sampling_bin,
    second_after,
    second_of,
)

__all__ = [
    "SAMPLING_BINS",
    "SECOND_US",
    "all_of",
    "app_label",
    "first_payload_type",
    "idiv",
    "is_freeze",
    "resolution_bin",
    "round_half_even",
    "sampling_bin",
    "second_after",
    "second_of",
]
