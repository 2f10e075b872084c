"""Per-second video-call quality from packet traces, as Spark DataFrame operators."""

__version__ = "0.1.0"
