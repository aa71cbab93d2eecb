"""The event schema, the fixed names of actions and outcomes, and detection thresholds.

Every event has an explicit order, `seq`. `source` and `actor` are strings or longs; null means absent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ACTIONS = ("CONNECT", "LOGIN", "COMMAND", "FILE_TRANSFER", "DISCONNECT")
OUTCOMES = ("SUCCESS", "FAILURE", "UNKNOWN")
BRUTE_FORCE, USER_ENUMERATION, TOP_ATTACKERS = "BRUTE_FORCE", "USER_ENUMERATION", "TOP_ATTACKERS"
EVENT_COLUMNS = ("seq", "ts_ms", "source", "actor", "action", "outcome")

CAPTURE_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("eventid", T.StringType()), ("src_ip", T.VariantType()), ("username", T.VariantType()), ("epoch", T.DoubleType()), ("timestamp", T.StringType()))]
)

#: Event kinds of the capture format that are kept, with action and outcome.
EVENT_KINDS = {
    "cowrie.session.connect": ("CONNECT", "UNKNOWN"),
    "cowrie.login.success": ("LOGIN", "SUCCESS"),
    "cowrie.login.failed": ("LOGIN", "FAILURE"),
    "cowrie.command.input": ("COMMAND", "UNKNOWN"),
    "cowrie.session.file_download": ("FILE_TRANSFER", "UNKNOWN"),
    "cowrie.session.file_download.failed": ("FILE_TRANSFER", "FAILURE"),
    "cowrie.session.file_upload": ("FILE_TRANSFER", "UNKNOWN"),
    "cowrie.session.closed": ("DISCONNECT", "UNKNOWN"),
}


@dataclass(frozen=True)
class Thresholds:
    """Window length, login attempts and distinct users that raise an alert, and members of a ranking."""

    window_ms: int = 60_000
    brute_force: int = 10
    user_enumeration: int = 6
    top_k: int = 20

    def __post_init__(self):
        if self.window_ms <= 0:
            raise ValueError("window_ms must be positive")


@dataclass(frozen=True)
class Sketches:
    """Sizes of the sketches: Count-Min width, depth and seed, HyperLogLog precision, Space-Saving capacity."""

    width: int = 16_384
    depth: int = 4
    seed: int = 42
    precision: int = 8
    capacity: int = 4_096
