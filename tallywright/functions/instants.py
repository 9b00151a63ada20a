"""Functions of instants that Spark lacks or spells otherwise: bins, strftime patterns, interval texts."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import SparkSession


class DialectError(ValueError):
    """The statement cannot be read."""


STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%%": "'%'"}


def strftime(pattern: str) -> str:
    """A strftime pattern as a Spark date_format pattern."""
    out, at = [], 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two.startswith("%"):
            if two not in STRFTIME:
                raise DialectError(f"no date pattern for {two!r}")
            out.append(STRFTIME[two])
            at += 2
        else:
            c = pattern[at]
            out.append(f"'{c}'" if c.isalpha() else c)
            at += 1
    return "".join(out)


def register(spark: SparkSession) -> None:
    """SQL functions that Spark lacks; Catalyst inlines them.  Bins are aligned to the epoch, also before 1970."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION date_bin(width INTERVAL DAY TO SECOND, at TIMESTAMP) RETURNS TIMESTAMP "
        "RETURN timestamp_micros(unix_micros(at) - pmod(unix_micros(at), cast(extract(DAY FROM width) * 86400000000 + extract(HOUR FROM width) * 3600000000 "
        "+ extract(MINUTE FROM width) * 60000000 + extract(SECOND FROM width) * 1000000 AS BIGINT)))"
    )


UNITS = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}


def interval(text: str) -> datetime.timedelta:
    """'1 minute', '2 hours 30 minutes' as a time delta."""
    parts = re.findall(r"(-?\d+(?:\.\d+)?)\s*([a-z]+?)s?\b", text.lower())
    if not parts or any(u not in UNITS for _, u in parts):
        raise DialectError(f"no interval: {text!r}")
    return datetime.timedelta(seconds=sum(float(n) * UNITS[u] for n, u in parts))
