"""String helpers, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text, delimiters: str = " ") -> Column:
    """All runs of characters that are no delimiter; empty ones never count."""
    return F.regexp_extract_all(_c(text), F.lit(f"([^{re.escape(delimiters)}]+)"), F.lit(1))


def next_token(text, delimiters: str, start=1) -> Column:
    """The first token at or after a place (from 1), empty if there is none."""
    return F.regexp_extract(F.substring(_c(text), start if isinstance(start, int) else start, 1 << 30), f"[^{re.escape(delimiters)}]+", 0)


def next_n_tokens(text, n: int, delimiters: str) -> Column:
    """The first n tokens, or none if there are fewer."""
    found = tokens(text, delimiters)
    return F.when(F.size(found) >= n, F.slice(found, 1, n)).otherwise(F.array().cast("array<string>"))


def trim_space(text) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def join(values, by: str = ";") -> Column:
    return F.array_join(_c(values), by)


def join_pairs(pairs, by: str = ";") -> Column:
    """k:v of a map, by key."""
    entries = F.array_sort(F.map_entries(_c(pairs)))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), by)


def to_readable(text) -> Column:
    """Bytes outside printable ASCII as a backslash and their hexadecimal number."""
    chars = F.filter(F.split(F.hex(F.encode(_c(text), "UTF-8")), "(?<=\\G..)"), lambda h: F.length(h) > 0)
    shown = F.transform(
        chars,
        lambda h: F.when((F.conv(h, 16, 10).cast("int") >= 32) & (F.conv(h, 16, 10).cast("int") < 127), F.decode(F.unhex(h), "UTF-8")).otherwise(
            F.concat(F.lit("\\"), F.lower(F.regexp_replace(h, "^0", "")))
        ),
    )
    return F.array_join(shown, "")


def parse_params(text) -> Column:
    """k=v pairs apart by ';' or ',', as a map."""
    parts = F.filter(F.split(_c(text), "[;,]"), lambda x: F.contains(x, F.lit("=")))
    return F.map_from_entries(F.transform(parts, lambda x: F.struct(trim_space(F.substring_index(x, "=", 1)).alias("key"), trim_space(F.regexp_replace(x, "^[^=]*=", "")).alias("value"))))


def base64_le(number) -> Column:
    """base64 of a number's 8 bytes, the lowest first."""
    h = F.lpad(F.hex(_c(number).cast("long")), 16, "0")
    return F.base64(F.unhex(F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(8)))))
