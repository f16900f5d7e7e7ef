"""Text, identifier and record helpers as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered_in


#: Fixed value: letters and digits without those that look alike.
ALPHABET = "ACDEFGHJKMNPQRTUVWXY34679"


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as numbers (up to 20 digits); letters by lower case."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1")


def anonymous_ids(df: DataFrame, item: str, out: str = "anon") -> DataFrame:
    """p001, p002, ... in item order; as wide as the count needs, three digits at least."""
    placed = numbered_in(df, [], [F.col(item)], "_at", "_of")
    row = (F.col("_at") + 1).cast("string")
    width = F.greatest(F.lit(3), F.length(F.col("_of").cast("string")))
    anon = F.concat(F.lit("p"), F.lpad(row, 20, "0").substr(F.lit(21) - F.greatest(width, F.length(row)), F.lit(20)))
    return placed.withColumn(out, anon).drop("_at", "_of")


def fingerprint(rows: Column) -> Column:
    """First 16 hex digits of sha256 over sorted lines, each ended by a newline."""
    return F.substring(F.sha2(F.concat(F.array_join(F.array_sort(rows), "\n"), F.lit("\n")), 256), 1, 16)


def content_fingerprint(parts: Column) -> Column:
    """md5 over the md5 of each part in sorted order: the order of the parts does not count."""
    return F.md5(F.array_join(F.array_sort(F.transform(parts, lambda p: F.md5(p.cast("binary")))), "|"))


def first_shown(a: Column, b: Column) -> Column:
    """Whether a is shown first: the leading byte of sha256(a NUL b) is below 128."""
    return F.substring(F.sha2(F.concat(a, F.lit("\0"), b), 256), 1, 1) < "8"


def last_line(text: Column) -> Column:
    """Last line that is not blank, without sentence marks at its end; null if there is none."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    return F.regexp_replace(F.trim(F.try_element_at(lines, F.lit(-1))), r"[.!?]+$", "")


def failure_tag(error: Column) -> Column:
    """HTTP status, 'contract', or the first 20 characters of an error."""
    code = F.regexp_extract(error, r"HTTP (\d{3})", 1)
    return (
        F.when(error.isNull(), None)
        .when(code != "", F.concat(F.lit("HTTP "), code))
        .when(F.lower(error).contains("contract"), "contract")
        .otherwise(F.substring(error, 1, 20))
    )


def chosen_pair(photos: Column, chosen: Column) -> Column:
    """First chosen and first rejected of a group; null if nothing is chosen or nothing is left."""
    left = F.array_except(photos, chosen)
    return F.when((F.size(chosen) > 0) & (F.size(left) > 0), F.array(chosen[0], left[0]))


def translate_reason(reason: str, names: list[str]) -> str:
    """Replaces isolated numbers 1..n by the names at these places."""
    import re

    def name(m: re.Match) -> str:
        i = int(m[0])
        return names[i - 1] if 1 <= i <= len(names) else m[0]

    return re.sub(r"(?<![\w.])\d+(?![\w.]|\.\d)", name, reason)


def last_json(text: str) -> dict | None:
    """The last balanced JSON object of a noisy text, without think blocks and code fences; None if there is none."""
    import re

    text = re.sub(r"<think>.*?</think>", "", text, flags=re.S)
    best = None
    decoder = json.JSONDecoder()
    at = 0
    while (at := text.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at += 1
            continue
        best, at = value, end
    return best


def codes(n: int, seed: int = 20260904, alphabet: str = ALPHABET, size: int = 4) -> list[str]:
    """n different codes from a 32-bit generator, drawn again on a collision."""
    out: list[str] = []
    seen: set[str] = set()
    state = seed & 0xFFFFFFFF
    while len(out) < n:
        code = ""
        for _ in range(size):
            state = (state + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
            t ^= (t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
            code += alphabet[((t ^ (t >> 14)) & 0xFFFFFFFF) * len(alphabet) >> 32]
        if code not in seen:
            seen.add(code)
            out.append(code)
    return out


def capture_time(original: Column, digitized: Column, tiff: Column, offset: Column, file_time: Column) -> Column:
    """Capture time by priority of sources 'yyyy:MM:dd HH:mm:ss', moved to UTC by a valid offset +hh:mm."""
    first = F.coalesce(*[F.try_to_timestamp(c, F.lit("yyyy:MM:dd HH:mm:ss")) for c in (original, digitized, tiff)])
    ok = offset.rlike(r"^[+-](0\d|1[0-4]):[0-5]\d$")
    sign = F.when(offset.startswith("-"), 1).otherwise(-1)
    minutes = F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")
    shifted = F.timestamp_seconds(F.unix_seconds(first) + F.when(ok, sign * minutes * 60).otherwise(0))
    return F.coalesce(shifted, file_time)
