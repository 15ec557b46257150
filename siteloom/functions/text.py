"""Text, number and JSON scalars as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# All Unicode white space: Spark's trim strips U+0020 only, and a plain \s knows ASCII only.
_EDGES = r"(?U)^\s+|\s+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_col(c), _EDGES, "")


def compact(c: Column | str) -> Column:
    """Runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def text_key(c: Column | str) -> Column:
    """`compact` in Unicode lower case; null stays null."""
    return F.lower(compact(c))


def ascii_lower(c: Column | str) -> Column:
    return F.translate(_col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_text_key(c: Column | str) -> Column:
    """`compact` in ASCII lower case, as the summary report uses it."""
    return ascii_lower(compact(c))


def blank(c: Column | str) -> Column:
    """Null, empty or white space only; never null itself."""
    return trimmed(F.coalesce(_col(c), F.lit(""))) == ""


def contains_ci(c: Column | str, needle: str) -> Column:
    """Literal case-insensitive substring over any scalar as text; null holds nothing."""
    return F.coalesce(F.contains(F.lower(_col(c).cast("string")), F.lit(needle.lower())), F.lit(False))


_FOREIGN = re.compile(r"\(\?[=!<](?!\w+>)|\\[1-9]|\(\?>|[*+?}]\+")


def valid_pattern(pattern: str) -> bool:
    """Whether a user's pattern is one that linear-time engines share: it compiles, without look-around or back references."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return not _FOREIGN.search(pattern)


def matches(c: Column | str, pattern: str) -> Column:
    """Unanchored regular expression; an invalid pattern matches nothing, null holds nothing."""
    return F.coalesce(F.rlike(_col(c), F.lit(pattern)), F.lit(False)) if valid_pattern(pattern) else F.lit(False)


def clamped(c: Column | str, most: int = 240) -> Column:
    """At most `most` characters, the last three of a longer text being dots."""
    c = _col(c)
    return F.when(F.char_length(c) > most, F.concat(F.left(c, F.lit(most - 3)), F.lit("..."))).otherwise(c)


def bounded_bytes(c: Column | str, most: int) -> Column:
    """The longest prefix of whole characters within `most` UTF-8 bytes.

    A prefix cut inside a character ends in a replacement after decoding, which is dropped with its broken bytes.
    """
    c = _col(c)
    raw = F.substring(F.encode(c, "UTF-8"), 1, most)
    cut = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "\uFFFD+$", "")
    return F.when(F.octet_length(c) <= most, c).otherwise(cut)


def format_bytes(c: Column | str) -> Column:
    c = _col(c).cast("double")
    return F.when(c >= 1_048_576, F.format_string("%.1f MB", c / 1_048_576)).when(c >= 1024, F.format_string("%.1f KB", c / 1024)).otherwise(F.format_string("%d B", c.cast("long")))


def format_ms(c: Column | str) -> Column:
    return F.format_string("%d ms", _col(c).cast("long"))


def status_label(status: Column | str, text: Column | str) -> Column:
    """Status code and text for display; without a response `No response`."""
    status = _col(status)
    return F.when(status.isNull(), F.lit("No response")).otherwise(F.trim(F.concat_ws(" ", status.cast("string"), trimmed(text))))


def transfer_rate(size_bytes: Column | str, ms: Column | str) -> Column:
    """Bytes a second; null without a positive time."""
    return F.floor(_col(size_bytes) * 1000 / F.nullif(_col(ms), F.lit(0)))


def severity_rank(c: Column | str) -> Column:
    """info 0 < warning 1 < error 2."""
    c = _col(c)
    return F.when(c == "error", 2).when(c == "warning", 1).otherwise(0)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 64-bit fingerprints."""
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def extraction_value(extractions: Column | str, name: str) -> Column:
    """Sort value of a custom extraction: the first entry of that name, its values joined and lower-cased; none: empty."""
    values = F.filter(_col(extractions), lambda x: x["name"] == name)
    return F.coalesce(F.lower(F.array_join(F.try_element_at(values, F.lit(1))["values"], ", ")), F.lit(""))


def search_matches(searches: Column | str, name: str) -> Column:
    """Sort value of a custom search: the sum of its match counts."""
    found = F.filter(_col(searches), lambda x: x["name"] == name)
    return F.coalesce(F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x["match_count"]), F.lit(0).cast("long"))
