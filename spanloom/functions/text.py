"""Scalar functions over text, as Columns (span math is on bytes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks of Python's splitlines(), besides \n, \r\n and \r.
SPLITLINES = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"


def normalized_levenshtein(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in code points; 1.0 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def occurrences(content: Column, search: Column) -> Column:
    """Non-overlapping occurrences; null for an empty search."""
    gone = F.length(F.replace(content, search, F.lit("")))
    return F.when(F.length(search) > 0, ((F.length(content) - gone) / F.length(search)).cast("long"))


def byte_start(content: Column, search: Column) -> Column:
    """Byte offset of the first occurrence; null if there is none."""
    at = F.instr(content, search)
    return F.when(at > 0, F.octet_length(F.substring(content, F.lit(1), at - 1)).cast("long"))


def line_count(text: Column) -> Column:
    """Lines as splitlines() counts them: a final line break starts no line."""
    body = F.regexp_replace(text, f"(?:{SPLITLINES})\\z", "")
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.size(F.split(body, SPLITLINES))).cast("long")


def byte_count(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def prefixed(text: Column, sign: str) -> Column:
    """Every line behind a sign, as a diff shows it."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit(sign), x)), "\n")


def hex_to_decimal(text: Column) -> Column:
    """Unsigned 64-bit value of hex digits, with or without 0x; null where they are none."""
    bare = F.regexp_replace(text, "^0x", "")
    return F.when(bare.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(bare, 16, 10).cast("decimal(20,0)"))


def error_context(content: Column, start: Column, end: Column, reach: int = 20) -> Column:
    """Up to 20 bytes on either side of a span, line breaks shown as \\n."""
    lo = F.greatest(F.lit(0), start - reach)
    part = F.substring(F.encode(content, "UTF-8"), (lo + 1).cast("int"), (end + reach - lo).cast("int"))
    return F.replace(F.decode(part, "UTF-8"), F.lit("\n"), F.lit("\\n"))


def align_newline(text: Column, current: Column) -> Column:
    """text with or without a final line break, as the replaced text has it; one break is put or taken, not more."""
    bare = F.regexp_replace(text, r"\n\z", "")
    return F.when(F.endswith(current, F.lit("\n")) & ~F.endswith(text, F.lit("\n")), F.concat(text, F.lit("\n"))).when(~F.endswith(current, F.lit("\n")), bare).otherwise(text)


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def safe_path(text: Column) -> Column:
    """Whether a replacement is a plain path of names."""
    return strip(text).rlike(r"^[A-Za-z0-9_:]+$")


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def json_colored(text: Column) -> Column:
    """Escaped JSON with its keys and values in spans, for a page."""
    keyed = F.regexp_replace(html_escape(text), r'("(?:[^"\\]|\\.)*")\s*:', '<span class="key">$1</span>:')
    return F.regexp_replace(keyed, r':\s*("(?:[^"\\]|\\.)*"|-?[0-9.eE+-]+|true|false|null)', ': <span class="val">$1</span>')


def default_value(name: Column) -> Column:
    """The default for a missing field, by its name. Rules in order (fixed values)."""
    some = name.rlike("(_level|_limit|_timeout|_override|_config|_policy)$") | name.rlike("^(optional_|maybe_)") | F.contains(name, F.lit("sandbox"))
    flag = name.rlike("^(is_|has_|can_|should_|enable|disable)") | name.rlike("(_enabled|_disabled|_allowed)$")
    return (
        F.when(some, F.lit("None"))
        .when(flag, F.lit("false"))
        .when(name.rlike("s$") & ~name.rlike("ss$"), F.lit("Vec::new()"))
        .when(name.rlike("(_count|_size|_index)$"), F.lit("0"))
        .when(name.rlike("(_name|_path|_url|_message)$"), F.lit("String::new()"))
        .otherwise(F.lit("None"))
    )


def ticked(text: Column, n: int) -> Column:
    """The n-th name between backticks; null if there is none."""
    return F.nullif(F.regexp_extract(text, "[^`]*`([^`]+)`" * n, n), F.lit(""))
