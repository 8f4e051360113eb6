"""String functions: trimming, escapes, splitting, spans, parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

BLANKS = " \t\r\n"


def trim(c: Column, what: str = BLANKS) -> Column:
    """Without the characters of ``what`` at either end."""
    return F.btrim(c, F.lit(what))


def trim_escaped(c: Column) -> Column:
    """Without blanks at either end, but for one that a backslash escapes."""
    left = F.ltrim(c, F.lit(BLANKS))
    short = F.rtrim(left, F.lit(BLANKS))
    slashes = F.length(short) - F.length(F.rtrim(short, F.lit("\\")))
    return F.when((slashes % 2 == 1) & (F.length(short) < F.length(left)), F.substring(left, F.lit(1), F.length(short) + 1)).otherwise(short)


def trim_text(c: Column, what: str) -> Column:
    """Without whole repeats of ``what`` at either end."""
    once = re.escape(what)
    return F.regexp_replace(c, f"^(?:{once})+|(?:{once})+$", "")


def unescape(c: Column) -> Column:
    """\\n, \\t and \\r become their characters, any other escaped character itself, in one pass from the left.

    A lone backslash at the end stays.
    """
    tokens = F.regexp_extract_all(c, F.lit(r"(?s)\\.|[^\\]+|\\"), F.lit(0))
    named = lambda t: (
        F.when(t == "\\n", "\n").when(t == "\\t", "\t").when(t == "\\r", "\r").when(t.startswith("\\") & (F.length(t) == 2), F.substring(t, 2, 1)).otherwise(t)
    )
    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(tokens, named), "")).otherwise(c)


def escape(c: Column) -> Column:
    """Tabs, returns and newlines become escapes, and so do blanks that stand at either end.  Backslashes stay as they are."""
    left = F.ltrim(c, F.lit(BLANKS))
    middle = F.rtrim(left, F.lit(BLANKS))
    front = F.substring(c, F.lit(1), F.length(c) - F.length(left))
    tail = F.substring(left, F.length(middle) + 1, F.length(left) - F.length(middle))
    named = lambda x: F.replace(F.replace(F.replace(x, F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    end = lambda x: named(F.replace(x, F.lit(" "), F.lit("\\ ")))
    return F.concat(end(front), named(middle), end(tail))


def split_all(c: Column, delimiter: str) -> Column:
    """Cells between delimiters; empty ones and the text after the last are kept."""
    return F.split(c, re.escape(delimiter), -1)


def split_tokens(c: Column, delimiter: str) -> Column:
    """Tokens of text and delimiter in order: array<struct<text, type>>, type 0 a delimiter and 1 text; empty text gives no token."""
    found = F.regexp_extract_all(c, F.lit(f"(?s){re.escape(delimiter)}|[^{re.escape(delimiter)}]+"), F.lit(0))
    return F.transform(found, lambda t: F.struct(t.alias("text"), F.when(t == delimiter, 0).otherwise(1).alias("type")))


def split_first(c: Column, separator: str) -> Column:
    """struct<head, tail> at the first separator; without one the whole text and null."""
    at = F.instr(c, separator)
    return F.struct(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c).alias("head"), F.when(at > 0, F.substring(c, at + len(separator), F.length(c))).alias("tail"))


def span(c: Column, members: str) -> Column:
    """Length of the prefix that has only the given characters."""
    return F.length(F.regexp_extract(c, f"(?s)^[{_class(members)}]*", 0))


def span_without(c: Column, members: str) -> Column:
    """Length of the prefix that has none of the given characters."""
    return F.length(F.regexp_extract(c, f"(?s)^[^{_class(members)}]*", 0))


def find(c: Column, needle: str) -> Column:
    """Place of the first occurrence from 0, or -1."""
    return F.instr(c, needle) - 1


def occurrences(c: Column, needle: str) -> Column:
    """Number of occurrences, those that overlap included."""
    if not needle:
        raise ValueError("empty needle")
    return F.regexp_count(c, F.lit(f"(?s){re.escape(needle[0])}(?={re.escape(needle[1:])})"))


def _class(members: str) -> str:
    return "".join("\\" + m if not m.isalnum() and m.isascii() else m for m in members)


def parse_int(c: Column) -> Column:
    """Strict: a sign and digits; anything else is null."""
    return F.when(c.rlike("^[-+]?[0-9]+$"), c.try_cast("bigint"))


def parse_float(c: Column) -> Column:
    """Sign, digits, fraction and exponent, or nan and inf; anything else is null."""
    return F.when(c.rlike(r"^[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$|(?i)^[-+]?(?:nan|inf|infinity)$"), c.try_cast("double"))


def fixed_string(c: Column, length: int) -> Column:
    """The text where it has 1 to ``length`` bytes in UTF-8, else null."""
    return F.when(F.octet_length(c).between(1, length), c)


def parse_ploidies(c: Column) -> Column:
    """"2/1/1" as array<int>."""
    return F.transform(F.split(c, "/"), lambda x: trim(x).try_cast("int"))
