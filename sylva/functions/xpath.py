"""XPath 1.0 conversions and core functions as Column expressions.

Numbers are IEEE doubles; Spark's ANSI division and its NaN = NaN don't follow
XPath, so they are guarded here."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_space


def nan() -> Column:
    return F.lit(math.nan)


def to_number(s: Column) -> Column:
    """A string as a number: an optional minus, digits, a point; else NaN."""
    bare = F.btrim(s, F.lit(" \t\r\n"))
    return F.when(bare.rlike(r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), bare.try_cast("double")).otherwise(nan())


def to_string(x: Column) -> Column:
    """A number in XPath's decimal form, without exponents."""
    plain = x.cast("string")
    whole = F.call_function("format_number", x, F.lit("0"))
    parts = F.call_function("format_number", x, F.lit("0.####################"))
    return (
        F.when(F.isnan(x), F.lit("NaN")).when(x == math.inf, F.lit("Infinity")).when(x == -math.inf, F.lit("-Infinity")).when(x == 0, F.lit("0"))
        .when(x == F.floor(x), whole)
        .when(plain.contains("E"), parts).otherwise(plain)
    )


def boolean_of_number(x: Column) -> Column:
    return (x != 0) & ~F.isnan(x)


def boolean_of_string(x: Column) -> Column:
    return x != ""


def number_of_boolean(x: Column) -> Column:
    return F.when(x, 1.0).otherwise(0.0)


def string_of_boolean(x: Column) -> Column:
    return F.when(x, "true").otherwise("false")


def compare(op: str, a: Column, b: Column, numbers: bool) -> Column:
    """A comparison of two numbers, or (only = and !=) of others."""
    if op == "=":
        out = a == b
    elif op == "!=":
        out = a != b
    else:
        out = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if not numbers:
        return out
    some = F.isnan(a) | F.isnan(b)
    return F.when(some, F.lit(op == "!=")).otherwise(out)


def divide(a: Column, b: Column) -> Column:
    """IEEE division; a zero divisor gives an infinity or NaN."""
    # the sign of a zero shows in its text
    minus = b.cast("string") == "-0.0"
    toward = F.when(F.isnan(a) | (a == 0), nan()).when((a > 0) != minus, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(F.isnan(b), nan()).when(b == 0, toward).otherwise(a / F.when(b != 0, b))


def remainder(a: Column, b: Column) -> Column:
    """The rest of truncating division, with the sign of the dividend."""
    odd = F.isnan(a) | F.isnan(b) | (b == 0) | (F.abs(a) == math.inf)
    return F.when(odd, nan()).when(F.abs(b) == math.inf, a).otherwise(a % F.when(b != 0, b))


def _kept(x: Column, f) -> Column:
    """Applies to finite numbers only; the others stay as they are."""
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**62), x).otherwise(f(x).cast("double"))


def floor(x: Column) -> Column:
    return _kept(x, F.floor)


def ceiling(x: Column) -> Column:
    return _kept(x, F.ceil)


def rounded(x: Column) -> Column:
    """Half up."""
    return _kept(x, lambda v: F.floor(v + 0.5))


def substring_before(s: Column, p: Column) -> Column:
    at = F.position(p, s)
    return F.when(at > 0, F.left(s, at - 1)).otherwise("")


def substring_after(s: Column, p: Column) -> Column:
    at = F.position(p, s)
    return F.when(p == "", s).when(at > 0, F.substring(s, at + F.char_length(p), F.char_length(s))).otherwise("")


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """Characters at positions >= round(start) and < round(start) + round(length)."""
    first = rounded(start)
    end = F.lit(math.inf) if length is None else first + rounded(length)
    n = F.char_length(s).cast("double")
    lo, hi = F.greatest(first, F.lit(1.0)), F.least(end, n + 1)
    empty = F.isnan(first) | F.isnan(end) | ~(lo < hi)
    cut = F.substring(s, F.when(empty, 1).otherwise(lo.cast("int")), F.when(empty, 0).otherwise((hi - lo).cast("int")))
    return F.when(empty, "").otherwise(cut)


def string_length(s: Column) -> Column:
    return F.char_length(s).cast("double")


def translate(s: Column, before: Column, after: Column) -> Column:
    """The first mapping of a character counts; surplus ones delete. Arguments may be
    columns, which Spark's own translate doesn't take."""
    codes = F.split(s, "")
    at = lambda c: F.position(c, before)
    mapped = F.transform(codes, lambda c: F.when((c == "") | (at(c) == 0), c).when(at(c) > F.char_length(after), "").otherwise(F.substring(after, at(c), F.lit(1))))
    return F.array_join(mapped, "")


#: Functions of strings and numbers only: name -> (argument types, builder).
SCALAR = {
    "concat": ("string*", lambda *a: F.concat(*a)),
    "starts-with": ("string string", lambda s, p: F.startswith(s, p)),
    "contains": ("string string", lambda s, p: F.contains(s, p)),
    "substring-before": ("string string", substring_before),
    "substring-after": ("string string", substring_after),
    "substring": ("string number number", substring),
    "string-length": ("string", string_length),
    "normalize-space": ("string", normalize_space),
    "translate": ("string string string", translate),
    "not": ("boolean", lambda b: ~b),
    "true": ("", lambda: F.lit(True)),
    "false": ("", lambda: F.lit(False)),
    "floor": ("number", floor),
    "ceiling": ("number", ceiling),
    "round": ("number", rounded),
    "boolean": ("boolean", lambda b: b),
    "number": ("number", lambda x: x),
    "string": ("string", lambda s: s),
}
