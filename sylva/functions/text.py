"""Column functions on markup text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of XML.
SPACE = r"[ \t\r\n]"


def escape(x: Column) -> Column:
    """``& < > "`` as references, the ampersand first."""
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(raw), F.lit(ref))
    return x


def canonical(x: Column) -> Column:
    """As in canonical form: also tab, line feed and carriage return."""
    x = escape(x)
    for raw, ref in (("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;")):
        x = F.replace(x, F.lit(raw), F.lit(ref))
    return x


#: The largest code that an encoding has.
_LARGEST = {"us-ascii": 0x7F, "iso-8859-1": 0xFF, "utf-8": 0x10FFFF, "utf-16": 0x10FFFF}


def data_string(x: Column, encoding: str = "utf-8") -> Column:
    """Escaped text for an encoding: what it doesn't have goes as references."""
    largest = _LARGEST[encoding.lower()]
    if largest == 0x10FFFF:
        return escape(x)
    each = F.transform(F.split(escape(x), ""), lambda c: F.when(F.ascii(c) > largest, F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c))
    return F.array_join(each, "")


def markup_string(x: Column, encoding: str = "utf-8") -> Column:
    """Markup for an encoding; null where the encoding lacks a character, as markup has
    no references."""
    largest = _LARGEST[encoding.lower()]
    return x if largest == 0x10FFFF else F.when(~F.exists(F.split(x, ""), lambda c: F.ascii(c) > largest), x)


def legal(x: Column) -> Column:
    """Without the characters that XML 1.0 doesn't allow."""
    return F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")


def normalize_lines(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def normalize_space(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, f"{SPACE}+", " "), F.lit(" "))


def normalize_public_id(x: Column) -> Column:
    return normalize_space(x)


def only_space(x: Column) -> Column:
    return x.rlike(f"^{SPACE}*$") & ~x.rlike(rf"[^ \t\r\n]")


def name_prefix(name: Column) -> Column:
    """What stands before the first colon, or nothing."""
    at = F.instr(name, ":")
    return F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise("")


def name_local(name: Column) -> Column:
    at = F.instr(name, ":")
    return F.when(at > 0, F.substring(name, at + 1, F.length(name))).otherwise(name)


def tokens(x: Column) -> Column:
    """The words of a list value."""
    return F.filter(F.split(x, f"{SPACE}+"), lambda w: w != "")


def tags(x: Column) -> Column:
    """Start, end and empty tags of tag soup, by pattern alone."""
    return F.regexp_extract_all(x, F.lit(r"</?[A-Za-z][^<>]*>"), F.lit(0))
