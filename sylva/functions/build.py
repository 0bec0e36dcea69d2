"""Building XML from columns: a small language of nodes.

    doc = el("order", {"key": col("k")}, el("item", None, col("name")), comment("ok"))
    df.select(doc.xml().alias("xml"))

Text and attribute values are escaped; ``each`` repeats a node over an array."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escape


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


@dataclass
class Node:
    make: Callable[[], Column]

    def xml(self) -> Column:
        return self.make()


def text(x) -> Node:
    return Node(lambda: F.coalesce(escape(_column(x).cast("string")), F.lit("")))


def raw(x) -> Node:
    return Node(lambda: _column(x))


def comment(x) -> Node:
    return Node(lambda: F.concat(F.lit("<!--"), _column(x), F.lit("-->")))


def pi(target: str, x) -> Node:
    return Node(lambda: F.concat(F.lit(f"<?{target} "), _column(x), F.lit("?>")))


def el(name: str, attrs: dict | None = None, *children) -> Node:
    """An element; a null attribute is left out."""

    def make() -> Column:
        parts = [F.lit(f"<{name}")]
        for a, v in (attrs or {}).items():
            parts.append(F.coalesce(F.concat(F.lit(f' {a}="'), escape(_column(v).cast("string")), F.lit('"')), F.lit("")))
        parts.append(F.lit(">"))
        parts += [(c if isinstance(c, Node) else text(c)).xml() for c in children]
        return F.concat(*parts, F.lit(f"</{name}>"))

    return Node(make)


def each(array, node: Callable[[Column], Node]) -> Node:
    return Node(lambda: F.array_join(F.transform(_column(array), lambda x: node(x).xml()), ""))
