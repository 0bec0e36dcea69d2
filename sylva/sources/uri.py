"""System identifiers and entity catalogs."""

from __future__ import annotations

from urllib.parse import unquote_to_bytes, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.functions.text import normalize_public_id

_UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
_PLAIN = _UNRESERVED | frozenset(b"!$&'()*+,;=:@/?")


def _escapes(part: str) -> str:
    """Percent escapes only where needed, in upper case."""
    out, k = [], 0
    while k < len(part):
        c = part[k]
        if c == "%" and len(raw := unquote_to_bytes(part[k : k + 3])) == 1:
            out.append(chr(raw[0]) if raw[0] in _UNRESERVED else f"%{raw[0]:02X}")
            k += 3
            continue
        out += [chr(b) if b in _PLAIN else f"%{b:02X}" for b in c.encode()]
        k += 1
    return "".join(out)


def normalize_uri(uri: str | None, base: str | None = None) -> str | None:
    """Absolute against ``base``, without dot segments or repeated slashes."""
    if uri is None:
        return None
    full = urljoin(base, uri) if base else uri
    s = urlsplit(full)
    kept: list[str] = []
    parts = s.path.split("/")
    for k, p in enumerate(parts):
        if p == "..":
            if len(kept) > 1:
                kept.pop()
        elif p not in ("", ".") or not kept or k == len(parts) - 1:
            kept.append("" if p == "." else p)
        if p == ".." and k == len(parts) - 1:
            kept.append("")
    return urlunsplit((s.scheme.lower(), s.netloc.lower(), _escapes("/".join(kept)), _escapes(s.query), ""))


@F.arrow_udf(T.StringType())
def normalize_column(uris: pa.Array, bases: pa.Array) -> pa.Array:
    return pa.array([normalize_uri(u, b) for u, b in zip(uris.to_pylist(), bases.to_pylist())], pa.string())


def rewrite(uris: DataFrame, rules: DataFrame, forward: bool = False) -> DataFrame:
    """``uris`` (uri) by ``rules`` (pattern, target): a pattern that ends in a slash is
    a prefix, any other the whole; the longest counts. Without a rule a URI is
    rejected (null), or kept with ``forward``.

    Rules meet URIs by equality only: on the whole, and on each prefix that ends in a
    slash."""
    cut = F.split("uri", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(cut) - 1), lambda k: F.concat(F.array_join(F.slice(cut, 1, k), "/"), F.lit("/")))
    keyed = uris.distinct().select("uri", F.explode(F.concat(F.array("uri"), F.when(F.size(cut) > 1, prefixes).otherwise(F.array().cast("array<string>")))).alias("pattern"))
    hits = keyed.join(rules, "pattern").filter("pattern = uri OR pattern LIKE '%/'")
    best = hits.groupBy("uri").agg(F.max_by(F.struct("pattern", "target"), F.length("pattern")).alias("r"))
    out = F.concat("r.target", F.substring("uri", F.length("r.pattern") + 1, F.length("uri")))
    return uris.join(best, "uri", "left").select("uri", F.coalesce(out, F.col("uri") if forward else F.lit(None)).alias("rewritten"))


def resolve(references: DataFrame, catalog: DataFrame, public_first: bool = True) -> DataFrame:
    """``references`` (ref_id, public_id, system_id) with the ``text`` that ``catalog``
    (public_id, system_id, text) has, by public id (normalised) and by system id."""
    def by(c: str, k: str) -> DataFrame:
        return catalog.filter(F.col(c).isNotNull()).select((normalize_public_id(F.col(c)) if c == "public_id" else F.col(c)).alias(k), F.col("text").alias(f"text_{k}")).dropDuplicates([k])

    rows = references.withColumn("_p", normalize_public_id(F.col("public_id"))).join(by("public_id", "_p"), "_p", "left").join(by("system_id", "system_id"), "system_id", "left")
    both = ("text__p", "text_system_id") if public_first else ("text_system_id", "text__p")
    return rows.select("ref_id", "public_id", "system_id", F.coalesce(*both).alias("text"))
