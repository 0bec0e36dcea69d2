"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The letters of the search are words. A pattern is a window of ``WINDOW`` consecutive
words of a benchmark item (an item of fewer words is one pattern). Patterns of one
length m form a matcher:

* the shift table has, for each hash of a block of two words that ends in a pattern,
  how far the search may move when the block stands at the end of the view; any other
  block moves it by m - 1 words;
* where the shift is zero, the hash of the block and of the view's first word selects
  a bucket of patterns, and each is compared word by word.

Patterns aren't copied: the words of all items stand in one list, each distinct word
once in memory, and a pattern is a place in it. Buckets are runs of a sorted array. The
benchmark is taken in blocks of ``BLOCK_BYTES`` of text, for which a worker holds less
than 300 MB beyond the interpreter (measured on 16 MB of random words). One block is searched in a
single pass that keeps the text in place; each further block is another pass.

Defined results: a null or empty text has no words and is clean; an item without words
has no patterns; ids of items may be of any type and are reported as strings; items of
equal text count as often as they have different ids, and all without an id as one,
which the digest of the items leaves out; repeated rows give repeated results, equal
ids of documents too; very long texts are searched whole; an empty benchmark leaves all
clean; an empty table gives no rows; extra columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, stage, tune

WINDOW = 13
#: Bytes of benchmark text searched for in one pass (what a task holds in memory).
BLOCK_BYTES = 16 << 20
#: A document is contaminated if at least one word in so many is hit.
MAX_CLEAN = 20

# bytes of UTF-8: ASCII letters (lower case by then), digits, and all beyond ASCII
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode().lower()) if text else []


_MIX = 0x9E3779B97F4A7C15


class WuManber:
    """Patterns of m words each: places in a list of words, with the items' numbers."""

    def __init__(self, text: list[bytes], starts: np.ndarray, items: np.ndarray, m: int):
        self.text, self.m, self.block = text, m, min(2, m)
        n = len(starts)
        self.mask = (1 << max(10, min(25, (n * m).bit_length() + 1))) - 1
        self.shift = shift = bytearray([min(255, m - self.block + 1)]) * (self.mask + 1)
        keys, before = np.empty(n, np.int64), -2
        for k, at in enumerate(starts.tolist()):
            # a window one further on has one new block; the others move less already
            for end in (m,) if at == before + 1 else range(self.block, m + 1):
                h = self._hash(text, at + end) & self.mask
                shift[h] = min(shift[h], m - end)
            keys[k], before = self._key(text, at, at + m), at
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.items = keys[order], starts[order].astype(np.int32), items[order].astype(np.int32)

    def _hash(self, text: list[bytes], end: int) -> int:
        if self.block == 1:
            return hash(text[end - 1]) * _MIX >> 20
        return (hash(text[end - 2]) * _MIX + hash(text[end - 1])) * _MIX >> 20

    def _key(self, text: list[bytes], start: int, end: int) -> int:
        return ((self._hash(text, end) ^ hash(text[start]) * _MIX) & (1 << 64) - 1) - (1 << 63)

    def search(self, text: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(start, end, item) of every occurrence, by start."""
        m, n, shift, mask, pair, mix = self.m, len(text), self.shift, self.mask, self.block == 2, _MIX
        end = m
        while end <= n:
            if pair:
                move = shift[((hash(text[end - 2]) * mix + hash(text[end - 1])) * mix >> 20) & mask]
            else:
                move = shift[(hash(text[end - 1]) * mix >> 20) & mask]
            if move:
                end += move
                continue
            start = end - m
            key, view = self._key(text, start, end), text[start:end]
            lo = int(np.searchsorted(self.keys, key))
            while lo < len(self.keys) and self.keys[lo] == key:
                at = int(self.starts[lo])
                if self.text[at : at + m] == view:
                    yield start, end, int(self.items[lo])
                lo += 1
            end += 1


class Matchers:
    """One matcher for each length of pattern, of items (id as string, text)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        known: dict[bytes, bytes] = {}
        text: list[bytes] = []
        self.names: list[str | None] = []
        numbers: dict[str | None, int] = {}
        by_length: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for name, said in items:
            if name not in numbers:
                numbers[name] = len(self.names)
                self.names.append(name)
            w = [known.setdefault(x, x) for x in words(said)]
            n, at = len(w), len(text)
            text += w
            if n:
                starts, owners = by_length[min(n, window)]
                starts.append(np.arange(at, at + max(1, n - window + 1)))
                owners.append(np.full(len(starts[-1]), numbers[name]))
        del known
        self.each = [WuManber(text, np.concatenate(a), np.concatenate(b), m) for m, (a, b) in by_length.items()]


def scan(text: str | None, search: Matchers) -> tuple[int, list[tuple[int, int]], set]:
    """The number of words, the hit ranges of words (apart, in order) and the items."""
    w, spans, items = words(text), [], set()
    for matcher in search.each:
        for start, end, item in matcher.search(w):
            if not spans or spans[-1] != (start, end):
                spans.append((start, end))
            items.add(search.names[item])
    return len(w), merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[int, Callable[[int], list[tuple[str | None, str]]]]:
    """How many blocks of about ``block_bytes`` of text the items make, and a function
    that gets the items of one: the driver holds a block at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).filter("t IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    return n, lambda k: [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


#: The matchers that a worker built last, for the tasks that follow.
_last: dict[str, Matchers] = {}


def _searcher(items: list[tuple[str | None, str]], window: int):
    name = uuid.uuid4().hex

    @F.arrow_udf(FOUND)
    def found(texts: pa.Array) -> pa.Array:
        from sylva.llm import decontam

        held = decontam._last
        if name not in held:
            held.clear()
            held[name] = Matchers(items, window)
        rows = []
        for text in texts.to_pylist():
            n, spans, which = scan(text, held[name])
            rows.append({"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(which, key=lambda i: (i is None, i or ""))})
        return pa.array(rows, _ARROW)

    return found


def annotate(docs: DataFrame, benchmark: DataFrame, column: str, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct ``column`` of n_words, hit spans and items."""
    tune(docs.sparkSession)
    n, block = _blocks(benchmark, "item_id", "text", block_bytes)
    if n == 1:
        return docs.withColumn(column, _searcher(block(0), window)(F.col(text_col)))
    # several blocks: the hits of each pass are few; they meet by the text's digest
    key, text = free_name(docs, "_text_key"), F.col(text_col)
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    hits = None
    for k in range(n):
        one = docs.select(digest.alias(key), text.alias("t")).select(key, _searcher(block(k), window)("t").alias("f")).filter(F.size("f.items") > 0)
        one = stage(one.groupBy(key).agg(F.first("f").alias("f")), "hits")
        hits = one if hits is None else hits.unionByName(one)
    joined = hits.groupBy(key).agg(F.max("f.n_words").alias("n"), F.flatten(F.collect_list("f.spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.items")))).alias("i"))
    joined = joined.select(key, F.struct(F.col("n").alias("n_words"), _merged(F.col("s")).alias("spans"), F.col("i").alias("items")).alias(column))
    counted = docs.withColumn(key, digest).join(stage(joined, "hits"), key, "left")
    none = _searcher([], window)(text)
    return counted.withColumn(column, F.when(F.col(column).isNotNull(), F.col(column)).otherwise(none)).drop(key)


def _merged(spans: Column) -> Column:
    """Hit spans that touch become one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated(found: Column, max_clean: int = MAX_CLEAN) -> Column:
    hit = n_hit(found)
    return (hit > 0) & (hit * max_clean >= found["n_words"])


def report(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The digest of each document's hits."""
    rows = annotate(docs.select("doc_id", "text"), benchmark, "found", **settings)
    found = F.col("found")
    ids = F.array_join(F.array_sort(found["items"]), ",")
    return rows.select("doc_id", found["n_words"].alias("n_words"), n_hit(found).alias("n_hit"), F.size(found["items"]).cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), contaminated(found).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without those that hold a benchmark passage, however small its share of
    the text is: a model that reads the document has seen the passage."""
    column = free_name(docs, "_found")
    return annotate(docs, benchmark, column, **settings).filter(n_hit(F.col(column)) == 0).drop(column)


#: The same by joins of word windows, in DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i : i + 12], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM p),
x AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS t
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
h AS (SELECT x.doc_id, x.i, x.m, p.item_id FROM x JOIN p ON x.m = p.m AND x.t = p.t),
n AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY doc_id),
s AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""
