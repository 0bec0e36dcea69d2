"""Near copies by the Jaccard similarity of their word shingles, checked exactly.

A budget of bits that reaches a similarity of 0.8 leaves nothing of SimHash's keys, so
fingerprints only find the nearest copies here. The rest comes from prefixes: of two
sets as similar as asked for, in any common order of shingles, the first n - ceil(s n) + 1
of each share one. The order is that of the hashes, with the shingles that very many
prefixes hold put last.

Fewer do for large sets. Of two such sets at most (1 - s) / s x n shingles aren't shared,
and the order of the others, the rare ones, is random: the chance that the first k of
their union are all unshared is at most f ** k, with f the share of these n among the rare
ones. A prefix ends where this is 2 ** -``CHANCE``, the chance that two shingles have one
64-bit hash, which any comparison of hashes takes: 32 entries of a text without common
shingles, however long it is. (A text without a common shingle among its first 32
keeps these: that many common ones stay unseen with a chance that makes up for it.)

Counts of each set's hashes in cells, about four hashes to a cell, bound what a pair can
share; they go with the entries, and turn most pairs away where they meet. The rest is
decided by the sets.

Pairs are looked for in three rounds: links of fingerprints, a few neighbours in each
bucket, then all pairs of a bucket that the first two left in different groups. So a
large group of near copies isn't compared pair by pair. Buckets beyond ``BLOCK`` entries
are dealt out as pairs of blocks, leaving out those within the bucket's main group.

Defined results: equal texts (by lower-case words) are copies, those without words too;
a text of fewer words than a shingle is one shingle; groups are connected components;
null and repeated ids are rows like others; an empty table gives no rows; extra columns
stay, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import broadcast_if_small, free_name, parts_for, scratch, stage, tune
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of the chance that the prefixes of a pair miss each other.
CHANCE = 64
#: Shingles in more prefixes than this, and than one text in ``COMMON_SHARE``, go last;
#: at most 32 x ``COMMON_SHARE`` of them are.
COMMON = 256
COMMON_SHARE = 1000
#: Entries of a bucket that meet in one place, from each of two blocks.
BLOCK = 4096
#: Cells of a set: a power of two from a quarter of its size on, within these bounds.
LEAST_CELLS, MOST_CELLS = 128, 4096
#: Entries of a text that are used in the round of few pairs.
FEW = 6
#: Bytes of an entry with its cells, about.
ENTRY_BYTES = 300
#: Ids that may be broadcast when a count has shown that there are no more (16 MB).
BROADCAST_IDS = 1_000_000


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes, in order."""
    words = text.encode().lower().split() if text else []
    return np.unique(simhash.shingle_hashes(words, size)) if words else np.empty(0, np.uint64)


def alike(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least.denominator >= (len(a) + len(b) - both) * least.numerator


def cells(found: np.ndarray) -> np.ndarray:
    """How many hashes lie in each cell; none if a cell has more than a byte counts."""
    n = min(MOST_CELLS, max(LEAST_CELLS, 1 << (-(-len(found) // 4) - 1).bit_length()))
    count = np.bincount((found % np.uint64(n)).astype(np.int64), minlength=n)
    return (count if count.max() < 256 else count[:0]).astype(np.uint8)


class Cells:
    """Cells of many sets, folded to the same number as they are compared."""

    def __init__(self, held: list[bytes]):
        self.held, self.widths, self.folded = held, np.array([len(c) for c in held]), {}

    def _of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each set's row is, and the rows, of all sets with so many cells."""
        if width not in self.folded:
            rows = np.flatnonzero(self.widths >= width)
            at = np.zeros(len(self.widths), np.int64)
            at[rows] = np.arange(len(rows))
            made = [np.frombuffer(self.held[k], np.uint8).reshape(-1, width).sum(axis=0, dtype=np.uint16) for k in rows.tolist()]
            self.folded[width] = at, np.stack(made)
        return self.folded[width]

    def may_be_alike(self, i: np.ndarray, j: np.ndarray, n: np.ndarray, least: Fraction) -> np.ndarray:
        """Of pairs of sets of n hashes: whether the shared part can be large enough."""
        ok, width = np.ones(len(i), bool), np.minimum(self.widths[i], self.widths[j])
        for w in np.unique(width[width > 0]).tolist():
            at, made = self._of(w)
            which = np.flatnonzero(width == w)
            step = (1 << 22) // w
            for k in range(0, len(which), step):
                q = which[k : k + step]
                x, y = i[q], j[q]
                most = np.minimum(made[at[x]], made[at[y]]).sum(axis=1, dtype=np.int64)
                ok[q] = most * (least.numerator + least.denominator) >= (n[x] + n[y]) * least.numerator
        return ok


def depth(n: int, rare: int, least: Fraction) -> int:
    """Entries of the prefix of a set of n, of which so many are rare."""
    exact = n + (-n * least.numerator // least.denominator) + 1
    unshared = (1 - least) / least * n / rare if rare else 1
    return min(exact, math.ceil(CHANCE / -math.log2(unshared))) if unshared < 0.75 else exact


def prefix(found: np.ndarray, common: np.ndarray, least: Fraction) -> np.ndarray:
    n = rare = len(found)
    if n and len(common):
        last = np.isin(found, common)
        rare -= int(last.sum())
        found = np.concatenate([found[~last], found[last]])
    return found[: depth(n, rare, least)] if n else found


SKETCH = T.StructType([T.StructField(n, t) for n, t in (("digest", T.BinaryType()), ("fp", T.LongType()), ("n", T.IntegerType()), ("cells", T.BinaryType()), ("low", T.ArrayType(T.LongType())))])
_NONE = np.empty(0, np.uint64)


def sketch(text: str | None, size: int, least: Fraction) -> tuple[bytes, int, int, bytes, np.ndarray]:
    """Digest of the words, fingerprint, number of shingles, cells, prefix."""
    words = text.encode().lower().split() if text else []
    if not words:
        return xxhash.xxh3_128_digest(b""), 0, 0, b"", _NONE.view(np.int64)
    hashes = simhash.shingle_hashes(words, size)
    found = np.unique(hashes)
    fp = np.uint64(simhash.majority(hashes)).view(np.int64)
    return xxhash.xxh3_128_digest(b" ".join(words)), int(fp), len(found), cells(found).tobytes(), prefix(found, _NONE, least).view(np.int64)


def sketch_column(text, size: int = SHINGLE, least: Fraction = Fraction(str(SIMILARITY))):
    @F.arrow_udf(SKETCH)
    def run(column: pa.Array) -> pa.Array:
        rows = [sketch(t, size, least) for t in column.to_pylist()]
        ends = np.cumsum([0, *(len(r[4]) for r in rows)])
        low = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([r[4] for r in rows]) if rows else _NONE.view(np.int64)))
        return pa.StructArray.from_arrays([*(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int32(), pa.binary()))), low], names=SKETCH.names)

    return run(text)


INDEX = "h long, v long, n int, at int"


def _index(prints: DataFrame, rows: DataFrame, common: np.ndarray, size: int, least: Fraction) -> DataFrame:
    """(h, v, n, at): the shingles in the prefix of each text, with its size and their
    places. Only texts with a common shingle in their first prefix are read again."""

    @F.arrow_udf("boolean")
    def touched(low: pa.Array) -> pa.Array:
        hit = np.append(0, np.cumsum(np.isin(low.values.to_numpy().view(np.uint64), common)))
        ends = low.offsets.to_numpy()
        return pa.array(hit[ends[1:]] > hit[ends[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, v, n, at = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingles(text, size)
                first = prefix(found, common, least)
                h.append(first)
                v.append(np.full(len(first), key, np.int64))
                n.append(np.full(len(first), len(found), np.int32))
                at.append(np.arange(len(first), dtype=np.int32))
            if h:
                cols = [np.concatenate(x) for x in (h, v, n, at)]
                yield pa.record_batch([pa.array(cols[0].view(np.int64)), *map(pa.array, cols[1:])], names=["h", "v", "n", "at"])

    flat = lambda df: df.select("v", "n", F.posexplode("low").alias("at", "h")).select("h", "v", "n", "at")
    if not len(common):
        return flat(prints)
    marked = stage(prints.select("v", "n", "low", touched("low").alias("hit")), "marked")
    again = rows.join(_few(marked.filter("hit").select("v")), "v", "left_semi").select("v", "text").mapInArrow(run, INDEX)
    return flat(marked.filter("NOT hit")).unionByName(again)


def _few(ids: DataFrame) -> DataFrame:
    return broadcast_if_small(ids, BROADCAST_IDS)


def _groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.RecordBatch]:
    """Whole groups of the first columns, which the rows are sorted by."""
    held: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        same, goes_on = np.ones(batch.num_rows, bool), True
        for k in range(keys):
            c = batch.column(k).to_numpy()
            same &= c == c[-1]
            goes_on = goes_on and bool(held) and held[-1].column(k)[-1].as_py() == c[0]
        if held and not goes_on:
            yield joined()
            held = []
        cut = int(np.argmax(same))
        if cut:
            held.append(batch.slice(0, cut))
            yield joined()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield joined()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only what more than one text has, of rows sorted by h."""
    for batch in _groups(batches):
        h = batch.column(0).to_numpy()
        same = h[1:] == h[:-1]
        keep = np.append(same, False) | np.append(False, same)
        if keep.any():
            yield batch.filter(pa.array(keep))


def _middle(fp: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of each group the row whose fingerprint is nearest to the bits that most of its
    rows have: of near copies of one text, what is nearest to that text."""
    starts = np.flatnonzero(new)
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sizes = np.diff(np.append(starts, len(fp)))
    most = np.packbits(2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    far = np.bitwise_count(fp ^ np.repeat(most, sizes))
    order = np.lexsort((np.arange(len(fp)), far, np.repeat(np.arange(len(starts)), sizes)))
    return order[starts]


def _candidates(shared: DataFrame, members: DataFrame, roots: DataFrame | None, least: Fraction, few: bool) -> DataFrame:
    """Pairs (a, b) of different groups that may be as similar as asked for; with
    ``few``, only neighbours in the order of fingerprints and pairs with the middle of a
    bucket, in the first buckets of a text. ``members``: (v, fp, cells)."""
    num, den = least.numerator, least.denominator

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, 3):
            h, p, q, own, n, at, _, v, root = (batch.column(k).to_numpy() for k in range(9))
            n, at = n.astype(np.int64), at.astype(np.int64)
            held = Cells(batch.column(9).to_pylist())
            new = np.append(True, (h[1:] != h[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
            group = np.cumsum(new)

            def send(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
                ok = root[i] != root[j]
                if not few:
                    ok &= (p[i] == q[i]) | (own[i] != own[j])
                i, j = i[ok], j[ok]
                most = np.minimum(n[i] - at[i], n[j] - at[j])
                # where their first common entry is, all before it aren't shared
                ok = (np.maximum(n[i], n[j]) * num <= np.minimum(n[i], n[j]) * den) & (most * (num + den) >= (n[i] + n[j]) * num) & ((at[i] + at[j]) * (num + den) <= (n[i] + n[j]) * (den - num))
                i, j = i[ok], j[ok]
                ok = held.may_be_alike(i, j, n, least)
                i, j = i[ok], j[ok]
                if len(i):
                    yield pa.record_batch([pa.array(np.minimum(v[i], v[j])), pa.array(np.maximum(v[i], v[j]))], names=["a", "b"])

            i, d = np.arange(len(h)), 1
            if few:
                yield from send(_middle(batch.column(6).to_numpy().view(np.uint64), new)[group - 1], i)
                i = i[:-1]
                yield from send(*((i[group[i] == group[i + 1]] + k) for k in (0, 1)))
            while not few and len(i):
                i = i[i + d < len(h)]
                i = i[group[i] == group[i + d]]
                i = i[n[i + d] * num <= n[i] * den]  # in order of size
                yield from send(i, i + d)
                d += 1

    parts = parts_for(shared.sparkSession, ENTRY_BYTES * shared.count(), busy=True)
    if roots is None:
        named = members.withColumn("root", F.col("v"))
    else:
        named = members.join(_few(roots), members["v"] == roots["vertex"], "left").select(members["v"], "fp", "cells", F.coalesce("root", "v").alias("root"))
    rows = (shared.filter(F.col("at") < FEW) if few else shared).join(named, "v")
    zero = F.lit(0).cast("int")
    hot = stage(shared.groupBy("h").count().filter(F.col("count") > BLOCK), "hot")
    mixed = F.xxhash64("v")
    if hot.isEmpty():
        dealt = rows.withColumns({"own": zero, "p": zero, "q": zero})
    elif few:
        # neighbours within a block will do in this round
        blocks = rows.join(broadcast_if_small(hot), "h", "left")
        own = F.coalesce(F.pmod(mixed, F.ceil(F.col("count") / BLOCK)).cast("int"), zero)
        dealt = blocks.withColumn("own", own).withColumns({"p": F.col("own"), "q": F.col("own")}).drop("count")
    else:
        # a bucket's main group comes in blocks behind those of the others
        sizes = rows.join(hot.select("h"), "h", "left_semi").groupBy("h", "root").count()
        main = sizes.groupBy("h").agg(F.max_by("root", "count").alias("main"), F.max("count").alias("most"), F.sum("count").alias("all"))
        main = stage(main.select("h", "main", F.ceil(F.col("most") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("others")), "mains")
        blocks = rows.join(main, "h", "left").filter("others IS NULL OR others > 0")
        is_main = F.col("root") == F.col("main")
        own = F.when(is_main, F.col("others") + F.pmod(mixed, F.col("mains")).cast("int")).otherwise(F.pmod(mixed, F.col("others")).cast("int"))
        blocks = blocks.withColumn("own", F.coalesce(own, zero))
        last = F.coalesce(F.when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1), zero)
        dealt = blocks.withColumn("c", F.explode(F.sequence(zero, last))).withColumns({"p": F.least("own", "c"), "q": F.greatest("own", "c")})
    dealt = dealt.select("h", "p", "q", "own", "n", "at", "fp", "v", "root", "cells")
    keys = ["h", "p", "q"]
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "fp" if few else "n", "v").mapInArrow(pairs, "a long, b long").distinct()


def _check(pairs: DataFrame, rows: DataFrame, size: int, least: Fraction) -> DataFrame:
    """The pairs that are as similar as asked for, by the texts of ``rows``."""

    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        seen: dict[str, np.ndarray] = {}

        def get(text: str) -> np.ndarray:
            if text not in seen:
                if len(seen) > 64:
                    seen.clear()
                seen[text] = shingles(text, size)
            return seen[text]

        return pa.array([alike(get(x), get(y), least) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())

    with scratch(rows.sparkSession) as kept:
        pairs = stage(pairs, "pairs")
        ends = stage(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "ends")
        texts = stage(rows.select("v", "text").join(_few(ends), "v", "left_semi"), "texts")
        one, two = texts.select(F.col("v").alias("a"), F.col("text").alias("s")), texts.select(F.col("v").alias("b"), F.col("text").alias("t"))
        out = stage(pairs.join(one, "a").join(two, "b").filter(similar("s", "t")).select("a", "b"), "similar")
        kept.append(out)
    return out


def copies(rows: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(v, root) of each row of a staged table (v long, text, sketch) that has a near
    copy; ``sketch`` is a ``sketch_column`` of the same settings."""
    spark, least = rows.sparkSession, Fraction(str(similarity))
    prints = rows.select("v", "sketch.*")
    texts = stage(prints.groupBy("digest").agg(F.min("v").alias("least"), F.min("fp").alias("fp"), F.count("*").alias("times")), "digests")
    again = stage(prints.select("v", "digest").join(texts.filter("times > 1").select(F.col("least").alias("w"), "digest"), "digest").filter("v <> w").select("v"), "again")
    single = prints.join(_few(again), "v", "left_anti")
    # links of fingerprints
    by_fp = stage(texts.groupBy("fp").agg(F.min("least").alias("lead")), "leads")
    near = stage(simhash.links(by_fp.select("fp")), "links")
    fa, fb = by_fp.select(F.col("fp").alias("a"), F.col("lead").alias("la")), by_fp.select(F.col("fp").alias("b"), F.col("lead").alias("lb"))
    pairs = near.join(fa, "a").join(fb, "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    pairs = pairs.unionByName(texts.join(by_fp, "fp").filter("least <> lead").select(F.col("lead").alias("a"), F.col("least").alias("b"))).distinct()
    edges = _check(pairs, rows, size, least)
    roots = stage(components(edges), "roots")
    # prefixes that share a shingle
    limit = max(COMMON, texts.count() // COMMON_SHARE)
    often = single.select(F.explode("low").alias("h")).groupBy("h").count().filter(F.col("count") > limit).select("h")
    common = np.array([r.h for r in often.collect()], np.int64).view(np.uint64)
    index = _index(single.select("v", "n", "low"), rows, common, size, least)
    parts = parts_for(spark, ENTRY_BYTES * (single.agg(F.sum(F.size("low"))).first()[0] or 0), busy=True)
    shared = stage(index.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_shared, INDEX), "shared")
    members = single.select("v", "fp", "cells").join(_few(stage(shared.select("v").distinct(), "sharing")), "v", "left_semi")
    members = stage(members, "members")
    for few in (True, False):
        edges = edges.unionByName(_check(_candidates(shared, members, roots, least, few), rows, size, least))
        roots = stage(components(edges), "roots")
    named = texts.join(roots, texts["least"] == roots["vertex"], "left").filter("times > 1 OR root IS NOT NULL")
    named = stage(named.select("digest", F.coalesce("root", "least").alias("root")), "named")
    return stage(prints.select("v", "digest").join(named, "digest").select("v", "root"), "members")


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies: the first of its smallest id."""
    tune(docs.sparkSession)
    key, found = free_name(docs, "_row"), free_name(docs, "_sketch")
    rows = stage(docs.withColumns({key: F.monotonically_increasing_id(), found: sketch_column(F.col("text"), size, Fraction(str(similarity)))}), "rows")
    with scratch(docs.sparkSession) as kept:
        groups = copies(rows.select(F.col(key).alias("v"), "text", F.col(found).alias("sketch")), size, similarity)
        kept.append(groups)
    ids = rows.select(F.col(key).alias("v"), "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "v")).alias("first")
    leads = stage(groups.join(ids, "v").groupBy("root").agg(first).select(F.col("first.v").alias("v")), "kept")
    drop = stage(groups.join(leads, "v", "left_anti").select(F.col("v").alias(key)), "dropped")
    return rows.join(_few(drop), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
