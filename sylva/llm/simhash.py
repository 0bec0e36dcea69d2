"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits, cut into a ring of five segments. Two fingerprints that
differ in at most four bits have a segment from which every chain of l consecutive
segments differs in at most 4 l / 5 bits, rounded down: none in the first segment, at
most one in the first two, two in three, three in four (the pigeonring principle).

The first two conditions are looked up: equal bits in the first segment and in one
half of the next (if at most one bit differs there, one half is equal). This gives ten
keys of about 19 bits for each distinct fingerprint. Pairs that meet are tried against
the longer chains, and then by their whole distance.

Equal fingerprints are one vertex. Buckets beyond ``BUCKET`` fingerprints are dealt out
as pairs of blocks. Large groups aren't compared pair by pair: fingerprints around a
pivot are linked to it, and two pivots' members are compared only if the pivots are
near enough for a link. A task sends on a forest of what it linked, never all pairs.

Defined results: a null or empty text has fingerprint zero, linked like any other; a
component's id is the smallest id in it (null if it has none); repeated rows and ties
are members of one component and each keeps its row; an empty table gives no rows; very
long texts are hashed in parts; extra columns aren't read, and ``keep_one`` keeps them,
whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_name, parts_for, stage, tune
from .components import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
BUCKET = 8192
#: Bytes of a row of the index, about.
ROW_BYTES = 24
#: Groups up to this size are compared by offsets, all at once.
SMALL = 48
_WIDTHS = (13, 13, 13, 13, 12)
_STARTS = (0, 13, 26, 39, 52)


def _mask(start: int, width: int) -> int:
    return ((1 << width) - 1) << start


SEGMENTS = [_mask(s, w) for s, w in zip(_STARTS, _WIDTHS)]


def _keys() -> list[tuple[int, int]]:
    """(first segment of the chain, bits of the key), ten of them."""
    out = []
    for i in range(5):
        j = (i + 1) % 5
        low = _WIDTHS[j] // 2
        out += [(i, SEGMENTS[i] | _mask(_STARTS[j], low)), (i, SEGMENTS[i] | _mask(_STARTS[j] + low, _WIDTHS[j] - low))]
    return out


KEYS = _keys()
#: chain bits of two to four segments from each first segment
_CHAINS = np.array([[SEGMENTS[i] | SEGMENTS[(i + 1) % 5], SEGMENTS[i] | SEGMENTS[(i + 1) % 5] | SEGMENTS[(i + 2) % 5], ((1 << 64) - 1) ^ SEGMENTS[(i + 4) % 5]] for i in range(5)], np.uint64)


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """A hash of each shingle of lower-case words, one at least."""
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    step = np.cumsum([len(w) + 1 for w in words])
    ends = (step[min(shingle, len(words)) - 1 :] - 1).tolist()
    starts = [0, *step[: n - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    return majority(shingle_hashes(words, shingle))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    n = len(hashes)
    set_bits = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        part = hashes[k : k + (1 << 14)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text):
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return run(text)


def chain_ok(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the differences ``x`` stay within the budgets from segment ``first``."""
    ok = np.bitwise_count(x & _CHAINS[first, 0]) <= 1
    ok &= np.bitwise_count(x & _CHAINS[first, 1]) <= 2
    ok &= np.bitwise_count(x & _CHAINS[first, 2]) <= 3
    return ok


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vertex to the smallest it is connected with."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = flat[: len(a)], flat[len(a) :], np.arange(len(names))
    while True:
        low = np.minimum(label[i], label[j])
        if (label[i] == low).all() and (label[j] == low).all():
            break
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    own = label != np.arange(len(names))
    return names[own], names[label[own]]


def _link_small(first: np.ndarray, group: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between rows of the same group, a few rows apart."""
    out, at, d = [], np.arange(len(fp)), 1
    while True:
        at = at[at + d < len(fp)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            return out
        x = fp[at] ^ fp[at + d]
        kept = chain_ok(x, first[at])
        kept[kept] = np.bitwise_count(x[kept]) <= DISTANCE
        if kept.any():
            out.append((fp[at[kept]], fp[at[kept] + d]))
        d += 1


def _link_large(first: int, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A set of links with the same components as all links of a group that have their
    chain at its first segment."""
    pivots, members, out = [], [], []
    rest = np.unique(fp)

    def linked(x: np.ndarray) -> np.ndarray:
        kept = chain_ok(x, np.full(x.shape, first))
        kept[kept] = np.bitwise_count(x[kept]) <= DISTANCE
        return kept

    while len(rest):
        near = linked(rest ^ rest[0])
        pivots.append(rest[0])
        members.append(rest[near])
        out.append((np.full(int(near.sum()), rest[0]), rest[near]))
        rest = rest[~near]
    pivot, root = np.array(pivots), list(range(len(pivots)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in range(len(pivot)):
        apart = np.bitwise_count(pivot[k + 1 :] ^ pivot[k])
        close = np.flatnonzero(apart <= 3 * DISTANCE)
        for j in (close[np.argsort(apart[close], kind="stable")] + k + 1).tolist():
            if find(k) == find(j):
                continue
            b = members[j]
            for lo in range(0, len(members[k]), 256):
                a = members[k][lo : lo + 256]
                hit = np.argwhere(linked(a[:, None] ^ b[None, :]))
                if len(hit):
                    out.append((a[hit[:1, 0]], b[hit[:1, 1]]))
                    root[find(j)] = find(k)
                    break
    return out


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, bits, p, q, fp) sorted by group; sends (a, b) links on."""
    first_of = np.array([i for i, _ in KEYS])
    links: list[tuple[np.ndarray, np.ndarray]] = []
    carry: list[np.ndarray] | None = None

    def work(cols: list[np.ndarray]) -> None:
        t, bits, p, q, fp = cols
        new = np.ones(len(fp), bool)
        new[1:] = (t[1:] != t[:-1]) | (bits[1:] != bits[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
        group = np.cumsum(new)
        begins = np.append(np.flatnonzero(new), len(fp))
        size = np.diff(begins)
        large = size > SMALL
        for k in np.flatnonzero(large):
            links.extend(_link_large(int(first_of[t[begins[k]]]), fp[begins[k] : begins[k + 1]]))
        small = ~np.repeat(large, size)
        links.extend(_link_small(first_of[t[small]], group[small], fp[small]))

    def send() -> Iterator[pa.RecordBatch]:
        if links:
            a, b = _forest(*(np.concatenate(x) for x in zip(*links)))
            links.clear()
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        cols[4] = cols[4].view(np.uint64)
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols)]
        if not len(cols[4]):
            continue
        # the last group may go on in the next batch
        same = np.ones(len(cols[4]), bool)
        for c in cols[:4]:
            same &= c == c[-1]
        cut = len(same) - int(same.sum())
        carry = [c[cut:] for c in cols]
        if cut:
            work([c[:cut] for c in cols])
        if sum(len(a) for a, _ in links) > 1 << 20:
            yield from send()
    if carry is not None:
        work(carry)
    yield from send()


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, enough for the components."""
    index = prints.select(F.explode(F.array(*[F.struct(F.lit(t).cast("tinyint").alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for t, (_, m) in enumerate(KEYS)])).alias("k"), "fp").select("k.t", "k.bits", "fp")
    hot = stage(index.groupBy("t", "bits").count().filter(F.col("count") > bucket).select("t", "bits", F.ceil(F.col("count") / bucket).cast("int").alias("blocks")), "hot")
    zero = F.lit(0).cast("int")
    if hot.isEmpty():
        dealt = index.select("t", "bits", zero.alias("p"), zero.alias("q"), "fp")
    else:
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        other = index.join(hot, ["t", "bits"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", block)
        other = other.select("t", "bits", "fp", "own", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("c"))
        dealt = other.select("t", "bits", F.least("own", "c").alias("p"), F.greatest("own", "c").alias("q"), "fp")
    parts = parts_for(prints.sparkSession, len(KEYS) * ROW_BYTES * prints.count(), busy=True)
    keys = ["t", "bits", "p", "q"]
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "fp").mapInArrow(_link, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long) and component_id of every row."""
    tune(docs.sparkSession)
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")), "prints")
    groups = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    linked = stage(components(links(groups.select("fp"))), "linked")
    named = groups.join(linked, groups["fp"] == linked["vertex"], "left").select("fp", "least", "root")
    joined = named.filter("root IS NOT NULL")
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = joined.join(smallest, "root").select("fp", "component_id").unionByName(named.filter("root IS NULL").select("fp", F.col("least").alias("component_id")))
    return rows.join(stage(of_fp, "components"), "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the first of its smallest id. Rows are
    told apart by a number, so that null and repeated ids are rows like others."""
    key = free_name(docs, "_row")
    rows = stage(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    found = stage(classes(rows, key, text_col).select(F.col("doc_id").alias("v"), "component_id"), "classes")
    ids = rows.select(F.col(key).alias("v"), "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "v")).alias("first")
    leads = found.join(ids, "v").groupBy("component_id").agg(first).select(F.col("first.v").alias("v"))
    drop = stage(found.join(leads, "v", "left_anti").select(F.col("v").alias(key)), "copies")
    return rows.join(broadcast_if_small(drop), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
