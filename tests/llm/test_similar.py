from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import similar

from .conftest import frame


def slow_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def slow_kept(docs):
    """Positions of the rows that stay."""
    sets = [slow_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    best = {}
    for k, (i, _) in enumerate(docs):
        best.setdefault(find(k), []).append((i is None, i or 0, k))
    return [min(v)[2] for v in best.values()]


def planted(rng):
    """Copies at similarities around 0.8 to 0.95, beside unlike texts."""
    say = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    line = "a line that very many of these texts have in common".split()
    docs = []
    for n in (1, 4, 5, 6, 9, 14, 40, 120, 400, 900):
        for _ in range(4):
            base = say(n)
            docs.append(base)
            for share in (0.01, 0.02, 0.03, 0.04):
                copy = list(base)
                for k in rng.sample(range(n), max(1, round(share * n / 2))):
                    copy[k] = "other"
                docs += [copy, base[: max(1, round(n * (1 - 4 * share)))]]
    docs += [say(30) + line for _ in range(60)]
    rng.shuffle(docs)
    docs = [(k, " ".join(w)) for k, w in enumerate(docs)]
    return [*docs, (900, None), (901, ""), (902, docs[0][1].upper()), (None, docs[1][1]), (None, "no id here"), (None, "no id here"), (3, "an id that is used twice")]


@pytest.mark.parametrize("common,block", [(similar.COMMON, similar.BLOCK), (5, 8), (40, 5)])
def test_keep_one_against_brute_force(spark, rng, monkeypatch, common, block):
    monkeypatch.setattr(similar, "COMMON", common)
    monkeypatch.setattr(similar, "BLOCK", block)
    docs = planted(rng)
    sets = [slow_set(t) for _, t in docs]
    found = [len(a & b) / len(a | b) for k, a in enumerate(sets) for b in sets[:k] if a & b]
    assert sum(0.8 <= j < 0.85 for j in found) > 10 and sum(0.85 <= j < 0.95 for j in found) > 10 and sum(0.7 < j < 0.8 for j in found) > 10
    kept = similar.keep_one(frame(spark, docs))
    assert kept.columns == frame(spark, docs).columns
    key = lambda rows: sorted((str(i), t or "") for i, t in rows)
    assert key((r.doc_id, r.text) for r in kept.collect()) == key(docs[k] for k in slow_kept(docs))


def test_pipeline_stage_finds_copies_from_0_8(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert sorted(r.doc_id for r in kept.select(F.col("doc_id")).collect()) == sorted(rows[k][0] for k in slow_kept(rows))


def test_empty(spark, empty):
    assert similar.keep_one(empty).count() == 0


def test_alike_is_exact():
    a = similar.shingles(" ".join(f"w{k}" for k in range(14)))
    assert similar.alike(a, a[:8], Fraction(4, 5)) and not similar.alike(a, a[:7], Fraction(4, 5))
    assert len(a) == 10


def test_cells_turn_no_alike_pair_away(rng):
    """And most that aren't alike, for sets of all sizes."""
    texts = [t for _, t in planted(rng) if t]
    long = [f"w{rng.randint(0, 9000)}" for _ in range(3000)]
    texts += [" ".join(long[:n]) for n in (3000, 2600, 2300, 1500, 1000)]
    sets, least = [similar.shingles(t) for t in texts], Fraction(4, 5)
    held, n = similar.Cells([similar.cells(a).tobytes() for a in sets]), np.array([len(a) for a in sets])
    assert len(set(held.widths)) > 2
    i, j = (np.array(x) for x in zip(*[(k, m) for k in range(len(sets)) for m in range(k)]))
    near = (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (n[i] > 10)
    i, j = i[near], j[near]
    ok = held.may_be_alike(i, j, n, least)
    alike = np.array([similar.alike(sets[a], sets[b], least) for a, b in zip(i.tolist(), j.tolist())])
    assert alike.sum() > 20 and ok[alike].all() and (ok & ~alike).sum() < 0.2 * (~alike).sum()


def test_cells_of_more_than_they_can_count():
    found = np.arange(0, 4096 * 300, 4096, dtype=np.uint64)
    assert len(similar.cells(found)) == 0
    held = similar.Cells([b"", similar.cells(found[:40]).tobytes()])
    assert held.may_be_alike(np.array([0, 0]), np.array([1, 0]), np.array([300, 40]), Fraction(4, 5)).all()


def test_depth():
    least = Fraction(4, 5)
    assert [similar.depth(n, n, least) for n in (1, 4, 5, 100, 155, 10_000)] == [1, 1, 2, 21, 32, 32]
    # the more common shingles, the longer; all of the exact prefix at last
    assert similar.depth(10_000, 5000, least) == 64 and similar.depth(10_000, 3000, least) == similar.depth(10_000, 0, least) == 2001


def test_prefixes_of_alike_sets_meet(rng):
    """Also where most of what they share is common."""
    least = Fraction(4, 5)
    draw = lambda n: [rng.getrandbits(64) for _ in range(n)]
    for _ in range(300):
        n, q = rng.choice([50, 200, 1000]), rng.choice([0, 0.2, 0.5, 0.78])
        shared, a, b = draw(round(0.8 * n)), draw(round(0.1 * n)), draw(round(0.1 * n))
        common = np.array(shared[: round(q * n)], np.uint64)
        a, b = (np.unique(np.array(shared + x, np.uint64)) for x in (a, b))
        assert similar.alike(a, b, least)
        assert len(np.intersect1d(similar.prefix(a, common, least), similar.prefix(b, common, least)))


def test_a_large_group_of_near_copies(spark, rng, monkeypatch):
    """Its buckets are dealt out in blocks, with texts around that share a part only."""
    monkeypatch.setattr(similar, "COMMON", 20)
    monkeypatch.setattr(similar, "BLOCK", 16)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(100)]
    docs = []
    for k in range(150):
        copy = list(base)
        for at in rng.sample(range(100), rng.choice([0, 1, 1, 2, 3, 4, 6])):
            copy[at] = f"x{k}"
        docs.append((k, " ".join(copy)))
    docs += [(1000 + k, " ".join(base[:60] + [f"y{rng.randint(0, 5000)}" for _ in range(40)])) for k in range(30)]
    kept = similar.keep_one(frame(spark, docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(docs[k][0] for k in slow_kept(docs))
