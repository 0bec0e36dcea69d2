import random

import numpy as np
import xxhash

from sylva.llm import simhash
from sylva.llm.components import components

from .conftest import ODD, frame


def slow_fingerprint(text):
    words = []
    for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" "):
        if w:
            words.append(w)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs):
    """(key, fingerprint) -> key -> smallest key reachable."""
    prints = sorted({p for _, p in pairs})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, p in pairs:
        if k is not None:
            least[find(p)] = min(least.get(find(p), k), k)
    return [(k, p, least.get(find(p))) for k, p in pairs]


def test_fingerprints():
    for _, t in ODD[:-2]:
        assert simhash.fingerprint(t) == slow_fingerprint(t)
    assert simhash.fingerprint("One two\x0bthree x four FIVE six seven") == slow_fingerprint("One two\x0bthree x four FIVE six seven")


def test_pigeonring_loses_no_pair(rng):
    """Every pair within four bits meets in a bucket whose chain it passes."""
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randint(1, 4)):
            b ^= 1 << k
        x = np.array([a ^ b], np.uint64)
        assert any(a & m == b & m and simhash.chain_ok(x, np.array([i]))[0] for i, m in simhash.KEYS)


def near(base, rng, n, bits):
    out = []
    for _ in range(n):
        p = base
        for k in rng.sample(range(64), rng.randint(0, bits)):
            p ^= 1 << k
        out.append(p)
    return out


def test_links_keep_components(spark, rng):
    prints = {0, 1, 7}
    for _ in range(8):
        chain = rng.getrandbits(64)
        prints |= set(near(chain, rng, 30, 3))
        for _ in range(6):
            chain = near(chain, rng, 1, 4)[0]
            prints.add(chain)
    prints |= set(near(rng.getrandbits(64), rng, 400, 6)) | {rng.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    want = {p: r for p, _, r in slow_components([(p, p) for p in prints])}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    table = spark.createDataFrame(signed, "fp long")
    for bucket in (simhash.BUCKET, 40):
        found = {r.vertex % 2**64: r.root % 2**64 for r in components(simhash.links(table, bucket)).collect()}
        groups, slow = {}, {}
        for p in prints:
            groups.setdefault(found.get(p, p), set()).add(p)
            slow.setdefault(want[p], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))


def test_large_groups(rng):
    """Of fingerprints with one key: all links whose chain starts there."""
    for first, mask in simhash.KEYS[::3]:
        base = rng.getrandbits(64)
        fp = [p & ~mask | base & mask for p in near(base, rng, 500, 8) + [rng.getrandbits(64) for _ in range(50)]]
        fp = np.array(fp, np.uint64)
        a, b = simhash._forest(*(np.concatenate(x) for x in zip(*simhash._link_large(first, fp))))
        root, names = dict(zip(a.tolist(), b.tolist())), sorted(set(fp.tolist()))
        up = {p: p for p in names}

        def find(p):
            while up[p] != p:
                p = up[p]
            return p

        for i, p in enumerate(names):
            x = np.array(names[:i], np.uint64) ^ np.uint64(p)
            for k in np.flatnonzero(simhash.chain_ok(x, np.full(i, first)) & (np.bitwise_count(x) <= 4)).tolist():
                up[find(p)] = find(names[k])
        by = {}
        for p in names:
            by.setdefault(root.get(p, p), set()).add(find(p))
        assert all(len(v) == 1 for v in by.values()) and len(by) == len({find(p) for p in names})


def test_report(spark, odd, empty):
    rows = simhash.report(odd).collect()
    want = slow_components([(i, slow_fingerprint(t) if t is None or len(t) < 5000 else simhash.fingerprint(t)) for i, t in ODD])
    assert sorted(map(str, ((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in rows))) == sorted(map(str, want))
    assert all(len(r.fingerprint) == 16 for r in rows)
    assert simhash.report(empty).count() == 0


def test_keep_one(spark, odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    # 1 and 6 are copies; 2, 3, 4 and one without id have no words; 5 comes twice
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 7, 8, 9, 10] and ids.count(None) == 1
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in odd.collect()}
    with_map = odd.selectExpr("*", "map('a', doc_id) AS m")
    assert simhash.keep_one(with_map).columns == with_map.columns and simhash.keep_one(with_map).count() == len(ids)
    assert simhash.keep_one(empty).count() == 0


def test_one_id_in_two_groups(spark):
    docs = frame(spark, [(5, "alpha beta gamma delta"), (5, "one two three four"), (3, "one two three four"), (6, "alpha beta gamma delta")])
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == [(3, "one two three four"), (5, "alpha beta gamma delta")]


def test_near_copies_meet(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(900)]
    base = [r.choice(words) for _ in range(800)]
    copy = list(base)
    copy[400] = "other"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(r.choice(words) for _ in range(800)))], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in simhash.report(docs).collect()} == {1: 1, 2: 1, 3: 3}
