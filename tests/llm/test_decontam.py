import hashlib
import re

import pytest

from sylva.llm import decontam

from .conftest import CLASHING, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def slow(docs, items):
    out = []
    for i, t in docs:
        w, hit, which = words(t), set(), set()
        for item, text in items:
            b = words(text)
            for k in range(max(1, len(b) - 12) if b else 0):
                p = b[k : k + 13]
                for at in range(len(w) - len(p) + 1):
                    if w[at : at + len(p)] == p:
                        hit |= set(range(at, at + len(p)))
                        which.add(item)
        ids = ",".join(sorted(map(str, which)))
        out.append((i, len(w), len(hit), len(which), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture(scope="module")
def cases():
    import random

    rng = random.Random(5)
    vocabulary = ["a", "b", "Cé", "d1", "x-y", "É", "zz"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.choice([0, 1, 2, 3, 12, 13, 14, 30]))) for k in range(20)] + [(100, None), (101, "..."), (3, say(15)), (10, "same words here"), (9, "same words here")]
    docs = [(k, say(rng.randint(0, 80))) for k in range(60)]
    docs += [(200 + k, say(30) + " " + (t or "") + " " + say(30)) for k, (_, t) in enumerate(items)]
    docs += [(300, None), (301, ""), (301, ""), (None, "same words here"), (302, "same words here " + "long " * 30000), (303, "sAMe, WORDS; here")]
    return docs, items


def test_search_against_brute_force(spark, cases):
    docs, items = cases
    bench = spark.createDataFrame([(i, t, *["?"] * len(CLASHING)) for i, t in items], "item_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    table = frame(spark, docs)
    want = sorted(map(str, slow([d for d in docs if len(d[1] or "") < 10000], items)))
    for block in (decontam.BLOCK_BYTES, 200):
        got = [tuple(r) for r in decontam.report(table, bench, block_bytes=block).collect()]
        assert sorted(str(r) for r in got if r[0] != 302) == want
        (long,) = [r for r in got if r[0] == 302]
        assert long[1] == 30003 and long[2] >= 3


def test_remove(spark, cases):
    docs, items = cases
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = frame(spark, docs)
    kept = decontam.remove(table, bench)
    assert kept.columns == table.columns
    bad = {r[0] for r in slow([d for d in docs if d[0] != 302], items) if r[2]}
    # 302 holds a short item among 30,000 words
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - bad - {302}


def test_empty(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(empty, none).count() == 0
    assert not any(r.contaminated for r in decontam.report(odd, none).collect())
    assert decontam.remove(odd, none).count() == odd.count()


def test_items_without_id_are_searched_for(spark):
    duckdb = pytest.importorskip("duckdb")
    docs = [(1, "before some leaked words after"), (2, "clean"), (3, "some leaked words and another passage here"), (4, "another passage here")]
    items = [(None, "some leaked words"), (7, "another passage here"), (None, "passage here")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = sorted(con.execute(decontam.ORACLE).fetchall())
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontam.BLOCK_BYTES, 20):
        assert sorted(tuple(r) for r in decontam.report(table, bench, block_bytes=block).collect()) == want
    assert [r.doc_id for r in decontam.remove(table, bench).collect()] == [2]


def test_ids_of_any_type(spark):
    """Ids that aren't numbers, and null ones."""
    docs = spark.createDataFrame([(1, "some leaked words"), (2, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([("b/1", "leaked words"), ("a/1", "some leaked"), (None, "words")], "item_id string, text string")
    rows = {r.doc_id: r for r in decontam.report(docs, bench).collect()}
    assert rows[1].n_hit == 3 and rows[1].n_items == 3 and rows[1].items_sha256 == hashlib.sha256(b"a/1,b/1").hexdigest()
    assert rows[2].n_items == 0
    found = decontam.annotate(docs, bench, "f").filter("doc_id = 1").first().f
    assert found["items"] == ["a/1", "b/1", None]


def test_memory_follows_the_benchmark():
    """No pattern is copied: a list of words, arrays of places, one shift table."""
    import random
    import tracemalloc

    rng = random.Random(3)
    vocabulary = [f"{rng.getrandbits(30):x}" for _ in range(20_000)]
    items = [(str(k), " ".join(rng.choice(vocabulary) for _ in range(100))) for k in range(1200)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    held = decontam.Matchers(items)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < 12 * size
    assert decontam.scan("x " + items[7][1] + " y", held)[1:] == ([(1, 101)], {"7"})

