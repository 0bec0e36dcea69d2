import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sylva.llm import dac, packing
from sylva.llm.common import stage
from sylva.llm.tokens import Encoder, chunks, encoder, tokenizer_path

from .conftest import ODD

PARTS = ["a", "b's", " ", "  ", "\n", "\t", "　", " ", "é", "日本", "1", "22", ".", "'ll", " x", "\r\n", "<|endoftext|>", "👍", "\xa0", "\x85", "²", "\x1c", "\x00", "ǅ", "½"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokenizer_path())
    return lambda s: np.array(t.encode(s or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_chunked_ids_are_the_tokenizers(s):
    t = Tokenizer.from_file(tokenizer_path())
    assert "".join(chunks(s)) == s
    assert encoder(tokenizer_path()).encode([s])[0] == np.array(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*PARTS, "Ω", " Жук", " long" + "g" * 80, " it's.\nSo", "   "]), max_size=9).map("".join), max_size=12))
def test_ids_of_texts_made_together(texts):
    t = Tokenizer.from_file(tokenizer_path())
    want = [np.array(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes() for s in texts]
    # few chunks are kept: most of what is met again was forgotten
    e = encoder(tokenizer_path(), 8)
    assert e.encode(texts) == want and e.encode(texts[::-1]) == want[::-1]
    assert max(map(len, [*e.kept, *e.kept.bare]), default=0) <= 64 and all(e.kept.values()) and all(type(x) is bytes for x in e.kept.values())


def test_new_words_share_a_call_of_the_model(plain):
    """op3, op9: one call for each new piece took more time than anything else."""
    e, calls = Encoder(tokenizer_path()), []

    class Counted:
        def __init__(self, model):
            self.model = model

        def __call__(self, *args):
            calls.append(1)
            return self.model(*args)

        def encode_batch_fast(self, *args, **kw):
            calls.append(1)
            return self.model.encode_batch_fast(*args, **kw)

    e.kept.model = Counted(e.kept.model)
    texts = [f"Some {'qwz'[k % 3] * (k % 5 + 1)}ord{chr(97 + k % 26)}é, and\nothers{k}." for k in range(300)]
    assert e.encode(texts) == [plain(x) for x in texts]
    assert len(calls) <= 2


def test_a_failed_call_leaves_no_chunk_without_ids(plain):
    e = Encoder(tokenizer_path())
    model, e.kept.model = e.kept.model, None
    with pytest.raises(Exception):
        e.encode(["some words, once"])
    e.kept.model = model
    assert e.encode(["some words, once"]) == [plain("some words, once")]


def test_added_tokens_count_as_the_tokenizer_has_them(tmp_path):
    t = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>  y", "a mark here  now", "plain", "a mark"]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert Encoder(tokenizer_path()).encode(texts) == want and np.frombuffer(want[0], "<u4").tolist() == [64, 220, 50256, 275]
    # one with a blank in it, one that takes the blanks before it
    from tokenizers import AddedToken

    t.add_tokens([AddedToken("a mark", normalized=False), AddedToken("now", lstrip=True, normalized=False)])
    t.save(str(tmp_path / "t.json"))
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    e = Encoder(str(tmp_path / "t.json"))
    assert e.chunked and e.encode(texts) == want


def test_another_kind_of_tokenizer_goes_whole():
    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    assert not Encoder(path).chunked
    assert Encoder(path).encode(["Some words", None])[0] == np.array(t.encode("Some words", add_special_tokens=False).ids, "<u4").tobytes()


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)]
    assert packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(1, 4) == [(0, 1)]


def test_bins_take_the_tightest_and_close_the_fullest():
    b = packing.BestFit(10, 2)
    assert b.put(6) == (0, 0) and b.put(3) == (0, 6) and b.put(8) == (1, 0)
    assert b.put(2) == (1, 8)  # space 2 is tighter than none of space 1
    assert b.put(5) == (2, 0)  # bin 1 is full and closed
    assert b.put(1) == (0, 9)


def check_packed(rows, docs, plain, capacity):
    by_seq: dict = {}
    by_doc: dict = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = sorted((str(i), k, s, n, zlib.crc32((plain(t) + b"\0\0\0\0")[4 * s : 4 * (s + n)])) for i, t in docs for k, (s, n) in enumerate(packing.cut(len(plain(t)) // 4 + 1, capacity)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by_seq)


def test_packing_of_odd_rows(spark, odd, empty, plain):
    rows = packing.pack(odd).collect()
    check_packed(rows, ODD, plain, 2048)
    assert packing.pack(empty).count() == 0


def test_packing_is_near_the_least(spark, sf, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    n = check_packed(packing.pack(frame).collect(), docs, plain, 2048)
    assert n <= 1.01 * math.ceil(sum(len(plain(t)) // 4 + 1 for _, t in docs) / 2048) + 1
    few = packing.pack(frame, open_bins=4, window=16, task_pieces=50)
    check_packed(few.collect(), docs, plain, 2048)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=1500))
def test_segments_give_any_token(ids):
    half = len(ids) // 2
    s = dac.Segment.of(dac.encode_segment(np.array(ids, "<u4"), [5, None], [half, len(ids) - half]))
    assert s.ids(0, len(ids)).tolist() == ids
    assert [s[i] for i in range(0, len(ids), 7)] == ids[::7]
    for a in range(0, len(ids), 191):
        b = min(len(ids), a + 97)
        assert s.ids(a, b).tolist() == ids[a:b]
    names, ends = s.documents()
    assert names == [5, None] and ends.tolist() == [half, len(ids)]
    with pytest.raises(IndexError):
        s[len(ids)]


def test_a_token_costs_a_few_short_reads():
    data = dac.encode_segment(np.arange(200_000, dtype="<u4"), [1], [200_000])
    taken = []

    def read(at, n):
        taken.append(n)
        return data[at : at + n]

    s = dac.Segment(read)
    head = sum(taken)
    assert [s[k] for k in (0, 70_000, 199_999)] == [0, 70_000, 199_999]
    assert sum(taken) - head < 3 * 400 and s.ids(150_000, 150_010).tolist() == list(range(150_000, 150_010))


def test_token_files(spark, odd, empty, plain):
    manifest = dac.write_tokens(odd, n_parts=3, segment_ids=100)
    rows = dac.read_documents(manifest).collect()
    start, want = 0, []
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain(t) + b"\0\0\0\0"
        want.append((i, len(ids) // 4, zlib.crc32(ids)))
    assert sorted(map(str, ((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows))) == sorted(map(str, want))
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ordered = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ordered == sorted(ordered, key=lambda i: (i is not None, i or 0))
    none = dac.write_tokens(empty)
    assert dac.read_documents(none).count() == 0 and dac.directory(none).count() == 0
    # any token of any document, from the files
    ids = {i: np.frombuffer(plain(t) + b"\0\0\0\0", "<u4") for i, t in ODD}
    asked = [(i, k) for i in (1, 3, 7, 9) for k in (0, 1, 5, 40_000, -1)] + [(12345, 0)]
    got = dac.tokens_at(manifest, spark.createDataFrame(asked, "doc_id long, i long")).collect()
    assert sorted((r.doc_id, r.i, r.id) for r in got if r.id is not None) == sorted((i, k, int(ids[i][k])) for i, k in asked if i in ids and 0 <= k < len(ids[i]))
    assert len(got) == len(asked) - 1


def test_ranges_of_ids():
    ties = np.array([-(2**63), -(2**62), 0, 2**62, 2**63 - 1], np.int64)
    assert dac.part_of([1, 5, 6, 9, None], ties, np.array([1, 5, 8])).tolist() == [0, 1, 2, 3, 0]
    # 7 is three bounds: its rows fill the ranges from before it to behind it
    hot = np.array([3, 7, 7, 7])
    assert dac.part_of([7] * 5, ties, hot).tolist() == [1, 2, 3, 4, 4] and dac.part_of([3, 4, 8], ties[:3], hot).tolist() == [0, 1, 4]
    low = np.array([-(2**63)] * 2 + [4])
    assert dac.part_of([None, None, -(2**63), 3], np.array([-(2**63), 2**62, 0, 0], np.int64), low).tolist() == [0, 2, 2, 2]
    assert dac.part_of([None, 3], ties[:2], np.array([], np.int64)).tolist() == [0, 0]


def test_equal_ids_in_many_ranges(spark, plain):
    """A hot id doesn't meet in one task: its documents are told apart by their codes."""
    docs = [(7, f"text number {k}") for k in range(400)] + [(8, "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    manifest = dac.write_tokens(table, n_parts=6)
    assert manifest.select("part").distinct().count() > 3
    rows = dac.read_documents(manifest).collect()
    assert sorted(r.ids_crc32 for r in rows) == sorted(zlib.crc32(plain(t) + b"\0\0\0\0") for _, t in docs)
    assert max(rows, key=lambda r: r.start).doc_id == 8


def test_full_pieces_of_many_partitions_share_no_sequence(spark):
    """Ids of whole pieces and of bins were equal from partition 64 on once."""
    rows = spark.createDataFrame([(i, k, 0, n, i) for i in range(140) for k, n in enumerate((2048, 700))], packing.PIECES)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        staged = stage(rows.repartition(140), "many")
        assert staged.rdd.getNumPartitions() >= 130
        found = packing.place(staged).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    held: dict = {}
    for r in found:
        held[r.sequence_id] = held.get(r.sequence_id, 0) + r.length
    assert len(found) == 280 and max(held.values()) <= 2048
