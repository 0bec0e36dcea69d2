"""The pipeline's stages against brute force, and what its entry promises."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sylva.llm import registry
from sylva.llm.common import read, stage

from .conftest import ODD, frame
from .test_decontam import slow as slow_hits
from .test_similar import slow_kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf):
    """The table before each stage and after the last."""
    out = [read(spark, sf, "documents")]
    for name, apply in corpus_pipeline.STAGES:
        out.append(stage(apply(spark, out[-1], sf), name.replace(" ", "-")))
    return out


def ids(table):
    return {r.doc_id for r in table.select("doc_id").collect()}


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns_stay(steps):
    for table in steps[:-1]:
        assert table.columns == COLUMNS


def test_quality_keeps_the_good(spark, sf, steps):
    kept, labels = ids(steps[1]), read(spark, sf, "labels").collect()
    good = [r.doc_id for r in labels if r.quality == 1]
    bad = [r.doc_id for r in labels if r.quality == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_one_of_each_group(steps):
    docs = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert ids(steps[2]) == {docs[k][0] for k in slow_kept(docs)}


def test_no_benchmark_passages(spark, sf, steps):
    bench = [(r.item_id, r.text) for r in read(spark, sf, "benchmark").collect()]
    hits = slow_hits([(r.doc_id, r.text) for r in steps[2].collect()], bench)
    assert ids(steps[3]) == {h[0] for h in hits if not h[2]}


def test_no_secrets(steps):
    from .test_secrets import base

    before, after = {r.doc_id: r for r in steps[3].collect()}, {r.doc_id: r for r in steps[4].collect()}
    assert set(before) == set(after)
    for i, r in after.items():
        assert not base(r.text) and r.n_chars == len(r.text)
        if not base(before[i].text) and "[SECRET]" not in r.text:
            assert r.text == before[i].text


def test_all_is_packed(steps):
    assert ids(steps[5]) == ids(steps[4])


def test_run_is_the_stages(spark, sf, steps):
    a = corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length", "ids_crc32")
    assert a.exceptAll(steps[5].select(*a.columns)).isEmpty()


def test_odd_rows_go_through(spark, sf):
    docs = frame(spark, ODD)
    for k, (_, apply) in enumerate(corpus_pipeline.STAGES):
        docs = stage(apply(spark, docs, sf), f"odd{k}")
    assert docs.filter(F.col("doc_id") == 7).count() == 1


def test_an_empty_table_goes_through(spark, sf, empty):
    docs = empty
    for k, (_, apply) in enumerate(corpus_pipeline.STAGES):
        docs = stage(apply(spark, docs, sf), f"empty{k}")
    assert docs.count() == 0


def test_registry():
    assert [n for n in registry.queries()] == sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0])) and len(registry.queries()) == 10
