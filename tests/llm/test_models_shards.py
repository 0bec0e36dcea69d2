import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.llm import quality, sharding, toxicity
from sylva.llm.common import read

from .conftest import ODD, frame

SF01 = "/root/testdata/sf0.01"


# ---- quality


def split(table, kept):
    return table.filter(f"pmod(xxhash64(doc_id), 2) = {int(kept)}")


@pytest.fixture(scope="module")
def halves(spark):
    docs, labels = read(spark, SF01, "documents"), read(spark, SF01, "labels")
    return docs, labels, split(labels, 0), split(labels, 1)


def test_quality_held_out(halves):
    docs, _, train, test = halves
    rows = quality.score(docs, train).join(test, "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.keep for r in good) >= 0.98 * len(good)
    assert sum(not r.keep for r in bad) >= 0.95 * len(bad)


def test_quality_shrinkage_against_brute_force(spark):
    rows = [(k, f"h{k % 3}" if k % 7 else None, f"p{k % 5}", (k * 37 % 100) / 100) for k in range(300)] + [(1000, "rare", "p", 0.9)]
    found = quality.sites(spark.createDataFrame(rows, "doc_id long, host string, path string, p double"))
    rate = sum(r[3] for r in rows) / len(rows)
    assert found.rate == pytest.approx(rate)

    def strength(groups, rates):
        n = sum(g[0] for g in groups)
        spread = sum(g[0] * (g[1] / g[0] - r) ** 2 for g, r in zip(groups, rates)) / n
        noise = sum(r * (1 - r) for r in rates) / n
        most = sum(g[0] * r * (1 - r) for g, r in zip(groups, rates)) / n
        between = spread - noise
        return min(1e4, max(1.0, most / between - 1)) if between > 0 else 1e4

    def grouped(key):
        out = {}
        for r in rows:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, s + r[3])
        return out

    hosts, paths = grouped(lambda r: r[1]), grouped(lambda r: (r[1], r[2]))
    k = strength(list(hosts.values()), [rate] * len(hosts))
    host_rate = {h: (k * rate + s) / (k + n) for h, (n, s) in hosts.items()}
    k2 = strength(list(paths.values()), [host_rate[h] for h, _ in paths])
    got = {(r.host, r.path): r for r in found.table.collect()}
    assert set(got) == set(paths)
    for key, r in got.items():
        assert r.n == paths[key][0] and r.good == pytest.approx(paths[key][1])
        assert r.host_rate == pytest.approx(host_rate[key[0]]) and r.strength == pytest.approx(k2)
    # a sparse host is drawn towards the rate of all
    assert abs(host_rate["rare"] - rate) < abs(0.9 - rate)


def slow_posterior(texts, labels):
    """The whole classifier, plainly: Newton's method, moments, shrinkage, own score out."""
    x = np.float32([quality.features(t) for _, _, _, t in texts]).astype(float)
    known = {i: min(q for j, q in labels if j == i) for i, _ in labels}
    chosen = sorted((i, k) for k, (i, *_) in enumerate(texts) if i in known)
    a, y = x[[k for _, k in chosen]], np.array([known[i] > 0 for i, _ in chosen], float)
    mean, spread = a.mean(0), a.std(0)
    spread[spread < 1e-9] = np.inf
    z = np.column_stack([(a - mean) / spread, np.ones(len(y))])
    w, pen = np.zeros(z.shape[1]), np.array([1.0] * (z.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(pen) + 1e-12 * np.eye(len(w)), z.T @ (y - p) - pen * w)
    rate = y.mean()
    logit = lambda p: np.log(p / (1 - p))
    e = np.clip((x - mean) / spread @ w[:-1] + w[-1] - logit(rate), -12, 12)
    p = 1 / (1 + np.exp(-(e + logit(rate))))

    def moments(groups, rates):
        n = sum(g[0] for g in groups)
        spread = sum(g[0] * (g[1] / g[0] - r) ** 2 for g, r in zip(groups, rates)) / n - sum(r * (1 - r) for r in rates) / n
        return min(1e4, max(1.0, sum(g[0] * r * (1 - r) for g, r in zip(groups, rates)) / n / spread - 1)) if spread > 0 else 1e4

    hosts, paths = {}, {}
    for (_, h, d, _), v in zip(texts, p):
        for table, key in ((hosts, h), (paths, (h, d))):
            n, s = table.get(key, (0, 0.0))
            table[key] = n + 1, s + v
    rho = p.mean()
    k = moments(list(hosts.values()), [rho] * len(hosts))
    host_rate = {h: (k * rho + s) / (k + n) for h, (n, s) in hosts.items()}
    k2 = moments(list(paths.values()), [host_rate[h] for h, _ in paths])
    out = []
    for (i, h, d, t), ev, v in zip(texts, e, p):
        n, s = paths[h, d]
        r = np.clip((k2 * host_rate[h] + s - v) / (k2 + n - 1), 1e-6, 1 - 1e-6)
        out.append((i, ev, host_rate[h], r, 1 / (1 + np.exp(-(ev + logit(r)))) if t and t.split() else 0.0))
    return out


def test_posterior_against_brute_force(spark):
    docs = [(r.doc_id, r.source if r.doc_id % 9 else None, r.lang, r.text) for r in read(spark, SF01, "documents").collect()]
    docs += [(90_001, "rare", "xx", docs[0][3]), (90_002, "rare", None, None), (90_003, None, None, " ")]
    labels = [(r.doc_id, r.quality) for r in read(spark, SF01, "labels").collect() if r.quality is not None]
    labels += [(labels[0][0], 0)]
    table = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string")
    got = {r.doc_id: r for r in quality.score(table, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == len(docs)
    for i, e, host, path, p in slow_posterior(docs, labels):
        r = got[i]
        assert r.evidence == pytest.approx(e, abs=1e-4) and r.host_rate == pytest.approx(host, abs=1e-5)
        assert r.path_rate == pytest.approx(path, abs=1e-5) and r.p_quality == pytest.approx(p, abs=1e-4) and r.keep == (p >= 0.5)


def test_sites_of_urls(spark):
    urls = ["https://Example.org/a/b.html", "http://u@h.example:8080/x", "//h.example", "HTTPS://h.example/docs/v1/?q=/z/", "no url", None, "http:///x/y"]
    host, path = quality.site_columns(F.col("u"))
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(host.alias("h"), path.alias("p")).collect()
    assert [tuple(r) for r in rows] == [("example.org", "/a"), ("h.example", "/"), ("h.example", "/"), ("h.example", "/docs"), (None, None), (None, None), (None, None)]
    docs = read(spark, SF01, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), *[c.alias(n) for c, n in zip(quality.site_columns(F.col("url")), ("host", "path"))])
    scored = quality.score(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), "host", "path")
    assert scored.count() == docs.count()


def test_quality_odd_rows(spark, odd, empty, labels):
    rows = quality.score(odd, labels).collect()
    assert len(rows) == len(ODD)
    blank = {2, 3, 4}
    for r in rows:
        if r.doc_id is not None:
            assert (r.p_quality == 0 and not r.keep) if r.doc_id in blank else r.keep
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 4
    assert quality.score(empty, labels).count() == 0 and quality.keep_good(empty, labels).count() == 0


def test_quality_keeps_what_it_scores(spark, halves):
    docs, labels, _, _ = halves
    scored = {r.doc_id for r in quality.score(docs, labels).filter("keep").collect()}
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == scored


# ---- toxicity


def test_ordinal_model_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    latent = x @ [1.5, -1.0, 0.0] + rng.logistic(size=3000)
    y = (latent[:, None] > np.array([0.0, 1.0, 2.5])).sum(axis=1)
    w, cuts = toxicity.fit(toxicity.Sparse.of(x), y, steps=800)
    assert np.allclose(w, [1.5, -1.0, 0.0], atol=0.25) and np.allclose(cuts, [0, 1, 2.5], atol=0.3)
    assert (np.diff(cuts) > 0).all()


def test_fit_is_at_the_least_loss():
    """No weight or threshold can be moved to lower the loss, by differences."""
    rng = np.random.default_rng(1)
    x = rng.poisson(0.4, size=(400, 6)).astype(float)
    y = np.clip(np.round(x @ [1, 0, -1, 0.5, 0, 2] + rng.normal(size=400)), 0, 3).astype(int)
    s = toxicity.Sparse.of(x)
    assert np.allclose(s.dot(np.arange(6.0)), x @ np.arange(6.0)) and np.allclose(s.back(np.arange(400.0)), x.T @ np.arange(400.0))
    w, cuts = toxicity.fit(s, y, steps=3000, rate=0.02)
    best = toxicity.loss(s, y, w, cuts)
    assert best == pytest.approx(slow_loss(x, y, w, cuts))
    for k in range(6):
        for d in (-0.05, 0.05):
            assert toxicity.loss(s, y, w + d * np.eye(6)[k], cuts) > best
    for k in range(3):
        for d in (-0.05, 0.05):
            assert toxicity.loss(s, y, w, cuts + d * np.eye(3)[k]) > best


def slow_loss(x, y, w, cuts):
    total = 0.0
    for row, grade in zip(x, y):
        at = [1 / (1 + math.exp(-(c - float(row @ w)))) for c in cuts]
        total -= math.log(([*at, 1.0])[grade] - ([0.0, *at])[grade])
    return total / len(y) + float(w @ w) / (2 * len(y))


def slow_features(text):
    out = {}
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for f in [word] + [word[:n] + "*" for n in (4, 5, 6) if len(word) > n]:
            out[f] = out.get(f, 0) + 1
    return out


def test_toxicity_against_brute_force(spark, odd):
    """Which features are chosen, and what the model makes of each text."""
    docs = [(r.doc_id, r.text) for r in read(spark, SF01, "documents").select("doc_id", "text").collect()]
    labels = {r.doc_id: r.toxic for r in read(spark, SF01, "labels").collect() if r.toxic is not None}
    table = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(table, read(spark, SF01, "labels"))
    shares: dict = {}
    n = [sum(labels.get(i) == c for i, _ in docs) for c in (0, 1)]
    for i, t in docs:
        if i in labels:
            for f in slow_features(t):
                shares.setdefault(f, [0, 0])[labels[i]] += 1
    want = set()
    for f, (clean, bad) in shares.items():
        pool = (clean + bad) / sum(n)
        error = math.sqrt(pool * (1 - pool) * (1 / n[0] + 1 / n[1]))
        if clean + bad >= 5 and error > 0 and abs(bad / n[1] - clean / n[0]) / error >= 5:
            want.add(f)
    assert set(model.vocabulary) == want and len(want) > 0
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    for i, t in docs:
        x = sum(model.weights[model.vocabulary[f]] * math.log(1 + c) for f, c in slow_features(t).items() if f in model.vocabulary)
        p = [1 / (1 + math.exp(cut - x)) for cut in model.thresholds]
        exact = [1 - p[0], p[0] - p[1], p[1] - p[2], p[2]]
        assert got[i].severity == pytest.approx(sum(p)) and got[i].p_toxic == pytest.approx(p[0]) and got[i].toxic == (p[0] >= model.cut)
        assert exact[got[i].grade] == pytest.approx(max(exact))
    assert toxicity.score(odd, model).count() == len(ODD)


def test_graded_labels_are_grades(spark):
    say = {0: "calm", 1: "rude", 2: "nasty", 3: "vile"}
    docs = [(k, " ".join(["word"] * 5 + [say[k % 4]])) for k in range(400)]
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, k % 4) for k in range(400)], "doc_id long, toxic int"))
    got = [model.severity(f"word {say[g]}")[0] for g in range(4)]
    assert got == sorted(got) and got[3] > 2 and got[0] < 0.5


def test_cut():
    assert 0.25 < toxicity.best_cut(np.array([0.9, 0.6, 0.1, 0.05]), np.array([True, True, False, False])) < 0.5
    assert 0.8 < toxicity.best_cut(np.array([0.9, 0.8, 0.7, 0.1]), np.array([True, False, True, False])) < 0.9


def test_toxicity_held_out(spark):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    train, test = split(labels, 0), split(labels, 1)
    model = toxicity.train(docs, train)
    by = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = test.collect()
    caught = [by[t.doc_id].toxic for t in truth if t.toxic == 1]
    clean = [by[t.doc_id].toxic for t in truth if t.toxic == 0]
    assert sum(caught) >= 0.9 * len(caught) and sum(clean) <= 0.01 * len(clean)
    assert all(0 <= r.severity <= 3 and r.grade in (0, 1, 2, 3) for r in by.values())


def test_toxicity_odd_rows(spark, odd, empty, labels):
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and not any(r.toxic or r.severity for r in rows)
    assert toxicity.score(empty, model).count() == 0


# ---- shards


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve(dims, bits):
    side = 1 << bits
    points = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = sharding.hilbert_index(points, bits)
    assert sorted(index) == list(range(side**dims))
    walk = points[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check_shards(rows, docs):
    n = len(docs)
    want = sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t in docs)
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in rows) == want
    counts = [sum(r.shard == s for r in rows) for s in range(8)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in rows)
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)


def test_shards(spark, odd, empty, sf):
    check_shards(sharding.shard_documents(odd).collect(), ODD)
    assert sharding.shard_documents(empty).count() == 0
    docs = read(spark, sf, "documents")
    check_shards(sharding.shard_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_written_shards_prune(spark, sf, tmp_path):
    docs = read(spark, SF01, "documents")
    ranges = sharding.write_shards(docs, str(tmp_path / "shards"), ["lang", "n_chars"], ["doc_id"]).collect()
    assert sum(r.rows for r in ranges) == docs.count() and len(ranges) == 8
    # a filter on either dimension skips shards
    assert sum(r.min_lang <= "de" <= r.max_lang for r in ranges) < 8
    assert sum(r.max_n_chars >= 8000 for r in ranges) < 8
    assert math.isclose(max(r.rows for r in ranges), min(r.rows for r in ranges), abs_tol=1)


def test_cuts_of_strings(spark, rng):
    """Against a plain sort: the value at each n-th part, whatever values begin with."""
    for n, values in ((8, [f"https://host{rng.randint(0, 40):02}.example/{rng.randint(0, 9)}" for _ in range(500)] + [None] * 9), (64, ["b"] * 100 + ["a"] * 3 + ["é", "日", ""]), (4, ["x"]), (4, [None]), (4, [])):
        table = spark.createDataFrame([(v,) for v in values], "s string")
        have = sorted((v for v in values if v is not None), key=lambda v: v.encode())
        want = [next(v for i, v in enumerate(have) if (i + 1) * n // len(have) >= k) for k in range(1, n)] if have else []
        assert sharding.string_cuts(table, n) == sharding.string_cuts(table, n, few=0) == want


def test_values_that_begin_alike_are_pruned(spark, tmp_path):
    rows = [(k, f"https://www.example.org/site/{k % 50:02}", k * 7919 % 1000) for k in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, url string, n long")
    ranges = sharding.write_shards(table, str(tmp_path / "urls"), ["url", "n"], ["doc_id"]).collect()
    want = "https://www.example.org/site/07"
    assert sum(r.min_url <= want <= r.max_url for r in ranges) <= 4 and sum(r.min_n <= 500 <= r.max_n for r in ranges) < 8


def test_clashing(spark):
    table = frame(spark, [(1, "a b c d e f g"), (2, "h i j k l m n")])
    assert sharding.shard_documents(table).count() == 2
