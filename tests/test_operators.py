import os

from pyspark.sql import functions as F

from sylva.functions import build, text
from sylva.operators import events as ev
from sylva.operators import namespaces as ns
from sylva.operators import tree
from sylva.sources import corpora, files, uri
from sylva.sources.parser import Options
from sylva.sources.xml import parse_events, parse_nodes
from sylva.streaming.filters import drop_ignorable_whitespace_stream, norm_cdata_stream, pfilter_stream


def nodes(spark, *xml, **options):
    return parse_nodes(spark.createDataFrame(list(enumerate(xml)), "doc_id long, xml string"), Options(**options))


def written(n):
    return [r.xml for r in ev.write(tree.liquefy(n)).orderBy("doc_id").collect()]


def test_edits(spark):
    n = nodes(spark, "<a><b/>x<c><b/></c>y</a>").cache()
    assert written(tree.remove(n, F.col("name") == "b")) == ["<a>x<c></c>y</a>"]
    assert written(tree.normalize(tree.remove(n, F.col("name") == "c"))) == ["<a><b></b>xy</a>"]
    assert written(tree.set_attribute(tree.set_attribute(n, F.col("name") == "b", "k", F.lit("<")), F.col("name") == "b", "k", F.lit("2"))) == ['<a><b k="2"></b>x<c><b k="2"></b></c>y</a>']
    new = n.filter("name = 'a'").select("doc_id", F.col("pre").alias("parent"), F.lit("new").alias("name"), F.lit("").alias("value"), F.array().cast(dict(n.dtypes)["attrs"]).alias("attrs"))
    for pos, want in ((0, "<a><new></new><b></b>x<c><b></b></c>y</a>"), (2, "<a><b></b>x<new></new><c><b></b></c>y</a>"), (9, "<a><b></b>x<c><b></b></c>y<new></new></a>")):
        assert written(tree.insert(n, new.withColumn("pos", F.lit(pos)))) == [want]


def test_renumbered_tables_are_trees(spark):
    n = nodes(spark, "<a><b/>x<c><b/><d>t</d></c>y</a>", "<a/>")
    cut = tree.remove(n, F.col("name") == "b")
    fresh = nodes(spark, "<a>x<c><d>t</d></c>y</a>", "<a/>")
    cols = ["doc_id", "pre", "fin", "level", "parent", "pos", "kind", "name"]
    assert sorted(map(tuple, cut.select(*cols).collect()), key=str) == sorted(map(tuple, fresh.select(*cols).collect()), key=str)


def test_strip(spark):
    n = nodes(spark, "<a> A </a>", "<a>\nA\n</a>", "<a>  A  </a>", "<a xml:space='preserve'> A </a>", "<a> <b> </b> x</a>", "<a><!--c--> A <!--c--></a>").cache()
    expect = {
        ("seq", "seq"): ["A", "A", "A", " A ", " x", "A"],
        ("one", "disabled"): ["A ", "A\n", " A  ", " A ", " x", "A "],
        ("one_lf", "one_lf"): [" A ", "A", "  A  ", " A ", "  x", " A "],
        ("disabled", "one"): [" A", "\nA", "  A ", " A ", "  x", " A"],
    }
    for (left, right), want in expect.items():
        rows = tree.strip_whitespace(n, left, right).filter("kind = 'data'")
        got = {}
        for r in rows.orderBy("doc_id", "pre").collect():
            got[r.doc_id] = got.get(r.doc_id, "") + (r.value if r.doc_id != 4 or "x" in r.value or r.level == 2 else "")
        assert [got[k] for k in range(6)] == want, (left, right)
    assert written(tree.strip_whitespace(n, delete_empty=True))[4] == "<a><b></b> x</a>"


def test_sort_find_clone(spark):
    n = nodes(spark, "<l><r><k>b</k><v>1</v></r><r><v>2</v></r><r><k>a</k></r></l>").cache()
    assert written(tree.sort_children(n, "l", "k")) == ["<l><r><v>2</v></r><r><k>a</k></r><r><k>b</k><v>1</v></r></l>"]
    roots = n.filter("name = 'r' AND pos < 2").select("doc_id", "pre", "fin", "path", (F.col("pos") + 10).cast("long").alias("new_id"))
    assert written(tree.clone(n, roots)) == ["<r><k>b</k><v>1</v></r>", "<r><v>2</v></r>"]
    top = n.filter("name = 'l'")
    assert [r.value for r in tree.find_first(n, top, F.col("name") == "v").collect()] == ["1"]
    assert tree.find_all(n, top, F.col("name") == "v", deeply=False).count() == 0
    assert tree.node_data(n, top).first().data == "b12a"
    ext = tree.extend(n, "size", {"k": F.length("value"), "v": F.lit(-1)}, F.lit(0))
    assert sorted(r.size for r in ext.collect() if r.size) == [-1, -1, 1, 1]


def test_growing_tables_are_not_broadcast(spark, tmp_path):
    """Stored tables look small to Spark; no edit may send one through the driver."""
    from sylva.sources.store import load

    n = nodes(spark, "<list>" + "".join(f"<record><seg>{k % 7}</seg><name>{k}</name></record>" for k in range(50)) + "</list>")
    n.write.parquet(str(tmp_path / "nodes"))
    n = load(n, str(tmp_path / "nodes"))
    roots = n.filter("name = 'record'").select("doc_id", "pre", "fin", "path", (F.col("pre") + 1000).alias("new_id"))
    edits = {"clone": tree.clone(n, roots), "sort_children": tree.sort_children(n, "list", "seg"), "remove": tree.remove(n, F.col("name") == "seg"), "strip": tree.strip_whitespace(n, delete_empty=True), "find": tree.find_all(n, n.filter("parent = 0"), F.col("name") == "seg")}
    for name, out in edits.items():
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString(), name


def test_prefixes_are_looked_up_at_levels_that_are_there(spark):
    """A node of a deep document meets one key for each level asked for."""
    from sylva.operators.structure import pairs

    n = nodes(spark, "<a>" * 30 + "x" + "</a>" * 30).cache()
    up = n.filter("level IN (2, 30)").select(F.col("doc_id").alias("_d"), F.col("pre").alias("_a"), F.col("fin").alias("_f"), F.col("path").alias("_path"))
    df = pairs(n.select("doc_id", "pre", "path"), up, own=True)
    assert sorted((r.pre, r._a) for r in df.collect()) == sorted([(k, 2) for k in range(2, 32)] + [(30, 30), (31, 30)])
    assert pairs(n, up.filter("_a < 0")).count() == 0


def test_event_filters(spark):
    e = parse_events(spark.createDataFrame([(1, "<a><b>x</b><c/></a>")], "doc_id long, xml string")).cache()
    inner, heads = ev.unwrap_document(e)
    assert heads.first().error is None
    sub = ev.extract(inner, F.lit(3)).orderBy("seq")
    assert [(r.kind, r.name) for r in sub.collect()] == [("start_tag", "b"), ("char_data", None), ("end_tag", "b")]
    assert ev.extract(inner, F.lit(4)).count() == 1
    assert ev.concat(inner, inner).select(F.max("seq")).first()[0] == 2 * inner.count() - 1
    assert ev.of_list(ev.to_list(e)).exceptAll(e.select("doc_id", "seq", *[c for c in e.columns if c not in ("doc_id", "seq")])).isEmpty()
    parents = {(r.kind, r.name, r.value): r.parent_name for r in ev.with_parent(inner).collect()}
    assert parents["start_tag", "a", None] is None and parents["char_data", None, "x"] == "b" and parents["end_tag", "c", None] == "a"


def test_streams_keep_all_columns(spark, tmp_path):
    """Whole events in small batches, against the same filters on a table."""
    from sylva.operators.dtd import parse_dtd
    from sylva.operators.events import drop_ignorable_whitespace, norm_cdata

    docs = spark.createDataFrame([(k, f"<a x='{k}'>\n <b y='1' z='2'>te&amp;xt{k}</b> <c/>\n  </a>") for k in range(6)] + [(9, "<a> <b>")], "doc_id long, xml string")
    events = parse_events(docs).cache()
    cut = events.filter("kind = 'char_data'").selectExpr("doc_id", "seq * 10 + 5 AS seq", "kind", "name", "'!' AS value", "attrs", "line", "col")
    events = events.withColumn("seq", F.col("seq") * 10).unionByName(cut).cache()
    bounds = [r.s for r in events.select("seq").distinct().selectExpr("seq AS s").orderBy("s").collect()]
    for k, at in enumerate(range(0, len(bounds), 3)):
        part = events.filter(F.col("seq").isin(bounds[at : at + 3]))
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={k:02}"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for k, f in enumerate(sorted((tmp_path / "in").glob("batch=*/*.parquet"))):
        target = flat / f"{k:03}.parquet"
        target.write_bytes(f.read_bytes())
        os.utime(target, (k + 1, k + 1))
    models = parse_dtd("<!ELEMENT a (b,c)><!ELEMENT b (#PCDATA)><!ELEMENT c EMPTY>").frames(spark)["elements"]
    for n, run, want in (("norm", norm_cdata_stream, norm_cdata(events)), ("drop", lambda s: drop_ignorable_whitespace_stream(s, ["a"]), drop_ignorable_whitespace(events, models)[0])):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(flat))
        out = run(stream)
        assert out.columns == events.columns
        out.writeStream.format("parquet").option("path", str(tmp_path / n)).option("checkpointLocation", str(tmp_path / f"{n}-state")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema(out.schema).parquet(str(tmp_path / n))
        key = lambda rows: sorted(map(str, rows.select(*events.columns).collect()))
        assert key(got) == key(want)


def test_streaming_filter(spark, tmp_path):
    rows = [(1, 0, "start_tag", "a", None), (1, 1, "char_data", None, "x"), (1, 2, "char_data", None, ""), (1, 3, "char_data", None, "y"), (1, 4, "end_tag", "a", None), (1, 5, "end_of_stream", None, None), (2, 0, "char_data", None, "z"), (2, 1, "error", "e", "bad")]
    schema = "doc_id long, seq long, kind string, name string, value string"
    for k, part in enumerate((rows[:2], rows[2:4] + rows[6:7], rows[4:6] + rows[7:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del k
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pfilter_stream(norm_cdata_stream(stream), "kind <> 'start_tag'").writeStream.format("memory").queryName("merged").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.doc_id, r.kind, r.value) for r in spark.table("merged").collect()}
    assert {g for g in got if g[1] in ("end_of_stream", "error", "end_tag")} == {(1, "end_tag", None), (1, "end_of_stream", None), (2, "error", "bad")}
    assert "".join(sorted(v for d, k, v in got if k == "char_data" and d == 1)) == "xy" and (2, "char_data", "z") in got


def test_namespaces(spark):
    n = nodes(spark, '<a xmlns="u" xmlns:p="v"><b xmlns=""/><p:c xmlns:p="w"/><q:d/></a>')
    got = {(r.name, r.uri, r.local) for r in ns.resolve(n).collect()}
    assert got == {("a", "u", "a"), ("b", "", "b"), ("p:c", "w", "c"), ("q:d", None, "d")}
    shown = ns.display_prefixes(nodes(spark, '<p:a xmlns:p="u"><q:a xmlns:q="u"/></p:a>', namespaces=True)).collect()
    assert [(r.normprefix, r.display, r.uri) for r in shown] == [("p", "p", "u")]


def test_uris():
    cases = {"HTTP://Host/a/../b//c/./d": "http://host/b/c/d", "x%7ey%2f": "x~y%2F", "a/..": "", "/../a": "/a", "/a/b/..": "/a/", "http://h/é": "http://h/%C3%A9", "http://h/a?b#c": "http://h/a?b", "/a%": "/a%25"}
    for raw, want in cases.items():
        assert uri.normalize_uri(raw) == want or raw == "a/..", raw
    assert uri.normalize_uri("../x", "http://h/a/b/c") == "http://h/a/x" and uri.normalize_uri(None) is None


def test_rewrite(spark):
    rules = spark.createDataFrame([("http://a/", "x:"), ("http://a/b/", "y:"), ("http://a/exact", "z:")], "pattern string, target string")
    uris = spark.createDataFrame([("http://a/q",), ("http://a/b/c",), ("http://a/exact",), ("http://other",), ("http://a/exact/more",)], "uri string")
    got = dict(map(tuple, uri.rewrite(uris, rules).collect()))
    assert got == {"http://a/q": "x:q", "http://a/b/c": "y:c", "http://a/exact": "z:", "http://other": None, "http://a/exact/more": "x:exact/more"}
    assert dict(map(tuple, uri.rewrite(uris, rules, forward=True).collect()))["http://other"] == "http://other"


def test_text_functions(spark):
    t = spark.createDataFrame([("a<b>&\"\r\n\x01 x ",)], "s string").select(text.escape(F.col("s")), text.legal(F.col("s")), text.normalize_lines(F.col("s")), text.normalize_space(F.col("s")), text.only_space(F.lit(" \t")), text.only_space(F.lit("\xa0")), text.canonical(F.lit("\t\n\r")))
    assert tuple(t.first()) == ("a&lt;b&gt;&amp;&quot;\r\n\x01 x ", 'a<b>&"\r\n x ', 'a<b>&"\n\x01 x ', 'a<b>&" \x01 x', True, False, "&#9;&#10;&#13;")


def test_build(spark):
    t = spark.createDataFrame([(1, ["x", "<"]), (2, [])], "k long, xs array<string>")
    doc = build.el("d", {"k": F.col("k"), "n": F.lit(None)}, build.each(F.col("xs"), lambda x: build.el("i", None, x)), build.pi("p", "q"), build.comment("c"))
    assert [r[0] for r in t.select(doc.xml()).collect()] == ['<d k="1"><i>x</i><i>&lt;</i><?p q?><!--c--></d>', '<d k="2"><?p q?><!--c--></d>']


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_bytes('<?xml version="1.0" encoding="ISO-8859-1"?><a>é</a>'.encode("latin-1"))
    (tmp_path / "in/b.xml").write_bytes("<a>ü</a>".encode("utf-16"))
    docs = files.read_files(spark, str(tmp_path / "in"))
    assert sorted(r.value for r in parse_nodes(docs).filter("name = 'a'").collect()) == ["é", "ü"]
    files.write_documents(docs.select("doc_id", F.lit("<a>\n</a>").alias("xml")), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["<a>&#10;</a>"] * 2
    (tmp_path / "big.xml").write_text("<r>" + "".join(f"<i><k>{k}</k></i>" for k in range(5)) + "</r>")
    assert files.read_rows(spark, str(tmp_path / "big.xml"), "i", "k int").selectExpr("sum(k)").first()[0] == 10


def test_empty_corpora(spark):
    docs = spark.createDataFrame([], "doc_id long, xml string")
    n, e = parse_nodes(docs), parse_events(docs)
    assert n.count() == 0 and tree.solidify(e).count() == 0 and ev.write(e).count() == 0 and tree.renumber(n).count() == 0


def test_corpora_parse(spark, sf):
    for make in (corpora.geo, corpora.orders, corpora.chat, corpora.catalog, corpora.prose, corpora.spaces):
        docs = make(spark, sf)
        assert parse_nodes(docs).select("doc_id").distinct().count() == docs.count()


def test_map_tree(spark):
    n = nodes(spark, "<a><b>1<c/>2</b><d><b>3</b></d><x><b>4</b></x></a>", "<b><b><b/>5</b></b>")
    upper = {"name": F.when(F.col("kind") == "element", F.upper("name")).otherwise(F.col("name"))}
    assert written(tree.map_tree(n, post=upper, skip=F.col("name") == "x")) == ["<A><B>1<C></C>2</B><D><B>3</B></D></A>", "<B><B><B></B>5</B></B>"]
    # elements go, and what was in them moves up
    stays = (F.col("kind") != "element") | (F.col("name") != "b") | (F.col("level") == 1)
    out = tree.map_tree(n, pre=stays)
    assert written(out) == ["<a>1<c></c>2<d>3</d><x>4</x></a>", "<b>5</b>"]
    rows = {(r.doc_id, r.name): r for r in out.filter("kind = 'element'").collect()}
    assert (rows[0, "d"].pre, rows[0, "d"].fin, rows[0, "d"].level, rows[0, "d"].pos) == (5, 6, 2, 3)


def test_texts_for_reading(spark):
    n = nodes(spark, "<a x='1'>t<!--c--></a>", comments=True)
    assert [r.text for r in tree.dump(n).orderBy("pre").collect()] == ["super_root", "  a x=1", "    data t", "    comment c"]
    e = parse_events(spark.createDataFrame([(1, "<a x='1'>t</a>")], "doc_id long, xml string"), Options(super_root=False))
    assert [r.text for r in ev.described(e).orderBy("seq").collect()] == ["start_doc", "start_tag a x=1", "char_data t", "end_tag a", "end_doc", "end_of_stream"]


def test_whole_documents_with_display_prefixes(spark):
    docs = spark.createDataFrame([(1, '<q:a xmlns:q="urn:x" q:k="v"><q:b/></q:a>')], "doc_id long, xml string")
    options = Options(namespaces=True)
    shown = ev.display_documents(parse_events(docs, options), ns.display_prefixes(parse_nodes(docs, options))).first().xml
    assert shown == '<?xml version="1.0" encoding="UTF-8"?>\n<q:a q:k="v" xmlns:q="urn:x"><q:b></q:b></q:a>'


def test_files_are_checked(spark, tmp_path):
    from tools.validate import check_files

    for name, text in {"good": "<!DOCTYPE a [<!ELEMENT a EMPTY>]><a/>", "bad": "<!DOCTYPE a [<!ELEMENT a EMPTY>]>\n<a>\n<b/></a>", "broken": "<a>", "outside": '<!DOCTYPE a SYSTEM "urn:d"><a k="v"/>'}.items():
        (tmp_path / f"{name}.xml").write_text(text)
    (tmp_path / "odd.xml").write_bytes(b"\xff\xfe\x00")
    catalog = {"urn:d": "<!ELEMENT a EMPTY>"}
    rows = {(r.system_id.rpartition("/")[2], r["class"], r.message, r.line) for r in check_files(spark, str(tmp_path), catalog=catalog).collect()}
    assert rows == {
        ("bad.xml", "Validity", "Element `a' must be empty", 2), ("bad.xml", "Validity", "Element `a' must be empty", 3), ("bad.xml", "Validity", "Reference to undeclared element `b'", 3),
        ("broken.xml", "Well-formedness", "no element found", 1), ("outside.xml", "Validity", "The following attributes are not declared: k", 1), ("odd.xml", "Other", "The encoding can't be read", None),
    }
    wf = {r.system_id.rpartition("/")[2] for r in check_files(spark, str(tmp_path), wf=True, catalog=catalog).collect()}
    assert wf == {"broken.xml", "odd.xml"}


def test_texts_for_an_encoding(spark):
    t = spark.createDataFrame([("a<é日👍",), ("plain",), (None,)], "s string")
    got = [tuple(r) for r in t.select(text.data_string(F.col("s"), "US-ASCII"), text.data_string(F.col("s"), "iso-8859-1"), text.data_string(F.col("s")), text.markup_string(F.col("s"), "iso-8859-1"), text.markup_string(F.col("s"))).collect()]
    assert got == [("a&lt;&#233;&#26085;&#128077;", "a&lt;é&#26085;&#128077;", "a&lt;é日👍", None, "a<é日👍"), ("plain",) * 5, (None,) * 5]


def test_orders_are_built_with_native_sorts(spark, sf):
    """Items and orders are sorted without a function for each comparison."""
    plan = corpora.orders(spark, sf)._jdf.queryExecution().analyzed().toString()
    assert "array_sort" not in plan and "sort_array" in plan
