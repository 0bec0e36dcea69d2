import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.operators import events as ev
from sylva.operators import tree
from sylva.sources.files import decode
from sylva.sources.parser import Columns, Options, Prefixes, read, read_nodes
from sylva.sources.xml import diagnostics, parse_events, parse_nodes


def kinds(xml, **options):
    return [(e.kind, e.name, e.value) for e in read(xml, Options(**options))]


def test_events_of_a_document():
    got = kinds("<a x='1'><!--c-->t<![CDATA[<&]]><b/><?p d?></a>")
    assert got == [
        ("start_doc", None, None), ("start_super", None, None), ("start_tag", "a", None), ("comment", None, "c"), ("char_data", None, "t<&"),
        ("start_tag", "b", None), ("end_tag", "b", None), ("pinstr", "p", "d"), ("end_tag", "a", None), ("end_super", None, None), ("end_doc", None, None), ("end_of_stream", None, None),
    ]


def test_switches():
    got = kinds("<a><!--c--><?p d?></a>", comments=False, pinstr=False, super_root=False)
    assert [k for k, _, _ in got] == ["start_doc", "start_tag", "end_tag", "end_doc", "end_of_stream"]


MALFORMED = ["<doc", "<doc><a</a></doc>", "<a></b>", "<a/><b/>", "text", "<a x=1/>", "<a x='1' x='2'/>", "<a>&undefined;</a>", "<a>]]></a>", "<a b='<'/>", "<a><!-- -- --></a>", "<?xml version='1.0'?><?xml version='1.0'?><a/>", "<a>\x01</a>", "<1a/>", "", "<a>&#0;</a>", "<!DOCTYPE a [<!ENTITY e '&e;'>]><a>&e;</a>", "<a><?xml x?></a>", "<a/>trailing"]


@pytest.mark.parametrize("xml", MALFORMED)
def test_malformed_ends_with_an_error(xml):
    events, rows = read(xml, Options()), Columns()
    assert events[-1].kind == "error" and events[-1].name == "Well-formedness"
    assert not read_nodes(1, xml, Options(), rows) and not any(rows._lists())


def test_error_positions():
    e = read("<doc>\n  <a</a></doc>", Options())[-1]
    assert e.line == 2


def test_entities_come_from_the_catalog_only():
    xml = "<!DOCTYPE a SYSTEM 'd.dtd' [<!ENTITY e SYSTEM 'e.xml'>]><a>&e;</a>"
    catalog = {"d.dtd": "<!ATTLIST a k CDATA 'v'>", "e.xml": "<b>in</b>"}
    events = read(xml, Options(catalog=catalog))
    assert [(e.kind, e.name, e.attrs) for e in events if e.kind == "start_tag"] == [("start_tag", "a", [("k", "v")]), ("start_tag", "b", [])]
    assert read(xml, Options(catalog={"d.dtd": ""}))[-1].kind == "error"


def test_catalog_functions_and_braces():
    xml = "<!DOCTYPE a [<!ENTITY e SYSTEM 'e.xml'>]><a k='{{x}'>&e;{</a>"
    o = Options(catalog=lambda system, public: f"<b>{system}</b>", escape_contents=lambda t: {"{": "(", "}": ")"}.get(t, t[0]), escape_attributes=lambda t: t[0])
    e = read(xml, o)
    assert [(x.kind, x.name, x.value, x.attrs) for x in e if x.kind in ("start_tag", "char_data")] == [("start_tag", "a", None, [("k", "{x}")]), ("start_tag", "b", None, []), ("char_data", None, "e.xml", []), ("char_data", None, "(", [])]


def test_expressions(spark):
    got = [(e.kind, e.name, e.value) for e in read("<!--c-->t<b/>", Options(entry="expr", super_root=False))]
    assert got == [("start_doc", None, None), ("comment", None, "c"), ("char_data", None, "t"), ("start_tag", "b", None), ("end_tag", "b", None), ("end_doc", None, None), ("end_of_stream", None, None)]
    docs = spark.createDataFrame([(1, "<?p q?><b>x</b>y")], "doc_id long, xml string")
    assert [(r.pre, r.fin, r.level, r.kind, r.value) for r in parse_nodes(docs, Options(entry="expr")).orderBy("pre").collect()] == [(0, 4, 0, "super_root", "xy"), (1, 1, 1, "pinstr", "q"), (2, 3, 1, "element", "x"), (3, 3, 2, "data", "x"), (4, 4, 1, "data", "y")]
    assert read("<b>", Options(entry="expr"))[-1].kind == "error"


def test_expansion_is_bounded():
    bombs = "".join(f"<!ENTITY e{k} '{f'&e{k - 1};' * 10 if k else 'x' * 1000}'>" for k in range(9))
    assert read(f"<!DOCTYPE a [{bombs}]><a>&e8;</a>", Options())[-1].kind == "error"


def test_prefixes():
    p = Prefixes()
    assert [p.add("p", "u1"), p.add("q", "u1"), p.add("p", "u2"), p.add("", "u3"), p.add("", "u4")] == ["p", "p", "p1", "1", "2"]


def test_namespaces():
    e = read('<a xmlns="u" xmlns:p="v"><p:b p:x="1" y="2"/></a>', Options(namespaces=True))
    (a, b) = [x for x in e if x.kind == "start_tag"]
    assert a.name == "1:a" and b.name == "p:b" and b.attrs == [("p:x", "1"), ("y", "2")]
    assert read("<q:a/>", Options(namespaces=True))[-1].name == "Namespace"
    assert read('<a xmlns:p="u" xmlns:q="u" p:x="" q:x=""/>', Options(namespaces=True))[-1].name == "Namespace"


def test_encodings():
    text = '<?xml version="1.0" encoding="ISO-8859-1"?><a>é</a>'
    assert decode(text.encode("latin-1")) == text
    assert decode("<a>é</a>".encode("utf-16")) == "<a>é</a>"
    assert decode("<a>é</a>".encode()) == "<a>é</a>" and decode(b"\xff\xfe\xff") is None
    assert decode("<a>é</a>".encode("cp1250"), "cp1250") == "<a>é</a>"
    assert read(text, Options())[-1].kind == "end_of_stream"


NAMES = st.sampled_from(["a", "b", "c"])
TREES = st.recursive(
    st.one_of(st.sampled_from(["x", " ", "é&<>\"'"]).map(lambda t: ("t", t)), st.just(("c", "note")), st.just(("p", "data"))),
    lambda kids: st.tuples(NAMES, st.dictionaries(NAMES, st.sampled_from(["1", "é", '<&">'])), st.lists(kids, max_size=4)),
    max_leaves=14,
)


def esc(t):
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def render(t):
    if t[0] in ("t", "c", "p") and isinstance(t[1], str):
        return {"t": esc(t[1]), "c": "<!--note-->", "p": "<?pi data?>"}[t[0]]
    attrs = "".join(f' {k}="{esc(v)}"' for k, v in sorted(t[1].items()))
    return f"<{t[0]}{attrs}>{''.join(map(render, t[2]))}</{t[0]}>"


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(NAMES, st.just({}), st.lists(TREES, max_size=4)), min_size=1, max_size=12))
def test_symmetry(spark, trees):
    """events = liquefy(nodes); nodes = solidify(events); canonical text comes back."""
    docs = spark.createDataFrame([(k, render(t)) for k, t in enumerate(trees)], "doc_id long, xml string")
    events = parse_events(docs).cache()
    inner = ev.unwrap_document(events)[0]
    nodes = parse_nodes(docs).cache()
    key = ["doc_id", "kind", "name", "value"]
    rows = lambda d: [tuple(r) for r in d.orderBy("doc_id", "seq").select(*key).collect()]
    assert rows(tree.liquefy(nodes)) == rows(inner)
    solid = tree.solidify(events).cache()
    cols = ["doc_id", "pre", "fin", "level", "parent", "pos", "kind", "name"]
    assert sorted(map(tuple, solid.select(*cols).collect()), key=str) == sorted(map(tuple, nodes.filter("pre > 0").select(*cols).collect()), key=str)
    assert rows(tree.liquefy(solid)) == rows(inner)
    assert {r.doc_id: r.xml for r in ev.write(events).collect()} == dict(docs.collect())
    again = tree.renumber(nodes.withColumn("pre", nodes["pre"] * 0 - 1))
    assert sorted(map(tuple, again.select(*cols, "path").collect()), key=str) == sorted(map(tuple, nodes.select(*cols, "path").collect()), key=str)
    assert ev.errors(inner).count() == 0


def test_stream_errors(spark):
    docs = spark.createDataFrame([(1, "<a><b/></a>")], "doc_id long, xml string")
    e = parse_events(docs)
    swapped = e.withColumn("seq", e["seq"] * -1)
    assert ev.errors(swapped).count() > 0
    assert ev.errors(e.filter("name = 'a' AND kind = 'start_tag'")).filter("message = 'elements are not closed'").count() == 1


def test_diagnostics(spark):
    docs = spark.createDataFrame([(1, "<a/>"), (2, "<a>"), (3, None)], "doc_id long, xml string")
    assert {(r.doc_id, r["class"]) for r in diagnostics(docs).collect()} == {(2, "Well-formedness"), (3, "Other")}
    assert {r.doc_id for r in parse_nodes(docs).collect()} == {1}


def test_plain_text_is_no_expansion():
    """Only entities count against the limit, and long texts take linear time."""
    import time

    from sylva.sources import parser

    long = "<a>" + "x" * (70 << 20) + "</a>"
    began = time.time()
    events = read(long, Options())
    assert [e.kind for e in events if e.kind == "error"] == [] and max(len(e.value or "") for e in events) == 70 << 20
    to = Columns()
    assert read_nodes(1, long, Options(), to) and len(to.value[-1]) == 70 << 20
    assert time.time() - began < 60
    bomb = '<!DOCTYPE a [<!ENTITY e SYSTEM "urn:e">]><a>' + "&e;" * 9 + "</a>"
    assert read(bomb, Options(catalog={"urn:e": "y" * (parser.MAX_EXPANSION // 8)}))[-1].kind == "error"


def test_events_leave_while_a_document_is_read():
    from sylva.sources.parser import CHUNK, iterate

    xml = "<a>" + "<b>text</b>" * (CHUNK // 4) + "<c></a>"
    it = iterate(xml, Options())
    first = [next(it) for _ in range(10)]
    assert [e.kind for e in first[:4]] == ["start_doc", "start_super", "start_tag", "start_tag"] and first[4].value == "text"
    rest = list(it)
    assert rest[-1].kind == "error" and sum(e.kind == "char_data" for e in rest) + 2 == CHUNK // 4
    # a text that runs over chunks is one event
    whole = [e for e in iterate("<a>" + "word " * CHUNK + "</a>", Options()) if e.kind == "char_data"]
    assert len(whole) == 1 and len(whole[0].value) == 5 * CHUNK


def test_system_ids_are_relative_to_their_entity():
    catalog = {"http://h/x/one.ent": '<b/>&two;', "http://h/y/two.ent": "<c/>", "http://h/x/d.dtd": '<!ENTITY one SYSTEM "one.ent"><!ENTITY two SYSTEM "../y/two.ent">'}
    xml = '<!DOCTYPE a SYSTEM "x/d.dtd"><a>&one;</a>'
    names = [e.name for e in read(xml, Options(catalog=catalog, base="http://h/doc.xml")) if e.kind == "start_tag"]
    assert names == ["a", "b", "c"]
    assert read(xml, Options(catalog=catalog, base="http://other/doc.xml"))[-1].kind == "error"


def test_without_positions():
    assert {(e.line, e.col) for e in read("<a>\n<b/></a>", Options(positions=False, super_root=False)) if e.kind != "start_doc"} == {(None, None)}
    to = Columns()
    read_nodes(1, "<a>\n<b/></a>", Options(positions=False), to)
    assert to.line[1:] == [None] * (len(to) - 1)


def test_errors_name_their_entity():
    xml = '<!DOCTYPE a [<!ENTITY e SYSTEM "urn:e"><!ENTITY f SYSTEM "urn:f">]><a>&e;</a>'
    events = read(xml, Options(catalog={"urn:e": "<b>&f;</b>", "urn:f": "<c>\n</d>"}))
    assert (events[-1].kind, events[-1].attrs, events[-1].line) == ("error", [("entity", "urn:f")], 2)
    assert read("<a>", Options())[-1].attrs == [("entity", "[toplevel]")]


def test_large_documents_leave_in_parts(monkeypatch):
    """Parts have the rows that the whole has, none is large, and what isn't well-formed
    gives none; a reader is gone when its document is."""
    import gc

    from sylva.sources import parser, xml as reader

    monkeypatch.setattr(parser, "CHUNK", 300)
    body = "".join(f"<b k='{k}'>t<c/>&amp;<!--x--><n:d xmlns:n='v{k % 3}' n:a='1'/>{'long ' * (k % 50)}</b>tail" for k in range(400))
    xml = f"<a xmlns='u'><e>{body}</e>end</a>"
    for options in (Options(), Options(namespaces=True)):
        to = Columns()
        assert read_nodes(1, xml, options, to)
        whole = {r["pre"]: r for r in reader._batch(to, options.namespaces).to_pylist()}
        gc.disable()
        try:
            parts = [(reader._batch(rows, options.namespaces), last, len(rows)) for rows, last in parser.stream_nodes(1, xml, options, Columns(), 100, 1000)]
            assert not any(isinstance(x, parser._Reader) for x in gc.get_objects())
        finally:
            gc.enable()
        rows = [r for batch, _, _ in parts for r in batch.to_pylist()]
        assert [last for _, last, _ in parts].count(False) > 20 and max(n for _, _, n in parts) < 200
        for r in rows + list(whole.values()):
            r["line"] = r["col"] = 0  # of a text, they depend on the chunks
        assert len(rows) == len(whole) and all(r == whole[r["pre"]] for r in rows)
        for bad in (xml[:-1], xml + "<", xml.replace("tail</e>", "&nope;</e>"), None):
            assert [(len(rows), last) for rows, last in parser.stream_nodes(1, bad, options, Columns(), 100, 1000)] == [(0, True)]


def test_batches_are_bounded_by_their_text(spark):
    """Few rows with long texts are a batch."""
    import pyarrow as pa

    from sylva.sources import xml as reader

    class Docs:
        sparkSession = spark
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    docs = pa.record_batch([pa.array(range(40)), pa.array(["<a>" + "x" * 10**6 + "</a>"] * 40)], names=["doc_id", "xml"])
    for parse in (parse_nodes, parse_events):
        batches = [b.num_rows for b in parse(Docs())(iter([docs]))]
        assert sum(batches) > 100 and len(batches) >= 40 * 10**6 // (2 * reader.CHARS)
