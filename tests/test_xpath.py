import math

import pytest
from pyspark.sql import functions as F

from sylva.plans.path import PathError, parse, rewrite, type_of
from sylva.plans.xpath import evaluate, xpath
from sylva.sources.parser import Options
from sylva.sources.store import roundtrip
from sylva.sources.xml import parse_nodes

XML = """<!DOCTYPE a [<!ATTLIST b x ID #IMPLIED>]><a id="1"><b x="x1" n="1">t1<c/>t2</b><b x="x2" n="2"><c>5</c><!--k--><?pi data?></b><d xml:lang="en-US" n="3"><b>7</b></d></a>"""


@pytest.fixture(scope="module")
def nodes(spark):
    return parse_nodes(spark.createDataFrame([(1, XML)], "doc_id long, xml string")).cache()


# places: 0 super root, 1 a, 2 b, 3 "t1", 4 c, 5 "t2", 6 b, 7 c, 8 "5", 9 comment, 10 pi, 11 d, 12 b, 13 "7"
NODES = {
    "/": [0], "/a": [1], "//b": [2, 6, 12], "/a/b[2]/c": [7], "//b[position()=last()]": [6, 12], "//c/ancestor::*": [1, 2, 6], "//c[1]": [4, 7],
    "(//c)[1]": [4], "(//c)[last()]": [7], "/descendant::b[2]": [6], "//b[@n>1]": [6], "//b[c=5]": [6], "//b[.='7']": [12], "//@n/..": [2, 6, 11],
    "//b[lang('en')]": [12], "//b[lang('en-us')]": [12], "//b[lang('e')]": [], "//b/preceding-sibling::*[1]": [2], "//d/preceding-sibling::b[1]": [6], "//d/preceding-sibling::b[2]": [2],
    "//node()[self::comment()]": [9], "//processing-instruction()": [10], "//processing-instruction('other')": [], "//text()": [3, 5, 8, 13],
    "//c[string-length(.)=0]": [4], "//b[not(@x)]": [12], "//b[@n < count(//b)]": [2, 6], "//b[position()>1][1]": [6], "//b[last()][c]": [6],
    "id('x2 x1 nope')": [2, 6], "id('x2')/c": [7], "id(//b/@x)": [2, 6], "//b[2]/following::node()": [11, 12, 13], "//d/preceding::c": [4, 7],
    "/a/b[1]/@n/following::c": [4, 7], "//*[count(*)>1]": [1], "//b[1.5]": [], "//b[0]": [], "//b['']": [], "//b['x']": [2, 6, 12], "//b[true()]": [2, 6, 12],
    "//c/ancestor-or-self::*": [1, 2, 4, 6, 7], "//b/descendant-or-self::b": [2, 6, 12], "//b | //c | //b": [2, 4, 6, 7, 12], "//a//b/.": [2, 6, 12], "//d/b/../..": [1],
    "/a/*[self::d or self::c]": [11], "//b[c[.=5]]": [6], "//b[c and @n=1]": [2], "//*[@n mod 2 = 1]": [2, 11], "/child::a/child::b[position()=2]": [6], "//c/following-sibling::text()": [5],
    "//b[.//text()]": [2, 6, 12], "//*[name()='d']": [11], "//*[local-name()='b' and @x='x2']": [6], "//b[../@id = 1]": [2, 6], "//c[../@n = 2]": [7], "//b[@n != //d/@n]": [2, 6],
    "//b[@n = //d/@n - 1]": [6], "descendant-reverse::b[1]": [12], "/a/child-reverse::*[1]": [11],
}

VALUES = {
    "count(//b)": 3.0, "sum(//b/@n)": 3.0, "string(//b)": "t1t2", "string(//zz)": "", "1 div 0": math.inf, "-1 div 0": -math.inf, "-7 mod 2": -1.0, "7 mod -2": 1.0, "5 mod 0": math.nan,
    "0 div 0": math.nan, "1.5 mod 0.5": 0.0, "concat('a', 1.5, true())": "a1.5true", "boolean(//zz)": False, "boolean('false')": True, "boolean(0)": False, "substring('12345', 1.5, 2.6)": "234",
    "substring('12345', 0, 3)": "12", "substring('12345', 0 div 0, 3)": "", "substring('12345', 1, 0 div 0)": "", "substring('12345', -42, 1 div 0)": "12345", "substring('12345', -1 div 0, 1 div 0)": "",
    "substring('12345', 2)": "2345", "substring('12345', 4, -1)": "", "translate('bar', 'abc', 'AB')": "BAr", "translate('--aaa--', 'abc-', 'ABC')": "AAA", "translate('aba', 'aa', 'xy')": "xbx",
    "substring-after('1999/04', '/')": "04", "substring-after('x', '')": "x", "substring-before('1999/04', '/')": "1999", "substring-before('x', 'y')": "", "contains('x', '')": True,
    "starts-with('xy', 'x')": True, "normalize-space('  a \n b ')": "a b", "string-length('é👍')": 2.0, "number('abc')": math.nan, "number(' -12.5 ')": -12.5, "number('1e3')": math.nan, "number('+1')": math.nan,
    "number(true())": 1.0, "floor(-1.5)": -2.0, "ceiling(1.2)": 2.0, "round(2.5)": 3.0, "round(-2.5)": -2.0, "round(0 div 0)": math.nan, "string(1 div 3)": "0.3333333333333333", "string(-0.5)": "-0.5",
    "string(1000000 * 1000000 * 1000000 * 1000000)": "1000000000000000000000000", "string(0.0000001)": "0.0000001", "string(5)": "5", "string(-0)": "0", "string(0 div 0)": "NaN", "string(-1 div 0)": "-Infinity",
    "not(//zz)": True, "//b = '7'": True, "//b != '7'": True, "//zz = //zz": False, "//b = //c": True, "//b/@n < //c": True, "//b/@n > //d/@n": False, "'a' < 'b'": False, "1 < 2 and 2 < 3 or false()": True,
    "true() = 'x'": True, "true() = 2": True, "//zz = false()": True, "1 = '1'": True, "0 div 0 = 0 div 0": False, "0 div 0 != 0 div 0": True, "name(//@xml:lang)": "xml:lang", "position() + last()": 2.0, "2 + 3 * 4 - -1": 15.0,
    "count(//b[c]/following::node())": 8.0, "count(//node())": 13.0, "count(//@*)": 7.0, "string(//comment())": "k", "string(//processing-instruction())": "data", "lang('en')": False,
}


@pytest.mark.parametrize("path", NODES)
def test_node_sets(nodes, path):
    rows = evaluate(nodes, path).collect()
    assert sorted(r.pre for r in rows) == NODES[path]


@pytest.mark.parametrize("path", VALUES)
def test_values(nodes, path):
    ((value,),) = evaluate(nodes, path).select("value").collect()
    want = VALUES[path]
    assert type(value) is type(want) and (value == want or value != value and want != want)


def test_variables_and_user_functions(nodes):
    twice = {"twice": ("number", ["number"], lambda x: x * 2)}
    assert evaluate(nodes, "twice(count(//b)) + $k", {"k": 1}, twice).first().value == 7.0
    assert evaluate(nodes, "//b[@x = $id]", {"id": "x2"}).first().pre == 6
    assert evaluate(nodes, "//b[$n]", {"n": 2}).count() == 0 or evaluate(nodes, "/a/b[$n]", {"n": 2}).first().pre == 6


def test_namespaces(spark):
    docs = spark.createDataFrame([(1, '<p:a xmlns:p="u" xmlns="v"><b p:c="1"/><q:b xmlns:q="u"/></p:a>')], "doc_id long, xml string")
    on = Options(namespaces=True)
    assert [r.name for r in xpath(docs, "//p:b", on).collect()] == ["p:b"]
    assert xpath(docs, "//p:*", on).count() == 2
    assert xpath(docs, "string(//@p:c)", on).first().value == "1"
    assert xpath(docs, "namespace-uri(//@p:c)", on).first().value == "u"
    assert xpath(docs, "count(/*/namespace::*)", on).first().value == 3.0
    # names are shown with the prefixes of the document
    assert [xpath(docs, f"name({p})", on).first().value for p in ("/*", "//*[local-name()='b'][1]", "//@p:c", "//*[2]/@*")] == ["p:a", "b", "p:c", ""]


@pytest.mark.parametrize("path", ["", "//", "a[", "f(", "nosuch(1)", "count()", "a b", "$v", "a/b::c", "concat('x')", "1 2"])
def test_bad_paths(nodes, path):
    with pytest.raises(PathError):
        evaluate(nodes, path)


def test_rewrites():
    assert [s.axis for s in rewrite(parse("//a").steps)] == ["descendant"]
    assert [s.axis for s in rewrite(parse("//a[@x]").steps)] == ["descendant"]
    assert [s.axis for s in rewrite(parse("//a[1]").steps)] == ["descendant-or-self", "child"]
    assert [s.axis for s in rewrite(parse("//a[last()]").steps)] == ["descendant-or-self", "child"]
    assert type_of(parse("//a | b")) == "nodeset"


def test_second_opinion(spark, sf):
    """Spark's own xpath functions on paths that they can do."""

    from sylva.sources import corpora

    docs = corpora.geo(spark, sf)
    for path in ("/region/nation/@name", "/region/nation/customer[@seg='BUILDING']/@key", "//customer[2]/text()", "//nation[last()]/customer/@bal", "/region/nation[3]/preceding-sibling::nation/@key"):
        mine = {r.doc_id: r.v for r in xpath(docs, path).groupBy("doc_id").agg(F.array_sort(F.collect_list("value")).alias("v")).collect()}
        theirs = {r.doc_id: r.v for r in docs.select("doc_id", F.array_sort(F.expr(f'xpath(xml, "{path}")')).alias("v")).collect() if r.v}
        assert mine == theirs


def test_plans_join_on_documents(spark, sf):
    """No step may fall back to a nested loop."""
    from sylva.sources import corpora

    for path in ("//customer[@seg='BUILDING']/ancestor::*", "/region/nation[2]/following::customer", "//nation[customer/@bal > 9000]", "//*[@key = //nation/@key]"):
        plan = xpath(corpora.geo(spark, sf), path)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_structural_joins_meet_by_keys(spark):
    """Each step of //a//b, ancestors and lang joins on the document and a key of paths;
    twice the nodes of a document make twice the rows that are joined, not four times."""
    from sylva.operators.structure import keys_above

    made = []
    for n in (200, 400):
        docs = spark.createDataFrame([(1, "<r>" + "<a><b><c/></b></a>" * n + "</r>")], "doc_id long, xml string")
        nodes = roundtrip(parse_nodes(docs), "nodes")
        assert evaluate(nodes, "count(//a//c)").first().value == n and evaluate(nodes, "//c/ancestor::a").count() == n
        made.append(nodes.filter("name = 'c'").select(F.explode(keys_above("path"))).count())
        for path in ("//a//c", "//c/ancestor::a", "//a/descendant-or-self::b", "//c[lang('en')]"):
            plan = evaluate(nodes, path)._jdf.queryExecution().optimizedPlan().toString()
            assert "xxhash64" in plan, path
    assert made[1] == 2 * made[0]


def test_attributes_are_read_on_the_row(spark):
    docs = spark.createDataFrame([(1, "<r><a x='1' y='2'/><a x='3'/><a/></r>")], "doc_id long, xml string")
    nodes = roundtrip(parse_nodes(docs), "nodes")
    for path, want in (("//a[@x='1']", 1), ("//a[@x]", 2), ("//a[not(@x)]", 1), ("//a[@x > 1 and not(@y)]", 1), ("//a[count(@*) = 2]", 1), ("//a[@x != @y]", 1), ("//a[@x < @y]", 1), ("//a[sum(@*) = 3]", 2), ("//a/@*", 3), ("//a[string(@x) = '']", 1), ("//a[@x = 1]/@y", 1)):
        df = evaluate(nodes, path)
        assert df.count() == want, path
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString(), path
