"""Queries of the XML engine over corpora built from the relational tables, each with
SQL over those tables that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva import ship
from sylva.functions import build, text
from sylva.functions import xpath as fn
from sylva.operators import events as ev
from sylva.operators import namespaces as ns
from sylva.operators import tree
from sylva.operators.dtd import dtds_of, parse_dtd, read_dtds, written
from sylva.operators.structure import wide
from sylva.operators.validate import Validator
from sylva.plans.xpath import evaluate, xpath
from sylva.sources import corpora, store, uri
from sylva.sources.parser import Options
from sylva.sources.xml import attributes, diagnostics, parse_events, parse_nodes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def nodes(spark: SparkSession, sf: str, corpus: str, options: Options = Options()) -> DataFrame:
    """The node table of a corpus, parsed once and stored: most plans read it often."""
    return store.roundtrip(parse_nodes(getattr(corpora, corpus)(spark, sf), options), "nodes")


def xp(name: str, corpus: str, path: str, sql: str, shape: Callable[[DataFrame], DataFrame] | None = None, **settings) -> None:
    """A query that evaluates one path on every document of a corpus."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        # no path asks for lines and columns
        out = evaluate(nodes(spark, sf, corpus, Options(positions=False)), path, **settings)
        if shape:
            return shape(out)
        return out.select("doc_id", "pre", "value") if "pre" in out.columns else out

    query(name, sql)(run)


#: The geo corpus by place: nation j of its region; customer k of its region and i of
#: the m of its nation. A region is node 1, its nation j is 1 + j + 2 x customers before.
GEO = """
WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS j FROM nation),
c0 AS (SELECT doc_id, n_nationkey, n_name, j, c_custkey, c_name, c_mktsegment AS seg, c_acctbal AS bal,
  row_number() OVER (PARTITION BY doc_id ORDER BY n_nationkey, c_custkey) AS k,
  row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS i,
  count(*) OVER (PARTITION BY n_nationkey) AS m
  FROM n JOIN customer ON c_nationkey = n_nationkey),
c AS (SELECT *, CAST(2 + j + 2 * (k - 1) AS BIGINT) AS pre, CAST(1 + j + 2 * (k - i) AS BIGINT) AS npre FROM c0),
nn AS (SELECT doc_id, n_nationkey, n_name, j, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS m FROM n),
np AS (SELECT *, CAST(1 + j + 2 * coalesce(sum(m) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pre FROM nn),
r AS (SELECT CAST(r_regionkey AS BIGINT) AS doc_id, r_name FROM region)
"""
#: The catalog corpus: part k is child i of its brand. Below it are its text, an x in
#: every 19th, and a b, which has a text in every 31st.
CAT = """
WITH p0 AS (SELECT min(p_partkey) OVER (PARTITION BY p_brand) AS doc_id, p_brand, p_partkey AS k, p_name, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i,
  2 + CAST(p_partkey % 19 = 0 AS INTEGER) + CASE WHEN p_partkey % 31 = 0 THEN 2 WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS size FROM part),
p AS (SELECT *, CAST(2 + coalesce(sum(size) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pre FROM p0)
"""


def money(x: str) -> str:
    return f"printf('%.2f', {x})"


def esc(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def canon(x: str) -> str:
    return f"replace(replace(replace({esc(x)}, chr(9), '&#9;'), chr(10), '&#10;'), chr(13), '&#13;')"


# ---- sources, sinks, parsing


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The balances of one segment by region, through a path."""
    found = evaluate(nodes(spark, sf, "geo"), "sum(/region/nation/customer[@seg='BUILDING']/@bal)")
    return found.select("doc_id", F.round("value", 2).alias("total"))


query("xp_sum_path", GEO + "SELECT r.doc_id, round(coalesce(sum(CAST(" + money("bal") + " AS DOUBLE)), 0), 2) AS total FROM r LEFT JOIN (SELECT * FROM c WHERE seg = 'BUILDING') c ON r.doc_id = c.doc_id GROUP BY r.doc_id")(flagship)


@query("src_from_string", "SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 'region' AS root FROM region")
def _(spark, sf):
    return parse_nodes(corpora.geo(spark, sf)).filter("parent = 0").select("doc_id", F.col("name").alias("root"))


@query("entity_catalog_join", "SELECT c_custkey AS ref_id, CASE WHEN c_custkey % 2 = 0 THEN n_name WHEN c_nationkey % 5 <> 0 THEN 'system ' || n_name END AS text FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, sf):
    n = corpora.table(spark, sf, "nation")
    k = F.col("n_nationkey").cast("string")
    catalog = n.select(F.concat(F.lit("-//N//"), k).alias("public_id"), F.lit(None).cast("string").alias("system_id"), F.col("n_name").alias("text")).unionByName(
        n.filter("n_nationkey % 5 <> 0").select(F.lit(None).cast("string").alias("public_id"), F.concat(F.lit("urn:n:"), k).alias("system_id"), F.concat(F.lit("system "), "n_name").alias("text"))
    )
    c = corpora.table(spark, sf, "customer")
    refs = c.select(F.col("c_custkey").alias("ref_id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  -//N//"), "c_nationkey", F.lit("\n"))).alias("public_id"), F.concat(F.lit("urn:n:"), "c_nationkey").alias("system_id"))
    return uri.resolve(refs, catalog).select("ref_id", "text")


@query("uri_normalize", r"SELECT page_id, regexp_replace(rtrim(regexp_replace(url, '[?#].*', ''), '/'), '/[^/]*$', '') || '/a/b~' AS uri FROM pages")
def _(spark, sf):
    ship(spark)
    p = corpora.table(spark, sf, "pages")
    wild = F.concat(F.regexp_replace("url", "[?#].*", ""), F.lit("/../a//./b%7e#x"))
    return p.select("page_id", uri.normalize_column(wild, F.lit("http://base.example/x/")).alias("uri"))


_RULES = [("https://", "mirror:s/"), ("http://", "mirror:p/")]


@query("uri_rewrite", "SELECT url, CASE WHEN starts_with(url, 'https://') THEN 'mirror:s/' || substr(url, 9) WHEN starts_with(url, 'http://') THEN 'mirror:p/' || substr(url, 8) ELSE url END AS rewritten FROM pages")
def _(spark, sf):
    rules = spark.createDataFrame(_RULES, "pattern string, target string")
    p = corpora.table(spark, sf, "pages").select(F.col("url").alias("uri"))
    return uri.rewrite(p, rules, forward=True).select(F.col("uri").alias("url"), "rewritten")


@query("parse_nodes", GEO + """
SELECT doc_id, CAST(1 AS BIGINT) AS pre, CAST(1 + (SELECT count(*) FROM n WHERE n.doc_id = r.doc_id) + 2 * (SELECT count(*) FROM c WHERE c.doc_id = r.doc_id) AS BIGINT) AS fin, 'region' AS name, 1 AS level FROM r
UNION ALL SELECT doc_id, pre, CAST(pre + 2 * m AS BIGINT), 'nation', 2 FROM np
UNION ALL SELECT doc_id, pre, CAST(pre + 1 AS BIGINT), 'customer', 3 FROM c""")
def _(spark, sf):
    return parse_nodes(corpora.geo(spark, sf)).filter("kind = 'element'").select("doc_id", "pre", "fin", "name", "level")


@query("wf_check", """SELECT p_partkey AS doc_id, 'error' AS severity, 'Well-formedness' AS class, message, '[toplevel]' AS entity, CAST(1 + p_partkey % 7 AS INTEGER) AS line, CAST(col AS INTEGER) AS col FROM part,
  (VALUES (1, 'mismatched tag', 8), (2, 'undefined entity', 3), (3, 'duplicate attribute', 9), (4, 'no element found', 3)) AS t(r, message, col) WHERE p_partkey % 5 = r""")
def _(spark, sf):
    """A document for each part, four in five broken in a known place."""
    broken = F.element_at(F.array(*map(F.lit, ["<a><b></b></a>", "<a><b></a></b>", "<a>&nope;</a>", '<a x="1" x="2"/>', "<a>"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    xml = F.concat(F.repeat(F.lit("\n"), (F.col("p_partkey") % 7).cast("int")), broken)
    return diagnostics(corpora.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), xml.alias("xml")))


_TURN = "conv_id * 1000 + turn"


@query("parse_fragment", f"SELECT {_TURN} AS doc_id, role, text FROM conversations")
def _(spark, sf):
    c = corpora.table(spark, sf, "conversations")
    xml = build.el("turn", {"role": F.col("role")}, F.col("text")).xml()
    n = parse_nodes(c.select(F.expr(_TURN).alias("doc_id"), xml.alias("xml")), Options(entry="content"))
    return n.filter("parent = 0").select("doc_id", F.col("attrs")[0]["value"].alias("role"), F.col("value").alias("text"))


DTD = parse_dtd(corpora.CATALOG_DTD, root="brand")


def _dtds(spark: SparkSession, sf: str, *parts: Column | str) -> dict[str, DataFrame]:
    """The tables of a DTD for each part, whose key is the id."""
    none = F.lit(None).cast("string")
    text = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    rows = corpora.table(spark, sf, "part").select(F.col("p_partkey").alias("dtd_id"), F.lit("r").alias("root"), none.alias("public_id"), none.alias("system_id"), F.lit("").alias("internal"), text.alias("external"))
    return read_dtds(rows)


def _key() -> Column:
    return F.col("p_partkey").cast("string")


def _mod(n: int) -> Column:
    return (F.col("p_partkey") % n).cast("string")


@query("dtd_elements", "SELECT p_partkey AS dtd_id, name || CASE WHEN own THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS name, kind AS model_kind, CASE kind WHEN 'mixed' THEN 'e' || p_partkey ELSE '' END AS allowed FROM part, (VALUES ('e', true, 'empty'), ('m', false, 'mixed'), ('r', false, 'regexp')) AS t(name, own, kind)")
def _(spark, sf):
    found = _dtds(spark, sf, "<!ELEMENT e", _key(), " EMPTY><!ELEMENT m (#PCDATA|e", _key(), ")*><!ELEMENT r (m?,e", _key(), ")>")["elements"]
    return found.select("dtd_id", "name", "model_kind", F.array_join("allowed", ",").alias("allowed"))


@query("dtd_write", """SELECT p_partkey, '<!NOTATION n SYSTEM "s">' || chr(10) || '<!ELEMENT e' || p_partkey || ' EMPTY>' || chr(10) || '<!ATTLIST e' || p_partkey || ' a CDATA "&lt;' || p_size || '">' || chr(10)
  || '<!ATTLIST e' || p_partkey || ' b (x|y) #IMPLIED>' || chr(10) AS text FROM part""")
def _(spark, sf):
    ship(spark)
    text = F.concat(F.lit("<!-- c --><!ELEMENT  e"), _key(), F.lit(" EMPTY ><!ATTLIST e"), _key(), F.lit(" a  CDATA '&lt;"), F.col("p_size").cast("string"), F.lit("' b ( x | y ) #IMPLIED><!NOTATION n SYSTEM 's'>"))
    return corpora.table(spark, sf, "part").select("p_partkey", written(text).alias("text"))


@query("dtd_conditional", "SELECT p_partkey AS dtd_id, 'a' || p_partkey AS name FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'c' FROM part")
def _(spark, sf):
    on = F.when(F.col("p_partkey") % 2 == 0, "INCLUDE").otherwise("IGNORE")
    found = _dtds(spark, sf, "<!ENTITY % on '", on, "'><![%on;[<!ELEMENT a", _key(), " EMPTY>]]><![IGNORE[<!ELEMENT b ANY> ']]>' <![INCLUDE[<!ELEMENT d ANY>]]>]]><!ELEMENT c ANY>")
    return found["elements"].select("dtd_id", "name")


@query("dtd_determinism", "SELECT p_partkey AS dtd_id, p_partkey % 5 <> p_partkey % 3 AS deterministic FROM part")
def _(spark, sf):
    return _dtds(spark, sf, "<!ELEMENT r ((a", _mod(5), ",b)|(a", _mod(3), ",c)+)>")["elements"].select("dtd_id", "deterministic")


@query("dtd_validate", """SELECT p_partkey AS dtd_id, CASE p_partkey % 5 WHEN 0 THEN 'More than one ID attribute for element `e''' WHEN 1 THEN 'ID attribute must be #IMPLIED or #REQUIRED; element `e'''
  WHEN 2 THEN 'Reference to undeclared notation `g' || p_partkey || '''' ELSE 'Default value for attribute `t'' is lexically malformed' END AS message FROM part WHERE p_partkey % 5 < 4""")
def _(spark, sf):
    k = F.col("p_partkey") % 5
    wrong = F.when(k == 0, "i ID #REQUIRED j ID #IMPLIED").when(k == 1, "i ID 'x'").when(k == 2, F.concat(F.lit("n NOTATION (g"), _key(), F.lit(") #IMPLIED"))).when(k == 3, "t NMTOKEN 'a b'").otherwise("t NMTOKENS 'a b'")
    return _dtds(spark, sf, "<!ELEMENT e EMPTY><!ATTLIST e ", wrong, ">")["errors"].select("dtd_id", "message")


@query("dtd_first_wins", """SELECT p_partkey AS dtd_id, what, CASE what WHEN 'warning' THEN text ELSE 'first' || p_partkey END AS value FROM part,
  (VALUES ('entity', ''), ('attribute', ''), ('warning', 'More than one declaration for entity `x'''), ('warning', 'More than one ATTLIST declaration for element type `e'''), ('warning', 'More than one declaration for attribute `a'' of element type `e''')) AS t(what, text)""")
def _(spark, sf):
    f = _dtds(spark, sf, "<!ENTITY x 'first", _key(), "'><!ENTITY x 'second'><!ELEMENT e ANY><!ATTLIST e a CDATA 'first", _key(), "'><!ATTLIST e a CDATA 'second'>")
    rows = f["entities"].select("dtd_id", F.lit("entity").alias("what"), F.col("text").alias("value")).unionByName(f["attributes"].select("dtd_id", F.lit("attribute").alias("what"), F.col("default_value").alias("value")))
    return rows.unionByName(f["warnings"].select("dtd_id", F.lit("warning").alias("what"), F.col("message").alias("value")))


@query("dtd_options", "SELECT p_partkey AS dtd_id, p_partkey % 2 = 0 AS optional_elements, 'a' || p_partkey || ' b' AS optional_attributes, 'urn:' || p_size AS uri_of_p, CASE WHEN p_partkey % 3 = 0 THEN 'Unknown option `what''' END AS error FROM part")
def _(spark, sf):
    relaxed = F.when(F.col("p_partkey") % 2 == 0, "<?sylva:dtd optional-element-and-notation-declarations?>").otherwise("<?other:dtd optional-element-and-notation-declarations?>")
    unknown = F.when(F.col("p_partkey") % 3 == 0, "<?sylva:dtd what?>").otherwise("<?other:dtd what?>")
    f = _dtds(spark, sf, relaxed, unknown, '<?sylva:dtd optional-attribute-declarations elements="a', _key(), ' b"?><?sylva:dtd namespace prefix="p" uri="urn:', F.col("p_size").cast("string"), '"?>')
    rows = f["settings"].join(f["namespaces"].filter("prefix = 'p'"), "dtd_id").join(f["errors"], "dtd_id", "left")
    return rows.select("dtd_id", "optional_elements", F.array_join("optional_attributes", " ").alias("optional_attributes"), F.col("uri").alias("uri_of_p"), F.col("message").alias("error"))


@query("parse_events", GEO + """
SELECT doc_id, kind, CAST(n AS BIGINT) AS n FROM (
  SELECT r.doc_id, 1 + (SELECT count(*) FROM n WHERE n.doc_id = r.doc_id) + (SELECT count(*) FROM c WHERE c.doc_id = r.doc_id) AS tags, (SELECT count(*) FROM c WHERE c.doc_id = r.doc_id) AS texts FROM r) x,
  LATERAL (VALUES ('start_tag', tags), ('end_tag', tags), ('char_data', texts), ('start_doc', 1), ('end_doc', 1), ('start_super', 1), ('end_super', 1), ('end_of_stream', 1)) AS t(kind, n)
WHERE n > 0""")
def _(spark, sf):
    return parse_events(corpora.geo(spark, sf)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


_GEO_XML = GEO + f""",
cx AS (SELECT doc_id, n_nationkey, string_agg('<customer bal="' || {money('bal')} || '" key="' || c_custkey || '" seg="' || seg || '">' || {canon('c_name')} || '</customer>', '' ORDER BY c_custkey) AS x FROM c GROUP BY doc_id, n_nationkey),
nx AS (SELECT n.doc_id, string_agg('<nation key="' || n.n_nationkey || '" name="' || n_name || '">' || coalesce(x, '') || '</nation>', '' ORDER BY n.n_nationkey) AS x FROM n LEFT JOIN cx ON n.n_nationkey = cx.n_nationkey GROUP BY n.doc_id)
SELECT r.doc_id, '<region key="' || r.doc_id || '" name="' || r_name || '">' || coalesce(x, '') || '</region>' AS xml FROM r LEFT JOIN nx ON r.doc_id = nx.doc_id"""


@query("write_events", _GEO_XML)
def _(spark, sf):
    return ev.write(parse_events(corpora.geo(spark, sf)))


@query("write_nodes", f"SELECT conv_id AS doc_id, '<conv>' || string_agg('<turn n=\"' || turn || '\" role=\"' || role || '\">' || {canon('text')} || '</turn>', '' ORDER BY turn) || '</conv>' AS xml FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return ev.write(tree.liquefy(nodes(spark, sf, "chat")))


_NS = Options(namespaces=True)


@query("display_events", """SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CASE n_nationkey % 3
  WHEN 0 THEN '<nation xmlns="urn:geo"><name>' || n_name || '</name></nation>'
  WHEN 1 THEN '<g:nation m:key="' || n_nationkey || '" xmlns:g="urn:geo" xmlns:m="urn:meta"><g:name>' || n_name || '</g:name></g:nation>'
  ELSE '<a:nation xmlns:a="urn:geo" xmlns:m="urn:meta"><a:name>' || n_name || '</a:name><m:x></m:x></a:nation>' END AS xml FROM nation""")
def _(spark, sf):
    docs = corpora.spaces(spark, sf)
    return ev.display(parse_events(docs, _NS), ns.display_prefixes(parse_nodes(docs, _NS)))


@query("xml_escape", f"SELECT doc_id, {esc('text')} AS escaped FROM documents")
def _(spark, sf):
    return corpora.table(spark, sf, "documents").select("doc_id", text.escape(F.col("text")).alias("escaped"))


@query("roundtrip_marshal", GEO + f"""SELECT doc_id, pre, CAST(pre + 1 AS BIGINT) AS fin, 3 AS level, npre AS parent, CAST(i - 1 AS INTEGER) AS pos, '0.' || (j - 1) || '.' || (i - 1) AS path, 'element' AS kind, 'customer' AS name,
  c_name AS value, 'key=' || c_custkey || ';seg=' || seg || ';bal=' || {money('bal')} AS attrs, 1 AS line FROM c
UNION ALL SELECT doc_id, CAST(pre + 1 AS BIGINT), CAST(pre + 1 AS BIGINT), 4, pre, 0, '0.' || (j - 1) || '.' || (i - 1) || '.0', 'data', NULL, c_name, '', 1 FROM c
UNION ALL SELECT doc_id, pre, CAST(pre + 2 * m AS BIGINT), 2, CAST(1 AS BIGINT), CAST(j - 1 AS INTEGER), '0.' || (j - 1), 'element', 'nation', coalesce((SELECT string_agg(c_name, '' ORDER BY i) FROM c WHERE c.n_nationkey = np.n_nationkey), ''), 'key=' || n_nationkey || ';name=' || n_name, 1 FROM np""")
def _(spark, sf):
    """Whole rows of nodes, written and read again."""
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat(a["name"], F.lit("="), a["value"])), ";")
    rows = nodes(spark, sf, "geo").filter("level > 1")
    return rows.select("doc_id", "pre", "fin", "level", "parent", "pos", F.array_join(F.col("path").cast("array<string>"), ".").alias("path"), "kind", "name", "value", attrs.alias("attrs"), "line")


@query("ns_relocate_attributes", "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'M:key' AS name, 'M' AS prefix, CAST(n_nationkey AS VARCHAR) AS value FROM nation WHERE n_nationkey % 3 = 1")
def _(spark, sf):
    names = spark.createDataFrame([("urn:geo", "G"), ("urn:meta", "M")], "uri string, normprefix string")
    return attributes(ns.relocate(nodes(spark, sf, "spaces", _NS), names)).select("doc_id", "name", "prefix", "value")


@query("ns_relocate", "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'G:name' AS name, n_name AS value FROM nation")
def _(spark, sf):
    names = spark.createDataFrame([("urn:geo", "G"), ("urn:meta", "M")], "uri string, normprefix string")
    return ns.relocate(nodes(spark, sf, "spaces", _NS), names).filter("kind = 'element' AND local = 'name'").select("doc_id", "name", "value")


@query("lex_tags", "SELECT page_id, CAST(len(regexp_extract_all(html, '</?[A-Za-z][^<>]*>')) AS BIGINT) AS n_tags FROM pages")
def _(spark, sf):
    return corpora.table(spark, sf, "pages").select("page_id", F.size(text.tags(F.col("html"))).cast("long").alias("n_tags"))


@query("norm_crlf", r"SELECT doc_id, replace(text, chr(10), ' / ') AS lines FROM documents")
def _(spark, sf):
    wild = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\r")))
    return corpora.table(spark, sf, "documents").select("doc_id", F.replace(text.normalize_lines(wild), F.lit("\n"), F.lit(" / ")).alias("lines"))


@query("norm_public_id", r"SELECT doc_id, trim(regexp_replace(text, '[ \n\r\t]+', ' ', 'g'), ' ') AS id FROM documents")
def _(spark, sf):
    return corpora.table(spark, sf, "documents").select("doc_id", text.normalize_public_id(F.concat(F.lit(" \n"), "text", F.lit("\t "))).alias("id"))


# ---- event streams


@query("ev_pfilter", GEO + "SELECT doc_id, CAST(3 + 2 * j - 1 + 3 * (k - 1) + 1 AS BIGINT) AS seq, c_name AS value FROM c")
def _(spark, sf):
    return ev.pfilter(parse_events(corpora.geo(spark, sf)), F.col("kind") == "char_data").select("doc_id", "seq", "value")


@query("ev_norm_cdata", GEO + "SELECT doc_id, c_name AS value FROM c")
def _(spark, sf):
    e = parse_events(corpora.geo(spark, sf)).withColumn("seq", F.col("seq") * 3)
    cut = F.col("kind") == "char_data"
    head = e.withColumn("value", F.when(cut, F.left("value", F.lit(3))).otherwise(F.col("value")))
    rest = e.filter(cut).withColumns({"seq": F.col("seq") + 1, "value": F.substring(F.col("value"), F.lit(4), F.length("value"))})
    none = e.filter(cut).withColumns({"seq": F.col("seq") + 2, "value": F.lit("")})
    return ev.norm_cdata(head.unionByName(rest).unionByName(none)).filter("kind = 'char_data'").select("doc_id", "value")


_GEO_DTD = "<!ELEMENT region (nation*)><!ELEMENT nation (customer*)><!ELEMENT customer (#PCDATA)>"


@query("ev_drop_ws", GEO + "SELECT doc_id, CAST(count(*) AS BIGINT) AS texts FROM c GROUP BY doc_id")
def _(spark, sf):
    docs = corpora.geo(spark, sf).withColumn("xml", F.replace(F.replace("xml", F.lit("<nation"), F.lit("\n  <nation")), F.lit("<customer"), F.lit("\n\t<customer")))
    kept, _ = ev.drop_ignorable_whitespace(parse_events(docs), parse_dtd(_GEO_DTD).frames(spark)["elements"])
    return kept.filter("kind = 'char_data'").groupBy("doc_id").agg(F.count("*").alias("texts"))


@query("ev_unwrap", GEO + "SELECT r.doc_id, CAST(2 + 2 * (SELECT count(*) FROM n WHERE n.doc_id = r.doc_id) + 3 * (SELECT count(*) FROM c WHERE c.doc_id = r.doc_id) AS BIGINT) AS n FROM r")
def _(spark, sf):
    inner, _ = ev.unwrap_document(parse_events(corpora.geo(spark, sf)))
    return inner.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("ev_extract", GEO + "SELECT doc_id, CAST(2 + 3 * m AS BIGINT) AS n FROM np WHERE j = 1")
def _(spark, sf):
    inner, _ = ev.unwrap_document(parse_events(corpora.geo(spark, sf)))
    return ev.extract(inner, F.lit(3)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("ev_list_roundtrip", GEO + "SELECT r.doc_id, CAST(7 + 2 * (SELECT count(*) FROM n WHERE n.doc_id = r.doc_id) + 3 * (SELECT count(*) FROM c WHERE c.doc_id = r.doc_id) AS BIGINT) AS n FROM r")
def _(spark, sf):
    return ev.of_list(ev.to_list(parse_events(corpora.geo(spark, sf)))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("ev_concat", GEO + "SELECT doc_id, CAST(count(*) * 2 AS BIGINT) AS texts, CAST(2 * (7 + 3 * count(*) + 2 * (SELECT count(*) FROM n WHERE n.doc_id = c.doc_id)) - 1 AS BIGINT) AS last FROM c GROUP BY doc_id")
def _(spark, sf):
    e = parse_events(corpora.geo(spark, sf))
    return ev.concat(e, e).groupBy("doc_id").agg(F.count_if(F.col("kind") == "char_data").alias("texts"), F.max("seq").alias("last")).filter("texts > 0")


@query("ev_depth", GEO + "SELECT doc_id, 1 AS depth, CAST(2 AS BIGINT) AS tags FROM r UNION ALL SELECT doc_id, 2, CAST(2 * count(*) AS BIGINT) FROM n GROUP BY doc_id UNION ALL SELECT doc_id, 3, CAST(2 * count(*) AS BIGINT) FROM c GROUP BY doc_id")
def _(spark, sf):
    return ev.depth(parse_events(corpora.geo(spark, sf))).filter("kind IN ('start_tag', 'end_tag')").groupBy("doc_id", "depth").agg(F.count("*").alias("tags"))


@query("ev_parse_list", "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS BIGINT) AS record, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS phone FROM nation JOIN customer ON c_nationkey = n_nationkey")
def _(spark, sf):
    c = corpora.table(spark, sf, "customer")
    rec = build.el("record", None, build.el("name", None, F.col("c_name")), build.raw(F.when(F.col("c_custkey") % 2 == 0, build.el("phone", None, F.col("c_mktsegment")).xml()).otherwise("")))
    docs = c.groupBy(F.col("c_nationkey").cast("long").alias("doc_id")).agg(F.concat(F.lit("<list>"), corpora.children(F.col("c_custkey"), rec.xml()), F.lit("</list>")).alias("xml"))
    return ev.records(parse_events(docs), "record", ["name", "phone"])


@query("stream_filters", GEO + "SELECT doc_id, c_name AS value FROM c")
def _(spark, sf):
    """The streaming filter's rows, from a stream over stored events."""
    from sylva.streaming.filters import norm_cdata_stream

    e = parse_events(corpora.geo(spark, sf)).select("doc_id", "seq", "kind", "name", "value")
    path, out = store.shared_path(spark, "events"), store.shared_path(spark, "stream")
    store.save(e, path)
    stream = norm_cdata_stream(spark.readStream.schema(e.schema).parquet(path))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).filter("kind = 'char_data'").select("doc_id", "value")


# ---- search and projection on trees


def _nations(n: DataFrame) -> DataFrame:
    return n.filter("name = 'nation'").select("doc_id", "pre", "fin")


def _seg(value: str) -> Column:
    return F.exists("attrs", lambda a: (a["name"] == "seg") & (a["value"] == value))


@query("find_first", GEO + "SELECT doc_id, npre AS of, min(pre) AS pre FROM c WHERE seg = 'BUILDING' GROUP BY doc_id, npre")
def _(spark, sf):
    n = nodes(spark, sf, "geo")
    return tree.find_first(n, _nations(n), _seg("BUILDING")).select("doc_id", "of", "pre")


@query("find_all_deep", GEO + "SELECT doc_id, pre, c_name AS value FROM c WHERE seg = 'MACHINERY'")
def _(spark, sf):
    n = nodes(spark, sf, "geo")
    return tree.find_all(n, n.filter("parent = 0"), _seg("MACHINERY")).select("doc_id", "pre", "value")


@query("find_all_elements", GEO + "SELECT doc_id, pre FROM np")
def _(spark, sf):
    n = nodes(spark, sf, "geo")
    return tree.find_all(n, n.filter("parent = 0"), F.col("name") == "nation", deeply=False).select("doc_id", "pre")


@query("classify_data", CAT + "SELECT doc_id, class, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, 'NORMAL' AS class FROM p UNION ALL SELECT doc_id, 'ERROR' FROM p WHERE k % 31 = 0) x GROUP BY doc_id, class")
def _(spark, sf):
    return Validator(nodes(spark, sf, "catalog"), DTD).classify().groupBy("doc_id", "class").agg(F.count("*").alias("n"))


@query("attr_project", GEO + f"SELECT doc_id, CAST(c_custkey AS VARCHAR) AS key, seg, {money('bal')} AS bal FROM c")
def _(spark, sf):
    a = attributes(nodes(spark, sf, "geo").filter("name = 'customer'"))
    one = lambda n: F.max(F.when(F.col("name") == n, F.col("value"))).alias(n)
    return a.groupBy("doc_id", "owner").agg(one("key"), one("seg"), one("bal")).drop("owner")


@query("id_index", CAT + "SELECT doc_id, CASE WHEN k % 23 = 0 THEN 'p0' ELSE 'p' || k END AS id, 'part' AS name FROM p")
def _(spark, sf):
    return Validator(nodes(spark, sf, "catalog"), DTD).id_index().select("doc_id", "id", "name")


@query("id_lookup", CAT + "SELECT doc_id, k AS part, p_name AS value FROM p WHERE k % 23 <> 0")
def _(spark, sf):
    n = nodes(spark, sf, "catalog")
    wanted = corpora.table(spark, sf, "part").select(F.min("p_partkey").over(Window.partitionBy("p_brand")).alias("doc_id"), F.col("p_partkey").alias("part"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")).filter("part % 23 <> 0")
    hit = wanted.join(Validator(n, DTD).id_index(), ["doc_id", "id"])
    texts = n.filter("kind = 'data'").groupBy("doc_id", F.col("parent").alias("pre")).agg(F.min_by("value", "pre").alias("value"))
    return hit.join(texts, ["doc_id", "pre"]).select("doc_id", "part", "value")


@query("nav_siblings", GEO + "SELECT doc_id, pre, lag(pre) OVER (PARTITION BY n_nationkey ORDER BY i) AS previous, lead(pre) OVER (PARTITION BY n_nationkey ORDER BY i) AS next FROM c")
def _(spark, sf):
    return tree.siblings(nodes(spark, sf, "geo")).filter("name = 'customer'").select("doc_id", "pre", "previous", "next")


@query("ns_split", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'p' || n_nationkey ELSE '' END AS prefix, n_name || ':x' AS local FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, '', n_name FROM nation WHERE n_nationkey % 2 = 1")
def _(spark, sf):
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("p"), "n_nationkey", F.lit(":"), "n_name", F.lit(":x"))).otherwise(F.col("n_name"))
    return corpora.table(spark, sf, "nation").select("n_nationkey", text.name_prefix(name).alias("prefix"), text.name_local(name).alias("local"))


@query("node_data", GEO + "SELECT np.doc_id, np.pre AS of, coalesce(string_agg(c_name, '' ORDER BY c.pre), '') AS data FROM np LEFT JOIN c ON np.n_nationkey = c.n_nationkey GROUP BY np.doc_id, np.pre")
def _(spark, sf):
    n = nodes(spark, sf, "geo")
    return tree.node_data(n, _nations(n))


@query("doc_order", GEO + "SELECT doc_id, pre, CAST(pre AS INTEGER) AS ord FROM c")
def _(spark, sf):
    return tree.document_order(nodes(spark, sf, "geo")).filter("name = 'customer'").select("doc_id", "pre", "ord")


# ---- XPath

xp("ax_child", "geo", "/region/nation/customer", GEO + "SELECT doc_id, pre, c_name AS value FROM c")
xp("ax_descendant", "geo", "/descendant::customer", GEO + "SELECT doc_id, pre, c_name AS value FROM c")
xp("ax_parent", "geo", "//customer[@seg='BUILDING']/parent::nation/@name", GEO + "SELECT DISTINCT doc_id, npre AS pre, n_name AS value FROM c WHERE seg = 'BUILDING'")
xp("ax_ancestor", "geo", "//customer[@seg='BUILDING']/ancestor::*/@name", GEO + "SELECT DISTINCT doc_id, npre AS pre, n_name AS value FROM c WHERE seg = 'BUILDING' UNION ALL SELECT DISTINCT c.doc_id, CAST(1 AS BIGINT), r_name FROM c JOIN r ON c.doc_id = r.doc_id WHERE seg = 'BUILDING'")
xp("ax_following_sibling", "geo", "/region/nation[1]/following-sibling::nation/@name", GEO + "SELECT doc_id, pre, n_name AS value FROM np WHERE j > 1")
xp("ax_preceding_sibling", "geo", "/region/nation[last()]/preceding-sibling::nation/@name", GEO + "SELECT doc_id, pre, n_name AS value FROM np WHERE j < (SELECT max(j) FROM np x WHERE x.doc_id = np.doc_id)")
xp("ax_following", "geo", "/region/nation[2]/following::customer", GEO + "SELECT doc_id, pre, c_name AS value FROM c WHERE j > 2")
xp("ax_preceding", "geo", "/region/nation[2]/preceding::customer", GEO + "SELECT doc_id, pre, c_name AS value FROM c WHERE j < 2 AND EXISTS (SELECT * FROM n x WHERE x.doc_id = c.doc_id AND x.j = 2)")
xp("ax_attribute", "geo", "//customer/@seg", GEO + "SELECT doc_id, pre, seg AS value FROM c")
xp("ax_desc_or_self", "geo", "/region/descendant-or-self::*[@name]/@name", GEO + "SELECT doc_id, pre, n_name AS value FROM np UNION ALL SELECT doc_id, CAST(1 AS BIGINT), r_name FROM r")
xp("ax_anc_or_self", "geo", "//nation[1]/ancestor-or-self::*/@key", GEO + "SELECT doc_id, pre, CAST(n_nationkey AS VARCHAR) AS value FROM np WHERE j = 1 UNION ALL SELECT doc_id, CAST(1 AS BIGINT), CAST(doc_id AS VARCHAR) FROM r WHERE doc_id IN (SELECT doc_id FROM n)")
xp("ax_self", "geo", "//*[@bal]/self::customer[. = string(.)]", GEO + "SELECT doc_id, pre, c_name AS value FROM c")
xp("ax_following_attr", "geo", "/region/@key/following::nation/@name", GEO + "SELECT doc_id, pre, n_name AS value FROM np")
xp("ax_preceding_nth", "geo", "/region/nation[3]/preceding::nation[2]/@name", GEO + "SELECT doc_id, pre, n_name AS value FROM np WHERE j = 1 AND (SELECT max(j) FROM np x WHERE x.doc_id = np.doc_id) >= 3")
xp("ax_desc_of_many", "geo", "//nation//customer[@seg='BUILDING']", GEO + "SELECT doc_id, pre, c_name AS value FROM c WHERE seg = 'BUILDING'")
xp("xp_root", "geo", "//customer[@seg='BUILDING'][1]/../../..", GEO + "SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS pre FROM c WHERE seg = 'BUILDING'", lambda d: d.select("doc_id", "pre"))
xp("xp_path", "orders", "/orders/order[@status='F']/item[@qty > 40]/@price", f"""
SELECT o_custkey AS doc_id, {money('l_extendedprice')} AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND CAST(l_quantity AS INTEGER) > 40""", lambda d: d.select("doc_id", "value"))
xp("xp_union", "geo", "//nation/@name | //region/@name | //nation[1]/@name", GEO + "SELECT doc_id, pre, n_name AS value FROM np UNION ALL SELECT doc_id, CAST(1 AS BIGINT), r_name FROM r")
xp("xp_filter_expr", "geo", "(//customer)[5]", GEO + "SELECT doc_id, pre, c_name AS value FROM c WHERE k = 5")
xp("xp_position", "geo", "//nation/customer[position() > 2 and position() < 6]", GEO + "SELECT doc_id, pre, c_name AS value FROM c WHERE i > 2 AND i < 6")
xp("xp_last", "geo", "//nation/customer[last()]", GEO + "SELECT doc_id, pre, c_name AS value FROM c WHERE i = m")
xp("xp_pred_chain", "geo", "//nation/customer[@seg='BUILDING'][2][@bal > 0]", GEO + "SELECT doc_id, pre, c_name AS value FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY i) AS b FROM c WHERE seg = 'BUILDING') x WHERE b = 2 AND bal > 0")
xp("xp_topk", "orders", "/orders/order/item[position() <= 2]/@n", """
SELECT o_custkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS value FROM (
  SELECT o_custkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey) x WHERE i <= 2""", lambda d: d.select("doc_id", "value"))
xp("xp_literals", "geo", "concat('a\"b', \"c'd\", 12, .5, true(), false())", "SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 'a\"bc''d120.5truefalse' AS value FROM region")
xp("xp_bool_ops", "geo", "//customer[@seg='BUILDING' and @bal > 5000 or @seg='MACHINERY' and not(@bal > 0)]", GEO + f"SELECT doc_id, pre, c_name AS value FROM c WHERE seg = 'BUILDING' AND CAST({money('bal')} AS DOUBLE) > 5000 OR seg = 'MACHINERY' AND NOT CAST({money('bal')} AS DOUBLE) > 0")
xp("xp_compare", "geo", "//nation[customer/@bal > 9900]/@name", GEO + f"SELECT DISTINCT doc_id, npre AS pre, n_name AS value FROM c WHERE CAST({money('bal')} AS DOUBLE) > 9900")
xp("xp_arith", "orders", "count(/orders/order) * 3 - 7 mod 4 + count(/orders/order) div 2", "SELECT o_custkey AS doc_id, count(*) * 3.0::DOUBLE - 3 + count(*) / 2.0::DOUBLE AS value FROM orders GROUP BY o_custkey")
xp("xp_var", "geo", "count(//customer[@seg = $seg])", GEO + "SELECT r.doc_id, CAST((SELECT count(*) FROM c WHERE c.doc_id = r.doc_id AND seg = 'HOUSEHOLD') AS DOUBLE) AS value FROM r", variables={"seg": "HOUSEHOLD"})
xp("xp_fn_count", "geo", "count(//customer/..)", GEO + "SELECT r.doc_id, CAST((SELECT count(*) FROM np WHERE np.doc_id = r.doc_id AND m > 0) AS DOUBLE) AS value FROM r")
xp("xp_fn_sum", "orders", "sum(//item/@qty)", "SELECT o_custkey AS doc_id, CAST(coalesce(sum(CAST(l_quantity AS INTEGER)), 0) AS DOUBLE) AS value FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey")
xp("xp_fn_string", "geo", "string(//customer[@seg='FURNITURE'])", GEO + "SELECT r.doc_id, coalesce((SELECT min_by(c_name, pre) FROM c WHERE c.doc_id = r.doc_id AND seg = 'FURNITURE'), '') AS value FROM r")
xp("xp_fn_boolean", "geo", "boolean(//nation[count(customer) > 70])", GEO + "SELECT r.doc_id, EXISTS (SELECT * FROM np WHERE np.doc_id = r.doc_id AND m > 70) AS value FROM r")
xp("xp_fn_names", "geo", "concat(name(//nation), '/', local-name(//@bal), '/', namespace-uri(/*), '/', name(//nothing))", GEO + "SELECT r.doc_id, CASE WHEN EXISTS (SELECT * FROM n WHERE n.doc_id = r.doc_id) THEN 'nation' ELSE '' END || '/' || CASE WHEN EXISTS (SELECT * FROM c WHERE c.doc_id = r.doc_id) THEN 'bal' ELSE '' END || '//' AS value FROM r")
xp("xp_fn_not", "geo", "//nation[not(customer[contains(., '99')])]/@name", GEO + "SELECT doc_id, pre, n_name AS value FROM np WHERE NOT EXISTS (SELECT * FROM c WHERE c.n_nationkey = np.n_nationkey AND contains(c_name, '99'))")
xp("xp_fn_concat", "geo", "//nation[concat(@key, '-', @name) = concat(@key, '-NATION_', @key)]/@name", GEO + "SELECT doc_id, pre, n_name AS value FROM np WHERE n_name = 'NATION_' || n_nationkey")
xp("xp_fn_starts_with", "geo", "//customer[starts-with(., 'Customer#0000000')]", GEO + "SELECT doc_id, pre, c_name AS value FROM c WHERE starts_with(c_name, 'Customer#0000000')")
xp("xp_fn_contains", "geo", "//customer[contains(., '77')]", GEO + "SELECT doc_id, pre, c_name AS value FROM c WHERE contains(c_name, '77')")
xp("xp_fn_lang", "prose", "count(/doc/p[lang('en')])", "SELECT doc_id, CASE WHEN lower(lang) = 'en' OR starts_with(lower(lang), 'en-') THEN CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS DOUBLE) ELSE 0.0::DOUBLE END AS value FROM documents")


@query("ax_namespace", "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CASE n_nationkey % 3 WHEN 0 THEN ':urn:geo,xml:http://www.w3.org/XML/1998/namespace' WHEN 1 THEN 'g:urn:geo,m:urn:meta,xml:http://www.w3.org/XML/1998/namespace' ELSE 'a:urn:geo,xml:http://www.w3.org/XML/1998/namespace' END AS scope FROM nation")
def _(spark, sf):
    found = evaluate(nodes(spark, sf, "spaces", _NS), "/*/namespace::*")
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit(":"), "value"))), ",").alias("scope"))


def _with_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog documents with the declarations inside."""
    docs = corpora.catalog(spark, sf)
    return docs.withColumn("xml", F.concat(F.lit(f"<!DOCTYPE brand [{corpora.CATALOG_DTD}]>"), "xml"))


@query("xp_fn_id", CAT + "SELECT doc_id, p_name AS value FROM p WHERE i = 2 AND k % 23 <> 0 AND k % 31 <> 0")
def _(spark, sf):
    found = xpath(_with_ids(spark, sf), "id(/brand/part[2]/@id)[@id != 'p0' and not(b[text()])]/text()")
    return found.select("doc_id", "value")


def _texts(name: str, f: Callable[[Column], Column], sql: str) -> None:
    """A scalar function over whole texts."""
    query(name, f"SELECT doc_id, {sql} AS value FROM documents")(lambda spark, sf: corpora.table(spark, sf, "documents").select("doc_id", f(F.col("text")).alias("value")))


_texts("xp_fn_substr_before", lambda t: fn.substring_before(t, F.lit("an")), "CASE WHEN strpos(text, 'an') > 0 THEN left(text, strpos(text, 'an') - 1) ELSE '' END")
_texts("xp_fn_substr_after", lambda t: fn.substring_after(t, F.lit("an")), "CASE WHEN strpos(text, 'an') > 0 THEN substr(text, strpos(text, 'an') + 2) ELSE '' END")
_texts("xp_fn_substring", lambda t: fn.substring(t, F.lit(1.5), F.lit(2.6)), "substr(text, 2, 3)")
_texts("xp_fn_strlen", fn.string_length, "CAST(length(text) AS DOUBLE)")
_texts("xp_fn_normspace", text.normalize_space, r"trim(regexp_replace(text, '[ \n\r\t]+', ' ', 'g'), ' ')")
_texts("xp_fn_translate", lambda t: fn.translate(t, F.lit("abcabc"), F.lit("ABxyz")), "translate(text, 'abc', 'ABx')")
_texts("xp_fn_number", lambda t: fn.to_number(F.concat(F.lit(" -"), F.char_length(t).cast("string"), F.lit(".50\n"))), "CAST(-length(text) - 0.5 AS DOUBLE)")
_texts("xp_fn_round", lambda t: fn.rounded(F.char_length(t) / 4.0) + fn.floor(F.char_length(t) / 3.0) + fn.ceiling(-F.char_length(t) / 7.0), "CAST(floor(length(text) / 4.0 + 0.5) + floor(length(text) / 3.0) + ceil(-length(text) / 7.0) AS DOUBLE)")


# ---- conversion and transforms


@query("solidify", GEO + "SELECT doc_id, pre, CAST(pre + 1 AS BIGINT) AS fin, npre AS parent, CAST(i - 1 AS INTEGER) AS pos FROM c")
def _(spark, sf):
    return tree.solidify(parse_events(corpora.geo(spark, sf))).filter("name = 'customer'").select("doc_id", "pre", "fin", "parent", "pos")


@query("liquefy", GEO + "SELECT doc_id, CAST(2 * j + 3 * (k - 1) AS BIGINT) AS seq, c_name AS value FROM c")
def _(spark, sf):
    e = tree.liquefy(nodes(spark, sf, "geo"))
    texts = e.filter("kind = 'char_data'").select("doc_id", (F.col("seq") - 1).alias("seq"), "value")
    starts = e.filter("kind = 'start_tag' AND name = 'customer'").select("doc_id", "seq")
    return starts.join(texts, ["doc_id", "seq"])


@query("tr_map_prune", GEO + "SELECT doc_id, CAST(2 + j AS BIGINT) AS pre, n_name AS value FROM n")
def _(spark, sf):
    n = tree.remove(nodes(spark, sf, "geo"), F.col("name") == "customer")
    return n.filter("name = 'nation'").select("doc_id", (F.col("pre") + 1).alias("pre"), F.get(F.filter("attrs", lambda a: a["name"] == "name"), 0)["value"].alias("value"))


@query("tr_remove", GEO + "SELECT doc_id, CAST(j + 2 * x - 1 + 2 AS BIGINT) AS pre, c_name AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS x FROM c WHERE seg <> 'BUILDING') y")
def _(spark, sf):
    n = tree.remove(nodes(spark, sf, "geo"), (F.col("name") == "customer") & _seg("BUILDING"))
    return n.filter("name = 'customer'").select("doc_id", (F.col("pre") + 1).alias("pre"), "value")


@query("tr_map_sibl", GEO + "SELECT doc_id, pre, coalesce(lag(c_name) OVER w, '-') || '|' || c_name || '|' || coalesce(lead(c_name) OVER w, '-') AS value FROM c WINDOW w AS (PARTITION BY n_nationkey ORDER BY i)")
def _(spark, sf):
    n = nodes(spark, sf, "geo").filter("name = 'customer'")
    w = tree.sibling_order()
    return n.select("doc_id", "pre", F.concat(F.coalesce(F.lag("value").over(w), F.lit("-")), F.lit("|"), "value", F.lit("|"), F.coalesce(F.lead("value").over(w), F.lit("-"))).alias("value"))


@query("tr_postorder", GEO + "SELECT doc_id, pre, CAST(2 * (k - 1) + 1 + j - 1 AS INTEGER) AS post FROM c")
def _(spark, sf):
    return tree.post_order(nodes(spark, sf, "geo")).filter("name = 'customer'").select("doc_id", "pre", "post")


@query("tr_strip_ws", "SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS value FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def _(spark, sf):
    d = corpora.table(spark, sf, "documents")
    xml = F.concat(F.lit("<d> \n"), text.escape(text.legal(F.col("text"))), F.lit("\t <!--c--></d>"))
    n = tree.strip_whitespace(parse_nodes(d.select("doc_id", xml.alias("xml"))), delete_empty=True)
    return n.filter("kind = 'data'").select("doc_id", "value")


@query("tr_normalize", GEO + "SELECT doc_id, pre, c_name AS value FROM c")
def _(spark, sf):
    n = nodes(spark, sf, "geo")
    data = F.col("kind") == "data"
    head = n.withColumn("value", F.when(data, F.left("value", F.lit(4))).otherwise(F.col("value")))
    tail = n.filter(data).withColumns({"value": F.substring(F.col("value"), F.lit(5), F.length("value")), "path": F.concat(F.slice("path", 1, F.size("path") - 1), F.array(F.lit(1)))})
    none = n.filter(data).withColumns({"value": F.lit(""), "path": F.concat(F.slice("path", 1, F.size("path") - 1), F.array(F.lit(2)))})
    merged = tree.normalize(head.unionByName(tail).unionByName(none))
    return merged.filter(data).select("doc_id", F.col("parent").alias("pre"), "value")


@query("tr_insert", GEO + "SELECT doc_id, CAST(pre + j AS BIGINT) AS pre, CASE WHEN m > 0 THEN 1 ELSE 0 END AS pos FROM np")
def _(spark, sf):
    n = nodes(spark, sf, "geo")
    new = _nations(n).select("doc_id", F.col("pre").alias("parent"), F.lit(1).alias("pos"), F.lit("mark").alias("name"), F.lit("").alias("value"), F.array().cast(dict(n.dtypes)["attrs"]).alias("attrs"), F.lit("mark").alias("local"), F.lit("").alias("prefix"))
    some = n.filter("name = 'customer' AND pos = 0").select("doc_id", "parent")
    new = new.join(some.withColumn("_has", F.lit(True)), ["doc_id", "parent"], "left").drop("_has")
    out = tree.insert(n, new)
    marks = out.filter("name = 'mark'").select("doc_id", F.col("parent").alias("pre"), "pos")
    return marks.select("doc_id", F.col("pre") + 0, "pos").toDF("doc_id", "pre", "pos").withColumn("pre", F.col("pre") + 1)


@query("tr_set_attr", GEO + "SELECT doc_id, pre, CASE WHEN bal < 0 THEN 'debt' ELSE seg END AS seg FROM c")
def _(spark, sf):
    # two decimals don't tell a small debt from none, nor the sign of -0.00
    exact = {"exact": F.coalesce(F.col("c_acctbal").cast("string"), F.lit(""))}
    n = store.roundtrip(parse_nodes(corpora.geo(spark, sf, exact)), "nodes")
    debt = (F.col("name") == "customer") & F.exists("attrs", lambda a: (a["name"] == "exact") & F.coalesce(a["value"].try_cast("double") < 0, F.lit(False)))
    out = tree.set_attribute(n, debt, "seg", F.lit("debt"))
    return out.filter("name = 'customer'").select("doc_id", "pre", F.get(F.filter("attrs", lambda a: a["name"] == "seg"), 0)["value"].alias("seg"))


@query("tr_clone", "SELECT CAST(n_nationkey + 1000 AS BIGINT) AS doc_id, CAST(2 * row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS BIGINT) AS pre, c_name AS value FROM nation JOIN customer ON c_nationkey = n_nationkey")
def _(spark, sf):
    n = nodes(spark, sf, "geo")
    key = F.get(F.filter("attrs", lambda a: a["name"] == "key"), 0)["value"].cast("long")
    roots = n.filter("name = 'nation'").select("doc_id", "pre", "fin", "path", (key + 1000).alias("new_id"))
    return tree.clone(n, roots).filter("name = 'customer'").select("doc_id", "pre", "value")


@query("tr_sort_children", "SELECT CAST(c_nationkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) - 1 AS INTEGER) AS pos, c_name AS name FROM customer")
def _(spark, sf):
    c = corpora.table(spark, sf, "customer")
    rec = build.el("record", None, build.el("seg", None, F.col("c_mktsegment")), build.el("name", None, F.col("c_name")))
    docs = c.groupBy(F.col("c_nationkey").cast("long").alias("doc_id")).agg(F.concat(F.lit("<list>"), corpora.children(F.col("c_custkey"), rec.xml()), F.lit("</list>")).alias("xml"))
    n = tree.sort_children(store.roundtrip(parse_nodes(corpora.spread(docs)), "nodes"), "list", "seg")
    records = n.filter("name = 'record'").select("doc_id", F.col("pre").alias("parent"), F.col("pos").alias("at"))
    return records.join(wide(n.filter("name = 'name'").select("doc_id", "parent", "value")), ["doc_id", "parent"]).select("doc_id", F.col("at").alias("pos"), F.col("value").alias("name"))


@query("xml_build", f"SELECT c_custkey, '<c k=\"' || c_custkey || '\"' || CASE WHEN c_acctbal >= 0 THEN ' ok=\"yes\"' ELSE '' END || '><!--x-->' || {esc('c_name')} || '</c>' AS xml FROM customer")
def _(spark, sf):
    doc = build.el("c", {"k": F.col("c_custkey"), "ok": F.when(F.col("c_acctbal") >= 0, "yes")}, build.comment("x"), F.col("c_name"))
    return corpora.table(spark, sf, "customer").select("c_custkey", doc.xml().alias("xml"))


@query("tr_macro", "SELECT CAST(n_regionkey AS BIGINT) AS doc_id, n_nationkey, 'Hello ' || n_name || '!' AS value FROM nation")
def _(spark, sf):
    """Uses of a macro, an element in a namespace of its own, meet its definition and
    get their parameter."""
    use = build.el("m:greet", {"who": F.col("n_name"), "id": F.col("n_nationkey")})
    docs = corpora.table(spark, sf, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.concat(F.lit('<r xmlns:m="urn:macro"><m:define name="greet">Hello $who!</m:define>'), corpora.children(F.col("n_nationkey"), use.xml()), F.lit("</r>")).alias("xml"))
    n = parse_nodes(docs, _NS).filter("uri = 'urn:macro'")
    at = lambda name: F.get(F.filter("attrs", lambda a: a["name"] == name), 0)["value"]
    made = n.filter("local = 'define'").select("doc_id", at("name").alias("local"), F.col("value").alias("body"))
    used = n.filter("local <> 'define'").select("doc_id", "local", at("who").alias("who"), at("id").cast("int").alias("n_nationkey"))
    return used.join(made, ["doc_id", "local"]).select("doc_id", "n_nationkey", F.replace("body", F.lit("$who"), F.col("who")).alias("value"))


# ---- validation


#: What each check finds in the catalog corpus: (doc_id, pre, message) from the seeds.
_SEEDED = {
    "declared": "SELECT doc_id, pre + 2 AS pre, 'Reference to undeclared element `x''' AS message FROM p WHERE k % 19 = 0",
    "content": "SELECT doc_id, pre, 'Element `part'' does not match its content model' AS message FROM p WHERE k % 19 = 0",
    "chardata": "SELECT doc_id, pre + 3 + CAST(k % 19 = 0 AS INTEGER) AS pre, 'Element `b'' must be empty' AS message FROM p WHERE k % 31 = 0",
    "idref": "SELECT doc_id, pre, 'Attribute `ref'' of element `part'' refers to unknown ID `nowhere''' AS message FROM p WHERE k % 17 = 0",
    "attr-required": "SELECT doc_id, pre, 'Required attribute `size'' is missing' AS message FROM p WHERE k % 11 = 0",
    "attr-lexical": "SELECT doc_id, pre, 'Attribute `grade'' is lexically malformed' AS message FROM p WHERE k % 13 = 0",
    "attr-fixed": "SELECT doc_id, pre, 'Attribute `unit'' is fixed, but has here a different value' AS message FROM p WHERE k % 29 = 0",
    "id-unique": "SELECT doc_id, pre, 'ID not unique' AS message FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM p WHERE k % 23 = 0) z WHERE n > 1",
}


def _checked(name: str, run: Callable[[Validator], DataFrame], checks: list[str]) -> None:
    """The diagnostics of a check, each with its place, against the seeded violations."""
    sql = CAT + " UNION ALL ".join(f"SELECT doc_id, CAST(pre AS BIGINT) AS pre, '{c}' AS \"check\", message FROM ({_SEEDED[c]}) x" for c in checks)
    query(name, sql)(lambda spark, sf: run(Validator(nodes(spark, sf, "catalog"), DTD)))


_checked("val_declared", lambda v: v.declared(), ["declared"])
_checked("val_mixed", lambda v: v.content(("mixed",)), ["content"])
_checked("val_chardata", lambda v: v.chardata(), ["chardata"])
_checked("val_idref_anti", lambda v: v.idref(), ["idref"])
_checked("val_attrs", lambda v: v.attrs(), ["attr-required", "attr-lexical", "attr-fixed"])
_checked("val_att_lex", lambda v: v.attrs(("lexical",)), ["attr-lexical"])
_checked("val_id_unique", lambda v: v.id_unique(), ["id-unique"])
_checked("val_all", lambda v: v.all(), list(_SEEDED))


@query("val_own_dtd", """WITH p AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 11 <> 4)
SELECT k AS doc_id, CAST(2 AS BIGINT) AS pre, 'Attribute `a'' is lexically malformed' AS message FROM p WHERE k % 3 = 1
UNION ALL SELECT k, 1, 'Element `r'' does not match its content model' FROM p WHERE k % 5 = 2
UNION ALL SELECT k, 1, 'Required attribute `id'' is missing' FROM p WHERE k % 7 = 3
UNION ALL SELECT p_partkey, 0, 'Document has no DTD' FROM part WHERE p_partkey % 11 = 4""")
def _(spark, sf):
    """Each document is held against its own DTD: an allowed value by key, a model that
    asks for two children in every fifth, an attribute that every seventh lacks; every
    eleventh has no DTD."""
    k = F.col("p_partkey")
    model, need = F.when(k % 5 == 2, "(e,e)").otherwise("(e)"), F.when(k % 7 == 3, "<!ATTLIST r id CDATA #REQUIRED>").otherwise("")
    dtd = F.concat(F.lit("<!DOCTYPE r [<!ELEMENT r "), model, F.lit("><!ELEMENT e EMPTY><!ATTLIST e a (v"), _key(), F.lit(") #IMPLIED>"), need, F.lit("]>"))
    value = F.concat(F.lit("v"), F.when(k % 3 == 1, "0").otherwise(_key()))
    docs = corpora.table(spark, sf, "part").select(k.alias("doc_id"), F.concat(F.when(k % 11 == 4, "").otherwise(dtd), F.lit('<r><e a="'), value, F.lit('"/></r>')).alias("xml"))
    # the checks read the nodes again and again
    docs = corpora.spread(docs)
    return Validator(store.roundtrip(parse_nodes(docs), "nodes"), dtds_of(docs)).all().select("doc_id", "pre", "message")


@query("att_defaults", CAT + "SELECT doc_id, CAST(count(*) FILTER (WHERE k % 13 <> 0 AND k % 3 <> 0) AS BIGINT) AS mid, CAST(count(*) FILTER (WHERE k % 29 <> 0) AS BIGINT) AS cm FROM p GROUP BY doc_id")
def _(spark, sf):
    t = Validator(nodes(spark, sf, "catalog"), DTD).typed().filter("NOT specified")
    return t.groupBy("doc_id").agg(F.count_if((F.col("name") == "grade") & (F.col("value") == "mid")).alias("mid"), F.count_if((F.col("name") == "unit") & (F.col("value") == "cm")).alias("cm"))


_ORDER_DTD = "<!ELEMENT orders (order+)><!ELEMENT order (item*, sum?)><!ELEMENT item EMPTY><!ELEMENT sum EMPTY>"


@query("val_content", "SELECT o_custkey AS doc_id, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 7 = 0 AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY o_custkey")
def _(spark, sf):
    # in every 7th order the sum stands before the items
    docs = corpora.orders(spark, sf)
    late = F.regexp_replace("xml", r'(<order key="([0-9]+)"[^>]*>)(.*?)(</order>)', "$1$3<sum k=\"$2\"></sum>$4")
    moved = docs.withColumn("xml", late)
    n = store.roundtrip(parse_nodes(moved), "nodes")
    key = F.get(F.filter("attrs", lambda a: a["name"].isin("k", "key")), 0)["value"].cast("long")
    early = (F.col("name") == "sum") & (key % 7 == 0)
    rows = n.withColumn("pre", F.when(early, F.col("parent") + 0).otherwise(F.col("pre")))
    return Validator(rows, parse_dtd(_ORDER_DTD)).content(("regexp",)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("val_empty", CAT + "SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM p WHERE k % 3 = 0 GROUP BY doc_id")
def _(spark, sf):
    docs = corpora.table(spark, sf, "part").select(F.min("p_partkey").over(Window.partitionBy("p_brand")).alias("g"), F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 3 == 0, "<e><!--c--><f/></e>").otherwise("<e><!--c--></e>").alias("xml"))
    bad = Validator(parse_nodes(docs), parse_dtd("<!ELEMENT e EMPTY><!ELEMENT f EMPTY>")).content(("empty",))
    return bad.join(docs, "doc_id").groupBy(F.col("g").alias("doc_id")).agg(F.count("*").alias("n"))


@query("val_root", "SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 'The root element is `region'' but is declared as `country''' AS message FROM region")
def _(spark, sf):
    return Validator(nodes(spark, sf, "geo"), parse_dtd("<!ELEMENT country ANY>", root="country")).root().select("doc_id", "message")


@query("val_mixed_dups", "SELECT p_partkey AS dtd_id, 'More than one occurrence of an element in the mixed content model of `b''' AS message FROM part WHERE p_partkey % 4 = p_partkey % 3")
def _(spark, sf):
    return _dtds(spark, sf, "<!ELEMENT a (#PCDATA|x|y)*><!ELEMENT b (#PCDATA|x", _mod(4), "|x", _mod(3), ")*>")["errors"].select("dtd_id", "message")


@query("att_normalize", "SELECT n_nationkey, ' ' || n_name || '  x ' AS as_cdata, n_name || ' x' AS as_tokens, 2 AS n_tokens FROM nation")
def _(spark, sf):
    value = F.concat(F.lit(" "), F.col("n_name"), F.lit("  x "))
    docs = corpora.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit('<e c="'), value, F.lit('" t="'), value, F.lit('"/>')).alias("xml"))
    t = Validator(parse_nodes(docs), parse_dtd("<!ELEMENT e EMPTY><!ATTLIST e c CDATA #IMPLIED t NMTOKENS #IMPLIED>")).typed()
    return t.groupBy(F.col("doc_id").cast("int").alias("n_nationkey")).agg(F.max(F.when(F.col("name") == "c", F.col("value"))).alias("as_cdata"), F.max(F.when(F.col("name") == "t", F.col("value"))).alias("as_tokens"), F.max(F.when(F.col("name") == "t", F.size("values"))).alias("n_tokens"))


@query("val_entities", "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'Reference to undeclared or parsed entity `e' || n_nationkey % 3 || '''' AS message FROM nation WHERE n_nationkey % 3 <> 0")
def _(spark, sf):
    docs = corpora.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit('<p src="e'), (F.col("n_nationkey") % 3).cast("string"), F.lit('"/>')).alias("xml"))
    dtd = parse_dtd("<!NOTATION gif SYSTEM 'gif'><!ENTITY e0 SYSTEM 'a.gif' NDATA gif><!ENTITY e1 'parsed'><!ELEMENT p EMPTY><!ATTLIST p src ENTITY #REQUIRED>")
    return Validator(parse_nodes(docs), dtd).entity_values().select("doc_id", "message")


@query("val_standalone", "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(1 + CAST(n_nationkey % 2 = 0 AS INTEGER) AS BIGINT) AS n FROM nation")
def _(spark, sf):
    docs = corpora.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.when(F.col("n_nationkey") % 2 == 0, "<e> <f/></e>").otherwise("<e><f/></e>").alias("xml"))
    dtd = parse_dtd("<!ELEMENT e (f)><!ELEMENT f EMPTY><!ATTLIST f d CDATA 'x'>")
    return Validator(parse_nodes(docs), dtd, standalone=True).standalone_checks().groupBy("doc_id").agg(F.count("*").alias("n"))


# ---- namespaces


@query("ns_normalize", """SELECT * FROM (
  SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'urn:' || n_nationkey AS uri, 'p' AS normprefix FROM nation
  UNION ALL SELECT n_nationkey, 'urn:other', 'p1' FROM nation UNION ALL SELECT n_nationkey, 'urn:none', '1' FROM nation) x""")
def _(spark, sf):
    k = F.col("n_nationkey").cast("long")
    n = corpora.table(spark, sf, "nation")
    rows = lambda seq, prefix, to: n.select(k.alias("doc_id"), F.lit(seq).cast("long").alias("seq"), F.lit(prefix).alias("prefix"), to.alias("uri"))
    own = F.concat(F.lit("urn:"), k.cast("string"))
    return ns.normalize(rows(1, "p", own).unionByName(rows(2, "p", F.lit("urn:other"))).unionByName(rows(3, "q", own)).unionByName(rows(4, "", F.lit("urn:none"))))


@query("ns_resolve", "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'urn:geo' AS uri, local FROM nation, (VALUES ('nation'), ('name')) AS t(local) UNION ALL SELECT n_nationkey, 'urn:meta', 'x' FROM nation WHERE n_nationkey % 3 = 2")
def _(spark, sf):
    return ns.resolve(nodes(spark, sf, "spaces")).select("doc_id", "uri", "local")


@query("ns_effective", "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'name' AS local, prefix FROM nation, (VALUES (0, ''), (1, 'g'), (1, 'm'), (2, 'a'), (2, 'b')) AS t(r, prefix) WHERE n_nationkey % 3 = r")
def _(spark, sf):
    n = nodes(spark, sf, "spaces")
    names = n.filter("kind = 'element'").select("doc_id", "pre", text.name_local(F.col("name")).alias("local")).filter("local = 'name'")
    return ns.effective(n).join(names, ["doc_id", "pre"]).select("doc_id", "local", "prefix")


@query("ns_display", "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, display, uri FROM nation, (VALUES (0, '', 'urn:geo'), (1, 'g', 'urn:geo'), (1, 'm', 'urn:meta'), (2, 'a', 'urn:geo'), (2, 'm', 'urn:meta')) AS t(r, display, uri) WHERE n_nationkey % 3 = r")
def _(spark, sf):
    return ns.display_prefixes(nodes(spark, sf, "spaces", _NS)).select("doc_id", "display", "uri")
