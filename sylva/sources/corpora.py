"""XML corpora built from relational tables: documents (doc_id, xml) whose truth
plain SQL over the same tables gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions.text import escape, legal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def children(order: Column, xml: Column) -> Column:
    """Texts of a group joined in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("k"), xml.alias("x")))), lambda s: s["x"]), "")


def element(name: str, attrs: dict[str, Column], body: Column, numbers: tuple[str, ...] = ()) -> Column:
    """``numbers``: attributes whose values have nothing to escape."""
    parts: list[Column] = [F.lit(f"<{name}")]
    for a, v in attrs.items():
        parts += [F.lit(f' {a}="'), v.cast("string") if a in numbers else escape(v.cast("string")), F.lit('"')]
    return F.concat(*parts, F.lit(">"), body, F.lit(f"</{name}>"))


def spread(docs: DataFrame) -> DataFrame:
    """Few, large documents, and many made of a small file, are dealt out before they are
    read: the tasks that made them may be few."""
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism)


def money(x: Column) -> Column:
    return F.format_string("%.2f", x)


def geo(spark: SparkSession, sf_dir: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """C1: a document for each region: region > nation > customer. Bodies grow with the
    input, so they aren't broadcast. ``extra``: more attributes of customers."""
    c = table(spark, sf_dir, "customer")
    cust = element("customer", {"key": F.col("c_custkey"), "seg": F.col("c_mktsegment"), "bal": money(F.col("c_acctbal"))} | (extra or {}), escape(F.col("c_name")))
    by_nation = c.groupBy("c_nationkey").agg(children(F.col("c_custkey"), cust).alias("body"))
    n = table(spark, sf_dir, "nation").join(by_nation.hint("merge"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    nation = element("nation", {"key": F.col("n_nationkey"), "name": F.col("n_name")}, F.coalesce("body", F.lit("")))
    by_region = n.groupBy("n_regionkey").agg(children(F.col("n_nationkey"), nation).alias("body"))
    r = table(spark, sf_dir, "region").join(by_region.hint("merge"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return spread(r.select(F.col("r_regionkey").cast("long").alias("doc_id"), element("region", {"key": F.col("r_regionkey"), "name": F.col("r_name")}, F.coalesce("body", F.lit(""))).alias("xml")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2: a document for each customer with orders: orders > order > item."""
    item = element("item", {"n": F.col("l_linenumber"), "qty": F.col("l_quantity").cast("int"), "price": money(F.col("l_extendedprice"))}, F.lit(""), ("n", "qty", "price"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(children(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), item).alias("body"))
    o = table(spark, sf_dir, "orders").join(items.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    order = element("order", {"key": F.col("o_orderkey"), "prio": F.col("o_orderpriority"), "status": F.col("o_orderstatus")}, F.coalesce("body", F.lit("")))
    return o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("<orders>"), children(F.col("o_orderkey"), order), F.lit("</orders>")).alias("xml"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3: a document for each conversation: conv > turn, mixed content."""
    turn = element("turn", {"n": F.col("turn"), "role": F.col("role")}, escape(legal(F.coalesce("text", F.lit("")))))
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.concat(F.lit("<conv>"), children(F.struct("turn", "role", "text"), turn), F.lit("</conv>")).alias("xml"))


#: The DTD of the catalog corpus.
CATALOG_DTD = """<!ELEMENT brand (note?, part*)>
<!ELEMENT note (#PCDATA)>
<!ELEMENT part (#PCDATA | b)*>
<!ELEMENT b EMPTY>
<!ATTLIST brand name CDATA #REQUIRED>
<!ATTLIST part id ID #REQUIRED
               ref IDREF #IMPLIED
               size NMTOKEN #REQUIRED
               unit CDATA #FIXED "cm"
               grade (low | mid | high) "mid">
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: a document for each brand, with violations seeded by part key:
    every 11th lacks its size, every 13th has an unknown grade, every 17th refers to
    an id that is not there, every 19th has an undeclared child, every 23rd repeats
    the id 'p0', every 29th has a wrong fixed value, every 31st has text in EMPTY."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")

    def every(n: int, yes: Column, no: Column | None = None) -> Column:
        return F.when(k % n == 0, yes).otherwise(no if no is not None else F.lit(""))

    body = F.concat(
        F.lit('<part id="'), every(23, F.lit("p0"), F.concat(F.lit("p"), k.cast("string"))), F.lit('"'),
        every(11, F.lit(""), F.concat(F.lit(' size="'), F.col("p_size").cast("string"), F.lit('"'))),
        every(13, F.lit(' grade="top"'), every(3, F.lit(' grade="low"'))),
        every(17, F.lit(' ref="nowhere"')),
        every(29, F.lit(' unit="in"')),
        F.lit(">"), escape(F.col("p_name")),
        every(19, F.lit("<x/>")), every(31, F.lit("<b>text</b>"), every(2, F.lit("<b/>"))),
        F.lit("</part>"),
    )
    docs = p.groupBy("p_brand").agg(F.min("p_partkey").alias("doc_id"), children(k, body).alias("body"))
    return spread(docs.select("doc_id", element("brand", {"name": F.col("p_brand")}, F.col("body")).alias("xml")))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5: a document for each text: doc (xml:lang) > p for each line."""
    text = escape(legal(F.coalesce("text", F.lit(""))))
    body = F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    return table(spark, sf_dir, "documents").select("doc_id", element("doc", {"xml:lang": F.coalesce("lang", F.lit(""))}, body).alias("xml"))


def spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6: a document for each nation, its namespaces by key: a default one, one
    prefix, or two prefixes for one URI."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    name = escape(F.col("n_name"))
    plain = F.concat(F.lit('<nation xmlns="urn:geo"><name>'), name, F.lit("</name></nation>"))
    prefixed = F.concat(F.lit('<g:nation xmlns:g="urn:geo" xmlns:m="urn:meta" m:key="'), k.cast("string"), F.lit('"><g:name>'), name, F.lit("</g:name></g:nation>"))
    twice = F.concat(F.lit('<a:nation xmlns:a="urn:geo"><b:name xmlns:b="urn:geo">'), name, F.lit('</b:name><m:x xmlns:m="urn:meta"/></a:nation>'))
    return n.select(k.cast("long").alias("doc_id"), F.when(k % 3 == 0, plain).when(k % 3 == 1, prefixed).otherwise(twice).alias("xml"))
