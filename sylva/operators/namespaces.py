"""Namespaces over events, nodes and plain (doc_id, seq, prefix, uri) declarations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .structure import pairs

#: Prefixes that are put into an expression; more are joined.
MOST_PREFIXES = 1000


def normalize(declarations: DataFrame) -> DataFrame:
    """(doc_id, uri, normprefix) from declarations in order: the first prefix seen for
    a URI names it; if an earlier URI has that name, a number from 1 is added (also
    where the prefix is empty).

    The k-th URI that wants a prefix gets the k-th free name, which makes the rule a
    rank; names that other declarations spell out literally are passed over."""
    first = declarations.filter("uri <> ''").groupBy("doc_id", "uri").agg(F.min(F.struct("seq", "prefix")).alias("f")).select("doc_id", "uri", F.col("f.seq").alias("seq"), F.col("f.prefix").alias("prefix"))
    names = F.array_sort(F.collect_list(F.struct("seq", "prefix", "uri")))
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<struct<uri:string,normprefix:string>>").alias("out"))

    def add(acc, d):
        tries = F.concat(F.when(d["prefix"] != "", F.array(d["prefix"])).otherwise(F.array().cast("array<string>")), F.transform(F.sequence(F.lit(1), F.size(acc["taken"]) + 1), lambda k: F.concat(d["prefix"], k.cast("string"))))
        name = F.filter(tries, lambda t: ~F.array_contains(acc["taken"], t))[0]
        return F.struct(F.concat(acc["taken"], F.array(name)).alias("taken"), F.concat(acc["out"], F.array(F.struct(d["uri"].alias("uri"), name.alias("normprefix")))).alias("out"))

    # the URIs of one document, a handful, are folded in order
    return first.groupBy("doc_id").agg(names.alias("d")).select("doc_id", F.inline(F.aggregate("d", start, add, lambda a: a["out"])))


def declarations(nodes: DataFrame) -> DataFrame:
    """(doc_id, seq, prefix, uri) of documents parsed without namespaces, from their
    xmlns attributes; ``seq`` orders them by element and place."""
    a = nodes.select("doc_id", F.col("pre").alias("owner"), F.col("fin"), "path", F.inline("attrs")).filter("name = 'xmlns' OR name LIKE 'xmlns:%'")
    prefix = F.when(F.col("name") == "xmlns", "").otherwise(F.substring("name", 7, 2**31 - 1))
    return a.select("doc_id", "owner", "fin", "path", F.struct("owner", "pos").alias("seq"), prefix.alias("prefix"), F.col("value").alias("uri"))


def effective(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, prefix, uri) in scope at each element: the nearest declaration of
    each prefix; an empty URI hides it."""
    owners = declarations(nodes).select(F.col("doc_id").alias("_d"), F.col("owner").alias("_a"), F.col("fin").alias("_f"), F.col("path").alias("_path"), "owner", "prefix", "uri")
    seen = pairs(nodes.filter("kind = 'element'").select("doc_id", "pre", "path"), owners, own=True)
    near = seen.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "pre", "prefix").orderBy(F.desc("owner")))).filter("_n = 1 AND uri <> ''")
    return near.select("doc_id", "pre", "prefix", "uri")


def resolve(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, name, uri, local): names of elements with the URI of their prefix;
    uri is null where the prefix isn't declared."""
    at = F.instr("name", ":")
    rows = nodes.filter("kind = 'element'").select("doc_id", "pre", "name", F.when(at > 0, F.substring("name", F.lit(1), at - 1)).otherwise("").alias("prefix"), F.when(at > 0, F.substring("name", at + 1, F.length("name"))).otherwise(F.col("name")).alias("local"))
    found = rows.join(effective(nodes), ["doc_id", "pre", "prefix"], "left")
    return found.select("doc_id", "pre", "name", F.when((F.col("prefix") == "") & F.col("uri").isNull(), "").otherwise(F.col("uri")).alias("uri"), "local")


def display_prefixes(nodes: DataFrame) -> DataFrame:
    """(doc_id, normprefix, display, uri) of documents parsed with namespaces: the
    prefix by which a URI is first known."""
    ns = nodes.filter("kind = 'element'").select("doc_id", "pre", F.inline("ns")).filter("uri <> '' AND prefix <> 'xml'")
    return ns.groupBy("doc_id", "normprefix").agg(F.min(F.struct("pre", "pos", "prefix", "uri")).alias("f")).select("doc_id", "normprefix", F.col("f.prefix").alias("display"), F.col("f.uri").alias("uri"))


def relocate(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Elements and attributes under another set of normalised prefixes (uri,
    normprefix): names are made again from URIs; a URI that isn't there keeps its prefix."""

    def renamed(prefix, local, name):
        return F.when(local.isNull(), name).when(prefix == "", local).otherwise(F.concat(prefix, F.lit(":"), local))

    few = prefixes.select("uri", "normprefix").limit(MOST_PREFIXES + 1).collect()
    if not few:
        return nodes
    if len(few) <= MOST_PREFIXES:
        table = F.create_map(*[F.lit(x) for r in few for x in (r["uri"], r["normprefix"])])
        fresh = lambda uri, prefix: F.coalesce(F.try_element_at(table, uri), prefix)

        def moved(a):
            prefix = fresh(a["uri"], a["prefix"])
            return a.withField("prefix", prefix).withField("name", renamed(prefix, a["local"], a["name"]))

        prefix = fresh(F.col("uri"), F.col("prefix"))
        return nodes.withColumns({"name": renamed(prefix, F.col("local"), F.col("name")), "prefix": prefix, "attrs": F.transform("attrs", moved)}).select(*nodes.columns)
    table = prefixes.select(F.col("uri").alias("_u"), F.col("normprefix").alias("_p"))
    each = nodes.filter(F.size("attrs") > 0).select("doc_id", "pre", F.explode("attrs").alias("_x")).join(table, F.col("_x.uri") == F.col("_u"), "left")
    x, own = F.col("_x"), F.coalesce("_p", "_x.prefix")
    lists = each.groupBy("doc_id", "pre").agg(F.array_sort(F.collect_list(x.withField("prefix", own).withField("name", renamed(own, x["local"], x["name"])))).alias("_attrs"))
    rows = nodes.join(table, F.col("uri") == F.col("_u"), "left").join(lists, ["doc_id", "pre"], "left")
    prefix = F.coalesce("_p", "prefix")
    return rows.withColumns({"name": renamed(prefix, F.col("local"), F.col("name")), "prefix": prefix, "attrs": F.coalesce("_attrs", "attrs")}).select(*nodes.columns)
