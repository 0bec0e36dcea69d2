"""Operators on node tables: conversion, navigation, search and functional edits.

An edit makes a new table; ``renumber`` gives pre, fin, level, parent, pos and path
again from the order that ``path`` has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sylva.functions.text import SPACE
from sylva.sources.store import roundtrip

from .events import depth
from .structure import key, pairs, wide, with_path


def sibling_order() -> WindowSpec:
    return Window.partitionBy("doc_id", "parent").orderBy("pos")


def solidify(events: DataFrame) -> DataFrame:
    """Events to nodes: each start tag meets its end tag, which is the next end tag of
    its depth; ``pre`` counts the events that open nodes."""
    opens = F.col("kind").isin("start_tag", "char_data", "pinstr", "comment")
    d = depth(events.filter(opens | (F.col("kind") == "end_tag")))
    order = Window.partitionBy("doc_id").orderBy("seq")
    d = d.withColumn("_pre", F.sum(opens.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    d = d.withColumn("level", F.when(F.col("kind").isin("start_tag", "end_tag"), F.col("depth")).otherwise(F.col("depth") + 1))
    level = Window.partitionBy("doc_id", "level").orderBy("seq")
    # an element's end tag follows its start tag among the tags of its level
    tags = d.filter("kind IN ('start_tag', 'end_tag')").withColumn("_next", F.lead("_pre").over(level)).filter("kind = 'start_tag'").select("doc_id", "seq", F.col("_next").alias("_fin"))
    nodes = d.filter(opens).join(tags, ["doc_id", "seq"], "left").withColumn("fin", F.coalesce("_fin", "_pre"))
    above = nodes.filter("kind = 'start_tag'").select("doc_id", (F.col("level") + 1).alias("level"), F.col("_pre").alias("_at"), F.col("_pre").alias("_parent"))
    rows = nodes.withColumn("_at", F.col("_pre")).withColumn("_parent", F.lit(None).cast("long")).select("doc_id", "level", "_at", "_parent", F.lit(1).alias("_is"), "_pre", "fin", "kind", "name", "value", "attrs")
    both = rows.unionByName(above.withColumn("_is", F.lit(0)), allowMissingColumns=True)
    near = Window.partitionBy("doc_id", "level").orderBy("_at", "_is").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("parent", F.coalesce(F.last("_parent", ignorenulls=True).over(near), F.lit(0).cast("long"))).filter("_is = 1")
    kind = F.when(F.col("kind") == "start_tag", "element").when(F.col("kind") == "char_data", "data").otherwise(F.col("kind"))
    pos = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("_pre")) - 1
    return found.select("doc_id", F.col("_pre").alias("pre"), "fin", "level", "parent", pos.alias("pos"), kind.alias("kind"), "name", "value", "attrs")


def liquefy(nodes: DataFrame) -> DataFrame:
    """Nodes to events: every node opens at its ``pre``, elements close after ``fin``,
    the deepest first."""
    pairs = F.transform("attrs", lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value")))
    body = nodes.filter("kind <> 'super_root'")
    kind = F.when(F.col("kind") == "element", "start_tag").when(F.col("kind") == "data", "char_data").otherwise(F.col("kind"))
    opening = body.select("doc_id", F.col("pre").alias("_a"), F.lit(0).alias("_b"), F.lit(0).alias("_c"), kind.alias("kind"), "name", F.when(F.col("kind") != "element", F.col("value")).alias("value"), pairs.alias("attrs"))
    closing = body.filter("kind = 'element'").select("doc_id", F.col("fin").alias("_a"), F.lit(1).alias("_b"), (-F.col("level")).alias("_c"), F.lit("end_tag").alias("kind"), "name", F.lit(None).cast("string").alias("value"), F.array().cast("array<struct<name:string,value:string>>").alias("attrs"))
    w = Window.partitionBy("doc_id").orderBy("_a", "_b", "_c")
    return opening.unionByName(closing).withColumn("seq", F.row_number().over(w).cast("long") - 1).select("doc_id", "seq", "kind", "name", "value", "attrs")


def descendants(nodes: DataFrame, of: DataFrame, matching: Column) -> DataFrame:
    """(doc_id, of, ...node) for nodes below those in ``of`` (doc_id, pre, fin)."""
    start = with_path(of, nodes).select(F.col("doc_id").alias("_d"), F.col("pre").alias("_a"), F.col("pre").alias("of"), F.col("fin").alias("_f"), F.col("path").alias("_path"))
    return pairs(nodes.filter(matching), start).drop("_a", "_f")


def find_all(nodes: DataFrame, of: DataFrame, matching: Column, deeply: bool = True) -> DataFrame:
    """All matches among the descendants (or children) of given nodes."""
    if deeply:
        return descendants(nodes, of, matching)
    start = of.select(F.col("doc_id").alias("_d"), F.col("pre").alias("of"))
    return nodes.filter(matching).join(wide(start), (F.col("doc_id") == F.col("_d")) & (F.col("parent") == F.col("of"))).drop("_d")


def find_first(nodes: DataFrame, of: DataFrame, matching: Column, deeply: bool = True) -> DataFrame:
    """The first match of each given node that has one."""
    found = find_all(nodes, of, matching, deeply)
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "of").orderBy("pre"))).filter("_n = 1").drop("_n")


def node_data(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(doc_id, of, data): the text below elements, comments and instructions left out."""
    below = descendants(nodes, of, F.col("kind") == "data")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "value"))), lambda s: s["value"]), "")
    some = below.groupBy("doc_id", "of").agg(text.alias("data"))
    return of.select("doc_id", F.col("pre").alias("of")).join(wide(some), ["doc_id", "of"], "left").withColumn("data", F.coalesce("data", F.lit("")))


def siblings(nodes: DataFrame) -> DataFrame:
    """With the pre of the previous and the next sibling."""
    return nodes.withColumns({"previous": F.lag("pre").over(sibling_order()), "next": F.lead("pre").over(sibling_order())})


def document_order(nodes: DataFrame) -> DataFrame:
    """With ``ord``: the rank of a node in its document by path."""
    return nodes.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1)


def post_order(nodes: DataFrame) -> DataFrame:
    """With ``post``: the rank in which traversal leaves nodes."""
    return nodes.withColumn("post", F.row_number().over(Window.partitionBy("doc_id").orderBy("fin", F.desc("level"))) - 1)


# ---- edits

def prune(nodes: DataFrame, matching: Column) -> DataFrame:
    """Without the subtrees of matching nodes (not numbered anew): a node goes if a
    matching one before it, or itself, ends behind it."""
    before = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.max(F.when(matching, F.col("fin"))).over(before)
    return nodes.withColumn("_ends", ends).filter("_ends IS NULL OR _ends < pre").drop("_ends")


def renumber(nodes: DataFrame) -> DataFrame:
    """pre, fin, level, pos and parent from ``path``, which orders the nodes. Paths
    may have gaps; a node's parent has its path without the last number.

    Each node has a mark that its path orders behind all below it: the nodes counted up
    to the mark give ``fin``."""
    last = F.lit(2**31 - 1)
    ends = F.array(F.struct(F.col("path").alias("path"), F.lit(1).alias("_is")), F.struct(F.concat("path", F.array(last)).alias("path"), F.lit(0).alias("_is")))
    both = nodes.select("doc_id", key().alias("_key"), F.inline(ends))
    order = Window.partitionBy("doc_id").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("_n", F.sum("_is").over(order) - 1)
    places = counted.groupBy("doc_id", "_key").agg(F.max(F.when(F.col("_is") == 1, F.col("_n"))).alias("_pre"), F.max(F.when(F.col("_is") == 0, F.col("_n"))).alias("_fin"))
    up = F.when(F.size("path") > 0, key(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))))
    rows = nodes.withColumns({"_key": key(), "_up": up, "level": F.size("path")}).join(wide(places), ["doc_id", "_key"])
    parents = places.select("doc_id", F.col("_key").alias("_up"), F.col("_pre").alias("_parent"))
    out = rows.join(wide(parents), ["doc_id", "_up"], "left")
    pos = F.when(F.size("path") > 0, F.row_number().over(Window.partitionBy("doc_id", "_up").orderBy("path")) - 1).otherwise(0)
    out = out.withColumns({"pre": F.col("_pre"), "fin": F.col("_fin"), "parent": F.col("_parent"), "pos": pos})
    return out.select(*nodes.columns)


def remove(nodes: DataFrame, matching: Column) -> DataFrame:
    return renumber(prune(nodes, matching))


def insert(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Insert leaf elements ``new`` (doc_id, parent, pos, name, value, attrs): each goes
    before the child at ``pos`` of its parent, or behind the last."""
    paths = nodes.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_p"), F.col("path").alias("_path"))
    at = new.join(wide(paths), (F.col("doc_id") == F.col("_d")) & (F.col("parent") == F.col("_p")))
    # old children move to odd numbers, new ones take the even number before
    kinds = dict(nodes.dtypes)
    rows = at.withColumns({"path": F.concat(F.transform("_path", lambda k: 2 * k + 1), F.array(2 * F.col("pos"))), "kind": F.lit("element")})
    fill = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in rows.columns}
    rows = rows.withColumns(fill).select(*[F.col(c).cast(kinds[c]).alias(c) for c in nodes.columns])
    spread = nodes.withColumn("path", F.transform("path", lambda k: 2 * k + 1))
    return renumber(spread.unionByName(rows))


def sort_children(nodes: DataFrame, of: str, key: str) -> DataFrame:
    """Children of elements named ``of`` in the order of the text of their first child
    named ``key`` (missing: first), ties in their old order."""
    parents = nodes.filter((F.col("kind") == "element") & (F.col("name") == of)).select("doc_id", F.col("pre").alias("parent"))
    kids = nodes.join(wide(parents), ["doc_id", "parent"]).select("doc_id", "parent", "pre", "pos")
    keys = nodes.filter((F.col("kind") == "element") & (F.col("name") == key)).select("doc_id", F.col("parent").alias("pre"), F.struct("pos", "value").alias("_v")).groupBy("doc_id", "pre").agg(F.min("_v").alias("_v"))
    ranked = kids.join(wide(keys), ["doc_id", "pre"], "left").withColumn("_to", F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy(F.coalesce("_v.value", F.lit("")), "pos")) - 1)
    moved = ranked.select("doc_id", "pre", "_to")
    # a node's path changes at the level of each ancestor that moved
    spans = nodes.select("doc_id", "pre", "fin", "level", "path").join(wide(moved), ["doc_id", "pre"]).select(F.col("doc_id").alias("_d"), F.col("pre").alias("_a"), F.col("fin").alias("_f"), F.col("path").alias("_path"), (F.col("level") - 1).alias("_at"), "_to")
    hits = pairs(nodes.select("doc_id", "pre", "path"), spans, own=True).groupBy("doc_id", "pre").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_to"))).alias("_map"))
    out = nodes.join(wide(hits), ["doc_id", "pre"], "left")
    path = F.transform("path", lambda k, i: F.coalesce(F.try_element_at("_map", i), k))
    # numbering reads the moved nodes more than once
    return renumber(roundtrip(out.withColumn("path", F.when(F.col("_map").isNull(), F.col("path")).otherwise(path)).select(*nodes.columns), "moved"))


def normalize(nodes: DataFrame) -> DataFrame:
    """Empty data nodes go, neighbouring ones merge into the first."""
    rows = nodes.filter("kind <> 'data' OR value <> ''")
    data = F.col("kind") == "data"
    w = Window.partitionBy("doc_id", "parent").orderBy("path")
    starts = F.when(data & (F.coalesce(F.lag("kind").over(w), F.lit("")) == "data"), 0).otherwise(1)
    rows = rows.withColumn("_i", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("doc_id", "parent", "_i")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "value")).over(group)), lambda s: s["value"]), "")
    merged = rows.withColumns({"_t": text, "_n": F.row_number().over(group.orderBy("path"))}).filter("_n = 1 OR kind <> 'data'")
    return renumber(merged.withColumn("value", F.when(data, F.col("_t")).otherwise(F.col("value"))).select(*nodes.columns))


_STRIP = {
    "seq": (f"^{SPACE}+", f"{SPACE}+$"),
    "one": (f"^{SPACE}", f"{SPACE}$"),
    "one_lf": (r"^(\r\n|\n|\r)", r"(\r\n|\n|\r)$"),
    "disabled": ("^", "$"),
}


def strip_whitespace(nodes: DataFrame, left: str = "seq", right: str = "seq", delete_empty: bool = False) -> DataFrame:
    """Strip the first data child of each element at its left and the last at its
    right. Comments don't count; below xml:space="preserve" nothing is stripped."""
    space = F.filter("attrs", lambda a: a["name"] == "xml:space")
    owners = nodes.filter(F.size(space) > 0).select(F.col("doc_id").alias("_d"), F.col("pre").alias("_a"), F.col("fin").alias("_f"), F.col("path").alias("_path"), F.get(space, 0)["value"].alias("_s"))
    near = pairs(nodes.filter("kind = 'data'").select("doc_id", "pre", "path"), owners, own=True).groupBy("doc_id", "pre").agg(F.max_by("_s", "_a").alias("_space"))
    counted = nodes.filter("kind NOT IN ('comment', 'super_root')").groupBy("doc_id", "parent").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    rows = nodes.join(wide(near), ["doc_id", "pre"], "left").join(wide(counted), ["doc_id", "parent"], "left")
    ruled = (F.col("kind") == "data") & (F.coalesce("_space", F.lit("default")) != "preserve")
    value = F.when(ruled & (F.col("pos") == F.col("_first")), F.regexp_replace("value", _STRIP[left][0], "")).otherwise(F.col("value"))
    value = F.when(ruled & (F.col("pos") == F.col("_last")), F.regexp_replace(value, _STRIP[right][1], "")).otherwise(value)
    out = rows.withColumn("value", value).select(*nodes.columns)
    return renumber(out.filter("kind <> 'data' OR value <> ''")) if delete_empty else out


def set_attribute(nodes: DataFrame, matching: Column, name: str, value: Column) -> DataFrame:
    """Matching elements get the attribute, in the place of an old one."""
    element = F.transform("attrs", lambda a: F.when(a["name"] == name, a.withField("value", value)).otherwise(a))
    has = F.exists("attrs", lambda a: a["name"] == name)
    kind = nodes.schema["attrs"].dataType.elementType
    made = {f.name: F.lit(None).cast(f.dataType) for f in kind.fields} | {"name": F.lit(name), "local": F.lit(name), "value": value, "pos": F.size("attrs")}
    new = F.struct(*[made[f.name].cast(f.dataType).alias(f.name) for f in kind.fields])
    return nodes.withColumn("attrs", F.when(matching & has, element).when(matching, F.concat("attrs", F.array(new))).otherwise(F.col("attrs")))


def clone(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Subtrees as documents of their own: ``roots`` (doc_id, pre, fin, path, new_id)."""
    r = roots.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_a"), F.col("fin").alias("_f"), F.col("path").alias("_path"), F.size("path").alias("_n"), "new_id")
    inside = pairs(nodes, r, own=True)
    moved = inside.withColumns({"doc_id": F.col("new_id"), "path": F.concat(F.array(F.lit(0)), F.slice("path", F.col("_n") + 1, F.size("path")))}).select(*nodes.columns)
    top = roots.select(F.col("new_id").alias("doc_id")).withColumns({"kind": F.lit("super_root"), "path": F.array().cast("array<int>")})
    fill = {c: F.lit(None).cast(t) for c, t in nodes.dtypes if c not in top.columns}
    fill |= {c: F.array().cast(t) for c, t in nodes.dtypes if c in ("attrs", "ns")}
    return renumber(moved.unionByName(top.withColumns(fill).select(*nodes.columns)))


def map_tree(nodes: DataFrame, pre: Column | None = None, post: dict[str, Column] | None = None, skip: Column | None = None) -> DataFrame:
    """A rewritten copy: nodes for which ``skip`` holds go on the way down with all below
    them; ``post`` gives columns of the nodes that are left anew; nodes for which ``pre``
    doesn't hold go by themselves, and what was below them moves up to their place."""
    rows = prune(nodes, skip) if skip is not None else nodes
    rows = rows.withColumns(post) if post else rows
    if pre is not None:
        # the numbers of a node that goes stay in the paths below it, which keeps the
        # order; a level less is made up for by the nearest ancestor that stays
        kept = rows.filter(pre | (F.col("kind") == "super_root"))
        up = kept.select(F.col("doc_id").alias("_d"), F.col("pre").alias("_a"), F.col("fin").alias("_f"), F.col("path").alias("_path"), F.size("path").alias("_n"))
        own = kept.select("doc_id", F.col("pre"), "path")
        above = pairs(own, up, own=True).groupBy("doc_id", "pre").agg(F.array_sort(F.collect_list("_n")).alias("_levels"))
        # each remaining step is the whole way from one that stays to the next, as a number
        order = Window.partitionBy("doc_id").orderBy("path")
        ranked = kept.withColumn("_rank", F.row_number().over(order))
        keyed = ranked.join(wide(above), ["doc_id", "pre"])
        ranks = ranked.select(F.col("doc_id").alias("_d"), key().alias("_own"), F.col("_rank").alias("_r"))
        steps = keyed.select("doc_id", "pre", F.posexplode(F.transform(F.filter("_levels", lambda n: n > 0), lambda n: F.xxhash64(F.slice("path", 1, n)))).alias("_i", "_key"))
        paths = steps.join(wide(ranks), (F.col("doc_id") == F.col("_d")) & (F.col("_key") == F.col("_own"))).groupBy("doc_id", "pre").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_r"))), lambda s: s["_r"]).cast("array<int>").alias("_new"))
        rows = kept.join(wide(paths), ["doc_id", "pre"], "left").withColumn("path", F.coalesce("_new", F.array().cast("array<int>"))).select(*nodes.columns)
    return renumber(rows.select(*nodes.columns))


def dump(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, text): a line for each node, for reading."""
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), a["name"], F.lit("="), a["value"])), "")
    said = F.when(F.col("kind") == "element", F.concat("name", attrs)).otherwise(F.concat_ws(" ", "kind", "name", F.when(F.col("kind") != "super_root", F.col("value"))))
    return nodes.select("doc_id", "pre", F.concat(F.repeat(F.lit("  "), F.size("path")), said).alias("text"))


def extend(nodes: DataFrame, column: str, registry: dict[str, Column], default: Column | None = None) -> DataFrame:
    """A computed column chosen by element name, as extensions of a tree are."""
    out = default if default is not None else F.lit(None)
    for name, value in registry.items():
        out = F.when((F.col("kind") == "element") & (F.col("name") == name), value).otherwise(out)
    return nodes.withColumn(column, out)
