"""Operators on event streams: DataFrames ordered by (doc_id, seq).

Everything that needs order is a window over ``doc_id``, so one shuffle serves a whole
chain of filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sylva.functions.text import canonical, only_space

from .dtd import DTD_ROWS

WRAPPING = ["start_doc", "end_doc", "start_super", "end_super", "end_of_stream", "position"]


def order() -> WindowSpec:
    """In document order within a document."""
    return Window.partitionBy("doc_id").orderBy("seq")


def pfilter(events: DataFrame, predicate: Column) -> DataFrame:
    return events.filter(predicate)


def renumber(events: DataFrame) -> DataFrame:
    """``seq`` without gaps."""
    return events.withColumn("seq", F.row_number().over(order()).cast("long") - 1)


def depth(events: DataFrame) -> DataFrame:
    """With ``depth``: how many elements are open at an event, its own included."""
    turn = F.when(F.col("kind") == "start_tag", 1).when(F.col("kind") == "end_tag", -1).otherwise(0)
    running = F.sum(turn).over(order().rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("depth", (running + F.when(F.col("kind") == "end_tag", 1).otherwise(0)).cast("int"))


def norm_cdata(events: DataFrame) -> DataFrame:
    """Empty character data goes, neighbouring pieces become one (islands of
    character data, each named by its first event)."""
    rows = events.filter("kind <> 'char_data' OR value <> ''")
    data = F.col("kind") == "char_data"
    starts = F.when(data & (F.coalesce(F.lag("kind").over(order()), F.lit("")) == "char_data"), 0).otherwise(1)
    island = rows.withColumn("_island", F.sum(starts).over(order().rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"]), "")
    firsts = [F.min_by(c, "seq").alias(c) for c in events.columns if c not in ("doc_id", "seq", "value")]
    return island.groupBy("doc_id", "_island").agg(F.min("seq").alias("seq"), text.alias("_text"), F.min_by("value", "seq").alias("value"), *firsts).withColumn("value", F.when(F.col("kind") == "char_data", F.col("_text")).otherwise(F.col("value"))).select(*events.columns)


def with_parent(events: DataFrame) -> DataFrame:
    """With ``parent_name`` and ``parent_seq``: the element that an event is in. At
    each level the last start tag before an event is the open one."""
    d = depth(events)
    level = d.withColumn("_up", F.when(F.col("kind").isin("start_tag", "end_tag"), F.col("depth") - 1).otherwise(F.col("depth")))
    starts = d.filter("kind = 'start_tag'").select("doc_id", F.col("depth").alias("_up"), F.col("seq").alias("_s"), F.col("name").alias("_n"), F.lit(True).alias("_open"))
    both = level.withColumns({"_s": F.col("seq"), "_n": F.lit(None).cast("string"), "_open": F.lit(False)}).unionByName(starts, allowMissingColumns=True)
    w = Window.partitionBy("doc_id", "_up").orderBy("_s", F.col("_open").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_open"), F.struct("_s", "_n")), ignorenulls=True).over(w)
    return both.withColumn("_p", last).filter(~F.col("_open")).withColumns({"parent_name": F.col("_p._n"), "parent_seq": F.col("_p._s")}).select(*events.columns, "depth", "parent_name", "parent_seq")


def drop_ignorable_whitespace(events: DataFrame, dtd_elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blank character data in elements that take only elements goes. Second: a
    diagnostic for each other text there."""
    models = dtd_elements.select(F.col("name").alias("parent_name"), "model_kind")
    few = models.limit(DTD_ROWS + 1).count() <= DTD_ROWS
    rows = with_parent(events).join(F.broadcast(models) if few else models, "parent_name", "left")
    ruled = (F.col("kind") == "char_data") & (F.col("model_kind") == "regexp")
    blank = only_space(F.col("value"))
    bad = rows.filter(ruled & ~blank).select("doc_id", "seq", F.concat(F.lit("Element `"), F.col("parent_name"), F.lit("' must not have character contents")).alias("message"))
    return rows.filter(~F.coalesce(ruled & blank, F.lit(False))).select(*events.columns), bad


def unwrap_document(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the events around the root element; second, a row for each document
    with its error, if any."""
    inner = events.filter(~F.col("kind").isin(*WRAPPING, "error"))
    heads = events.groupBy("doc_id").agg(F.max(F.when(F.col("kind") == "error", F.col("value"))).alias("error"))
    return inner, heads


def extract(events: DataFrame, from_seq: Column) -> DataFrame:
    """The balanced subexpression that starts at ``from_seq``: to the end tag of the
    same depth, or the one event alone."""
    d = depth(events).withColumn("_from", from_seq).filter("seq >= _from")
    first = F.min_by(F.struct("kind", "depth"), "seq").over(Window.partitionBy("doc_id"))
    d = d.withColumn("_first", first)
    end = F.min(F.when((F.col("_first.kind") != "start_tag") | ((F.col("kind") == "end_tag") & (F.col("depth") == F.col("_first.depth"))), F.col("seq"))).over(Window.partitionBy("doc_id"))
    return d.withColumn("_end", end).filter("seq <= _end").select(*events.columns)


def to_list(events: DataFrame) -> DataFrame:
    """One row for each document, its events as an array in order."""
    rest = [c for c in events.columns if c not in ("doc_id", "seq")]
    return events.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", *rest))).alias("events"))


def of_list(lists: DataFrame) -> DataFrame:
    return lists.select("doc_id", F.inline("events"))


def concat(*streams: DataFrame) -> DataFrame:
    """The streams one after another, for each document."""
    rows = None
    for k, s in enumerate(streams):
        one = s.withColumn("_stream", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    w = Window.partitionBy("doc_id").orderBy("_stream", "seq")
    return rows.withColumn("seq", F.row_number().over(w).cast("long") - 1).drop("_stream")


def event_text(attrs: str = "attrs") -> Column:
    """The markup of an event in canonical form: attributes by name, empty elements
    with two tags."""
    sorted_attrs = F.array_sort(F.transform(attrs, lambda a: F.struct(a["name"].alias("name"), a["value"].alias("value"))))
    listed = F.array_join(F.transform(sorted_attrs, lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), canonical(a["value"]), F.lit('"'))), "")
    kind, name, value = F.col("kind"), F.col("name"), F.coalesce("value", F.lit(""))
    return (
        F.when(kind == "start_tag", F.concat(F.lit("<"), name, listed, F.lit(">")))
        .when(kind == "end_tag", F.concat(F.lit("</"), name, F.lit(">")))
        .when(kind == "char_data", canonical(value))
        .when(kind == "pinstr", F.concat(F.lit("<?"), name, F.lit(" "), value, F.lit("?>")))
        .when(kind == "comment", F.concat(F.lit("<!--"), value, F.lit("-->")))
        .otherwise("")
    )


def write(events: DataFrame, column: str = "xml") -> DataFrame:
    """(doc_id, xml): every document as canonical text."""
    parts = events.select("doc_id", "seq", event_text().alias("t")).filter("t <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "t"))), lambda s: s["t"]), "")
    return parts.groupBy("doc_id").agg(joined.alias(column))


def write_documents(events: DataFrame, dtd=None, style: str = "omit", system: str | None = None, column: str = "xml") -> DataFrame:
    """Whole documents with an XML declaration. ``style``: ``omit`` the DOCTYPE,
    ``reference`` the declarations, ``include`` them, or ``auto``: refer to them where
    there is a system id."""
    if style == "auto":
        style = "reference" if system else "include" if dtd is not None else "omit"
    head = {"omit": lambda: "", "reference": lambda: dtd.write_reference(system), "include": lambda: dtd.write_included()}[style]()
    return write(events, column).withColumn(column, F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n{head}'), column))


def display_documents(events: DataFrame, prefixes: DataFrame, dtd=None, style: str = "omit", system: str | None = None) -> DataFrame:
    """Whole documents as ``write_documents`` gives them, with display prefixes."""
    return write_documents(display_events(events, prefixes), dtd, style, system)


def described(events: DataFrame) -> DataFrame:
    """(doc_id, seq, text): a line for each event, for reading."""
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), a["name"], F.lit("="), a["value"])), "")
    return events.select("doc_id", "seq", F.concat(F.concat_ws(" ", "kind", "name", "value"), F.coalesce(attrs, F.lit(""))).alias("text"))


def display(events: DataFrame, prefixes: DataFrame, column: str = "xml") -> DataFrame:
    """The text of ``display_events``."""
    return write(display_events(events, prefixes), column)


def display_events(events: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Events with display prefixes: ``prefixes`` (doc_id, normprefix, display,
    uri) renames them, and the root declares them all. An empty display prefix is
    allowed for elements only; ns1, ns2, ... are made up where there is none."""
    made = Window.partitionBy("doc_id").orderBy("normprefix")
    named = prefixes.withColumn("display", F.coalesce("display", F.concat(F.lit("ns"), F.row_number().over(made).cast("string"))))
    maps = named.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("normprefix", "display"))).alias("_map"), F.map_from_entries(F.collect_list(F.struct("display", "uri"))).alias("_uris"))
    rows = depth(events).join(maps, "doc_id", "left")

    def shown(name: Column) -> Column:
        at = F.instr(name, ":")
        own = F.try_element_at("_map", F.substring(name, F.lit(1), at - 1))
        local = F.substring(name, at + 1, F.length(name))
        return F.when(at == 0, name).when(own == "", local).when(own.isNull(), name).otherwise(F.concat(own, F.lit(":"), local))

    declared = F.transform(F.map_entries("_uris"), lambda e: F.struct(F.when(e["key"] == "", "xmlns").otherwise(F.concat(F.lit("xmlns:"), e["key"])).alias("name"), e["value"].alias("value")))
    attrs = F.transform("attrs", lambda a: F.struct(shown(a["name"]).alias("name"), a["value"].alias("value")))
    root = (F.col("kind") == "start_tag") & (F.col("depth") == 1) & F.col("_uris").isNotNull()
    return rows.withColumns({"name": F.when(F.col("kind").isin("start_tag", "end_tag"), shown(F.col("name"))).otherwise(F.col("name")), "attrs": F.when(root, F.concat(attrs, declared)).otherwise(attrs)}).select(*events.columns)


def errors(events: DataFrame) -> DataFrame:
    """Well-formedness of a stream by itself: start and end tags pair by depth, in
    order, with equal names, and one root is closed."""
    tags = depth(events).filter("kind IN ('start_tag', 'end_tag')")
    w = Window.partitionBy("doc_id", "depth").orderBy("seq")
    before = F.lag(F.struct("kind", "name")).over(w)
    bad = tags.withColumn("_b", before).filter((F.col("kind") == "end_tag") & ((F.col("_b.kind") != "start_tag") | F.col("_b").isNull() | (F.col("_b.name") != F.col("name")))).select("doc_id", "seq", F.lit("end tag without start tag").alias("message"))
    sums = events.groupBy("doc_id").agg(F.sum(F.when(F.col("kind") == "start_tag", 1).when(F.col("kind") == "end_tag", -1).otherwise(0)).alias("n"), F.max("seq").alias("seq"))
    open_ = sums.filter("n <> 0").select("doc_id", "seq", F.lit("elements are not closed").alias("message"))
    roots = tags.filter("depth = 1 AND kind = 'start_tag'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("seq").alias("seq")).filter("n > 1").select("doc_id", "seq", F.lit("more than one root").alias("message"))
    return bad.unionByName(open_).unionByName(roots)


def records(events: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """Flat records of a stream: for each ``record`` element, the text of its named
    children (null where there is none)."""
    d = with_parent(events)
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(F.when((F.col("kind") == "start_tag") & (F.col("name") == record), 1).otherwise(0)).over(w)
    text = d.withColumn("_record", number).filter((F.col("kind") == "char_data") & F.col("parent_name").isin(*fields))
    rows = text.groupBy("doc_id", "_record").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("parent_name") == f, F.struct("seq", "value")))), lambda s: s["value"]), "").alias(f"_{k}") for k, f in enumerate(fields)], *[F.max(F.col("parent_name") == f).alias(f"_has{k}") for k, f in enumerate(fields)])
    return rows.select("doc_id", F.col("_record").alias("record"), *[F.when(F.col(f"_has{k}"), F.col(f"_{k}")).alias(f) for k, f in enumerate(fields)])
