"""Documents (doc_id, xml) to events and nodes, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva import ship

from .parser import Columns, Options, iterate, split_name, stream_nodes

EVENTS = "doc_id long, seq long, kind string, name string, value string, attrs array<struct<name:string,value:string>>, line int, col int"

#: ``value`` of an element or the super root is its string value: the text below it.
NODES = (
    "doc_id long, pre long, fin long, level int, parent long, pos int, path array<int>, kind string, name string, prefix string, local string, uri string, value string, "
    "attrs array<struct<pos:int,name:string,prefix:string,local:string,uri:string,type:string,value:string>>, ns array<struct<pos:int,prefix:string,normprefix:string,uri:string>>, line int, col int"
)

_PAIR = pa.struct([("name", pa.string()), ("value", pa.string())])
_ATTR = pa.struct([("pos", pa.int32()), ("name", pa.string()), ("prefix", pa.string()), ("local", pa.string()), ("uri", pa.string()), ("type", pa.string()), ("value", pa.string())])
_NS = pa.struct([("pos", pa.int32()), ("prefix", pa.string()), ("normprefix", pa.string()), ("uri", pa.string())])
_EVENT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(_PAIR), pa.int32(), pa.int32()]
_NODE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(_ATTR), pa.list_(_NS), pa.int32(), pa.int32()]

#: Rows that a batch sent back to Spark has, about, and characters of their values.
BATCH, CHARS = 20_000, 4 << 20


def _emit(rows: Iterator[tuple], types: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    chars, value = 0, names.index("value")
    for row in rows:
        held.append(row)
        chars += len(row[value] or "")
        if len(held) >= BATCH or chars >= CHARS:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, chars = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _names(ddl: str) -> list[str]:
    depth, out, word = 0, [], ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return [*out, word.split()[0]]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None]]:
    """One at a time: a batch of large documents isn't in memory twice."""
    for batch in batches:
        for doc, xml in zip(batch.column(0), batch.column(1)):
            yield doc.as_py(), xml.as_py()


def parse_events(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """One row for each event; a document that isn't well-formed ends with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc, xml in _documents(batches):
                for seq, e in enumerate(iterate(xml, options)):
                    yield doc, seq, e.kind, e.name, e.value, [{"name": n, "value": v} for n, v in e.attrs], e.line, e.col

        return _emit(rows(), _EVENT_TYPES, _names(EVENTS))

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "xml").mapInArrow(run, EVENTS)


def _list(ends: list[int], fields: pa.StructType, columns: list) -> pa.ListArray:
    parts = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)]
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.StructArray.from_arrays(parts, fields=list(fields)))


def _batch(rows: Columns, namespaces: bool) -> pa.RecordBatch:
    """Rows of nodes with the parts of their names."""
    pos, names, values, types = rows.attrs
    if namespaces:
        own = [split_name(n) if n is not None else ("", None) for n in rows.name]
        prefix, local, uri = [p for p, _ in own], [n for _, n in own], _uris(rows.doc, [p for p, _ in own], rows)
        parts = [split_name(n) for n in names]
        owner = [d for d, a, b in zip(rows.doc, [0, *rows.attrs_end], rows.attrs_end) for _ in range(b - a)]
        attr_uri = _uris(owner, [p for p, _ in parts], rows)
        a_prefix, a_local = [p for p, _ in parts], [n for _, n in parts]
    else:
        prefix = uri = pa.repeat("", len(rows))
        a_prefix = attr_uri = pa.repeat("", len(names))
        local = rows.name
        names = a_local = pa.array(names, pa.string())
    paths = pa.ListArray.from_arrays(pa.array([0, *rows.path_end], pa.int32()), pa.array(rows.path, pa.int32()))
    attrs = _list(rows.attrs_end, _ATTR, [pos, names, a_prefix, a_local, attr_uri, types, values])
    ns = _list(rows.ns_end, _NS, list(rows.ns))
    columns = [rows.doc, rows.pre, rows.fin, rows.level, rows.parent, rows.pos, paths, rows.kind, rows.name, prefix, local, uri, rows.value, attrs, ns, rows.line, rows.col]
    batch = pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, _NODE_TYPES)], names=_names(NODES))
    if rows.later:
        complete = np.ones(len(rows), bool)
        complete[rows.later] = False
        batch = batch.filter(pa.array(complete))
    return batch


def _uris(docs: list, prefixes: list[str], rows: Columns) -> list[str]:
    """The URI of each normalised prefix: one for a prefix within a document."""
    known = {}
    for d, a, b in zip(rows.doc, [0, *rows.ns_end], rows.ns_end):
        for k in range(a, b):
            known[d, rows.ns[2][k]] = rows.ns[3][k]
    return [known.get((d, p), "") if p else "" for d, p in zip(docs, prefixes)]


def parse_nodes(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """One row for each node of the well-formed documents, with attributes and
    in-scope namespaces as arrays; ``pre`` is the rank in document order and ``fin``
    the largest ``pre`` below. A document of many nodes leaves the reader in parts, an
    element behind what is below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Columns()
        for doc, xml in _documents(batches):
            for rows, whole in stream_nodes(doc, xml, options, rows, BATCH, CHARS):
                if not whole or rows.full(BATCH, CHARS):
                    yield _batch(rows, options.namespaces)
                    rows = Columns()
        if len(rows):
            yield _batch(rows, options.namespaces)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "xml").mapInArrow(run, NODES)


def diagnostics(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """A row for each document that isn't well-formed."""
    errors = parse_events(docs, options).filter("kind = 'error'")
    return errors.select("doc_id", F.lit("error").alias("severity"), F.col("name").alias("class"), F.col("value").alias("message"), F.col("attrs")[0]["value"].alias("entity"), "line", "col")


def attributes(nodes: DataFrame) -> DataFrame:
    """doc_id, owner, pos, name, prefix, local, uri, type, value."""
    return nodes.select("doc_id", F.col("pre").alias("owner"), F.inline("attrs"))


def namespace_nodes(nodes: DataFrame) -> DataFrame:
    """doc_id, owner, pos, prefix, normprefix, uri."""
    return nodes.filter("kind = 'element'").select("doc_id", F.col("pre").alias("owner"), F.inline("ns"))
