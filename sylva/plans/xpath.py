"""XPath 1.0 as DataFrame plans: one plan for all documents.

A relation of contexts is *loop-lifted*: key columns say which context a row belongs
to, and node columns hold its node. A step joins the node table; a predicate makes
each candidate a context of its own; a scalar is a column on the rows of its contexts.

Joins are equalities: of parents, of places, and of the keys of paths and their prefixes
for ancestors and descendants, so that a join makes the rows asked for and few others.
``following`` and ``preceding`` without positions look at the outermost context only;
with positions they compare ranks within a document. What a node's own row holds, its
attributes and its string value, is read there without a join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions import xpath as fn
from sylva.sources.parser import Options
from sylva.sources.store import roundtrip
from sylva.sources.xml import parse_nodes

from sylva.operators.structure import key, keys_above

from .path import BOOLEAN, NODESET, NUMBER, REVERSE, STRING, Binary, Call, Filter, Literal, Neg, Path, PathError, Step, Var, parse, positional, rewrite, type_of

#: Columns of a node; (doc, pre, sub, apos) identifies it and orders a document:
#: an element (sub 0), its namespaces (1), its attributes (2), its children.
NODE = ["doc", "pre", "sub", "apos", "fin", "parent", "pos", "path", "kind", "name", "prefix", "local", "uri", "qname", "type", "sv", "attrs", "ns"]
KEY = ["doc", "pre", "sub", "apos"]


def node_table(nodes: DataFrame, irregular: bool = True) -> DataFrame:
    """All nodes in one table, attributes and namespaces among them."""
    none, zero = F.lit(None).cast("string"), F.lit(0)

    regular = nodes.select(
        F.col("doc_id").alias("doc"), "pre", zero.alias("sub"), zero.alias("apos"), "fin", "parent", "pos", "path", "kind", "name", "prefix", "local", "uri", _qname(F.col("prefix"), F.col("local"), F.col("name"), "ns").alias("qname"), none.alias("type"), F.coalesce("value", F.lit("")).alias("sv"), "attrs", "ns"
    )
    if not irregular:
        return regular
    return regular.unionByName(_attributes(regular, [], F.lit(True))).unionByName(_namespaces(regular, []))


def _qname(prefix: Column, local: Column, name: Column, ns: str) -> Column:
    """The name with the prefix that the document has for it."""
    shown = F.coalesce(F.get(F.filter(ns, lambda n: n["normprefix"] == prefix), 0)["prefix"], prefix)
    return F.when(shown == "", F.coalesce(local, name)).otherwise(F.concat(shown, F.lit(":"), local))


def _inner(rows: DataFrame, keep: list[str], each: Column, sub: int, pos: int, kind: str, columns: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """The nodes that lie within the rows of elements, as rows of their own."""
    x = F.col("_x")
    own = {"sub": F.lit(sub), "apos": x["pos"], "fin": F.col("pre"), "parent": F.col("pre"), "pos": F.lit(pos), "kind": F.lit(kind)} | columns(x)
    own |= {c: F.array().cast(rows.schema[c].dataType) for c in ("attrs", "ns")}
    return rows.filter("sub = 0").withColumn("_x", F.explode(each)).select(*keep, *[own.get(c, F.col(c)).alias(c) for c in NODE])


def _attributes(rows: DataFrame, keep: list[str], matching: Callable[[Column], Column] | Column) -> DataFrame:
    each = F.filter("attrs", matching) if callable(matching) else F.col("attrs")
    return _inner(rows, keep, each, 2, -1, "attribute", lambda a: {c: a[c] for c in ("name", "prefix", "local", "uri", "type")} | {"qname": _qname(a["prefix"], a["local"], a["name"], "ns"), "sv": a["value"]})


def _namespaces(rows: DataFrame, keep: list[str]) -> DataFrame:
    none = F.lit("")
    return _inner(rows, keep, F.col("ns"), 1, -2, "namespace", lambda n: {"name": n["prefix"], "prefix": none, "local": n["prefix"], "uri": none, "qname": n["prefix"], "type": F.lit(None).cast("string"), "sv": n["uri"]})


@dataclass
class Rel:
    """Contexts: key columns, the node columns, and perhaps _position and _size."""

    df: DataFrame
    keys: list[str]
    placed: bool = False


@dataclass
class Evaluator:
    """Compiles expressions over one node table."""

    table: DataFrame
    variables: dict = field(default_factory=dict)
    #: name -> (result type, argument types, builder): user functions on columns
    functions: dict = field(default_factory=dict)

    def __post_init__(self):
        self.fresh = count()

    def _new(self, base: str) -> str:
        return f"_{base}{next(self.fresh)}"

    def _type(self, e) -> str:
        return type_of(e, self.variables, self.functions)

    # ---- node sets

    def start(self) -> Rel:
        """A context for each document: its super root, at position 1 of 1."""
        root = self.table.filter("pre = 0 AND sub = 0")
        return Rel(root.withColumns({"_doc": F.col("doc"), "_position": F.lit(1.0), "_size": F.lit(1.0)}), ["_doc"], True)

    def nodeset(self, e, rel: Rel) -> Rel:
        """The nodes of an expression in each context of ``rel``, each once."""
        if isinstance(e, Path):
            return self._path(e, rel)
        if isinstance(e, Filter):
            return self._filter(e, rel)
        if isinstance(e, Binary) and e.op == "|":
            a, b = self.nodeset(e.left, rel), self.nodeset(e.right, rel)
            cols = rel.keys + NODE
            return Rel(a.df.select(*cols).unionByName(b.df.select(*cols)).dropDuplicates(rel.keys + KEY), rel.keys)
        if isinstance(e, Call) and e.name == "id":
            return self._id(e.args[0], rel)
        raise PathError("not a node-set")

    def _path(self, e: Path, rel: Rel) -> Rel:
        steps = rewrite(e.steps)
        if e.start == "/":
            if rel.keys == ["_doc"] and rel.placed:
                now = Rel(rel.df.select(*rel.keys, *NODE), rel.keys)
                if steps and steps[0].axis in ("child", "descendant"):
                    now, steps = self._top_step(steps[0]), steps[1:]
                    for s in steps:
                        now, _ = self._step(s, now, False)
                    return now
            else:
                docs = rel.df.select(*rel.keys, F.col("doc").alias("_of"))
                roots = self.table.filter("pre = 0 AND sub = 0")
                now = Rel(docs.join(roots, F.col("_of") == F.col("doc")).select(*rel.keys, *NODE), rel.keys)
            single = True
        elif e.start is None:
            now, single = Rel(rel.df.select(*rel.keys, *NODE), rel.keys), True
        else:
            now, single = self.nodeset(e.start, rel), False
        for s in steps:
            now, single = self._step(s, now, single)
        return now

    def _top_step(self, s: Step) -> Rel:
        """The first step from the root of each document needs no join."""
        c_ = self._new("c")
        at = F.col("parent") == 0 if s.axis == "child" else F.col("pre") > 0
        top = {"doc": F.col("doc"), "pre": F.lit(0).cast("long"), "sub": F.lit(0), "apos": F.lit(0)}
        found = self.table.filter(self._test(s) & (F.col("sub") == 0) & at).select(F.col("doc").alias("_doc"), *[top[c].alias(c_ + c) for c in KEY], *NODE)
        if s.preds:
            found = self._step_predicates(s, ["_doc"] + [c_ + c for c in KEY], found)
        return Rel(found.select("_doc", *NODE), ["_doc"])

    def _test(self, s: Step) -> Column:
        principal = {"attribute": "attribute", "namespace": "namespace"}.get(s.axis, "element")
        kind = F.col("kind")
        if s.test == "*":
            return kind == principal
        if s.test == "prefix":
            return (kind == principal) & (F.col("prefix") == s.name)
        if s.test == "name":
            return (kind == principal) & (F.col("name") == s.name)
        if s.test == "text":
            return kind == "data"
        if s.test == "comment":
            return kind == "comment"
        if s.test == "processing-instruction":
            return (kind == "pinstr") & (F.col("name") == s.name if s.name is not None else F.lit(True))
        return F.lit(True)

    def _step(self, s: Step, rel: Rel, single: bool) -> tuple[Rel, bool]:
        """One step from each node of ``rel``. ``single``: each context has at most one
        node so far, so that no result comes twice."""
        axis = s.axis.removesuffix("-reverse")
        c_ = self._new("c")
        ctx = [F.col(c).alias(c_ + c) for c in KEY + ["fin", "parent", "pos", "path"]]
        if axis == "self":
            found = rel.df.filter(self._test(s)).select(*rel.keys, *ctx, *NODE)
            disjoint, single_out = True, single
        elif axis in ("attribute", "namespace"):
            here = rel.df.select(*rel.keys, *ctx, *NODE)
            keep = rel.keys + [c_ + c for c in KEY]
            named = (lambda a: a[s.test] == s.name) if s.test in ("name", "prefix") else F.lit(True)
            found = _namespaces(here, keep) if axis == "namespace" else _attributes(here, keep, named)
            found = found.filter(self._test(s))
            disjoint, single_out = True, False
        else:
            if axis in ("following", "preceding") and not any(positional(p) or self._type(p) == NUMBER for p in s.preds):
                here, single = self._outermost(axis, rel, c_), True
            else:
                here = rel.df.select(*rel.keys, *ctx)
            b = self.table.filter(self._test(s))
            if not axis.endswith("-or-self"):
                b = b.filter("sub = 0")
            on, before = self._condition(axis, c_)
            here, same = here.filter(before), F.col(c_ + "doc") == F.col("doc")
            if axis.startswith("descendant"):
                here = here.withColumn(c_ + "key", key(c_ + "path"))
                b = b.withColumn("_key", F.explode(keys_above("path", axis != "descendant")))
                same = same & (F.col(c_ + "key") == F.col("_key"))
            elif axis.startswith("ancestor"):
                # an attribute's element is above it
                above = keys_above(c_ + "path", True) if axis != "ancestor" else F.when(F.col(c_ + "sub") > 0, keys_above(c_ + "path", True)).otherwise(keys_above(c_ + "path"))
                here = here.withColumn(c_ + "key", F.explode(above))
                b = b.withColumn("_key", key())
                same = same & (F.col(c_ + "key") == F.col("_key"))
            found = here.join(b, same & on).select(*rel.keys, *[c_ + c for c in KEY], *NODE)
            disjoint = axis == "child"
            single_out = single and axis == "parent"
        if s.preds:
            found = self._step_predicates(s, rel.keys + [c_ + c for c in KEY], found)
        out = found.select(*rel.keys, *NODE)
        if not single and not disjoint:
            out = out.dropDuplicates(rel.keys + KEY)
        return Rel(out, rel.keys), single_out

    def _outermost(self, axis: str, rel: Rel, c_: str) -> DataFrame:
        """Of each context the node that has all results of the axis."""
        ends = F.when(F.col("sub") > 0, F.col("pre")).otherwise(F.col("fin"))
        place = F.struct(ends, "pre", "sub", "apos", "doc", "fin") if axis == "following" else F.struct("pre", "sub", "apos", "doc", "fin")
        best = rel.df.groupBy(*rel.keys, F.col("doc").alias("_same_doc")).agg((F.min if axis == "following" else F.max)(place).alias("_best"))
        return best.select(*rel.keys, *[F.col(f"_best.{c}").alias(c_ + c) for c in KEY + ["fin"]])

    @staticmethod
    def _condition(axis: str, context: str) -> tuple[Column, Column]:
        """The join condition, and which contexts have results at all."""
        c = lambda x: F.col(context + x)
        pre, fin, sub = F.col("pre"), F.col("fin"), F.col("sub")
        element, always = c("sub") == 0, F.lit(True)
        same = (pre == c("pre")) & (sub == c("sub")) & (F.col("apos") == c("apos"))
        regular = sub == 0
        below = (pre > c("pre")) & (pre <= c("fin"))
        above = (pre < c("pre")) & (fin >= c("pre"))
        owner = (pre == c("pre")) & (c("sub") > 0)
        conditions = {
            "child": (F.col("parent") == c("pre"), element),
            "descendant": (below, element),
            "parent": (pre == c("parent"), always),
            "ancestor": (above | owner, always),
            "following-sibling": ((F.col("parent") == c("parent")) & (F.col("pos") > c("pos")), element),
            "preceding-sibling": ((F.col("parent") == c("parent")) & (F.col("pos") < c("pos")), element),
            # after an attribute comes what its element contains
            "following": (pre > F.when(c("sub") > 0, c("pre")).otherwise(c("fin")), always),
            "preceding": (fin < c("pre"), always),
            "descendant-or-self": (same | (regular & element & below), always),
            "ancestor-or-self": (same | (regular & (above | owner)), always),
        }
        return conditions[axis]

    def _local(self, e) -> Column | None:
        """Of a path that stays on the row of its context, the string values as an array:
        attributes without predicates, or the node itself."""
        if not isinstance(e, Path) or e.start is not None or len(e.steps) != 1 or e.steps[0].preds:
            return None
        s = e.steps[0]
        if s.axis == "self" and s.test == "node":
            return F.array("sv")
        if s.axis != "attribute" or s.test not in ("*", "name", "prefix", "node"):
            return None
        each = F.col("attrs")
        if s.test in ("name", "prefix"):
            each = F.filter(each, lambda a: a[s.test] == s.name)
        return F.transform(each, lambda a: a["value"])

    def _step_predicates(self, s: Step, group: list[str], found: DataFrame) -> DataFrame:
        backward = s.axis in REVERSE
        order = [F.col(c).desc() if backward else F.col(c).asc() for c in KEY[1:]]
        return self._predicates(s.preds, group, order, found)

    def _predicates(self, preds: tuple, group: list[str], order: list[Column], found: DataFrame) -> DataFrame:
        """Keeps candidates; each predicate counts positions anew within ``group``."""
        for p in preds:
            if isinstance(p, Literal) and not isinstance(p.value, str):
                if p.value != int(p.value) or p.value < 1:
                    found = found.filter(F.lit(False))
                    continue
                n = self._new("n")
                found = found.withColumn(n, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(n) <= int(p.value)).filter(F.col(n) == int(p.value)).drop(n)
                continue
            # every candidate is a context of its own
            own = {self._new("k"): F.col(c) for c in KEY}
            placed = {}
            if positional(p):
                w = Window.partitionBy(*group)
                placed = {"_position": F.row_number().over(w.orderBy(*order)).cast("double"), "_size": F.count("*").over(w).cast("double")}
            rel = Rel(found.withColumns(own | placed), group + list(own), bool(placed))
            kind = self._type(p)
            rel, value = self.scalar(p, rel, NUMBER if kind == NUMBER else BOOLEAN)
            if kind == NUMBER:
                value = F.col("_position") == value
            found = rel.df.filter(value).select(*group, *NODE)
        return found

    def _filter(self, e: Filter, rel: Rel) -> Rel:
        """Predicates on a whole node-set count in document order."""
        found = self.nodeset(e.of, rel).df.select(*rel.keys, *NODE)
        return Rel(self._predicates(e.preds, rel.keys, [F.col(c).asc() for c in KEY[1:]], found), rel.keys)

    def _id(self, arg, rel: Rel) -> Rel:
        """The elements whose ID attribute is one of the words of the argument."""
        if self._type(arg) == NODESET:
            words = self.nodeset(arg, rel).df.select(*rel.keys, F.col("doc").alias("_of"), F.explode(F.split("sv", r"[ \t\r\n]+")).alias("_word"))
        else:
            on, value = self.scalar(arg, rel, STRING)
            words = on.df.select(*rel.keys, F.col("doc").alias("_of"), F.explode(F.split(value, r"[ \t\r\n]+")).alias("_word"))
        ids = self.table.filter("sub = 2 AND type = 'ID'").select(F.col("doc").alias("_of"), F.col("sv").alias("_word"), F.col("pre").alias("_pre"))
        hit = words.distinct().join(ids, ["_of", "_word"]).select(*rel.keys, "_of", "_pre")
        owners = self.table.filter("sub = 0")
        return Rel(hit.join(owners, (F.col("_of") == F.col("doc")) & (F.col("_pre") == F.col("pre"))).select(*rel.keys, *NODE).dropDuplicates(rel.keys + KEY), rel.keys)

    # ---- scalars

    def _attach(self, rel: Rel, values: DataFrame, name: str, default) -> tuple[Rel, Column]:
        """``values`` (keys, name) as a column on the rows of ``rel``."""
        joined = rel.df.join(values, rel.keys, "left")
        return Rel(joined, rel.keys, rel.placed), F.coalesce(F.col(name), F.lit(default))

    def _aggregate(self, e, rel: Rel, value: Column, default) -> tuple[Rel, Column]:
        name = self._new("v")
        found = self.nodeset(e, rel)
        return self._attach(rel, found.df.groupBy(*rel.keys).agg(value.alias(name)), name, default)

    def scalar(self, e, rel: Rel, want: str) -> tuple[Rel, Column]:
        """An expression as a column of type ``want`` on the rows of ``rel``."""
        kind = self._type(e)
        if kind == NODESET:
            if (values := self._local(e)) is not None:
                if want == BOOLEAN:
                    return rel, F.size(values) > 0
                text = F.coalesce(F.get(values, 0), F.lit(""))
                return rel, fn.to_number(text) if want == NUMBER else text
            if want == BOOLEAN:
                return self._aggregate(e, rel, F.count("*") > 0, False)
            first = F.min_by("sv", F.struct("pre", "sub", "apos"))
            rel, text = self._aggregate(e, rel, first, "")
            return rel, fn.to_number(text) if want == NUMBER else text
        rel, value = self._own(e, rel, kind)
        return rel, self._convert(value, kind, want)

    @staticmethod
    def _convert(x: Column, kind: str, want: str) -> Column:
        convert = {
            (NUMBER, STRING): fn.to_string, (NUMBER, BOOLEAN): fn.boolean_of_number, (STRING, NUMBER): fn.to_number,
            (STRING, BOOLEAN): fn.boolean_of_string, (BOOLEAN, NUMBER): fn.number_of_boolean, (BOOLEAN, STRING): fn.string_of_boolean,
        }
        return x if kind == want else convert[kind, want](x)

    def _own(self, e, rel: Rel, kind: str) -> tuple[Rel, Column]:
        if isinstance(e, Literal):
            return rel, F.lit(e.value)
        if isinstance(e, Var):
            v = self.variables[e.name]
            return rel, F.lit(float(v) if kind == NUMBER else v)
        if isinstance(e, Neg):
            rel, x = self.scalar(e.of, rel, NUMBER)
            return rel, -x
        if isinstance(e, Call):
            return self._call(e, rel)
        if e.op in ("and", "or"):
            rel, a = self._held(e.left, rel, BOOLEAN)
            rel, b = self._held(e.right, rel, BOOLEAN)
            return rel, a & b if e.op == "and" else a | b
        if kind == NUMBER:
            rel, a = self._held(e.left, rel, NUMBER)
            rel, b = self._held(e.right, rel, NUMBER)
            return rel, {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "div": lambda: fn.divide(a, b), "mod": lambda: fn.remainder(a, b)}[e.op]()
        return self._compare(e, rel)

    def _held(self, e, rel: Rel, want: str) -> tuple[Rel, Column]:
        """A scalar under a name of its own, which later joins don't disturb."""
        rel, value = self.scalar(e, rel, want)
        if isinstance(e, (Literal, Var)):
            return rel, value
        name = self._new("h")
        return Rel(rel.df.withColumn(name, value), rel.keys, rel.placed), F.col(name)

    _SWAP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "=", "!=": "!="}

    def _compare(self, e: Binary, rel: Rel) -> tuple[Rel, Column]:
        left, right = self._type(e.left), self._type(e.right)
        if left == NODESET and right == NODESET:
            return self._compare_sets(e, rel)
        if right == NODESET:
            return self._compare(Binary(self._SWAP[e.op], e.right, e.left), rel)
        if left != NODESET:
            numbers = e.op not in ("=", "!=") or NUMBER in (left, right)
            want = NUMBER if numbers and not (e.op in ("=", "!=") and BOOLEAN in (left, right)) else BOOLEAN if BOOLEAN in (left, right) else STRING
            rel, a = self._held(e.left, rel, want)
            rel, b = self._held(e.right, rel, want)
            return rel, fn.compare(e.op, a, b, want == NUMBER)
        if right == BOOLEAN:
            want = BOOLEAN if e.op in ("=", "!=") else NUMBER
            rel, a = self._held(Call("boolean", (e.left,)), rel, want)
            rel, b = self._held(e.right, rel, want)
            return rel, fn.compare(e.op, a, b, want == NUMBER)
        # some node must compare with the scalar of its context
        numbers = right == NUMBER or e.op not in ("=", "!=")
        rel, b = self._held(e.right, rel, NUMBER if numbers else STRING)
        if (values := self._local(e.left)) is not None:
            return rel, F.exists(values, lambda v: fn.compare(e.op, fn.to_number(v) if numbers else v, b, numbers))
        nodes = self.nodeset(e.left, rel).df
        name, found = self._new("v"), self._new("b")
        if not isinstance(e.right, (Literal, Var)):
            nodes = nodes.join(rel.df.select(*rel.keys, b.alias(found)), rel.keys)
            b = F.col(found)
        a = fn.to_number(F.col("sv")) if numbers else F.col("sv")
        hit = nodes.filter(fn.compare(e.op, a, b, numbers)).select(*rel.keys).distinct().withColumn(name, F.lit(True))
        return self._attach(rel, hit, name, False)

    def _compare_sets(self, e: Binary, rel: Rel) -> tuple[Rel, Column]:
        """Some node of one set against some node of the other: equality joins, the
        rest by extremes."""
        one, two = self._local(e.left), self._local(e.right)
        if one is not None and two is not None:
            numbers = e.op not in ("=", "!=")
            number = (lambda v: fn.to_number(v)) if numbers else (lambda v: v)
            return rel, F.exists(one, lambda v: F.exists(two, lambda w: fn.compare(e.op, number(v), number(w), numbers)))
        name = self._new("v")
        a, b = self.nodeset(e.left, rel).df, self.nodeset(e.right, rel).df
        if e.op == "=":
            hit = a.select(*rel.keys, "sv").join(b.select(*rel.keys, "sv"), [*rel.keys, "sv"], "left_semi").select(*rel.keys).distinct().withColumn(name, F.lit(True))
            return self._attach(rel, hit, name, False)
        if e.op == "!=":
            ends = lambda d, p: d.groupBy(*rel.keys).agg(F.min("sv").alias(f"{p}lo"), F.max("sv").alias(f"{p}hi"))
            both = ends(a, "a_").join(ends(b, "b_"), rel.keys)
            hit = both.filter("a_lo <> b_hi OR a_hi <> b_lo OR a_lo <> a_hi").select(*rel.keys).withColumn(name, F.lit(True))
            return self._attach(rel, hit, name, False)
        number = lambda d, f, n: d.select(*rel.keys, fn.to_number(F.col("sv")).alias("x")).filter(~F.isnan("x")).groupBy(*rel.keys).agg(f("x").alias(n))
        low, high = (F.min, F.max) if e.op in ("<", "<=") else (F.max, F.min)
        both = number(a, low, "a_x").join(number(b, high, "b_x"), rel.keys)
        hit = both.filter(fn.compare(e.op, F.col("a_x"), F.col("b_x"), True)).select(*rel.keys).withColumn(name, F.lit(True))
        return self._attach(rel, hit, name, False)

    def _call(self, e: Call, rel: Rel) -> tuple[Rel, Column]:
        if e.name in self.functions:
            _, wants, build = self.functions[e.name]
            args = []
            for a, want in zip(e.args, wants):
                rel, x = self._held(a, rel, want)
                args.append(x)
            return rel, build(*args)
        if e.name == "position":
            return rel, F.col("_position")
        if e.name == "last":
            return rel, F.col("_size")
        if e.name in ("count", "sum") and (values := self._local(e.args[0])) is not None:
            return rel, F.size(values).cast("double") if e.name == "count" else F.aggregate(values, F.lit(0.0), lambda acc, v: acc + fn.to_number(v))
        if e.name == "count":
            return self._aggregate(e.args[0], rel, F.count("*").cast("double"), 0.0)
        if e.name == "sum":
            return self._aggregate(e.args[0], rel, F.sum(fn.to_number(F.col("sv"))), 0.0)
        if e.name in ("local-name", "namespace-uri", "name"):
            col = {"local-name": "local", "namespace-uri": "uri", "name": "qname"}[e.name]
            if not e.args:
                return rel, F.coalesce(F.when(F.col("kind").isin("element", "attribute", "pinstr", "namespace"), F.col(col)), F.lit(""))
            return self._aggregate(e.args[0], rel, F.min_by(F.coalesce(col, F.lit("")), F.struct("pre", "sub", "apos")), "")
        if e.name == "lang":
            return self._lang(e.args[0], rel)
        if e.name in ("string", "number", "string-length", "normalize-space") and not e.args:
            value = F.col("sv")
            if e.name == "number":
                value = fn.to_number(value)
            return rel, fn.SCALAR[e.name][1](value)
        wants, build = fn.SCALAR[e.name]
        kinds = ["string"] * len(e.args) if wants.endswith("*") else wants.split()
        args = []
        for a, want in zip(e.args, kinds):
            rel, x = self._held(a, rel, want)
            args.append(x)
        return rel, build(*args)

    def _lang(self, arg, rel: Rel) -> tuple[Rel, Column]:
        """Whether the nearest xml:lang is the language or a variety of it."""
        rel, want = self._held(arg, rel, STRING)
        name = self._new("v")
        lang = F.get(F.filter("attrs", lambda a: a["name"] == "xml:lang"), 0)["value"]
        owners = self.table.filter("sub = 0").select(F.col("doc").alias("_of"), key().alias("_own"), F.col("pre").alias("_pre"), F.col("fin").alias("_fin"), lang.alias("_lang")).filter("_lang IS NOT NULL")
        here = rel.df.select(*rel.keys, F.col("doc").alias("_doc_here"), F.col("pre").alias("_at"), F.explode(keys_above("path", True)).alias("_key"))
        on = (F.col("_doc_here") == F.col("_of")) & (F.col("_key") == F.col("_own")) & (F.col("_pre") <= F.col("_at")) & (F.col("_fin") >= F.col("_at"))
        near = here.join(owners, on).groupBy(*rel.keys).agg(F.max_by("_lang", "_pre").alias(name))
        rel, lang = self._attach(rel, near, name, "")
        lang, want = F.lower(lang), F.lower(want)
        return rel, (lang == want) | F.startswith(lang, F.concat(want, F.lit("-")))


def evaluate(nodes: DataFrame, path: str, variables: dict | None = None, functions: dict | None = None) -> DataFrame:
    """An expression on the root of every document. A node-set gives a row for each
    node (doc_id, pre, sub, apos, kind, name, value), anything else one for each
    document (doc_id, value)."""
    e = parse(path)
    run = Evaluator(node_table(nodes), variables or {}, functions or {})
    kind = run._type(e)
    if kind == NODESET:
        return run.nodeset(e, run.start()).df.select(F.col("doc").alias("doc_id"), "pre", "sub", "apos", "kind", "name", F.col("sv").alias("value"))
    rel, value = run.scalar(e, run.start(), kind)
    return rel.df.select(F.col("_doc").alias("doc_id"), value.alias("value"))


def xpath(docs: DataFrame, path: str, options: Options = Options(), **settings) -> DataFrame:
    """``evaluate`` over documents (doc_id, xml). Each step reads the node table, so it
    is parsed once and stored; steps then scan only the columns and names they need."""
    return evaluate(roundtrip(parse_nodes(docs, options), "nodes"), path, **settings)
