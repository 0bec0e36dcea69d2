"""Validation of node tables against DTDs, as set-oriented plans.

Each check gives diagnostics (doc_id, pre, check, message); nothing fails a job. All
documents have one DTD, or each its own: declarations are joined by the id of the DTD
and their names. Their tables are broadcast only within ``DTD_ROWS``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.text import SPACE, normalize_space, only_space, tokens
from sylva.sources.store import roundtrip

from .dtd import DTD_ROWS, Dtd, DtdTables
from .structure import wide

_NAME, _TOKEN = r"(?:[^\W\d]|:)[\w.\-:·]*", r"[\w.\-:·]+"
#: The form of normalised values by type; names may have letters of any script.
LEXICAL = {
    "ID": f"(?U)^{_NAME}$", "IDREF": f"(?U)^{_NAME}$", "ENTITY": f"(?U)^{_NAME}$",
    "IDREFS": f"(?U)^{_NAME}( {_NAME})*$", "ENTITIES": f"(?U)^{_NAME}( {_NAME})*$",
    "NMTOKEN": f"(?U)^{_TOKEN}$", "NMTOKENS": f"(?U)^{_TOKEN}( {_TOKEN})*$",
}


class Validator:
    """The checks of a DTD, or of each document's own, over one node table."""

    def __init__(self, nodes: DataFrame, dtd: Dtd | DtdTables, standalone: bool = False):
        self.nodes, self.standalone = nodes, standalone
        rows = nodes.filter("kind = 'element'").select("doc_id", "pre", "parent", "name", "attrs")
        if isinstance(dtd, DtdTables):
            self.of, tables = dtd.of, dtd.frames
            self.regular = rows.join(wide(self.of), "doc_id")
            few = all(tables[t].limit(DTD_ROWS + 1).count() <= DTD_ROWS for t in ("elements", "attributes", "settings"))
        else:
            self.of = None
            tables = {name: table.withColumn("dtd_id", F.lit(0).cast("long")) for name, table in dtd.frames(nodes.sparkSession).items()}
            self.regular = rows.withColumn("dtd_id", F.lit(0).cast("long"))
            few = max(len(dtd.elements), len(dtd.attributes)) <= DTD_ROWS
        self.tables = tables = tables if few else {name: wide(table) for name, table in tables.items()}
        small = (lambda t: F.broadcast(tables[t])) if few else (lambda t: tables[t])
        self.elements, self.attributes, self.settings = small("elements"), small("attributes"), small("settings")
        self.entities, self.notations = tables["entities"], tables["notations"]
        self._typed: DataFrame | None = None

    @staticmethod
    def _say(rows: DataFrame, check: str, message: Column) -> DataFrame:
        return rows.select("doc_id", "pre", F.lit(check).alias("check"), message.alias("message"))

    def _declared(self) -> DataFrame:
        return self.regular.join(self.elements.select("dtd_id", "name", "model_kind", "model_regex", F.col("allowed").alias("model_names"), "external"), ["dtd_id", "name"])

    def no_dtd(self) -> DataFrame:
        """The roots of documents without a DTD, where each has its own."""
        top = self.nodes.filter("pre = 0")
        lost = top.join(wide(self.of), "doc_id", "left_anti") if self.of is not None else top.filter(F.lit(False))
        return self._say(lost, "dtd", F.lit("Document has no DTD"))

    def declarations(self) -> DataFrame:
        """What is wrong with the DTDs themselves, at the root of each document."""
        errors = self.tables["errors"]
        of = self.of if self.of is not None else self.nodes.filter("pre = 0").select("doc_id", F.lit(0).cast("long").alias("dtd_id"))
        return self._say(of.join(errors, "dtd_id").withColumn("pre", F.lit(0).cast("long")), "dtd", F.col("message"))

    def declared(self) -> DataFrame:
        """Elements need a declaration, unless the DTD says they are optional."""
        missing = self.regular.join(self.elements.select("dtd_id", "name"), ["dtd_id", "name"], "left_anti")
        missing = missing.join(self.settings.select("dtd_id", "optional_elements"), "dtd_id").filter("NOT optional_elements")
        return self._say(missing, "declared", F.concat(F.lit("Reference to undeclared element `"), "name", F.lit("'")))

    def root(self) -> DataFrame:
        top = self.regular.filter("parent = 0").join(self.settings.select("dtd_id", "root"), "dtd_id")
        return self._say(top.filter("root IS NOT NULL AND name <> root"), "root", F.concat(F.lit("The root element is `"), "name", F.lit("' but is declared as `"), "root", F.lit("'")))

    def _children(self) -> DataFrame:
        """(doc_id, pre, children): the names of child elements in order."""
        kids = self.regular.select("doc_id", F.col("parent").alias("pre"), F.struct(F.col("pre").alias("k"), "name").alias("s"))
        return kids.groupBy("doc_id", "pre").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["name"]).alias("children"))

    def content(self, kinds: tuple = ("regexp", "mixed", "empty")) -> DataFrame:
        """Child elements against content models: a pattern over their names, the
        allowed names, or none."""
        names = F.coalesce("children", F.array().cast("array<string>"))
        rows = self._declared().filter(F.col("model_kind").isin(*kinds)).join(wide(self._children()), ["doc_id", "pre"], "left").withColumn("children", names)
        text = F.array_join(F.transform("children", lambda n: F.concat(F.lit("<"), n, F.lit(">"))), "")
        ok = (
            F.when(F.col("model_kind") == "regexp", F.rlike(text, F.concat(F.lit("^"), "model_regex", F.lit("$"))))
            .when(F.col("model_kind") == "mixed", F.size(F.array_except("children", "model_names")) == 0)
            .otherwise(F.size("children") == 0)
        )
        tail = F.when(F.col("model_kind") == "empty", " must be empty").otherwise(" does not match its content model")
        return self._say(rows.filter(~ok), "content", F.concat(F.lit("Element `"), "name", F.lit("'"), tail))

    def chardata(self) -> DataFrame:
        """Text in element content is blank; EMPTY elements have none."""
        data = self.nodes.filter("kind = 'data'").select("doc_id", F.col("pre").alias("at"), F.col("parent").alias("pre"), "value")
        rows = self._declared().filter("model_kind IN ('regexp', 'empty')").join(wide(data), ["doc_id", "pre"])
        blank = only_space(F.col("value"))
        bad = rows.filter(((F.col("model_kind") == "regexp") & ~blank) | ((F.col("model_kind") == "empty") & (F.col("value") != "")))
        empty = F.col("model_kind") == "empty"
        return self._say(bad.withColumn("pre", F.col("at")), "chardata", F.concat(F.lit("Element `"), "name", F.when(empty, "' must be empty").otherwise("' must not have character contents")))

    def classify(self) -> DataFrame:
        """(doc_id, pre, class) of data nodes: NORMAL, EMPTY, IGNORABLE, ERROR or OTHER."""
        data = self.nodes.filter("kind = 'data'").select("doc_id", F.col("pre").alias("at"), F.col("parent").alias("pre"), "value")
        rows = data.join(self._declared().select("doc_id", "pre", "model_kind"), ["doc_id", "pre"], "left")
        blank = only_space(F.col("value"))
        kind = (
            F.when(F.col("value") == "", "EMPTY").when(F.col("model_kind").isNull(), "OTHER")
            .when(F.col("model_kind") == "regexp", F.when(blank, "IGNORABLE").otherwise("ERROR")).when(F.col("model_kind") == "empty", "ERROR").otherwise("NORMAL")
        )
        return rows.select("doc_id", F.col("at").alias("pre"), kind.alias("class"))

    def drop_ignorable(self) -> DataFrame:
        """The nodes without blanks in element content (not numbered anew)."""
        gone = self.classify().filter("class = 'IGNORABLE'").select("doc_id", "pre")
        return self.nodes.join(gone, ["doc_id", "pre"], "left_anti").select(*self.nodes.columns)

    def typed(self) -> DataFrame:
        """Every specified or declared attribute of every element: (doc_id, pre,
        element, name, raw, specified, type, allowed, default_kind, default_value,
        value, values), values normalised by type and defaults put in. It is stored,
        as many checks read it."""
        if self._typed is None:
            self._typed = roundtrip(self._all_attributes(), "typed")
        return self._typed

    def _all_attributes(self) -> DataFrame:
        given = self.regular.select("doc_id", "dtd_id", "pre", F.col("name").alias("element"), F.explode("attrs").alias("a")).select("doc_id", "dtd_id", "pre", "element", F.col("a.name").alias("name"), F.col("a.value").alias("raw"))
        known = self.attributes.select("dtd_id", "element", "name", "type", "allowed", "default_kind", "default_value", "external")
        owners = self.regular.select("doc_id", "dtd_id", "pre", F.col("name").alias("element")).join(known, ["dtd_id", "element"])
        rows = owners.join(given, ["doc_id", "dtd_id", "pre", "element", "name"], "full").withColumn("specified", F.col("raw").isNotNull())
        text = F.coalesce("raw", "default_value")
        value = F.when(F.coalesce("type", F.lit("CDATA")) == "CDATA", text).otherwise(normalize_space(text))
        plural = F.coalesce("type", F.lit("")).isin("IDREFS", "ENTITIES", "NMTOKENS")
        return rows.withColumns({"value": value, "values": F.when(plural, tokens(text))})

    def attrs(self, of: tuple = ("undeclared", "required", "lexical", "fixed")) -> DataFrame:
        """Attributes: declared, there if required, of the form of their type, equal to
        a fixed value."""
        rows = self.typed().join(self.settings.select("dtd_id", "optional_elements", "optional_attributes"), "dtd_id")
        optional = F.col("optional_elements") | F.array_contains("optional_attributes", F.col("element"))
        pattern = F.create_map(*[F.lit(x) for pair in LEXICAL.items() for x in pair])
        malformed = (F.col("type").isin("ENUM", "NOTATION") & ~F.array_contains("allowed", F.col("value"))) | (F.try_element_at(pattern, "type").isNotNull() & ~F.rlike("value", F.try_element_at(pattern, "type")))
        tests = {
            "undeclared": (F.col("type").isNull() & ~optional, F.concat(F.lit("The following attributes are not declared: "), "name")),
            "required": ((F.col("default_kind") == "REQUIRED") & ~F.col("specified"), F.concat(F.lit("Required attribute `"), "name", F.lit("' is missing"))),
            "lexical": (F.col("specified") & F.coalesce(malformed, F.lit(False)), F.concat(F.lit("Attribute `"), "name", F.lit("' is lexically malformed"))),
            "fixed": ((F.col("default_kind") == "FIXED") & F.col("specified") & (F.col("value") != F.col("default_value")), F.concat(F.lit("Attribute `"), "name", F.lit("' is fixed, but has here a different value"))),
        }
        found = F.array(*[F.when(tests[t][0], F.struct(F.lit(f"attr-{t}").alias("check"), tests[t][1].alias("message"))) for t in of])
        hits = rows.select("doc_id", "pre", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("m"))
        return hits.select("doc_id", "pre", "m.check", "m.message")

    def id_index(self) -> DataFrame:
        """(doc_id, id, pre, name)."""
        return self.typed().filter("type = 'ID' AND value IS NOT NULL").select("doc_id", F.col("value").alias("id"), "pre", F.col("element").alias("name"))

    def id_unique(self) -> DataFrame:
        """The second and later elements with one id."""
        again = self.id_index().withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("pre"))).filter("n > 1")
        return self._say(again, "id-unique", F.lit("ID not unique"))

    def references(self) -> DataFrame:
        """(doc_id, pre, element, name, ref): each IDREF."""
        rows = self.typed().filter("type IN ('IDREF', 'IDREFS') AND value IS NOT NULL")
        return rows.select("doc_id", "pre", "element", "name", F.explode(F.coalesce("values", F.array("value"))).alias("ref"))

    def idref(self) -> DataFrame:
        """References to an id that no element has."""
        ids = self.id_index().select("doc_id", F.col("id").alias("ref"))
        lost = self.references().join(wide(ids), ["doc_id", "ref"], "left_anti")
        return self._say(lost, "idref", F.concat(F.lit("Attribute `"), "name", F.lit("' of element `"), "element", F.lit("' refers to unknown ID `"), "ref", F.lit("'")))

    def entity_values(self) -> DataFrame:
        """ENTITY attributes name unparsed entities."""
        rows = self.typed().filter("type IN ('ENTITY', 'ENTITIES') AND value IS NOT NULL").select("doc_id", "dtd_id", "pre", F.explode(F.coalesce("values", F.array("value"))).alias("entity"))
        unparsed = self.entities.filter("NOT is_parameter AND notation IS NOT NULL").select("dtd_id", F.col("name").alias("entity"))
        return self._say(rows.join(unparsed, ["dtd_id", "entity"], "left_anti"), "entity", F.concat(F.lit("Reference to undeclared or parsed entity `"), "entity", F.lit("'")))

    def standalone_checks(self) -> DataFrame:
        """In a standalone document nothing may depend on external declarations:
        defaults, normalisation, blanks in element content."""
        rows = self.typed().filter("external")
        defaults = self._say(rows.filter("NOT specified AND default_value IS NOT NULL"), "standalone", F.concat(F.lit("Standalone declaration is violated: default of attribute `"), "name", F.lit("'")))
        changed = self._say(rows.filter("specified AND raw <> value"), "standalone", F.concat(F.lit("Standalone declaration is violated: normalization of attribute `"), "name", F.lit("'")))
        data = self.nodes.filter("kind = 'data'").select("doc_id", F.col("pre").alias("at"), F.col("parent").alias("pre"), "value")
        blanks = self._declared().filter("model_kind = 'regexp' AND external").join(data, ["doc_id", "pre"]).filter(F.col("value").rlike(f"^{SPACE}+$"))
        white = self._say(blanks, "standalone", F.concat(F.lit("Standalone declaration is violated: white space in element `"), "name", F.lit("'")))
        return defaults.unionByName(changed).unionByName(white)

    def all(self) -> DataFrame:
        """Every check."""
        out = self.declared()
        for part in (self.root(), self.content(), self.chardata(), self.attrs(), self.id_unique(), self.idref(), self.entity_values()):
            out = out.unionByName(part)
        if self.of is not None:
            out = out.unionByName(self.no_dtd()).unionByName(self.declarations())
        return out.unionByName(self.standalone_checks()) if self.standalone else out

    def diagnostics(self) -> DataFrame:
        """Every check, with its place: doc_id, severity, class, message, entity, line,
        col. Warnings of the DTDs come with them."""
        at = self.nodes.select("doc_id", "pre", "line", "col")
        found = self.all().join(at, ["doc_id", "pre"])
        errors = found.select("doc_id", F.lit("error").alias("severity"), F.lit("Validity").alias("class"), "message", F.lit("[toplevel]").alias("entity"), "line", "col")
        of = self.of if self.of is not None else self.nodes.filter("pre = 0").select("doc_id", F.lit(0).cast("long").alias("dtd_id"))
        warned = of.join(self.tables["warnings"], "dtd_id")
        none = F.lit(None).cast("int")
        return errors.unionByName(warned.select("doc_id", F.lit("warning").alias("severity"), F.lit("Validity").alias("class"), "message", F.lit("[dtd]").alias("entity"), none.alias("line"), none.alias("col")))
