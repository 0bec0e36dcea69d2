"""DTDs: declarations read to tables for plans, one DTD on the driver (``parse_dtd``) or
those of many documents in tasks (``dtds_of``).

Reading knows parameter entities, conditional sections and the processing
instructions that relax declarations. The first declaration of an attribute or entity
counts; what that ignores is a warning."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva import ship
from sylva.sources.store import roundtrip

#: The most declarations of one kind that are broadcast.
DTD_ROWS = 20_000
#: The target of processing instructions that are options of a DTD.
OPTIONS = "sylva:dtd"

NAME = r"(?:[^\W\d]|:)[\w.\-:·]*"


class DtdError(ValueError):
    pass


# ---- content models: ("name", n), ("seq", [..]), ("alt", [..]), ("?"|"*"|"+", m)

_MODEL = re.compile(rf"\s*([(),|?*+]|#PCDATA|{NAME})")


class _Model:
    def __init__(self, text: str):
        self.tokens = _MODEL.findall(text)
        if "".join(self.tokens) != re.sub(r"\s+", "", text):
            raise DtdError(f"bad content model {text}")
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""

    def item(self):
        t = self.take()
        if t == "(":
            parts, sep = [self.item()], None
            while (s := self.take()) != ")":
                if s not in (",", "|") or sep not in (None, s):
                    raise DtdError("a content model can't mix , and |")
                sep = s
                parts.append(self.item())
            out = parts[0] if len(parts) == 1 else ("alt" if sep == "|" else "seq", parts)
        elif re.fullmatch(NAME, t):
            out = ("name", t)
        else:
            raise DtdError(f"bad content model at {t or 'its end'}")
        if self.peek() in ("?", "*", "+") and self.peek():
            out = (self.take(), out)
        return out


def parse_model(text: str):
    """(kind, tree or names): empty, any, mixed or regexp."""
    text = text.strip()
    if text in ("EMPTY", "ANY"):
        return text.lower(), None
    if re.match(r"\(\s*#PCDATA", text):
        m = re.fullmatch(rf"\(\s*#PCDATA\s*((?:\|\s*{NAME}\s*)*)\)(\*?)", text)
        if not m or m[1] and not m[2]:
            raise DtdError(f"bad mixed content {text}")
        return "mixed", [x.strip() for x in m[1].split("|") if x.strip()]
    p = _Model(text)
    tree = p.item()
    if p.peek():
        raise DtdError(f"bad content model {text}")
    return "regexp", tree


def regex_of(m) -> str:
    """A pattern over child names written as <a><b>. Repeats of repeats collapse, so
    that no pattern backtracks without end."""
    op, x = m
    if op == "name":
        return f"(?:<{re.escape(x)}>)"
    if op == "seq":
        return "(?:" + "".join(map(regex_of, x)) + ")"
    if op == "alt":
        return "(?:" + "|".join(map(regex_of, x)) + ")"
    while x[0] in ("?", "*", "+"):
        op, x = (op, x[1]) if op == x[0] else ("*", x[1])
    return f"(?:{regex_of(x)}){op}"


def names_of(m) -> list[str]:
    op, x = m
    return [x] if op == "name" else names_of(x) if op in ("?", "*", "+") else [n for y in x for n in names_of(y)]


def deterministic(m) -> bool:
    """Whether the position automaton never has two places to go with one name."""
    labels: list[str] = []
    follow: dict[int, set[int]] = {}

    def walk(m) -> tuple[bool, set[int], set[int]]:
        op, x = m
        if op == "name":
            labels.append(x)
            follow[len(labels) - 1] = set()
            return False, {len(labels) - 1}, {len(labels) - 1}
        if op == "alt":
            parts = [walk(y) for y in x]
            return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        if op == "seq":
            empty, first, last = True, set(), set()
            for y in x:
                e, f, l = walk(y)
                for k in last:
                    follow[k] |= f
                first |= f if empty else set()
                last = last | l if e else l
                empty &= e
            return empty, first, last
        e, f, l = walk(x)
        if op in ("*", "+"):
            for k in l:
                follow[k] |= f
        return e or op in ("?", "*"), f, l

    _, first, _ = walk(m)
    return all(len({labels[k] for k in s}) == len(s) for s in [first, *follow.values()])


# ---- declarations


@dataclass
class Element:
    name: str
    model: str
    kind: str
    tree: object
    external: bool = False


@dataclass
class Attribute:
    element: str
    name: str
    type: str
    allowed: list[str]
    default: str  # REQUIRED, IMPLIED, FIXED or VALUE
    value: str | None
    external: bool = False


@dataclass
class Entity:
    name: str
    parameter: bool
    text: str | None
    public: str | None = None
    system: str | None = None
    notation: str | None = None
    external: bool = False


#: Declarations of any kind in one table; ``what`` says which.
DECLARATIONS = "what string, element string, name string, kind string, regex string, allowed array<string>, deterministic boolean, external boolean, text string, default_kind string, public_id string, system_id string, notation string"
_COLUMNS = [c.split()[0] for c in DECLARATIONS.split(", ")]


def _row(what: str, **values) -> tuple:
    values = {"what": what, "allowed": [], "deterministic": True, "external": False} | values
    return tuple(values.get(c) for c in _COLUMNS)


def split(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of a table (dtd_id, ...) of declarations."""
    of = lambda what: rows.filter(F.col("what") == what)
    text = lambda name: F.col("text").alias(name)
    return {
        "elements": of("element").select("dtd_id", "name", F.col("kind").alias("model_kind"), F.col("regex").alias("model_regex"), "allowed", "deterministic", "external", text("model")),
        "attributes": of("attribute").select("dtd_id", "element", "name", F.col("kind").alias("type"), "allowed", "default_kind", text("default_value"), "external"),
        "entities": of("entity").select("dtd_id", "name", (F.col("kind") == "parameter").alias("is_parameter"), "text", "public_id", "system_id", "notation", "external"),
        "notations": of("notation").select("dtd_id", "name", "public_id", "system_id"),
        "settings": of("settings").select("dtd_id", F.col("name").alias("root"), (F.col("kind") == "optional").alias("optional_elements"), F.col("allowed").alias("optional_attributes")),
        "namespaces": of("namespace").select("dtd_id", F.col("name").alias("prefix"), text("uri")),
        "warnings": of("warning").select("dtd_id", text("message")),
        "errors": of("error").select("dtd_id", text("message")),
    }


@dataclass
class Dtd:
    root: str | None = None
    elements: dict[str, Element] = field(default_factory=dict)
    attributes: dict[tuple[str, str], Attribute] = field(default_factory=dict)
    entities: dict[str, Entity] = field(default_factory=dict)
    parameters: dict[str, Entity] = field(default_factory=dict)
    notations: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    pinstrs: list[tuple[str, str]] = field(default_factory=list)
    namespaces: dict[str, str] = field(default_factory=dict)
    optional_elements: bool = False
    optional_attributes: set[str] = field(default_factory=set)
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def add(self, text: str, external: bool = False, catalog: dict[str, str] | None = None, target: str = OPTIONS) -> Dtd:
        """More declarations, after those that are there: the first of a kind counts,
        and what may not be declared again is an error."""
        _Reader(self, catalog or {}, external, target).read(re.sub("\r\n?", "\n", re.sub(r"^<\?xml[^>]*\?>", "", text)))
        return self

    # ---- tables

    def declarations(self) -> list[tuple]:
        """Rows of ``DECLARATIONS``: one for each declaration, option, warning and error."""
        out = []
        for e in self.elements.values():
            tree = e.tree if e.kind == "regexp" else None
            out.append(_row("element", name=e.name, kind=e.kind, regex=regex_of(tree) if tree else None, allowed=list(e.tree or []) if e.kind == "mixed" else [], deterministic=deterministic(tree) if tree else True, external=e.external, text=e.model))
        for a in self.attributes.values():
            out.append(_row("attribute", element=a.element, name=a.name, kind=a.type, allowed=a.allowed, default_kind=a.default, text=a.value, external=a.external))
        for e in [*self.entities.values(), *self.parameters.values()]:
            out.append(_row("entity", name=e.name, kind="parameter" if e.parameter else "general", text=e.text, public_id=e.public, system_id=e.system, notation=e.notation, external=e.external))
        out += [_row("notation", name=n, public_id=p, system_id=s) for n, (p, s) in self.notations.items()]
        out.append(_row("settings", name=self.root, kind="optional" if self.optional_elements else "declared", allowed=sorted(self.optional_attributes)))
        out += [_row("namespace", name=p, text=u) for p, u in self.namespaces.items()]
        out += [_row("warning", text=w) for w in self.warnings]
        return out + [_row("error", text=e) for e in self.validate()]

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """Tables elements, attributes, entities, notations, settings and more; a row for
        each declaration, so their size is the DTD's."""
        rows = spark.createDataFrame([(0, *r) for r in self.declarations()], f"dtd_id long, {DECLARATIONS}")
        return {name: table.drop("dtd_id") for name, table in split(rows).items()}

    def write(self) -> str:
        """The declarations as text."""
        out = [f'<!NOTATION {n} ' + (f'PUBLIC "{p}"' + (f' "{s}"' if s else "") if p else f'SYSTEM "{s}"') + ">" for n, (p, s) in self.notations.items()]
        for e in [*self.parameters.values(), *self.entities.values()]:
            where = f'PUBLIC "{e.public}" "{e.system}"' if e.public else f'SYSTEM "{e.system}"' if e.system else None
            body = where or '"' + (e.text or "").replace("&", "&#38;").replace("%", "&#37;").replace('"', "&#34;") + '"'
            out.append(f"<!ENTITY {'% ' if e.parameter else ''}{e.name} {body}{f' NDATA {e.notation}' if e.notation else ''}>")
        for e in self.elements.values():
            out.append(f"<!ELEMENT {e.name} {e.model}>")
        for a in self.attributes.values():
            kind = f"NOTATION ({'|'.join(a.allowed)})" if a.type == "NOTATION" else f"({'|'.join(a.allowed)})" if a.type == "ENUM" else a.type
            value = '"' + (a.value or "").replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;") + '"'
            default = {"REQUIRED": "#REQUIRED", "IMPLIED": "#IMPLIED", "FIXED": f"#FIXED {value}", "VALUE": value}[a.default]
            out.append(f"<!ATTLIST {a.element} {a.name} {kind} {default}>")
        return "".join(x + "\n" for x in out)

    def write_reference(self, system: str | None = None, public: str | None = None) -> str:
        """A DOCTYPE that refers to the declarations, or that has none."""
        where = f' PUBLIC "{public}" "{system}"' if public else f' SYSTEM "{system}"' if system else ""
        return f"<!DOCTYPE {self.root}{where}>\n"

    def write_included(self) -> str:
        """A DOCTYPE with the declarations inside."""
        return f"<!DOCTYPE {self.root} [\n{self.write()}]>\n"

    # ---- checks on the declarations themselves

    def validate(self) -> list[str]:
        """What is wrong with the declarations, as messages."""
        bad = list(self.errors)
        for e in self.elements.values():
            if e.kind == "mixed" and len(set(e.tree)) < len(e.tree):
                bad.append(f"More than one occurrence of an element in the mixed content model of `{e.name}'")
            if e.kind == "regexp" and not deterministic(e.tree):
                bad.append(f"The content model of element `{e.name}' is not deterministic")
        for element in dict.fromkeys(a.element for a in self.attributes.values()):
            own = [a for a in self.attributes.values() if a.element == element]
            if sum(a.type == "ID" for a in own) > 1:
                bad.append(f"More than one ID attribute for element `{element}'")
            if sum(a.type == "NOTATION" for a in own) > 1:
                bad.append(f"More than one NOTATION attribute for element `{element}'")
            for a in own:
                if a.type == "ID" and a.default in ("FIXED", "VALUE"):
                    bad.append(f"ID attribute must be #IMPLIED or #REQUIRED; element `{element}'")
                if a.value is not None and not lexical(a.type, a.value, a.allowed):
                    bad.append(f"Default value for attribute `{a.name}' is lexically malformed")
                if a.type == "NOTATION":
                    bad += [f"Reference to undeclared notation `{n}'" for n in a.allowed if n not in self.notations]
                if a.name == "xml:space" and not (a.type == "ENUM" and set(a.allowed) <= {"default", "preserve"} and a.allowed):
                    bad.append("Declaration of attribute `xml:space' does not conform to XML specification")
        for e in self.entities.values():
            if e.notation and e.notation not in self.notations:
                bad.append(f"Reference to undeclared notation `{e.notation}'")
        return bad


def lexical(kind: str, value: str, allowed: list[str]) -> bool:
    """Whether a normalised value has the form of its type."""
    token = r"[\w.\-:·]+"
    if kind in ("ID", "IDREF", "ENTITY"):
        return bool(re.fullmatch(NAME, value))
    if kind in ("IDREFS", "ENTITIES"):
        return bool(re.fullmatch(rf"{NAME}( {NAME})*", value))
    if kind == "NMTOKEN":
        return bool(re.fullmatch(token, value))
    if kind == "NMTOKENS":
        return bool(re.fullmatch(rf"{token}( {token})*", value))
    if kind in ("ENUM", "NOTATION"):
        return value in allowed
    return True


_QUOTED = r"""("[^"]*"|'[^']*')"""
_ATTDEF = re.compile(
    rf"\s*(?P<name>{NAME})\s+(?P<type>CDATA|IDREFS|IDREF|ID|ENTITIES|ENTITY|NMTOKENS|NMTOKEN|(?:NOTATION\s*)?\([^)]*\))\s*"
    rf"(?:(?P<word>\#REQUIRED|\#IMPLIED)|(?P<fixed>\#FIXED\s+)?(?P<value>{_QUOTED}))"
)
_PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}


def char_refs(text: str) -> str:
    return re.sub(r"&#(?:x([0-9a-fA-F]+)|([0-9]+));", lambda m: chr(int(m[1], 16) if m[1] else int(m[2])), text)


class _Reader:
    def __init__(self, dtd: Dtd, catalog: dict[str, str], external: bool, target: str = OPTIONS):
        self.dtd, self.catalog, self.external, self.target, self.open = dtd, catalog, external, target, []

    def expand(self, name: str) -> str:
        e = self.dtd.parameters.get(name)
        if e is None:
            raise DtdError(f"Reference to undeclared parameter entity `{name}'")
        if name in self.open:
            raise DtdError(f"Recursive reference to parameter entity `{name}'")
        text = e.text if e.text is not None else self.catalog.get(e.system, self.catalog.get(e.public))
        if text is None:
            raise DtdError(f"Can't resolve parameter entity `{name}'")
        return text

    def inline(self, text: str) -> str:
        """Parameter references within a declaration, outside of literals."""

        def one(m: re.Match) -> str:
            if m[1]:
                return m[1]
            body = self.expand(m[2])
            self.open.append(m[2])
            out = f" {self.inline(body)} "
            self.open.pop()
            return out

        return re.sub(rf"""("[^"]*"|'[^']*')|%({NAME});""", one, text)

    def literal(self, quoted: str) -> str:
        """An entity's replacement text: parameter and character references."""
        body = re.sub(rf"%({NAME});", lambda m: self.expand(m[1]), quoted[1:-1])
        return char_refs(body)

    def read(self, text: str) -> None:
        at = 0
        while at < len(text):
            if m := re.compile(r"\s+").match(text, at):
                at = m.end()
            elif m := re.compile(r"<!--(.*?)-->", re.S).match(text, at):
                at = m.end()
            elif m := re.compile(rf"<\?({NAME})\s*(.*?)\?>", re.S).match(text, at):
                self.pinstr(m[1], m[2])
                at = m.end()
            elif m := re.compile(rf"%({NAME});").match(text, at):
                body = self.expand(m[1])
                self.open.append(m[1])
                outer, self.external = self.external, self.external or self.dtd.parameters[m[1]].system is not None
                self.read(body)
                self.external = outer
                self.open.pop()
                at = m.end()
            elif m := re.compile(r"<!\[").match(text, at):
                at = self.conditional(text, m.end())
            elif m := re.compile(r"""<!(ELEMENT|ATTLIST|ENTITY|NOTATION)\s((?:[^"'<>]|"[^"]*"|'[^']*')*)>""").match(text, at):
                getattr(self, m[1].lower())(m[2])
                at = m.end()
            else:
                raise DtdError(f"can't read the declaration at {text[at : at + 30]!r}")

    def conditional(self, text: str, at: int) -> int:
        """An INCLUDE or IGNORE section; ]]> inside a literal doesn't close it."""
        head = re.compile(r"\s*([^\[\s]+)\s*\[").match(text, at)
        word = self.inline(head[1]).strip() if head else ""
        if word not in ("INCLUDE", "IGNORE"):
            raise DtdError("bad conditional section")
        depth, k = 1, head.end()
        scan = re.compile(r"""<!\[|\]\]>|"[^"]*"|'[^']*'|<!--.*?-->""", re.S)
        while depth:
            m = scan.search(text, k)
            if not m:
                raise DtdError("conditional section isn't closed")
            depth += (m[0] == "<![") - (m[0] == "]]>")
            k = m.end()
        if word == "INCLUDE":
            self.read(text[head.end() : m.start()])
        return k

    def element(self, body: str) -> None:
        m = re.fullmatch(rf"\s*({NAME})\s*(.*?)\s*", self.inline(body), re.S)
        if not m:
            raise DtdError("bad element declaration")
        kind, tree = parse_model(m[2])
        if m[1] in self.dtd.elements:
            self.dtd.errors.append(f"Element `{m[1]}' has already been declared")
            return
        self.dtd.elements[m[1]] = Element(m[1], re.sub(r"\s+", "", m[2]), kind, tree, self.external)

    def attlist(self, body: str) -> None:
        text = self.inline(body)
        m = re.match(rf"\s*({NAME})", text)
        if not m:
            raise DtdError("bad attribute declaration")
        element, at = m[1], m.end()
        if any(e == element for e, _ in self.dtd.attributes):
            self.dtd.warnings.append(f"More than one ATTLIST declaration for element type `{element}'")
        while text[at:].strip():
            m = _ATTDEF.match(text, at)
            if not m:
                raise DtdError(f"bad attribute declaration for `{element}'")
            at = m.end()
            kind, allowed = m["type"], []
            if "(" in kind:
                allowed = [x.strip() for x in kind[kind.index("(") + 1 : -1].split("|")]
                kind = "NOTATION" if kind.startswith("NOTATION") else "ENUM"
            default = m["word"][1:] if m["word"] else "FIXED" if m["fixed"] else "VALUE"
            value = None
            if m["value"]:
                value = self.value(m["value"][1:-1])
                if kind != "CDATA":
                    value = " ".join(value.split(" ")).strip()
                    value = re.sub(" +", " ", value)
            if (element, m["name"]) in self.dtd.attributes:
                self.dtd.warnings.append(f"More than one declaration for attribute `{m['name']}' of element type `{element}'")
                continue
            self.dtd.attributes[element, m["name"]] = Attribute(element, m["name"], kind, allowed, default, value, self.external)

    def value(self, text: str, open_: tuple = ()) -> str:
        """A default value with its references put in."""
        if "<" in text:
            raise DtdError("Attribute default with <")

        def one(m: re.Match) -> str:
            if m[1]:
                return char_refs(m[0])
            name = m[2]
            if name in _PREDEFINED:
                return _PREDEFINED[name]
            e = self.dtd.entities.get(name)
            if e is None or e.text is None or name in open_:
                raise DtdError(f"bad reference to entity `{name}'")
            return self.value(e.text, (*open_, name))

        return re.sub(rf"&(?:(#x[0-9a-fA-F]+|#[0-9]+)|({NAME}));", one, re.sub(r"[\t\n\r]", " ", text))

    def entity(self, body: str) -> None:
        m = re.fullmatch(rf"\s*(%\s+)?({NAME})\s+(?:{_QUOTED}|(?:PUBLIC\s+{_QUOTED}|SYSTEM)\s+{_QUOTED}(?:\s+NDATA\s+({NAME}))?)\s*", self.inline(body) if not re.match(r"\s*%\s", body) else body)
        if not m:
            raise DtdError("bad entity declaration")
        parameter, name = bool(m[1]), m[2]
        table = self.dtd.parameters if parameter else self.dtd.entities
        public = " ".join(m[4][1:-1].split()) if m[4] else None
        e = Entity(name, parameter, self.literal(m[3]) if m[3] else None, public, m[5][1:-1] if m[5] else None, m[6], self.external)
        if not parameter and name in _PREDEFINED:
            if e.text is None or char_refs(e.text) not in (_PREDEFINED[name], f"&#{ord(_PREDEFINED[name])};"):
                self.dtd.errors.append(f"Predefined entity `{name}' redeclared")
            return
        if name in table:
            self.dtd.warnings.append(f"More than one declaration for entity `{name}'")
            return
        table[name] = e

    def notation(self, body: str) -> None:
        m = re.fullmatch(rf"\s*({NAME})\s+(?:PUBLIC\s+{_QUOTED}(?:\s+{_QUOTED})?|SYSTEM\s+{_QUOTED})\s*", self.inline(body))
        if not m:
            raise DtdError("bad notation declaration")
        if m[1] in self.dtd.notations:
            self.dtd.errors.append(f"Notation `{m[1]}' declared twice")
            return
        strip = lambda q: q[1:-1] if q else None
        self.dtd.notations[m[1]] = (strip(m[2]), strip(m[3] or m[4]))

    def pinstr(self, target: str, data: str) -> None:
        self.dtd.pinstrs.append((target, data))
        if target != self.target:
            return
        option, attrs = parse_option(data)
        if option == "optional-element-and-notation-declarations":
            self.dtd.optional_elements = True
        elif option == "optional-attribute-declarations":
            self.dtd.optional_attributes |= set(attrs.get("elements", "").split())
        elif option == "namespace":
            self.dtd.namespaces[attrs["prefix"]] = attrs["uri"]
        else:
            self.dtd.errors.append(f"Unknown option `{option}'")


def parse_option(data: str) -> tuple[str, dict[str, str]]:
    """The option of a processing instruction and its attributes."""
    m = re.match(rf"\s*({NAME})", data)
    if not m:
        raise DtdError("option without a name")
    return m[1], {n: v[1:-1] for n, v in re.findall(rf"({NAME})\s*=\s*{_QUOTED}", data[m.end() :])}


def parse_dtd(text: str, internal: str = "", root: str | None = None, catalog: dict[str, str] | None = None, target: str = OPTIONS) -> Dtd:
    """A DTD of an internal subset, read first, and an external one. Processing
    instructions for ``target`` are options; those for others are kept, no more."""
    return Dtd(root=root).add(internal, False, catalog, target).add(text, True, catalog, target)


def doctype(xml: str) -> tuple[str | None, str | None, str | None, str]:
    """(root, public, system, internal subset) of a document's DOCTYPE."""
    m = re.search(rf"<!DOCTYPE\s+({NAME})(?:\s+PUBLIC\s+{_QUOTED}\s+{_QUOTED}|\s+SYSTEM\s+{_QUOTED})?\s*", xml)
    if not m:
        return None, None, None, ""
    strip = lambda q: q[1:-1] if q else None
    subset = re.compile(r"""\[((?:[^\]"'<]|"[^"]*"|'[^']*'|<!--.*?-->|<\?.*?\?>|<!(?:[^"'>]|"[^"]*"|'[^']*')*>)*)\]""", re.S).match(xml, m.end())
    return m[1], strip(m[2]), strip(m[3] or m[4]), subset[1] if subset else ""


def dtd_of(xml: str, catalog: dict[str, str] | None = None) -> Dtd:
    """The DTD of a document: its internal subset, then the external one from the
    catalog."""
    root, public, system, internal = doctype(xml)
    known = catalog or {}
    return parse_dtd(known.get(system, known.get(public, "")), internal, root, known)


@dataclass
class DtdTables:
    """The DTDs of many documents: ``of`` (doc_id, dtd_id), and tables keyed by dtd_id."""

    of: DataFrame
    frames: dict[str, DataFrame]


def _doctypes(docs: DataFrame) -> DataFrame:
    """(doc_id, root, public_id, system_id, internal); no root without a DOCTYPE."""

    @F.arrow_udf("root string, public_id string, system_id string, internal string")
    def run(texts: pa.Array) -> pa.Array:
        rows = [doctype(t) if t else (None, None, None, "") for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["root", "public_id", "system_id", "internal"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), run("xml").alias("d")).select("doc_id", "d.*")


def dtds_of(docs: DataFrame, catalog: dict[str, str] | None = None, target: str = OPTIONS, transform: Callable[[Dtd], Dtd] | None = None) -> DtdTables:
    """The DTDs of ``docs`` (doc_id, xml), each different one parsed once, in a task:
    its internal subset, then the external one from the catalog. A DTD that can't be
    read has an error, and what was read before it. ``transform`` may change a DTD before
    anything is held against it."""
    ship(docs.sparkSession)
    found = roundtrip(_doctypes(docs).withColumn("dtd_id", F.xxhash64("root", "public_id", "system_id", "internal")), "doctypes").filter("root IS NOT NULL")
    each = found.groupBy("dtd_id").agg(*[F.first(c).alias(c) for c in ("root", "public_id", "system_id", "internal")])
    return DtdTables(found.select("doc_id", "dtd_id"), read_dtds(each.withColumn("external", F.lit(None).cast("string")), catalog, target, transform))


def read_dtds(texts: DataFrame, catalog: dict[str, str] | None = None, target: str = OPTIONS, transform: Callable[[Dtd], Dtd] | None = None) -> dict[str, DataFrame]:
    """The tables of ``texts`` (dtd_id, root, public_id, system_id, internal, external):
    the internal subset of each comes first, then its external text, or the one that the
    catalog has."""
    known = catalog or {}
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["dtd_id", *_COLUMNS]
        kinds = [pa.int64(), *(pa.list_(pa.string()) if c == "allowed" else pa.bool_() if c in ("deterministic", "external") else pa.string() for c in _COLUMNS)]
        for batch in batches:
            out = []
            for key, root, public, system, internal, external in zip(*(c.to_pylist() for c in batch.columns)):
                dtd = Dtd(root=root)
                try:
                    for part, outside in ((internal or "", False), (external if external is not None else known.get(system, known.get(public, "")), True)):
                        dtd.add(part, outside, known, target)
                except DtdError as e:
                    dtd.errors.append(str(e))
                dtd = transform(dtd) if transform else dtd
                out += [(key, *r) for r in dtd.declarations()]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    # small texts take long to read: as many tasks as there are cores, not as their size asks for
    texts = texts.repartition(texts.sparkSession.sparkContext.defaultParallelism)
    rows = texts.select("dtd_id", "root", "public_id", "system_id", "internal", "external").mapInArrow(run, f"dtd_id long, {DECLARATIONS}")
    return split(roundtrip(rows, "declarations"))


def written(text: Column, target: str = OPTIONS) -> Column:
    """The declarations of a DTD as they are written again; null if it can't be read."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                out.append(None if t is None else parse_dtd(t, target=target).write())
            except DtdError:
                out.append(None)
        return pa.array(out, pa.string())

    return run(text)
