import re

import pytest
from pyspark.sql import functions as F

from sylva.operators import events as ev
from sylva.operators import tree
from sylva.operators.dtd import DtdError, deterministic, doctype, dtd_of, dtds_of, parse_dtd, parse_model, parse_option, regex_of
from sylva.operators.validate import Validator
from sylva.sources.parser import Options
from sylva.sources.xml import parse_events, parse_nodes


def model(text):
    return parse_model(text)[1]


@pytest.mark.parametrize(
    ("text", "yes", "no"),
    [
        ("(a,b)", ["ab"], ["", "a", "ba", "abb"]),
        ("(a|b)*", ["", "abba"], ["c"]),
        ("(a,(b|c)+,d?)", ["ab", "abcd", "acc"], ["ad", "a", "abdd"]),
        ("((a*)*)+", ["", "aaaa"], ["b"]),
        ("(a?,(b,c)?)", ["", "a", "bc", "abc"], ["ab", "cb"]),
        ("((a+)?)*", ["", "aaa"], ["ab"]),
    ],
)
def test_models(text, yes, no):
    rule = re.compile(regex_of(model(text)))
    say = lambda s: "".join(f"<{c}>" for c in s)
    assert all(rule.fullmatch(say(s)) for s in yes) and not any(rule.fullmatch(say(s)) for s in no)


def test_repeats_do_not_run_away():
    assert re.fullmatch(regex_of(model("((a*)*)*")), "<a>" * 5000 + "<b>") is None


@pytest.mark.parametrize(("text", "want"), [("(a,b)", True), ("((a,b)|(a,c))", False), ("(a*,a)", False), ("((a|b)*,c)", True), ("(a?,b?,a)", False), ("((a,b)*,a)", False), ("(a,(b|c)+)", True)])
def test_determinism(text, want):
    assert deterministic(model(text)) is want


@pytest.mark.parametrize("text", ["(a,b|c)", "(#PCDATA|a)", "(a", "a", "(a,)", "()", "(#PCDATA,a)*"])
def test_bad_models(text):
    with pytest.raises(DtdError):
        if parse_model(text)[0] == "regexp" and text == "a":
            raise DtdError


def test_declarations():
    d = parse_dtd("""<?xml version='1.0'?>
      <!ENTITY % types "(low|high)"><!ENTITY % more SYSTEM "more"><!ENTITY e "x&#65;&amp;">
      <!NOTATION gif PUBLIC "-//G//" "gif"><!ENTITY pic SYSTEM "a.gif" NDATA gif>
      <!ELEMENT a (b , c?)><!ELEMENT b EMPTY>
      <!ATTLIST a k %types; "low" t NMTOKENS " p  q " u CDATA #FIXED 'a&e;' id ID #IMPLIED n NOTATION (gif) #IMPLIED>
      %more;""", catalog={"more": "<!ELEMENT c ANY><!ENTITY e 'second'>"})  # fmt: skip
    assert list(d.elements) == ["a", "b", "c"] and d.elements["a"].model == "(b,c?)"
    assert {k[1]: (a.type, a.value, a.default) for k, a in d.attributes.items()} == {"k": ("ENUM", "low", "VALUE"), "t": ("NMTOKENS", "p q", "VALUE"), "u": ("CDATA", "axA&", "FIXED"), "id": ("ID", None, "IMPLIED"), "n": ("NOTATION", None, "IMPLIED")}
    assert d.entities["e"].text == "xA&amp;" and d.warnings == ["More than one declaration for entity `e'"]
    assert d.validate() == []
    again = parse_dtd(d.write())
    assert again.elements == d.elements and again.notations == d.notations and {k: (a.type, a.value) for k, a in again.attributes.items()} == {k: (a.type, a.value) for k, a in d.attributes.items()}


def test_internal_first():
    d = parse_dtd("<!ENTITY e 'out'><!ATTLIST a k CDATA 'out' j CDATA 'j'>", internal="<!ENTITY e 'in'><!ATTLIST a k CDATA 'in'>", root="a")
    assert d.entities["e"].text == "in" and d.attributes["a", "k"].value == "in" and d.attributes["a", "j"].external


@pytest.mark.parametrize("text", ["<!ELEMENT a>", "<!ENTITY % e '%e;'>%e;", "%nope;", "<![WHAT[]]>", "<![INCLUDE[", "<!ATTLIST a b BAD 'x'>", "junk", "<!ATTLIST a b CDATA '<'>", "<!ATTLIST a b CDATA '&nope;'>"])
def test_errors(text):
    with pytest.raises((DtdError, RecursionError)):
        parse_dtd(text)


def test_twice_and_predefined():
    assert parse_dtd("<!ELEMENT a ANY><!ELEMENT a EMPTY>").validate() == ["Element `a' has already been declared"]
    assert parse_dtd("<!ENTITY lt '&#38;#60;'><!ENTITY gt '>'>").validate() == []
    assert parse_dtd("<!ENTITY lt 'x'>").validate() == ["Predefined entity `lt' redeclared"]
    assert parse_dtd("<!ATTLIST a xml:space CDATA 'x'>").validate() == ["Declaration of attribute `xml:space' does not conform to XML specification"]


def test_documents_with_doctypes(spark):
    xml = "<!DOCTYPE r SYSTEM 's' [<!ELEMENT r (t)>]><r> <t>x</t></r>"
    d = dtd_of(xml, {"s": "<!ELEMENT t (#PCDATA)><!ATTLIST t k CDATA 'v'>"})
    assert d.root == "r" and list(d.elements) == ["r", "t"] and d.elements["t"].external
    docs = spark.createDataFrame([(1, "<r> <t>x</t></r>")], "doc_id long, xml string")
    events = parse_events(docs)
    written = {s: ev.write_documents(events, d, s, "s").first().xml for s in ("omit", "reference", "include", "auto")}
    assert written["omit"] == '<?xml version="1.0" encoding="UTF-8"?>\n<r> <t>x</t></r>' and written["auto"] == written["reference"] and '<!DOCTYPE r SYSTEM "s">' in written["auto"]
    assert list(dtd_of(written["include"]).elements) == ["r", "t"]
    bare = Validator(parse_nodes(docs), d).drop_ignorable()
    assert ev.write(tree.liquefy(bare)).first().xml == "<r><t>x</t></r>"


def test_doctype_and_options():
    assert doctype('<!DOCTYPE a PUBLIC "p" "s" [<!ENTITY x "]">] ><a/>') == ("a", "p", "s", '<!ENTITY x "]">')
    assert doctype("<a/>") == (None, None, None, "")
    assert parse_option('namespace prefix="p" uri=\'u\'') == ("namespace", {"prefix": "p", "uri": "u"})


DTD = """<!NOTATION n SYSTEM 'n'><!ENTITY u SYSTEM 'u' NDATA n>
<!ELEMENT r (e*,t?)><!ELEMENT e EMPTY><!ELEMENT t (#PCDATA|e)*>
<!ATTLIST e id ID #IMPLIED ref IDREFS #IMPLIED req CDATA #REQUIRED k (x|y) 'x' f CDATA #FIXED 'f' ent ENTITIES #IMPLIED>"""

CASES = {
    "<r><e req='1'/></r>": [],
    "<r> <e req='1'/>\n</r>": [],
    "<r><e req='1'/>text</r>": ["Element `r' must not have character contents"],
    "<r><t/><e req='1'/></r>": ["Element `r' does not match its content model"],
    "<r><e req='1'> </e></r>": ["Element `e' must be empty"],
    "<r><e req='1'><!--c--><?p?></e></r>": [],
    "<r><e req='1'><e req='1'/></e></r>": ["Element `e' must be empty"],
    "<r><t>x<e req='1'/>y</t></r>": [],
    "<r><t><t/></t></r>": ["Element `t' does not match its content model"],
    "<r><u/></r>": ["Element `r' does not match its content model", "Reference to undeclared element `u'"],
    "<r><e/></r>": ["Required attribute `req' is missing"],
    "<r><e req='1' z='1'/></r>": ["The following attributes are not declared: z"],
    "<r><e req='1' k='z'/></r>": ["Attribute `k' is lexically malformed"],
    "<r><e req='1' k=' y '/></r>": [],
    "<r><e req='1' f='g'/></r>": ["Attribute `f' is fixed, but has here a different value"],
    "<r><e req='1' id='é日1'/><e req='1' id=':x'/></r>": [],
    "<r><e req='1' id='1x'/></r>": ["Attribute `id' is lexically malformed"],
    "<r><e req='1' id='a'/><e req='1' id='a'/></r>": ["ID not unique"],
    "<r><e req='1' id='a' ref='a  b'/><e req='1' id='b'/></r>": [],
    "<r><e req='1' id='a' ref='a q'/></r>": ["Attribute `ref' of element `e' refers to unknown ID `q'"],
    "<r><e req='1' ent='u u'/></r>": [],
    "<r><e req='1' ent='v'/></r>": ["Reference to undeclared or parsed entity `v'"],
    "<t/>": ["The root element is `t' but is declared as `r'"],
}


def test_validation(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, xml string")
    rows = Validator(parse_nodes(docs), parse_dtd(DTD, root="r")).all().collect()
    for k, (xml, want) in enumerate(CASES.items()):
        assert sorted(r.message for r in rows if r.doc_id == k) == want, xml


def test_validation_against_own_dtds(spark):
    """Each document has its DTD inside, or part of it in a catalog, or none."""
    inside = f"<!DOCTYPE r [{DTD}]>"
    rows = [(k, inside + xml, want) for k, (xml, want) in enumerate(CASES.items())]
    outside = '<!DOCTYPE r SYSTEM "urn:d" [<!ATTLIST e k (x|z) "x">]>'
    rows += [(100 + k, outside + xml, [m for m in want if "`k'" not in m]) for k, (xml, want) in enumerate(CASES.items()) if "k=' y" not in xml]
    rows += [
        (200, "<r/>", ["Document has no DTD"]),
        (201, "<!DOCTYPE a [<!ELEMENT a EMPTY>]><a/>", []),
        (202, "<!DOCTYPE a [<!ELEMENT a EMPTY><!ELEMENT a ANY>]><a/>", ["Element `a' has already been declared"]),
        (203, "<!DOCTYPE a [<!ELEMENT a ((b,c)|(b,d))>]><a/>", ["Element `a' does not match its content model", "The content model of element `a' is not deterministic"]),
        (204, "<!DOCTYPE a [<!ELEMENT a EMPTY><!ATTLIST a i ID #IMPLIED j ID #IMPLIED>]><a/>", ["More than one ID attribute for element `a'"]),
        (205, "<!DOCTYPE a [<?sylva:dtd optional-element-and-notation-declarations?>]><a x='1'><b/></a>", []),
        (206, "<!DOCTYPE a [<?sylva:dtd optional-attribute-declarations elements='a'?><!ELEMENT a (b)><!ELEMENT b EMPTY>]><a x='1'><b x='1'/></a>", ["The following attributes are not declared: x"]),
        (207, "<!DOCTYPE a [<!ELEMENT a EMPTY><!ATTLIST a n NOTATION (g) #IMPLIED>]><a/>", ["Reference to undeclared notation `g'"]),
        (208, "<!DOCTYPE b [<!ELEMENT a EMPTY>]><a/>", ["The root element is `a' but is declared as `b'"]),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, xml string")
    nodes = parse_nodes(docs, Options(catalog={"urn:d": DTD}))
    own = dtds_of(docs, {"urn:d": DTD})
    assert own.of.select("dtd_id").distinct().count() == 10
    v = Validator(nodes, own)
    got = v.all().collect()
    for k, xml, want in rows:
        assert sorted(r.message for r in got if r.doc_id == k) == want, xml
    places = v.diagnostics().collect()
    assert len([r for r in places if r.severity == "error"]) == len(got) and all(r["class"] == "Validity" for r in places)
    at = {(r.doc_id, r.message): (r.line, r.col) for r in places}
    assert at[5 + 4, "Reference to undeclared element `u'"] == (3, len(DTD.splitlines()[-1]) + len("]><r>"))


def test_dtds_are_changed_before_use(spark):
    docs = spark.createDataFrame([(1, "<!DOCTYPE a [<!ELEMENT a (b)>]><a><b/></a>"), (2, "<!DOCTYPE a [<!ELEMENT a (b)><!ELEMENT b ANY>]><a><b x='1'/></a>")], "doc_id long, xml string")

    def more(dtd):
        if "b" not in dtd.elements:
            dtd.add("<!ELEMENT b EMPTY>")
        return dtd.add("<!ATTLIST b x CDATA #IMPLIED>")

    assert Validator(parse_nodes(docs), dtds_of(docs, transform=more)).all().count() == 0
    assert Validator(parse_nodes(docs), dtds_of(docs)).all().count() == 2
    assert parse_dtd("<!ELEMENT a ANY>").add("<!ELEMENT a EMPTY>").validate() == ["Element `a' has already been declared"]


def test_a_dtd_that_cant_be_read(spark):
    docs = spark.createDataFrame([(1, "<!DOCTYPE a [<!ELEMENT a EMPTY> %x;]><a/>"), (2, None), (3, "<!DOCTYPE a [<!ELEMENT a EMPTY>]><a/>")], "doc_id long, xml string")
    own = dtds_of(docs)
    errors = own.of.join(own.frames["errors"], "dtd_id").collect()
    assert [(r.doc_id, r.message) for r in errors] == [(1, "Reference to undeclared parameter entity `x'")]
    assert sorted(r.doc_id for r in own.of.collect()) == [1, 3] and own.frames["elements"].count() == 2


def test_relaxed_and_classes(spark):
    docs = spark.createDataFrame([(1, "<r><x a='1'/></r>"), (2, "<r> <t>x</t></r>")], "doc_id long, xml string")
    relaxed = parse_dtd("<?o:dtd optional-element-and-notation-declarations?><?other:dtd something-else?><!ELEMENT r (t)><!ELEMENT t (#PCDATA)>", target="o:dtd")
    assert relaxed.validate() == [] and parse_dtd("<?sylva:dtd what?>").validate() == ["Unknown option `what'"]
    v = Validator(parse_nodes(docs), relaxed)
    assert v.declared().count() == 0 and v.attrs().count() == 0
    assert {(r.doc_id, r["class"]) for r in v.classify().collect()} == {(2, "IGNORABLE"), (2, "NORMAL")}


def test_defaults_and_empty(spark):
    nodes = parse_nodes(spark.createDataFrame([(1, "<r><e req='1'/></r>")], "doc_id long, xml string"))
    got = {(r.name, r.value) for r in Validator(nodes, parse_dtd(DTD)).typed().filter("NOT specified AND value IS NOT NULL").collect()}
    assert got == {("k", "x"), ("f", "f")}
    assert Validator(nodes.filter(F.lit(False)), parse_dtd(DTD, root="r")).all().count() == 0
    assert Validator(nodes, parse_dtd("")).declared().count() == 2


def test_checks_of_own_dtds_read_stored_nodes(spark, sf, monkeypatch):
    """Documents are read once, not by each check, and no table that grows with them is
    broadcast, however small it looks."""
    import __spark_entry__ as entry
    from sylva.operators import validate

    monkeypatch.setattr(validate, "DTD_ROWS", 0)
    plan = entry.queries()["val_own_dtd"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "BroadcastHashJoin" not in plan
