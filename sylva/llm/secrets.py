"""Secret scans: fixed patterns and a battery of randomness tests, in DataFrame
functions only.

Base spans come from three patterns. The method adds spans of kind ``random``: runs of
``RUN`` or more token characters that don't touch a base span and look drawn at random.
Each run's encoding is inferred (hex, base 32, base 36, base 64) and three tests are
taken over its alphabet of k characters and its length n:

* chi-squared of the character counts against a uniform alphabet,
* the number of runs of a character class (digit, lower, upper, other),
* the serial correlation of neighbouring character codes.

Each test has a normal score under the hypothesis that the run is *structured*: it
repeats characters as words do, rarely changes class, or is correlated. The scores add
up to one, and the false discovery rate is held by Benjamini and Hochberg's step-up
rule within classes of length (powers of two), over all documents. For that a histogram
of scores is counted, one row for each class and step, however many runs there are.

A text is cut into segments of about ``SEGMENT`` characters, at characters that no
pattern can cross, and each segment is searched by itself: lists of spans stay short,
so that time grows with the length of a text, however many spans it has.

Defined results: a null or empty text has no spans; a very long text is searched whole;
spans that start together go by kind; runs whose scores tie are taken together or not
at all; repeated rows count and report each; an empty table gives no rows; columns
other than the id and text aren't read, whatever their names, and ``redact`` keeps
them (and updates ``n_chars`` where it is there).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stage

KINDS = ["assign", "access", "hex", "random"]
# The patterns of base spans, with the group and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = [(ASSIGN, 2, 8), (ACCESS, 0, 16), (HEX, 0, 32)]

#: Characters of a segment, at least, where there is a place to cut.
SEGMENT = 2048
# A character that no pattern has, or a single blank that no ":" or "=" is next to.
_SAFE = r"""[^A-Za-z0-9+/_.=:"'\x20-]|(?<![:=\x20])\x20(?![:=\x20])"""
_SEGMENTS = rf"(?s).{{{SEGMENT},}}?(?:{_SAFE})|.+"

#: Shortest run that is tested.
RUN = 20
_RUNS = rf"[A-Za-z0-9+/_=-]{{{RUN},}}"
#: Expected share of false spans among those added in a class of length.
FALSE_SHARE = 0.01
#: Steps of the histogram in standard deviations, and its ends.
STEP, LOW, HIGH = 0.05, -10.0, 40.0
#: Classes of length: powers of two from 16 on, the last one open.
LENGTH_CLASSES = 8
#: Chance that neighbours differ in class, and correlation, of structured text.
CHANGE, CORRELATED = 0.15, 0.5
#: Chance that two characters of words are the same.
COINCIDENCE = 0.065

_SPANS = "array<struct<start:bigint,kind:int,end:bigint,text:string>>"


def _occurrences(text: Column, pattern: str, kind: int, group: int, least: int, keep_text: bool = False) -> Column:
    """The matches of a pattern, as places in code points. What lies between them has
    their places: the text is split there and lengths add up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    # a match starts where the piece before it ends
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("long"))
    rows = F.zip_with(F.arrays_zip(found.alias("m"), tested.alias("t")), F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(g.alias("gap"), m["m"].alias("m"), m["t"].alias("t")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("out"))

    def add(acc: Column, r: Column) -> Column:
        begin = acc["at"] + r["gap"]
        end = begin + F.char_length(r["m"])
        kept = F.lit(None).cast("string") if not keep_text else r["m"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), kept.alias("text"))
        out = F.when(F.char_length(r["t"]) >= least, F.concat(acc["out"], F.array(span).cast(_SPANS))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    spans = F.aggregate(rows, start, add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPANS))


# the runs of hexadecimal digits that count have 32 or more: the same maximal runs
_LONG = {HEX: r"[0-9a-f]{32,}", ACCESS: r"AKIA[A-Z0-9]{12,}"}


def segments(text: Column) -> Column:
    """The parts of a text, in order: none of an empty one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_SEGMENTS), F.lit(0))


def segment_spans(segment: Column) -> Column:
    """The base spans of one segment, by start and then kind."""
    return F.array_sort(F.concat(*[_occurrences(segment, _LONG.get(p, p), k, group, least) for k, (p, group, least) in enumerate(BASE)]))


def alphabet(run: Column) -> Column:
    """Characters of the inferred encoding; null where none is inferred."""
    return (
        F.when(run.rlike(r"^[0-9]+$|^[^A-Za-z]+$"), F.lit(None))
        .when(run.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), F.lit(16))
        .when(run.rlike(r"^[A-Z2-7]+=*$"), F.lit(32))
        .when(run.rlike(r"^([0-9a-z]+|[0-9A-Z]+)$"), F.lit(36))
        .otherwise(F.lit(64))
        .cast("double")
    )


def score(run: Column) -> Column:
    """How many standard deviations a run is from a structured one."""
    codes = F.transform(F.split(F.rtrim(run, F.lit("=")), ""), F.ascii)
    codes = F.filter(codes, lambda c: c > 0)
    n, k = F.size(codes).cast("double"), alphabet(run)
    zero, one = F.lit(0.0), F.lit(0)

    def same(acc: Column, c: Column) -> Column:
        run = F.when(acc["last"] == c, acc["run"] + 1).otherwise(F.lit(1.0))
        # c^2 is the sum of the first c odd numbers
        return F.struct(c.alias("last"), run.alias("run"), (acc["sum"] + 2 * run - 1).alias("sum"))

    squares = F.aggregate(F.array_sort(codes), F.struct(one.alias("last"), zero.alias("run"), zero.alias("sum")), same, lambda a: a["sum"])
    chi = k / n * squares - n
    excess = k * F.greatest(F.lit(COINCIDENCE), 2 / k) - 1
    uniform = -(chi - (k - 1) - (n - 1) * excess) / F.sqrt(2 * (k - 1) + 4 * n * excess)

    def kind_of(c: Column) -> Column:
        return F.when(c.between(48, 57), F.lit(1)).when(c.between(97, 122), F.lit(2)).when(c.between(65, 90), F.lit(3)).otherwise(F.lit(4))

    def turn(acc: Column, c: Column) -> Column:
        kind = kind_of(c)
        return F.struct(kind.alias("last"), (acc["n"] + F.when((acc["last"] > 0) & (acc["last"] != kind), 1.0).otherwise(0.0)).alias("n"))

    turns = F.aggregate(codes, F.struct(one.alias("last"), zero.alias("n")), turn, lambda a: a["n"])
    runs = (turns - (n - 1) * CHANGE) / F.sqrt((n - 1) * CHANGE * (1 - CHANGE))

    def pair(acc: Column, c: Column) -> Column:
        x = c.cast("double")
        return F.struct(x.alias("last"), (acc["x"] + x).alias("x"), (acc["xx"] + x * x).alias("xx"), (acc["xy"] + acc["last"] * x).alias("xy"))

    def correlation(a: Column) -> Column:
        # the last and first are neighbours too
        var = n * a["xx"] - a["x"] * a["x"]
        r = (n * (a["xy"] + a["last"] * F.element_at(codes, 1)) - a["x"] * a["x"]) / F.when(var > 0, var)
        return F.least(F.lit(0.999), F.abs(F.coalesce(r, F.lit(1.0))))

    r = F.aggregate(codes, F.struct(zero.alias("last"), zero.alias("x"), zero.alias("xx"), zero.alias("xy")), pair, correlation)
    serial = (F.lit(math.atanh(CORRELATED)) - F.atanh(r)) * F.sqrt(n - 3)
    total = (uniform + runs + serial) / F.sqrt(F.lit(3.0))
    return F.when(k.isNotNull() & (n >= 8), F.greatest(F.lit(LOW), F.least(F.lit(HIGH), total)))


def length_class(span: Column) -> Column:
    return F.least(F.lit(LENGTH_CLASSES - 1), F.floor(F.log2((span["end"] - span["start"]).cast("double")) - 4).cast("int"))


def random_runs(segment: Column, base: Column) -> Column:
    """Runs of a segment that touch no base span, with their class of length and step
    of score."""
    runs = _occurrences(segment, _RUNS, 3, 0, RUN, keep_text=True)
    free = F.filter(runs, lambda r: ~F.exists(base, lambda b: (r["start"] < b["end"]) & (r["end"] > b["start"])))
    scored = F.transform(free, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), length_class(r).alias("class"), F.floor((score(r["text"]) - LOW) / STEP).cast("int").alias("step")))
    return F.filter(scored, lambda r: r["step"].isNotNull())


_FOUND = "array<struct<at:bigint,n:bigint,base:array<struct<start:bigint,kind:int,end:bigint>>,runs:array<struct<start:bigint,end:bigint,class:int,step:int>>>>"


def found_in(text: Column) -> Column:
    """For each segment with a span: where it starts, how long it is, its base spans and
    tested runs, at places within it."""
    every = segments(text)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    starts = F.aggregate(every, zero, lambda acc, s: F.struct((acc["at"] + F.char_length(s)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def one(segment: Column, at: Column) -> Column:
        base = segment_spans(segment)
        return F.struct(at.alias("at"), F.char_length(segment).cast("long").alias("n"), _bare(base).alias("base"), random_runs(segment, base).alias("runs"))

    with_spans = F.filter(F.zip_with(every, starts, one), lambda s: (F.size(s["base"]) > 0) | (F.size(s["runs"]) > 0))
    likely = text.rlike("|".join(f"(?:{_LONG.get(p, p)})" for p, _, _ in BASE) + f"|{_RUNS}")
    return F.when(likely, with_spans).otherwise(F.array()).cast(_FOUND)


def placed(found: Column, name: str) -> Column:
    """The ``base`` spans or ``runs`` of all segments, at places in the whole text."""

    def move(s: Column) -> Column:
        if name == "base":
            return F.transform(s["base"], lambda b: F.struct((b["start"] + s["at"]).alias("start"), b["kind"].alias("kind"), (b["end"] + s["at"]).alias("end")))
        return F.transform(s["runs"], lambda r: F.struct((r["start"] + s["at"]).alias("start"), (r["end"] + s["at"]).alias("end"), r["class"].alias("class"), r["step"].alias("step")))

    return F.flatten(F.transform(found, move))


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def least_steps(runs: DataFrame, share: float = FALSE_SHARE) -> dict[int, int]:
    """For each class of length, the step from which on runs are taken as random."""
    # classes times steps rows at most
    counted = runs.select(F.explode("runs").alias("r")).groupBy("r.class", "r.step").agg(F.count("*").alias("n")).collect()
    out: dict[int, int] = {}
    for c in sorted({r["class"] for r in counted}):
        own = sorted(((r["step"], r["n"]) for r in counted if r["class"] == c), reverse=True)
        total, above = sum(n for _, n in own), 0
        for step, n in own:
            above += n
            if _tail(LOW + step * STEP) <= share * above / total:
                out[c] = step
    return out


def _taken(runs: Column, steps: dict[int, int]) -> Column:
    """The runs from their class's step on, as spans."""
    kept = F.filter(runs, lambda r: _any([(r["class"] == c) & (r["step"] >= s) for c, s in steps.items()]))
    return F.transform(kept, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A staged table of (id, base spans, tested runs): one pass over the texts."""
    based = docs.select(F.col(id_col).alias("id"), found_in(F.col(text_col)).alias("found"))
    return stage(based.select("id", placed(F.col("found"), "base").alias("base"), placed(F.col("found"), "runs").alias("runs")), "spans")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans of every document."""
    rows = found(docs)
    spans = F.concat(F.col("base"), _taken(F.col("runs"), least_steps(rows)))
    return rows.select(F.col("id").alias("doc_id"), *[_count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(spans).alias("spans"), _count(spans, 3).alias("n_random"))


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``mark``. The spans and tested runs of all
    texts are staged beside them; thresholds come from all runs."""
    name = free_name(docs, "_found")
    held = stage(docs.withColumn(name, found_in(F.col(text_col))), "searched")
    steps = least_steps(held.select(placed(F.col(name), "runs").alias("runs")))
    text = F.col(text_col)

    def cut(segment: Column, s: Column) -> Column:
        """A segment without its spans; places are short, as segments are."""
        spans = F.array_sort(F.concat(s["base"], _taken(s["runs"], steps)))

        def add(acc: Column, x: Column) -> Column:
            piece = F.concat(acc["out"], F.substring(segment, acc["at"].cast("int") + 1, (x["start"] - acc["at"]).cast("int")), F.lit(mark))
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], piece).otherwise(acc["out"]).alias("out"))

        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
        return F.aggregate(spans, start, add, lambda a: F.concat(a["out"], F.substring(segment, a["at"].cast("int") + 1, F.lit(2**31 - 1))))

    # segments with spans are found again by the lengths of all
    every = segments(text)
    begins = F.map_from_arrays(F.transform(F.col(name), lambda s: s["at"]), F.col(name))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def join(acc: Column, segment: Column) -> Column:
        s = F.try_element_at(begins, acc["at"])
        new = F.when(s.isNotNull(), cut(segment, s)).otherwise(segment)
        return F.struct((acc["at"] + F.char_length(segment)).alias("at"), F.concat(acc["out"], F.array(new)).alias("out"))

    done = F.aggregate(every, zero, join, lambda a: F.array_join(a["out"], ""))
    has = F.size(name) > 0
    out = held.withColumn(text_col, F.when(has, done).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(has, F.char_length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
