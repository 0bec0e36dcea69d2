"""Event filters on a stream of events: Structured Streaming with state by document.

Events of a document must arrive in the order of ``seq`` over the micro-batches; within
one batch they are sorted. The state is the pending text, or the names of the open
elements, so it doesn't grow with a document. All columns of events stay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sylva.sources.xml import EVENTS

_COLUMNS = ["doc_id", "seq", "kind", "name", "value", "attrs", "line", "col"]
_END = ("end_of_stream", "error")


def _filled(events: DataFrame) -> DataFrame:
    """Events with all columns; those that a table lacks are null."""
    kinds = dict(x.split(" ", 1) for x in EVENTS.replace(", ", "\n").splitlines())
    return events.select(*[F.col(c) if c in events.columns else F.lit(None).cast(kinds[c]).alias(c) for c in _COLUMNS])


def _integers(rows: pd.DataFrame) -> pd.DataFrame:
    """Numbers that may be missing stay whole."""
    return rows.astype({"doc_id": "Int64", "seq": "Int64", "line": "Int32", "col": "Int32"})[_COLUMNS]


def _norm(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(parts)).sort_values("seq", ignore_index=True)
    text = rows["kind"] == "char_data"
    rows = rows[~text | (rows["value"].fillna("") != "")].reset_index(drop=True)
    if state.exists:
        at, value, line, col = state.get
        rows = pd.concat([pd.DataFrame([(key[0], at, "char_data", None, value, [], line, col)], columns=_COLUMNS).astype(object), rows.astype(object)], ignore_index=True)
    text = rows["kind"] == "char_data"
    # a run of texts is one group, any other event one by itself
    group = (~text | ~text.shift(fill_value=False)).cumsum()
    first = rows[~group.duplicated()].copy()
    joined = rows["value"].where(text).groupby(group.values).agg(lambda v: "".join(x for x in v if isinstance(x, str)))
    first["value"] = [j if k == "char_data" else v for j, k, v in zip(joined.tolist(), first["kind"], first["value"])]
    ended = bool(rows["kind"].isin(_END).any())
    if len(first) and not ended and first["kind"].iloc[-1] == "char_data":
        last = first.iloc[-1]
        state.update((int(last["seq"]), last["value"], *(None if pd.isna(last[c]) else int(last[c]) for c in ("line", "col"))))
        first = first.iloc[:-1]
    elif state.exists:
        state.remove()
    if len(first):
        yield _integers(first)


def _dropper(element_only: frozenset[str]) -> Callable:
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("seq", ignore_index=True)
        stack, keep = list(state.get[0]) if state.exists else [], []
        for kind, name, value in zip(rows["kind"], rows["name"], rows["value"]):
            blank = kind == "char_data" and bool(stack) and stack[-1] in element_only and not (value or "").strip(" \t\r\n")
            keep.append(not blank)
            if kind == "start_tag":
                stack.append(name)
            elif kind == "end_tag":
                stack.pop()
        if rows["kind"].isin(_END).any():
            if state.exists:
                state.remove()
        else:
            state.update((stack,))
        if any(keep):
            yield _integers(rows[pd.Series(keep)])

    return run


def norm_cdata_stream(events: DataFrame) -> DataFrame:
    """Merge neighbouring character data over micro-batches; what is pending when a
    document ends is sent before its last event."""
    return _filled(events).groupBy("doc_id").applyInPandasWithState(_norm, EVENTS, "at long, text string, line int, col int", "append", GroupStateTimeout.NoTimeout)


def drop_ignorable_whitespace_stream(events: DataFrame, element_only: list[str]) -> DataFrame:
    """Without blank texts in elements that have element content only, which are named."""
    return _filled(events).groupBy("doc_id").applyInPandasWithState(_dropper(frozenset(element_only)), EVENTS, "open array<string>", "append", GroupStateTimeout.NoTimeout)


def pfilter_stream(events: DataFrame, predicate) -> DataFrame:
    """A filter without state is the same on streams."""
    return events.filter(predicate)
