"""Spans of patterns in whole texts by DataFrame functions alone: offsets count code points, ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,stop:int,value:string>>"


def find(text: Column, pattern: str, when: Column) -> tuple[Column, Column]:
    """All leftmost non-overlapping matches, and the pieces of text around them; none unless when holds.

    The two arrays are meant to become columns, which at() then turns into spans.
    """
    none = F.array().cast("array<string>")
    return F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(when, F.split(text, pattern, -1)).otherwise(none)


#: Matches whose ends are summed together. Ends are appended block by block, as each append copies what is there.
BLOCK = 256


def _ends(found: str, around: str) -> str:
    """Where each match of column found ends: the lengths of the matches and of the pieces of column around, summed up."""
    places = f"sequence(b * {BLOCK}, least(b * {BLOCK} + {BLOCK - 1}, size({found}) - 1))"
    part = f"aggregate({places}, array(acc.t), (x, i) -> array_append(x, element_at(x, -1) + length({around}[i]) + length({found}[i])))"
    return (
        f"aggregate(sequence(0, (size({found}) - 1) div {BLOCK}), named_struct('t', 0, 'e', cast(array() as array<int>)), "
        f"(acc, b) -> named_struct('t', element_at({part}, -1), 'e', concat(acc.e, slice({part}, 2, {BLOCK}))), acc -> acc.e)"
    )


def _spans(found: str, around: str, more: str, kind: str) -> Column:
    span = f"struct(e - length({found}[i]) as start, e as stop, {found}[i] as value{more})"
    return F.when(F.size(found) > 0, F.expr(f"transform({_ends(found, around)}, (e, i) -> {span})")).otherwise(F.array()).cast(kind)


def at(found: str, around: str) -> Column:
    """Spans of the matches in column found, placed by the lengths of the pieces in column around."""
    return _spans(found, around, "", SPAN)


def with_context(found: str, around: str, before: int, after: int) -> Column:
    """at() with the characters before and after each match, as far as the neighbouring matches of the pattern."""
    more = f", right({around}[i], {before}) as before, left({around}[i + 1], {after}) as after"
    return _spans(found, around, more, "array<struct<start:int,stop:int,value:string,before:string,after:string>>")


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans with their kind, in a form that sorts by start, then by order."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("k"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
