"""Rule tables as expressions: one CASE for each output, no Python at run time."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(parts: Sequence[str]) -> str:
    return "|".join(re.escape(p) for p in parts)


def either(parts: Sequence[str]) -> str:
    """A pattern for one of the parts, shared beginnings once, so a place is given up at the first character that none has."""
    by: dict[str, list[str]] = {}
    for p in sorted(set(parts)):
        by.setdefault(p[:1], []).append(p[1:])
    ends = by.pop("", None) is not None
    options = []
    for c, rests in by.items():
        options.append(re.escape(c) + (re.escape(rests[0]) if len(rests) == 1 else either(rests)))
    if ends:
        options.append("")  # the longer ones first
    firsts = "".join(re.escape(c) for c in by)
    return (f"(?=[{firsts}])" if len(by) > 1 and not ends else "") + (f"(?:{'|'.join(options)})" if len(options) > 1 else options[0])


def has_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether text contains one of the parts; false for null. One constant array for the whole list keeps plans small."""
    return F.coalesce(F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p)), F.lit(False))


def has_word(verb: Column, words: Sequence[str]) -> Column:
    """Whether one of the words is a whole run of ASCII letters in verb."""
    return F.coalesce(verb.rlike(f"(?:^|[^a-zA-Z])(?:{quoted(words)})(?:$|[^a-zA-Z])"), F.lit(False))


def has_alone(text: Column, parts: Sequence[str]) -> Column:
    """Whether the first occurrence of one of the parts stands between other characters than a-z and 0-9."""
    return F.coalesce(F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: first_alone(text, p)), F.lit(False))


def first_alone(text: Column, part: Column) -> Column:
    at = F.instr(text, part)
    word = lambda c: F.coalesce(c.rlike("^[a-z0-9]$"), F.lit(False))
    return (at > 0) & ~((at > 1) & word(F.substring(text, at - 1, F.lit(1)))) & ~word(F.substring(text, at + F.length(part), F.lit(1)))


def first_rule(rules: Sequence[tuple], fits: Callable[[Sequence[str]], Column], value: int | Callable[[tuple], Column]) -> Column:
    """Element ``value`` of the first rule whose first element fits (or what ``value`` makes of the rule); null if none does."""
    out = None
    for rule in rules:
        test, then = fits(rule[0]), value(rule) if callable(value) else F.lit(rule[value])
        out = F.when(test, then) if out is None else out.when(test, then)
    return out
