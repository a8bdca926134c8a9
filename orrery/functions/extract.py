"""Positional extraction from text: matches with their places, JVM-side, and a state machine in an Arrow UDF behind a JVM-side filter."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.text import quoted

PRICE = r"(?:[¥￥$]\s?\d+(?:\.\d+)?)|(?:\d+(?:\.\d+)?\s?(?:元|块|rmb))"


def match_places(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern in a text, each with its group's text and its place (from 0), JVM-side: what stands between the matches
    tells where they are. The pattern must not match nothing; null texts have none."""
    whole, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    part = F.regexp_extract_all(c, F.lit(pattern), F.lit(group)) if group else whole

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        return F.struct((at + F.length(x["whole"])).alias("at"), F.array_append(acc["out"], F.struct(x["text"].alias("text"), at.alias("at"))).alias("out"))

    none = F.array().cast("array<struct<text:string,at:int>>")
    each = F.arrays_zip(whole.alias("whole"), part.alias("text"), F.slice(gaps, 1, F.size(whole)).alias("gap"))
    return F.coalesce(F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"]), none)


def _near(amounts: Column, units: Column, distance: int, nearest: bool, make: Callable[[Column, Column], Column]) -> Column:
    """For each amount, what `make` gives of it and of the unit near it (null if none is)."""

    def one(m: Column) -> Column:
        close = F.filter(units, lambda u: F.abs(u["at"] - m["at"]) <= distance)
        pick = F.array_min(F.transform(close, lambda u: F.struct(F.abs(u["at"] - m["at"]).alias("d"), u["at"].alias("at"), u["text"].alias("text"))))["text"] if nearest else F.get(close, F.lit(0))["text"]
        return make(m, pick)

    return F.transform(amounts, one)


def prices(c: Column, units: list[str], distance: int = 25, nearest: bool = False) -> Column:
    """Amounts in a text with the unit word near it: the first unit in text order within `distance` characters, or the nearest."""
    number = lambda m: F.regexp_extract(m["text"], r"\d+(?:\.\d+)?", 0).cast("double")
    return _near(match_places(c, f"(?i){PRICE}"), match_places(c, quoted(units)), distance, nearest, lambda m, u: F.struct(number(m).alias("amount"), u.alias("near_unit")))


def amounts_near(c: Column, money: str, unit: str, distance: int = 25) -> Column:
    """The distinct pairs of an amount (the first group of the money pattern, as text) and the first unit within `distance` characters
    (else empty), in text order."""
    found = _near(match_places(c, f"(?i){money}", 1), match_places(c, f"(?i){unit}"), distance, False, lambda m, u: F.struct(m["text"].alias("amount"), F.coalesce(F.trim(u), F.lit("")).alias("near_unit")))
    return F.array_distinct(found)


def contacts(c: Column, patterns: dict[str, tuple[list[str], str]], window: int = 40) -> Column:
    """Contacts by kind: after each trigger word, the first id that the kind's pattern finds within `window` characters; each pair of
    kind and value once, in text order of its trigger within a kind. A kind without triggers is sought in the whole text; its pattern
    must mean the same to Java. Only texts that hold a trigger or such a pattern leave the JVM."""
    compiled = {k: (re.compile("|".join(re.escape(w) for w in t), re.I) if t else None, re.compile(p)) for k, (t, p) in patterns.items()}

    def find(t: str | None) -> list[dict]:
        seen: dict[tuple[str, str], None] = {}
        for kind, (trigger, pattern) in compiled.items():
            if trigger is None:
                seen.update({(kind, m.group()): None for m in pattern.finditer(t or "")})
                continue
            for m in trigger.finditer(t or ""):
                if found := pattern.search((t or "")[m.end() : m.end() + window]):
                    seen.setdefault((kind, found.group()), None)
        return [{"type": k, "value": v} for k, v in seen]

    @F.pandas_udf("array<struct<type:string,value:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(find)

    any_kind = "|".join([rf"(?iu:{quoted(t)})" if t else f"(?:{p})" for t, p in patterns.values()]) or "(?!)"
    return F.when(c.rlike(any_kind), run(c)).otherwise(F.array().cast("array<struct<type:string,value:string>>"))
