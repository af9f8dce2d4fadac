"""Licence scan: normalised lines and whole texts against licence templates by the Dice coefficient of word-bigram sets.

A licence that no unit holds is looked for in windows over the whole text, across line ends and within lines: runs of at most
``(2 - t) / t`` times as many word pairs as the template has. The best window begins and ends with a pair of the template,
so only those are compared. A window with Dice t shares at least ``t / (2 - t)`` of the template's n bigrams, so of any
``n - ceil(n t / (2 - t)) + 1`` of them one is in the text; texts without any are passed over.

Only templates whose bigram count lies within the bounds that the threshold implies are compared:
``t / (2 - t) * a <= b <= (2 - t) / t * a`` for set sizes a and b.

Defined cases: a null, empty or one-word unit has no bigrams and matches nothing; ties are all reported (one row per
licence); a licence found in windows alone counts as one unit; repeated rows of a doc_id merge; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import let
from siftwell.sources.scratch import table

MIN_DICE = 0.8
#: Letters of the beginnings of words that are looked for first.
KEY = 6

#: Public licence notices (fixed values).
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain.",
}


def normalise(text: Column) -> Column:
    """Lower case; every run without letters, digits or line ends becomes one space."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def _words(unit: Column) -> Column:
    return F.filter(F.split(unit, " "), lambda w: w != "")


def _pairs(w: Column) -> Column:
    """Word pairs in order, repeats included."""
    n = F.size(w)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), w[i + 1]))
    )


def _bigrams(w: Column) -> Column:
    return F.array_distinct(_pairs(w))


def _template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _template_rows(templates: dict[str, str]) -> list[tuple[str, list[str]]]:
    out = []
    for name, text in templates.items():
        w = _template_words(text)
        if len(w) < 2:
            raise ValueError(f"template {name} has fewer than two words")
        out.append((name, sorted({f"{a} {b}" for a, b in zip(w, w[1:])})))
    return out


def _probe(bigrams: list[str], shared: int, common: Counter) -> list[str]:
    """So many bigrams that a text with ``shared`` of them has one at least: those of few templates and many letters."""
    return sorted(bigrams, key=lambda b: (common[b], -len(b), b))[: len(bigrams) - shared + 1]


def _keys(rows: list[tuple[str, list[str]]], least_shared: dict[str, int]) -> tuple[list[str], list[str]]:
    """Beginnings of words of which a text with any of most templates has one at least, and the names of the other templates.

    A template needs ``n - shared + 1`` bigrams that hold a chosen beginning; those that serve most templates are chosen first.
    """
    starts = {name: [{w[:KEY] for w in b.split(" ") if len(w) >= KEY} for b in bigrams] for name, bigrams in rows}
    need = {name: len(bigrams) - least_shared[name] + 1 for name, bigrams in rows}
    without = [name for name, _ in rows if sum(map(bool, starts[name])) < need[name]]
    chosen: list[str] = []
    while open_ := {n: k for n, k in need.items() if n not in without and k > 0}:
        gain = Counter()
        for name, k in open_.items():
            own = Counter(x for b in starts[name] if not b.intersection(chosen) for x in b)
            gain.update({x: min(n, k) for x, n in own.items()})
        best = min(gain, key=lambda x: (-gain[x], x))
        chosen.append(best)
        for name in open_:
            need[name] -= sum(best in b and not b.intersection(chosen[:-1]) for b in starts[name])
    return chosen, without


def _flat(x: Column) -> Column:
    """Normalised text with its words one space apart, across line ends too."""
    one = F.replace(F.replace(x, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    for _ in range(3):
        one = F.replace(one, F.lit("\n\n"), F.lit("\n"))
    # Runs of more blank lines than that are rare.
    return F.translate(F.when(F.contains(one, F.lit("\n\n")), F.regexp_replace(one, "\n+", "\n")).otherwise(one), "\n", " ")


def _best_window(pairs: Column, template: Column, longest: Column, shared: Column) -> Column:
    """The highest Dice of the windows of ``pairs`` that begin and end with a pair of the template, null without any.

    Each start looks at the next ``longest`` hits alone. With d distinct pairs of the template among those within reach no window from there has
    a Dice above 2 d / (d + n), so a start is passed over when d is too small or the bound does not exceed the best so far. Others
    fold their window once, from pair to pair, with the distinct pairs seen; work grows in proportion to the text.
    """
    n = F.size(template)
    at = F.filter(F.transform(pairs, lambda g, i: F.when(F.array_contains(template, g), i)), lambda i: i.isNotNull())
    nothing = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("held"), F.lit(None).cast("double").alias("best"))

    def grown(s: Column, g: Column) -> Column:
        own = F.array_contains(template, g)
        held, seen = s["held"] + own.cast("int"), F.array_append(s["seen"], g)
        dice = F.lit(2.0) * held / (F.size(seen) + n)
        new = F.struct(seen.alias("seen"), held.alias("held"), F.when(own, F.greatest(s["best"], dice)).otherwise(s["best"]).alias("best"))
        return F.when(F.array_contains(s["seen"], g), s).otherwise(new)

    def from_start(best: Column, hits: Column, start: Column) -> Column:
        i = start["i"]
        ends = F.filter(F.slice(hits, start["k"] + 1, longest), lambda j: j < i + longest)

        def folded(ends: Column) -> Column:
            d = F.size(F.array_distinct(F.transform(ends, lambda j: pairs[j])))
            window = F.slice(pairs, i + 1, F.element_at(ends, -1) - i + 1)
            found = F.aggregate(window, nothing, grown, lambda s: s["best"])
            return F.when((d >= shared) & (F.lit(2.0) * d / (d + n) > F.coalesce(best, F.lit(0.0))), F.greatest(best, found)).otherwise(best)

        return let(ends, folded)

    starts = lambda hits: F.transform(hits, lambda i, k: F.struct(i.alias("i"), k.alias("k")))
    return let(at, lambda hits: F.aggregate(starts(hits), F.lit(None).cast("double"), lambda best, start: from_start(best, hits, start)))


def _windows(rows: list[tuple[str, list[str]]], lengths: dict[str, int], min_dice: float) -> tuple[Column, Column]:
    """Templates ``t`` that the text ``flat`` may hold and none of its units ``m``, and ``license_id, dice`` of those in its windows."""
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    common = Counter(b for _, bigrams in rows for b in bigrams)
    least_shared = {name: math.ceil(len(bigrams) * low - 1e-9) for name, bigrams in rows}
    keys, without = _keys(rows, least_shared)
    any_of = lambda strings: reduce(Column.__or__, [F.contains("flat", F.lit(x)) for x in strings], F.lit(False))

    def asked(name: str, bigrams: list[str]) -> Column:
        shared, longest = least_shared[name], math.floor(lengths[name] * high + 1e-9)
        held = any_of(_probe(bigrams, shared, common))
        return F.when(held, F.struct(F.lit(name).alias("id"), F.array(*map(F.lit, bigrams)).alias("b"), F.lit(shared).alias("shared"), F.lit(longest).alias("longest")))

    def best(pairs: Column) -> Column:
        return F.transform("t", lambda t: F.struct(t["id"].alias("license_id"), _best_window(pairs, t["b"], t["longest"], t["shared"]).alias("dice")))

    # Few strings tell that a text holds none of the templates.
    maybe = any_of([*keys, *(b for name, bigrams in rows if name in without for b in _probe(bigrams, least_shared[name], common))])
    return (
        F.filter(F.when(maybe, F.array(*[asked(*row) for row in rows])), lambda t: t.isNotNull() & ~F.exists("m", lambda m: m["license_id"] == t["id"])),
        F.when(F.size("t") > 0, F.filter(let(_words(F.col("flat")), lambda w: let(_pairs(w), best)), lambda w: w["dice"] >= min_dice)),
    )


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, min_dice: float = MIN_DICE) -> DataFrame:
    """``doc_id, license_id, dice, n_units``: the best Dice of each licence found, and the number of units that match it.

    ``templates`` is a parameter of the scan (one literal in the plan), so its size is set by the caller and not by the data.
    """
    templates = TEMPLATES if templates is None else templates
    rows = _template_rows(templates)
    low, high = min_dice / (2 - min_dice), (2 - min_dice) / min_dice
    floor, ceiling = low * min(len(b) for _, b in rows), high * max(len(b) for _, b in rows)
    lit = F.array(*[F.struct(F.lit(name).alias("id"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("b")) for name, b in rows])

    def compared(b: Column, t: Column) -> Column:
        shared = F.size(F.array_intersect(b, t["b"]))
        return F.struct(t["id"].alias("license_id"), (F.lit(2.0) * shared / (F.size(b) + t["n"])).alias("dice"))

    def matches(b: Column) -> Column:
        close = F.filter(lit, lambda t: F.size(b).between(F.ceil(t["n"] * low), F.floor(t["n"] * high)))
        return F.filter(F.transform(close, lambda t: compared(b, t)), lambda m: m["dice"] >= min_dice)

    none = F.array().cast("array<struct<license_id:string,dice:double>>")
    # A unit of w words, d of them distinct, has between d - 1 and w - 1 distinct bigrams.
    of_words = lambda w: F.when((F.size(w) - 1 >= floor) & (F.size(F.array_distinct(w)) - 1 <= ceiling), let(_bigrams(w), matches)).otherwise(none)
    of_unit = lambda u: let(_words(u), of_words)
    lines = F.split("x", "\n")
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array(F.translate("x", "\n", " ")))).otherwise(lines)
    found = docs.where("text IS NOT NULL").select("doc_id", normalise(F.col("text")).alias("x"))
    lengths = {name: len(_template_words(text)) - 1 for name, text in templates.items()}
    asked, windows = _windows(rows, lengths, min_dice)
    matched = found.select("doc_id", _flat(F.col("x")).alias("flat"), F.flatten(F.transform(units, of_unit)).alias("m")).withColumn("t", asked)
    hits = matched.select("doc_id", F.explode(F.concat("m", F.coalesce(windows, none))).alias("m"))
    return hits.groupBy("doc_id", "m.license_id").agg(F.round(F.max("m.dice"), 6).alias("dice"), F.count("*").alias("n_units"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence that a document holds, with its best Dice coefficient and the number of matching units."""
    return license_scan(table(spark, sf_dir, "documents"))


def op8_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in TEMPLATES.items())
    gram = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    token = "list_filter(string_split(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda a: a <> '')"
    return f"""
WITH t AS (SELECT id, {gram} AS b FROM (SELECT id, {token.format('lower(x)')} AS w FROM (VALUES {values}) v(id, x))),
x AS (SELECT doc_id, lower(text) AS x FROM documents WHERE text IS NOT NULL),
u AS (
  SELECT doc_id, unnest(string_split(x, chr(10))) AS u FROM x
  UNION ALL SELECT doc_id, x FROM x WHERE contains(x, chr(10))
), g AS (SELECT doc_id, {gram} AS b FROM (SELECT doc_id, {token.format('u')} AS w FROM u)),
m AS (
  SELECT doc_id, id AS license_id, 2.0::DOUBLE * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b)) AS dice
  FROM g JOIN t ON len(g.b) BETWEEN {MIN_DICE / (2 - MIN_DICE)} * len(t.b) - 1e-9 AND {(2 - MIN_DICE) / MIN_DICE} * len(t.b) + 1e-9
)
SELECT doc_id, license_id, round(max(dice), 6) AS dice, count(*) AS n_units FROM m WHERE dice >= {MIN_DICE} GROUP BY ALL
"""
