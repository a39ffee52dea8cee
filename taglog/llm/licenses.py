"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Units of a text are its lines, its blank-line-separated paragraphs and the whole text. A unit is normalised (lower case,
every run of characters other than a-z and 0-9 is one space) and compared to the templates whose number of distinct word
bigrams lies within the bounds that the threshold sets: ``dice >= t`` needs ``min / max >= t / (2 - t)``. Only DataFrame
functions are used, every row on its own: nothing is shuffled, joined or broadcast beyond the fixed template table.

A notice with neighbours in its unit is found by windows over the words of the whole text. A window is a run of words
with the sizes that the threshold allows a template; the best one starts and ends at bigrams of its template, so only
such windows are compared, and only in texts that hold enough of a template's bigrams. Before anything else, a text is
passed over if it holds none of a few telling words, or none of some telling bigrams: they are chosen so that every window
or unit that reaches the threshold holds one, as it shares so many bigrams with its template that the rest are too few. Each start keeps its best window;
of windows that overlap, the one with the highest coefficient stays (a notice is not also its near namesake). A licence
that windows find and no unit gives is one more match.

Defined results: null or empty text matches nothing (n_matches 0, best_dice 0.0, licenses empty); repeated rows give
repeated rows; equal units of one text count once, and so does a licence that only windows find; a unit of one word has no bigrams and matches nothing; other columns
are not read.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices and short licence texts as published.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Licences and headers beyond those of the SQL, which knows units and ``TEMPLATES`` only.
_FREE = "This {0} is free software{3} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation{4} either version {2} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
ADDED: dict[str, list[str]] = {
    "AGPL-3.0": [_FREE.format("program", "Affero ", "3", ":", ","), "This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."],
    "GPL-2.0": [_FREE.format("program", "", "2", ";", ";")],
    "LGPL-2.1": [_FREE.format("library", "Lesser ", "2.1", ";", ";"), "This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": [_FREE.format("library", "Lesser ", "3", ":", ","), "This work is licensed under the GNU Lesser General Public License, version 3."],
}
ALL = {name: TEMPLATES.get(name, []) + ADDED.get(name, []) for name in sorted(TEMPLATES | ADDED)}


def template_bigrams(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(licence, distinct word bigrams) of every template."""
    out = []
    for name, texts in templates.items():
        for text in texts:
            w = re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")
            out.append((name, list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))))
    return out


def telling_words(table: list[tuple[str, list[str]]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which a text must hold one to match any template.

    A match shares at least ratio * n of a template's n bigrams, so it holds one of any n - ceil(ratio * n) + 1 of them.
    Words are taken greedily, long ones first among equals, until that many bigrams of each template hold a taken word.
    """
    ratio, taken = threshold / (2 - threshold), []
    left = [(len(g) - math.ceil(len(g) * ratio - 1e-9) + 1, set(g)) for _, g in table]
    while open_ := [(n, g) for n, g in left if n > 0]:
        gain: dict[str, float] = {}
        for n, g in open_:
            own: dict[str, int] = {}
            for x in g:
                for w in set(x.split(" ")):
                    own[w] = own.get(w, 0) + 1
            for w, k in own.items():
                gain[w] = gain.get(w, 0.0) + min(k, n) / n
        best = max(gain, key=lambda w: (gain[w] * min(len(w), 8) ** 2, w))
        taken.append(best)
        left = [(n - len(gone), g - gone) for n, g in left for gone in [{x for x in g if best in x.split(" ")}]]
    return taken


def telling_bigrams(table: list[tuple[str, list[str]]], threshold: float = THRESHOLD) -> list[str]:
    """Bigrams of which a text must hold one to match any template: of each template its longest, by the same count."""
    ratio = threshold / (2 - threshold)
    return sorted({x for _, g in table for x in sorted(g, key=lambda x: (-len(x), x))[: len(g) - math.ceil(len(g) * ratio - 1e-9) + 1]})


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def _sequence(words: Column) -> Column:
    return F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_sequence(words))


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(text: Column, table: list[tuple[str, list[str]]], threshold: float) -> Column:
    """(dice, name) of the best windows of a text that do not overlap a better one."""
    ratio = threshold / (2 - threshold)
    # a window with dice >= threshold shares at least ratio * n of a template's n bigrams
    known = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, g)).alias("grams"), F.lit(len(g)).alias("n"), F.lit(math.ceil(len(g) * ratio - 1e-9)).alias("need"), F.lit(math.floor(len(g) / ratio + 1e-9)).alias("most")) for name, g in table))
    every = F.array(*map(F.lit, dict.fromkeys(x for _, g in table for x in g)))
    fewest = min(math.ceil(len(g) * ratio - 1e-9) for _, g in table)
    none = F.array().cast("array<struct<dice:double,name:string,a:int,z:int>>")

    def best_at(grams: Column, t: Column, at: Column, k: Column) -> Column:
        a = F.get(at, k)
        ends = F.filter(F.slice(at, k + t["need"], t["most"] - t["need"] + 1), lambda z: z - a < t["most"])

        def scored(z: Column) -> Column:
            return _bound(F.array_distinct(F.slice(grams, a + 1, z - a + 1)), lambda w: F.struct((F.lit(2.0) * F.size(F.array_intersect(w, t["grams"])) / (F.size(w) + t["n"])).alias("dice"), t["name"].alias("name"), a.alias("a"), z.alias("z")))

        return F.array_max(F.filter(F.transform(ends, scored), lambda s: s["dice"] >= threshold))

    def of_template(grams: Column, hits: Column, t: Column) -> Column:
        at = F.transform(F.filter(hits, lambda h: F.array_contains(t["grams"], h["gram"])), lambda h: h["at"])
        starts = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - t["need"]), lambda k: best_at(grams, t, p, k))
        return _bound(at, lambda p: F.when(F.size(p) >= t["need"], F.filter(starts(p), lambda s: s.isNotNull())).otherwise(none))

    def of_text(grams: Column, held: Column) -> Column:
        hits = F.filter(F.transform(grams, lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda h: F.array_contains(held, h["gram"]))
        near = F.filter(known, lambda t: F.size(F.array_intersect(held, t["grams"])) >= t["need"])
        found = _bound(hits, lambda h: F.flatten(F.transform(near, lambda t: of_template(grams, h, t))))
        return F.aggregate(
            F.reverse(F.array_sort(found)),
            none,
            lambda kept, s: F.when(F.exists(kept, lambda o: (o["a"] <= s["z"]) & (s["a"] <= o["z"])), kept).otherwise(F.concat(kept, F.array(s))),
        )

    return _bound(_words(text), lambda w: _bound(_sequence(w), lambda g: _bound(F.array_intersect(g, every), lambda held: F.when(F.size(held) >= fewest, of_text(g, held)).otherwise(none))))


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = ALL, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_matches, best_dice, licenses): matching units, the best coefficient and the matched licences, sorted."""
    table = template_bigrams(templates)
    ratio = threshold / (2 - threshold)
    low, high = min(len(g) for _, g in table) * ratio, max(len(g) for _, g in table) / ratio
    known = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(len(grams)).alias("n")) for name, grams in table))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # each step is a column that the next one refers to, so that it is computed once, and only where the step before says so
    told = functools.reduce(lambda a, w: a | F.contains("_lic_low", F.lit(w)), telling_words(table, threshold), F.lit(False))
    paired = functools.reduce(lambda a, x: a | F.contains("_lic_spaced", F.lit(f" {x} ")), telling_bigrams(table, threshold), F.lit(False))
    spaced = F.concat(F.lit(" "), F.regexp_replace("_lic_low", "[^a-z0-9]+", " "), F.lit(" "))
    hopeful = docs.select(F.col(id_col), text.alias("_lic_text"), F.lower(text).alias("_lic_low"))
    hopeful = hopeful.select(id_col, "_lic_text", "_lic_low", told.alias("_lic_told"))
    hopeful = hopeful.select(id_col, "_lic_text", F.when(F.col("_lic_told"), spaced).alias("_lic_spaced"))
    hopeful = hopeful.select(id_col, "_lic_text", F.coalesce(paired, F.lit(False)).alias("_lic_hope"))
    text = F.col("_lic_text")
    units = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n"), F.array(text)))
    words = F.transform(units, _words)
    # a unit of n words has at most n - 1 distinct bigrams
    words = F.filter(words, lambda w: (F.size(w) > 1) & (F.size(w) - 1 >= low))
    grams = F.filter(F.transform(words, _bigrams), lambda g: F.size(g).between(low, high))
    # equal sets count once: as sorted strings, which are compared by hash
    grams = F.transform(F.array_distinct(F.transform(grams, lambda g: F.array_join(F.array_sort(g), ","))), lambda g: F.split(g, ","))

    def matches(g: Column) -> Column:
        near = F.filter(known, lambda t: (F.least(F.size(g), t["n"]) >= F.lit(ratio) * F.greatest(F.size(g), t["n"])))
        scored = F.transform(near, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])).alias("dice"), t["name"].alias("name")))
        return F.filter(scored, lambda s: s["dice"] >= threshold)

    in_units = F.filter(F.transform(grams, lambda g: F.array_max(matches(g))), lambda m: m.isNotNull())
    u_none, w_none = F.array().cast("array<struct<dice:double,name:string>>"), F.array().cast("array<struct<dice:double,name:string,a:int,z:int>>")
    hope = F.col("_lic_hope")
    found = hopeful.select(id_col, F.when(hope, in_units).otherwise(u_none).alias("u"), F.when(hope, _windows(text, table, threshold)).otherwise(w_none).alias("w"))
    # windows come best first, so a licence's first one is its best
    names = F.array_distinct(F.transform("w", lambda s: s["name"]))
    more = F.transform(F.array_except(names, F.transform("u", lambda s: s["name"])), lambda n: F.struct(F.array_max(F.transform(F.filter("w", lambda s: s["name"] == n), lambda s: s["dice"])).alias("dice"), n.alias("name")))
    found = found.select(id_col, F.concat("u", more).alias("m"))
    return found.select(
        id_col,
        F.size("m").cast("long").alias("n_matches"),
        F.round(F.coalesce(F.array_max(F.transform("m", lambda x: x["dice"])), F.lit(0.0)), 6).alias("best_dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda x: x["name"]))), ",").alias("licenses"),
    )


def oracle(templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """SQL for ``scan_licenses`` over ``documents``."""
    table = template_bigrams(templates)
    ratio = threshold / (2 - threshold)
    values = ", ".join("('{}', [{}], {})".format(n, ", ".join(f"'{x}'" for x in g), len(g)) for n, g in table)
    return f"""
with t(name, grams, n) as (values {values}),
u as (select doc_id, unnest(list_distinct(list_concat(string_split(coalesce(text, ''), chr(10)), regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n'), [coalesce(text, '')]))) as unit from documents),
w as (select doc_id, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') as w from u),
g as (select distinct doc_id, list_sort(list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])) as g from w where len(w) > 1),
s as (select doc_id, g, name, 2.0::double * len(list_intersect(g, grams)) / (len(g) + n) as dice from g, t where least(len(g), n) >= {ratio!r} * greatest(len(g), n)),
b as (select doc_id, g, max(dice) as dice, arg_max(name, (dice, name)) as name from s where dice >= {threshold} group by doc_id, g),
f as (select doc_id, count(*) as n_matches, round(max(dice), 6) as best_dice, string_agg(distinct name, ',' order by name) as licenses from b group by doc_id)
select d.doc_id, coalesce(n_matches, 0) as n_matches, coalesce(best_dice, 0.0::double) as best_dice, coalesce(licenses, '') as licenses from documents d left join f on d.doc_id = f.doc_id
"""
