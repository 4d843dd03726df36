"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

A block is any run of consecutive words, up to the window of a template: its
number of words over ``threshold``. So a match contains the template, and the
template fills the match: words scattered over a text are none, and line feeds
do not matter. A template of n distinct tokens is met by ``threshold`` of them,
but by at least ``LEAST`` (short notices need all).

Tokens of the templates are ordered by their frequency in the whole corpus, the
rarest first. A block with ``need`` of a template's n tokens holds one of its
n - need + 1 rarest: those are the template's prefix, and the join key. Around
each place of a prefix token, a length filter (enough words) and a positional
one (enough of the template's tokens within reach of the place) come before the
windows are counted.

Only templates are broadcast; their number and size are a parameter. Text is
never shuffled: texts without a prefix token leave the scan with their base
columns alone, others with the words around those tokens.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import LOWER, UPPER, documents, let, row_key, text_of

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases that the base counts, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and texts of common licenses, with labels.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
        use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
        the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
        ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "lgpl": "licensed under the GNU Lesser General Public License",
    "agpl-3.0": "licensed under the GNU Affero General Public License version 3",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc-by-long": "licensed under a Creative Commons Attribution 4.0 International License",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose""",
    "all-rights-reserved": "All rights reserved.",
}
THRESHOLD, LEAST = 0.8, 10
#: ASCII characters that are in no word, but for the line feed.
_GAPS = "".join(chr(i) for i in range(128) if not chr(i).isalnum() and chr(i) != "\n")


def _list(text: str) -> list[str]:
    import re

    return re.findall(WORDS, text.translate({i: i + 32 for i in range(65, 91)}))


def measures(text: str, threshold: float = THRESHOLD) -> tuple[list[str], int, int]:
    """Distinct tokens of a template, how many are needed, and the words of its window."""
    words = _list(text)
    tokens = sorted(set(words))
    return tokens, max(math.ceil(threshold * len(tokens) - 1e-9), min(len(tokens), LEAST)), math.ceil(len(words) / threshold - 1e-9)


def spaced(t: Column) -> Column:
    """Lower-case A-Z, with blanks for what is in no word; line feeds stay."""
    return F.translate(t, UPPER + _GAPS, LOWER + " " * len(_GAPS))


def _words(t: Column) -> Column:
    """Words of a spaced text."""
    return F.array_remove(F.split(F.replace(t, F.lit("\n"), F.lit(" ")), " ", -1), "")


def _holds(t: Column, words: list[str]) -> Column:
    """Whether a spaced text with blanks around it has all of the words."""
    return reduce(Column.__and__, [F.contains(t, F.lit(f" {w} ")) for w in words])


def template_index(docs: DataFrame, templates: dict[str, str], threshold: float, text_col: str) -> list[tuple]:
    """A row per template and prefix token: (label, n, need, window, tokens rarest first, token)."""
    own = {k: measures(v, threshold) for k, v in sorted(templates.items())}
    vocabulary = sorted({t for ts, _, _ in own.values() for t in ts})
    words = docs.select(F.explode(_words(spaced(text_of(text_col)))).alias("token"))
    counted = words.where(F.col("token").isin(vocabulary)).groupBy("token").agg(F.count("*").alias("c")).collect()  # the templates' own words
    c, out = {r["token"]: r["c"] for r in counted}, []
    for label, (tokens, need, window) in own.items():
        tokens = sorted(tokens, key=lambda t: (c.get(t, 0), t))
        out += [(label, len(tokens), need, window, tokens, t) for t in tokens[: len(tokens) - need + 1]]
    return out


def _places(words: Column) -> Column:
    """Starts of all phrases: array<struct<at, label>>."""
    def of(ws: list[str], label: str) -> Column:
        def starts(i: Column) -> Column:
            same = [F.coalesce(F.get(words, i + j) == w, F.lit(False)) for j, w in enumerate(ws)]
            return reduce(Column.__and__, same)

        hit = F.filter(F.sequence(F.lit(0), F.size(words) - 1), starts)
        return F.transform(hit, lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label")))

    return F.concat(*[of(phrase.split(), label) for phrase, label in PHRASES.items()])


def _most_distinct(reach: Column, label: Column, sets: dict[str, list[str]], first: Column, at: Column, window: Column) -> Column:
    """The most distinct tokens of a template in any window that starts at ``first`` to ``at``; ``reach``: the words from ``first`` on.

    A token at p, met before at q, is new to the windows that start behind q and
    hold p: one interval of starts a place. A sweep over the intervals' ends
    counts all windows at once, where counting each anew is quadratic.
    """
    own = None
    for name, tokens in sets.items():  # membership by a hash set of the template that is meant
        own = (lambda x, n=name: F.when(label == n, x.isin(sets[n]))) if own is None else (lambda x, n=name, rest=own: rest(x).when(label == n, x.isin(sets[n])))
    if own is None:
        return F.lit(0)
    places = F.filter(F.transform(reach, lambda x, i: F.struct(x.alias("t"), (first + i).alias("p"))), lambda y: own(y["t"]))

    def ends(k: Column, placed: Column) -> Column:
        here, before = F.get(placed, k), F.get(placed, k - 1)
        last = F.when(before["t"] == here["t"], before["p"]).otherwise(-1)
        low, high = F.greatest(last + 1, here["p"] - window + 1, first), F.least(here["p"], at)
        step = lambda p, d: F.struct(p.cast("int").alias("p"), F.lit(d).alias("d"))
        return F.when(low <= high, F.array(step(low, 1), step(high + 1, -1))).otherwise(F.array().cast("array<struct<p:int,d:int>>"))

    def swept(placed: Column) -> Column:
        events = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), F.size(placed) - 1), lambda k: ends(k, placed))))
        start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
        add = lambda s, e: F.struct((s["now"] + e["d"]).alias("now"), F.greatest(s["most"], s["now"] + e["d"]).alias("most"))
        return F.when(F.size(placed) > 0, F.aggregate(events, start, add, lambda s: s["most"])).otherwise(0)

    return let(F.array_sort(places), swept)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """A row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest share of a template's tokens in a block that meets it, 0
    if none does. A null or empty text has no words; repeated and null ids
    are rows of their own; an empty table gives an empty one.
    """
    rows = template_index(docs, templates, threshold, text_col)
    index = docs.sparkSession.createDataFrame(rows, "label string, n int, need int, window int, tokens array<string>, token string")
    prefixes, widest = sorted({r[5] for r in rows}), max([r[3] for r in rows], default=1)
    src = docs.select(row_key().alias("_row"), F.col(id_col).alias("_id"), spaced(text_of(text_col)).alias("_t"))
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    flat = F.concat(F.lit(" "), F.replace("_t", F.lit("\n"), F.lit(" ")), F.lit(" "))
    hint = reduce(Column.__or__, [_holds(flat, phrase.split()) for phrase in PHRASES])
    no_hits = F.array().cast("array<struct<token:string,at:int,near:array<string>>>")

    def hits(w: Column) -> Column:  # places of prefix tokens, with the words around; ``at``: the place among those
        found = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["x"].isin(prefixes))
        first = lambda i: F.greatest(i - widest + 1, F.lit(0))
        return F.transform(
            found,
            lambda y: F.struct(y["x"].alias("token"), (y["i"] - first(y["i"])).alias("at"), F.slice(w, first(y["i"]) + 1, y["i"] - first(y["i"]) + widest).alias("near")),
        )

    words = let(
        _words(F.col("_t")),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n"), F.when(hint, _places(w)).otherwise(none).alias("places"),
            F.when(F.arrays_overlap(w, F.array(*[F.lit(p) for p in prefixes])), hits(w)).otherwise(no_hits).alias("hits"),
        ),
    )
    base = src.select("_row", "_id", words.alias("_w"))
    base = base.select("_row", "_id", F.col("_w.n").alias("n_words"), F.col("_w.places").alias("_p"), F.posexplode_outer("_w.hits").alias("_k", "_h"))
    lead = F.coalesce(F.col("_k"), F.lit(0)) == 0  # a document's base places stay with its first hit
    base = base.select("_row", "_id", "n_words", F.when(lead, F.col("_p")).alias("_p"), "_h.token", "_h.at", "_h.near")
    pairs = base.join(F.broadcast(index), "token", "left")  # the templates' prefix tokens: a few hundred rows
    # within reach of the place: windows that hold it start at most window - 1 words before
    first = F.greatest(F.col("at") - F.col("window") + 1, F.lit(0))
    reach = F.slice("near", first + 1, F.col("at") - first + F.col("window"))
    able = (F.size(reach) >= F.col("need")) & (F.size(F.array_intersect(reach, F.col("tokens"))) >= F.col("need"))
    sets = {label: measures(text, threshold)[0] for label, text in sorted(templates.items())}
    most = let(reach, lambda ws: _most_distinct(ws, F.col("label"), sets, first, F.col("at"), F.col("window")))
    best = F.when(F.when(F.col("label").isNotNull(), able).otherwise(F.lit(False)), most)
    pairs = pairs.select("_row", "_id", "n_words", "_p", "label", "n", F.when(best >= F.col("need"), best).alias("hit"))
    out = pairs.groupBy("_row").agg(
        F.first("_id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.coalesce(F.first("_p", ignorenulls=True), none).alias("_p"),
        F.collect_set(F.when(F.col("hit").isNotNull(), F.col("label"))).alias("_l"),
        F.coalesce(F.max(F.col("hit") / F.col("n")), F.lit(0.0)).alias("score"),
    )
    at = F.transform("_p", lambda x: x["at"])
    names = F.array_distinct(F.transform("_p", lambda x: x["label"]))
    return out.select(
        "id", "n_words", F.size("_p").cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"), F.array_join(F.array_sort(names), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names, F.col("_l"))), ",").alias("labels"), "score",
    )


def op5_license_scan(spark, sf_dir):
    return scan(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def _oracle() -> str:
    pat = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    own = {k: measures(v) for k, v in TEMPLATES.items()}
    values = ", ".join(f"('{k}', [{', '.join(repr(t) for t in ts)}], {need}, {window})" for k, (ts, need, window) in own.items())
    hits = "\nUNION ALL\n".join(
        f"SELECT rid, i - 1 AS p, '{label}' AS label FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE t LIKE '%{ws.split()[-1]}%') WHERE "
        + " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(ws.split()))
        for ws, label in PHRASES.items()
    )
    return rf"""
WITH d0 AS (SELECT doc_id, {low.format("coalesce(text, '')")} AS t, row_number() OVER () AS rid FROM documents),
d AS (SELECT *, regexp_extract_all(t, '{pat}') AS w FROM d0),
tpl(label, toks, need, size) AS (VALUES {values}),
b AS (SELECT rid, w, label, toks, need, size FROM (SELECT rid, w, list_distinct(w) AS ws FROM d), tpl WHERE len(list_intersect(ws, toks)) >= need),
s AS (SELECT *, unnest(range(1, greatest(1, len(w) - size + 1) + 1)) AS i FROM b),
c AS (SELECT rid, label, max(len(list_intersect(w[i:i + size - 1], toks))) AS best, any_value(need) AS need, any_value(len(toks)) AS n FROM s GROUP BY rid, label),
m AS (SELECT rid, list(DISTINCT label) AS ls, max(best::DOUBLE / n) AS score FROM c WHERE best >= need GROUP BY rid),
h AS ({hits}),
hb AS (SELECT rid, count(*) AS n, min(p) AS f, max(p) AS l, list(DISTINCT label) AS ls FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hb.n, 0)::BIGINT AS n_base, hb.f::BIGINT AS first_word, hb.l::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(hb.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(hb.ls, []), coalesce(m.ls, [])))), ','), '') AS labels,
  coalesce(m.score, 0.0) AS score
FROM d LEFT JOIN hb USING (rid) LEFT JOIN m USING (rid)
"""


OP5_SQL = _oracle()
