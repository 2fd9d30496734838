"""License notices in texts, by diagonal voting of word k-grams.

Templates are short license phrases, read by word pairs, and whole license
texts, read by runs of four words. Every rolling word k-gram of every text that
can hold a template is joined with the k-grams of the templates; a hit at word p of the text and
word q of the template votes for the diagonal p - q. Diagonals next to each
other (a word was put in or left out) merge in overlapping bands of bounded width;
merged spans with enough of the template's k-grams are verified by aligning the
template's words with the span's in order. The templates are a bounded list, so
their k-grams are broadcast. A text can only hold a template if it has one of a few
words without which too many of the template's k-grams would be missing
(``anchors``); this loses nothing and is one search in place of all k-grams. Only
texts with spans are looked at again.
DataFrame operations only.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import BROADCAST_ROWS, stored

#: Phrases whose words must stand in a row, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices, found also with a few words changed.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "isc license": "isc",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "released into the public domain": "public-domain",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "you may not use this file except in compliance with the license": "apache-2.0",
}
#: License texts without their lines of names and years, by label.
LICENSES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
        to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
        OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
        AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
#: Words that are in too many texts to tell them apart.
COMMON = frozenset("a all an and any are as at be by for in is it no not of on or other that the this to use with you".split())
#: Words are runs of ASCII letters and digits and of characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Templates in all, at most; their k-grams are broadcast.
MAX_TEMPLATES = 10_000
#: Words in a gram: of phrases and notices, and of license texts.
K, LONG_K = 2, 4
#: Anchors that a text is searched for, at most; with more, all texts are cut into k-grams.
MAX_ANCHORS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else that matters between ASCII words.

    ``lower`` is much faster than ``translate``. It also changes letters beyond
    ASCII, which stay beyond ASCII and so keep the words, but for two letters
    whose lower case is ASCII: texts with these take the slow way.
    """
    return F.when(text.rlike("[Kİ]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _bodies(phrases: dict[str, str], notices: dict[str, str], licenses: dict[str, str]) -> list[tuple]:
    """(template, words, label, base, k) of all templates."""
    found = re.compile(WORD)
    rows = [(p.split(), label, True, K) for p, label in phrases.items()] + [(p.split(), label, False, K) for p, label in notices.items()]
    rows += [(found.findall(text.lower()), label, False, LONG_K) for label, text in licenses.items()]
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"{len(rows)} templates; the bound is {MAX_TEMPLATES}")
    if any(len(body) < k for body, _, _, k in rows):
        raise ValueError(f"a template needs {K} words or more, a license {LONG_K}")
    return [(i, *row) for i, row in enumerate(rows)]


def anchors(bodies: list[tuple], least: float) -> list[str]:
    """Words of which a text needs one to hold any of the templates.

    Without all anchors of a template, fewer of its k-grams than a span needs can
    be in a text. Words are taken in turn, each time that which settles most
    k-grams still to be settled, long ones before short ones and common ones last.
    """
    open_ = []
    for _, body, _, base, k in bodies:
        grams = [frozenset(body[i : i + k]) for i in range(len(body) - k + 1)]
        # a hit needs this many different k-grams; one more than the rest must be out of reach
        needed = len(grams) if base else min(n for n in range(len(grams) + 1) if n / len(grams) >= least)
        open_.append((len(grams) - needed + 1, grams))
    chosen: list[str] = []
    while open_:
        gain: Counter = Counter()
        for need, grams in open_:
            touched = Counter(w for g in grams for w in g)
            for w, n in touched.items():
                gain[w] += min(n, need)
        best = max(gain, key=lambda w: (w not in COMMON, gain[w] * len(w), w))
        chosen.append(best)
        left = [(need - sum(best in g for g in grams), [g for g in grams if best not in g]) for need, grams in open_]
        open_ = [x for x in left if x[0] > 0]
    return chosen


def _grams(array: str, k: int) -> Column:
    """Places and hashes (p, gram) of all runs of ``k`` words in an array; none in a shorter one."""
    parts = ", ".join(f"{array}[i + {j}]" for j in range(k))
    none = "cast(array() as array<struct<p:int,gram:bigint>>)"
    return F.expr(f"case when size({array}) < {k} then {none} else transform(sequence(0, size({array}) - {k}), i -> named_struct('p', i, 'gram', xxhash64({parts}))) end")


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, licenses: dict[str, str] = LICENSES, least: float = 0.8, slack: int = 2) -> DataFrame:
    """Spans that the votes suggest: ``(doc, version, template, label, base, first, last, votes, share)``.

    For a phrase every diagonal with all k-grams; for a notice the bands of
    diagonals that have ``least`` of its k-grams. Each diagonal opens a band with
    those up to ``slack`` behind it, so bands overlap and a stray hit before a
    notice cannot cut it; a k-gram votes once in a band. ``share`` is votes over
    k-grams; the text is not yet compared.
    """
    bodies = _bodies(phrases, notices, licenses)
    templates = docs.sparkSession.createDataFrame(bodies, "template int, body array<string>, label string, base boolean, k int").withColumn("grams", F.size("body") - F.col("k") + 1)
    grams = reduce(DataFrame.union, [templates.where(F.col("k") == k).select("template", F.inline(_grams("body", k)).alias("q", "gram")) for k in (K, LONG_K)])
    text = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    if len(need := anchors(bodies, least)) <= MAX_ANCHORS:
        text = text.where(ascii_lower(F.col("text")).rlike(f"(?<![a-z0-9])(?:{'|'.join(map(re.escape, need))})(?![a-z0-9])"))
    # places and hashes of both lengths come from one pass over the words
    rolling = text.select("doc", "version", words(F.col("text")).alias("ws")).select("doc", "version", F.inline(F.concat(_grams("ws", K), _grams("ws", LONG_K))))
    hits = rolling.join(F.broadcast(grams), "gram").select("doc", "version", "template", "q", "p").distinct()
    votes = hits.groupBy("doc", "version", "template", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("qs"), F.min("p").alias("low"), F.max("p").alias("high"))
    votes = votes.join(F.broadcast(templates.drop("body")), "template")
    # both branches need the same columns of the votes, so that the texts are read once
    exact = votes.where("base and size(qs) = grams").select("doc", "version", "template", "label", "base", F.col("low").alias("first"), (F.col("high") + F.col("k") - 1).alias("last"), F.size("qs").cast("long").alias("votes"), F.lit(1.0).alias("share"))
    band = Window.partitionBy("doc", "version", "template").orderBy("diagonal").rangeBetween(0, slack)
    seen = F.size(F.array_distinct(F.flatten(F.collect_list("qs").over(band))))
    merged = votes.where("not base").select(
        "doc", "version", "template", "label", "base", F.min("low").over(band).alias("first"), (F.max("high").over(band) + F.col("k") - 1).alias("last"),
        seen.cast("long").alias("votes"), (seen / F.col("grams")).alias("share"),
    )
    merged = merged.where(F.col("share") >= least)
    return exact.unionByName(merged)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, licenses: dict[str, str] = LICENSES, least: float = 0.8, slack: int = 2) -> DataFrame:
    """One row per document with its license labels.

    Returns ``(doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, spans)``. ``n_base`` counts all places where a phrase's words
    stand in a row, ``first_word`` and ``last_word`` are the smallest and largest
    start of these (words from 0), ``labels`` also has those of the notices
    and of whole license texts.
    ``score`` is the largest share of a template's k-grams in a verified span,
    ``spans`` lists the verified spans as (label, first, last, share); a notice with
    words put in may be there by more than one band.

    A span is verified when the words of a phrase stand there one by one, or
    when at least ``least`` of a notice's words are found in the span in order,
    each at most ``slack`` words further on than expected. Null texts count as
    empty: no words, no labels, score 0. Rows that repeat id and text give equal
    rows; other columns are ignored.
    """
    spans = license_spans(docs, id_col, text_col, phrases, notices, licenses, least, slack)
    spans = spans.groupBy("doc", "version").agg(F.collect_list(F.struct("first", "last", "base", "label", "template", "share")).alias("found"))
    spans = stored(spans.select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), "found"))
    held = spans.agg(F.sum(F.size("found"))).first()[0] or 0
    spans = F.broadcast(spans) if held <= BROADCAST_ROWS else spans
    text = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))
    both = text.join(spans, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("version") == F.col("__version")), "left")
    ws = F.when(F.col("found").isNotNull(), words(F.col("text")))
    n_words = F.when(F.col("ws").isNotNull(), F.size("ws")).otherwise(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_CASE)))
    none = F.array().cast("array<struct<first:int,last:int,base:boolean,label:string,template:int,share:double>>")
    bodies = F.create_map(*[F.lit(x) for i, body, *_ in _bodies(phrases, notices, licenses) for x in (i, " ".join(body))])
    both = both.select("doc_id", F.col("text"), ws.alias("ws"), F.coalesce("found", none).alias("found"), bodies.alias("bodies"))
    body = "split(bodies[s.template], ' ')"
    here = "slice(ws, s.first + 1, s.last - s.first + 1)"
    # walk along the span with the notice's words: a word found within reach moves the place behind it
    at = f"array_position(slice({here}, acc.p + 1, {slack + 2}), w)"
    walk = f"aggregate({body}, named_struct('p', 0, 'n', 0), (acc, w) -> if({at} > 0, named_struct('p', acc.p + cast({at} as int), 'n', acc.n + 1), acc), acc -> acc.n)"
    stands = f"case when s.base then {here} = {body} else {walk} >= {least} * size({body}) end"
    both = both.withColumn("held", F.when(F.size("found") > 0, F.expr(f"filter(found, s -> {stands})")).otherwise(F.col("found")))
    base = F.expr("filter(held, s -> s.base)")
    starts = F.transform(base, lambda s: s["first"])
    label = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return both.select(
        "doc_id",
        n_words.cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        label(base).alias("base_labels"),
        label(F.col("held")).alias("labels"),
        F.coalesce(F.array_max(F.transform("held", lambda s: s["share"])), F.lit(0.0)).alias("score"),
        F.array_sort(F.array_distinct(F.transform("held", lambda s: F.struct(s["label"].alias("label"), s["first"].cast("long").alias("first"), s["last"].cast("long").alias("last"), s["share"].alias("share"))))).alias("spans"),
    )
