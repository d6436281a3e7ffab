"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates. DataFrame operations only.

Words are runs of digits, letters a-z and any characters past ASCII, A-Z taken as a-z; comment signs, rules and the like only
separate them. For a template of n words a block is a line and the n - 1 words after it, on as many lines as they take. So a
template that begins anywhere in a line is found however its lines are wrapped. It is found where a block holds at least
``threshold`` percent of its distinct words.

The join is exact. Template words are put in one global order, rarest in the corpus's texts first (ties by word). A template of
n words of which t are needed shares a word among its first n - t + 1 with any block that meets the threshold (prefix filter),
and a text or block with fewer than t of them can't meet it (length filter). From the first shared word on at most as many can
follow as the template has left (positional filter). Texts are filtered whole, then blocks; what passes is verified on full
sets. Only words of templates are ordered and compared, as others never count towards containment.

Texts are not shuffled: the scan is a map, after one aggregation of template words for their order; what a text's blocks take is
proportional to the text. Null and empty texts have no words and no labels. Rows that repeat, and rows with null or repeated
doc_ids, are scanned each by itself. Of several places with one phrase the smallest and the largest count. Very long texts are
scanned whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License texts and notices in wide use, and their labels.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "mit-notice": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "rights-reserved": "All rights reserved. No part of this publication may be reproduced or distributed without the prior written permission of the publisher",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "apache-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
}
THRESHOLD = 80

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SEPARATORS_IN_LINES = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """A blank before each word and nothing else; empty without words."""
    inner = F.trim(F.regexp_replace(text, _SEPARATORS, " "))
    return F.when(inner == "", F.lit("")).otherwise(F.concat(F.lit(" "), inner))


def count_blanks(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def base_columns(phrases: Mapping[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and found (the labels of phrases that stand in the text), from the columns spaced and n_words."""
    # Most texts have none of the phrases: one search decides.
    any_phrase = "(?i) (" + "|".join(phrases) + ")(?= |$)"
    phrased = F.when(F.col("spaced").rlike(any_phrase), F.translate("spaced", _UPPER, _LOWER))
    counts, firsts, lasts, found = [], [], [], []
    for phrase, label in phrases.items():
        n = len(phrase.split())
        overlapping = any(phrase.split()[k:] == phrase.split()[: n - k] for k in range(1, n))
        if overlapping:
            raise ValueError(f"{phrase}: a phrase that can overlap itself")
        pieces = F.split("phrased", f" {phrase}(?= |$)")
        some = F.size(pieces) > 1
        counts.append(F.when(some, F.size(pieces) - 1).otherwise(0))
        firsts.append(F.when(some, count_blanks(F.element_at(pieces, 1))))
        lasts.append(F.when(some, F.col("n_words") - count_blanks(F.element_at(pieces, -1)) - n))
        found.append(F.when(some, F.lit(label)))
    nothing = F.lit(None).cast("long")
    return {
        "phrased": phrased, "n_base": F.coalesce(sum(counts[1:], counts[0]), F.lit(0)).cast("long"),
        "first_word": F.least(*firsts, nothing), "last_word": F.greatest(*lasts, nothing), "found": F.array_compact(F.array(*found)),
    }


def words_in_order(text: str) -> list[str]:
    return [x.translate(str.maketrans(_UPPER, _LOWER)) for x in re.split(_SEPARATORS, text) if x]


def template_words(templates: Mapping[str, str]) -> dict[str, list[str]]:
    return {k: sorted(set(words_in_order(v))) for k, v in templates.items()}


def _known(vocabulary: list[str]) -> Column:
    """The vocabulary's words that stand in the column spaced (letters past ASCII lower-cased too, so some that don't quite)."""
    return F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), F.split(F.lower("spaced"), " "))


def word_order(spaced_texts: DataFrame, vocabulary: list[str]) -> list[str]:
    """Template words, those in the fewest texts first. At most as many rows come to the driver as templates have words."""
    counted = spaced_texts.select(F.explode(_known(vocabulary)).alias("word")).groupBy("word").count().collect()
    often = {r["word"]: r["count"] for r in counted}
    return sorted(vocabulary, key=lambda w: (often.get(w, 0), w))


def _lines(text: Column) -> Column:
    """(words, starts): a text's words, and at which of them a line with words begins."""
    marked = F.replace(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _SEPARATORS_IN_LINES, " "), F.lit("\n"), F.lit(" \n "))
    tokens = F.filter(F.split(marked, " "), lambda x: x != "")

    def of(t: Column) -> Column:
        breaks = F.array_compact(F.transform(t, lambda x, i: F.when(x == "\n", i)))
        starts = F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(breaks, lambda at, k: at - k)))
        return F.struct(F.filter(t, lambda x: x != "\n").alias("words"), starts.alias("starts"))

    return F.get(F.transform(F.array(tokens), of), 0)


def _share(order: dict[str, int], own: list[str], n: int, threshold: int) -> Column:
    """The highest share of a template's distinct words in a block of the column lines, null if none reaches the threshold; own: those words, rarest first; n: its words."""
    needed = -(-len(own) * threshold // 100)
    own = sorted(own, key=order.__getitem__)
    every, prefix = F.array(*[F.lit(w) for w in own]), F.array(*[F.lit(w) for w in own[: len(own) - needed + 1]])
    words, starts = F.col("lines.words"), F.col("lines.starts")

    def block(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), F.size(words))
        return F.slice(words, start + 1, F.greatest(end - start + (n - 1), F.lit(0)))

    def common(held: Column) -> Column:
        """Prefix and positional filter, then the full sets."""
        return F.when(F.arrays_overlap(held, prefix), F.size(F.array_intersect(every, held))).otherwise(0)

    best = F.array_max(F.transform(starts, lambda start, i: F.get(F.transform(F.array(block(start, i)), common), 0)))
    return F.when(best >= needed, best / len(own))


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels (the phrases' and the templates'), score (1.0 with a phrase, else the best template's share, 0.0 without)."""
    text = shared.text_of()
    rows = docs.select("doc_id", text.alias("text"), spaced(text).alias("spaced"))
    sets = template_words(templates)
    order = {w: i for i, w in enumerate(word_order(rows, sorted({w for s in sets.values() for w in s})))}
    rows = rows.withColumn("n_words", count_blanks(F.col("spaced"))).withColumn("known", _known(list(order)))
    for name, column in base_columns(phrases).items():
        rows = rows.withColumn(name, column)
    may = []
    for own in sets.values():
        needed = -(-len(own) * threshold // 100)
        ranked = sorted(own, key=order.__getitem__)
        words = lambda some: F.array(*[F.lit(w) for w in some])
        # Length and prefix filter on the whole text.
        may.append((F.size("known") >= needed) & F.arrays_overlap("known", words(ranked[: len(own) - needed + 1])) & (F.size(F.array_intersect("known", words(own))) >= needed))
    rows = rows.withColumn("may", F.array(*may))
    rows = rows.withColumn("lines", F.when(F.array_contains("may", True), _lines(F.col("text"))))
    shares = [F.when(F.get("may", F.lit(k)), _share(order, own, len(words_in_order(templates[name])), threshold)) for k, (name, own) in enumerate(sets.items())]
    rows = rows.withColumn("shares", F.when(F.col("lines").isNotNull(), F.array(*shares)))
    named = F.array(*[F.lit(name) for name in sets])
    rows = rows.withColumn("templates", F.coalesce(F.array_compact(F.zip_with(named, "shares", lambda name, x: F.when(x.isNotNull(), name))), F.array().cast("array<string>")))
    base_labels = F.array_sort(F.array_distinct("found"))
    labels = F.array_sort(F.array_distinct(F.concat("found", "templates")))
    score = F.when(F.size("found") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("shares"), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.cast("double").alias("score"))
