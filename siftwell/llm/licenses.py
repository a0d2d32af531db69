"""Licence scans with a positional index of rare words.

One pass over the texts keeps, per document, its number of words, which licence
words it has and, only where a licence could stand at all, its words. Document
frequencies of the licence words (a fixed vocabulary) come from all documents.
Then, per document and template whose key phrase has all its words in it:

1. with at most ``m`` of the template's words out of place, any ``m + 2`` of its
   places have two words that stand; the ``m + 2`` places with the words of
   highest IDF are looked up. Every occurrence p of such a word, which the
   template has at q, proposes the start ``p - q``;
2. starts that two places propose are compared word by word, so no start is
   lost, whatever else the document holds;
3. a start counts if ``share`` of the template's words stand in place and so
   does every word of its key phrase.

Labels are those of matched templates and of the base phrases. The score is the
largest share of words in place, at least 0.5 if a base phrase is found, else 0.
Only built-in functions are used, and no row leaves its partition but for the
counts.

Null text counts as empty. Rows are scanned one by one: repeated rows give
equal results, an empty table an empty one. Equal frequencies are ordered by
word. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from siftwell.llm.shared import shared_folder, table, text_or_empty, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a template's words that must stand in place, in percent.
SHARE = 80


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str
    key_phrase: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key(self) -> tuple[int, int]:
        """First word of the key phrase in the template, and one past its last."""
        words, key = self.words, self.key_phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return at, at + len(key)

    def need(self, share: int) -> int:
        return -(-share * len(self.words) // 100)


#: Phrases that name a licence, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Sentences of public licence notices and the phrase that each must have.
TEMPLATES = (
    Template("apache-2.0", "apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("apache-file", "apache-2.0", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    Template("bsd", "bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("cc-by-4.0", "cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc-by-nc-4.0", "cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc0", "cc0-1.0", "has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    Template("gpl-3.0", "gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-later", "gpl-or-later", "either version 2 of the license or at your option any later version", "at your option any later version"),
    Template("isc", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("mit-notice", "mit", "released under the mit license", "the mit license"),
    Template("mpl-2.0", "mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("unlicense", "unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    # Whole texts, without titles and names of holders.
    Template("mit-text", "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
        "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
        "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do "
        "so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the software the software is provided as is without warranty of any kind express or implied including "
        "but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the "
        "authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or "
        "otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "to deal in the software without restriction"),
    Template("bsd-2-clause-text", "bsd-2-clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the "
        "following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
        "following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the "
        "copyright holders and contributors as is and any express or implied warranties including but not limited to the implied "
        "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or "
        "contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited "
        "to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any "
        "theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the "
        "use of this software even if advised of the possibility of such damage",
        "with the distribution this software is provided by"),
    Template("bsd-3-clause-text", "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission this software is provided by the copyright holders and contributors "
        "as is and any express or implied warranties",
        "endorse or promote products derived from this software"),
    Template("isc-text", "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
        "that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author "
        "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no "
        "event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting "
        "from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
        "connection with the use or performance of this software",
        "this permission notice appear in all copies"),
    Template("0bsd-text", "0bsd",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software "
        "is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or "
        "any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious "
        "action arising out of or in connection with the use or performance of this software",
        "is hereby granted the software is provided as is"),
    Template("zlib-text", "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
        "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
        "commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this "
        "software must not be misrepresented you must not claim that you wrote the original software if you use this software in a "
        "product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must "
        "be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or "
        "altered from any source distribution",
        "the origin of this software must not be misrepresented"),
    Template("unlicense-text", "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by "
        "any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain we make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all "
        "present and future rights to this software under copyright law",
        "dedicate any and all copyright interest in the software to the public domain"),
    Template("boost-text", "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to "
        "prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to "
        "the following the copyright notices in the software and this entire statement including the above license grant this "
        "restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative "
        "works of the software unless such copies or derivative works are solely in the form of machine executable object code generated "
        "by a source language processor",
        "machine executable object code generated by a source language processor"),
    Template("apache-notice", "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
        "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in "
        "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
        "either express or implied see the license for the specific language governing permissions and limitations under the license",
        "for the specific language governing permissions and limitations under the license"),
    Template("gpl-notice", "gpl-or-later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version this program is "
        "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or "
        "fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu "
        "general public license along with this program",
        "at your option any later version this program is distributed"),
    Template("mpl-notice", "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
        "this file you can obtain one at http mozilla org mpl 2 0",
        "if a copy of the mpl was not distributed with this file"),
)


def strings(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def vocabulary(templates, base) -> list[str]:
    return sorted({w for t in templates for w in t.words} | {w for p in base for w in p.split()})


def scanned(docs: DataFrame, templates, base, id_column: str, text_column: str) -> DataFrame:
    """``id, n_words, present, words``: ``words`` is null where nothing can match."""
    lowered = F.translate(text_or_empty(text_column), UPPER, LOWER)
    split = docs.select(
        F.col(id_column).alias("id"), F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words")
    )
    known = split.select("*", F.array_intersect("words", strings(vocabulary(templates, base))).alias("present"))
    possible = F.lit(False)
    for phrase in sorted({*base, *(t.key_phrase for t in templates)}):
        possible = possible | _has_all(phrase.split())
    return known.select(
        "id",
        F.size("words").cast("bigint").alias("n_words"),
        "present",
        F.when(possible, F.col("words")).alias("words"),
    )


def _has_all(words: list[str]) -> Column:
    return F.size(F.array_except(strings(sorted(set(words))), "present")) == 0


def _at(i: Column) -> Column:
    """The word at i, null outside the document."""
    return F.get("words", i)


def _places(phrase: list[str]) -> Column:
    """Starts of the phrase in the document."""

    def here(i: Column) -> Column:
        out = F.lit(True)
        for j, w in enumerate(phrase):
            out = out & (_at(i + j) == w)
        return F.coalesce(out, F.lit(False))

    none = F.array().cast("array<int>")
    found = F.filter(F.sequence(F.lit(0), F.size("words") - 1), here)
    return F.when(F.col("words").isNotNull() & _has_all(phrase), found).otherwise(none)


def looked_up(t: Template, frequency: dict[str, int], share: int) -> tuple[list[tuple[str, int]], int]:
    """The places to look up, rarest words first, and how many of them a start must have."""
    misses = len(t.words) - t.need(share)
    by_idf = sorted(range(len(t.words)), key=lambda q: (frequency.get(t.words[q], 0), t.words[q], q))
    chosen = by_idf[: misses + 2]
    return [(t.words[q], q) for q in chosen], len(chosen) - misses


def _starts(t: Template, frequency: dict[str, int], share: int) -> Column:
    """Starts of the template that enough of the looked up places propose."""
    places, agree = looked_up(t, frequency, share)
    rare = strings(sorted({w for w, _ in places}))
    postings = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(q).alias("q")) for w, q in places))

    def proposals(i: Column) -> Column:
        return F.transform(F.filter(postings, lambda x: x["w"] == _at(i)), lambda x: i - x["q"])

    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(rare, _at(i)))
    starts = F.sort_array(F.flatten(F.transform(at, proposals)))
    return F.when(F.col("words").isNotNull() & _has_all(t.key_phrase.split()), starts if agree > 1 else F.array_distinct(starts))


def _best(t: Template, starts: Column, frequency: dict[str, int], share: int) -> Column:
    """Largest share of words in place over the starts that count; null without one."""
    words = strings(t.words)
    agreed = starts
    if looked_up(t, frequency, share)[1] > 1:
        twice = F.filter(starts, lambda x, i: (i > 0) & (starts[F.greatest(i - 1, F.lit(0))] == x))
        agreed = F.array_distinct(twice)

    def hits(s: Column, low: int, high: int) -> Column:
        # A start may lie before the document; there is no word at a negative place.
        stands = lambda j: (s + j >= 0) & F.coalesce(_at(s + j) == F.get(words, j), F.lit(False))
        return F.size(F.filter(F.sequence(F.lit(low), F.lit(high - 1)), stands))

    low, high = t.key
    scored = F.transform(
        agreed,
        lambda s: F.when(hits(s, low, high) == high - low, hits(s, 0, len(t.words))).otherwise(F.lit(0)),
    )
    most = F.array_max(scored)
    return F.when(most >= t.need(share), most / F.lit(float(len(t.words))))


def scan_licenses(
    docs: DataFrame,
    templates: tuple[Template, ...] = TEMPLATES,
    base: dict[str, str] = BASE,
    share: int = SHARE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score, templates``."""
    folder = shared_folder(docs.sparkSession)
    known = written(scanned(docs, templates, base, id_column, text_column), folder, "scanned")
    counts = known.select(F.explode("present").alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counts.collect()}  # at most the vocabulary

    columns = {f"places_{i}": _places(p.split()) for i, p in enumerate(base)}
    for t in templates:
        columns[f"starts_{t.name}"] = _starts(t, frequency, share)
    found = known.select("*", *(c.alias(k) for k, c in columns.items()))
    judged = found.select(
        "id",
        "n_words",
        F.array_sort(F.flatten(F.array(*(F.col(f"places_{i}") for i in range(len(base)))))).alias("places"),
        F.array_compact(
            F.array(*(F.when(F.size(f"places_{i}") > 0, F.lit(v)) for i, v in enumerate(base.values())))
        ).alias("base_found"),
        F.array_compact(
            F.array(
                *(
                    F.struct(F.lit(t.name).alias("name"), F.lit(t.label).alias("label"), best.alias("score"))
                    for t in templates
                    for best in [_best(t, F.col(f"`starts_{t.name}`"), frequency, share)]
                )
            )
        ).alias("tried"),
    )
    matched = judged.select("*", F.filter("tried", lambda x: x["score"].isNotNull()).alias("hit"))
    labels = F.array_union("base_found", F.transform("hit", lambda x: x["label"]))
    best = F.coalesce(F.array_max(F.transform("hit", lambda x: x["score"])), F.lit(0.0))
    floor = F.when(F.size("places") > 0, 0.5).otherwise(0.0)
    return matched.select(
        F.col("id").alias(id_column),
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        _joined(F.col("base_found")).alias("base_labels"),
        _joined(labels).alias("labels"),
        F.greatest(best, floor).alias("score"),
        _joined(F.transform("hit", lambda x: x["name"])).alias("templates"),
    )


def _joined(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), ",")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("templates")


def _rows(rows) -> str:
    return ",\n    ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


OP2_SQL = rf"""
with tp(t, q, word) as (values
    {_rows((t.name, q, w) for t in TEMPLATES for q, w in enumerate(t.words))}
), tl(t, label, n, need, low, high) as (values
    {_rows((t.name, t.label, len(t.words), t.need(SHARE), *t.key) for t in TEMPLATES)}
), bp(phrase, label) as (values
    {_rows(BASE.items())}
), w as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as ws
  from documents
), k as (
  select r, i - 1 as p, ws[i] as word from (select r, ws, unnest(range(1, len(ws) + 1)) as i from w)
), hits as (
  select r, t, p - q as s, count(*) as hits, count(*) filter (where q >= low and q < high) as key_hits
  from k join tp using (word) join tl using (t) group by r, t, s
), best as (
  select r, label, max(hits / n::double) as score from hits join tl using (t)
  where hits >= need and key_hits = high - low group by r, label
), base as (
  select r, i - 1 as p, label
  from (select r, ws, unnest(range(1, len(ws) + 1)) as i from w) as x, bp
  where array_to_string(ws[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase
), b as (
  select r, count(*) as n_base, min(p) as first_word, max(p) as last_word,
    string_agg(distinct label, ',' order by label) as base_labels
  from base group by r
), m as (
  select r, string_agg(distinct label, ',' order by label) as labels from
    (select r, label from base union select r, label from best) group by r
), s as (
  select r, max(score) as score from best group by r
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base,
  first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  greatest(coalesce(s.score, 0), case when n_base > 0 then 0.5 else 0 end)::double as score
from w left join b using (r) left join m using (r) left join s using (r)
"""
