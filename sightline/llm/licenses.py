"""Licence scan by a positional rare-token index, with DataFrame functions only.

Each template is a notice in words and its mandatory key phrases, which stand around the parts that vary.
Of all words of the templates, the corpus's document frequencies are counted; the index holds, of every key
phrase, its word of highest inverse document frequency with its place. Each of a text's places of such a
word is a posting: it says where the phrase would stand, and the phrase is verified there. A verified phrase
says where the template would begin; a template is found where all of its key phrases agree on that to
within a few words, so that inserted words and names do no harm.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, split_words

#: Phrases and the labels that they give wherever they stand.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices as published by the licences' authors, in words, and the phrases that must stand in them.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("you may not use this file except in compliance with the license", "distributed on an as is basis", "language governing permissions and limitations"),
    ),
    "mit": ("released under the mit license", ("mit license",)),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is "
        "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
        "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
        ("permission is hereby granted free of charge", "merge publish distribute sublicense", "substantial portions of the software", "fitness for a particular purpose and noninfringement"),
    ),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "any person obtaining a copy")),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ("permission to use copy modify", "for any purpose with or without fee is hereby granted", "disclaims all warranties with regard to this software"),
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    "bsd-3-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright "
        "notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain", "redistributions in binary form must reproduce", "endorse or promote products derived from this software"),
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to "
        "use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented",
        ("in no event will the authors be held liable", "alter it and redistribute it freely", "must not be misrepresented"),
    ),
    "unlicense": ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software released into the public domain",)),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your "
        "option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the "
        "gnu general public license for more details",
        ("under the terms of the gnu general public license", "published by the free software foundation", "distributed in the hope that it will be useful"),
    ),
    "lgpl": ("gnu lesser general public license", ("lesser general public license",)),
    "agpl": ("gnu affero general public license", ("affero general public license",)),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc0": ("cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    "creative-commons": ("creative commons attribution license", ("creative commons attribution",)),
}
#: Words by which a template's key phrases may disagree on its beginning: so many, or this part of its length.
DRIFT, DRIFT_PART = 2, 8


def drift(length: int) -> int:
    return max(DRIFT, length // DRIFT_PART)


def _starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    places = F.sequence(F.lit(0), F.size(words) - len(parts))

    def stands(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            found &= F.get(words, i + k) == part
        return found

    return F.when(F.size(words) >= len(parts), F.filter(places, stands)).otherwise(F.expr("cast(array() as array<int>)"))


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))


def _strings(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words))


def find(words: Sequence[str], phrase: Sequence[str]) -> int:
    return next(i for i in range(len(words)) if list(words[i : i + len(phrase)]) == list(phrase))


def key_phrases(templates: Mapping[str, tuple[str, tuple[str, ...]]]) -> list[tuple[str, int, list[str]]]:
    """(template, place in it, words) of every mandatory phrase."""
    return [(label, find(text.split(), key.split()), key.split()) for label, (text, keys) in templates.items() for key in keys]


def scan_licenses(docs: DataFrame, templates: Mapping[str, tuple[str, tuple[str, ...]]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, places (start of every base phrase, with its label), found (label, start and share of each template's words) per row of ``docs``.

    Null and empty texts have no words and nothing found. Rows are told apart by a number of their
    own, so a null or repeated doc_id does no harm. An empty table gives an empty result. Other
    columns are ignored. What reaches the driver is one row for each word of the templates.
    """
    space = Workspace(docs.sparkSession, "licenses")
    keys = key_phrases(templates)
    bank = sorted({w for _, _, phrase in keys for w in phrase})
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), split_words(F.col("text").cast("string")).alias("words"))
    # The rarest word of each phrase: of those that a phrase has, the one in the fewest documents.
    held = split.select(F.array_intersect(F.col("words"), _strings(bank)).alias("own")).select(F.explode("own").alias("word"))
    df = dict(held.groupBy("word").count().collect()) if bank else {}
    rarest = [min(range(len(phrase)), key=lambda i: (df.get(phrase[i], 0), phrase[i], i)) for _, _, phrase in keys]
    anchors = sorted({phrase[at] for (_, _, phrase), at in zip(keys, rarest)} | {p.split()[k] for p, k in zip(BASE_PHRASES, (0, 0, 2))})

    placed = F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    rows = split.withColumn("hits", F.filter(placed, lambda x: x["word"].isin(anchors)))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.size("hits") > 0, F.col("words")).alias("words"), "hits")
    rows = space.table(rows, "rows")
    words = F.col("words")
    # Postings: where each key phrase would stand by its rarest word, kept where it does stand.
    postings = F.create_map(*[x for word in anchors for x in (F.lit(word), F.array(*[F.struct(F.lit(k).alias("key"), F.lit(at).alias("at")) for k, ((_, _, phrase), at) in enumerate(zip(keys, rarest)) if phrase[at] == word] or [F.struct(F.lit(-1).alias("key"), F.lit(0).alias("at"))]))])
    wanted = F.flatten(F.transform("hits", lambda h: F.transform(F.element_at(postings, h["word"]), lambda p: F.struct(p["key"].alias("key"), (h["pos"] - p["at"]).alias("start")))))
    phrases = F.array(*[_strings(phrase) for _, _, phrase in keys]) if keys else F.array(_strings([""]))
    met = rows.where("words is not null").select("row", "words", F.filter(wanted, lambda p: p["key"] >= 0).alias("wanted")).where("size(wanted) > 0")

    def stands(p: Column) -> Column:
        phrase = F.element_at(phrases, p["key"] + 1)
        return (p["start"] >= 0) & (F.slice(words, F.greatest(p["start"] + 1, F.lit(1)), F.size(phrase)) == phrase)

    met = space.table(met.select("row", "words", F.filter("wanted", stands).alias("standing")).where("size(standing) > 0"), "standing")
    found = [_found(label, text.split(), [(k, at) for k, (of, at, _) in enumerate(keys) if of == label]) for label, (text, _) in templates.items()]
    met = met.select("row", F.filter(F.array(*found), lambda f: F.size(f["at"]) > 0).alias("found")).where("size(found) > 0") if found else met.select("row", F.lit(None).alias("found")).limit(0)
    met = space.table(met, "found")
    places = F.concat(*[_labelled(_starts(words, phrase), label) for phrase, label in BASE_PHRASES.items()])
    none = "cast(array() as array<{}>)"
    return rows.join(met, "row", "left").select(
        "doc_id", "n_words",
        F.when(words.isNotNull(), places).otherwise(F.expr(none.format("struct<start:bigint,label:string>"))).alias("places"),
        F.coalesce("found", F.expr(none.format("struct<label:string,at:array<struct<start:bigint,share:double>>>"))).alias("found"),
    )


def _found(label: str, notice: list[str], keys: list[tuple[int, int]]) -> Column:
    """label and at: where the template begins by its first key phrase, if all others agree; with the share of its words that stand there."""
    begins = [F.transform(F.filter("standing", _is(key)), _less(at)) for key, at in keys]
    slack = drift(len(notice))
    kept = begins[0]
    for other in begins[1:]:
        kept = F.filter(kept, _near(other, slack))
    distinct = sorted(set(notice))

    def placed(b: Column) -> Column:
        around = F.slice("words", F.greatest(b, F.lit(0)) + 1, len(notice) + slack)
        return F.struct(b.cast("long").alias("start"), (F.size(F.array_intersect(_strings(distinct), around)) / len(distinct)).alias("share"))

    return F.struct(F.lit(label).alias("label"), F.transform(kept, placed).alias("at"))


def _is(key: int):
    return lambda p: p["key"] == key


def _less(at: int):
    return lambda p: p["start"] - at


def _near(others: Column, slack: int):
    return lambda b: F.exists(others, lambda o: F.abs(o - b) <= slack)


def digest(scanned: DataFrame) -> DataFrame:
    starts, base, own = F.col("places.start"), F.array_distinct("places.label"), F.col("found.label")
    shares = F.flatten(F.transform("found", lambda f: F.transform(f["at"], lambda a: a["share"])))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(shares), F.lit(0.0))).alias("score"),
    )
