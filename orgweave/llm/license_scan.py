"""Licence scans with a positional index of rare words (DataFrame functions only).

Templates are paragraphs of licence texts and notices, cut into words that are weighted by
inverse document frequency over all documents. The index holds each template's highest-IDF
words, as many as have more than 1 - MIN_SHARE of its weight, with their places: a match, which
has to agree on MIN_SHARE of the weight, cannot lack all of them. They are looked up for every
word of a file. A word's place in the file minus its place in the template is a relative
position; at each relative position of a template all of its words are intersected with the
file, SLACK words of drift allowed for inserted or dropped words. What agrees on MIN_SHARE of
the weight becomes a label if the template's mandatory key phrases all stand near it as
consecutive words. No number of words, places or notices is limited, so notices in one file do
not displace each other. The score is the share of the template's IDF that agrees.

Every text is cut into words once. What later steps need is written: the counts, which of the
templates' words it has, and the words of files that hold a word of a key phrase.

The base count is separate and exact: all places of three fixed phrases.

Defined cases: null and empty texts have no words and no labels; repeated rows are scanned
each by itself; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweave.llm.common import let, materialise, read

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# fixed values: the base phrases and their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# fixed values: label, paragraph or notice in words, mandatory key phrases
TEMPLATES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("permission is hereby granted", "free of charge", "without restriction")),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included", "substantial portions of the software")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted", "free of charge", "without restriction")),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses")),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("unless required by applicable law", "as is basis")),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("free software", "general public license")),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("in the hope that it will be useful", "gnu general public license")),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", ("you should have received a copy", "gnu general public license")),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1 or later", ("lesser general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("free software", "lesser general public license")),
    ("agpl", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("free software", "affero general public license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form", "this list of conditions")),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products", "prior written permission")),
    ("bsd", "use of this source code is governed by a bsd style license", ("bsd style license",)),
    ("bsd", "released under the bsd 3 clause license", ("bsd", "clause license")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify", "with or without fee")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ("must not be misrepresented",)),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("anyone is free to copy modify publish",)),
    ("wtfpl", "do what the fuck you want to public license", ("what the fuck you want to public license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc0", "released under the creative commons cc0 1 0 universal public domain dedication", ("cc0",)),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability", ("without warranty of any kind", "noninfringement", "authors or copyright holders")),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("copyright holders and contributors", "are disclaimed")),
    ("apache", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ("apache license", "terms and conditions for use reproduction and distribution")),
    ("mpl", "mozilla public license version 2 0", ("mozilla public license",)),
    ("epl", "eclipse public license v 2 0", ("eclipse public license",)),
    ("eupl", "licensed under the european union public licence eupl version 1 2", ("european union public licence",)),
    ("eupl", "licensed under the eupl", ("licensed under the eupl",)),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ("common development and distribution license",)),
    ("cddl", "common development and distribution license cddl version 1 0", ("common development and distribution license",)),
    ("artistic", "the artistic license 2 0", ("artistic license",)),
)
#: Identifiers of the software package data exchange, as words, and their labels.
SPDX = {
    "mit": "mit", "apache 2 0": "apache", "gpl 2 0": "gpl", "gpl 3 0": "gpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "mpl 2 0": "mpl", "epl 2 0": "epl",
    "isc": "isc", "zlib": "zlib", "bsl 1 0": "boost", "unlicense": "unlicense", "wtfpl": "wtfpl", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "cc by nd 4 0": "cc-by-nd", "cc0 1 0": "cc0", "eupl 1 2": "eupl",
    "cddl 1 0": "cddl", "artistic 2 0": "artistic",
}
TEMPLATES += tuple((label, f"spdx license identifier {name}", (f"spdx license identifier {name}",)) for name, label in SPDX.items())
SLACK = 2
#: Share of a template's IDF that has to agree on a relative position.
MIN_SHARE = 0.5
_VOCABULARY = sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})
#: A word of each template's first key phrase; a file without any of them holds no template.
_TELLING = sorted({max(phrases[0].split(), key=lambda w: (len(w), w)) for _, _, phrases in TEMPLATES})
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _places(words: Column, phrase: list[str], first: Column) -> Column:
    """Those of the places `first` of the phrase's first word where the whole phrase stands."""

    def stands(i: Column) -> Column:
        every = F.lit(True)
        for k, w in enumerate(phrase[1:], 1):
            every = every & (F.get(words, i + k) == w)
        return F.coalesce(every, F.lit(False))

    return F.filter(first, stands)


def _base(words: Column) -> Column:
    """All places of the base phrases and the labels found."""

    def of_phrase(phrase: str) -> Column:
        parts = phrase.split()
        at = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
        return F.when(F.array_contains(words, parts[0]), _places(words, parts, at)).otherwise(F.array().cast("array<int>"))

    found = F.struct(*[of_phrase(p).alias(label) for p, label in PHRASES.items()])
    return let(
        found,
        lambda f: F.struct(
            F.concat(*[f[x] for x in PHRASES.values()]).alias("places"),
            F.array_compact(F.array(*[F.when(F.size(f[x]) > 0, F.lit(x)) for x in PHRASES.values()])).alias("labels"),
        ),
    )


def _given(value, kind: str) -> Column:
    """A value as data of the plan: one text, read once when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _templates(idf: dict[str, float]) -> Column:
    """The templates as one array: label, number of words, key phrases, words with their places and weights, whole weight."""
    rows = []
    for label, notice, phrases in TEMPLATES:
        parts = notice.split()
        words = [{"w": w, "at": [i for i, x in enumerate(parts) if x == w], "idf": idf[w]} for w in sorted(set(parts))]
        rows.append({"label": label, "n": len(parts), "phrases": [p.split() for p in phrases], "words": words, "weight": sum(idf[w] for w in set(parts))})
    return _given(rows, "array<struct<label:string,n:int,phrases:array<array<string>>,words:array<struct<w:string,at:array<int>,idf:double>>,weight:double>>")


def index(idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
    """Word: (template, place) of the templates' highest-IDF words, as many as no match can lack."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, notice, _) in enumerate(TEMPLATES):
        parts = notice.split()
        weight, held = sum(idf[w] for w in set(parts)), 0.0
        for w in sorted(set(parts), key=lambda w: (-idf[w], w)):
            if held > (1 - MIN_SHARE) * weight:
                break
            held += idf[w]
            out.setdefault(w, []).extend((t, i) for i, x in enumerate(parts) if x == w)
    return out


def _matches(words: Column, idf: dict[str, float]) -> Column:
    """(label, place, score) of every template that stands in the words."""
    entries = index(idf)
    keys = F.array(*map(F.lit, entries))
    posted = _given({w: [{"t": t, "o": i} for t, i in places] for w, places in entries.items()}, "map<string,array<struct<t:int,o:int>>>")
    none = F.array().cast("array<struct<t:int,d:int>>")
    relative = lambda w, i: F.transform(posted[w], lambda p: F.struct(p["t"].alias("t"), (i - p["o"]).alias("d")))
    found = F.array_distinct(F.flatten(F.transform(words, lambda w, i: F.when(F.array_contains(keys, w), relative(w, i)).otherwise(none))))
    at = lambda i, w: F.coalesce((i >= 0) & (F.get(words, i) == w), F.lit(False))
    drift = F.sequence(F.lit(-SLACK), F.lit(SLACK))

    def judged(candidate: Column, template: Column) -> Column:
        d = candidate["d"]
        stands = lambda x: F.exists(x["at"], lambda o: F.exists(drift, lambda k: at(d + o + k, x["w"])))
        agreed = F.aggregate(template["words"], F.lit(0.0), lambda total, x: total + F.when(stands(x), x["idf"]).otherwise(0.0))
        return F.struct(template["label"].alias("label"), F.greatest(d, F.lit(0)).alias("place"), (agreed / template["weight"]).alias("score"), template.alias("of"))

    def verified(m: Column) -> Column:
        low, high = F.greatest(m["place"] - SLACK, F.lit(0)), m["place"] + m["of"]["n"] + SLACK
        whole = lambda phrase, i: F.forall(F.transform(phrase, lambda w, k: at(i + k, w)), lambda x: x)
        return (m["score"] >= MIN_SHARE) & F.forall(m["of"]["phrases"], lambda phrase: F.exists(F.sequence(low, high), lambda i: whole(phrase, i)))

    kept = lambda templates: F.filter(F.transform(found, lambda c: judged(c, F.get(templates, c["t"]))), verified)
    return F.transform(let(_templates(idf), kept), lambda m: F.struct(m["label"].alias("label"), m["place"].alias("place"), m["score"].alias("score")))


def license_scan(docs: DataFrame, *keep: Column | str, text_col: str = "text") -> DataFrame:
    """The columns `keep`, n_words, n_base, first_word, last_word, base_labels, labels, score and matches of every row.

    matches: each template found, with its label, place and score.
    """
    vocabulary, telling = (F.array(*map(F.lit, x)) for x in (_VOCABULARY, _TELLING))
    read_once = let(
        _words(F.col(text_col)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _base(w).alias("base"),
            F.array_intersect(w, vocabulary).alias("known"),
            F.when(F.arrays_overlap(w, telling), w).alias("words"),
        ),
    )
    names = docs.select(*keep).columns
    texts = materialise(docs.select(F.struct(*keep).alias("row"), read_once.alias("found")), "license-words")
    # the null word counts the documents; the vocabulary is fixed and small
    counts = {r.w: r["count"] for r in texts.select(F.explode(F.array_append("found.known", F.lit(None).cast("string"))).alias("w")).groupBy("w").count().collect()}
    idf = {w: math.log((counts.get(None, 0) + 1) / (counts.get(w, 0) + 1)) + 1e-6 for w in _VOCABULARY}
    none = F.array().cast("array<struct<label:string,place:int,score:double>>")
    words = F.col("found.words")
    scanned = texts.withColumn("matches", F.when(words.isNotNull(), _matches(words, idf)).otherwise(none))
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    best = F.array_max(F.transform("matches", lambda m: m["score"]))
    places = F.col("found.base.places")
    return scanned.select(
        *[F.col("row")[c].alias(c) for c in names],
        F.col("found.n_words").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        joined(F.col("found.base.labels")).alias("base_labels"),
        joined(F.concat("found.base.labels", F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size(places) > 0, 1.0).otherwise(0.0))).alias("score"),
        "matches",
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"), "doc_id").drop("matches")
