"""Licence scan by a positional rare-token index.

Licence templates are passages of licences. Their words, with the positions at
which they stand and their IDF in the corpus, are the index (postings). A file
is looked up, template by template, by those of its words that are rarest: each of their occurrences votes, for every posting of the word, for a relative
position of file and template. A template whose rare words agree on one
relative position is a candidate; it is found if its key phrase stands in the
file. All steps are DataFrame expressions.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, let, written

#: Words of a licence: runs of ASCII letters and digits and of any non-ASCII characters.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Fixed values: (label, key phrase, passage), wording of the public licences and of the notices that name them.
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"
        " sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "apache",
        "apache license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
        " without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl",
        "general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
        " either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty"
        " without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    (
        "lgpl",
        "lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"
        " either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty",
    ),
    (
        "agpl",
        "affero general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"
        " either version 3 of the license or at your option any later version",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code"
        " must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice"
        " this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    (
        "bsd",
        "used to endorse or promote products derived from this software",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        "isc",
        "for any purpose with or without fee is hereby granted",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl",
        "mozilla public license",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ),
    (
        "epl",
        "eclipse public license",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    ),
    (
        "unlicense",
        "unencumbered software released into the public domain",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form"
        " or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    (
        "cc0",
        "waived all copyright and related or neighboring rights",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    ),
    (
        "zlib",
        "to alter it and redistribute it freely",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    (
        "boost",
        "any person or organization obtaining a copy of the software",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software"
        " to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
    ),
    (
        "artistic",
        "some semblance of artistic control",
        "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package",
    ),
    ("ofl", "sil open font license", "this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at"),
    (
        "postgresql",
        "without a written agreement is hereby granted",
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"
        " provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    ),
    ("cc-by", "cc by 4", "licensed under cc by 4 0"),
    ("cc-by", "creative commons attribution 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "cc by nc 4", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa", "cc by nc sa", "licensed under cc by nc sa 4 0"),
]


def _starts(words: Column, phrase: list[str]) -> Column:
    """The places, from 0, where the phrase's words follow each other."""
    here = lambda ws, i: functools.reduce(lambda a, b: a & b, [F.get(ws, i + k) == w for k, w in enumerate(phrase)])
    places = lambda ws: F.filter(F.sequence(F.lit(0), F.greatest(F.size(ws) - 1, F.lit(0))), lambda i: F.coalesce(here(ws, i), F.lit(False)))
    return let(words, places)


def _if_all(known: Column, phrase: list[str], value: Column) -> Column:
    """``value``, worked out only in files that have all words of the phrase."""
    return F.when(functools.reduce(lambda a, b: a & b, [F.array_contains(known, w) for w in dict.fromkeys(phrase)]), value)


def by_idf(df: dict[str, int]) -> list[list[str]]:
    """Each template's words by falling IDF, that is by rising number of files that have them (``df``), ties by the word."""
    return [sorted(set(passage.split()), key=lambda w: (df.get(w, 0), w)) for _, _, passage in TEMPLATES]


def scan(docs: DataFrame, rarest: int = 8, least_votes: int = 3) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A file's words are lower-cased in A-Z. n_base counts the places where a
    base phrase's words follow each other, first_word and last_word are the
    smallest and largest of their starts (else null), base_labels their labels.
    labels adds those of the templates found: of the ``rarest`` words of highest
    IDF (over all files) that file and template share, at least ``least_votes``
    agree on one relative position, and the key phrase stands in the file. IDF
    orders words, and none is too common, so a licence that every file has is
    found in every file. Each template is looked up on its own, where all words
    of its key phrase stand, so a file may hold any number of licences. score is the largest share of a found template's looked-up words
    that agree, 1 for a base phrase. Null or empty text: no words, no labels, score 0. Equal rows are
    scanned alike, rows of one doc_id with other texts on their own.
    """
    text = F.coalesce("text", F.lit(""))
    # lower() may also change non-ASCII letters; no phrase has one, and none of them becomes a phrase's letter.
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    array = lambda ws: F.array(*[F.lit(w) for w in ws])
    vocabulary = sorted({w for _, _, passage in TEMPLATES for w in passage.split()})
    # The vocabulary is fixed, so its counts are a bounded table.
    known = docs.select(F.explode(F.array_append(F.array_intersect(words, array(vocabulary)), F.lit(""))).alias("w"))
    df = {r["w"]: r["n"] for r in known.groupBy("w").agg(F.count("*").alias("n")).collect()}
    index = by_idf(df)
    wanted = [max(1, min(least_votes, len(ws))) for ws in index]
    files = docs.select("doc_id", F.xxhash64(text).alias("h"), words.alias("ws"))
    files = files.withColumn("known", F.array_intersect("ws", array(sorted({*vocabulary, *(w for phrase in BASE for w in phrase.split())}))))
    nothing = F.expr("cast(array() as array<int>)")
    for phrase, label in BASE.items():
        files = files.withColumn(f"at_{label}", F.coalesce(_if_all(F.col("known"), phrase.split(), _starts(F.col("ws"), phrase.split())), nothing))
    # The words to look up, by template; occurrences are listed in files that have enough of one template's.
    none = F.expr("cast(array() as array<string>)")
    chosen = lambda known: F.array(*[F.coalesce(_if_all(known, key.split(), F.slice(F.array_intersect(array(ws), known), 1, rarest)), none) for ws, (_, key, _) in zip(index, TEMPLATES, strict=True)])
    enough = lambda rare: functools.reduce(lambda a, b: a | b, [F.size(rare[t]) >= m for t, m in enumerate(wanted)])
    rare = let(F.when(F.size("known") >= min(wanted), chosen(F.col("known"))), lambda r: F.when(enough(r), r))
    spots = lambda r: F.filter(F.transform("ws", lambda w, i: F.struct(w.alias("w"), i.alias("p"))), lambda o: F.array_contains(r, o["w"]))
    looked_up = let(rare, lambda r: F.when(r.isNotNull(), F.struct(r.alias("rare"), let(F.array_distinct(F.flatten(r)), spots).alias("occ"))))
    starts = [f"at_{label}" for label in BASE.values()]
    files = written(files.select("doc_id", "h", F.size("ws").cast("long").alias("n_words"), *starts, looked_up.alias("look")), "licence-words")
    postings = [(w, t, p) for t, (_, _, passage) in enumerate(TEMPLATES) for p, w in enumerate(passage.split())]
    table = docs.sparkSession.createDataFrame(postings, "w string, t int, tp int")
    hits = files.where("look is not null").select("doc_id", "h", F.col("look.rare").alias("rare"), F.inline("look.occ")).join(F.broadcast(table), "w")
    hits = hits.withColumn("rare", F.element_at("rare", F.col("t") + 1)).where(F.array_contains("rare", F.col("w")))
    votes = hits.groupBy("doc_id", "h", "t", (F.col("p") - F.col("tp")).alias("rel")).agg(F.count_distinct("w").alias("votes"), F.first(F.size("rare")).alias("n"))
    of = lambda values: F.element_at(array(values), F.col("t") + 1)
    candidates = votes.where(F.col("votes") >= of(wanted)).groupBy("doc_id", "h", "t").agg(F.max(F.col("votes") / F.col("n")).alias("share"))
    candidates = written(candidates.withColumnsRenamed({"doc_id": "__d", "h": "__h"}), "candidates")
    # The key phrases are looked for in the candidates' texts only.
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h"))
    asked = docs.select("doc_id", F.xxhash64(text).alias("h"), "text").join(few(candidates.groupBy("__d", "__h").agg(F.collect_set("t").alias("ts"))), same)
    asked = asked.select("__d", "__h", "ts", words.alias("ws"))
    stands = [F.when(F.array_contains("ts", t) & (F.size(_starts(F.col("ws"), key.split())) > 0), F.lit(t)) for t, (_, key, _) in enumerate(TEMPLATES)]
    found = asked.select("__d", "__h", F.explode(F.array_compact(F.array(*stands))).alias("t")).distinct().withColumnsRenamed({"__d": "doc_id", "__h": "h", "t": "__t"})
    found = candidates.join(found, same & (F.col("t") == F.col("__t"))).groupBy("__d", "__h").agg(F.collect_set(of([label for label, _, _ in TEMPLATES])).alias("more"), F.max("share").alias("share"))
    files = files.drop("look").join(few(found), same, "left")
    all_starts = F.concat(*starts)
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{x}") > 0, F.lit(x)) for x in BASE.values()]))
    return files.select(
        "doc_id",
        "n_words",
        F.size(all_starts).cast("long").alias("n_base"),
        F.array_min(all_starts).cast("long").alias("first_word"),
        F.array_max(all_starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.coalesce("more", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
