"""Licence scan with a positional index of rare words. DataFrame functions only.

The index holds the notices below: the words of each, their inverse document
frequency among the notices, and for the rare words every (notice, position).
A file's rare words are looked up; each posting proposes that the notice starts
at (place in the file - position in the notice), so words that belong together
propose the same start. A start is accepted if the notice's key phrase stands
there word by word and the weight of all its words found in place reaches
``MIN_COVER``.

The plain phrases (``PHRASES``) are reported wherever their words stand one after
another. The index is a constant, so nothing is shuffled: one scan splits the
texts that hold a rare word beside its neighbour in a key phrase, which no
accepted start lacks, and the rest is arithmetic on that row.

Edge cases: null and empty texts have no words, no places and score 0; repeated
notices count once as a label, each place of a phrase counts; a file may hold
many notices; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored.
"""

import math
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.plans.materialize import cut

#: Plain phrases and their labels (fixed values of the task).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label, notice, key phrase
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-attribution", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("mit-notice", "released under the mit license", "mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "you may not use this file except in compliance with the license"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "free software foundation either version 3 of the license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "free software foundation either version 2 of the license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "terms of the gnu lesser general public license as published"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "terms of the gnu affero general public license as published"),
    ("gpl-3.0", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble the gnu general public license is a free copyleft license for software and other kinds of works", "free copyleft license for software and other kinds of works"),
    ("mit-text", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "without warranty of any kind express or implied"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software", "software and accompanying documentation covered by this license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain by waiving all"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("wtfpl", "do what the fuck you want to public license everyone is permitted to copy and distribute verbatim or modified copies of this license document", "do what the fuck you want to public license"),
    ("artistic-2.0", "you may distribute verbatim copies of the source form of the standard version of this package in any medium without restriction either gratis or for a distributor fee", "verbatim copies of the source form of the standard version of this package"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", "unauthorized copying of this file via any medium is strictly prohibited"),
]

MIN_COVER = 0.7
RARE_IN = 6

#: A word in a text that is not lower-cased yet.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Index:
    """Weights, postings and key phrases of a list of notices."""

    def __init__(self, notices=NOTICES, rare_in: int = RARE_IN):
        self.labels = [x[0] for x in notices]
        self.words = [x[1].split() for x in notices]
        keys = [x[2].split() for x in notices]
        held = Counter(w for x in self.words for w in set(x))
        self.idf = {w: math.log((1 + len(notices)) / n) for w, n in held.items()}
        #: start and length of each key phrase in its notice
        self.keys = []
        for words, key in zip(self.words, keys, strict=True):
            at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
            self.keys.append((at, len(key)))
        self.postings: dict[str, list[tuple[int, int]]] = {}
        #: neighbours of which every key phrase and plain phrase holds one
        self.pairs = {tuple(p.split()[:2]) for p in PHRASES}
        #: words of which every key phrase and plain phrase holds one
        self.cores = {max(p, key=len) for p in [*keys, *(p.split() for p in PHRASES)]}
        for t, words in enumerate(self.words):
            # the rarest word of the key phrase, and every rarer word held by few notices
            at, n = self.keys[t]
            best = max(range(at, at + n), key=lambda q: (self.idf[words[q]], -q))
            first = best if best + 1 < at + n else best - 1
            self.pairs.add((words[first], words[first + 1]))
            for q, w in enumerate(words):
                if q == best or (held[w] <= rare_in and self.idf[w] > self.idf[words[best]] + 1e-9):
                    self.postings.setdefault(w, []).append((t, q))


def _strings(words):
    return F.array(*[F.lit(w) for w in words])


def _phrase_places(w):
    """(start, label) of every place of a plain phrase in the array w."""

    def at(x, i):
        found = None
        for phrase, label in PHRASES.items():
            first, *rest = phrase.split()
            here = x == first
            for k, word in enumerate(rest, 1):
                here = here & (F.get(w, i + k) == word)
            hit = F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))
            found = F.when(here, hit) if found is None else found.when(here, hit)
        return found

    return F.filter(F.transform(w, at), lambda s: s.isNotNull())


def _notice_places(w, index: Index, min_cover: float):
    """(label, cover) of every accepted start of a notice in the array w."""
    rare = list(index.postings)
    lists = F.create_map(
        *[x for k in rare for x in (F.lit(k), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(q).alias("q")) for t, q in index.postings[k]]))]
    )
    words = F.array(*[_strings(x) for x in index.words])
    weight = F.array(*[F.array(*[F.lit(index.idf[v] / sum(index.idf[u] for u in x)) for v in x]) for x in index.words])
    keys = F.array(*[_strings(x[a : a + n]) for x, (a, n) in zip(index.words, index.keys, strict=True)])
    begin = F.array(*[F.lit(a) for a, _ in index.keys])
    labels = _strings(index.labels)
    hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].isin(rare))
    # a start is a notice and a place, packed into one number: numbers are made distinct by hash, structs by comparing all
    longest, many = max(map(len, index.words)), len(index.words)
    packed = F.transform(hits, lambda s: F.transform(F.element_at(lists, s["x"]), lambda p: (s["i"] - p["q"] + longest).cast("long") * many + p["t"]))
    starts = F.transform(F.array_distinct(F.flatten(packed)), lambda z: F.struct((z % many).cast("int").alias("t"), (F.floor(z / many) - longest).cast("int").alias("o")))

    def keyed(s):
        # word by word: a slice of the array would copy all of it for every start
        a = s["o"] + F.get(begin, s["t"])
        return (a >= 0) & F.forall(F.transform(F.get(keys, s["t"]), lambda x, j: F.coalesce(F.get(w, a + j) == x, F.lit(False))), lambda same: same)

    def cover(s):
        return F.aggregate(
            F.transform(F.get(words, s["t"]), lambda x, j: F.when(F.get(w, s["o"] + j) == x, F.get(F.get(weight, s["t"]), j)).otherwise(0.0)),
            F.lit(0.0),
            lambda a, x: a + x,
        )

    found = F.transform(F.filter(starts, keyed), lambda s: F.struct(F.get(labels, s["t"]).alias("label"), cover(s).alias("cover")))
    return F.filter(found, lambda s: s["cover"] >= min_cover)


def scan(docs: DataFrame, notices=NOTICES, min_cover: float = MIN_COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document."""
    index = Index(notices)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    edge = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    other = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
    pairs = "|".join(f"{a}{other}{b}" for a, b in sorted(index.pairs))
    beside = rf"(?i)(?<!{edge})(?:{pairs})(?!{edge})"
    # a plain search for one word of each phrase passes over most texts; arrays of one bind a value once
    some = lambda low: reduce(or_, [low.contains(core) for core in sorted(index.cores)])
    likely = F.exists(F.array(text), lambda t: F.exists(F.array(F.lower(t)), some) & t.rlike(beside))
    words = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    split = docs.select("doc_id", F.when(likely, words).alias("w"), F.when(~likely, F.regexp_count(text, F.lit(WORD))).cast("long").alias("n"))
    split = cut(split, "lic-words")
    w = F.col("w")
    split = split.withColumn("base", _phrase_places(w)).withColumn("own", _notice_places(w, index, min_cover))
    none = F.array().cast("array<string>")
    start, base = F.transform("base", lambda s: s["start"]), F.coalesce(F.transform("base", lambda s: s["label"]), none)
    own = F.coalesce(F.transform("own", lambda s: s["label"]), none)
    best = F.array_max(F.transform("own", lambda s: s["cover"]))
    return split.select(
        "doc_id",
        F.coalesce("n", F.size(w)).cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.least(F.lit(1.0), F.coalesce(best, F.when(F.size(base) > 0, F.lit(0.5)), F.lit(0.0))).alias("score"),
    )


def op4_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
