"""Licence scan with a positional index of rare words. DataFrame functions only.

Templates are word sequences: the notices and grants of well-known licences, each with a mandatory
phrase, and short phrases, which are their own mandatory phrase. The index's collection are all texts (`everywhere`), or the
texts with a key word of some mandatory phrase; words are ranked by idf over it, and a template's postings are the
places of its words. Labels and places are the same in both; texts outside the collection have score 0, so only the first scores every text.

1. Of each text, for each template, the `depth` words of highest idf are taken that the text and the template share.
2. Each place of such a word in the text, moved back by each of the word's places in the template,
   is a position where the template could begin. For a short phrase the positions of its words are
   intersected. For a long template the position on which most of these words agree is taken, if at least two do.
3. There the mandatory phrase is verified, word for word: for a short phrase at that position (so that no
   place is lost: a phrase that is there has all its words there), for a long template within
   SLACK words of where the template has it, as texts are edited.

The score is the largest share, by idf, of a template's words that stand at the position found, or at one relative to a hit of a
short phrase's rarest word. A word is a run of ASCII letters, digits and of everything outside ASCII, with A-Z in lower case.

Defined cases: a null text counts as empty; texts without words have zero counts, null positions,
empty labels and score 0; of positions with equal agreement the smallest is taken; repeated rows each get their own row; a text of any
length is cut into words once for the index and once for the look-ups; an empty table gives an empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further mandatory phrases of this operator, by label.
OWN = {
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "apache license version 2 0": "apache-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license version 2": "gpl-2.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "permission is hereby granted free of charge": "mit-text",
    "creative commons attribution": "cc",
    "spdx license identifier": "spdx",
    "all rights reserved": "all-rights-reserved",
}
#: Openings of public licence texts and notices, as words, by label, with the mandatory phrase of each.
TEMPLATES = {
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "permission is hereby granted free of charge",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistribution and use in source and binary forms",
    ),
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "apache license version 2 0",
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "under the terms of the gnu general public license",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        "lesser general public license",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "mozilla public license",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "released into the public domain",
    ),
    "boost": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        "software and accompanying documentation covered by this license",
    ),
}
#: A text without any of these has none of the mandatory phrases above.
KEYS = ("licen", "permission", "redistribution", "reserved", "creative commons", "public domain")
DEPTH, LONG_DEPTH, INDEXED, SLACK = 2, 5, 24, 3
# Single characters are looked up in a table of bits, which ranges are not.
_BREAK = "[" + "".join(f"\\x{b:02X}" for b in range(128) if not chr(b).isalnum() or chr(b).isupper()) + "]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are put in lower case
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _BREAK), lambda w: w != "")


def _has_key(text: Column, phrases: list[str]) -> Column:
    """Whether a text can have one of the phrases; key words beyond KEYS are the longest words of phrases without one."""
    more = [max(p.split(), key=len) for p in phrases if not any(set(k.split()) <= set(p.split()) or k in p.split() or (" " not in k and k in p) for k in KEYS)]
    patterns = [r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(k.split()) for k in [*KEYS, *more]]
    return F.coalesce(text.rlike("(?i)(" + "|".join(patterns) + ")"), F.lit(False))


def _constant(words) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def _numbers(values) -> Column:
    """Literals, which are folded into one array; a function of an array would be computed again for every element."""
    return F.array(*[F.lit(float(v)) for v in values])


def scan_licenses(docs: DataFrame, own: dict[str, str] = OWN, templates: dict[str, tuple[str, str]] = TEMPLATES, depth: int = DEPTH, everywhere: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text). everywhere: all texts are the index's collection and have a score, not only those with a key word."""
    phrases = {**BASE, **own}
    vocabulary = sorted({w for p in [*phrases, *(t for t, _ in templates.values())] for w in p.split()})
    candidate = F.lit(True) if everywhere else _has_key(F.col("text"), [*phrases, *(m for _, m in templates.values())])
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), candidate.alias("candidate"))
    # The collection's size and how many of its texts have each word of the vocabulary: one row for each word.
    shared = F.array_distinct(F.filter(_words(F.col("text")), lambda w: w.isin(vocabulary)))
    rows = slim.where("candidate").select(F.explode(F.concat(F.array(F.lit("")), shared)).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    total = counts.pop("", 0)
    # Words of one or two characters are too common to index.
    idf = {w: math.log((total + 2) / (counts.get(w, 0) + 1)) if len(w) > 2 else 0.0 for w in vocabulary}

    # Texts outside the collection only have their words counted.
    n_words = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    nothing = [F.lit(0).cast("long").alias("n_base"), *[F.lit(None).cast("long").alias(n) for n in ("first_word", "last_word")], F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score")]
    plain = slim.where(~F.col("candidate")).select("doc_id", n_words.alias("n_words"), *nothing)
    split = slim.where("candidate").select("doc_id", _words(F.col("text")).alias("words"))
    # The index: of each phrase its rarest words, of each long template the INDEXED rarest ones.
    rarest = lambda of, n: [of[k] for k in sorted(range(len(of)), key=lambda k: (-idf[of[k]], k))][:n]
    of_long = {label: list(dict.fromkeys(w for w in rarest(text.split(), len(text.split())) if idf[w] > 0))[:INDEXED] for label, (text, _) in templates.items()}
    indexed = sorted({w for p in phrases for w in rarest(p.split(), depth)} | {w for ws in of_long.values() for w in ws})
    at = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(indexed), i)))
    hit = F.transform("at", lambda i: F.struct(F.get("words", i).alias("w"), i.cast("long").alias("at")))
    postings = split.select("doc_id", "words", at.alias("at")).select("doc_id", "words", hit.alias("hits"))
    looked_up = postings.select("doc_id", F.size("words").cast("long").alias("n_words"), "hits", F.array_distinct(F.transform("hits", lambda h: h["w"])).alias("present"), "words")

    def rarest_first(of: list[str]) -> list[int]:
        return sorted(range(len(of)), key=lambda k: (-idf[of[k]], k))

    def possible(of: list[str], place: int) -> Column:
        """Where a phrase would begin, by one posting."""
        return F.transform(F.filter("hits", lambda h: h["w"] == of[place]), lambda h: h["at"] - place)

    def has(*of: str) -> Column:
        """Whether the text has these words at all; most texts lack them, and nothing more is looked up for these."""
        return reduce(lambda a, b: a & b, [F.array_contains("present", w) for w in dict.fromkeys(of)])

    def begins(of: list[str]) -> Column:
        """Positions (words from 0) where the postings of the rarest words and then the whole phrase agree."""
        rare = rarest_first(of)[:depth]
        agreed = reduce(F.array_intersect, [possible(of, p) for p in rare])
        found = F.filter(agreed, lambda at: (at >= 0) & (at + len(of) <= F.size("words")) & (F.slice("words", F.greatest(at, F.lit(0)).cast("int") + 1, len(of)) == _constant(of)))
        return F.when(has(*(of[p] for p in rare)), found).otherwise(F.array().cast("array<bigint>"))

    def share(of: list[str], at: Column) -> Column:
        """By idf, of the words that stand where this position wants them."""
        weights, whole = _numbers(idf[w] for w in of), max(sum(idf[w] for w in of), 1e-9)
        stands = F.transform(_constant(of), lambda w, k: F.when(F.get("words", (at + k).cast("int")) == w, F.get(weights, k)).otherwise(0.0))
        return F.aggregate(stands, F.lit(0.0), lambda a, b: a + b) / whole

    def partial(of: list[str]) -> Column:
        rare = rarest_first(of)[0]
        return F.when(has(of[rare]), F.coalesce(F.array_max(F.transform(possible(of, rare), lambda at: share(of, at))), F.lit(0.0))).otherwise(0.0)

    def shared_with(ranked: list[str]) -> Column:
        """The LONG_DEPTH highest-idf words that the text has of these."""
        return F.slice(F.filter(_constant(ranked), lambda w: F.array_contains("present", w)), 1, LONG_DEPTH)

    def wanted(of: list[str], ranked: list[str], taken: str) -> Column:
        """Where the template would begin, by each posting of the words taken, in order; `taken` is a column, as a lambda makes what stands in it for every element."""
        places = F.create_map(*[x for w in ranked for x in (F.lit(w), F.array(*[F.lit(k).cast("long") for k, x in enumerate(of) if x == w]))])
        chosen = F.filter("hits", lambda h: F.array_contains(taken, h["w"]))
        all_places = F.flatten(F.transform(chosen, lambda h: F.transform(F.element_at(places, h["w"]), lambda p: h["at"] - p)))
        return F.when(F.size(taken) > 0, F.sort_array(all_places)).otherwise(F.array().cast("array<bigint>"))

    def most_agreed(wanted: str) -> Column:
        """struct(n, at): the position that most postings want, and how many do; none where no two agree."""
        none = F.lit(-1).cast("long")
        start = F.struct(F.lit(0).cast("long").alias("n"), none.alias("at"), F.lit(0).cast("long").alias("run"), F.lit(None).cast("long").alias("last"))

        def step(s: Column, at: Column) -> Column:
            run = F.when(at == s["last"], s["run"] + 1).otherwise(F.lit(1).cast("long"))
            return F.struct(F.greatest(s["n"], run).alias("n"), F.when(run > s["n"], at).otherwise(s["at"]).alias("at"), run.alias("run"), at.alias("last"))

        best = F.aggregate(wanted, start, step, lambda s: F.struct(s["n"].alias("n"), s["at"].alias("at")))
        return F.when(F.size(F.array_distinct(wanted)) < F.size(wanted), best).otherwise(F.struct(F.lit(0).cast("long").alias("n"), none.alias("at")))

    def has_mandatory(of: list[str], phrase: list[str], at: Column) -> Column:
        place = next(k for k in range(len(of)) if of[k : k + len(phrase)] == phrase)
        begin = F.greatest(at + place - SLACK, F.lit(0))
        near = F.concat(F.lit(" "), F.array_join(F.slice("words", begin.cast("int") + 1, len(phrase) + 2 * SLACK), " "), F.lit(" "))
        return F.contains(near, F.lit(f" {' '.join(phrase)} "))

    short = [(p.split(), p) for p in phrases]
    long = [(text.split(), phrase.split(), label) for label, (text, phrase) in templates.items()]
    taken = looked_up.select("*", *[shared_with(of_long[label]).alias(f"taken{i}") for i, (_, _, label) in enumerate(long)])
    placed = taken.select(*looked_up.columns, *[wanted(w, of_long[label], f"taken{i}").alias(f"wanted{i}") for i, (w, _, label) in enumerate(long)])
    agreed = placed.select(*looked_up.columns, *[begins(w).alias(f"at{i}") for i, (w, _) in enumerate(short)], *[most_agreed(f"wanted{i}").alias(f"best{i}") for i in range(len(long))])
    found = agreed.select(
        "doc_id", "n_words", *[f"at{i}" for i in range(len(short))],
        *[((F.col(f"best{i}.n") >= 2) & has_mandatory(w, m, F.col(f"best{i}.at"))).alias(f"is{i}") for i, (w, m, _) in enumerate(long)],
        F.greatest(*[partial(w) for w, _ in short], *[F.when(F.col(f"best{i}.n") >= 2, share(w, F.col(f"best{i}.at"))).otherwise(0.0) for i, (w, _, _) in enumerate(long)], F.lit(0.0)).alias("score"),
    )
    of_base = [i for i, (_, p) in enumerate(short) if p in BASE]
    places = F.flatten(F.array(*[f"at{i}" for i in of_base]))

    def labels(chosen: list[int], *more: Column) -> Column:
        each = [F.when(F.size(f"at{i}") > 0, F.lit(phrases[short[i][1]])) for i in chosen]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*each, *more)))), ",")

    scanned = found.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        labels(of_base).alias("base_labels"),
        labels(list(range(len(short))), *[F.when(F.col(f"is{i}"), F.lit(label)) for i, (_, _, label) in enumerate(long)]).alias("labels"),
        F.least(F.col("score"), F.lit(1.0)).cast("double").alias("score"),
    )
    return scanned if everywhere else plain.union(scanned)
