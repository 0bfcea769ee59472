"""Licence scan by a positional index of rare words; DataFrame functions only.

A template has a label, the words of its usual sentence, and within it a mandatory key phrase. A
first pass counts in how many documents each word of a key phrase occurs. The index holds for
each template the postings (offset in the key phrase) of its two words of highest IDF. The second
pass looks up each file's words in it: a place of the rarest word suggests a start, the second
word has to stand at the same relative position, and the whole key phrase is then verified word
by word. So no place of a key phrase is missed, and only files that hold a rarest word are looked
at any closer. Everything after the counts is one scan without a shuffle.

The score is the largest share of a template's words, aligned at a verified place, that the file
has there; 0 without any place.

Defined cases: null texts count as empty; texts without words have no places; repeated rows are
scanned one by one; in an empty table all words have the same IDF and the first of a phrase lead.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costsieve.llm.common import A_Z, col, fresh

RARE = 2


class Template(NamedTuple):
    label: str
    key: str
    words: str
    base: bool = False


# Phrases and labels of the contract (base), and of well-known licence texts.
TEMPLATES = [
    Template("mit", "under the mit license", "released under the mit license", True),
    Template("apache-2", "apache license version 2", "licensed under the apache license version 2 0", True),
    Template("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0", True),
    Template("gpl-3", "gnu general public license version 3",
             "this work is licensed under the gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2",
             "this work is licensed under the gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license", "the terms of the gnu lesser general public license"),
    Template("agpl", "gnu affero general public license", "the terms of the gnu affero general public license"),
    Template("mpl-2", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    Template("cc0", "cc0 1 0 universal", "creative commons cc0 1 0 universal"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy",
             "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms",
             "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("isc", "permission to use copy modify and or distribute this software",
             "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    Template("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
]

# All ASCII characters that part words.
BREAKS = "".join(chr(c) for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))


def word_array(text: Column) -> Column:
    """The text's words, ASCII capitals in lower case."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), A_Z + BREAKS, A_Z.lower() + " " * len(BREAKS)))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def document_frequency(words: DataFrame, words_col: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each word of the (small, fixed) vocabulary occurs."""
    seen = words.select(F.explode(F.array_intersect(_strings(vocabulary), col(words_col))).alias("w"))
    return {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def rare_postings(templates: list[Template], df: dict[str, int], rare: int = RARE) -> list[list[tuple[str, int]]]:
    """For each template the words of its key with the highest IDF, and their offsets there."""
    out = []
    for t in templates:
        words = t.key.split()
        out.append(sorted(zip(words, range(len(words))), key=lambda x: (df.get(x[0], 0), x[1]))[:rare])
    return out


def scan(docs: DataFrame, text_col: str = "text", templates: list[Template] | None = None, rare: int = RARE) -> DataFrame:
    """``docs`` with ``n_words`` and ``places``: array of (template, label, base, start, share) for
    every place of a key phrase, in words from 0."""
    templates = TEMPLATES if templates is None else templates
    (words,) = fresh(docs, "__words")
    keep = [col(c) for c in docs.columns if c.lower() not in ("n_words", "places")]
    table = docs.select(*keep, word_array(col(text_col)).alias(words))
    vocabulary = sorted({w for t in templates for w in t.key.split()})
    index = rare_postings(templates, document_frequency(table.select(words), words, vocabulary), rare)
    # the look-up by word, as literals of a fixed size
    leads: dict[str, list[tuple[int, int]]] = {}
    for i, posts in enumerate(index):
        leads.setdefault(posts[0][0], []).append((i, posts[0][1]))
    look_up = F.create_map(*[x for w, posts in sorted(leads.items()) for x in (
        F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(o).alias("o")) for t, o in posts]))])
    keys = F.array(*[_strings(t.key.split()) for t in templates])
    others = F.array(*[F.array(*[F.struct(F.lit(w).alias("w"), F.lit(o).alias("o")) for w, o in posts]) for posts in index])
    lines = F.array(*[_strings(t.words.split()) for t in templates])
    ahead = F.array(*[F.lit((" " + t.words + " ").split(" " + t.key + " ")[0].count(" ")) for t in templates])
    labels, bases = _strings([t.label for t in templates]), F.array(*[F.lit(t.base) for t in templates])

    w = col(words)
    known = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))),
                     lambda x: F.array_contains(_strings(sorted(leads)), x["w"]))
    starts = F.flatten(F.transform(known, lambda x: F.transform(
        F.element_at(look_up, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["o"]).alias("start")))))
    aligned = F.filter(starts, lambda h: (h["start"] >= 0) & F.forall(
        F.get(others, h["t"]), lambda p: F.coalesce(F.get(w, h["start"] + p["o"]) == p["w"], F.lit(False))))
    verified = F.filter(aligned, lambda h: F.slice(w, h["start"] + 1, F.size(F.get(keys, h["t"]))) == F.get(keys, h["t"]))
    share = F.transform(verified, lambda h: F.struct(
        h["t"].alias("template"), F.get(labels, h["t"]).alias("label"), F.get(bases, h["t"]).alias("base"),
        h["start"].cast("long").alias("start"),
        (F.size(F.filter(F.transform(F.get(lines, h["t"]), lambda x, j: F.coalesce(
            F.get(w, h["start"] - F.get(ahead, h["t"]) + j) == x, F.lit(False))), lambda x: x))
         / F.size(F.get(lines, h["t"]))).alias("share")))
    none = F.array().cast("array<struct<template:int,label:string,base:boolean,start:bigint,share:double>>")
    places = F.when(F.arrays_overlap(w, _strings(sorted(leads))), share).otherwise(none)
    return table.withColumn("n_words", F.size(w).cast("long")).withColumn("places", places).drop(words)


def label_list(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(places["label"])), ",")
