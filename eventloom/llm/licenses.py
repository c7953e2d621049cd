"""Licence scans by diagonal voting.

Every text's rolling five-word hashes are joined, in Spark, to the positions of those hashes
in the licence templates.  A hit at text word ``p`` and template word ``q`` votes for the
diagonal ``p - q``; votes are summed by diagonal, neighbouring diagonals (words put in or
left out) are merged, and a merged span counts if it holds enough of the template's own
positions.  The templates are fixed, so the broadcast side has a fixed size.

Nulls scan as empty text (no words, no labels, score 0); repeated rows are scanned each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, doc_text, gram_hashes, small_batches

GRAM = 5
#: Diagonals this near are one placement of a template.
NEIGHBOUR = 4
#: Share of a placement's template positions that must be hit.
VERIFY = 0.6
#: The same for templates of under SHORT hashes, where versions of a licence differ by a word.
VERIFY_SHORT, SHORT = 0.85, 12

#: Phrases of the base rule and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Licence notices, by their common core, and passages of licence bodies, by label (fixed values).
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "distributed under the mit license"),
    ("mit", "available under the mit license"),
    ("mit", "under the terms of the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc-by-nc", "creative commons attribution non commercial 4 0 international"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-sa", "creative commons attribution share alike 4 0 international"),
    ("gpl-3", "the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2", "the gnu general public license version 2"),
    ("gpl-2", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users"),
    ("lgpl", "the gnu lesser general public license"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved no part of this"),
]

#: Bytes of a word stay, lower-cased; all others become spaces.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_PHRASES = {p.encode(): label for p, label in PHRASES.items()}

BASE = "doc_id long, text_key long, n_words long, n_base long, first_word long, last_word long, base_labels string"


def scan_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """``(word index, label)`` of every place where a phrase's words stand one after another."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in _PHRASES.items():
        at, counted, blanks = joined.find(b" " + phrase + b" "), 0, 0
        while at >= 0:  # blanks are counted on from the last place, so every byte is read once
            blanks += joined.count(b" ", counted, at)
            found.append((blanks, label))
            counted, at = at, joined.find(b" " + phrase + b" ", at + 1)
    return sorted(found)


def _key(words: list[bytes], hashes: WordHashes) -> int:
    """Tells rows of one id but different words apart."""
    return (hashes[b" ".join(words)] if len(words) < 3 else hash_words(hashes.of(words))) & (2**63 - 1)


def hash_words(h) -> int:
    return int(gram_hashes(h, 3).sum(dtype=h.dtype))


def base_scan(docs: DataFrame) -> DataFrame:
    """Per row: words, and the places of the base phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = scan_words(text)
                places = phrase_places(words)
                labels = ",".join(sorted({x for _, x in places}))
                out.append((_key(words, hashes), len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, labels))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [x.split()[0] for x in BASE.split(", ")])

    small_batches(docs.sparkSession)
    return doc_text(docs).mapInArrow(run, BASE)


def rolling_grams(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, grams)``: rolling word hashes of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keys, grams = [], []
            for text in batch.column(1).to_pylist():
                words = scan_words(text)
                keys.append(_key(words, hashes))
                grams.append(gram_hashes(hashes.of(words), GRAM).view("i8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(grams, pa.list_(pa.int64()))], ["doc_id", "text_key", "grams"])

    small_batches(docs.sparkSession)
    return doc_text(docs).mapInArrow(run, "doc_id long, text_key long, grams array<long>")


def template_grams(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``(gram, template, label, at, size)``: the templates' rolling hashes with their positions."""
    hashes, rows = WordHashes(), []
    for k, (label, text) in enumerate(templates):
        grams = gram_hashes(hashes.of(scan_words(text)), GRAM).view("i8").tolist()
        rows += [(g, k, label, q, len(grams)) for q, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, label string, at int, size int")


def diagonal_votes(grams: DataFrame, templates: DataFrame) -> DataFrame:
    """Verified placements ``(doc_id, text_key, label, first_word, last_word, share)``."""
    hits = grams.select("doc_id", "text_key", F.posexplode("grams").alias("p", "gram")).join(F.broadcast(templates), "gram")
    votes = (
        hits.groupBy("doc_id", "text_key", "template", "label", "size", (F.col("p") - F.col("at")).alias("diagonal"))
        .agg(F.count("*").alias("votes"), F.min("p").alias("low"), F.max("p").alias("high"), F.collect_set("at").alias("ats"))
    )
    by = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > NEIGHBOUR, F.lit(True)).cast("int")
    merged = (
        votes.withColumn("opens", opens)
        .withColumn("placement", F.sum("opens").over(by))
        .groupBy("doc_id", "text_key", "template", "label", "size", "placement")
        .agg(F.min("low").alias("first_word"), (F.max("high") + GRAM - 1).alias("last_word"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("hit"))
    )
    share = F.col("hit") / F.col("size")
    return merged.withColumn("share", share).where(share >= F.when(F.col("size") < SHORT, VERIFY_SHORT).otherwise(VERIFY)).select("doc_id", "text_key", "label", "first_word", "last_word", "share")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Base places and the method's labels, one row per row of ``docs``."""
    spark = docs.sparkSession
    found = diagonal_votes(rolling_grams(docs), template_grams(spark))
    labels = found.groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    base = base_scan(docs)
    same = base["doc_id"].eqNullSafe(labels["doc_id"]) & (base["text_key"] == labels["text_key"])
    out = base.join(labels, same, "left").select(base["*"], "more", "share")
    all_labels = F.array_union(F.array_remove(F.split("base_labels", ","), ""), F.coalesce("more", F.array().cast("array<string>")))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        F.array_join(F.array_sort(F.array_distinct(all_labels)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


