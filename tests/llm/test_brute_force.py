"""Licence scans and recording searches against plain Python over the smallest tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from eventloom.llm import audio, licenses

SF = "/root/testdata/sf0.001"


def plain_words(text: str | None) -> list[str]:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_scan(text: str | None) -> tuple:
    """Base places, then diagonal votes by comparing every text word with every template word."""
    words = plain_words(text)
    base = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    starts: dict[tuple, list[int]] = {}
    for p in range(len(words) - licenses.GRAM + 1):
        starts.setdefault(tuple(words[p : p + licenses.GRAM]), []).append(p)
    labels, best = {x for _, x in base}, 0.0
    for label, template in licenses.TEMPLATES:
        t = plain_words(template)
        size = len(t) - licenses.GRAM + 1
        hits = sorted((p - q, q) for q in range(size) for p in starts.get(tuple(t[q : q + licenses.GRAM]), []))
        placement: set[int] = set()
        for i, (diagonal, q) in enumerate(hits):
            if i and diagonal - hits[i - 1][0] > licenses.NEIGHBOUR:
                placement = set()
            placement.add(q)
            share = len(placement) / size
            if share >= (licenses.VERIFY_SHORT if size < licenses.SHORT else licenses.VERIFY):
                labels.add(label)
                best = max(best, share)
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(1.0 if base else best, 9))


def broken_up(rng: random.Random, text: str) -> str:
    """A template with some words put in, left out or changed."""
    out = []
    for word in text.split():
        roll = rng.random()
        if roll < 0.04:
            continue
        out += [word, "extra"] if roll < 0.08 else ["other"] if roll < 0.12 else [word]
    return " ".join(out)


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(11)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    planted = [(10**9 + i, f"start here, {t.upper() if i % 2 else t}. and on") for i, (_, t) in enumerate(licenses.TEMPLATES)]
    planted += [(2 * 10**9 + i, broken_up(rng, f"before {licenses.TEMPLATES[i % len(licenses.TEMPLATES)][1]} after")) for i in range(3 * len(licenses.TEMPLATES))]
    planted += [(3 * 10**9, None), (3 * 10**9 + 1, ""), (3 * 10**9 + 2, "CC BY-NC " * 2000), (3 * 10**9 + 2, "cc by nc"), (None, "under the MIT license")]
    rows = [tuple(r) for r in docs.collect()] + planted
    found = licenses.scan_licenses(docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string")).repartition(5))
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in found.collect())
    assert got == Counter((i, *plain_scan(t)) for i, t in rows)


def test_phrases_of_a_long_text_in_linear_time():
    """A text of 6 MB full of phrases, next to one of a fifth of it; the places are those of a plain count."""
    import time

    unit, took = ["under", "the", "mit", "license", "x", "cc", "by", "nc"], []
    for n in (40_000, 200_000):
        words = [w.encode() for w in unit * n]
        began = time.process_time()
        places = licenses.phrase_places(words)
        took.append(time.process_time() - began)
        assert places == sorted([(8 * i, "mit") for i in range(n)] + [(8 * i + 5, "cc-by-nc") for i in range(n)])
    assert took[1] < 15 * took[0] + 1


def plain_alignments(a: np.ndarray, b: np.ndarray) -> tuple | None:
    """The offset of most equal keys, then its bit error, counted one pair of positions at a time."""
    shift = 32 - audio.KEY_BITS
    votes = Counter(j - i for i, x in enumerate(a.tolist()) for j, y in enumerate(b.tolist()) if x >> shift == y >> shift)
    if not votes:
        return None
    offset, n = min(votes.items(), key=lambda x: (-x[1], x[0]))
    pairs = [(a[i], b[i + offset]) for i in range(len(a)) if 0 <= i + offset < len(b)]
    error = sum(int(x ^ y).bit_count() for x, y in pairs) / (32 * len(pairs))
    good = n >= audio.MIN_VOTES and len(pairs) >= audio.MIN_OVERLAP and error <= audio.MAX_ERROR
    return (offset, n, round(error, 9), len(pairs)) if good else None


def test_recording_search_matches_brute_force(spark, monkeypatch):
    """Near, shifted and unrelated melodies, in several blocks a side."""
    rng = np.random.default_rng(5)
    tunes = [rng.normal(size=40) for _ in range(24)]
    tunes += [tunes[i] + rng.normal(scale=0.08, size=40) for i in range(8)] + [np.concatenate([tunes[i][9:], rng.normal(size=9)]) for i in range(8, 14)]
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(tunes)], "vec_id long, embedding array<double>").repartition(4, "vec_id")
    prints = audio.fingerprints(audio.rendered(vectors)).select("rec_id", "prints")
    held = {r["rec_id"]: np.frombuffer(r["prints"], "<u4") for r in prints.collect()}
    want = {}
    for i in held:
        for j in held:
            if i % 4 == 0 and i != j and (found := plain_alignments(held[i], held[j])):
                want[i, j] = found
    monkeypatch.setattr(audio, "PAIRS_AT_A_TIME", 500)
    got = audio.search(prints.where(F.col("rec_id") % 4 == 0), prints).collect()
    assert len(want) >= 4 and len(got) == len(want)
    assert {(r["query_id"], r["match_id"]): (r["offset_frames"], r["votes"], round(r["bit_error"], 9), r["overlap"]) for r in got} == want
