"""Training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import audio, bpe, chunks, language, licenses, lm, near_dup, packing, pii, quality, tokens
from eventloom.llm.components import components
from eventloom.llm.queries import oracle_sql, queries, tokenizer_file

WORDS = "the river takes a slow turn past old mills where children fish under green willows each spring while boats drift on toward wide harbours far below".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, words string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, repeats, ties, odd characters, a long text; clashing extra columns."""
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "one", "a b c d", "É ü 👍 \x85 \x1c", "x" * 30_000, prose(rng, 3000), "it's <|endoftext|> here  twice   spaced\n\n done", "mail a.b@c.example, +1 (555) 123-4567 or 10.0.0.1 by 4539 1488 0343 6467"]
    rows = [(i, t, "en", "s", 0, 1, "w") for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, "no id at all in this row", None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library(text: str | None) -> list[int]:
    return chunks.load_tokenizer(tokenizer_file("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_as_the_whole():
    encoder, rng = chunks.PieceEncoder(tokenizer_file("byte_bpe_50k.json")), random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", ".", "'s", "1", "é", "一", "\x85", "\xa0", "\x1c", "<|endoftext|>", " the", "​", "👍", "Ġ", "\r", "　", "\x00", "×", "́", "_", "-"]
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
        assert encoder.ids(text) == encoder.library(text), repr(text)
        assert encoder.count(text, {"a": 1}) == len(encoder.library(text)) // 4


def test_token_counts(odd, empty):
    got = tokens.with_limit(tokens.count_tokens(odd, tokenizer_file("byte_bpe_50k.json"), 10), 1024).collect()
    want = sorted((len((r[1] or "").encode()), len(library(r[1]))) for r in odd_rows())
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert tokens.count_tokens(empty, tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_bpe_round_trip(odd, empty):
    import public_tokenizers

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_documents(odd, path, public_tokenizers.PATTERN)
    decoded = bpe.decode_documents(encoded, path, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in decoded) == sorted((r[1] or "").encode() for r in odd_rows())
    one = bpe.ByteBPE(path, public_tokenizers.PATTERN)
    for text in ("word " * 30_000, "x" * 120_000, " " * 60_000 + "end", "a  b " * 20_000):
        assert one.encode(text) == one.enc.encode_ordinary(text)
    digests = {r["doc_id"]: r for r in bpe.round_trip_digests(odd, path, public_tokenizers.PATTERN).collect()}
    assert digests[3]["ids_sha256"] == hashlib.sha256(" ".join(map(str, one.encode("one"))).encode()).hexdigest()
    assert digests[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest() and digests[0]["n_tokens"] == 0
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


def test_packing_places_every_piece(odd, empty):
    rows = packing.pack_documents(odd, tokenizer_file("byte_bpe_50k.json")).collect()
    by_seq: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    ids = {r[0]: [*library(r[1]), 2] for r in odd_rows()}
    assert sum(r["length"] for r in rows) == sum(len(library(r[1])) + 1 for r in odd_rows())
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        assert r["piece"] == 0 or r["length"] == 1024
    assert packing.pack_documents(empty, tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_minimum_bin_slack_is_near_the_bound():
    rng = np.random.default_rng(2)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(rng.integers(1, 1025, 5000), return_counts=True))}
    plan = packing.minimum_bin_slack(histogram)
    used: dict[int, int] = {}
    for times, sizes in plan:
        assert sum(sizes) <= 1024
        for s in sizes:
            used[s] = used.get(s, 0) + times
    assert used == histogram
    assert sum(t for t, _ in plan) <= 1.01 * sum(k * n for k, n in histogram.items()) / 1024 + 1
    brute = {sum(c) for r in range(6) for c in itertools.combinations([7, 11, 13, 17, 19], r)}
    left = np.zeros(101, np.int64)
    left[[7, 11, 13, 17, 19]] = 1
    for room in range(1, 80):
        assert sum(packing.fullest([19, 17, 13, 11, 7], left, room)) == max(x for x in brute if x <= room)


def brute_components(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng: random.Random, n: int, edits: int) -> list[str]:
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.sample(range(150), rng.randrange(edits + 1)):
            own[at] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(8)
    texts = [*family(rng, 60, 6), *family(rng, 40, 3), *family(rng, 30, 9), *[prose(rng, 40) for _ in range(30)], "one two", "One TWO", "", None, "a b c d e", "a  b c d e "]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_find_links_that_no_centre_shows(spark):
    """Large families whose members are near one another by chance of their edits; every link is held against brute force."""
    rng = random.Random(31)
    texts = [*family(rng, 150, 5), *family(rng, 120, 7)]
    for k in (0, 40, 150, 200):  # chains that lead away from their family
        words = texts[k].split()
        for _ in range(8):
            for at in rng.sample(range(150), 2):
                words[at] = f"c{rng.randrange(10**9)}"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_beginnings_keep_every_link():
    """Linked sets that differ from a centre share an early difference, at places that leave room: by brute force."""
    rng = np.random.default_rng(3)
    for percent in (80, 85):
        base = rng.choice(10**6, 120, replace=False)
        sets = []
        for _ in range(60):
            own = set(base.tolist()) - set(rng.choice(base, rng.integers(0, 25), replace=False).tolist())
            sets.append(own | set(rng.choice(400, rng.integers(0, 12)).tolist()))
        for centre in (sets[0], sets[1]):
            apart = [x ^ centre for x in sets]
            seen = {e: sum(e in d for d in apart) for d in apart for e in d}
            first = [sorted(d, key=lambda e: (seen[e], e))[: len(x) * (100 - percent) // percent + 1] for x, d in zip(sets, apart)]
            for i, j in itertools.combinations(range(60), 2):
                x, y, c = sets[i], sets[j], centre
                linked = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
                if not linked(x, y) or (linked(x, c) and linked(y, c)):
                    continue
                places = [(first[i].index(e), first[j].index(e)) for e in set(first[i]) & set(first[j])]
                room = max(min(len(apart[i]) - p, len(apart[j]) - q) for p, q in places)
                assert (len(apart[i]) + len(apart[j]) - 2 * room) * (100 + percent) <= (len(x) + len(y)) * (100 - percent)


def test_bit_counts_are_plain_counts_of_slots():
    """Counts by predictor, fold and slot equal those made one bit at a time, from 32-bit slots, also across additions."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(60)).encode() for _ in range(40)]
    code = lm.Code.of({b: 1 + b % 7 for b in range(256)})
    counts, want = lm.BitCounts(code), np.zeros((len(lm.ORDERS), lm.FOLDS, code.slots, 2), np.int32)
    for some in (texts[:25], texts[25:]):
        counts.learn(some)
        for fold in range(lm.FOLDS):
            counts._add(fold)
    for fold, some in enumerate(lm.by_fold(texts)):
        for _, bit, slots in lm.blocks_of(some, code):
            assert all(x.dtype == np.uint32 for x in slots)
            for k, x in enumerate(slots):
                for slot, b in zip(x.tolist(), bit.astype(int).tolist()):
                    want[k, fold, slot, b] += 1
    assert want.sum() > 0 and (counts.counts == want).all()


def test_beginnings_hand_on_only_what_several_roots_hold(spark):
    """A million and a half shingles of one difference each leave nothing but the one that differences share, at its own place."""
    from pyspark.sql import functions as F

    own = F.expr("array_union(transform(sequence(0, 1499), x -> xxhash64(id, x)), array(7, if(id < 500, 8, xxhash64(id))))")
    parted = spark.range(1000).select((F.col("id") % 4).alias("centre"), F.col("id").alias("cid"), F.when(F.col("id") < 500, 0).otherwise(F.col("id")).alias("root"), F.lit(0).cast("long").alias("centre_root"), F.lit(20_000).cast("long").alias("n_shingles"), own.alias("apart"))
    got = near_dup.beginnings(parted, near_dup.held_across(parted), 85).groupBy("shingle", "place", "n_apart").count().collect()
    assert [tuple(r) for r in got] == [(7, 1501, 1502, 1000)]


def test_near_duplicate_stage_links_from_80_on(spark):
    """Pairs of 100 shingles of which 90 are shared (similarity 90 / 110), others at 88 / 112: under 0.80."""
    import corpus_pipeline

    def pair(k: int, changed: int) -> list[str]:
        words = [f"w{k}x{i}" for i in range(104)]
        return [" ".join(words), " ".join(words[:-changed] + [f"v{k}x{i}" for i in range(changed)])]

    texts = [t for k in range(40) for t in pair(k, 10 if k % 2 == 0 else 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i in range(80) if i % 4 != 1}
    assert near_dup.near_duplicates(docs).where("kept").count() == 80
    assert near_dup.bands_for(85) == 36 and near_dup.screen_for(85) == 126


def test_near_duplicates_odd_rows(odd, empty):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == len(odd_rows())
    assert [r["component_id"] for r in rows if r["doc_id"] in (0, 1, 2)] == [r["doc_id"] for r in rows if r["doc_id"] in (0, 1, 2)]
    assert near_dup.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: find(x) for x in parent}


def test_quality_ledger(odd, empty):
    rows = {r["doc_id"]: r for r in quality.apply_policy(quality.ledger(odd)).collect()}
    assert len(rows) == len(odd_rows()) - 1
    assert rows[0]["n_words"] == 0 and rows[0]["base_failed"] and not rows[0]["kept"]
    for i in (3, 5, 7, 8):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", odd_rows()[i][1]) if w]
        runs = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
        covered = {p for j, run in enumerate(runs) if runs.count(run) > 1 for p in range(j, j + 5)}
        assert (rows[i]["n_words"], rows[i]["n_repeat_words"], rows[i]["word_chars"]) == (len(words), len(covered), sum(map(len, words)))
    report = {r["rule"]: r for r in quality.ablations(quality.ledger(odd)).collect()}
    assert report["few_words"]["n_failed"] >= report["few_words"]["n_only"] > 0
    assert quality.ledger(empty).count() == 0
    assert quality.mask("2024-2") == 2 ** len(quality.RULES) - 1


def test_lm_equal_windows_share_a_representative():
    rng = np.random.default_rng(6)
    for keys in (rng.integers(0, 1 << 48, 20_000), rng.integers(0, 900, 20_000), np.zeros(1), np.arange(5)):
        keys = keys.astype(np.uint64)
        chosen, of = lm.representatives(keys)
        assert (keys[chosen][of] == keys).all() and (np.diff(chosen) > 0).all()
    assert len(lm.representatives(np.full(5000, 7, np.uint64))[0]) == 1


def test_lm_scores_and_counts_expand_equal_windows_once(monkeypatch):
    """Costs equal those of a plain walk over all bits; windows held many times are opened a few times, also across cuts."""
    monkeypatch.setattr(lm, "CHUNK", 4000)
    rng = random.Random(7)
    texts = [t.encode() for t in (prose(rng, 40), prose(rng, 8), "", "ä\n\xff ü", "x" * 9001)] * 60
    code = lm.Code.of({b: 1 + b % 9 for b in range(256)})
    opened, plain = [], lm.Bits

    class Counted(plain):
        def __init__(self, buf, at, code):
            opened.append(len(at))
            super().__init__(buf, at, code)

    monkeypatch.setattr(lm, "Bits", Counted)
    counts = lm.BitCounts(code)
    counts.learn(texts)
    n, ones = lm.counts_by_fold(code, counts.blocks())
    weights = np.array([[rng.uniform(0, 0.6) for _ in range(lm.GATES)] for _ in lm.ORDERS])
    model = lm.Mixture.of(code, (n, ones), [], weights)
    got = model.scores(texts)
    assert sum(opened) < 0.2 * sum(len(t) + 1 for t in texts)
    for t, score in zip(texts[:5], got):
        want = 0.0
        for gate, bit, slots in lm.blocks_of([t], code):
            step = lm.mixed_steps(model.weights[:, gate], [o[x] for o, x in zip(model.odds, slots)])
            want += sum(float(model.cost[int(b), gate * lm.STEPS + i]) for b, i in zip(bit, step))
        assert abs(score - want) < 1e-9 * abs(want)
    assert np.allclose(got.reshape(60, 5), got[:5], rtol=1e-12, atol=0)


def test_language_learns_and_handles_odd_rows(spark, odd, empty):
    rng = random.Random(3)
    other = "der fluss zieht langsam an alten mühlen vorbei wo kinder unter grünen weiden fischen und boote treiben".split()
    rows = [(i, prose(rng, 60) if i % 2 else " ".join(rng.choice(other) for _ in range(60)), "en" if i % 2 else "de") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs, F.col("doc_id") % 4 == 2).collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "de") for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    out = {r["doc_id"]: r for r in language.identify(odd, F.lit(False)).collect()}
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == "und" and out[0]["score"] == 0
    assert language.identify(empty, F.lit(False)).count() == 0


def test_lm_base_scores(spark, odd, empty):
    import math
    from collections import Counter

    rows = lm.score(odd, F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False))).collect()
    counts: Counter[bytes] = Counter()
    for i, t, *_ in odd_rows():
        if i is None or i % 5 != 1:
            counts.update([*lm.tokens(t), b""])
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(lm.tokens(t)) + 1, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*lm.tokens(t), b""]), 6)) for _, t, *_ in odd_rows())
    assert sorted((r["n_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 and r["train_tokens"] == n for r in rows)
    assert lm.score(empty, F.lit(False)).count() == 0


def test_lm_probabilities_sum_to_one():
    code = lm.Code.of({97: 50, 98: 20, 255: 5})
    seen = lm.BitCounts(code)
    seen.learn([b"abab" * 500, b"aab" * 400])
    model = lm.Mixture.of(code, lm.counts_by_fold(code, seen.blocks()), [])
    every = 10 ** model.scores([b"ab" + bytes([c]) for c in range(256)])
    longer = 10 ** model.scores([b"ab"])
    assert longer.sum() < 1 and every.sum() < 1
    assert model.scores([b"abab"])[0] > model.scores([b"bbbb"])[0]
    assert np.allclose((10**model.cost).sum(axis=0), 1)


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 60_000)
    rng = random.Random(11)
    rows = [(i, prose(rng, 40) + f" {rng.random()}") for i in range(1500)]
    docs = spark.createDataFrame(rows + [(9000 + i, rows[0][1]) for i in range(500)], "doc_id long, text string")
    held = F.col("doc_id") % 6 == 1
    first, *others = ([r["score"] for r in lm.score(docs.repartition(n), held).orderBy("doc_id").collect()] for n in (1, 8, 32))
    for other in others:
        assert np.allclose(first, other, rtol=1e-9, atol=0)


def test_lm_learns_weights_and_refinement_from_one_small_block(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, prose(rng, 60), False) for i in range(200)], "doc_id long, text string, held_out boolean").coalesce(1)
    code = lm.Code.of({b: 1 + 100 * prose(rng, 200).encode().count(b) for b in range(97, 123)})
    model = lm.train(docs, code, 80_000)
    assert (np.abs(model.weights - 0.3) > 0.01).any(axis=0).sum() >= 10
    steps = 10 ** model.cost[1].reshape(lm.GATES, lm.STEPS) - lm._SQUASH
    assert (np.abs(steps) > 0.01).sum() > lm.STEPS


def test_lm_mixes_as_a_plain_mixer_does_bit_by_bit():
    rng = random.Random(13)
    mixer = lm.OnlineMixer(lm.Code.of({}), np.zeros((lm.FOLDS, len(lm.ORDERS), 1 << 16), np.int8))
    weights, curve = [0.3] * 4, [[0.0] * 4 for _ in range(4)]
    seen, ones = [0] * lm.STEPS, [0] * lm.STEPS
    for _ in range(400):
        odds = [rng.randint(-40, 40) for _ in range(4)]
        bit = int(rng.random() < 1 / (1 + 2.0 ** (-odds[1] / 8)))
        at = sum(w * o / 8 for w, o in zip(weights, odds)) * lm.STEPS / (2 * lm.RANGE) + lm.STEPS / 2
        at = int(min(max(at, 0), lm.STEPS - 1))
        p = 1 / (1 + 2.718281828459045 ** -((at + 0.5) * 2 * lm.RANGE / lm.STEPS - lm.RANGE))
        seen[at] += 1
        ones[at] += bit
        for i in range(4):
            for j in range(4):
                curve[i][j] += p * (1 - p) * odds[i] * odds[j] / 64
        slope = [(bit - p) * o / 8 for o in odds]
        move = np.linalg.solve(np.array(curve) + lm.HELD * np.eye(4), slope)
        weights = [float(min(max(w + m, lm.LEAST_WEIGHT), lm.MOST_WEIGHT)) for w, m in zip(weights, move)]
        mixer.step(7, np.array([bit], np.float32), [np.array([o], np.int8) for o in odds])
    here = slice(7 * lm.STEPS, 8 * lm.STEPS)
    assert np.allclose(mixer.weights[:, 7], weights, atol=1e-3) and np.allclose(mixer.curve[7], curve, rtol=1e-2, atol=0.1)
    assert mixer.weights[1, 7] > max(mixer.weights[k, 7] for k in (0, 2, 3)), "the predictor that knows the bit gains weight"
    assert np.abs(mixer.refined[0, here] - seen).sum() <= 4 and np.abs(mixer.refined[1, here] - ones).sum() <= 4


def test_lm_shards_do_not_depend_on_how_calls_are_cut(monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 5000)
    rng = random.Random(14)
    texts = [prose(rng, 30).encode() for _ in range(150)] + [b"", b"x" * 12_000]
    code = lm.Code.of({97: 500, 98: 20, 255: 5})
    counts = lm.BitCounts(code)
    counts.learn(texts)
    apart = lm.apart_odds(*lm.counts_by_fold(code, counts.blocks()))
    whole, cut = lm.OnlineMixer(code, apart), lm.OnlineMixer(code, apart)
    whole.learn(texts)
    for t in texts:
        cut.learn([t])
    for m in (whole, cut):
        m.close()
    assert (whole.refined == cut.refined).all() and (whole.curved == cut.curved).all() and (whole.pulled == cut.pulled).all()
    assert whole.refined[0].sum() > 0


def test_base_patterns_match_plain_regexes():
    import re

    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    rng = random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choices(["1", "23", "4444", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "x@y.z", "255", "é"], k=rng.randint(0, 14)))
        want = [(k, m.start(), m.end()) for k in pii.KINDS for m in re.finditer(plain[k], text)]
        assert [m[:3] for m in pii.base_matches(text)] == want, repr(text)
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")


def test_pii_finds_base_and_added_spans(spark, odd, empty):
    tagger = pii.CharTagger(pii._CLASSES, 9).fit(*pii.training_windows([r[1] for r in odd_rows() if r[1] and "@" in r[1]], plain=1200), 6)
    rows = {r["doc_id"]: r for r in pii.detect(odd, tagger).collect()}
    assert [rows[9][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    assert rows[0]["spans"] == "" and rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    base, more = pii.all_spans(["call me at (682) 555-5413 now please"], tagger)[0]
    assert base == [] and [m[0] for m in more] in ([], ["phone"])
    clean = pii.all_spans([prose(random.Random(1), 500) + " in 1999 and 12 more"], tagger)[0]
    assert clean == ([], [])
    masked = {r["doc_id"]: r["text"] for r in pii.redact(odd, tagger).collect()}
    assert "[EMAIL]" in masked[9] and "@" not in masked[9] and masked[0] is None
    assert pii.detect(empty, tagger).count() == 0


def planted_variants() -> dict[str, list[tuple[str, str]]]:
    """By form, ``(what is planted, the span in it)``: every form that the tagger trains on beside the base's own."""
    rng = random.Random(21)
    name = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(4, 8)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    out: dict[str, list[tuple[str, str]]] = {}

    def put(form: str, made: str, span: str | None = None) -> None:
        out.setdefault(form, []).append((made, span or made))

    for _ in range(40):
        for at, dot in ((" (at) ", "."), (" [at] ", "."), ("(at)", "."), (" at ", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)")):
            put(f"email{at}{dot}", f"{name()}{at}{name()}{dot}{rng.choice(['com', 'org', 'net'])}")
        digits = num(15)
        digits += next(d for d in "0123456789" if pii.luhn(digits + d))
        fours = [digits[i : i + 4] for i in range(0, 16, 4)]
        put("card after", f"{rng.randrange(10, 10000)} {digits}", digits)
        put("card grouped", f"{rng.randrange(10, 10000)} {' '.join(fours)}", " ".join(fours))
        put("card dots", ".".join(fours))
        for sep in ("[.]", "(.)", "[dot]", "(dot)", " . "):
            put(f"ip {sep}", sep.join(str(rng.randint(0, 255)) for _ in range(4)))
        a, b, c = (str(rng.randrange(200, 999)) for _ in range(2)), None, str(rng.randrange(1000, 9999))
        a, b = a
        for form in ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "0{}/{}-{}"):
            put(f"phone {form}", form.format(a, b, c))
    return out


def test_pii_recall_of_every_form_it_trains_on(spark):
    """Trained by ``fit`` on the smallest tables, planted in their own prose: exact spans, and hardly any in clean texts."""
    rng = random.Random(22)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    tagger = pii.fit(docs)
    texts = [r["text"] for r in docs.where("text is not null").collect()]
    clean = [t for t in texts if len(t) > 300 and not pii._CUE.search(t)]
    recall = {}
    for form, planted in planted_variants().items():
        made = []
        for what, span in planted:
            t = rng.choice(clean)[:600]
            cut = t.find(" ", rng.randrange(len(t) - 100)) + 1
            made.append((t[:cut] + what + " " + t[cut:], cut + what.index(span), cut + what.index(span) + len(span)))
        spans = pii.all_spans([t for t, _, _ in made], tagger)
        found = sum((form.split()[0].split("(")[0], a, b) in base + more for (_, a, b), (base, more) in zip(made, spans))
        recall[form] = found / len(planted)
    assert min(recall.values()) >= 0.9, recall
    added = sum(len(more) for _, more in pii.all_spans(clean, tagger))
    assert added <= 0.002 * len(clean), added
    assert pii.all_spans(["meet me at the mill. then we look at old boats."], tagger)[0][1] == []


def test_tagger_gradients():
    rng = np.random.default_rng(0)
    tagger = pii.CharTagger(5, 3, 4, 3)
    x, y = rng.integers(0, 5, (6, 2)), rng.integers(0, 3, (6, 2))
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    _, grads = tagger.gradients(x, y)
    for name, p in tagger.p.items():
        at = tuple(rng.integers(0, n) for n in p.shape)
        before = p[at]
        p[at] = before + 1e-3
        up = tagger.gradients(x, y)[0]
        p[at] = before - 1e-3
        down = tagger.gradients(x, y)[0]
        p[at] = before
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3, name


def test_licenses(spark, odd, empty):
    rng = random.Random(9)
    texts = ["Released under the MIT License. " + prose(rng, 50), prose(rng, 30) + " Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", prose(rng, 80), "x CC BY-NC y cc by nc"]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i]["labels"] for i in range(5)] == ["mit", "apache-2", "gpl-3", "", "cc-by-nc"]
    assert [rows[i]["n_base"] for i in range(5)] == [1, 1, 0, 0, 2]
    assert (rows[0]["first_word"], rows[1]["first_word"], rows[4]["first_word"], rows[4]["last_word"]) == (1, 33, 1, 5)
    long = prose(rng, 20) + " " + licenses.TEMPLATES[5][1].replace("without restriction", "without any restriction") + " " + prose(rng, 20)
    one = licenses.scan_licenses(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert one["labels"] == "mit" and 0.6 <= one["score"] < 1
    led = ["Licensed under the GNU General Public License, version 3", "This program is licensed under the GNU General Public License version 2.", "You may use it under the terms of the MIT License", "text: Creative Commons Attribution-ShareAlike 4.0 International", "GNU General Public License"]
    found = licenses.scan_licenses(spark.createDataFrame([(i, f"{prose(rng, 9)} {t} {prose(rng, 9)}") for i, t in enumerate(led)], "doc_id long, text string"))
    assert [r["labels"] for r in found.orderBy("doc_id").collect()] == ["gpl-3", "gpl-2", "mit", "cc-by-sa", ""]
    assert licenses.scan_licenses(odd).count() == len(odd_rows())
    assert licenses.scan_licenses(empty).count() == 0


def test_audio_alignment(spark):
    rng = np.random.default_rng(1)
    melody = [rng.normal(size=64) for _ in range(30)]
    rows = [(i, [float(x) for x in m]) for i, m in enumerate(melody)] + [(100, [float(x) for x in melody[0] + rng.normal(scale=0.05, size=64)]), (101, [float(x) for x in melody[3]]), (102, None), (103, [])]
    rec = audio.rendered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = audio.find_recordings(rec, F.col("rec_id") % 20 == 0).collect()
    links = {(r["rec_id"], r["match_id"]) for r in found if r["match_id"] is not None}
    assert (0, 100) in links and {r["class_id"] for r in found if r["rec_id"] in (3, 101)} == {3}
    assert {r["rec_id"] for r in found} == {r[0] for r in rows}
    pcm = bytes(rec.where("rec_id = 0").first()["pcm"])
    a, b = audio.fingerprint(pcm), audio.fingerprint(pcm[2 * 10 * audio.HOP :])
    block = lambda i, x: (np.array([i]), np.array([0, len(x)]), x)
    hit = audio.align(block(1, b), block(2, a))
    assert hit and hit[0][2] == 10 and hit[0][4] < 0.05
    assert audio.find_recordings(rec.limit(0), F.col("rec_id") % 20 == 0).count() == 0


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, words string, n_words int, kept boolean, want string, cid long, fp string, best string, lang_pred string"


def test_stages_judge_rows_not_ids(spark):
    """One id on a good and on a bad row, repeated rows, extra columns of clashing names, null ids; then an empty table."""
    import corpus_pipeline as p

    rng = random.Random(14)
    tail = ("r", "w", 7, None, "x", 5, "f", "b", "zz")
    good = [prose(rng, 60) for _ in range(9)]
    rows = [(i, t, "en", "s", len(t), *tail) for i, t in enumerate(good)]
    rows += [(1, "too short", "en", "s", 9, *tail), rows[2], (3, None, None, None, None, *tail), (None, good[4] + " and more of it", "en", "s", 1, *tail), (5, good[6], "en", "s", 1, *tail)]
    docs = spark.createDataFrame(rows, CLASHING).repartition(3)
    columns = docs.columns
    docs = p.materialize(p.quality_rules(spark, docs, ""))
    assert docs.columns == columns and sorted(r["text"] for r in docs.collect()) == sorted(r[1] for r in rows if r[1] and r[1] != "too short")
    docs = p.materialize(p.language_id(spark, docs, ""))
    assert docs.columns == columns and docs.count() == 12
    docs = p.materialize(p.near_duplicates(spark, docs, ""))
    assert docs.columns == columns
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted((5 if i == 6 else i, t) for i, t in enumerate(good))
    docs = p.personal_data(spark, docs, "")
    assert docs.columns == columns and {r["cid"] for r in docs.collect()} == {5}
    assert p.best_fit_packing(spark, docs, "").count() == 9
    docs = spark.createDataFrame([], CLASHING)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_registry():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(oracle_sql()) <= set(queries())


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    rng = random.Random(2)
    texts = [prose(rng, 60) + f" mail u{i}@x.example." for i in range(12)] + ["short", None, prose(rng, 20) + " ###" * 40]
    texts.append(texts[0])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    columns, kept = docs.columns, []
    for _, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, ""))
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept == [13, 13, 12, 12]
    assert all("[EMAIL]" in r["text"] and r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert p.STAGES[-1][1](spark, docs, "").select("doc_id").distinct().count() == 12
