"""Secrets, token alignment and the manifest against plain Python, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from eventloom.llm import alignment, chunks, manifest, secrets
from eventloom.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, tree string, pos long, pair string"
A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
WORDS = "the river takes a slow turn past old mills where children fish under green willows each spring".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, repeated rows, one id on several rows; clashing extra columns."""
    rng = random.Random(4)
    texts = [None, "", " ", "one", "É ü 👍 \x85 \x1c", "x" * 5000, prose(rng, 900), "a▁b", "see <|endoftext|> <s>  twice\n\n done ", "ABC abcẞ"]
    rows = [(i, t, "en" if i % 3 else "de", "s", 3, 1, "t", 2, "p") for i, t in enumerate(texts)]
    rows += [(20 + i, prose(rng, 5), "fr", None, None, 1, "t", 2, "p") for i in range(70)]
    return [*rows, rows[6], rows[6], (6, "other", "en", None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None, None), (99, None, "", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# The manifest.


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """Leaves, trees and proofs one node at a time."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def grow(digests: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
        paths, where = [[] for _ in digests], list(range(len(digests)))
        while len(digests) > 1:
            for i, at in enumerate(where):
                run = at // 8 * 8
                paths[i].append((digests[run:at], digests[at + 1 : run + 8]))
                where[i] = at // 8
            digests = [h(*digests[k : k + 8]) for k in range(0, len(digests), 8)]
        return digests[0], paths

    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = h(*map(field, (doc_id, source, lang, n_chars, text)))
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        trees[lang].append((doc_id is not None, doc_id, leaf, h(*map(field, (doc_id, source, lang, n_chars, lower(text)))) if bad else leaf))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown = {}
    for lang in langs:
        trees[lang].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        grown[lang] = grow([x[2] for x in trees[lang]])
    root, tops = grow([grown[lang][0] for lang in langs])
    out = []
    for top, lang in zip(tops, langs):
        for (_, doc_id, leaf, found), own in zip(trees[lang], grown[lang][1]):
            for left, right in own + top:
                found = h(*left, found, *right)
            out.append((doc_id, leaf, grown[lang][0], root, h(*[x for run in own + top for side in run for x in side]), found, found == root))
    return out


def test_manifest_matches_plain_trees(spark, odd):
    key = lambda r: tuple(map(str, r))
    want = sorted(plain_manifest([r[:5] for r in odd_rows()]), key=key)
    assert sorted(map(tuple, manifest.manifest(odd).collect()), key=key) == want
    assert {r[-1] for r in want} == {True, False}
    for n, langs in ((1, 1), (9, 1), (66, 2), (20, 20)):
        rows = [(i, f"Text {i}", f"l{i % langs}", "s", i) for i in range(n)]
        got = manifest.manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)).collect()
        assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(rows), key=key), (n, langs)


def test_manifest_of_many_ranges(spark):
    """Repeated rows and ids over more ranges than rows of some trees."""
    rows = [(i // 3, "same" if i % 2 else None, None if i % 7 == 0 else f"l{i % 4 // 3}", "s", 1) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(13)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = Counter(map(tuple, manifest.manifest(docs).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == Counter(plain_manifest(rows))


def test_manifest_matches_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(manifest.ORACLE_SQL)
    got = manifest.manifest(spark.read.parquet(f"{SF}/documents.parquet"))
    assert want.columns == got.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_manifest_of_nothing(empty):
    assert manifest.manifest(empty).count() == 0


# Token alignment.


class PlainAligner:
    def __init__(self):
        import sentencepiece

        self.a = chunks.load_tokenizer(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.unit = chunks._bytes_of_unit()

    def piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def align(self, text: str | None) -> tuple:
        """Counts, the written groups, and each linked pair's number, by comparing every end."""
        if not text:
            return 0, 0, 0, 0, "", {}
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        sides = [bytes(self.unit[c] for c in self.a.id_to_token(i)) for i in a], [self.piece(i) for i in b]
        if any(b"".join(s) != (" " + text).encode() for s in sides):
            return 0, 0, 0, 0, "", {}
        a_ends, b_ends = (np.cumsum([len(x) for x in s]).tolist() for s in sides)
        groups, low = [], 0
        for end in sorted(set(a_ends) & set(b_ends)):
            groups.append(([i for i, e in zip(a, a_ends) if low < e <= end], [i for i, e in zip(b, b_ends) if low < e <= end]))
            low = end
        pairs = Counter((i, j) for x, y in groups for i in x for j in y)
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        return len(a), len(b), len(groups), pairs.total(), hashlib.sha256(written.encode()).hexdigest(), pairs


def plain_alignment(rows: list[tuple]) -> Counter:
    plain = PlainAligner()
    found = [(r[0], *plain.align(r[1])) for r in rows]
    held = Counter(p for *_, pairs in found for p in pairs)
    best: dict[int, int] = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    return Counter((i, *n, sum(k for p, k in pairs.items() if held[p] == best[p[0]]), sum(k * held[p] for p, k in pairs.items()), digest) for i, *n, digest, pairs in found)


def test_alignment_of_strange_texts(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 7)
    one, plain, rng = alignment.Aligner(A, B), PlainAligner(), random.Random(1)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", ".", "'s", "1", "é", "一", "\x85", "\xa0", "\x1c", "<|endoftext|>", " the", "​", "👍", "Ġ", "\r", "　", "\x00", "×", "́", "_", "-", "<s>", "<unk>", "<0x41>", "ﬁ", "word", "aaaaaaaa"]
    texts = ["".join(rng.choices(alphabet + ["▁"] * (k % 9 == 0), k=rng.randint(0, 14))) for k in range(3000)]
    for text, got in zip(texts, one.align(texts)):
        pairs = {(int(c) >> alignment.SHIFT, int(c) & (1 << alignment.SHIFT) - 1): int(n) for c, n in zip(got[5], got[6])}
        assert (*got[:5], pairs) == plain.align(text), repr(text)


def test_alignment_counts_long_groups_by_number(monkeypatch):
    monkeypatch.setattr(alignment, "LISTED", 3)
    one, plain = alignment.Aligner(A, B), PlainAligner()
    texts = ["x" * 3000, "Straßenbahnhaltestelle 一二三四五六 ооооооооооо", "antidisestablishmentarianism " * 5]
    for text, got in zip(texts, one.align(texts)):
        pairs = {(int(c) >> alignment.SHIFT, int(c) & (1 << alignment.SHIFT) - 1): int(n) for c, n in zip(got[5], got[6])}
        assert (*got[:5], pairs) == plain.align(text)


def test_galloping_finds_what_sets_find():
    rng = np.random.default_rng(2)
    for _ in range(300):
        sides = [[np.unique(rng.integers(1, 60, rng.integers(1, 40))) for _ in range(4)] for _ in range(2)]
        flat, starts = [np.concatenate(s) for s in sides], [np.cumsum([0, *map(len, s)]) for s in sides]
        i, j = alignment.common_ends(*flat, *starts)
        want = [(starts[0][s] + p, starts[1][s] + q) for s in range(4) for p, x in enumerate(sides[0][s]) for q, y in enumerate(sides[1][s]) if x == y]
        assert list(zip(i.tolist(), j.tolist())) == want


def test_alignment_matches_brute_force(spark, odd, empty):
    """The whole smallest table, in two tiers of which the broadcast one is large, small or empty."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = plain_alignment([tuple(r) for r in docs.collect()])
    for frequent in (1 << 18, 200, 0):
        assert Counter(map(tuple, alignment.align_tokens(docs.repartition(4), A, B, frequent).collect())) == want
    assert Counter(map(tuple, alignment.align_tokens(odd, A, B, 5).collect())) == plain_alignment(odd_rows())
    assert alignment.align_tokens(empty, A, B).count() == 0


# Secrets.

PLAIN = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def plain_base(text: str) -> list[tuple[str, int, int]]:
    fits = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if fits[k](m)]


def test_base_secrets_match_plain_patterns(spark):
    rng = random.Random(7)
    parts = ["password", "PassWd", "secret", "toKen", "token", "api_key", "APIKEY", "ſecret", "'", '"', " ", "  ", ":", "=", "abc", "Zz9+/_.-", "AKIA", "AKIAQ7", "0123456789abcdef", "deadbeef", "é", "\n", "x"]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert secrets.base_spans(text) == plain_base(text), repr(text)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in secrets.detect(docs).collect():
        base = plain_base(texts[r["doc_id"]] or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(base, key=lambda s: (s[1], list(PLAIN).index(s[0]))))
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for k, _, _ in base) for kind in PLAIN]
        assert set(filter(None, written.split(","))) <= set(r["spans"].split(","))


def test_battery_matches_simulation():
    """Under either hypothesis each probability is (nearly) as often below a level as it says, at each length."""
    rng = np.random.default_rng(3)
    weights = np.concatenate([np.full(40, 1e-4), rng.dirichlet(np.full(22, 8.0))])
    weights /= weights.sum()
    pairs = np.zeros((128, 128))
    own = [ord(c) for c in secrets.ALPHABETS["base62"]]
    pairs[np.ix_(own, own)] = 1e6 * np.outer(weights, weights)
    ordinary = secrets.Ordinary.of("base62", pairs)
    for n in (16, 32, 100):
        uniform = [ordinary.probabilities(rng.integers(0, 62, n))[0] for _ in range(1500)]
        words = [ordinary.probabilities(rng.choice(62, n, p=weights))[1] for _ in range(1500)]
        assert all(np.mean(np.array(ps) < level) < 1.8 * level for ps in (uniform, words) for level in (0.05, 0.01)), n
    power = [np.mean([ordinary.probabilities(rng.integers(0, 62, n))[1] < 1e-4 for _ in range(300)]) for n in (16, 24, 40)]
    assert power[0] < power[2] and power[2] > 0.95


def test_step_up_is_the_usual_rule():
    rng = random.Random(5)
    for _ in range(200):
        depths = [min(int(rng.expovariate(0.05)), 320) for _ in range(rng.randint(1, 60))]
        ps = sorted(10 ** (-d / secrets.BINS) for d in depths)
        passed = [p for i, p in enumerate(ps, 1) if p <= secrets.RATE * i / len(ps)]
        least = secrets.step_up(dict(Counter(depths)))
        assert sum(d >= least for d in depths) == (sum(p <= passed[-1] for p in ps) if passed else 0)


def test_secrets_are_told_from_names(spark, odd, empty):
    rng = random.Random(8)
    token = lambda symbols, n: "".join(rng.choice(symbols) for _ in range(n))
    made = {"base62": 40, "base64": 44, "base64 url": 43, "hex upper": 32}
    rows, want = [], {}
    for i in range(400):
        text = prose(rng, 40)
        if i % 4 == 0:
            encoding = list(made)[i // 4 % len(made)]
            secret = token(secrets.ALPHABETS[encoding], made[encoding])
            text = f"{text[:50]} {secret} {text[50:]}"
            want[i] = secret
        elif i % 4 == 1:
            text += " the_river_takes_a_slow_turn src/green/willows/spring/mills TheRiverTakesASlowTurnPastOldMills 2024-01-05-12-30-59-0001 " + "xy" * 30
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    battery = secrets.fit(docs)
    found = {r["doc_id"]: [rows[r["doc_id"]][1][int(a) : int(b)] for _, a, b in (s.split(":") for s in r["spans"].split(",") if s)] for r in secrets.detect(docs, battery).collect()}
    hit = sum(found[i] == [s] for i, s in want.items())
    assert hit >= 0.9 * len(want), (hit, len(want))
    assert {s for i in range(400) if i not in want for s in found[i]} == set()
    assert battery.ordinary.keys() == secrets.ALPHABETS.keys()
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs, battery).collect()}
    assert sum("[SECRET]" in masked[i] and want[i] not in masked[i] for i in want) == hit
    rows = secrets.detect(odd).collect()
    assert len(rows) == len(odd_rows()) and all(r["spans"] == "" for r in rows)
    assert secrets.redact(odd).schema == odd.schema and secrets.redact(odd).where("text is null").count() == 2
    assert secrets.detect(empty).count() == 0 and secrets.redact(empty).count() == 0


def test_secrets_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (secrets.fit(docs.repartition(n)) for n in (1, 9))
    assert one == many


def test_probability_helpers():
    assert math.isclose(secrets.upper_normal(1.959964), 0.025, rel_tol=1e-4)
    assert math.isclose(secrets.upper_poisson(3, 2.0), 1 - math.exp(-2) * (1 + 2 + 2), rel_tol=1e-9)
    assert math.isclose(secrets.cauchy([0.2, 0.2]), 0.2, rel_tol=1e-9)


def test_the_table_of_frequent_words_decides_no_count(spark, monkeypatch):
    """No table, one word, and what the sample gives: the library's counts each time."""
    from tokenizers import Tokenizer

    from eventloom.llm import tokens

    rows = [(i, t) for i, t in enumerate(["the cat the dog", "the  the\n the", None, "", "naïve café " * 9, "dog " * 40 + "zebra"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for words in (None, [], ["the"]):
        if words is not None:
            monkeypatch.setattr(tokens, "frequent_pretokens", lambda docs, rows, words=words: words)
        assert sorted((r["doc_id"], r["n_tokens"]) for r in tokens.count_tokens(docs, path).collect()) == want
