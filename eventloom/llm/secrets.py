"""Secrets: base patterns, and a battery of randomness tests for what they can't name.

The base patterns (an assigned password or token, an access key id, a long hexadecimal run) are
scanned in every whole text, in linear time.  Every other run of 16 or more symbols is a
candidate.  Its encoding is inferred from its symbols, and three tests measure it there:

* chi-squared uniformity of the alphabet, by its coincidences (pairs of equal symbols);
* runs of digits and of other symbols: names change case and use joining signs, but seldom mix
  digits in;
* serial correlation of neighbouring symbols' ranks, in which both cases of a letter stand together.

Each test gives two probabilities: under a uniform alphabet, and under ordinary words.  What
ordinary words are is counted over all texts: how often each symbol follows each other one in
runs too short to be candidates (16,384 counters, whatever the corpus).  A test's probabilities
depend on the candidate's length, and so does its power.  The three are combined by Cauchy's
rule, which holds for dependent tests.

A candidate is a secret if uniformity isn't refuted (``ACCEPT``) and ordinary words are, at a
false discovery rate of ``RATE`` among the candidates of its encoding and length (Benjamini and
Hochberg's step-up rule in each stratum, over a histogram of all candidates' probabilities; the
histograms' size is fixed by their bins).  A short token must be much odder than a long one, and a
stratum full of ordinary names lets little through.  Candidates that touch a base span are left
to it.

Nulls count as empty text (no spans); repeated rows are scanned each and count each; an empty
table gives an empty result; a text without a blank is one run and is tested whole; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, small_batches

KINDS = ("assign", "access", "hex", "random")
#: Symbols that a candidate has at least.
SHORTEST = 16
#: False discoveries among the discoveries of a stratum, and the least probability under uniformity.
RATE, ACCEPT = 0.01, 0.001
#: Bins of a probability's exponent: so many to a power of ten, down to 1e-40.
BINS, DEEPEST = 8, 40

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}")

#: Encodings from the narrowest on, and their alphabets.
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "hex": _DIGIT + "abcdef",
    "hex upper": _DIGIT + "ABCDEF",
    "base32": "234567" + _UPPER,
    "base36": _DIGIT + _LOWER,
    "base36 upper": _DIGIT + _UPPER,
    "base62": _DIGIT + _UPPER + _LOWER,
    "base64": "+/" + _DIGIT + _UPPER + _LOWER,
    "base64 url": "-" + _DIGIT + _UPPER + "_" + _LOWER,
}
ALPHABETS = {e: "".join(sorted(s, key=lambda c: (c.lower(), c))) for e, s in ALPHABETS.items()}
_RANKS = {e: {ord(c): i for i, c in enumerate(s)} for e, s in ALPHABETS.items()}
_RANK = {e: np.array([_RANKS[e].get(c, -1) for c in range(128)], np.int64) for e in ALPHABETS}
_SETS = {e: frozenset(s) for e, s in ALPHABETS.items()}
_SYMBOL = np.array([bool(re.fullmatch(r"[A-Za-z0-9+/_-]", chr(c))) for c in range(256)])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns: each kind's leftmost matches that don't overlap, without those too short."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    # A run is matched whole, so one that is too short holds none that is long enough.
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def encoding_of(token: str) -> str | None:
    """The narrowest encoding that has all symbols of ``token``; None for numbers and for mixtures."""
    symbols = frozenset(token)
    if not symbols - _SETS["hex"] and not symbols - frozenset(_DIGIT):
        return None
    return next((e for e, s in _SETS.items() if symbols <= s), None)


def upper_normal(z: float) -> float:
    """P(Z >= z)."""
    return max(math.erfc(z / math.sqrt(2)) / 2, 1e-300)


def upper_poisson(k: int, mean: float) -> float:
    """P(X >= k), by the terms from k on or their complement; by Fisher's root beyond 1000."""
    if mean > 1000:
        return upper_normal(2 * (math.sqrt(max(k, 0)) - math.sqrt(mean)))
    term, total = math.exp(-mean), 0.0
    for i in range(k):
        total += term
        term *= mean / (i + 1)
    return min(1.0, max(1 - total, 1e-16))


def cauchy(ps: list[float]) -> float:
    """One probability from several, which may depend on one another; one near 1 counts as 0.99, so that it can't outweigh the others."""
    t = sum(1 / (p * math.pi) if p < 1e-12 else math.tan((0.5 - min(p, 0.99)) * math.pi) for p in ps) / len(ps)
    return 1 / (t * math.pi) if t > 1e12 else 0.5 - math.atan(t) / math.pi


@dataclass(frozen=True)
class Ordinary:
    """How ordinary words use an alphabet: coincidence of two and three symbols, changes between digits and others, products of neighbours.

    ``..._joint`` is the covariance of a place's change, or product, with the next one's, which shares a symbol.
    """

    digits: tuple[bool, ...]
    two: float
    three: float
    changes: float
    changes_joint: float
    product: float
    product_variance: float
    product_joint: float

    @classmethod
    def of(cls, encoding: str, pairs: np.ndarray) -> Ordinary:
        """From the 128 x 128 counts of neighbouring symbols, each pair of the alphabet counted once more.

        An alphabet of one case takes words of both, since capitals spell the same words.
        """
        symbols = ALPHABETS[encoding]
        own, other = [ord(c) for c in symbols], [ord(c.swapcase()) for c in symbols]
        p = pairs[np.ix_(own, own)] + 1.0
        if not (any(map(str.islower, symbols)) and any(map(str.isupper, symbols))):
            letters = np.array([c.isalpha() for c in symbols])
            p += pairs[np.ix_(other, other)] * (letters[:, None] | letters)
        p /= p.sum()
        q, k = p.sum(1), len(own)
        digits, x = np.array([c.isdigit() for c in symbols]), np.arange(k) - (k - 1) / 2
        change, before, after = (digits[:, None] != digits).astype(float), p / p.sum(0), p / p.sum(1)[:, None]
        changes, product = float((p * change).sum()), float((p * np.outer(x, x)).sum())
        joint = float((q * (before * change).sum(0) * (after * change).sum(1)).sum()) - changes**2
        products_joint = float((q * x**2 * (x @ before) * (after @ x)).sum()) - product**2
        return cls(tuple(digits.tolist()), float((q**2).sum()), float((q**3).sum()), changes, joint, product, float((p * np.outer(x, x) ** 2).sum()) - product**2, products_joint)

    def probabilities(self, ranks: np.ndarray) -> tuple[float, float]:
        """``(under uniformity, under ordinary words)`` of a token's ranks."""
        n, k = len(ranks), len(self.digits)
        counts = np.bincount(ranks, minlength=k)
        same = int((counts * (counts - 1)).sum())
        mean = n * (n - 1) * self.two
        spread = 2 * n * (n - 1) * (self.two - self.two**2) + 4 * n * (n - 1) * (n - 2) * (self.three - self.two**2)
        alphabet = upper_poisson(same // 2, n * (n - 1) / (2 * k)), upper_normal((mean - same) / math.sqrt(max(spread, 1e-12)))
        digit, share = np.array(self.digits)[ranks], sum(self.digits) / k
        changes, w = int((digit[1:] != digit[:-1]).sum()), 2 * share * (1 - share)
        even = (abs(changes - (n - 1) * w) - 0.5) / math.sqrt((n - 1) * w * (1 - w) + 2 * (n - 2) * (w / 2 - w * w))
        mean, spread = (n - 1) * self.changes, math.sqrt(max((n - 1) * self.changes * (1 - self.changes) + 2 * (n - 2) * self.changes_joint, 1e-12))
        # Rare changes are too skew for a normal tail.
        often = max(upper_normal((changes - 0.5 - mean) / spread), upper_poisson(changes, mean)) if self.changes < 0.5 else upper_normal((mean - changes - 0.5) / spread)
        runs = min(1.0, 2 * upper_normal(even)), often
        x = ranks - (k - 1) / 2
        product = float((x[1:] * x[:-1]).sum())
        away = (n - 1) * self.product - product if self.product > 0 else product - (n - 1) * self.product
        spread = math.sqrt(max((n - 1) * self.product_variance + 2 * (n - 2) * self.product_joint, 1e-12))
        serial = 2 * upper_normal(abs(product) / (math.sqrt(n - 1) * (k * k - 1) / 12)), upper_normal(away / spread)
        return tuple(cauchy(list(ps)) for ps in zip(alphabet, runs, serial))


def candidates(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, str]]:
    """``(start, end, encoding)`` of whole runs that no base span touches."""
    taken = sorted((a, b) for _, a, b in base)
    at = 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while at < len(taken) and taken[at][1] <= a and (at + 1 == len(taken) or taken[at + 1][0] >= taken[at][0]):
            at += 1
        if any(x < b and a < y for x, y in taken[max(at - 2, 0) : at + 2]):
            continue
        beside = (text[a - 1] if a else " ") + (text[b] if b < len(text) else " ")
        if not beside[0].isalnum() and not beside[1].isalnum() and (e := encoding_of(m[0])):
            yield a, b, e


def stratum(encoding: str, n: int) -> int:
    """Encoding and length (two bands for each doubling, all beyond 2^20 together) as one number."""
    return list(ALPHABETS).index(encoding) * 64 + min(int(2 * math.log2(n)), 40)


def depth(p: float) -> int:
    return min(int(-math.log10(max(p, 1e-300)) * BINS), DEEPEST * BINS)


def neighbours(docs: DataFrame) -> np.ndarray:
    """How often each symbol follows each other one in ordinary words, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 14, np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                raw = np.frombuffer(_CANDIDATE.sub(" ", text or "").encode("utf-8", "surrogatepass"), np.uint8)
                known = _SYMBOL[raw]
                both = np.flatnonzero(known[1:] & known[:-1])
                total += np.bincount(raw[both].astype(np.int64) * 128 + raw[both + 1], minlength=1 << 14)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["pair", "n"])

    small_batches(docs.sparkSession)
    rows = doc_text(docs).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 14)
    for r in rows:
        out[r["pair"]] = r["n"]
    return out.reshape(128, 128)


@dataclass(frozen=True)
class Battery:
    """Ordinary use of each alphabet, and how deep a candidate of each stratum must lie."""

    ordinary: dict[str, Ordinary]
    least: dict[int, int]

    def measured(self, text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int, float, int]]:
        """``(start, end, stratum, probability under uniformity, depth under ordinary words)`` of each candidate."""
        for a, b, e in candidates(text, base):
            uniform, words = self.ordinary[e].probabilities(_RANK[e][np.frombuffer(text[a:b].encode(), np.uint8)])
            yield a, b, stratum(e, b - a), uniform, depth(words)

    def spans(self, text: str) -> tuple[list, list]:
        """``(base spans, added spans)``."""
        base = base_spans(text)
        return base, [("random", a, b) for a, b, s, uniform, d in self.measured(text, base) if uniform >= ACCEPT and d >= self.least.get(s, DEEPEST * BINS + 1)]


def step_up(counts: dict[int, int], rate: float = RATE) -> int:
    """The least depth that is discovered: the deepest i of m lie at a probability of at most i * rate / m."""
    m, seen, least = sum(counts.values()), 0, DEEPEST * BINS + 1
    for d in sorted(counts, reverse=True):
        seen += counts[d]
        if 10 ** (-d / BINS) <= rate * seen / m:
            least = d
    return least


def fit(docs: DataFrame, rate: float = RATE) -> Battery:
    """Two passes over all texts: how words use their symbols, then how deep candidates lie."""
    pairs = neighbours(docs)
    first = Battery({e: Ordinary.of(e, pairs) for e in ALPHABETS}, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            for text in batch.column(1).to_pylist():
                for _, _, s, _, d in first.measured(text or "", base_spans(text or "")):
                    seen[s, d] = seen.get((s, d), 0) + 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in range(2)] + [pa.array([seen[k] for k in keys], pa.int64())], ["stratum", "depth", "n"])

    rows = doc_text(docs).mapInArrow(run, "stratum long, depth long, n long").groupBy("stratum", "depth").agg(F.sum("n").alias("n")).collect()
    counts: dict[int, dict[int, int]] = {}
    for r in rows:
        counts.setdefault(r["stratum"], {})[r["depth"]] = r["n"]
    return Battery(first.ordinary, {s: step_up(c, rate) for s, c in counts.items()})


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def detect(docs: DataFrame, battery: Battery | None = None) -> DataFrame:
    """Counts and digest of the base spans, and all spans, one row per row of ``docs``."""
    own = battery or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, more = own.spans(text or "")
                out.append((*[sum(k == kind for k, _, _ in base) for kind in KINDS[:3]], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [f.split()[0] for f in FOUND.split(", ")])

    small_batches(docs.sparkSession)
    return doc_text(docs).mapInArrow(run, FOUND)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every stretch that spans cover replaced by one ``[SECRET]``."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, battery: Battery | None = None) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; null texts stay null, other columns as they are."""
    own = battery or fit(docs)
    at = docs.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text in batch.column(at).to_pylist():
                base, more = own.spans(text) if text else ([], [])
                new.append(redacted(text, base + more) if text else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, pa.string()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
