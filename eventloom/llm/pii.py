"""Personal data: base patterns, and a character BiLSTM-CRF that adds what they can't write.

The patterns (email, ip, card, phone) run over every whole text in linear time.  The tagger
reads overlapping windows; every stretch of text that holds a digit or an ``@``, an "at" (in
brackets or on its own) before a dotted or spelt domain, or an "at" with a "dot" soon after,
lies in some window.  A character's tag comes from the window in whose middle half it stands, so
windows are reconciled over the whole text; adjoining tags become spans, which must pass the
kind's own check (Luhn, number ranges, digit counts) and not touch a base match.  A base match
that failed its check bars only itself: a card with a number beside it is still found.

The tagger is trained on a bounded sample (``SAMPLE`` texts) whose labelled spans are the
base matches, with generated variants set into the same texts; a table without such texts
trains on the generated ones alone.

Nulls count as empty text (no spans); repeated rows are scanned each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, small_batches
from .tagger import CharTagger

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
SAMPLE, EPOCHS = 500, 8
#: Windows with a generated string that the tagger trains on: some 80 of its rarest form.
GENERATED = 5400
#: Mean probability that a span's tags need.
CONFIDENT = 0.9
#: Windows decoded in one go.
BLOCK = 256

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_DIGIT_RUNS = re.compile(r"[0-9]+")
#: An "at" in brackets or on its own, before a dotted or spelt domain.
_AT = r"(?:[\[(]\s*(at)\s*[\])]|\b(at)\b)\s*[a-z0-9-]+\s*(?:\.\s*[a-z0-9-]|[\[(]?\s*dot\b)"
_CUE = re.compile(r"[0-9@]|" + _AT + r"|\bat\b.{1,60}?\bdot\b", re.S | re.I)
_AT_SIGN = re.compile(_AT, re.I)
_SPELT_AT = re.compile(r"(?:@|[\[(]\s*at\s*[\])]|\sat\s)", re.I)
_SPELT = re.compile(r"[A-Za-z0-9._%+-]+\s*[\[(]?\s*(?:@|at)\s*[\])]?\s*[A-Za-z0-9-]+(?:\s*(?:\.|[\[(]?\s*dot\s*[\])]?)\s*[A-Za-z0-9-]+)+", re.I)

#: Character classes of the tagger (fixed values): these signs one by one, others by kind; an "at" before a domain has its own, and its "dot" is a dot.
_SIGNS = "@.-+_%()[]/:,;'\"=#&*|<>!?"
_CLASSES = 9 + len(_SIGNS)


def _class_table() -> np.ndarray:
    table = np.full(0x250, 7, np.int64)
    for c in range(0x250):
        ch = chr(c)
        if "0" <= ch <= "9":
            table[c] = 1
        elif ch.isalpha():
            table[c] = (2 if ch.islower() else 3) if c < 128 else 4
        elif ch == "\n":
            table[c] = 6
        elif ch.isspace():
            table[c] = 5
        elif ch in _SIGNS:
            table[c] = 8 + _SIGNS.index(ch)
    return table


_TABLE = _class_table()


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = _TABLE[np.minimum(points, len(_TABLE) - 1)]
    for m in _AT_SIGN.finditer(text):
        out[slice(*m.span(m.lastindex))] = _CLASSES - 1
        if m[0][-3:].lower() == "dot":
            out[m.end() - 3 : m.end()] = _TABLE[ord(".")]
    return out


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def passes(kind: str, match: str) -> bool:
    """The kind's own check of a match."""
    digits = "".join(_DIGITS.findall(match))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", match)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            low = m.end()
            yield start, low
        at = text.find("@", max(at + 1, low))


def base_matches(text: str) -> list[tuple[str, int, int, bool]]:
    """``(kind, start, end, passes)`` of the base patterns, by kind and start; linear in the text."""
    found = [("email", a, b, True) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            found += [(kind, m.start(), m.end(), passes(kind, m[0])) for m in pattern.finditer(text)]
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def tags_of(n: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """0 outside, 1 + 2k at the first and 2 + 2k at later characters of a span of kind k."""
    tags = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


def _window_starts(text: str) -> list[int]:
    """Starts of the windows, ``STRIDE`` apart, that a cue lies in."""
    last, out = max(0, -(-(len(text) - WINDOW) // STRIDE)), set()
    at = 0
    while m := _CUE.search(text, at):
        first, stop = m.start() // STRIDE, (m.end() - 1) // STRIDE
        out.update(k for k in range(first - 2, stop + 3) if 0 <= k <= last)
        at = max(m.end() if m.end() - m.start() < 2 else m.start() + 1, (first + 1) * STRIDE if m.end() - m.start() < 2 else 0)
    return [k * STRIDE for k in sorted(out)]


def tagged_spans(tagger: CharTagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans of each text, windows reconciled over the whole of it."""
    jobs = [(i, s) for i, t in enumerate(texts) for s in _window_starts(t)]
    cells: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    classes = {i: classes_of(texts[i]) for i in {i for i, _ in jobs}}
    for at in range(0, len(jobs), BLOCK):
        some = jobs[at : at + BLOCK]
        x = np.zeros((len(some), WINDOW), np.int64)
        for r, (i, s) in enumerate(some):
            own = classes[i][s : s + WINDOW]
            x[r, : len(own)] = own
        tags, share = tagger.decode(x.T)
        for r, (i, s) in enumerate(some):
            cells.setdefault(i, []).append((s, tags[:, r], share[:, r]))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    quarter = (WINDOW - STRIDE) // 2
    for i, windows in cells.items():
        n = len(texts[i])
        tags, share = np.zeros(n, np.int64), np.zeros(n)
        had = {s for s, _, _ in windows}
        for s, t, q in windows:
            a = 0 if s == 0 or s - STRIDE not in had else quarter
            b = min(WINDOW, n - s) if s + STRIDE not in had else min(WINDOW - quarter, n - s)
            tags[s + a : s + b], share[s + a : s + b] = t[a:b], q[a:b]
        kind = (tags + 1) // 2
        cuts = np.flatnonzero(np.diff(kind, prepend=0, append=0))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if kind[a] and share[a:b].mean() >= CONFIDENT:
                out[i].append((KINDS[kind[a] - 1], int(a), int(b)))
    return out


def _card_within(s: str) -> tuple[int, int] | None:
    """The longest run of whole digit groups that passes as a card: a number beside it may be tagged with it."""
    groups = [m.span() for m in _DIGIT_RUNS.finditer(s)]
    runs = []
    for i, (a, _) in enumerate(groups):
        n = 0
        for c, b in groups[i:]:
            n += b - c
            if n > 19:
                break
            if passes("card", s[a:b]):
                runs.append((n, a, b))
    return max(runs, key=lambda r: (r[0], -r[1]))[1:] if runs else None


def _sound(text: str, kind: str, a: int, b: int) -> tuple[str, int, int] | None:
    """The span without blanks around it, if it is whole and passes its kind's check; of a run of numbers, the card in it."""
    while a < b and text[a].isspace():
        a += 1
    while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:("):
        b -= 1
    s = text[a:b]
    whole = not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
    if not whole or not s:
        return None
    if kind == "email":
        ok = _SPELT.fullmatch(s) is not None and _SPELT_AT.search(s) is not None
    elif kind == "phone":
        ok = passes(kind, s) and re.fullmatch(r"[+(]?[0-9][0-9\x20()./-]+[0-9]", s) is not None and re.search(r"[\x20()./-]", s) is not None
    elif kind == "card":
        if not passes(kind, s) and (inner := _card_within(s)):
            s, a, b = s[slice(*inner)], a + inner[0], a + inner[1]
        ok = passes(kind, s) and re.fullmatch(r"[0-9][0-9\x20./-]+[0-9]", s) is not None
    else:
        ok = passes(kind, s) and re.fullmatch(r"[0-9]+(?:\s?[.\[(]+(?:dot)?[\])]?\s?[0-9]+){3}", s) is not None
    return (kind, a, b) if ok else None


def _barred(span: tuple[str, int, int], match: tuple[str, int, int, bool]) -> bool:
    """A base span bars what touches it; a match that failed its check bars the same span of its kind."""
    (kind, a, b), (k, c, d, ok) = span, match
    return c < b and a < d if ok else (k, c, d) == span


def all_spans(texts: list[str], tagger: CharTagger | None) -> list[tuple[list, list]]:
    """``(base spans, added spans)`` of each text."""
    more = tagged_spans(tagger, texts) if tagger else [[] for _ in texts]
    out = []
    for text, found in zip(texts, more):
        matches = base_matches(text)
        sound = [x for s in found if (x := _sound(text, *s)) and not any(_barred(x, m) for m in matches)]
        out.append(([(k, a, b) for k, a, b, ok in matches if ok], sound))
    return out


def _variant(rng: random.Random) -> tuple[str, str | None]:
    """A generated string and the kind of its span; None for one that only looks like it."""
    word = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pick = rng.randrange(20)
    if pick < 3:
        return f"{word(rng.randint(3, 9))}{rng.choice(['', '.', '_', num(2)])}{word(3)}@{word(5)}{rng.choice(['', num(1)])}.{rng.choice(['example.com', 'org', 'net'])}", "email"
    if pick < 7:
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" [at] ", "."), ("(at)", "."), (" at ", "."), (" at ", ".")])  # the last is the hardest to tell from prose
        return f"{word(6)}{at}{word(5)}{dot}{rng.choice(['com', 'org', 'net'])}", "email"
    if pick < 11:
        return rng.choice([".", "[.]", "(.)", "[dot]", "(dot)", " . "]).join(str(rng.randint(0, 255)) for _ in range(4)), "ip"
    if pick < 13:
        sep = rng.choice(["", " ", "-", "."])
        digits = num(15)
        digits += next(d for d in "0123456789" if luhn(digits + d))
        return sep.join(digits[i : i + 4] for i in range(0, 16, 4)), "card"
    if pick < 16:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {a} {b}{c}", f"{a}.{b}.{c}", f"0{a}/{b}-{c}"]), "phone"
    return rng.choice([num(2), num(4), f"{num(1)}.{num(1)}", f"{num(3)},{num(3)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"20{num(2)}-0{rng.randint(1, 9)}-1{num(1)}", f"version {num(1)}.{num(1)}.{num(1)}", f"@{word(6)}", num(9)]), None


def training_windows(texts: list[str], seed: int = 3, plain: int = GENERATED) -> tuple[np.ndarray, np.ndarray]:
    """Windows of classes and tags: base matches where they stand, and generated variants put in."""
    rng = random.Random(seed)
    xs, ys = [], []

    def add(text: str, spans: list[tuple[str, int, int]], around: int) -> None:
        s = max(0, min(around - rng.randrange(WINDOW), len(text) - WINDOW))
        x, y = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
        x[: len(text) - s] = classes_of(text)[s : s + WINDOW]
        y[: len(text) - s] = tags_of(len(text), spans)[s : s + WINDOW]
        xs.append(x), ys.append(y)

    for text in texts:
        spans = [(k, a, b) for k, a, b, ok in base_matches(text) if ok]
        for _, a, _ in spans[:4]:
            add(text, spans, a)
    pool = texts or ["no text at hand here, so these few words stand in for one and are used again."]
    for _ in range(plain):
        text = rng.choice(pool)
        around = rng.randrange(max(1, len(text) - 2 * WINDOW)) if len(text) > 2 * WINDOW else 0
        text = _DIGITS.sub("", text[around : around + 2 * WINDOW]).replace("@", "")
        made, kind = _variant(rng)
        cut = text.find(" ", rng.randrange(max(1, len(text)))) + 1
        if kind == "card" and rng.random() < 0.4:  # a number beside it is not part of it
            beside = f"{rng.randrange(10, 10000)} "
            text, cut = text[:cut] + beside + text[cut:], cut + len(beside)
        add(text[:cut] + made + " " + text[cut:], [(kind, cut, cut + len(made))] if kind else [], cut)
    return np.stack(xs), np.stack(ys)


def fit(docs: DataFrame, sample: int = SAMPLE) -> CharTagger:
    """Train the tagger on at most ``sample`` texts that hold a cue, chosen by a hash of the id."""
    some = doc_text(docs).where(F.col("text").rlike("[0-9@]"))
    n = some.count()
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("pii")), F.lit(1_000_000)) / 1_000_000

    def near_cues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            for t in batch.column(1).to_pylist():
                m = _CUE.search(t)
                s = max(0, m.start() - 4 * WINDOW) if m else 0
                out.append(t[s : s + 8 * WINDOW])
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], ["doc_id", "text"])

    small_batches(docs.sparkSession)
    cut = some.where(draw < min(1.0, 2 * sample / max(n, 1))).mapInArrow(near_cues, "doc_id long, text string")
    rows = cut.orderBy(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("pii")), "doc_id", "text").limit(sample).collect()
    texts = [t for _, t in sorted((r["doc_id"] or 0, r["text"]) for r in rows)]
    x, y = training_windows(texts)
    return CharTagger(_CLASSES, 1 + 2 * len(KINDS)).fit(x, y, EPOCHS)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame, tagger: CharTagger | None = None) -> DataFrame:
    """Counts and digest of the base spans, and all spans, one row per row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(tagger or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, more in all_spans([t or "" for t in batch.column(1).to_pylist()], model.value):
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                out.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], [f.split()[0] for f in FOUND.split(", ")])

    small_batches(docs.sparkSession)
    return doc_text(docs).mapInArrow(run, FOUND)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind; of overlapping spans the first, longest one counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: CharTagger | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]``."""
    model = docs.sparkSession.sparkContext.broadcast(tagger or fit(docs))
    schema = docs.schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = all_spans([t or "" for t in texts], model.value)
            new = [None if t is None else redacted(t, base + more) for t, (base, more) in zip(texts, spans)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, pa.string()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)
