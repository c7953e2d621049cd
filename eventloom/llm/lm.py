"""Language-model scores by logistic context mixing over bits.

A text is a sequence of bytes with an end symbol; a byte is a path of bits in a Huffman tree
of the training bytes.  Four predictors, each a table of bit counts hashed by the last 1, 2,
3 or 5 bytes and the node in the tree, give log-odds; a weight set chosen by a gate (depth in
the tree, kind of the last byte) adds them up; a refinement table over gate and sum turns the
result into the final probability.  Training makes two passes over all texts.  The first counts
bits, by fold of the texts.  The second mixes online: it goes through each shard of the texts in
the order of a hash, predicts a block of bits from the weights as they are, notes in the
refinement table what came of those predictions, and only then moves the gate's weights by the
block's errors.  A text is predicted from the counts of the other folds, so it never teaches from
its own counts, nor from those of its copies, and its refinement corrects weights that it didn't
set.  Shards hold about ``SHARD_BYTES`` bytes, so their number grows with the corpus; their weights
are averaged by the curvature they saw and their refinements are summed.  Folds, shards and their
order follow from hashes of the rows, and all sums are of whole numbers, so a score depends
neither on the order of rows nor on how they are partitioned.

A predictor's slots follow the training bytes: one for every ``BYTES_PER_SLOT``, as a power of
two from 2^``LEAST_BITS`` to 2^``MOST_BITS``, which bounds what a worker and the driver hold.
Beyond that more text sharpens the counts but contexts share slots.

A window of a byte and the five before it decides all slots, so counting and scoring, whose tables
stand still meanwhile, expand equal windows of a portion of texts once: counts are added as many
times as a window is there, and a window's cost is handed to every place that holds it.

The base score needs every token's training count.  A broadcast table of bounded size holds
the frequent words; rarer ones are joined to the count table in Spark.

A null text is empty: its one token is the end.  Texts are expanded ``CHUNK`` bytes at a time, so
a very long one costs memory only for its bytes.  With no training rows, every count is 0 and
the model knows nothing (each bit costs one bit).  Repeated rows are scored each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

ORDERS = (1, 2, 3, 5)
#: Slots of a predictor's table, as a power of two, and the training bytes for each.
LEAST_BITS, MOST_BITS, BYTES_PER_SLOT = 16, 19, 256
#: Gates: depth in the tree (at most DEPTHS), times the kind of the last byte.
DEPTHS, KINDS = 10, 4
GATES = DEPTHS * KINDS
#: Steps of the refinement table over log-odds from -RANGE to RANGE.
STEPS, RANGE = 128, 10.0
PRIOR = 0.35
BLOCK_BITS = 32_768
#: Parts of the texts, by a hash of their bytes: training predicts each from the counts of the others.
FOLDS = 4
#: Training bytes of a shard, about, and bits of one gate after which its weights move.
SHARD_BYTES, ONLINE_BITS = 8 << 20, 16384
#: Weights are held near their start as by so many bits of curvature 1, and within these bounds.
HELD, LEAST_WEIGHT, MOST_WEIGHT = 20.0, -1.0, 2.0
#: Log-odds are held in eighths, as bytes, so that the tables stay in a core's cache.
EIGHTHS = 8
#: Bytes of text that are expanded into bits at a time.
CHUNK = 1 << 20
#: Bytes of a fold that a task gathers before it adds them to its tables.
SEEN_BYTES = 1 << 20
#: Slots of a block of counts: tasks hand on whole blocks, not slots.
BLOCK_SLOTS = 4096
#: Tasks whose blocks are summed in one group; their sums are summed then.
TASKS_PER_SUM = 64
#: Words of the broadcast table at most.
FREQUENT = 200_000
#: Words that a task counts before it hands on what it has.
COUNTER_WORDS = 300_000
END, PAD = 0xFF, max(ORDERS)
_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
_KIND = np.array([0 if c in b" \t\n\r\x0b\x0c\xff" else 1 if chr(c).isalpha() and c < 128 else 2 if c >= 128 else 3 for c in range(256)], np.int32)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@dataclass
class Code:
    """A Huffman tree by depth: each byte's node (hashed) and bit there, and how long its path is."""

    length: np.ndarray
    salt: np.ndarray
    bit: np.ndarray
    slot_bits: int = 18

    @property
    def slots(self) -> int:
        return 1 << self.slot_bits

    @classmethod
    def of(cls, counts: dict[int, int]) -> Code:
        heap: list[tuple[int, int, tuple]] = [(1 + 256 * counts.get(b, 0), b, (b,)) for b in range(256)]
        heapq.heapify(heap)
        paths: dict[int, list[tuple[int, int]]] = {b: [] for b in range(256)}
        node = 255
        while len(heap) > 1:
            (n, _, left), (m, tie, right) = heapq.heappop(heap), heapq.heappop(heap)
            node -= 1
            for side, members in enumerate((left, right)):
                for b in members:
                    paths[b].append((node, side))
            heapq.heappush(heap, (n + m, 256 + tie, left + right))
        length = np.array([len(paths[b]) for b in range(256)], np.uint8)
        salt, bit = np.zeros((int(length.max()), 256), np.uint32), np.zeros((int(length.max()), 256), np.float32)
        for b in range(256):
            for depth, (node, side) in enumerate(reversed(paths[b])):
                salt[depth, b], bit[depth, b] = node * 0x2545F491 * 0x9E3779B1 & 0xFFFFFFFF, side
        bits = int(math.log2(max(sum(counts.values()) / BYTES_PER_SLOT, 1)))
        return cls(length, salt, bit, min(max(bits, LEAST_BITS), MOST_BITS))


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after PAD end symbols and before one; and where each text's own start."""
    pad, end = bytes([END]) * PAD, bytes([END])
    buf = np.frombuffer(b"".join([x for t in texts for x in (pad, t, end)]), np.uint8)
    sizes = np.array([len(t) + PAD + 1 for t in texts], np.int64)
    return buf, np.cumsum(sizes) - sizes + PAD


def hashed(nearest: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Hashes of the last 1, 2, 3 ... of ``ORDERS`` bytes, which are given nearest first."""
    h = np.uint32(0)
    for k, (multiply, c) in enumerate(zip(_MULTIPLY, nearest), 1):
        h = np.add(h, c, out=h if k > 1 else None, dtype=np.uint32)
        h += np.uint32(1)
        h *= multiply
        h ^= h >> np.uint32(15)
        if k in ORDERS:
            yield h * np.uint32(0x9E3779B1)


class Bits:
    """The bits of the bytes at ``at``, gate by gate.

    Bytes are ordered by the kind of the byte before them and then by the length of their
    paths, longest first, so that those of one kind which still have a bit at some depth are a
    slice of every array: a gate's weights are plain numbers.
    """

    def __init__(self, buf: np.ndarray, at: np.ndarray, code: Code):
        self.code = code
        most = len(code.bit)
        rank = _KIND[buf[at - 1]] * (most + 1) + (most - code.length[buf[at]].astype(np.int32))
        self.order = np.argsort(rank.astype(np.uint8 if KINDS * (most + 1) < 256 else np.uint16), kind="stable")
        low, high = int(at[0]), int(at[-1]) + 1
        at = at[self.order]
        self.sym = buf[at]
        self.hashes = [h.take(at - low) for h in hashed(buf[low - k : high - k] for k in range(1, max(ORDERS) + 1))]
        sizes = np.bincount(rank, minlength=KINDS * (most + 1)).reshape(KINDS, most + 1)
        self.first = np.concatenate([[0], sizes.sum(axis=1).cumsum()])
        self.there = sizes.cumsum(axis=1)

    def blocks(self, most_bits: int = BLOCK_BITS) -> Iterator[tuple[slice, int, np.ndarray, list[np.ndarray]]]:
        """``(bytes, gate, bits, slots by predictor)`` of at most ``most_bits`` bits of one gate."""
        most = len(self.code.bit)
        for kind in range(KINDS):
            for depth in range(most):
                first, n = int(self.first[kind]), int(self.there[kind, most - depth - 1])
                for i in range(first, first + n, most_bits):
                    span = slice(i, min(i + most_bits, first + n))
                    sym = self.sym[span]
                    salt = self.code.salt[depth].take(sym)
                    slots = [h[span] + salt for h in self.hashes]
                    for x in slots:
                        x >>= np.uint32(32 - self.code.slot_bits)
                    yield span, min(depth, DEPTHS - 1) * KINDS + kind, self.code.bit[depth].take(sym), slots


#: Steps per unit of log-odds, and the probability in the middle of each step.
_PER_UNIT = np.float32(STEPS / (2 * RANGE))
_MIDDLE = (np.arange(STEPS) + 0.5) / float(_PER_UNIT) - RANGE
_SQUASH = (1 / (1 + np.exp(-_MIDDLE))).astype(np.float32)
#: Shards hand on curvatures in whole parts of this size, so that their sums are exact in any order.
PARTS = 64


def in_eighths(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(odds * EIGHTHS), -127, 127).astype(np.int8)


def mixed_steps(weights: np.ndarray, stretched: list[np.ndarray]) -> np.ndarray:
    """The refinement step of the weighted sum of log-odds."""
    w = (weights * (_PER_UNIT / EIGHTHS)).astype(np.float32)
    x = w[0] * stretched[0]
    for k in range(1, len(ORDERS)):
        x += w[k] * stretched[k]
    x += np.float32(STEPS / 2)
    np.maximum(x, np.float32(0), out=x)
    np.minimum(x, np.float32(STEPS - 1), out=x)
    return x.astype(np.intp)


def own_bytes(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the bytes of laid-out texts and their ends are, the symbols before each left out."""
    own = np.ones(len(buf), bool)
    own[(starts[:, None] - 1 - np.arange(PAD)).ravel()] = False
    return np.flatnonzero(own)


def windows(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes at ``at`` (ascending), each with the PAD before it in one number: itself in the highest place, the farthest in the lowest."""
    low, high = int(at[0]), int(at[-1]) + 1
    wide = np.append(buf[low - PAD : high], np.zeros(7 - PAD, np.uint8))
    every = np.ndarray(high - low, "<u8", wide, strides=(1,)) & np.uint64((1 << 8 * (PAD + 1)) - 1)
    return every if len(at) == len(every) else every.take(at - low)


def sums_of_runs(keys: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ascending ``keys``, and how often each is there (or its sum of ``times``)."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys.take(first), np.diff(first, append=len(keys)) if times is None else np.add.reduceat(times, first)


def representatives(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(chosen, of)``, so that ``keys[chosen][of]`` is ``keys``.

    Equal keys share one, by a table of places hashed by the keys; a key that lost its slot to
    another is chosen wherever it stands.
    """
    bits = max(len(keys).bit_length() + 1, 10)
    slot = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)
    here, place = np.arange(len(keys), dtype=np.int32), np.empty(1 << bits, np.int32)
    place[slot] = here
    found = place.take(slot)
    lost = np.flatnonzero(keys.take(found) != keys)
    found[lost] = lost
    chosen = np.flatnonzero(found == here)
    number = place[: len(keys)]
    number[chosen] = np.arange(len(chosen), dtype=np.int32)
    return chosen, number.take(found)


def by_fold(texts: list[bytes]) -> list[list[bytes]]:
    """The texts of each fold; copies share theirs."""
    folds: list[list[bytes]] = [[] for _ in range(FOLDS)]
    for t in texts:
        folds[xxhash.xxh64_intdigest(t) % FOLDS].append(t)
    return folds


def portions(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """``(number of the first, texts)`` in runs of about CHUNK bytes; a longer text is alone."""
    first, some, size = 0, [], 0
    for i, t in enumerate(texts):
        if some and size + len(t) > CHUNK:
            yield first, some
            first, some, size = i, [], 0
        some.append(t)
        size += len(t) + PAD + 1
    if some:
        yield first, some


def blocks_of(texts: list[bytes], code: Code, most_bits: int = BLOCK_BITS) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """``(gate, bits, slots by predictor)`` of all bits of the texts, in blocks."""
    for _, some in portions(texts):
        buf, starts = laid_out(some)
        at = own_bytes(buf, starts)
        for i in range(0, len(at), CHUNK):
            for _, gate, bit, slots in Bits(buf, at[i : i + CHUNK], code).blocks(most_bits):
                yield gate, bit, slots


class BitCounts:
    """One task's bit counts, by predictor, fold and slot.

    A window of a byte and the bytes before it decides the slots of all its bits, so windows are
    sorted, and those of one predictor's order that are equal are counted at once.
    """

    def __init__(self, code: Code):
        self.code = code
        self.counts = np.zeros((len(ORDERS), FOLDS, code.slots, 2), np.int32)
        self.seen: list[list[np.ndarray]] = [[] for _ in range(FOLDS)]
        self.n_seen = [0] * FOLDS

    def learn(self, texts: list[bytes]) -> None:
        for fold, some in enumerate(by_fold(texts)):
            for _, few in portions(some):
                buf, starts = laid_out(few)
                at = own_bytes(buf, starts)
                for i in range(0, len(at), CHUNK):
                    self.seen[fold].append(windows(buf, at[i : i + CHUNK]))
                    self.n_seen[fold] += len(self.seen[fold][-1])
                    if self.n_seen[fold] > SEEN_BYTES:
                        self._add(fold)

    def _add(self, fold: int) -> None:
        if not self.seen[fold]:
            return
        keys = np.concatenate(self.seen[fold])
        self.seen[fold], self.n_seen[fold] = [], 0
        keys.sort()
        times, longest = None, PAD
        for k, order in reversed(list(enumerate(ORDERS))):
            keys, times = sums_of_runs(keys >> np.uint64(8 * (longest - order)), times)
            longest = order
            self._count(self.counts[k, fold].reshape(-1), order, keys, times.astype(np.int32))

    def _count(self, counts: np.ndarray, order: int, keys: np.ndarray, times: np.ndarray) -> None:
        """Add every bit of the windows ``keys`` of ``order + 1`` bytes, ``times`` each."""
        sym = (keys >> np.uint64(8 * order)).astype(np.uint8)
        *_, h = hashed((keys >> np.uint64(8 * (order - k))).astype(np.uint8) for k in range(1, order + 1))
        length = self.code.length.take(sym)
        for depth, (salt, bit) in enumerate(zip(self.code.salt, self.code.bit)):
            there = np.flatnonzero(length > depth)
            if len(there) < len(sym):
                sym, h, length, times = (x.take(there) for x in (sym, h, length, times))
            slot = (h + salt.take(sym)) >> np.uint32(32 - self.code.slot_bits)
            np.add.at(counts, slot.astype(np.intp) * 2 + bit.astype(np.intp).take(sym), times)

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """``(number, counts)`` of ``BLOCK_SLOTS`` slots each, counted through all predictors and folds; empty ones are left out."""
        for fold in range(FOLDS):
            self._add(fold)
        for i, block in enumerate(self.counts.reshape(-1, BLOCK_SLOTS, 2)):
            if block.any():
                yield i, block


def weights_at_start() -> np.ndarray:
    return np.full((len(ORDERS), GATES), 1.2 / len(ORDERS))


class OnlineMixer:
    """Mixes online over one shard at a time, from the log-odds ``apart`` of the other folds.

    Texts of a shard must come in one fixed order; how they are cut into calls is of no account.
    """

    def __init__(self, code: Code, apart: np.ndarray):
        self.code, self.apart = code, apart
        #: Whole numbers over all shards that were closed: predictions and ones by gate and step, curvature, and weights by curvature.
        self.refined = np.zeros((2, GATES * STEPS), np.int64)
        self.curved, self.pulled = np.zeros((len(ORDERS), len(ORDERS), GATES), np.int64), np.zeros((len(ORDERS), GATES), np.int64)
        self._begin()

    def _begin(self) -> None:
        self.weights = weights_at_start()
        self.curve = np.zeros((GATES, len(ORDERS), len(ORDERS)))
        self.held: list[bytes] = []
        self.size = 0

    def learn(self, texts: list[bytes]) -> None:
        for t in texts:
            self.held.append(t)
            self.size += len(t) + PAD + 1
            if self.size > CHUNK:
                self._mix()

    def _mix(self) -> None:
        for fold, some in enumerate(by_fold(self.held)):
            for gate, bit, slots in blocks_of(some, self.code, ONLINE_BITS):
                self.step(gate, bit, [o.take(s, mode="clip") for o, s in zip(self.apart[fold], slots)])
        self.held, self.size = [], 0

    def step(self, gate: int, bit: np.ndarray, stretched: list[np.ndarray]) -> None:
        """Predict a block of bits of one gate, note the outcome, and move the gate's weights by the errors."""
        x = np.array(stretched, np.float32)
        z = (self.weights[:, gate] * (_PER_UNIT / EIGHTHS)).astype(np.float32) @ x
        z += np.float32(STEPS / 2)
        step = np.clip(z, np.float32(0), np.float32(STEPS - 1), out=z).astype(np.intp)
        here = slice(gate * STEPS, (gate + 1) * STEPS)
        zeros, ones = np.bincount(step + STEPS * bit.astype(np.intp), minlength=2 * STEPS).reshape(2, STEPS)
        self.refined[0, here] += zeros + ones
        self.refined[1, here] += ones
        p = _SQUASH.take(step, mode="clip")
        slope = x @ (bit - p) / EIGHTHS
        p -= p * p
        self.curve[gate] += (x * p) @ x.T / EIGHTHS**2
        move = np.linalg.solve(self.curve[gate] + HELD * np.eye(len(ORDERS)), slope)
        self.weights[:, gate] = np.clip(self.weights[:, gate] + move, LEAST_WEIGHT, MOST_WEIGHT)

    def close(self) -> None:
        """End a shard: what it saw joins the sums, and the next one starts anew."""
        self._mix()
        self.curved += np.rint(self.curve.transpose(1, 2, 0) * PARTS).astype(np.int64)
        self.pulled += np.rint(np.einsum("gij,jg->ig", self.curve, self.weights) * PARTS).astype(np.int64)
        self._begin()

    def rows(self) -> Iterator[pa.RecordBatch]:
        """``(kind, slot, a, b)``, to be summed: refinement (kind 0), weights by curvature (1), curvature (2)."""
        for kind, a, b in ((0, *self.refined), (1, self.pulled.ravel(), self.pulled.ravel()), (2, self.curved.ravel(), self.curved.ravel())):
            there = np.flatnonzero(a)
            columns = [np.full(len(there), kind, np.int32), there.astype(np.int32), a[there], b[there]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "slot", "a", "b"])


def averaged(kind: np.ndarray, slot: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The shards' weights, averaged by curvature; what none has seen stays at its start."""
    pulled, curved = np.zeros(len(ORDERS) * GATES), np.zeros(len(ORDERS) ** 2 * GATES)
    for x, k in ((pulled, 1), (curved, 2)):
        x[slot[kind == k]] = a[kind == k] / PARTS
    start, held = weights_at_start(), HELD * np.eye(len(ORDERS))
    pulled, curved = pulled.reshape(start.shape), curved.reshape(len(ORDERS), *start.shape)
    found = [np.linalg.solve(curved[:, :, g] + held, pulled[:, g] + HELD * start[:, g]) for g in range(GATES)]
    return np.clip(np.stack(found, axis=1), LEAST_WEIGHT, MOST_WEIGHT)


def counts_by_fold(code: Code, blocks: Iterator[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Summed counts of bits, and of ones, by fold, predictor and slot."""
    n, ones = (np.zeros((len(ORDERS), FOLDS, code.slots), np.float32) for _ in range(2))
    for i, block in blocks:
        n.reshape(-1, BLOCK_SLOTS)[i] = block.sum(axis=1)
        ones.reshape(-1, BLOCK_SLOTS)[i] = block[:, 1]
    return n.swapaxes(0, 1), ones.swapaxes(0, 1)


def log_odds(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return in_eighths(np.log((ones + np.float32(PRIOR)) / (n - ones + np.float32(PRIOR))))


def apart_odds(n: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """For each fold the log-odds that all the others give."""
    return np.stack([log_odds(n.sum(axis=0) - x, ones.sum(axis=0) - y) for x, y in zip(n, ones)])


@dataclass
class Mixture:
    """The trained model: tree, log-odds, weights, and cost in log10 by bit, gate and step."""

    code: Code
    odds: np.ndarray
    weights: np.ndarray
    cost: np.ndarray

    @classmethod
    def of(cls, code: Code, counts: tuple[np.ndarray, np.ndarray], refined: list[np.ndarray], weights: np.ndarray | None = None) -> Mixture:
        """From counts by fold and the summed rows of a refinement (empty lists for none)."""
        seen, ones = np.zeros(GATES * STEPS), np.zeros(GATES * STEPS)
        if len(refined):
            kind, slot, a, b = refined
            seen[slot[kind == 0]], ones[slot[kind == 0]] = a[kind == 0], b[kind == 0]
        p = np.clip((ones + 20 * np.tile(_SQUASH, GATES)) / (seen + 20), 1e-6, 1 - 1e-6)
        weights = weights_at_start() if weights is None else weights
        return cls(code, log_odds(*(x.sum(axis=0) for x in counts)), weights.astype(np.float32), np.log10(np.stack([1 - p, p])).astype(np.float32))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text, its end included."""
        total = np.zeros(len(texts))
        for first, some in portions(texts):
            total[first : first + len(some)] = self._portion(some)
        return total

    def _portion(self, texts: list[bytes]) -> np.ndarray:
        buf, starts = laid_out(texts)
        ends = starts + np.array([len(t) + 1 for t in texts])
        total = np.zeros(len(texts))
        at = np.concatenate([np.arange(s, e, dtype=np.int32) for s, e in zip(starts, ends)])
        of = np.repeat(np.arange(len(texts), dtype=np.int32), ends - starts)
        for i in range(0, len(at), CHUNK):
            some = at[i : i + CHUNK]
            chosen, same = representatives(windows(buf, some))
            bits = Bits(buf, some.take(chosen), self.code)
            cost = np.zeros(len(bits.order))
            for span, gate, bit, slots in bits.blocks():
                step = mixed_steps(self.weights[:, gate], [o.take(x, mode="clip") for o, x in zip(self.odds, slots)])
                step += STEPS * bit.astype(np.intp)
                cost[span] += self.cost[:, gate * STEPS : (gate + 1) * STEPS].ravel().take(step, mode="clip")
            by_window = np.empty(len(cost))
            by_window[bits.order] = cost
            total += np.bincount(of[i : i + CHUNK], by_window.take(same), len(texts))
        return total


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``(kind, word, n)`` over training rows: words (kind 0, the end as an empty word) and bytes (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        sizes = np.zeros(256, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(tokens(text))
                words[b""] += 1
                sizes += np.bincount(np.frombuffer((text or "").encode("utf-8", "surrogatepass") + bytes([END]), np.uint8), minlength=256)
            if len(words) > COUNTER_WORDS:
                yield _counted(0, words)
                words = Counter()
        yield _counted(0, words)
        yield _counted(1, {bytes([b]): int(n) for b, n in enumerate(sizes) if n})

    small_batches(docs.sparkSession)
    parts = docs.where("not held_out").select("text").mapInArrow(run, "kind int, word binary, n long")
    return parts.groupBy("kind", "word").agg(F.sum("n").alias("n"))


def _counted(kind: int, counts: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(counts), pa.int32()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["kind", "word", "n"])


def bit_counts(texts: DataFrame, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Counts by fold over all texts: each task packs its tables into blocks, which are summed in two steps."""
    shared = texts.sparkSession.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mixer, part = BitCounts(shared.value), TaskContext.get().partitionId() // TASKS_PER_SUM
        for batch in batches:
            mixer.learn([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(0).to_pylist()])
        for i, block in mixer.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["block", "part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(2 * BLOCK_SLOTS, np.int64)
        for x in table.column("counts"):
            # a task's own counts are 32 bits wide, sums 64
            total += np.frombuffer(x.as_buffer(), np.int32 if len(x.as_buffer()) == 8 * BLOCK_SLOTS else np.int64)
        return table.slice(0, 1).set_column(2, "counts", pa.array([total.tobytes()], pa.binary()))

    small_batches(texts.sparkSession)
    schema = "block int, part int, counts binary"
    parts = texts.mapInArrow(run, schema).groupBy("block", "part").applyInArrow(add, schema)
    found = parts.groupBy("block").applyInArrow(add, schema).select("block", "counts").toLocalIterator()
    return counts_by_fold(code, ((r["block"], np.frombuffer(r["counts"], np.int64).reshape(-1, 2)) for r in found))


def mixed_online(docs: DataFrame, code: Code, apart: np.ndarray, n_bytes: int) -> list[np.ndarray]:
    """``kind, slot, a, b`` summed over all shards of the training rows.

    A row's shard and place in it follow from its text and id together, so copies of one text
    are spread over the shards.
    """
    shared = docs.sparkSession.sparkContext.broadcast((code, apart))
    shards = max(1, round(n_bytes / SHARD_BYTES))
    placed = docs.where("not held_out").select("text", F.xxhash64("text", "doc_id").alias("place"))
    placed = placed.select("text", "place", F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, open_shard = OnlineMixer(*shared.value), None
        for batch in batches:
            for shard, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                if shard != open_shard and open_shard is not None:
                    mixer.close()
                open_shard = shard
                mixer.learn([(text or "").encode("utf-8", "surrogatepass")])
        mixer.close()
        yield from mixer.rows()

    small_batches(docs.sparkSession)
    ordered = placed.repartition("shard").sortWithinPartitions("shard", "place").select("text", "shard")
    t = ordered.mapInArrow(run, "kind int, slot int, a long, b long").groupBy("kind", "slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    return [t[name].to_numpy() for name in ("kind", "slot", "a", "b")]


def train(docs: DataFrame, code: Code, n_bytes: int) -> Mixture:
    """Train the mixture on all rows ``(doc_id, text, held_out)`` that are not held out, of ``n_bytes`` bytes."""
    counts = bit_counts(docs.where("not held_out").select("text"), code)
    found = mixed_online(docs, code, apart_odds(*counts), n_bytes)
    return Mixture.of(code, counts, found, averaged(*found[:3]))


def frequent_words(words: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """Words above the count at which at most ``most`` remain, from a histogram of count magnitudes."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    room, floor = most, None
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        if r["count"] > room:
            break
        room, floor = room - r["count"], r["level"]
    if floor is None:
        return {}
    found = words.where(level >= floor).select("word", "n").toArrow()
    return dict(zip(found["word"].to_pylist(), found["n"].to_pylist()))


SCORED = "part int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long, rare array<struct<word:binary,n:long>>"


def score(docs: DataFrame, held_out) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` of every row.

    Bits per byte count the end symbol as a byte.
    """
    marked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), held_out.alias("held_out"))
    counts = materialize(corpus_counts(marked))
    words = counts.where("kind = 0")
    whole = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_train, below = whole["n"], math.log10(whole["n"] + 0.5 * (whole["v"] + 1))
    sizes = {r["word"][0]: r["n"] for r in counts.where("kind = 1").collect()}
    code = Code.of(sizes)
    common = {w: math.log10(c + 0.5) - below for w, c in frequent_words(words).items()}
    shared = docs.sparkSession.sparkContext.broadcast((train(marked, code, sum(sizes.values())), common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (model, known), part, row = shared.value, TaskContext.get().partitionId(), 0
        names = [x.split()[0] for x in SCORED.split(", ")]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_tokens, n_known, base, ends = [], [], [], [0]
            words, times = [], []
            for text in texts:
                own = tokens(text)
                own.append(b"")
                got = list(map(known.get, own))
                if None in got:
                    rare = Counter([w for w, x in zip(own, got) if x is None])
                    got = [x for x in got if x is not None]
                    words += rare.keys()
                    times += rare.values()
                n_tokens.append(len(own)), n_known.append(len(got)), base.append(math.fsum(got)), ends.append(len(words))
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            total = model.scores(raw)
            rows = np.arange(row, row + len(texts))
            row += len(texts)
            columns = [pa.array(np.full(len(texts), part, np.int32)), pa.array(rows), batch.column(0), batch.column(2), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()), pa.array(list(map(len, raw)), pa.int64())]
            pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names)

    small_batches(docs.sparkSession)
    scored = materialize(marked.mapInArrow(run, SCORED))
    rare = scored.select("part", "row", F.explode("rare").alias("r")).select("part", "row", "r.word", F.col("r.n").alias("times"))
    cost = F.log10(F.coalesce("n", F.lit(0)) + 0.5) - below
    more = (
        rare.join(words.select("word", "n"), "word", "left")
        .groupBy("part", "row")
        .agg(F.sum(cost * F.col("times")).alias("more_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    )
    return scored.join(more, ["part", "row"], "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
        (F.col("score") * -math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
