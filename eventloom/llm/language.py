"""Language identification by a byte convolutional network, trained here in numpy.

Bytes of a fixed-length window are embedded; filters of several widths slide over them; each
filter's maximum over the window feeds a softmax over the languages.  A text is scored on all
its windows, end to end, and the windows' probabilities are averaged by their letters.

Training takes a bounded sample of labelled rows (``PER_LANGUAGE`` texts a language,
``WINDOWS_PER_TEXT`` windows each), chosen by a hash of the id; every label is learned, however
rare, and prediction covers every byte.

A null text, or one without a letter, is ``und`` with score 0.  With no labelled row at all,
every text is ``und``.  Repeated rows are scored each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 12, 6
#: Columns of spaces after a window, so that the widest filter starts at each of its bytes.
PAD = max(WIDTHS) - 1
PER_LANGUAGE, WINDOWS_PER_TEXT = 400, 3
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters lower-cased, other ASCII as spaces, bytes of other characters as they are.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def windows(text: str) -> np.ndarray:
    """All of the text's bytes, folded, in rows of ``WINDOW`` (the last one filled with spaces)."""
    raw = b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" "
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW), np.uint8).reshape(n, WINDOW)


@dataclass
class ByteConvNet:
    """Parameters of the network and its two passes."""

    labels: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, labels: list[str], rng: np.random.Generator) -> ByteConvNet:
        filters = [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls(labels, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, n**-0.5, (n, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))

    def bank(self) -> np.ndarray:
        """All filters side by side, the narrower ones filled up with zeros."""
        out = np.zeros((max(WIDTHS) * EMBED, len(WIDTHS) * FILTERS), np.float32)
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            out[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = f
        return out

    def features(self, rows: np.ndarray, places: list | None = None) -> np.ndarray:
        """Every filter's maximum (at least 0) over each window; ``places`` gets where it stood."""
        padded = np.pad(rows, ((0, 0), (0, PAD)), constant_values=32)
        x = np.take(self.embed, padded, axis=0).reshape(len(rows), -1)
        size = max(WIDTHS) * EMBED
        patches = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::EMBED]).reshape(-1, size)
        z = (patches @ self.bank()).reshape(len(rows), WINDOW, -1)
        if places is not None:
            places.append(z.argmax(axis=1))
        return np.maximum(z.max(axis=1) + np.concatenate(self.bias), 0)

    def probabilities(self, rows: np.ndarray, block: int = 64) -> np.ndarray:
        out = [softmax(self.features(rows[i : i + block]) @ self.out + self.out_bias) for i in range(0, len(rows), block)]
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def gradients(self, rows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, in the order of :meth:`parameters`."""
        places: list[np.ndarray] = []
        h = self.features(rows, places)
        delta = softmax(h @ self.out + self.out_bias)
        delta[np.arange(len(rows)), target] -= 1
        delta /= len(rows)
        back = (delta @ self.out.T) * (h > 0)
        padded = np.pad(rows, ((0, 0), (0, PAD)), constant_values=32)
        d_embed, d_filters, d_bias = np.zeros_like(self.embed), [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            at = places[0][:, k * FILTERS : (k + 1) * FILTERS, None] + np.arange(w)
            taken = padded[np.arange(len(rows))[:, None, None], at]
            patch = self.embed[taken].reshape(len(rows), FILTERS, w * EMBED)
            d_filters.append(np.einsum("bf,bfp->pf", g, patch))
            d_bias.append(g.sum(axis=0))
            np.add.at(d_embed, taken.ravel(), (g[:, :, None] * f.T[None]).reshape(-1, EMBED))
        return [d_embed, *d_filters, *d_bias, h.T @ delta, delta.sum(axis=0)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, target: np.ndarray, labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> ByteConvNet:
    """Fit the network by Adam on windows and their label numbers."""
    rng = np.random.default_rng(seed)
    net = ByteConvNet.new(labels, rng)
    params = net.parameters()
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            mine, t = order[i : i + batch], t + 1
            for p, g, m, v in zip(params, net.gradients(rows[mine], target[mine]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def spread(rows: np.ndarray, n: int = WINDOWS_PER_TEXT) -> np.ndarray:
    """``n`` of the windows at equal distances over the whole text."""
    return rows[np.unique(np.linspace(0, len(rows) - 1, n).astype(int))]


def training_windows(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """``(lang, window)`` from about ``per_language`` texts a language, chosen by a hash of the id in one scan."""
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not counts:
        return []
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["n"])))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1_000_000)) / 1_000_000

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, texts = (c.to_pylist() for c in batch.columns)
            out = [(i, lang, w.tobytes()) for i, lang, t in zip(ids, langs, texts) if _LETTER.search(t) for w in spread(windows(t))]
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.binary()))], ["doc_id", "lang", "window"])

    small_batches(labelled.sparkSession)
    some = labelled.where(draw < share[F.col("lang")]).select("doc_id", "lang", "text").mapInArrow(cut, "doc_id long, lang string, window binary")
    return sorted((r["lang"], bytes(r["window"])) for r in some.collect())


def fit(labelled: DataFrame) -> ByteConvNet | None:
    """Train on rows ``(doc_id, text, lang)`` with non-null text and label."""
    rows = training_windows(labelled.where("text is not null and lang is not null"))
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    return train(np.stack([np.frombuffer(w, np.uint8) for _, w in rows]), np.array([labels.index(lang) for lang, _ in rows]), labels)


def predict(docs: DataFrame, net: ByteConvNet | None, *carried: str) -> DataFrame:
    """``(*carried, lang_pred, score)`` of every row's whole text; only ``text`` decides.

    ``text`` is a column, or else a field of a carried struct ``row``.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)
    within = "text" not in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            last = batch.column(batch.num_columns - 1)
            texts = [None if t is None else str(t) for t in (pc.struct_field(last, "text") if within else last).to_pylist()]
            some = [net is not None and bool(t) and _LETTER.search(t) is not None for t in texts]
            cut = [windows(t) for t, ok in zip(texts, some) if ok]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if cut:
                rows = np.concatenate(cut)
                weight = (rows > 32).sum(axis=1).astype(np.float64) + 1e-9
                starts = np.concatenate([[0], np.cumsum([len(x) for x in cut])[:-1]])
                p = np.add.reduceat(net.probabilities(rows) * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
                best = p.argmax(axis=1)
                for i, b, q in zip([i for i, ok in enumerate(some) if ok], best, p):
                    lang[i], score[i] = net.labels[b], float(min(1.0, q[b]))
            kept = [batch.column(i) for i in range(len(carried))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*carried, "lang_pred", "score"])

    small_batches(docs.sparkSession)
    given = docs.select(*carried, *([] if within else [docs["text"].cast("string").alias("text")]))
    schema = StructType([*given.schema.fields[: len(carried)], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return given.mapInArrow(run, schema)


def identify(docs: DataFrame, held_out, carry: bool = False) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learn where ``held_out`` is false, predict everywhere.

    With ``carry`` the result is ``(held_out, row, lang_pred, score)``, each document as a struct.
    """
    marked = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"), held_out.alias("held_out"))
    net = fit(marked.where("not held_out").select("doc_id", "text", "lang"))
    if carry:
        return predict(docs.select(held_out.alias("held_out"), F.struct(docs["*"]).alias("row")), net, "held_out", "row")
    return predict(marked, net, "doc_id", "held_out")
