"""Byte-level BPE encoding and decoding with tiktoken over a local rank file.

Long texts are split first at safe boundaries (before a space that follows a non-space
character), so that one call's working set stays bounded; the ids are those of the whole.
Decoding joins the tokens' raw bytes, so it is exact for any id sequence.

Nulls encode as empty text (no ids); rows repeat as they come; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_text, small_batches

#: Characters of text that one call of the library gets, unless no boundary comes.
SPAN_CHARS = 50_000
_BOUNDARY = re.compile(r"(?<=\S)(?= )")

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class ByteBPE:
    """Encode and decode with the ranks in ``path`` and the pattern ``pattern``."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimal = [b"%d" % i for i in range(max(ranks.values()) + 1)]

    def spans(self, text: str) -> Iterator[str]:
        """``text`` in spans of about ``SPAN_CHARS`` characters, cut at safe boundaries alone."""
        start = 0
        while len(text) - start > SPAN_CHARS:
            if not (m := _BOUNDARY.search(text, start + SPAN_CHARS)):
                break
            yield text[start : m.start()]
            start = m.start()
        yield text[start:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= SPAN_CHARS:
            return self.enc.encode_ordinary(text)
        ids: list[int] = []
        for span in self.spans(text):
            ids += self.enc.encode_ordinary(span)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.enc.decode_bytes(ids)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` of every row: the token ids of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(ranks_path, pattern)
        for batch in batches:
            ids = [bpe.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return doc_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, decoded)``: the raw bytes of each row's ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(ranks_path, pattern)
        for batch in batches:
            raw = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "decoded"])

    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode the ids, and give digests of both (one pass, nothing shuffled)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(ranks_path, pattern)
        decimal = bpe.decimal.__getitem__
        for batch in batches:
            n, ids_sha, raw_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text) if text else []
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b" ".join(map(decimal, ids))).hexdigest())
                raw_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return doc_text(docs).mapInArrow(run, DIGESTS)
