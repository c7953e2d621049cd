"""Cutting texts where no byte-level pre-token can cross, and token ids of the pieces.

The pre-token pattern never joins a non-space character to a space that follows it, and its
white-space rule looks no further than the run itself.  So a text may be cut before every
space (U+0020) that follows a non-space character, and the pieces encode separately to the
ids of the whole.  Pieces repeat as words do, so a bounded cache answers most of them.
"""

from __future__ import annotations

import os
import re

import numpy as np

SPECIAL = "<|endoftext|>"
#: Pieces that a worker's cache holds before it starts anew.
CACHE_PIECES = 400_000
#: Pieces longer than this are encoded each time and never kept.
LONGEST_KEPT = 64
_SPACE_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def pieces(text: str) -> list[str]:
    """``text`` in pieces that encode separately; all but the first begin with a space.

    >>> pieces("a bc  d")
    ['a', ' bc', '  d']
    """
    return _CUT.split(text)


def load_tokenizer(path: str):
    """The ``tokenizers`` file at ``path``, single-threaded (Spark spreads the work)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Text on which both libraries' character classes are known to agree (letters, digits, common signs).
_PLAIN = re.compile("[\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*")
#: Letters, then signs and whatever follows them: the pattern always begins a token at that sign.
_HEAD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+)([!-/:-@\\[-`{-~].*)", re.S).fullmatch


def _bytes_of_unit() -> dict[str, int]:
    """The byte that each character of the vocabulary's printable alphabet stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceEncoder:
    """Token ids of whole texts, as the library gives them, through a bounded piece cache.

    Pieces of plain letters and signs that the cache lacks go to tiktoken's merge routine over
    the same file's vocabulary, which gives the same ids in less time; all others go to the
    library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.tok = load_tokenizer(path)
        self.cache: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        vocab, unit = self.tok.get_vocab(with_added_tokens=False), _bytes_of_unit()
        vocab.pop(SPECIAL, None)
        ranks = {bytes(map(unit.__getitem__, t)): i for t, i in vocab.items()}
        self.merge = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.opens = np.zeros(max(vocab.values()) + 2, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True

    def library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _misses(self, words: list[str]) -> list[bytes]:
        """Ids of pieces `` word``: one call for all, cut at the tokens that open with a space."""
        joined = " " + " ".join(words)
        plain = _PLAIN.fullmatch(joined)
        ids = np.array(self.merge(joined) if plain else self.tok.encode(joined, add_special_tokens=False).ids, "<u4")
        at = np.flatnonzero(self.opens[ids])
        if len(at) == len(words) and at[0] == 0:
            raw, at = ids.tobytes(), [*(at * 4).tolist(), len(ids) * 4]
            return [raw[a:b] for a, b in zip(at, at[1:])]
        return [np.array(x.ids, "<u4").tobytes() for x in self.tok.encode_batch([" " + w for w in words], add_special_tokens=False)]

    def _made(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pieces that the cache lacks.  Letters and the signs after them are looked up apart."""
        cut = {w: m.groups() for w in words if (m := _HEAD(w))}
        bare = [w for w in dict.fromkeys(cut[w][0] if w in cut else w for w in words) if w not in self.cache]
        made = dict(zip(bare, self._misses(bare))) if bare else {}
        kept = {w: x for w, x in made.items() if len(w) <= LONGEST_KEPT}
        for w, (head, tail) in cut.items():
            if (x := self.tails.get(tail)) is None:
                x = self.library(tail)
                if len(tail) <= LONGEST_KEPT and len(self.tails) < CACHE_PIECES // 8:
                    self.tails[tail] = x
            h = self.cache.get(head)
            made[w] = (made[head] if h is None else h) + x
        self._room(len(kept))
        self.cache.update(kept)
        return made

    def _room(self, n: int) -> None:
        if len(self.cache) + n > CACHE_PIECES:
            self.cache = {}

    def parts(self, text: str) -> list[bytes]:
        """The ids of ``text`` in order, piece by piece, as little-endian unsigned 32-bit numbers."""
        if not text:
            return []
        if SPECIAL in text:
            out = []
            for k, segment in enumerate(text.split(SPECIAL)):
                out += ([self.library(SPECIAL)] if k else []) + self.parts(segment)
            return out
        if "  " in text or _SPACE_AFTER_SPACE.search(text):
            return list(map(self._run, pieces(text)))
        first, *words = text.split(" ")
        got = self.looked_up(words)
        return [self.library(first), *got] if first else got

    def looked_up(self, words: list[str]) -> list[bytes]:
        """Ids of the pieces `` word``, from the cache or made anew."""
        got = list(map(self.cache.get, words))
        if None in got:
            where = [i for i, x in enumerate(got) if x is None]
            made = self._made(list(dict.fromkeys([words[i] for i in where])))
            for i in where:
                got[i] = made[words[i]]
        return got

    def ids(self, text: str) -> bytes:
        return b"".join(self.parts(text))

    def count(self, text: str, lengths: dict[str, int] | None = None) -> int:
        """Number of tokens; ``lengths`` answers frequent pieces (without leading space) first."""
        if lengths is None or SPECIAL in text or "  " in text or _SPACE_AFTER_SPACE.search(text):
            return sum(map(len, self.parts(text))) // 4
        first, *words = text.split(" ")
        got = list(map(lengths.get, words))
        rest = [w for w, n in zip(words, got) if n is None]
        known = sum(filter(None, got)) + (len(self.library(first)) // 4 if first else 0)
        return known + (sum(map(len, self.looked_up(rest))) // 4 if rest else 0)

    def _run(self, piece: str) -> bytes:
        if piece[0] != " " or len(piece) > LONGEST_KEPT:
            return self.library(piece)
        if (x := self.cache.get(piece[1:])) is None:
            self._room(1)
            x = self.cache[piece[1:]] = self.library(piece)
        return x
