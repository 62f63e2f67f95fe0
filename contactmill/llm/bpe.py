"""Byte-pair encoding and decoding of stored texts by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one last token that the
merge procedure can leave at its end. The tokens ending at a position come from
an automaton over the vocabulary (longest first); a token is the right one if
the last token of the prefix before it stays next to it, which a test on the
pair alone decides. Following the stored tokens back from the end gives the
ids, exactly those that repeated merging gives.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactmill.llm.rows import RecentCache, map_rows

# Fixed values of the byte-level scheme: the split of a text before merging,
# and what counts as white space there.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# Bounds of what a worker remembers.
CACHED_PIECES, CACHED_WORDS, CACHED_PAIRS = 250_000, 80_000, 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class PrefixEncoder:
    """Encoder and decoder of one vocabulary file (byte-level BPE with a merge list)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        # The bytes by id; the place after the largest id stands for all unknown ones and is empty, as are gaps.
        self.unknown = max(self.bytes_of) + 1
        self.table = pa.array([self.bytes_of.get(i, b"") for i in range(self.unknown + 1)], pa.binary())
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        # (left, right) -> (rank, merged), and the same the other way round
        self.merged, self.parts = {}, {}
        for rank, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else m for m in spec["model"]["merges"]):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = rank
            self.parts.setdefault(both, (rank, left, right))
        self.fits = RecentCache(CACHED_PAIRS, lambda pair: 1 + self._fits(pair >> 32, pair & 0xFFFFFFFF))
        self.tails = ahocorasick.Automaton()
        for i in vocab.values():
            if i not in self.parts or self._fits(self.parts[i][1], self.parts[i][2], self.parts[i][0]):
                self.tails.add_word(self.bytes_of[i].decode("latin-1"), (len(self.bytes_of[i]), i))
        self.tails.make_automaton()
        self.split = regex.compile(SPLIT)
        self.pieces = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.of_piece = RecentCache(CACHED_PIECES, self._encode_piece)
        self.of_word = RecentCache(CACHED_WORDS, self._encode_word)

    def _fits(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether merging leaves ``left`` and ``right`` side by side.

        Undo the merges of both tokens, latest first. If at some moment the two
        parts at the seam could merge by a rule that comes before all merges
        undone so far, the merge procedure would have joined them.
        """
        first = float("inf") if below is None else below
        while True:
            rank = self.merged.get((left, right))
            if rank is not None and rank < first:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # Of equal ranks the leftmost pair goes first: the right token is undone first,
            # and the seam goes before an equal merge inside the right token.
            if b is None or (a is not None and a[0] > b[0]):
                first, left = a[0], a[2]
            else:
                first, right = b[0] + 1, b[1]

    def _encode_word(self, word: str) -> bytes:
        octets = word.encode()
        last, starts = [0] * len(octets), [0] * len(octets)  # of the prefix that ends with each byte
        done, known, fill = -1, self.fits.new, self.fits.fill
        for end, (length, token) in self.tails.iter(octets.decode("latin-1")):
            if end == done:
                continue
            start = end - length
            if start >= 0:
                pair = last[start] << 32 | token
                if (known.get(pair) or fill(pair)) == 1:
                    continue
                known = self.fits.new
            last[end], starts[end], done = token, start, end
        ids, at = [], len(octets) - 1
        while at >= 0:
            ids.append(last[at])
            at = starts[at]
        ids.reverse()
        return array("I", ids).tobytes()

    def _encode_piece(self, piece: str) -> bytes:
        # Plain letters, with or without a space before them, are one word, which this cache remembers already.
        if piece.isascii() and (piece[1:] if piece[0] == " " else piece).isalpha():
            return self._encode_word(piece)
        known, fill = self.of_word.new, self.of_word.fill
        return b"".join([known.get(word) or fill(word) for word in self.split.findall(piece)])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.cut.split(text or "") if self.cut else [text or ""]
        out = []
        for n, part in enumerate(parts):
            if n % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                pieces, cache = self.pieces.findall(part), self.of_piece
                found = list(map(cache.new.get, pieces))
                if None in found:
                    found = [ids or cache.new.get(piece) or cache.fill(piece) for ids, piece in zip(found, pieces)]
                out += found
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        given = np.frombuffer(ids or b"", "<u4")
        # The bytes of the taken tokens lie one after the other in the value buffer.
        taken = self.table.take(pa.array(np.minimum(given, self.unknown)))
        size = int.from_bytes(taken.buffers()[1][4 * len(given):4 * len(given) + 4], "little") if len(given) else 0
        return str(taken.buffers()[2][:size], "utf-8", "replace") if size else ""


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encode_sources(raw_sources: DataFrame, vocabulary: str) -> DataFrame:
    """Token ids of every raw source: ``id, token_ids binary, n_tokens long``.

    ``raw_sources`` has ``id`` and ``raw_text``; other columns are ignored.
    ``vocabulary`` is the path of a byte-level BPE file on every executor.
    ``token_ids`` holds little-endian unsigned 32-bit ids of the whole text.
    Special tokens written out in a text get their own id, and none are added.
    A null or empty text has no tokens; a null id stays null; repeated rows give repeated rows.
    """
    def make():
        model = encoder(vocabulary)
        return lambda i, text: (i, model.encode(text))

    ids = map_rows(raw_sources.select("id", "raw_text"), make, "id long, token_ids binary")
    return ids.withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))


def decode_sources(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Texts of ``encode_sources`` rows: the given rows' ``id, token_ids, n_tokens`` and ``raw_text``.

    Null ids give an empty text. Encoding and decoding a text gives the same text.
    """
    def make():
        model = encoder(vocabulary)
        return lambda i, ids, n: (i, ids, n, model.decode(ids))

    return map_rows(encoded.select("id", "token_ids", "n_tokens"), make, "id long, token_ids binary, n_tokens long, raw_text string")
