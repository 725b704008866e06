"""Cost-balanced packing of token sequences.

The cost of a piece of n tokens is `linear * n + quadratic * n * n`, an estimate of what a
transformer layer spends on it. Documents are packed in blocks of about `block_tokens` tokens. In a
block, the longest piece goes first, each to the sequence of lowest cost that still has room for all
of it; where none has, the cheapest sequence with any room takes what fits and the rest is queued
again. A block's capacities sum to its tokens exactly: full sequences, and for the remainder
sequences of the powers of two of its binary form. So nothing is padded.

Blocks are made inside the scan's partitions: there is no shuffle, no key that could be hot, and a
lost task is simply run again with the same result.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import words as W

BLOCK_TOKENS = 1 << 20
SUFFIX = "</w>"
#: How a word of ASCII without apostrophes is split: letters, single digits, runs of anything else.
PIECES = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
#: The same for words of Latin letters below this character, whose classes all Unicode versions agree on.
LATIN_END = "\u0250"
LATIN_PIECES = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordTokenizer:
    """Token ids of texts through a cache of words.

    A tokenizer that splits at white space gives a text the ids of its words one after the other, so each
    distinct word goes through it once. The cache has two generations of `limit` words. Where the
    tokenizer is a byte-level BPE with an end-of-word suffix, plain words (ASCII, or lower-case Latin in NFC, without
    apostrophes) are merged by a faster BPE over the same vocabulary: the suffix
    is a byte that UTF-8 never holds and a token's id is its rank. All other words, and texts with special
    tokens, go through the tokenizer itself.
    """

    def __init__(self, path: str, limit: int = 250_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.limit = limit
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = self._fast(json.loads(Path(path).read_text())["model"])

    def _fast(self, model: dict):
        """bytes of a plain piece -> ids, or None if the model isn't of the kind that is known here."""
        if model.get("type") != "BPE" or model.get("end_of_word_suffix") != SUFFIX:
            return None
        import tiktoken

        # byte-level BPE writes printable Latin-1 characters as themselves and the other bytes from U+0100 on
        own = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
        as_byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {}
        for token, rank in model["vocab"].items():
            if token.encode() in self.specials:
                continue
            stem = token.removesuffix(SUFFIX)
            ranks[bytes(as_byte[c] for c in stem) + b"\xff" * (stem != token)] = rank
        return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, w: bytes) -> bytes:
        if self.merge is not None:
            if w.isascii():
                # a word of letters is one piece, and most others are one with a mark behind it
                if w.isalpha():
                    return pack_ids(self.merge(w + b"\xff"))
                if w[:-1].isalpha() and w[-1] not in b"'\x00":
                    return pack_ids(self.merge(w[:-1] + b"\xff") + self.merge(w[-1:] + b"\xff"))
                if b"'" not in w and b"\x00" not in w:
                    return pack_ids([x for piece in PIECES.findall(w) for x in self.merge(piece + b"\xff")])
            elif b"'" not in w and max(s := w.decode()) < LATIN_END and s == s.lower() and is_normalized("NFC", s):
                return pack_ids([x for piece in LATIN_PIECES.findall(s) for x in self.merge(piece.encode() + b"\xff")])
        return self.plain(w.decode())

    def forget(self) -> None:
        """Empty the cache: a worker that waits for its next task needn't hold it."""
        self.new, self.old = {}, {}

    def learn(self, w: bytes) -> bytes:
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        known = self.old.get(w)
        if known is None:
            known = self.word(w)
        self.new[w] = known
        return known

    def __call__(self, text: bytes) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit numbers."""
        if any(s in text for s in self.specials):
            return self.plain(text.decode())
        words = text.lower().split()
        got = list(map(self.new.get, words))
        for i in [i for i, x in enumerate(got) if x is None]:
            w = words[i]
            got[i] = self.new.get(w) or self.learn(w)
        return b"".join(got)


_PACKED = [struct.Struct(f"<{n}I").pack for n in range(64)]


def pack_ids(ids: list[int]) -> bytes:
    return _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else struct.pack(f"<{len(ids)}I", *ids)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def capacities(tokens: int, length: int) -> list[int]:
    """Sequence sizes for a block: full ones, then powers of two that sum to the remainder."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def assign(lengths: list[int], length: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of the pieces of items with these lengths."""
    # pieces of full length come first and take the full sequences in turn, without a search
    out = [(item, at, length, k, 0) for k, (item, at) in enumerate((item, at) for item, n in enumerate(lengths) for at in range(0, n - length + 1, length))]
    full = len(out)
    room = np.array(capacities(sum(lengths), length)[full:], dtype=np.int64)
    cost, used = np.zeros(len(room)), np.zeros(len(room), dtype=np.int64)
    queue = [(-(n % length), item, n - n % length) for item, n in enumerate(lengths) if n % length]
    heapq.heapify(queue)
    while queue:
        n, item, start = heapq.heappop(queue)
        n = -n
        fits = np.where(room >= n, cost, np.inf)
        k = int(fits.argmin())
        take = n
        if fits[k] == np.inf:
            k = int(np.where(room > 0, cost, np.inf).argmin())
            take = int(room[k])
            heapq.heappush(queue, (take - n, item, start + take))
        out.append((item, start, take, full + k, int(used[k])))
        used[k] += take
        room[k] -= take
        cost[k] += linear * take + quadratic * take * take
    return out


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    length: int = 2048,
    end_id: int = 1,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, cost, token_ids) of packed documents.

    docs needs doc_id and text; other columns, whatever their names, are not read. A null or empty text is
    the end token alone. A null doc_id stays null; rows that repeat are packed each by itself. token_ids are
    little-endian unsigned 32-bit numbers. An empty table gives no rows. Two pieces of one document may stand
    in one sequence. A document longer than a block is a block of its own.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << 32
        ids, held, tokens = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, tokens
            pieces = assign([len(x) // 4 for x in held], length, linear, quadratic)
            for at in range(0, len(pieces), 4096):
                part = pieces[at : at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i, *_ in part], pa.int64()),
                        pa.array([s for _, s, *_ in part], pa.int64()),
                        pa.array([n for _, _, n, *_ in part], pa.int64()),
                        pa.array([len(held[i]) // 4 for i, *_ in part], pa.int64()),
                        pa.array([first + k for *_, k, _ in part], pa.int64()),
                        pa.array([o for *_, o in part], pa.int64()),
                        pa.array([linear * n + quadratic * n * n for _, _, n, *_ in part], pa.float64()),
                        pa.array([held[i][4 * s : 4 * (s + n)] for i, s, n, *_ in part], pa.binary()),
                    ],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "cost", "token_ids"],
                )
            first += len(capacities(tokens, length))
            ids.clear()
            held.clear()
            tokens = 0

        for batch in W.chunks(batches):
            for doc, text in zip(batch.column(0).to_pylist(), W.texts(batch), strict=True):
                x = encode(text) + end
                ids.append(doc)
                held.append(x)
                tokens += len(x) // 4
                if tokens >= block_tokens:
                    yield from flush()
        if held:
            yield from flush()
        encode.forget()
        W.trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, cost double, token_ids binary")
