"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary's byte strings answers whole
pre-tokens that are in the vocabulary; the slot is verified against the stored string.
Tier two: other pre-tokens become a linked list of bytes with a heap of mergeable
neighbours, lowest rank first, leftmost first among equals; a merge relinks its
neighbours and pushes the two pairs it makes. Cost is n log n in the pre-token's bytes.

A text is cut into pre-tokens by the given pattern, each encoded by itself, without
special tokens; decoding concatenates the byte strings of the ids.

Defined results: a null text is an empty text, with no ids; text may be of any length;
repeated rows give equal rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.llm.common import WORKER_CACHES, in_slices, mapped, utf8

#: A worker remembers the ids of at most twice so many pre-tokens, in two generations.
MEMORY = 150_000
_M = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 string, blank, rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _mix(h: int, seed: int) -> int:
    h = (h ^ seed * 0x9E3779B97F4A7C15 & _M) * 0xFF51AFD7ED558CCD & _M
    return h ^ h >> 33


_digest = xxhash.xxh3_64_intdigest


def _latin(pattern: str) -> str:
    r"""The pattern with \p{L}, \p{N} and \s spelled out for the characters below U+0100."""
    letters = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
    numbers = "0-9\xb2\xb3\xb9\xbc\xbd\xbe"
    blanks = "\t\n\x0b\x0c\r \x85\xa0"
    out, at, inside = [], 0, False
    while at < len(pattern):
        for token, members in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", blanks), (r"\S", None)):
            if pattern.startswith(token, at):
                out.append(f"[^{blanks}]" if members is None else members if inside else f"[{members}]")
                at += len(token)
                break
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
            at += 1
    return "".join(out)


class PerfectHash:
    """A minimal perfect hash by displacement.

    Keys fall into buckets; the largest buckets first choose a seed that sends all of their
    keys to free slots, and buckets of one key at last name one of the slots left over.
    """

    def __init__(self, words: list[bytes]):
        n = self.n = len(words)
        self.buckets = max(1, n // 3)
        self.seeds = [0] * self.buckets  # a seed, or -1 - slot
        self.slots = [0] * n
        groups: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, word in enumerate(words):
            d = _digest(word)
            groups[d % self.buckets].append((d, i))
        free = bytearray(b"\1" * n)
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        for b in (b for b in order if len(groups[b]) > 1):
            seed = 0
            while True:
                seed += 1
                to = {_mix(d, seed) % n for d, _ in groups[b]}
                if len(to) == len(groups[b]) and all(free[t] for t in to):
                    break
            self.seeds[b] = seed
            for d, i in groups[b]:
                t = _mix(d, seed) % n
                free[t], self.slots[t] = 0, i
        left = iter([t for t in range(n) if free[t]])
        for b in (b for b in order if len(groups[b]) == 1):
            t = next(left)
            self.seeds[b], self.slots[t] = -1 - t, groups[b][0][1]
        self.words = [words[i] for i in self.slots]

    def find(self, word: bytes) -> int:
        """The word's place in the list given at the start, or -1."""
        if not self.n:
            return -1
        d = _digest(word)
        seed = self.seeds[d % self.buckets]
        slot = _mix(d, seed) % self.n if seed >= 0 else -1 - seed
        return self.slots[slot] if self.words[slot] == word else -1


class _Memory(dict):
    """pre-token -> ids; what is missing is looked up in the generation before, then in the two tiers."""

    def __init__(self, piece):
        self.piece, self.before = piece, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.before.get(text) or self.piece(text)
        if len(text) <= 64:
            if len(self) >= MEMORY:
                self.before = dict(self)
                self.clear()
            self[text] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        words = list(ranks)
        self.whole = PerfectHash(words)
        self.place_rank = [ranks[w] for w in words]
        self.strings = {r: w for w, r in ranks.items()}
        self.singles = [ranks[bytes([b])] for b in range(256)]
        #: (left id, right id) -> id of the two joined
        self.joins = {(ranks[w[:i]], ranks[w[i:]]): r for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks}
        self.slow = regex.compile(pattern).findall
        self.fast = re.compile(_latin(pattern)).findall
        self.memory = _Memory(self.piece)

    def merge(self, word: bytes) -> list[int]:
        """The ids of a pre-token by merges alone. A heap entry packs rank and place; it is stale unless the pair there still joins to that rank."""
        join = self.joins.get
        part = list(map(self.singles.__getitem__, word))
        n = len(part)
        shift = n.bit_length()
        low = (1 << shift) - 1
        heap = [r << shift | i for i, r in enumerate(map(join, zip(part, part[1:]))) if r is not None]  # noqa: B905
        if not heap:
            return part
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        part.append(-1)  # joins with nothing
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, rank = entry & low, entry >> shift
            j = after[i]
            if join((part[i], part[j])) != rank:
                continue
            part[i], part[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := join((rank, part[k]))) is not None:
                    heappush(heap, r << shift | i)
            h = before[i]
            if h >= 0 and (r := join((part[h], rank))) is not None:
                heappush(heap, r << shift | h)
        return [p for p in part if p >= 0]

    def piece(self, text: str) -> tuple[int, ...]:
        word = text.encode("utf-8")
        at = self.whole.find(word)
        return (self.place_rank[at],) if at >= 0 else tuple(self.merge(word))

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens: by the standard library's faster matcher where every character is below U+0100, else by the full classes."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.slow(text)
        return self.fast(text)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memory.__getitem__, self.pieces(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One codec for a worker; the vocabulary file is at the same path on every machine, as the tokenizer package is."""
    return Codec(read_ranks(path), pattern)


WORKER_CACHES.append(codec.cache_clear)


class _Gather:
    """Concatenates table entries for arrays of ids."""

    def __init__(self, strings: dict[int, bytes]):
        self.size = np.zeros(max(strings, default=-1) + 1, np.int64)
        for i, b in strings.items():
            self.size[i] = len(b)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings.get(i, b"") for i in range(len(self.size))), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, the end of each entry in them)."""
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[ids] - ends + sizes, sizes) + np.arange(total)], ends


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    decimal, decode = _Gather({r: b"%d," % r for r in own.strings}), _Gather(own.strings)
    for batch in in_slices(batches, 1, 1 << 20):
        ids: list[int] = []
        edges = [0]
        for body in batch.column(1).to_pylist():
            ids += own.encode((body or b"").decode("utf-8"))
            edges.append(len(ids))
        array, at = np.array(ids, np.int64), np.array(edges)
        hashes, lengths = [], None
        for table, comma in ((decimal, 1), (decode, 0)):
            data, ends = table(array)
            ends = np.concatenate([[0], ends])[at]
            view = memoryview(data)
            hashes.append([hashlib.sha256(view[a : max(a, b - comma)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
            lengths = np.diff(ends)
        columns = [batch.column(0), pa.array(np.diff(at), pa.int64()), *(pa.array(h, pa.string()) for h in hashes), pa.array(lengths, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    for batch in in_slices(batches, 1):
        ids = [own.encode((body or b"").decode("utf-8")) for body in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    for batch in batches:
        texts = [own.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("body"))
    return mapped(rows, lambda it: _encoded(it, path, pattern), "doc_id bigint, ids array<int>", caches=False)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text, from the rows of encode()."""
    return mapped(encoded.select("doc_id", "ids"), lambda it: _decoded(it, path, pattern), "doc_id bigint, text string", caches=False)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes: digests of each text's ids and of the bytes they decode to."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("body"))
    return mapped(rows, lambda it: _digests(it, path, pattern), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint", caches=False)
