"""Exact deduplication by content-defined chunk recipes.

Each text is normalised (A-Z lower-cased) and cut into chunks at places that its own bytes
choose. Its identifier is the first half of a chunk's SHA-256. Identifiers are verified: within a
task the bytes under one identifier are compared, and between tasks a second digest of another
kind (BLAKE2b, 256 bits) and the lengths, so that no text is moved to be verified. A document's
recipe is the ordered list of its identifiers. Texts are equal exactly when their recipes are,
and only identifiers and these lists are shuffled and compared. The chunk store keeps every
distinct chunk once, with its bytes on request; these are then compared between tasks, too.

Defined results: a null text is an empty text; all empty texts are equal; a null doc_id
ranks below every other id; rows that repeat a doc_id are one document and get the same
result; an identifier that stands for two chunks raises; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.llm.common import byte_column, in_slices, kept, mapped, utf8

#: Cut where the hash of the last WINDOW bytes has MASK_BITS zero bits; chunks have MIN_CHUNK to MAX_CHUNK bytes (but for a text's last).
WINDOW, MASK_BITS, MIN_CHUNK, MAX_CHUNK = 16, 9, 128, 65_536
#: Bytes of an identifier, and bytes of chunks that a task remembers, so that it need not send them again.
ID_BYTES, CHECK_BYTES, REMEMBERED = 16, 32, 16 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RECIPES = "doc_id bigint, n_bytes bigint, text_sha256 string, n_chunks bigint, recipe array<binary>"
_CHUNKS = "chunk_id binary, check binary, n_bytes bigint, n_uses bigint, first_doc_id bigint, content binary"


def cut_hashes(data: np.ndarray) -> np.ndarray:
    """For each i, a 32-bit hash of the WINDOW bytes that end at i (garbage where fewer are before)."""
    h = (data.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    width = 1
    while width < WINDOW:  # h[i] covers `width` bytes; double it
        factor = np.uint32(pow(0x01000193, width, 1 << 32))
        h[width:] += h[:-width] * factor
        width *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def cut_points(offsets: np.ndarray, data: np.ndarray) -> list[list[int]]:
    """For each text, the ends of its chunks, relative to its start. An empty text has none."""
    marks = np.flatnonzero((cut_hashes(data) >> np.uint32(32 - MASK_BITS)) == 0) + 1 if len(data) else np.zeros(0, np.int64)
    firsts = np.searchsorted(marks, offsets[:-1] + max(WINDOW, MIN_CHUNK))
    lasts = np.searchsorted(marks, offsets[1:])
    out = []
    for start, end, a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), firsts.tolist(), lasts.tolist(), strict=True):
        own, at, cuts = marks[a:b], start, []
        while at < end:
            i = int(np.searchsorted(own, at + MIN_CHUNK))
            at = min(int(own[i]) if i < len(own) else end, at + MAX_CHUNK, end)
            cuts.append(at - start)
        out.append(cuts)
    return out


def _lowered(batch: pa.RecordBatch) -> Iterator[tuple[memoryview, list[tuple[int, int]]]]:
    """For each text of a batch its normalised bytes and the (start, end) of its chunks."""
    offsets, raw = byte_column(batch.column(1))
    lowered = raw.tobytes().translate(_LOWER)
    view = memoryview(lowered)
    for start, end, ends in zip(offsets[:-1].tolist(), offsets[1:].tolist(), cut_points(offsets, np.frombuffer(lowered, np.uint8)), strict=True):
        yield view[start:end], list(zip([0, *ends], ends, strict=False))


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, 1):
        digests, sizes, lists = [], [], []
        for text, spans in _lowered(batch):
            ids = [hashlib.sha256(text[a:b]).digest() for a, b in spans]
            digests.append(ids[0].hex() if len(ids) == 1 else hashlib.sha256(text).hexdigest())
            sizes.append(len(text))
            lists.append([i[:ID_BYTES] for i in ids])
        n_chunks = pa.array([len(x) for x in lists], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), n_chunks, pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "text_sha256", "n_chunks", "recipe"])


def _chunks(batches: Iterator[pa.RecordBatch], contents: bool = True) -> Iterator[pa.RecordBatch]:
    """Each slice's distinct chunks with their uses and second digests; bytes only if asked for, and where the task hasn't sent them of late. Bytes that it remembers are compared."""
    sent: dict[bytes, bytes] = {}
    held = 0
    for batch in in_slices(batches, 1):
        uses: dict[bytes, list] = {}
        for doc_id, (text, spans) in zip(batch.column(0).to_pylist(), _lowered(batch), strict=True):
            for a, b in spans:
                content = bytes(text[a:b])
                name = hashlib.sha256(content).digest()[:ID_BYTES]
                row = uses.get(name)
                if row is None:
                    row = uses[name] = [0, None, content]
                elif row[2] != content:
                    raise ValueError(f"identifier {name.hex()} stands for two chunks")
                row[0] += 1
                if doc_id is not None and (row[1] is None or doc_id < row[1]):
                    row[1] = doc_id
        out = []
        for name, (n, first, content) in uses.items():
            known = sent.get(name)
            if known is None:
                sent[name] = content
                held += len(content)
            elif known != content:
                raise ValueError(f"identifier {name.hex()} stands for two chunks")
            check = hashlib.blake2b(content, digest_size=CHECK_BYTES).digest()
            out.append((name, check, len(content), n, first, content if contents and known is None else None))
        if held > REMEMBERED:
            sent.clear()
            held = 0
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk_id", "check", "n_bytes", "n_uses", "first_doc_id", "content"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("body"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, text_sha256, n_chunks, recipe (the ordered chunk identifiers); one row per input row."""
    return mapped(_rows(docs, id_col, text_col), _recipes, _RECIPES)


def chunk_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contents: bool = True) -> DataFrame:
    """Every distinct chunk once: chunk_id, n_bytes, n_uses, first_doc_id, verified (all second digests and lengths under the identifier are equal); with `contents` also content, whose bytes are compared as well."""
    each = mapped(_rows(docs, id_col, text_col), lambda it: _chunks(it, contents), _CHUNKS)
    one = lambda c: F.min(c) == F.max(c)
    figures = [F.max("n_bytes").alias("n_bytes"), F.sum("n_uses").alias("n_uses"), F.min("first_doc_id").alias("first_doc_id")]
    if not contents:
        return each.groupBy("chunk_id").agg(*figures, (one("check") & one("n_bytes")).alias("verified"))
    return each.groupBy("chunk_id").agg(*figures, F.min("content").alias("content"), (one("check") & one("n_bytes") & one("content")).alias("verified"))


def verify(store: DataFrame) -> int:
    """The number of identifiers in a store; one that stands for two chunks raises."""
    counts = store.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("verified"), 1)).alias("bad")).first()
    if counts["bad"]:
        raise ValueError(f"{counts['bad']} identifiers stand for two chunks")
    return counts["n"]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks for every row of docs.

    Identifiers are verified by the chunk store first. Groups of equal lists are counted with
    map-side partial aggregation, so a text that a third of all rows share costs one partial
    row per task. The groups come back to their rows in a join on list and chunk count; both
    sides are shuffled for it, and so adaptive execution may split a skewed recipe.
    """
    verify(chunk_store(docs, id_col, text_col, contents=False))
    own = kept(recipes(docs, id_col, text_col))
    groups = own.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.first("n_chunks").alias("n_chunks"))
    groups = groups.where("group_size > 1")
    return own.join(groups, ["recipe", "n_chunks"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        "n_bytes",
        "n_chunks",
    )
