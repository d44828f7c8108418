"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

A byte goes when a ``length``-byte string that covers it also starts in a document with a
smaller doc_id. Suffixes of a whole corpus don't fit a cluster's disks, and nearly all of
them are alone; so the sort is dealt out by anchors, without losing a match:

1. Anchors. In every ``length``-byte window the K-gram with the smallest hash is an anchor.
   Equal windows have equal anchors at equal places, wherever they are. Tasks send each
   anchor hash once with a count; its bucket answers whether it repeats anywhere.
2. Contexts. Around repeated anchors a task cuts out the bytes of all windows that hold the
   anchor, each distinct context once with its smallest document; a copy within the task is
   settled there. A context goes to its anchor's bucket. An anchor with very many
   contexts sends its windows one by one instead, each to its own bucket, where equal ones
   are at most one for each task: no bucket grows with a hot passage.
3. Sort. A bucket settles equal contexts, then builds the suffix array of the contexts
   that differ by the difference-cover algorithm modulo 3: sort the triples at sampled
   places, name them, recurse on the names until they are unique, sort the other suffixes
   by first byte and sampled rank, merge. Adjacent suffixes that agree on ``length`` bytes
   are one group, and all but its smallest document lose those bytes.
4. Removal. The intervals go back to the part of the corpus they came from.

Documents are dealt into parts of bounded bytes by a hash of row and input split, once; every
stage reads that same exchange, so neither rows without an id nor repeated ones share a part
for it. A task takes the parts or buckets of its partition one after another, so that memory is
that of one part, while partitions are some thousands, then those of 128 MB of text, and at most
some ten thousands, however large the corpus is. Counts, contexts and intervals are packed into binary columns, a row for each part and
bucket that have any: a part sends at most a row for each anchor, however many buckets there
are, and rows grow with the input.

Defined results: a null text is an empty text; texts below ``length`` bytes lose nothing;
rows that repeat a doc_id don't remove each other's bytes; a null doc_id ranks after every
other id; matches never cross documents, and are judged on the input; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.llm.common import binary_array, byte_column, utf8

LENGTH, K = 50, 24
#: Bytes of text for each part, the fewest parts, and the most buckets (their numbers come from 24 bits of a hash).
PART_BYTES, LEAST_PARTS, MOST_BUCKETS = 8 << 20, 64, 1 << 22
#: Partitions of an exchange up to which each part has its own, bytes of text for each beyond that, and the most partitions.
OWN_PARTITIONS, PARTITION_BYTES, MOST_PARTITIONS = 2048, 128 << 20, 32_768
#: Anchors above so many occurrences send windows.
HOT = 4096
#: At most about so many bytes are suffix-sorted at once (groups of one anchor stay together).
SORT_BYTES = 1 << 19
_NULL_ID = np.iinfo(np.int64).max
_MULT = 0x9E3779B97F4A7C15 | 1
_SPAN = LENGTH - K  # windows that hold an anchor start 0 to _SPAN bytes before it
_CTX = LENGTH + _SPAN


def _powers(width: int) -> np.uint64:
    return np.uint64(pow(0x100000001B3, width, 1 << 64))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place on; shorter by size - 1."""
    level, width, out, done = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULT), 1, None, 0
    n = len(data) - size + 1
    while True:
        if size & width:
            part = level[done : done + n]
            out = part.copy() if out is None else out * _powers(width) + part
            done += width
        if width * 2 > size:
            break
        level = level[:-width] * _powers(width) + level[width:]
        width *= 2
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each `width` neighbours; shorter by width - 1."""
    have = 1
    while have * 2 <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors(data: np.ndarray, offsets: np.ndarray, owned: bool = False, step: int = 1 << 19) -> tuple[np.ndarray, ...]:
    """(places, hashes) of the anchors of all documents, in order. The buffer is walked in overlapping pieces, whatever its documents' lengths.

    With `owned` also (lo, hi): an anchor's own windows, those whose leftmost smallest K-gram it
    is, start at place - _SPAN + lo to place - _SPAN + hi. Every window has one owner, and equal
    windows have it at the same place.
    """
    n, places, hashes, los, his = len(data), [], [], [], []
    ends = offsets[1:]
    for at in range(0, n, step):
        lo, hi = max(0, at - LENGTH), min(n, at + step + 2 * LENGTH)
        if hi - lo < LENGTH:
            continue
        h = gram_hashes(data[lo:hi], K)
        low = _slide(h, _SPAN + 1, np.minimum)  # of the window that starts here
        starts = np.arange(lo, lo + len(low))
        doc = np.searchsorted(ends, starts, side="right")
        low[starts + LENGTH > ends[np.minimum(doc, len(ends) - 1)]] = 0  # windows across documents choose nothing
        pad = np.zeros(_SPAN, np.uint64)
        high = _slide(np.concatenate([pad, low, pad]), _SPAN + 1, np.maximum)
        own = np.flatnonzero((h == high) & (h != 0))
        own = own[(own + lo >= at) & (own + lo < at + step)]
        places.append(own + lo)
        hashes.append(h[own])
        if owned:
            first, last = np.full(len(own), _SPAN + 1), np.full(len(own), -1)
            around = np.concatenate([pad, low, pad])  # the window that starts at own - _SPAN + s is around[own + s]
            for s in range(_SPAN + 1):
                mine = around[own + s] == h[own]
                np.minimum(first, np.where(mine, s, _SPAN + 1), out=first)
                last[mine] = s
            los.append(first)
            his.append(last)
    places, hashes = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((places, np.int64), (hashes, np.uint64)))
    if not owned:
        return places, hashes
    lo, hi = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (los, his))
    # Of equal anchors in one window the leftmost owns it.
    order = np.argsort(hashes, kind="stable")
    gap = np.diff(places[order])
    again = (hashes[order][1:] == hashes[order][:-1]) & (gap <= _SPAN)
    later = order[1:][again]
    lo[later] = np.maximum(lo[later], _SPAN - gap[again] + 1)
    return places, hashes, lo, hi


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence of integers from 1 on, by the difference cover {1, 2} modulo 3."""
    n = len(text)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    top = int(t.max()) + 1
    # Sampled places; an extra one at n makes the halves of the recursion end apart.
    first = np.arange(1, n + (n % 3 == 1), 3)
    second = np.arange(2, n, 3)
    sample = np.concatenate([first, second])
    if top < 1 << 21:
        triples = (t[sample] * top + t[sample + 1]) * top + t[np.minimum(sample + 2, n + 2)]
        _, names = np.unique(triples, return_inverse=True)
    else:
        _, pairs = np.unique(t[sample] * top + t[sample + 1], return_inverse=True)
        _, names = np.unique(pairs * top + t[np.minimum(sample + 2, n + 2)], return_inverse=True)
    names = names + 1
    if int(names.max()) == len(sample):
        order = np.empty(len(sample), np.int64)
        order[names - 1] = np.arange(len(sample))
    else:
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    wide = len(sample) + 2
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(t[zero] * wide + rank[zero + 1], kind="stable")]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(t[ones] * wide + rank[ones + 1], t[zero] * wide + rank[zero + 1])
    # Against a place that is 2 modulo 3: two symbols, then sampled ranks. The pair is named so that the key fits.
    _, pair = np.unique(np.concatenate([t[twos] * top + t[twos + 1], t[zero] * top + t[zero + 1]]), return_inverse=True)
    before += np.searchsorted(pair[: len(twos)] * wide + rank[twos + 2], pair[len(twos) :] * wide + rank[zero + 2])
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    at = np.arange(len(zero)) + before
    out[at] = zero
    taken[at] = True
    out[~taken] = sampled
    return out


def least_documents(contexts: np.ndarray, lo: np.ndarray, hi: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For contexts as rows of bytes, the windows [s, s + LENGTH) with s from lo to hi that also occur with a smaller document: a boolean (rows, _SPAN + 1)."""
    n = len(contexts)
    text = np.zeros((n, _CTX + 1), np.int64)
    text[:, :_CTX] = contexts
    text[:, :_CTX] += 2
    text[:, _CTX] = 1
    order = suffix_array(text.ravel())
    row, start = order // (_CTX + 1), order % (_CTX + 1)
    mine = (start >= lo[row]) & (start <= hi[row])
    row, start = row[mine], start[mine]
    out = np.zeros((n, _SPAN + 1), bool)
    if not len(row):
        return out
    windows = np.lib.stride_tricks.sliding_window_view(contexts, LENGTH, axis=1)[row, start]
    fresh = np.concatenate([[True], (windows[1:] != windows[:-1]).any(axis=1)])  # compare adjacent prefixes
    heads = np.flatnonzero(fresh)
    least = np.minimum.reduceat(docs[row], heads)[np.cumsum(fresh) - 1]
    out[row, start] = least < docs[row]
    return out


def _part(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids ascending, offsets, bytes) of a part, in an order that every stage finds again."""
    ids = table.column("doc_id").fill_null(_NULL_ID).to_numpy()
    bodies = table.column("body")
    order = np.argsort(ids, kind="stable")
    if (np.diff(ids[order]) == 0).any():  # equal ids are ordered by their texts
        digests = [hashlib.sha256(b or b"").digest() for b in bodies.to_pylist()]
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], digests[i])), np.int64)
    offsets, data = byte_column(bodies.take(pa.array(order)).cast(pa.large_binary()))
    return ids[order], offsets, data


def _packed(**columns) -> pa.Table:
    return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def _bucketed(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts by bucket, the buckets that occur, the edges of each in that order)."""
    order = np.argsort(buckets, kind="stable")
    ascending = buckets[order]
    heads = np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]])) if len(order) else np.zeros(0, np.int64)
    return order, ascending[heads], np.append(heads, len(order))


def _runs(edges: np.ndarray, data: np.ndarray) -> pa.Array:
    """One binary value for each run of data between edges."""
    data = np.ascontiguousarray(data)
    width = data.dtype.itemsize * (int(np.prod(data.shape[1:])) if data.ndim > 1 else 1)
    return binary_array(edges.astype(np.int64) * width, data.reshape(-1).view(np.uint8)).cast(pa.binary())


def _read(column, dtype: str, width: int = 0) -> list[np.ndarray]:
    out = [np.frombuffer(b, dtype) for b in column.to_pylist()]
    return [x.reshape(-1, width) for x in out] if width else out


def _bucket_of(hashes: np.ndarray, count: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(count)).astype(np.int64)


def _ask(table: pa.Table, count: int) -> pa.Table:
    """A part's distinct anchor hashes (the low 40 bits beside the bucket, which comes from the others: enough for a filter) and their counts (16 steps for each doubling), a row for each bucket."""
    ids, offsets, data = _part(table)
    _, hashes = anchors(data, offsets)
    own, counts = np.unique(hashes, return_counts=True)
    order, buckets, edges = _bucketed(_bucket_of(own, count))
    part = table.column("part")[0].as_py()
    return _packed(bucket=buckets, part=np.full(len(buckets), part), hashes=_runs(edges, own[order].view(np.uint8).reshape(-1, 8)[:, :5]), counts=_runs(edges, np.minimum(np.round(16 * np.log2(counts)), 255).astype(np.uint8)[order]))


def _answer(table: pa.Table) -> pa.Table:
    """For each part's row of a bucket: 0 for anchors that occur once in all, 1 for repeated and 2 for hot ones."""
    hashes, counts = _read(table.column("hashes"), "u1", 5), _read(table.column("counts"), "u1")
    whole = np.zeros((sum(map(len, hashes)), 8), np.uint8)
    whole[:, :5] = np.concatenate(hashes)
    _, where = np.unique(whole.view(np.uint64).ravel(), return_inverse=True)
    total = np.bincount(where, weights=2.0 ** (np.concatenate(counts) / 16))[where] if len(where) else np.zeros(0)
    flags = ((total > 1.5).astype(np.uint8) + (total > HOT)).astype(np.uint8)
    edges = np.cumsum([0, *map(len, hashes)])
    return _packed(part=table.column("part").combine_chunks(), bucket=table.column("bucket").combine_chunks(), flags=_runs(edges, flags))


def _cut(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """(n, width) bytes from each start on; zeros outside the data."""
    padded = np.concatenate([np.zeros(_CTX, np.uint8), data, np.zeros(_CTX, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, width)[starts + _CTX]


def _distinct(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, group number of each row) of equal rows; keys are hashes of the rows, checked against them."""
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    if len(rows) and (rows != rows[first[group]]).any():
        wide = np.ascontiguousarray(rows).view([("", np.uint8, rows.shape[1])]).ravel()
        _, first, group = np.unique(wide, return_index=True, return_inverse=True)
    return first, group


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    width = -(-rows.shape[1] // 8) * 8
    words = np.zeros((len(rows), width), np.uint8)
    words[:, : rows.shape[1]] = rows
    h = np.full(len(rows), 0xCBF29CE484222325, np.uint64)
    for word in words.view(np.uint64).T:
        h = (h ^ word) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
    return h


#: A context: its bucket's key, document, number of the document in its part, start of its first byte in the document plus _CTX, first and last window.
_META = np.dtype([("key", "u8"), ("doc_id", "i8"), ("doc", "u4"), ("start", "u4"), ("lo", "u1"), ("hi", "u1")])
#: The columns that travel; each is a difference to the context before where that is smaller.
_SENT = (("doc_id", "i8", True), ("doc", "i4", True), ("start", "u4", False), ("lo", "u1", False), ("hi", "u1", False))
_SPANS = np.dtype([("doc", "u4"), ("start", "u8"), ("size", "u8")])


def _intervals(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Spans, with those that touch or overlap merged."""
    out = np.zeros(len(doc), _SPANS)
    out["doc"], out["start"], out["size"] = doc, start, size
    if len(out) < 2:
        return out
    out = out[np.lexsort((out["start"], out["doc"]))]
    base = out["doc"].astype(np.int64) << 40
    begin, end = base + out["start"].astype(np.int64), base + (out["start"] + out["size"]).astype(np.int64)
    reach = np.maximum.accumulate(end)
    fresh = np.concatenate([[True], begin[1:] > reach[:-1]])
    heads = np.flatnonzero(fresh)
    last = np.concatenate([heads[1:], [len(out)]]) - 1
    merged = out[heads]
    merged["size"] = (reach[last] - begin[heads]).astype(np.uint64)
    return merged


def _contexts(table: pa.Table, answers: pa.Table, count: int) -> pa.Table:
    """A part's contexts around repeated anchors, a row for each bucket; spans settled here ride along."""
    ids, offsets, data = _part(table)
    part = table.column("part")[0].as_py()
    places, hashes, lo, hi = anchors(data, offsets, owned=True)
    own, inverse = np.unique(hashes, return_inverse=True)
    order, _, _ = _bucketed(_bucket_of(own, count))
    by_bucket = sorted(zip(answers.column("bucket").to_pylist(), answers.column("flags").to_pylist(), strict=True))
    flags = np.zeros(len(own), np.uint8)
    flags[order] = np.frombuffer(b"".join(f for _, f in by_bucket), np.uint8)
    flag = flags[inverse]
    doc = np.searchsorted(offsets, places, side="right") - 1

    def send(keys, starts, doc, lo, hi, width) -> None:
        for at in range(0, len(starts), 200_000):
            send_some(*(x[at : at + 200_000] for x in (keys, starts, doc, lo, hi)), width)

    pending: list[tuple] = []

    def send_some(keys, starts, doc, lo, hi, width) -> None:
        body = np.zeros((len(starts), _CTX + 2), np.uint8)
        body[:, :width] = _cut(data, starts, width)
        inside = np.arange(width)
        body[:, :width][(inside < lo[:, None]) | (inside >= hi[:, None] + LENGTH)] = 0  # bytes of other documents
        body[:, _CTX], body[:, _CTX + 1] = lo, hi
        pending.append((keys, starts, doc, lo, hi, body))

    normal, hot = np.flatnonzero((flag == 1) & (lo <= hi)), np.flatnonzero((flag == 2) & (lo <= hi))
    send(hashes[normal], places[normal] - _SPAN, doc[normal], lo[normal], hi[normal], _CTX)
    if len(hot):
        n = hi[hot] - lo[hot] + 1
        at = np.repeat(hot, n)
        starts = places[at] - _SPAN + lo[at] + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        starts, pick = np.unique(starts, return_index=True)
        none = np.zeros(len(starts), np.int64)
        keys = np.concatenate([gram_hashes(np.ascontiguousarray(c).ravel(), LENGTH)[::LENGTH] for c in np.array_split(_cut(data, starts, LENGTH), max(1, len(starts) // 50_000))])
        send(keys, starts, doc[at][pick], none, none, LENGTH)
    if pending:
        keys, starts, docs, lo, hi, body = (np.concatenate(x) for x in zip(*pending, strict=True))
        order = np.argsort(docs, kind="stable")  # the first of equal rows then has the smallest document
        keys, starts, docs, lo, hi, body = (x[order] for x in (keys, starts, docs, lo, hi, body))
        first, group = _distinct(_row_hash(body), body)
        later = ids[docs] > ids[docs[first]][group]
        spans = _intervals(docs[later], (starts + lo - offsets[docs])[later], (hi - lo + LENGTH)[later])
        keep = ~later
        meta = np.zeros(int(keep.sum()), _META)
        meta["key"], meta["doc_id"], meta["doc"] = keys[keep], ids[docs[keep]], docs[keep]
        meta["start"] = starts[keep] - offsets[docs[keep]] + _CTX
        meta["lo"], meta["hi"] = lo[keep], hi[keep]
        rows, metas = body[keep][:, :_CTX], meta
    else:
        rows, metas, spans = np.zeros((0, _CTX), np.uint8), np.zeros(0, _META), np.zeros(0, _SPANS)
    order, buckets, edges = _bucketed(_bucket_of(metas["key"], count))
    metas, heads = metas[order], edges[:-1]
    buckets, edges = np.append(buckets, part % count), np.append(edges, edges[-1])  # a last row carries the spans that are settled
    sent = {}
    for name, kind, differs in _SENT:
        column = metas[name].astype(kind)
        if differs:
            steps = np.diff(column, prepend=column[:1] * 0)
            steps[heads] = column[heads]
            column = steps
        sent[name] = _runs(edges, column)
    settled = pa.array([b""] * (len(buckets) - 1) + [spans.tobytes()], pa.binary())
    return _packed(bucket=buckets, part=np.full(len(buckets), part), body=_runs(edges, rows[order]), **sent, spans=settled).slice(0, len(buckets) - (not len(spans)))


def _sort(table: pa.Table) -> pa.Table:
    """A bucket's contexts, settled: a row of spans for each part."""
    bodies = _read(table.column("body"), "u1", _CTX)
    parts = table.column("part").to_pylist()
    body = np.concatenate(bodies)
    meta = np.zeros(len(body), _META)
    for name, kind, differs in _SENT:
        columns = _read(table.column(name), kind)
        meta[name] = np.concatenate([np.cumsum(c) if differs else c for c in columns])
    meta["key"] = _row_hash(body[:, _SPAN:LENGTH])  # the anchor's bytes, or a hot window's
    source = np.repeat(np.arange(len(parts)), [len(b) for b in bodies])
    order = np.argsort(meta["doc_id"], kind="stable")
    body, meta, source = body[order], meta[order], source[order]
    full = np.concatenate([body, meta["lo"][:, None], meta["hi"][:, None]], axis=1)
    first, group = _distinct(_row_hash(full), full)
    lost = np.zeros((len(body), _SPAN + 1), bool)
    later = meta["doc_id"] > meta["doc_id"][first][group]
    steps = np.arange(_SPAN + 1)
    lost[later] = (steps >= meta["lo"][later, None]) & (steps <= meta["hi"][later, None])
    # Contexts that differ but share an anchor are suffix-sorted, some anchors at a time.
    keys = meta["key"][first]
    by_key = np.argsort(keys, kind="stable")
    sorted_keys = keys[by_key]
    fresh = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]) if len(keys) else np.zeros(0, bool)
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.append(heads, len(keys)))
    shared = np.repeat(sizes > 1, sizes)
    mixed, mixed_keys = by_key[shared], sorted_keys[shared]
    # A shared window reaches half of the span to the left or to the right of its anchor: contexts that share neither half with another are alone.
    half, own = _SPAN // 2, first[mixed]
    near = np.zeros(len(mixed), bool)
    for at in (_SPAN - half, LENGTH):
        side = _row_hash(np.concatenate([body[own][:, at : at + half], meta["key"][own][:, None].view(np.uint8)], axis=1)) if len(own) else np.zeros(0, np.uint64)
        _, where, counts = np.unique(side, return_inverse=True, return_counts=True)
        near |= counts[where] > 1
    mixed, mixed_keys = mixed[near], mixed_keys[near]
    group_lost = np.zeros((len(first), _SPAN + 1), bool)
    at, most = 0, SORT_BYTES // (_CTX + 1)
    while at < len(mixed):
        end = min(at + most, len(mixed))
        while end < len(mixed) and mixed_keys[end] == mixed_keys[end - 1]:
            end += 1
        some = mixed[at:end]
        own = first[some]
        group_lost[some] = least_documents(body[own], meta["lo"][own], meta["hi"][own], meta["doc_id"][own])
        at = end
    if len(first):
        lost[~later] |= group_lost[group[~later]]
    row, s = np.nonzero(lost)
    m = meta[row]
    out_parts, out_spans = [], []
    from_part = source[row]
    order = np.argsort(from_part, kind="stable")
    edges = np.searchsorted(from_part[order], np.arange(len(parts) + 1))
    start = m["start"].astype(np.int64) - _CTX + s
    for i, (part, ready) in enumerate(zip(parts, table.column("spans").to_pylist(), strict=True)):
        own = order[edges[i] : edges[i + 1]]
        found = _intervals(m["doc"][own], start[own], np.full(len(own), LENGTH))
        if len(found) or ready:
            out_parts.append(part)
            out_spans.append(found.tobytes() + ready)
    return _packed(part=pa.array(out_parts, pa.int64()), spans=pa.array(out_spans, pa.binary()))


def covered(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each byte of a part whether a span covers it."""
    gone = np.zeros(int(offsets[-1]), bool)
    merged = _intervals(spans["doc"], spans["start"], spans["size"])
    starts = offsets[merged["doc"].astype(np.int64)] + merged["start"].astype(np.int64)
    for start, size in zip(starts.tolist(), merged["size"].tolist(), strict=True):
        gone[start : start + size] = True
    return gone


def _remove(table: pa.Table, spans: pa.Table, texts: bool) -> pa.Table:
    """What is left of a part's documents."""
    if not table.num_rows:
        return _EMPTY_TEXTS if texts else _EMPTY
    ids, offsets, data = _part(table)
    gone = covered(offsets, np.frombuffer(b"".join(spans.column("spans").to_pylist()), _SPANS))
    sums = np.concatenate([[0], np.cumsum(gone)])
    begins = gone & ~np.concatenate([[False], gone[:-1]])
    inner = offsets[:-1][offsets[:-1] < len(gone)]
    begins[inner] = gone[inner]
    runs = np.concatenate([[0], np.cumsum(begins)])
    left = data[~gone].tobytes()
    ends = (offsets - sums[offsets]).tolist()
    kept_texts = [left[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    columns = {
        "doc_id": pa.array(ids, pa.int64(), mask=ids == _NULL_ID),
        "n_bytes": pa.array(np.diff(offsets), pa.int64()),
        "n_removed": pa.array(sums[offsets[1:]] - sums[offsets[:-1]], pa.int64()),
        "n_spans": pa.array(runs[offsets[1:]] - runs[offsets[:-1]], pa.int64()),
        "kept_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in kept_texts], pa.string()),
    }
    if texts:
        columns["kept"] = pa.array(kept_texts, pa.binary())
    return pa.table(columns)


_SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
_EMPTY = pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "n_spans": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
_EMPTY_TEXTS = _EMPTY.append_column("kept", pa.array([], pa.binary()))


def part_count(docs: DataFrame, text_col: str = "text") -> int:
    """Parts for the bytes that the texts have: one aggregation over their lengths, whatever the source says of its size."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(LEAST_PARTS, -(-size // PART_BYTES))


def partition_count(parts: int) -> int:
    """Partitions that parts or buckets go to: one each up to OWN_PARTITIONS, then as many as their bytes need."""
    return max(min(parts, OWN_PARTITIONS), min(MOST_PARTITIONS, -(-parts * PART_BYTES // PARTITION_BYTES)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document; with `texts` also the kept bytes."""
    count = parts or part_count(docs, text_col)
    buckets = min(count, MOST_BUCKETS)
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("body"))
    part = F.pmod(F.xxhash64("doc_id", "body", F.spark_partition_id()), F.lit(count)).cast("bigint")
    part_width, bucket_width = partition_count(count), partition_count(buckets)
    dealt = own.select(part.alias("part"), "doc_id", "body").repartition(part_width, "part")
    asked = dealt.groupBy("part").applyInArrow(lambda t: _ask(t, buckets), "bucket bigint, part bigint, hashes binary, counts binary")
    answers = asked.repartition(bucket_width, "bucket").groupBy("bucket").applyInArrow(_answer, "part bigint, bucket bigint, flags binary")
    cut = dealt.groupBy("part").cogroup(answers.repartition(part_width, "part").groupBy("part")).applyInArrow(lambda t, a: _contexts(t, a, buckets), "bucket bigint, part bigint, body binary, doc_id binary, doc binary, start binary, lo binary, hi binary, spans binary")
    spans = cut.repartition(bucket_width, "bucket").groupBy("bucket").applyInArrow(_sort, "part bigint, spans binary")
    return dealt.groupBy("part").cogroup(spans.repartition(part_width, "part").groupBy("part")).applyInArrow(lambda t, s: _remove(t, s, texts), _SCHEMA + ", kept binary" * texts)
