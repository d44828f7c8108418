"""Repair of conversations by alignment with the role grammar ``(s?(ua)+)?``.

A conversation's turns are aligned with the alternating string of each length that the grammar
allows: even lengths are (ua)*, odd ones have an s in front. Keeping a turn costs 0, giving it
another role 2, deleting it 3, inserting an empty one 2, and a truncated turn that stays 1 more; blank and
repeated turns must go. The table of Wagner and Fischer is filled from the ends: read
backwards, the strings of all lengths are one, so one table holds the cheapest alignment of
every tail of the turns with every tail of every string. Only cells in Ukkonen's band are filled:
those that the cost of an alignment that is known already doesn't rule out. The incumbent is first
the better of two plain ones, then what a narrow band gives. Of the lengths with the least cost
each is traced through the table by its first letters in ASCII order, and the least audit wins.

A conversation is one unit, as a text is: Spark deals conversations out by a hash, sorts
their turns, and a task holds one conversation and a band of its table at a time.

Defined results: turns are read in the order of turn (nulls first), then role, then text; null
roles and texts are one blank; rows without a conv_id are one conversation; a conversation
without any turn left has cost 0, an empty audit and no turns; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklight.llm.common import each_group

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: More than any alignment costs, and the first band.
NEVER, NARROW = np.int64(1) << 40, 8


def damaged(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text, gone: damage by crc32 of 'conv:turn' modulo 20. A dropped row stays with `gone`, so that its conversation is known; a repeated one comes twice."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.encode(F.concat(filled(conv_id), F.lit(":"), filled(turn)), "UTF-8")), F.lit(20))
    out = turns.select(F.col(conv_id).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), filled(role).alias("role"), filled(text).alias("text"), kind.alias("kind"))
    left = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")
    return out.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), left.alias("text"), (F.col("kind") == 0).alias("gone"), copies).drop("copy")


def marked(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text, gone) with `blank` and `cut`: the last character that isn't white is no end of a sentence."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return turns.withColumns({"blank": last == "", "cut": ~last.isin(".", "!", "?")})


class Alignment:
    """Turns against every string of the grammar.

    initials: of roles. forced: must be deleted. extra: cost of staying. Cell (i, r) is the cheapest way from turn i on to the last
    r letters of a string; letters from the end are a, u, a, u and so on.
    """

    def __init__(self, initials: list[str], forced: np.ndarray, extra: np.ndarray):
        self.n, self.forced, self.extra, self.initials = len(initials), forced, extra, initials
        self.left = np.append(np.cumsum(~forced[::-1])[::-1], 0)  # turns from i on that may stay
        self.is_u, self.is_a, self.is_s = (np.array([x == c for x in initials], bool) for c in "uas")
        self.floor = DELETE * int(forced.sum()) + int(extra[~forced].sum())  # a turn that may stay costs no less, kept or not

    def plain(self) -> int:
        """The cost of deleting all, or of turns laid on an even string one by one with one insertion if they are odd."""
        own = np.flatnonzero(~self.forced)
        want_a = (len(own) - np.arange(len(own))) % 2 == 1
        fits = np.where(want_a, self.is_a[own], self.is_u[own])
        laid = self.floor + REROLE * int((~fits).sum()) + INSERT * (len(own) % 2)
        if len(own) % 2:  # the string is one longer, and what it lacks is the u in front
            laid = min(laid, self.floor + REROLE * int((~fits).sum()) + INSERT)
        return min(laid, DELETE * self.n)

    def fill(self, most: int) -> None:
        """Cells of paths that cost at most `most`. self.rows[i]: (first r, costs)."""
        spare = max(0, most - self.floor)
        self.rows: list[tuple[int, np.ndarray]] = [(0, np.zeros(0, np.int64))] * (self.n + 1)
        width = spare // INSERT + 1
        r = np.arange(0, width + 1, dtype=np.int64)
        self.rows[self.n] = (0, INSERT * r)
        for i in range(self.n - 1, -1, -1):
            low = max(0, int(self.left[i]) - spare // (DELETE - TRUNCATED) - 1)
            r = np.arange(low, int(self.left[i]) + width + 1, dtype=np.int64)
            cost = self._at(i + 1, r) + DELETE
            if not self.forced[i]:
                fits = np.where(r % 2 == 1, self.is_a[i], self.is_u[i])
                stay = self._at(i + 1, r - 1) + np.where(fits, 0, REROLE) + int(self.extra[i])
                cost = np.minimum(cost, np.where(r > 0, stay, NEVER))
            cost = np.minimum.accumulate(cost - INSERT * r) + INSERT * r  # insertions
            self.rows[i] = (low, cost)

    def _at(self, i: int, r: np.ndarray) -> np.ndarray:
        first, costs = self.rows[i]
        place = r - first
        inside = (place >= 0) & (place < len(costs))
        return np.where(inside, costs[np.where(inside, place, 0)], NEVER)

    def _one(self, i: int, r: int) -> int:
        first, costs = self.rows[i]
        return int(costs[r - first]) if 0 <= r - first < len(costs) else int(NEVER)

    def ends(self) -> list[tuple[int, int]]:
        """(cost, length) of each string; an odd one begins with a turn that stays as s."""
        first, costs = self.rows[0]
        out = [(int(c), first + k) for k, c in enumerate(costs.tolist()) if (first + k) % 2 == 0 and c < NEVER]
        best: dict[int, int] = {}
        for i in np.flatnonzero(self.is_s & ~self.forced).tolist():
            first, costs = self.rows[i + 1]
            for k, c in enumerate(costs.tolist()):
                if (first + k) % 2 == 0 and first + k > 0 and c < NEVER:
                    length = first + k + 1
                    best[length] = min(best.get(length, int(NEVER)), DELETE * i + int(self.extra[i]) + c)
        return out + [(c, length) for length, c in best.items()]

    def audit(self, cost: int, length: int) -> str:
        """The first of the cheapest alignments with a string, in ASCII order: D, I, K, R."""
        out, i, r = [], 0, length
        tail = None
        if length % 2:  # up to the turn that becomes s there are deletions alone; the suffix minimum tells whether one more still ends cheapest
            stays = [self._one(k + 1, length - 1) + DELETE * k + int(self.extra[k]) if self.is_s[k] and not self.forced[k] else int(NEVER) for k in range(self.n)]
            at = max(k for k, c in enumerate(stays) if c == cost)
            out, i, r = ["D"] * at + ["K"], at + 1, length - 1
        tail = self._one(i, r)
        while i < self.n or r:
            if i < self.n and self._one(i + 1, r) + DELETE == tail:
                out.append("D")
                i += 1
            elif r and self._one(i, r - 1) + INSERT == tail:
                out.append("I")
                r -= 1
            else:
                fits = self.is_a[i] if r % 2 else self.is_u[i]
                out.append("K" if fits else "R")
                i, r = i + 1, r - 1
            tail = self._one(i, r)
        return "".join(out)

    def best(self) -> tuple[int, str]:
        """(cost, audit)."""
        known = self.plain()
        narrow = min(known, self.floor + NARROW)
        while True:
            self.fill(narrow)
            ends = self.ends()
            least = min((c for c, _ in ends), default=int(NEVER))
            if least <= narrow:
                break
            narrow = min(known, least, self.floor + 4 * (narrow - self.floor))
        return least, min(self.audit(least, length) for c, length in ends if c == least)


def repaired(audit: str, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    left = sum(e != "D" for e in audit)
    out_roles, out_texts, at = [], [], 0
    for e in audit:
        want = "assistant" if left % 2 else "user"
        if e == "I":
            out_roles.append(want)
            out_texts.append("")
        elif e != "D":
            out_roles.append(roles[at] if e == "K" else want)
            out_texts.append(texts[at])
        left -= e != "D"
        at += e != "I"
    return out_roles, out_texts


_LEGAL = {"su", "ua", "au"}
_SCHEMA = "conv bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, turns array<struct<role:string,text:string>>"


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    out, size = [], 0
    for group in each_group(batches, 2):
        named, conv = group.column("named")[0].as_py(), group.column("key")[0].as_py()
        group = group.filter(pa.compute.invert(group.column("gone")))
        turns = {t for t in group.column("turn").to_pylist() if t is not None}
        roles, texts = group.column("role").to_pylist(), group.column("text").to_pylist()
        blank, cut = (np.array(group.column(c).to_pylist(), bool) for c in ("blank", "cut"))
        seen: set[tuple[str, str]] = set()
        again = np.array([x in seen or bool(seen.add(x)) for x in zip(roles, texts, strict=True)], bool) & ~blank
        cut = cut & ~blank & ~again
        initials = [x[:1] for x in roles]
        illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
        cost, audit = Alignment(initials, blank | again, cut.astype(np.int64) * TRUNCATED).best()
        new = repaired(audit, roles, texts)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv if named else None, gaps, int(blank.sum()), int(again.sum()), int(cut.sum()), illegal, cost, audit, [{"role": a, "text": b} for a, b in zip(*new, strict=True)]))
        size += group.nbytes
        if len(out) >= 4096 or size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def repair(turns: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, turns (role, text, as repaired): a row for each conversation of turns (conv, turn, role, text, gone)."""
    named: Column = F.col("conv").isNotNull()
    keyed = marked(turns).select(named.cast("int").alias("named"), F.coalesce("conv", F.lit(0)).alias("key"), "turn", "role", "text", "gone", "blank", "cut")
    dealt = keyed.repartition("named", "key").sortWithinPartitions("named", "key", F.asc_nulls_first("turn"), "role", "text")
    return dealt.mapInArrow(_repair, _SCHEMA)


def digest(turns: str = "turns") -> Column:
    """SHA-256 of repaired turns, role:text, joined by line ends."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"), 256)
