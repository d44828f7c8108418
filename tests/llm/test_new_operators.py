import functools
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklight.llm import queries, turns, whitening, winnowing

from .test_text_operators import docs_frame

# --- decontamination


def plain_contamination(docs, items, span=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                own = windows.get(tuple(w[s : s + n]))
                if own:
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((d, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=str)


def contaminated(spark, docs, items):
    got = winnowing.contamination(docs_frame(spark, [(*d, "en", "a") for d in docs]), spark.createDataFrame(items, "item_id bigint, text string"))
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got.collect()], key=str)


def test_decontamination_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    want = sorted(map(tuple, con.sql(queries.oracle_sql()["op12_decontamination"]).df()[["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]].values.tolist()))
    got = sorted(tuple(r) for r in queries.op12_decontamination(spark, sf_dir).collect())
    assert got == want and any(r[-1] for r in got)


def test_decontamination_edges(spark):
    rng = np.random.default_rng(1)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 40, n)]
    items = [(i, " ".join(word(n))) for i, n in enumerate([30, 10, 9, 5, 3, 2, 1, 11, 80, 300])]
    items += [(10, None), (11, ""), (12, "... !"), (1, items[0][1]), (None, "alpha beta gamma"), (13, "É lan, ß9"), (14, "same " * 200), (15, "same " * 12)]
    docs = [(1, None), (2, ""), (3, "?"), (3, "again Alpha  BETA-gamma"), (None, items[1][1]), (4, "é lan ß9 é LAN ß9"), (5, "É LAN\nß9"), (6, "same " * 500), (7, "same " * 9)]
    for k in range(60):
        own = items[int(rng.integers(0, 10))][1].split()
        at = int(rng.integers(0, len(own)))
        docs.append((100 + k, " ".join([*word(int(rng.integers(0, 150))), *own[at : at + int(rng.integers(1, 40))], *word(int(rng.integers(0, 150)))]).upper()))
    docs.append((200, " ".join(word(5000) + items[9][1].split() + word(63))))
    assert contaminated(spark, docs, items) == plain_contamination(docs, items)
    assert contaminated(spark, docs, [(1, None)]) == plain_contamination(docs, [])
    assert contaminated(spark, [], items) == []
    kept = winnowing.clean(docs_frame(spark, [(*d, "en", "a") for d in docs]), spark.createDataFrame(items, "item_id bigint, text string"))
    hit = {d for d, _, h, _ in plain_contamination(docs, items) if h}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - hit | {None}


def test_winnowing_without_broadcasts(spark, monkeypatch):
    items, docs = [(1, " ".join(f"a{k}" for k in range(25)))], [(1, "x " + " ".join(f"a{k}" for k in range(3, 17)) + " y"), (2, "a1 a2")]
    monkeypatch.setattr(winnowing, "BROADCAST_ROWS", 0)
    assert contaminated(spark, docs, items) == [(1, 16, 14, ["1"]), (2, 2, 0, [])]


# --- conversations


def plain_repair(rows):
    """(cost, audit) by trying every edit from every state of the grammar; rows: (initial, must go, truncated)."""
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def tail(i, state, inserted):
        best = (0, "") if i == len(rows) and state in ("", "a") else None
        tries = []
        if i < len(rows):
            initial, gone, cut = rows[i]
            tries.append((3, "D", i + 1, state, 0))
            if not gone:
                tries += [(cut, "K", i + 1, initial, 0)] if initial in steps[state] and initial else []
                tries += [(2 + cut, "R", i + 1, c, 0) for c in steps[state] if c != "s"]
        if inserted < 4:
            tries += [(2, "I", i, c, inserted + 1) for c in steps[state] if c != "s"]
        for cost, letter, *there in tries:
            rest = tail(*there)
            if rest is not None:
                found = (cost + rest[0], letter + rest[1])
                best = found if best is None or found < best else best
        return best

    return tail(0, "", 0)


def test_alignment_against_brute_force():
    rng = np.random.default_rng(3)
    for k in range(3000):
        n = int(rng.integers(0, 12))
        rows = [(str(rng.choice(list("ssuuuaaax"))) if rng.random() < 0.97 else "", bool(rng.random() < 0.2), int(rng.random() < 0.2)) for _ in range(n)]
        rows = [(c, g, 0 if g else t) for c, g, t in rows]
        own = turns.Alignment([c for c, _, _ in rows], np.array([g for _, g, _ in rows], bool), np.array([t for _, _, t in rows], np.int64))
        assert own.best() == plain_repair(tuple(rows)), rows


def test_long_conversation_is_aligned():
    rng = np.random.default_rng(5)
    initials = ["s", *(("ua" if rng.random() < 0.9 else "uu")[k % 2] for k in range(3000))]
    own = turns.Alignment(initials, rng.random(3001) < 0.05, (rng.random(3001) < 0.05).astype(np.int64))
    cost, audit = own.best()
    assert cost >= own.floor and set(audit) <= set("DIKR")


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_repair_against_brute_force(spark):
    rng = np.random.default_rng(7)
    texts = ["Hello there.", "yes", "no!", "", " \t\n", "What?", None, "a\x0b.", ". \r\n", "é", "\xa0"]
    rows = [(int(c), None if rng.random() < 0.05 else int(t), rng.choice(["user", "assistant", "system", "user", "assistant", None, "tool"]), rng.choice(texts)) for c in range(150) for t in range(int(rng.integers(1, 9)))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (500, None, "user", "Hi."), (501, 3, None, None)] + rows[:5]
    rows = [(c, t, None if r is None else str(r), None if x is None else str(x)) for c, t, r, x in rows]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, gone string")
    got = {r["conv"]: r for r in turns.repair(turns.damaged(df)).withColumn("sha", turns.digest()).collect()}
    assert set(got) == {r[0] for r in rows}
    after = damaged_rows(rows)
    white = re.compile(r"[^\x20\x09-\x0D]")
    for conv, r in got.items():
        own = sorted([x[1:] for x in after if x[0] == conv], key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, marks, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            signs = white.findall(text)
            fault = 0 if not signs else 1 if (role, text) in seen else 2 if signs[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marks.append((role[:1], fault in (0, 1), int(fault == 2)))
        numbers = {x[0] for x in own} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        cost, audit = plain_repair(tuple(marks))
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"]) == (gaps, *counts, illegal, cost, audit), conv
        initials = "".join(t["role"][0] for t in r["turns"])
        assert re.fullmatch("(s?(ua)+)?", initials)
        stay = [x for x, e in zip(own, audit.replace("I", "")) if e != "D"]
        assert [t["text"] for t, e in zip(r["turns"], audit.replace("D", "")) if e != "I"] == [x[2] for x in stay]
        assert [t["role"] for t, e in zip(r["turns"], audit.replace("D", "")) if e == "K"] == [x[1] for x, e in zip(own, audit.replace("I", "")) if e == "K"]
        assert r["sha"] == hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in r["turns"]).encode()).hexdigest()
    assert turns.repair(turns.damaged(df.limit(0))).collect() == []


# --- whitening


def plain_whitening(vectors, most=32):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    off = n * x - sums
    centred = off / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return (off * off).sum(1), centred @ axes / np.sqrt(values), values / np.trace(cov)


def test_whitening_against_numpy(spark, sf_dir):
    import pandas as pd

    table = pd.read_parquet(f"{sf_dir}/embeddings.parquet").sort_values("vec_id")
    deviation, white, explained = plain_whitening(np.stack(table["embedding"]))
    got = queries.op11_whitening(spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == len(table) * 32 and got.dtypes["component"] == np.int32
    assert got["n"].eq(len(table)).all() and (got["deviation"].to_numpy().reshape(-1, 32) == deviation[:, None]).all()
    own = got["whitened"].to_numpy().reshape(-1, 32)
    signs = np.sign((own * white).sum(0))
    assert np.abs(own * signs - white).max() < 1e-6
    assert np.abs(got["explained"].to_numpy().reshape(-1, 32)[0] / explained - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


VECTORS = "vec_id bigint, embedding array<double>, id string, index string"


@pytest.mark.parametrize("big", [1.0, 1e9])
def test_whitening_edges(spark, big):
    rng = np.random.default_rng(2)
    rows = [(k, (big * rng.normal(size=3)).tolist()) for k in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 1.0, 1.0]), (105, [1.0, 2.0])]
    again = [(0, rows[0][1]), (None, [0.0, 0.0, 0.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, "a", "b") for r in rows + odd + again], VECTORS)).collect()
    deviation, white, explained = plain_whitening([v for _, v in rows + again]) if big == 1.0 else (None, None, None)
    assert len(got) == 42 and all(len(r["whitened"]) == 3 for r in got) and got[0]["identity_error"] < 1e-9
    if big == 1.0:
        assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"]) for r in got) == sorted((i is None, i or 0, int(d)) for (i, _), d in zip(rows + again, deviation, strict=True))
    else:
        x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows + again]
        sums = [sum(c) for c in zip(*x)]
        exact = {i: sum((42 * c - s) ** 2 for c, s in zip(v, sums)) for (i, _), v in zip(rows + again, x)}
        assert all(r["deviation"] == (exact[r["vec_id"]] if exact[r["vec_id"]] < 2**63 else None) for r in got)
    assert whitening.whiten(spark.createDataFrame([(1, None, "a", "b")], VECTORS)).collect() == []


def test_whitening_without_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "a", "b")], VECTORS)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, [None, None], [None, None])]
    flat = whitening.whiten(spark.createDataFrame([(k, [float(k), 5.0], "a", "b") for k in range(4)], VECTORS)).collect()
    assert all(r["whitened"][1] is None and abs(r["whitened"][0]) > 0.4 and r["explained"] == [1.0, 0.0] for r in flat)
