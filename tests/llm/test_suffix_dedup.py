import hashlib
import random

import numpy as np
import pytest

from stacklight.llm import suffix_dedup as S

SCHEMA = "doc_id bigint, text string, n_bytes string"


def brute(docs):
    first = {}
    for i, b in docs:
        for p in range(len(b) - 49):
            key = b[p : p + 50]
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def made(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abé ", k=rng.choice([60, 80, 200]))) for _ in range(5)]
    docs = []
    for i in range(60):
        parts = [rng.choice([rng.choice(base), "".join(rng.choices("xyz", k=rng.randint(0, 60))), rng.choice(base)[: rng.randint(0, 70)], "q" * rng.randint(0, 130)]) for _ in range(rng.randint(0, 4))]
        docs.append((i * 3 + 1, "".join(parts)))
    return docs


@pytest.mark.parametrize("size", [*range(1, 12), 40, 200])
def test_suffix_array(size):
    rng = np.random.default_rng(size)
    for top in (2, 4, 300):
        text = rng.integers(1, top, size)
        assert S.suffix_array(text).tolist() == sorted(range(size), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = made(seed)
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA)
    got = {r[0]: tuple(r[1:]) for r in S.remove_repeats(rows, parts=5).collect()}
    assert got == brute([(i, t.encode()) for i, t in docs])


def test_hot_anchors_go_window_by_window(monkeypatch):
    docs = [(i, t.encode()) for i, t in made(3)]
    import pyarrow as pa
    import pyarrow.compute as pc

    monkeypatch.setattr(S, "HOT", 2)
    parts = {p: pa.table({"part": pa.array([p] * len(v)), "doc_id": pa.array([i for i, _ in v]), "body": pa.array([b for _, b in v], pa.binary())}) for p in range(3) if (v := docs[p::3])}

    def of(table, name, value):
        return table.filter(pc.equal(table.column(name), value))

    asked = pa.concat_tables([S._ask(t, 3) for t in parts.values()])
    answers = pa.concat_tables([S._answer(of(asked, "bucket", b)) for b in range(3)])
    cut = pa.concat_tables([S._contexts(t, of(answers, "part", p), 3) for p, t in parts.items()])
    spans = pa.concat_tables([S._sort(of(cut, "bucket", b)) for b in range(3)])
    out = pa.concat_tables([S._remove(t, of(spans, "part", p), False) for p, t in parts.items()])
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.to_pylist()} == brute(docs)


def test_nulls_repeats_and_long_texts(spark):
    line = "the same line of more than fifty bytes in each of these documents. "
    rows = [(1, None, "a"), (2, "", "a"), (3, line, "a"), (3, line, "a"), (None, line, "a"), (9, line * 3000, "a"), (10, "short", None)]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in S.remove_repeats(spark.createDataFrame(rows, SCHEMA), parts=3).collect()), key=str)
    n = len(line)
    assert got == sorted([(1, 0, 0), (2, 0, 0), (3, n, 0), (3, n, 0), (None, n, n), (9, n * 3000, n * 3000), (10, 5, 0)], key=str)


def test_partitions_stay_few():
    assert S.partition_count(5) == 5 and S.partition_count(S.OWN_PARTITIONS) == S.OWN_PARTITIONS
    assert S.partition_count((1 << 40) // S.PART_BYTES) < 10_000
    assert S.partition_count(10**9) == S.MOST_PARTITIONS


def test_parts_share_partitions(spark, monkeypatch):
    """Many parts in each partition, walked one after another: as by brute force."""
    monkeypatch.setattr(S, "OWN_PARTITIONS", 2)
    docs = made(4)
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA)
    out = S.remove_repeats(rows, parts=11)
    assert out.rdd.getNumPartitions() == 2
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == brute([(i, t.encode()) for i, t in docs])


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA), parts=2).collect() == []
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_default_parts_on_rows_in_memory_and_joined(spark):
    """Spark knows no size of such rows; parts come from the bytes of the texts."""
    docs = made(4)
    rows = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA)
    assert S.part_count(rows) == S.LEAST_PARTS
    want = brute([(i, t.encode()) for i, t in docs])
    assert {r[0]: tuple(r[1:]) for r in S.remove_repeats(rows).collect()} == want
    joined = rows.join(rows.select("doc_id"), "doc_id")
    assert {r[0]: tuple(r[1:]) for r in S.remove_repeats(joined).collect()} == want


def test_rows_without_an_id_share_no_part(spark):
    line = "the same line of more than fifty bytes in each of these documents. "
    rows = [(None, f"{line}{i}", "a") for i in range(40)] + [(7, f"{line}{i}", "a") for i in range(40)]
    got = [(r["doc_id"], r["n_removed"]) for r in S.remove_repeats(spark.createDataFrame(rows, SCHEMA), parts=8).collect()]
    assert sorted(n for i, n in got if i == 7) == [0] * 40 and all(n >= len(line) for i, n in got if i is None) and len(got) == 80


def test_spans_of_many_documents_merge_exactly():
    doc = np.array([70_000, 70_000, 3, 70_000]); start = np.array([9, 10, 1, 2]); size = np.array([1, 5, 2, 3])  # noqa: E702
    assert [tuple(int(v) for v in x) for x in S._intervals(doc, start, size)] == [(3, 1, 2), (70_000, 2, 3), (70_000, 9, 6)]


def test_kept_texts(spark):
    body = "a passage of well over fifty bytes that two documents have in common"
    rows = spark.createDataFrame([(1, "one " + body, ""), (2, body + " two", "")], SCHEMA)
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in S.remove_repeats(rows, parts=2, texts=True).collect()}
    assert kept == {1: "one " + body, 2: " two"}
