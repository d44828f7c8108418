import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklight.llm import ann, chosen_path, components, queries, shingles

DOCS = "doc_id bigint, text string, lang string, source string, n bigint, name string"


# --- nearest neighbours


def exact(vectors, k=5):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in (i for i in ids if i % 50 == 0):
        s = x @ x[ids.index(q)]
        out[q] = sorted(((-round(float(s[j]), 12), i) for j, i in enumerate(ids) if i != q))[:k]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ann_recall(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    want = exact(dict(zip(rows.vec_id, rows.embedding, strict=True)))
    got = collections.defaultdict(list)
    for r in queries.op1_ann(spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hit = sum(len({i for _, i in want[q]} & {i for i, _ in got[q]}) for q in want) / (5 * len(want))
    assert hit >= 0.9
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        known = {i: -s for s, i in want[q]}
        assert all(abs(known[i] - s) < 1e-9 for i, s in found if i in known)


def test_ann_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.standard_normal(8).tolist() for i in range(0, 120)}
    for i in range(200, 400):
        vectors[i] = vectors[50]
    rows = [(i, v) for i, v in vectors.items()] + [(0, vectors[0])]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1050, [float("nan")] * 8), (1003, [None] * 8), (1004, [float("inf")] * 8), (None, vectors[3]), (1100, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, key int, ids string")
    got = collections.defaultdict(list)
    every = ann.Settings(tables=2, probes=1 << 30)  # all buckets are probed: nothing may differ from brute force
    for r in ann.search(df, F.col("vec_id") % 50 == 0, settings=every).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-round(r["score"], 12), r["vec_id"]))
    want = exact(vectors)
    assert {q: got[q] for q in want} == want
    assert set(got) == set(want)  # 1100 has no candidates of its length
    assert ann.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def recall_of(spark, vectors, settings=ann.Settings()):
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    want, got = exact(vectors), collections.defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 50 == 0, settings=settings).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert all(len(got[q]) == 5 for q in want)
    return sum(len({i for _, i in want[q]} & got[q]) for q in want) / (5 * len(want))


def test_ann_in_many_blocks_and_with_more_hashes(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    vectors = {i: (centre + 0.3 * rng.standard_normal(16)).tolist() for i in range(600)}
    assert recall_of(spark, vectors, ann.Settings(block=50, query_block=3)) >= 0.9
    assert recall_of(spark, vectors, ann.Settings(block=50, query_block=3, hashes=3)) >= 0.9


def test_ann_recall_of_evenly_spread_vectors(spark):
    """The hardest case, with the shipped settings, end to end."""
    rng = np.random.default_rng(4)
    assert recall_of(spark, {i: rng.standard_normal(64).tolist() for i in range(3000)}) >= 0.9


@pytest.mark.parametrize("count, most", [(40_000, 0.1), (4_000_000, 0.06)])
def test_ann_rule_keeps_recall_with_few_candidates(count, most):
    """Recall at 5 and share of candidates of the shipped settings: brute force over evenly spread vectors."""
    s, rng = ann.Settings(), np.random.default_rng(5)
    hashes, probes = ann.fit(count, 64, 5, s)
    q = rng.standard_normal((100, 64)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    near, high, some = np.zeros((100, 0, 64), np.float32), np.zeros((100, 0), np.float32), None
    for _ in range(count // 40_000):
        x = rng.standard_normal((40_000, 64), dtype=np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        some = x[:2000]
        score = q @ x.T
        top = np.argpartition(-score, 5, axis=1)[:, :5]
        near = np.concatenate([near, x[top]], axis=1)
        high = np.concatenate([high, np.take_along_axis(score, top, 1)], axis=1)
        best = np.argsort(-high, axis=1)[:, :5]
        near, high = np.take_along_axis(near, best[:, :, None], 1), np.take_along_axis(high, best, 1)
    hit, met = np.zeros((100, 5), bool), np.zeros((100, len(some)), bool)
    for t in range(s.tables):
        own = ann.own_bucket(near.reshape(-1, 64).astype(float), t, hashes, s.seed).reshape(100, 5)
        others = ann.own_bucket(some.astype(float), t, hashes, s.seed)
        for i, probed in enumerate(ann.probed_buckets(q.astype(float), t, hashes, probes, s.seed)):
            hit[i] |= np.isin(own[i], probed)
            met[i] |= np.isin(others, probed)
    assert hit.mean() >= 0.9 and met.mean() < most


@pytest.mark.parametrize("dims", [64, 256, 768])
def test_ann_fits_to_the_cosines_of_a_sample(dims):
    """Vectors in clusters need few probes at any length, where evenly spread ones need very many; recall and share of candidates by brute force."""
    s, rng, count = ann.Settings(), np.random.default_rng(7), 20_000
    x = rng.standard_normal((400, dims))[np.arange(count) % 400] + 0.6 * rng.standard_normal((count, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    seen = ann.sampled_cosines(x[: s.sample], 5, s.pairs)
    assert len(seen) == s.pairs and list(seen) == sorted(seen)
    hashes, probes = ann.fit(count, dims, 5, s, seen)
    assert probes < ann.fit(count, dims, 5, s)[1]
    q, some = x[:100], x[-2000:]
    score = q @ x.T
    score[np.arange(100), np.arange(100)] = -2
    near = x[np.argpartition(-score, 5, axis=1)[:, :5]]
    hit, met = np.zeros((100, 5), bool), np.zeros((100, len(some)), bool)
    for t in range(s.tables):
        own, others = ann.own_bucket(near.reshape(-1, dims), t, hashes, s.seed).reshape(100, 5), ann.own_bucket(some, t, hashes, s.seed)
        for i, probed in enumerate(ann.probed_buckets(q, t, hashes, probes, s.seed)):
            hit[i] |= np.isin(own[i], probed)
            met[i] |= np.isin(others, probed)
    assert hit.mean() >= 0.9 and met.mean() < 0.1


def test_ann_sample_of_few_vectors():
    assert ann.sampled_cosines(np.eye(5), 5, 10) == ()
    assert ann.sampled_cosines(np.eye(6), 5, 4) == (0.0,) * 4


@pytest.mark.parametrize("dims", [8, 96])
def test_ann_of_few_vectors_that_are_far_off(spark, dims):
    """2 to 20 vectors, all opposite to the query: all of them come back, as by brute force."""
    for n in (2, 5, 20):
        x = np.random.default_rng(n).standard_normal((n, dims)) * 0.1
        x[:, 0] = -1
        x[0] = np.eye(dims)[0]
        rows = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id bigint, embedding array<double>")
        got = [r["vec_id"] for r in ann.search(rows, F.col("vec_id") == 0).orderBy("rank").collect()]
        cosine = x @ x[0] / np.linalg.norm(x, axis=1)
        assert got == sorted(range(1, n), key=lambda i: (-cosine[i], i))[:5]


def test_ann_probes_are_the_best_buckets():
    x = np.random.default_rng(6).standard_normal((4, 8))
    for hashes, probes in ((1, 5), (2, 40), (3, 100), (2, 1 << 30)):
        got = ann.probed_buckets(x, 0, hashes, probes, 1)
        heights = [ann.signed_axes(x, 0, w, 1) for w in range(hashes)]
        for i in range(4):
            every = {b: sum(h[i, d] for h, d in zip(heights, digits, strict=True)) for b, digits in enumerate(itertools.product(range(16), repeat=hashes))}
            want = sorted(every.values(), reverse=True)[:probes]
            assert np.allclose([every[b] for b in got[i]], want) and len(set(got[i])) == len(want)
        assert (got[:, 0] == ann.own_bucket(x, 0, hashes, 1)).all()


def test_pseudo_rotation_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 12))
    assert np.allclose(np.linalg.norm(ann.rotate(x, 0, 0, 1), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(ann.hadamard(ann.hadamard(np.eye(8))) / 8, np.eye(8))


# --- n-gram join


def brute(rows, size=5):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[a-z0-9_\x80-\xff]+", (t or "").lower().encode())
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    links, up = collections.Counter(), {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
            links[a] += 1
            links[b] += 1
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: (top(i), links[i]) for i in sets}


def near_copies(seed, groups=6, copies=12):
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(40, 200))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own) + (" " + passage if rng.random() < 0.2 else ""))
    rows += [" ".join(word() for _ in range(rng.randint(0, 40))) + " " + passage for _ in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def joined(spark, rows, settings=chosen_path.Settings()):
    df = spark.createDataFrame([(i, t, "en", "a", 1, "x") for i, t in rows], DOCS)
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in chosen_path.join(df, settings).collect()}


def test_join_equals_brute_force(spark):
    rows = near_copies(1)
    assert joined(spark, rows) == brute(rows)


def test_join_with_split_buckets_and_blocks(spark):
    rows = near_copies(2, groups=2, copies=60)
    tight = chosen_path.Settings(small=8, depth=2, block=16, exact_block=10)
    assert joined(spark, rows, tight) == brute(rows)


def test_join_of_unlike_documents_with_one_passage(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(40)) + " " + passage) for i in range(300)]
    rows += [(1000 + i, rows[i][1].rsplit(" ", 2)[0]) for i in range(0, 300, 10)]
    tight = chosen_path.Settings(small=8, block=16)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    signed = chosen_path.signatures(df, tight).withColumnRenamed("doc_id", "entry")
    sizes = components.components(chosen_path.candidate_links(signed, tight)).groupBy("component").count()
    assert sizes.agg(F.max("count")).first()[0] < len(rows) / 2  # a passage makes no component
    assert joined(spark, rows, tight) == brute(rows)


def test_join_edges(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, "..."), (4, "short text"), (5, "Short, TEXT!"), (6, text), (7, text.upper()), (8, text + " eleven"), (9, "x" * 50_000)]
    got = joined(spark, rows)
    assert got == brute(rows)
    assert got[1] == (1, 0) and got[4] == got[5] == (4, 1) and got[6][0] == 6 and got[8][0] == 6
    df = spark.createDataFrame([(None, text, "en", "a", 1, "x"), (6, text, "en", "a", 1, "x"), (6, text, "en", "a", 1, "x")], DOCS)
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in chosen_path.join(df).collect()), key=str) == sorted([(None, None, 0), (6, 6, 0)], key=str)
    assert chosen_path.join(df.limit(0)).collect() == []


def test_recall_of_the_parameters():
    assert chosen_path.recall() >= chosen_path.Settings().target and chosen_path.runs_of(chosen_path.Settings(target=0.9)) < chosen_path.runs_of()


def test_pairs_meet_as_often_as_the_formula_says():
    """Pairs of similarity 0.8 whose buckets are all split: the share that has a common path of full length in any run."""
    import pyarrow as pa

    rng, pairs, rows = np.random.default_rng(8), 300, []
    for _ in range(pairs):
        words = rng.integers(0, 1 << 62, 300).astype(str)
        rows += [" ".join(words), " ".join(words[: int(300 * 0.805)])]
    s = chosen_path.Settings(target=0.9)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2 * pairs), pa.int64()), pa.array([r.encode() for r in rows], pa.binary())], ["doc_id", "body"])
    table = pa.Table.from_batches(chosen_path._signed(iter([batch]), s)).to_pylist()

    def full(row):
        sampled = lambda e, t: random.Random(str((e, t))).random() < s.splits / min(chosen_path.SAMPLE, row["n"])
        ends = [(b, t) for b in row["paths"] for t in row["sample"] if sampled(b, t)]
        for level in range(1, s.depth):
            ends = [(*e, row["sketch"][random.Random(str((e, level))).randrange(chosen_path.SKETCH)]) for e in ends]
        return set(ends)

    met = np.mean([bool(full(table[2 * i]) & full(table[2 * i + 1])) for i in range(pairs)])
    assert abs(met - chosen_path.recall(s, 0.805)) < 0.07


def test_group_of_near_copies_is_split_in_one_run_only(spark, monkeypatch):
    """What the first run ties is not split again in the others; entries that it leaves loose still find all their links."""
    rng, seen = random.Random(9), []
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    base, rows = [word() for _ in range(120)], []
    for i in range(300):
        own = list(base)
        for _ in range(8 if i % 20 == 0 else rng.choice([1, 2, 3])):
            own[rng.randrange(len(own))] = word()
        rows.append((i, " ".join(own)))

    def counted(rows, large, plain=chosen_path._with_large):
        seen.append(rows.join(large, "bucket").count())
        return plain(rows, large)

    monkeypatch.setattr(chosen_path, "_with_large", counted)
    assert joined(spark, rows, chosen_path.Settings(small=32, aside=64)) == brute(rows)
    assert sum(seen) < 25 * len(rows)


def test_large_buckets_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BROADCAST_BUCKETS", 0)
    rows = near_copies(4, groups=2, copies=50)
    assert joined(spark, rows, chosen_path.Settings(small=8, depth=2, block=16, exact_block=10)) == brute(rows)


def test_shingles():
    texts = ["a b c d e f", "", "a b", "a b c d e f a b c d e f"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    sets = shingles.shingle_sets(offsets, np.frombuffer(data, np.uint8))
    assert [len(s) for s in sets] == [2, 0, 1, 6]
    assert set(sets[0]) <= set(sets[3])


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (100, 300), (7, 7)]
    got = {r["v"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("count", [2, 5, 6, 20])
@pytest.mark.parametrize("dims", [8, 64])
def test_ann_few_and_far_candidates_all_come_back(spark, count, dims):
    rng = np.random.default_rng(count + dims)
    away = rng.normal(size=dims)
    vectors = {i: (away + 0.01 * rng.normal(size=dims)).tolist() for i in range(1, count)} | {0: (-away).tolist()}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>")
    got = [(r["vec_id"], round(r["score"], 9)) for r in ann.search(rows, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(i, round(-minus, 9)) for minus, i in exact(vectors)[0]]
