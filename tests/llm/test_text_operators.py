import base64
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklight.llm import bpe, chunk_dedup, html_text, licenses, mixing, queries, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, kept string, body string"
RANKS = None


def docs_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)


def against_sql(df, sql, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    want = con.sql(sql).df()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    text = lambda d: sorted(map(tuple, d[columns].astype(object).where(d[columns].notna(), None).astype(str).values.tolist()))
    assert text(got) == text(want)


# --- exact dedup


def test_exact_dedup_equals_sql(spark, sf_dir):
    against_sql(queries.op8_exact_dedup(spark, sf_dir), queries.oracle_sql()["op8_exact_dedup"], sf_dir, "documents")


def test_exact_dedup_edges(spark):
    long = "word and Word " * 20_000
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (5, "Ab É", "en", None), (4, "aB É", None, "a"), (6, "ab é", "en", "a"), (7, long, "en", "a"), (8, long.lower(), "en", "a"), (9, long + "x", "en", "a"), (None, "ab É", "en", "a"), (4, "aB É", "en", "a")]
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in chunk_dedup.exact_duplicates(docs_frame(spark, rows)).collect()}
    digest = lambda t: hashlib.sha256(t.encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))).hexdigest()
    assert got == {
        (1, digest("")): (2, 2, False), (2, digest("")): (2, 2, True), (5, digest("ab É")): (5, 4, True), (4, digest("ab É")): (5, 4, False), (None, digest("ab É")): (5, 4, False),
        (6, digest("ab é")): (6, 1, True), (7, digest(long)): (8, 2, False), (8, digest(long)): (8, 2, True), (9, digest(long + "x")): (9, 1, True),
    }
    assert chunk_dedup.exact_duplicates(docs_frame(spark, [])).collect() == []


def test_chunks_are_found_again_after_an_insertion():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, 200_000).astype(np.uint8)
    b = np.concatenate([a[:50_000], np.full(7, 65, np.uint8), a[50_000:]])
    cut = lambda x: {bytes(x[i:j]) for c in chunk_dedup.cut_points(np.array([0, len(x)]), x) for i, j in zip([0, *c[:-1]], c, strict=True)}
    shared = cut(a) & cut(b)
    assert sum(map(len, shared)) > 180_000
    assert b"".join(bytes(a[i:j]) for c in chunk_dedup.cut_points(np.array([0, len(a)]), a) for i, j in zip([0, *c[:-1]], c, strict=True)) == a.tobytes()
    same = np.zeros(300_000, np.uint8)
    assert max(np.diff([0, *chunk_dedup.cut_points(np.array([0, len(same)]), same)[0]])) <= chunk_dedup.MAX_CHUNK


def test_chunk_store(spark):
    rows = [(1, "x" * 100, "en", "a"), (2, "x" * 100, "en", "a"), (3, "y", "en", "a")]
    got = {(r["n_bytes"], r["n_uses"], r["first_doc_id"]) for r in chunk_dedup.chunk_store(docs_frame(spark, rows)).collect()}
    assert got == {(100, 2, 1), (1, 1, 3)}
    store = chunk_dedup.chunk_store(docs_frame(spark, rows))
    assert {bytes(r["content"]) for r in store.collect()} == {b"x" * 100, b"y"} and chunk_dedup.verify(store) == 2


def test_chunks_are_verified_without_moving_them(spark):
    rows = [(i, "x" * 100 + "yz" * (i % 3), "en", "a") for i in range(40)]
    store = chunk_dedup.chunk_store(docs_frame(spark, rows), contents=False)
    assert "content" not in store.columns and all(r["verified"] for r in store.collect())
    full = chunk_dedup.chunk_store(docs_frame(spark, rows)).drop("content")
    assert sorted(map(tuple, store.select(full.columns).collect())) == sorted(map(tuple, full.collect()))


def test_an_identifier_of_two_chunks_raises(spark, monkeypatch):
    rows = [(i, f"text number {i}", "en", "a") for i in range(20)]
    store = chunk_dedup.chunk_store(docs_frame(spark, rows))
    assert chunk_dedup.verify(store) == 20
    with pytest.raises(ValueError):
        chunk_dedup.verify(store.withColumn("verified", F.col("n_bytes") < 0))
    monkeypatch.setattr(chunk_dedup, "ID_BYTES", 0)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"one", b"two"])], ["doc_id", "body"])
    with pytest.raises(ValueError):
        list(chunk_dedup._chunks(iter([batch])))


def test_recipes_are_ordered_lists(spark):
    rng = np.random.default_rng(1)
    text = "".join(map(chr, rng.integers(97, 123, 20_000)))
    rows = [(1, text, "en", "a"), (2, text.upper(), "en", "a"), (3, text[10_000:] + text[:10_000], "en", "a")]
    got = {r["doc_id"]: r["recipe"] for r in chunk_dedup.recipes(docs_frame(spark, rows)).collect()}
    assert got[1] == got[2] != got[3] and len(got[1]) > 10 and len(set(map(bytes, got[1])) & set(map(bytes, got[3]))) > 8


# --- byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(tokenizer):
    path, pattern, library = tokenizer
    codec, rng = bpe.codec(path, pattern), random.Random(1)
    texts = ["", "a" * 3000, "it's  we'll\n\n  x\t", "naïve façade ½ ²", "中文 \U0001f600 ́x", "\x1c\x85\xa0 z", "<|endoftext|>"]
    texts += ["".join(rng.choices("ab éñ中\U0001f600\n '1.,st", k=rng.randint(0, 300))) for _ in range(300)]
    texts += ["".join(rng.choices([chr(c) for c in range(256)], k=200)) for _ in range(100)]
    for t in texts:
        ids = library.encode_ordinary(t)
        assert codec.encode(t) == ids
        assert codec.decode(ids) == t.encode()


def test_perfect_hash(tokenizer):
    words = list(bpe.read_ranks(tokenizer[0]))[:5000]
    table = bpe.PerfectHash(words)
    assert [table.find(w) for w in words] == list(range(len(words)))
    assert sorted(table.slots) == list(range(len(words)))
    assert table.find(b"not in there at all") == -1 and bpe.PerfectHash([]).find(b"x") == -1


def test_bpe_on_spark(spark, tokenizer):
    path, pattern, library = tokenizer
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "Hello  wörld", "en", "a"), (3, "Hello  wörld", "en", "a"), (None, "x", "en", "a"), (4, "lorem ipsum " * 5000, None, None)]
    df = docs_frame(spark, rows)
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df, path, pattern).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(df, path, pattern), path, pattern)
    assert sorted((r["text"] for r in back.collect())) == sorted((t or "") for _, t, *_ in rows)
    assert bpe.round_trip(docs_frame(spark, []), path, pattern).collect() == []


# --- toxicity


def test_toxicity_on_the_held_out_fold(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = queries.op2_toxicity(spark, sf_dir).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got["held_out"].items())
    both = got.drop(columns="toxic").join(labels, how="inner")
    held = both[both["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.96
    assert (held["toxic"][held["predicted"] == 1]).mean() > 0.9 and (held["predicted"][held["toxic"] == 1]).mean() > 0.75


def test_toxicity_edges(spark):
    bad, good = "you are a loser and an idiot", "what a fine day it is"
    rows = [(i, f"{bad if i % 3 == 0 else good} number {i % 7}", "en", "a") for i in range(1, 400)]
    df = docs_frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 400)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(df, labels)
    more = docs_frame(spark, [(1, None, None, None), (2, "", "en", "a"), (3, bad, "xx", "a"), (4, good, "en", "a"), (None, bad, "en", "a"), (5, (good + " ") * 9000 + bad, "en", "a")])
    got = {r["doc_id"]: (round(r["score"], 9), r["toxic"]) for r in toxicity.scores(more, model).collect()}
    assert got[1] == got[2] and not got[4][1] and got[3][1] and got[None][1] and got[5][1]
    assert sorted(r["doc_id"] for r in toxicity.clean(more, model).collect()) == [1, 2, 4]
    assert toxicity.clean(more, model).columns == more.columns
    assert toxicity.scores(docs_frame(spark, []), model).collect() == []
    empty = toxicity.train(docs_frame(spark, []), labels.limit(0))
    assert [r["score"] for r in toxicity.scores(more, empty).collect()] == [0.0] * 6


def plain_score(model, text):
    """The forward pass word by word: no cache, no windows, no projections."""
    import re

    s, words = model.settings, re.findall(r"\w+", text.lower())
    rows = toxicity.features(words, s.table_bits)
    x = [sum(model.table[r].astype(float) for r in row) for row in rows]
    act = []
    for j, kernel in enumerate(model.kernels):
        for f in range(s.filters):
            sums = [sum(float(x[at + o] @ kernel[o, :, f]) for o in range(len(kernel))) for at in range(len(x) - len(kernel) + 1)]
            act.append(max(0.0, (max(sums) if sums else 0.0) + model.bias[j * s.filters + f]))
    z = sum(a * w for a, w in zip(act, model.out, strict=True)) + model.out_bias
    return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def test_toxicity_scores_equal_a_plain_forward_pass(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    rows = sorted(docs.collect(), key=lambda r: len(r["text"] or ""))
    some = [r for r in rows if len(r["text"] or "") < 3000][::4]
    assert len(some) > 20 and all(abs(got[r["doc_id"]] - plain_score(model, r["text"] or "")) < 1e-4 for r in some)


def test_toxicity_of_repeated_ids(spark):
    bad, good = "you are a loser and an idiot", "what a fine day it is"
    rows = [(i, f"{bad if i % 3 == 0 else good} number {i % 7}", "en", "a") for i in range(1, 200)]
    labels = [(i, int(i % 3 == 0)) for i in range(1, 200)]
    one = toxicity.train(docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    twice = toxicity.train(docs_frame(spark, rows[::-1] + rows), spark.createDataFrame(labels[::-1] + [(i, 0) for i, _ in labels], "doc_id bigint, toxic int"))
    assert np.array_equal(one.table, twice.table) and one.thresholds == twice.thresholds


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    bad, good = "you are a loser and an idiot", "what a fine day it is"
    rows = [(i, f"{bad if i % 3 == 0 else good} number {i % 7}", "en", "a") for i in range(1, 9_001)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, *_ in rows], "doc_id bigint, toxic int")
    seen, begun, calibrate = {}, toxicity._begun, toxicity.calibrate
    monkeypatch.setattr(toxicity, "_begun", lambda s, counts, toxic, n, pos: seen.update(fit=n, pos=pos) or begun(s, counts, toxic, n, pos))
    monkeypatch.setattr(toxicity, "calibrate", lambda scored: seen.update(tune=scored.count()) or calibrate(scored))
    model = toxicity.train(docs_frame(spark, rows), labels, toxicity.Settings(epochs=1))
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, *_ in rows}
    assert seen == {"fit": sum(f > 1 for f in fold.values()), "pos": sum(f > 1 and i % 3 == 0 for i, f in fold.items()), "tune": sum(f == 1 for f in fold.values())}
    got = {r["doc_id"]: r["toxic"] for r in toxicity.scores(docs_frame(spark, rows), model).collect()}
    assert got == {i: i % 3 == 0 for i in got} and set(model.thresholds) == {"", "en"}


def test_toxicity_learns_from_long_texts(spark):
    bad, good = "you are a loser and an idiot", "what a fine day it is"
    rows = [(i, f"{(good + ' ') * 2_000}{bad if i % 3 == 0 else good} number {i % 7}", "en", "a") for i in range(1, 200)]
    model = toxicity.train(docs_frame(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i, *_ in rows], "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r["toxic"] for r in toxicity.scores(docs_frame(spark, [(1, bad, "en", "a"), (2, good, "en", "a")]), model).collect()}
    assert got == {1: True, 2: False}


def test_toxicity_of_many_blocks_does_not_depend_on_partitions(spark):
    bad, good = "you are a loser and an idiot", "what a fine day it is"
    rows = [(i, f"{bad if i % 3 == 0 else good} number {i % 7}", "en", "a") for i in range(1, 600)]
    labels, s = spark.createDataFrame([(i, int(i % 3 == 0)) for i, *_ in rows], "doc_id bigint, toxic int"), toxicity.Settings(block=50)
    one, other = (toxicity.train(docs_frame(spark, rows).repartition(n), labels.repartition(n), s) for n in (1, 7))
    assert np.array_equal(one.table, other.table) and np.array_equal(one.out, other.out) and one.out_bias == other.out_bias and one.thresholds == other.thresholds
    got = {r["doc_id"]: r["toxic"] for r in toxicity.scores(docs_frame(spark, rows), one).collect()}
    assert got == {i: i % 3 == 0 for i in got}


def test_toxicity_of_more_labels_than_are_broadcast(spark, monkeypatch):
    """The same model, from texts that are shuffled once, hardly any of them without a label."""
    bad, good = "you are a loser and an idiot", "what a fine day it is"
    rows = [(i, f"{bad if i % 3 == 0 else good} number {i % 7}", "en", "a") for i in range(1, 4_000)]
    rows += [(i, "another text of an id that has two", "en", "a") for i in range(1, 200, 7)] + [(i, None, "en", "a") for i in (3, 5_000)] + [(None, good, "en", "a")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 800)] + [(9_000_000 + i, 1) for i in range(50)], "doc_id int, toxic int")
    one = toxicity.train(docs_frame(spark, rows), labels, toxicity.Settings(block=50))
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 10)
    first, mapped = [], toxicity.mapped
    monkeypatch.setattr(toxicity, "mapped", lambda df, *more: first.append(df) or mapped(df, *more))
    other = toxicity.train(docs_frame(spark, rows), labels, toxicity.Settings(block=50))
    assert np.array_equal(one.table, other.table) and np.array_equal(one.out, other.out) and one.out_bias == other.out_bias and one.thresholds == other.thresholds
    plan = first[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(block") == 1
    met = {r["id"] for r in first[0].where("text is not null").select("id").collect()}
    fits = {i for i in range(1, 4_000) if zlib.crc32(str(i).encode()) % 5}
    assert {i for i in fits if i < 800} <= met <= fits and len({i for i in met if i >= 800}) < 0.25 * len(fits)


@pytest.mark.parametrize("label", [0, 1])
def test_toxicity_of_one_class(spark, label):
    rows = [(i, f"number {i}", "en", "a") for i in range(1, 60)]
    model = toxicity.train(docs_frame(spark, rows), spark.createDataFrame([(i, label) for i, *_ in rows], "doc_id bigint, toxic int"))
    assert {r["score"] for r in toxicity.scores(docs_frame(spark, rows), model).collect()} == {float(label)}


def test_toxicity_thresholds_are_those_of_the_largest_f1(spark):
    rng = np.random.default_rng(3)
    n = 3_000
    y = (rng.random(n) < 0.2).astype(int)
    score = np.round(1 / (1 + np.exp(-(rng.standard_normal(n) * 2 + 3 * y - 3))), 3).clip(0.001, 0.999)
    lang = rng.choice(["en", "de", "", "few", None], n, p=[0.5, 0.3, 0.1, 0.02, 0.08])
    want = {}
    for each in ("", "en", "de"):
        own = np.array([each in ("", x) for x in lang])
        points = sorted(set(score[own]), reverse=True)
        f1 = [2 * y[own][score[own] >= p].sum() / ((score[own] >= p).sum() + y[own].sum()) for p in points]
        best = int(np.argmax(f1))
        want[each] = (points[best] + (points[best + 1] if best + 1 < len(points) else 0)) / 2
    rows = spark.createDataFrame([(x, float(p), int(v)) for x, p, v in zip(lang, score, y, strict=True)], "lang string, score double, y bigint")
    got = toxicity.calibrate(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert toxicity.calibrate(rows.limit(0)) == {}


# --- HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="cookie-notice">We use cookies on this very long notice that nobody reads</div>
<article><h1>Head &amp;   line</h1><p><b>First &lt;b&gt; block
 of text</b><br>after a break<div class="ad">buy</div><p>Short.</p><aside>aside</aside><section class="comments"><p>a reader says</p></section><form><input>f</form><p>Last &eacute;</article>
<div id="sidebar">side</div><footer>&copy; foot</footer>"""


def test_html(spark):
    want = "Head & line\nFirst <b> block of text\nafter a break\nShort.\nLast é"
    assert html_text.main_text(PAGE) == want
    plain = "<body><div class='menu'>a menu</div><div><p>One.</p><p>Two is longer than one.</p><p>a < b</p></div><div class=footer>f</div></body>"
    assert html_text.main_text(plain) == "One.\nTwo is longer than one.\na < b"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "v", "<p>x"), (1, "u", PAGE), (4, "u", "<article>" + "<p>w" * 30_000)]
    got = sorted(((r["page_id"], r["n_chars"], r["text"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()), key=str)
    assert got == sorted([(1, len(want), want), (1, len(want), want), (2, 0, ""), (3, 0, ""), (None, 1, "x"), (4, 59_999, "\n".join(["w"] * 30_000))], key=str)
    assert html_text.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_html_keeps_all_parts_of_an_article():
    text = html_text.main_text
    for gap in ("<aside>x</aside>", "<form>x</form>", "<nav>x</nav>", "<div class=ad><div>x</div></div>", "</div></div><div><div>"):
        assert text(f"<body><div><div><p>First part.</p>{gap}<p>Second.</p></div></div></body>") == "First part.\nSecond."
    assert text("<div><p>One half <button>x</button> and the other.</p></div>") == "One half\nand the other."
    assert text("<body><article><p>First.</p></article><div>x</div><article><p>Second one.</p></article></body>") == "First.\nSecond one."
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>A long entry of a menu, number {i}</a>" for i in range(9)) + "</ul></div>"
    assert text(f"<body><div>Site</div>{menu}<div><p>First part.</p>{menu}<p>Second.</p></div>{menu}<div>End</div></body>") == "First part.\nSecond."
    long = "Many words. " * 12
    assert text(f"<div>{long}</div>{menu}<div>Short.</div>{menu}<div>{long}x</div>").split("\n")[1:] == ["Short.", long + "x"]
    assert text("<div><p>A.</p></div><div><p><a href=/x>Only a link in a paragraph</a></p></div><div><p>B.</p></div>") == "A.\nOnly a link in a paragraph\nB."


def test_html_class_words_of_articles_stay():
    text = html_text.main_text
    page = "<body><div><div class='article-header'><h1 class='header'>Title</h1></div><p class='reply'>He made a reply.</p><p>And more.</p>{}</div></body>"
    for drop in ("<div class='comment-list'><p>c</p></div>", "<ol id=comments><li>c</ol>", "<div class='site-header'>c</div>", "<section class=sidebar>c</section>", "<div class=ad>c</div>", "<div class='cookie-notice'>c</div>"):
        assert text(page.format(drop)) == "Title\nHe made a reply.\nAnd more."


def test_surge_and_dive():
    sizes = np.array([0, 0, 5, 0, 7, 0, 0, 0, 0, 9, 9])
    assert html_text.stretches(sizes) == [(2, 11)] and html_text.stretches(sizes, 10) == [(2, 5), (9, 11)]
    assert html_text.stretches(np.zeros(0, int)) == []


def test_surge_and_dive_decide():
    """Unmarked lines away from dense text go, whatever their tags; lines of the article's own container stay, however short."""
    body = "".join(f"<p>{'Many words in a paragraph. ' * 8}</p>" for _ in range(3))
    page = f"<body><div>Site name</div><div>Some menu words</div><div>A tag line</div><div><div>By me</div></div><div>{body}<ul><li>a<li>b<li>c<li>d</ul></div><div>End</div><div>Last updated</div><div>Imprint</div></body>"
    own, _ = html_text.lines(page)
    kept = html_text.main_text(page).split("\n")
    assert len(kept) < len([x for x in own if x.text]) and kept[-4:] == ["a", "b", "c", "d"] and "Site name" not in kept and "Imprint" not in kept and len([k for k in kept if k.startswith("Many")]) == 3


def plain_article(page):
    """A plain reading of the given pages' shape: what stands between the article's tags, cut at block tags."""
    import html as h
    import re

    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = (" ".join(h.unescape(re.sub(r"</?[a-z][^<>]*>", "", part)).split()) for part in re.split(r"</?(?:p|h1|br)>", body))
    return "\n".join(x for x in blocks if x)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_html_equals_a_plain_reading_of_all_pages(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    want = {r["page_id"]: plain_article(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in queries.op3_html_text(spark, f"/root/testdata/{sf}").collect()} == want
    unmarked = pages.withColumn("html", F.replace(F.replace("html", F.lit("<article>"), F.lit("<div>")), F.lit("</article>"), F.lit("</div>")))
    assert {r["page_id"]: r["text"] for r in html_text.extract(unmarked).collect()} == want


def test_html_markup_is_found_as_by_one_pattern():
    attrs = r"""(?:[^"'>]|"[^"]*"|'[^']*')*"""
    plain = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({attrs})>", re.S)
    rng = random.Random(4)
    pieces = ["<a ", "<b", "</p", ">", '"', "'", "<!--", "-->", "<![CDATA[", "]]>", "<!x", "<?", "x", " ", "<", "/", "="]
    for _ in range(3000):
        page = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        markup, at, got = html_text.Markup(page), 0, []
        while (m := markup.search(at)) is not None:
            got.append((m.start, m.end, m.closing, m.tag, m.attrs))
            at = m.end
        assert got == [(m.start(), m.end(), bool(m[1]), m[2], m[3] or "") for m in plain.finditer(page)], page


@pytest.mark.parametrize("piece", ['<a href="x ', "<a href='x \"", "<a ", "<", "<div>", "<svg>", "<div></p>", '<a href="x">', "<!x ", "<a aaaaaaaa", "<div class='", "<span hidden=1>"])
def test_html_time_goes_with_length(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 20


def test_html_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "a", 5, "b")], "page_id bigint, url string, html string, text string, n_chars int, body string")
    assert [tuple(r) for r in html_text.extract(df).collect()] == [(1, "u", "x", 1)]


# --- licenses


def test_license_alignment():
    a = "x licensed under the the apache license version 2 0 y".split()
    b = "licensed under the apache license version 2 0".split()
    pairs = licenses.align(a, b)
    assert len(pairs) == 8 and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
    assert licenses.increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def test_license_scan_equals_plain_search(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {(r["doc_id"], r["license"]) for r in queries.op4_license_scan(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    lines = {k: v for k, v in licenses.TEMPLATES.items() if len(v) < 90}
    want = {(int(i), k) for i, t in zip(docs.doc_id, docs.text, strict=True) for k, v in lines.items() if v.lower() in t.lower()}
    assert want <= got and {g for g in got if g[1] in lines} == want


def test_license_edges(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    broken = mit.replace("free of charge", "without any charge").replace("merge, publish", "publish")
    rows = [(1, None, "", ""), (2, "", "", ""), (3, f"intro {broken} end {'z ' * 30_000} {mit}", "", ""), (4, "Licensed under the Apache License, Version 2.0. " * 3, "", ""), (None, "released UNDER the MIT license", "", ""), (5, "the license", "", "")]
    got = sorted(((r["doc_id"], r["license"], round(r["coverage"], 2)) for r in licenses.scan(docs_frame(spark, rows)).collect()), key=str)
    assert [g[:2] for g in got].count((3, "MIT-text")) == 2 and got.count((4, "Apache-2.0", 1.0)) == 3 and (None, "MIT", 1.0) in got
    assert not [g for g in got if g[0] in (1, 2, 5)]
    span = next(r for r in licenses.scan(docs_frame(spark, [(7, "Note: Released under the MIT License!", "", "")])).collect())
    assert "Note: Released under the MIT License!"[span["start"] : span["end"]] == "Released under the MIT License"


def test_license_with_insertions_against_brute_force():
    """Words put in anywhere, up to 200 at a place: no match is lost against alignment over every window of the text."""
    rng, scanner = random.Random(3), licenses.Scanner()
    for name in ("MIT-text", "Apache-2.0-header", "BSD-3-Clause-text"):
        template = licenses.words_of(licenses.TEMPLATES[name])
        for n in (0, 5, 10, 30, 60, 120, 200):
            own = list(template)
            for at in sorted(rng.sample(range(1, len(own)), rng.choice([1, 2])), reverse=True):
                own[at:at] = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            own = [w for w in own if rng.random() > 0.05]
            text = ["before"] * 20 + own + ["after"] * 20
            best = max(len(licenses.align(text[a:b], template)) for a in range(0, len(text), 25) for b in range(a + 25, len(text) + 25, 25)) / len(template)
            found = [c for t, c, _, _ in scanner.scan(" ".join(text)) if t == name]
            assert best >= 0.8 and len(found) == 1 and found[0] >= best - 1e-9, (name, n, best, found)


def test_license_far_apart_and_side_by_side():
    mit, scanner = licenses.TEMPLATES["MIT-text"], licenses.Scanner()
    half = len(mit) // 2
    assert not [m for m in scanner.scan(mit[:half] + " z" * 2000 + mit[half:]) if m[0] == "MIT-text"]
    damaged = " ".join(mit.split()[: int(len(mit.split()) * 0.85)])
    found = [m for m in scanner.scan(f"{damaged} and then {mit} end") if m[0] == "MIT-text"]
    assert [round(m[1], 1) for m in found] in ([0.8, 1.0], [0.9, 1.0]) and found[0][3] <= found[1][2]


# --- WARC


def test_warc_equals_sql(spark, sf_dir):
    against_sql(queries.op9_warc(spark, sf_dir), queries.oracle_sql()["op9_warc"], sf_dir, "pages")


def test_warc_edges(spark):
    big = "<p>é</p>" * 40
    rows = [(5, "http://a/\r\nx", big), (2, None, big), (9, "u", big), (1, "u", None), (3, "u", ""), (4, "u", "small"), (6, "u", "small"), (7, "u", big * 5000), (None, "u", "alone")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.write_and_read(df).collect()}
    for i, _, t in rows:
        body = (t or "").encode()
        revisit = i in (5, 9)
        assert got[i] == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None)
    assert warc.write_and_read(spark.createDataFrame([], df.schema)).collect() == []


def test_warc_records_have_their_own_identifiers(spark, tmp_path):
    big = "payload " * 40
    rows = [(2, "u", big), (2, "u", big), (None, "u", big), (None, "v", "x"), (None, "v", "x"), (7, "u", big)]
    df = spark.createDataFrame([(*r, "clash", b"clash", 1) for r in rows], "page_id bigint, url string, html string, digest string, body binary, row int")
    made = warc.archives(df)
    assert warc.export(made, str(tmp_path / "out")) == len(list((tmp_path / "out").glob("*.warc.gz")))
    found = [r for f in (tmp_path / "out").glob("*.warc.gz") for r in warc.records([f.read_bytes()])]
    names = [r.headers["warc-record-id"] for r in found]
    assert len(set(names)) == len(rows) == len(found)
    assert all(r.headers["warc-refers-to"] in names for r in found if r.kind == "revisit") and sum(r.kind == "revisit" for r in found) == 2
    import gzip

    assert all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1") for f in (tmp_path / "out").glob("*.warc.gz"))
    assert sorted(map(str, warc.read_files(spark, str(tmp_path / "out")).select("page_id", "record_type", "refers_to").collect())) == sorted(map(str, warc.read(made).select("page_id", "record_type", "refers_to").collect()))


def test_warc_with_many_groups(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    against_sql(queries.op9_warc(spark, sf_dir), queries.oracle_sql()["op9_warc"], sf_dir, "pages")


def test_warc_stream_by_small_pieces_and_damage():
    made = [warc.record(i, f"http://x/{i}", bytes([65 + i]) * (1000 * i), hashlib.sha256(bytes([65 + i]) * (1000 * i)).hexdigest(), None, False) for i in range(4)]
    archive = b"".join(made)
    for size in (1, 7, 1000, 1 << 20):
        found = list(warc.records(archive[at : at + size] for at in range(0, len(archive), size)))
        assert [r.payload_bytes for r in found] == [0, 1000, 2000, 3000] and found[2].payload == b"C" * 2000
    with pytest.raises(ValueError):
        list(warc.records([archive[:-20]]))
    wrong = warc.record(1, "u", b"payload", "0" * 64, None, False)
    with pytest.raises(ValueError):
        list(warc.records([wrong]))


def test_warc_files(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(warc.record(8, "http://x/", b"hello", hashlib.sha256(b"hello").hexdigest(), None, False))
    assert [(r["page_id"], r["payload_bytes"]) for r in warc.read_files(spark, str(tmp_path)).collect()] == [(8, 5)]


# --- mixing


@pytest.mark.parametrize("few", [0, 100])
def test_mixing_stops_on_a_tolerance(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "WINDOW_CELLS", few)
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 50), ("b", "x", 80), ("b", "y", 1000), ("c", "x", 5), ("d", "x", 9), ("c", "y", 7)], "source string, lang string, tokens bigint")
    share = lambda m, d: spark.createDataFrame(list(d.items()), f"{m} string, share double")
    goals = {"source": share("source", {"a": 0.4, "b": 0.4, "c": 0.1, "d": 0.1}), "lang": share("lang", {"x": 0.7, "y": 0.3})}
    rough, before = mixing.rake(cells, goals, rounds=1)
    raked, residual = mixing.rake(cells, goals, rounds=2, tolerance=1e-4)
    out = raked.toPandas()
    total = out["weight"].sum()
    assert residual <= 1e-4 < before and abs(total - 1251) < 1e-6
    assert np.allclose(out.groupby("source")["weight"].sum() / total, [0.4, 0.4, 0.1, 0.1], atol=1e-4) and np.allclose(out.groupby("lang")["weight"].sum() / total, [0.7, 0.3], atol=1e-4)
    never = {"source": share("source", {"a": 0.1, "b": 0.1, "d": 0.8}), "lang": share("lang", {"x": 0.1, "y": 0.9})}
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 2)
    assert mixing.rake(cells, never, rounds=2, tolerance=1e-4)[1] > 0.1


def test_mixing_equals_sql(spark, sf_dir):
    against_sql(queries.op6_mixing(spark, sf_dir), queries.oracle_sql()["op6_mixing"], sf_dir, "documents")


@pytest.mark.parametrize("window_cells", [500_000, 0])
def test_mixing_meets_its_margins(spark, monkeypatch, window_cells):
    monkeypatch.setattr(mixing, "WINDOW_CELLS", window_cells)
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice(["en", "en", "de"]), rng.choice("aab")) for i in range(3000)]
    docs = docs_frame(spark, rows)
    targets = {"source": spark.createDataFrame([("a", 1.0), ("b", 1.0), ("zz", 5.0)], "source string, share double"), "lang": spark.createDataFrame([("en", 0.6), ("de", 0.4)], "lang string, share double")}
    out = mixing.sampled(docs, margins={"source": 1, "lang": 1}, targets=targets, rate=0.5).toPandas()
    expected = (out["probability"] * out["n_tokens"]).groupby(out["source"]).sum()
    assert abs(expected["a"] / expected.sum() - 0.5) < 1e-6 and abs(expected.sum() / out["n_tokens"].sum() - 0.5) < 1e-6
    chosen = out[out["selected"]]
    assert abs(chosen["n_tokens"][chosen["source"] == "a"].sum() / chosen["n_tokens"].sum() - 0.5) < 0.05


def test_mixing_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "a b c", "en", "a"), (None, "d e", "de", "b"), (3, "a b c", "en", "a")]
    docs = docs_frame(spark, rows).withColumnRenamed("kept", "topic").withColumnRenamed("body", "selected")
    out = mixing.sampled(docs)
    assert sorted(r["n_tokens"] for r in out.collect()) == [0, 0, 2, 3, 3]
    drawn = mixing.drawn(docs)
    assert drawn.columns == docs.columns and all(r["topic"] == "clash" for r in drawn.collect())
    assert mixing.sampled(docs.limit(0)).collect() == []
