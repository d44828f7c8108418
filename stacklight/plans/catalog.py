"""The registered driver queries over the library's operators, and equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.functions import boxes, digests, paths, vectors
from stacklight.operators import assets, detect, diff, moves, openset, runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Parameters of the queries, used by both sides.
PER_CLASS, CONFIG = 8, openset.OpenSet(min_similarity=0.30, min_margin=0.02, top_k=3)
GRID_S, GRID_M, GATES = (0.20, 0.25, 0.30, 0.35), (0.0, 0.02, 0.05), openset.Gates(0.30, 0.90, 5, 1)
CUTOFF, NOW, STABLE = "1998-01-01 00:00:00", "1996-01-01 00:00:00", 120
ROOT, TARGET = "/library/output", "/library/sorted"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ppm(c: Column) -> Column:
    """Millionths as a whole number."""
    return F.floor(c * 1e6 + 0.5).cast("bigint")


# --- vectors and the open set -------------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label"), vectors.doubles("embedding").alias("vector"))


def known(rows: DataFrame) -> DataFrame:
    """Exemplars of the classes but 8 and 9, which play the unknown ones."""
    return openset.exemplars(rows.where("label < 8"), PER_CLASS)


_UNIT = """v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS raw FROM embeddings),
u AS (SELECT id, label, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS vector FROM v)"""
_CENTERS = """parts AS (SELECT label, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS i FROM u),
mean AS (SELECT label, i, floor(avg(x) * 1e9 + 0.5) / 1e9 AS x, count(*) AS n FROM parts GROUP BY ALL),
rawc AS (SELECT label, list(x ORDER BY i) AS c, max(n) AS n FROM mean GROUP BY label),
center AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS center, n FROM rawc)"""
_EXEMPLARS = f"""near AS (SELECT u.label, u.id, u.vector, floor(list_dot_product(vector, center) * 1e6 + 0.5) AS near FROM u JOIN center USING (label) WHERE u.label < 8),
ex AS (SELECT label, id, vector FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY near DESC, id) AS r FROM near) WHERE r <= {PER_CLASS}),
eparts AS (SELECT label, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS i FROM ex),
emean AS (SELECT label, i, floor(avg(x) * 1e9 + 0.5) / 1e9 AS x FROM eparts GROUP BY ALL),
erawc AS (SELECT label, list(x ORDER BY i) AS c FROM emean GROUP BY label),
ecenter AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS center FROM erawc)"""
_SCORES = f"""d AS (SELECT u.id, u.label AS actual, ex.label, list_dot_product(u.vector, ex.vector) AS s FROM u, ex),
t AS (SELECT id, actual, label, avg(s) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY s DESC) AS r FROM d) WHERE r <= {CONFIG.top_k} GROUP BY ALL),
sc AS (SELECT t.id, actual, t.label, (mean + list_dot_product(u.vector, center)) / 2 AS score FROM t JOIN u USING (id) JOIN ecenter ON ecenter.label = t.label),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM sc),
best AS (SELECT id, actual, max(label) FILTER (WHERE r = 1) AS nearest, max(score) FILTER (WHERE r = 1) AS score,
         max(score) FILTER (WHERE r = 1) - coalesce(max(score) FILTER (WHERE r = 2), -1) AS margin FROM rk GROUP BY ALL)"""
_OPEN = f"WITH {_UNIT}, {_CENTERS}, {_EXEMPLARS}, {_SCORES}"
_ACCEPTED = f"(score >= {CONFIG.min_similarity} AND margin >= {CONFIG.min_margin})"


@query(f"WITH {_UNIT} SELECT id, floor(list_sum(vector) * 1e6 + 0.5)::BIGINT AS sum_ppm, floor(vector[1] * 1e6 + 0.5)::BIGINT AS first_ppm, len(vector) AS n FROM u")
def vector_normalize(spark, sf_dir):
    v = labelled(spark, sf_dir).withColumn("u", vectors.normalize("vector"))
    return v.select("id", ppm(F.aggregate("u", F.lit(0.0), lambda s, x: s + x)).alias("sum_ppm"), ppm(F.col("u")[0]).alias("first_ppm"), F.size("u").cast("bigint").alias("n"))


@query(f"WITH {_UNIT}, {_CENTERS} SELECT label, n, floor(center[1] * 1e6 + 0.5)::BIGINT AS first_ppm, floor(list_sum(center) * 1e6 + 0.5)::BIGINT AS sum_ppm FROM center")
def class_centers(spark, sf_dir):
    c = openset.centers(labelled(spark, sf_dir))
    return c.select("label", "n", ppm(F.col("center")[0]).alias("first_ppm"), ppm(F.aggregate("center", F.lit(0.0), lambda s, x: s + x)).alias("sum_ppm"))


@query(f"""WITH {_UNIT}, {_CENTERS}, c AS (SELECT u.id, center.label, list_dot_product(u.vector, center.center) AS s FROM u, center),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY floor(s * 1e6 + 0.5) DESC, label) AS rank FROM c)
SELECT id, rank::INTEGER AS rank, label, floor(s * 1e6 + 0.5)::BIGINT AS cosine_ppm FROM r WHERE rank <= 3""")  # fmt: skip
def vector_cosine_topk(spark, sf_dir):
    """The three class centres nearest each vector; the centres are one small broadcast row."""
    v = labelled(spark, sf_dir)
    row = openset.centers(v).agg(F.collect_list(F.struct("label", "center")).alias("classes"))
    unit = v.select("id", vectors.normalize("vector").alias("u")).join(F.broadcast(row))
    ranked = F.slice(F.array_sort(F.transform("classes", lambda c: F.struct((-ppm(vectors.dot("u", c["center"]))).alias("minus"), c["label"].alias("label")))), 1, 3)
    return unit.select("id", F.posexplode(ranked).alias("p", "r")).select("id", (F.col("p") + 1).alias("rank"), "r.label", (-F.col("r.minus")).alias("cosine_ppm"))


def _scored(spark, sf_dir) -> DataFrame:
    v = labelled(spark, sf_dir)
    return openset.scores(v, known(v), CONFIG.top_k)


@query(f"""{_OPEN} SELECT id, CASE WHEN {_ACCEPTED} THEN nearest END AS predicted, CASE WHEN {_ACCEPTED} THEN 'accepted' ELSE 'unknown' END AS state,
floor(score * 1e6 + 0.5)::BIGINT AS score_ppm, floor(margin * 1e6 + 0.5)::BIGINT AS margin_ppm, nearest FROM best""")
def openset_decision(spark, sf_dir):
    d = openset.decisions(_scored(spark, sf_dir), CONFIG)
    return d.select("id", "predicted", "state", ppm(F.col("score")).alias("score_ppm"), ppm(F.col("margin")).alias("margin_ppm"), "nearest")


@query(SQL["openset_decision"])
def openset_blocks(spark, sf_dir):
    """openset_decision with references in blocks of 1,000 values, each broadcast on its own."""
    v = labelled(spark, sf_dir)
    d = openset.decisions(openset.scores(v, known(v), CONFIG.top_k, key="id", most=1000), CONFIG)
    return d.select("id", "predicted", "state", ppm(F.col("score")).alias("score_ppm"), ppm(F.col("margin")).alias("margin_ppm"), "nearest")


@query(f"{_OPEN} SELECT id, r::INTEGER AS rank, label, floor(score * 1e6 + 0.5)::BIGINT AS similarity_ppm FROM rk WHERE r <= {CONFIG.top_k}")
def openset_candidates(spark, sf_dir):
    d = openset.decisions(_scored(spark, sf_dir), CONFIG)
    return d.select("id", F.posexplode("candidates").alias("p", "c")).select("id", (F.col("p") + 1).alias("rank"), "c.label", ppm(F.col("c.similarity")).alias("similarity_ppm"))


@query(f"""{_OPEN} SELECT id, CASE WHEN id % 7 = 0 THEN 'accepted' WHEN {_ACCEPTED} THEN 'accepted' ELSE 'unknown' END AS state,
CASE WHEN id % 7 = 0 THEN 'rule' WHEN {_ACCEPTED} THEN 'reference' ELSE 'review' END AS stage,
CASE WHEN id % 7 <> 0 AND {_ACCEPTED} THEN nearest::VARCHAR END AS label,
CASE WHEN id % 7 = 0 THEN 'listed' WHEN {_ACCEPTED} THEN 'reference_match' ELSE 'no_acceptance_evidence' END AS reason FROM best""")
def route_decision(spark, sf_dir):
    d = openset.decisions(_scored(spark, sf_dir), CONFIG)
    return d.select("id", openset.route(F.col("id") % 7 == 0, F.lit("listed"), F.col("state"), F.col("predicted")).alias("r")).select("id", "r.*")


def _pairs_sql(s, m) -> str:
    return "grid(min_similarity, min_margin) AS (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a in s for b in m) + ")"


_OUTCOMES = """o AS (SELECT min_similarity, min_margin, CASE WHEN actual < 8 THEN actual::VARCHAR ELSE 'unknown' END AS actual,
CASE WHEN score >= min_similarity AND margin >= min_margin THEN nearest::VARCHAR ELSE 'unknown' END AS predicted, count(*) AS n FROM best, grid GROUP BY ALL)"""
_METRICS = """m AS (SELECT min_similarity, min_margin, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE predicted <> 'unknown'), 0)::BIGINT AS accepted,
coalesce(sum(n) FILTER (WHERE predicted <> 'unknown' AND predicted = actual), 0)::BIGINT AS correct, coalesce(sum(n) FILTER (WHERE actual = 'unknown'), 0)::BIGINT AS unknown_total,
coalesce(sum(n) FILTER (WHERE actual = 'unknown' AND predicted <> 'unknown'), 0)::BIGINT AS unknown_false_accept FROM o GROUP BY ALL),
r AS (SELECT *, accepted / total AS coverage, correct / nullif(accepted, 0) AS accepted_accuracy, unknown_false_accept / nullif(unknown_total, 0) AS unknown_false_accept_rate FROM m)"""


@query(f"{_OPEN}, {_pairs_sql(GRID_S, GRID_M)}, {_OUTCOMES}, {_METRICS} SELECT * FROM r")
def calibration_grid(spark, sf_dir):
    v = labelled(spark, sf_dir)
    return openset.calibrate(v, known(v), GRID_S, GRID_M, CONFIG.top_k)


@query(f"{_OPEN}, {_pairs_sql(GRID_S[2:3], GRID_M[1:2])}, {_OUTCOMES}, {_METRICS} SELECT * FROM r")
def calibration_metrics(spark, sf_dir):
    v = labelled(spark, sf_dir)
    return openset.calibrate(v, known(v), GRID_S[2:3], GRID_M[1:2], CONFIG.top_k)


@query(f"""{_OPEN}, {_pairs_sql(GRID_S, GRID_M)}, {_OUTCOMES}, {_METRICS} SELECT min_similarity, min_margin, accepted, correct FROM r
WHERE accepted >= {GATES.accepted} AND unknown_total >= {GATES.unknown} AND accepted_accuracy >= {GATES.accuracy} AND unknown_false_accept_rate <= {GATES.false_accept}
ORDER BY coverage DESC, accepted_accuracy DESC, unknown_false_accept_rate, min_similarity DESC, min_margin DESC LIMIT 1""")
def calibration_recommend(spark, sf_dir):
    return openset.recommend(calibration_grid(spark, sf_dir), GATES).select("min_similarity", "min_margin", "accepted", "correct")


@query(f"{_OPEN}, {_pairs_sql(GRID_S, GRID_M)}, {_OUTCOMES} SELECT * FROM o")
def confusion_matrix(spark, sf_dir):
    return openset.outcomes(_scored(spark, sf_dir), openset.grid(spark, GRID_S, GRID_M))


@query()
def float16_roundtrip(spark, sf_dir):
    v = labelled(spark, sf_dir).withColumn("half", vectors.half_bytes("vector"))
    v = v.withColumn("back", vectors.from_half_bytes("half"))
    return v.select("id", F.length("half").alias("n_bytes"), ppm(F.lit(1.0) - vectors.dot("back", vectors.normalize("vector"))).alias("lost_ppm"))


@query("""WITH p AS (SELECT vec_id, label, list_transform(embedding, lambda x: least(255, greatest(0, floor((x::DOUBLE + 1) * 127.5)))::BIGINT) AS a FROM embeddings),
b AS (SELECT vec_id, unnest(a) AS v FROM p), h AS (SELECT vec_id, v, count(*) AS n FROM b GROUP BY ALL),
e AS (SELECT vec_id, floor(-sum(n / 64 * log2(n / 64)) * 1e6 + 0.5)::BIGINT AS entropy_ppm, (sum(n) FILTER (WHERE v < 3))::BIGINT AS dark, (sum(n) FILTER (WHERE v > 252))::BIGINT AS bright, sum(n * v)::BIGINT AS total FROM h GROUP BY vec_id),
g AS (SELECT vec_id, a, unnest(range(1, 7)) AS y FROM p), g2 AS (SELECT vec_id, a, y, unnest(range(1, 7)) AS x FROM g),
k AS (SELECT vec_id, least(255, greatest(0, 9 * a[y*8+x+1] - (a[(y-1)*8+x] + a[(y-1)*8+x+1] + a[(y-1)*8+x+2] + a[y*8+x] + a[y*8+x+1] + a[y*8+x+2] + a[(y+1)*8+x] + a[(y+1)*8+x+1] + a[(y+1)*8+x+2]))) AS e FROM g2)
SELECT e.vec_id, entropy_ppm, coalesce(dark, 0) AS dark, coalesce(bright, 0) AS bright, total, edge_sum, edge_squares FROM e
JOIN (SELECT vec_id, sum(e)::BIGINT AS edge_sum, sum(e * e)::BIGINT AS edge_squares FROM k GROUP BY vec_id) USING (vec_id)""")  # fmt: skip
def technical_evidence(spark, sf_dir):
    """Luminance signals of 8x8 rasters made from the vectors, as expressions: one projection, no shuffle."""
    pixel = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5))).cast("bigint"))
    p = read(spark, sf_dir, "embeddings").select("vec_id", pixel.alias("a"))
    total = lambda c, f: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + f(x))
    share = lambda v: F.size(F.filter("a", lambda x: x == v)) / 64.0
    entropy = -F.aggregate(F.array_sort(F.array_distinct("a")), F.lit(0.0), lambda s, v: s + share(v) * F.log2(share(v)))
    at = lambda y, x: F.get("a", y * 8 + x)

    def edge(i):
        y, x = F.floor(i / 6).cast("int") + 1, (i % 6).cast("int") + 1
        around = sum((at(y + j, x + k) for j in (-1, 0, 1) for k in (-1, 0, 1)), F.lit(0))
        return F.least(F.lit(255), F.greatest(F.lit(0), 9 * at(y, x) - around)).cast("bigint")

    e = p.withColumn("edges", F.transform(F.sequence(F.lit(0), F.lit(35)), edge))
    return e.select(
        "vec_id", ppm(entropy).alias("entropy_ppm"), F.size(F.filter("a", lambda x: x < 3)).cast("bigint").alias("dark"), F.size(F.filter("a", lambda x: x > 252)).cast("bigint").alias("bright"),
        total("a", lambda x: x).alias("total"), total("edges", lambda x: x).alias("edge_sum"), total("edges", lambda x: x * x).alias("edge_squares"),
    )


# --- assets and baselines -----------------------------------------------------------------------


def found(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return assets.occurrences(docs.withColumn("path", F.concat(F.lit("/library/output/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))), "path", "text")


_FOUND = "f AS (SELECT doc_id, lang, n_chars, '/library/output/' || source || '/' || doc_id || '.txt' AS source_path, sha256(text) AS asset_id FROM documents)"


@query(f"WITH {_FOUND} SELECT asset_id, min(source_path) AS source_path, count(*) AS n_occurrences FROM f GROUP BY asset_id")
def dedup_assets(spark, sf_dir):
    return assets.assets(found(spark, sf_dir))


@query(f"WITH {_FOUND} SELECT asset_id, source_path, count(*) OVER (PARTITION BY asset_id) AS n_occurrences, source_path = min(source_path) OVER (PARTITION BY asset_id) AS canonical FROM f")
def asset_occurrences(spark, sf_dir):
    occ = assets.with_first(found(spark, sf_dir).select("asset_id", "source_path"))
    return occ.select("asset_id", "source_path", "n_occurrences", (F.col("source_path") == F.col("first_path")).alias("canonical"))


@query(f"""WITH {_FOUND}, k AS (SELECT DISTINCT sha256(text) AS asset_id FROM documents JOIN labels USING (doc_id)),
g AS (SELECT asset_id, count(*) AS n FROM f WHERE n_chars >= 40 GROUP BY asset_id)
SELECT (SELECT count(*) FROM f) AS discovered, count(*) FILTER (WHERE k.asset_id IS NULL) AS enqueued, (sum(n) - count(*) FILTER (WHERE k.asset_id IS NULL))::BIGINT AS duplicates,
(SELECT count(*) FROM f WHERE n_chars < 40) AS errors FROM g LEFT JOIN k ON k.asset_id = g.asset_id""")
def scan_counts(spark, sf_dir):
    """Labelled documents play the known assets, very short ones the unreadable files."""
    occ = found(spark, sf_dir)
    seen = occ.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return assets.scan_counts(occ, seen, F.col("n_chars") < 40)


@query(f"WITH {_FOUND} SELECT count(DISTINCT asset_id) AS assets, count(*) AS occurrences FROM f")
def inventory_counts(spark, sf_dir):
    return assets.inventory(found(spark, sf_dir))


_URL = "regexp_replace(url, '^[a-z]+://', '')"


@query(f"""WITH p AS (SELECT page_id, {_URL} AS path FROM pages), n AS (SELECT page_id, path, regexp_extract(regexp_replace(path, '[\\\\/]+', '/', 'g'), '[^/]*$') AS name FROM p)
SELECT page_id, name, lower(regexp_extract(name, '.(\\.[^.]+)$', 1)) AS suffix FROM n""")
def portable_name(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return p.select("page_id", paths.portable_name("path").alias("name"), paths.suffix("path").alias("suffix"))




@query("""WITH p AS (SELECT doc_id, '/library/' || CASE doc_id % 9 WHEN 0 THEN 'Tests' WHEN 1 THEN '.seektrash' WHEN 2 THEN '_organized_v2' ELSE source END || CASE WHEN doc_id % 11 = 0 THEN '/~$' ELSE '/' END || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.PART' ELSE '.png' END AS path FROM documents)
SELECT doc_id, path, doc_id % 9 < 3 OR doc_id % 11 = 0 OR doc_id % 5 = 0 AS excluded FROM p""")
def excluded_paths(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    n = F.col("doc_id") % 9
    folder = F.when(n == 0, "Tests").when(n == 1, ".seektrash").when(n == 2, "_organized_v2").otherwise(F.col("source"))
    path = F.concat(F.lit("/library/"), folder, F.when(F.col("doc_id") % 11 == 0, "/~$").otherwise("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, ".PART").otherwise(".png"))
    return d.select("doc_id", path.alias("path")).select("doc_id", "path", paths.is_excluded("path").alias("excluded"))


@query(f"WITH {_FOUND} SELECT source_path, sha256(source_path) AS occurrence_id FROM f")
def occurrence_id(spark, sf_dir):
    return found(spark, sf_dir).select("source_path", paths.occurrence_id("source_path").alias("occurrence_id"))


@query("""WITH r AS (SELECT doc_id, '  ' || source || '/' || doc_id || '.PNG ' AS source, CASE doc_id % 3 WHEN 0 THEN 'Published' WHEN 1 THEN ' ' ELSE lang END AS bucket,
CASE WHEN doc_id % 2 = 0 THEN upper(sha256(text)) ELSE 'n/a' END AS sha, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE n_chars::VARCHAR END AS size FROM documents)
SELECT trim(source) AS source_path, coalesce(nullif(trim(bucket), ''), '待复核') AS old_bucket, CASE WHEN doc_id % 2 = 0 THEN lower(sha) END AS baseline_sha256, try_cast(size AS BIGINT) AS source_size,
doc_id % 3 = 0 AS audit_locked, doc_id % 2 <> 0 AS baseline_identity_unverifiable FROM r""")
def baseline_normalize(spark, sf_dir):
    from stacklight.sources.baseline import normalised

    d = read(spark, sf_dir, "documents")
    raw = d.select(
        F.lit("Image").alias("Kind"), F.concat(F.lit("  "), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".PNG ")).alias("Source_Path"),
        F.when(F.col("doc_id") % 3 == 0, "Published").when(F.col("doc_id") % 3 == 1, " ").otherwise(F.col("lang")).alias("old_bucket"),
        F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha2("text", 256))).otherwise("n/a").alias("HASH"), F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.col("n_chars").cast("string")).alias("bytes"),
    )
    return normalised(raw).select("source_path", "old_bucket", "baseline_sha256", "source_size", "audit_locked", "baseline_identity_unverifiable")


# --- runs ---------------------------------------------------------------------------------------

_MTIME = "o_orderdate + to_seconds(o_custkey % 86400)"


@query(f"""WITH f AS (SELECT o_orderkey, {_MTIME} AS modified, o_orderstatus, sha256(o_orderkey::VARCHAR) AS sha, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'other' ELSE sha256(o_orderkey::VARCHAR) END AS base FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'missing' WHEN o_orderstatus = 'P' THEN 'missing' WHEN modified > TIMESTAMP '{CUTOFF}' THEN 'added_deferred' WHEN modified > TIMESTAMP '{NOW}' - INTERVAL {STABLE} SECOND THEN 'source_changed'
WHEN base <> sha THEN 'source_changed' WHEN base IS NULL THEN 'baseline_identity_unverifiable' ELSE 'processed' END AS status,
CASE WHEN o_orderkey % 13 = 0 THEN 'missing_or_unreadable' WHEN o_orderstatus = 'P' THEN 'not_a_regular_file' WHEN modified > TIMESTAMP '{CUTOFF}' THEN 'modified_after_cutoff' WHEN modified > TIMESTAMP '{NOW}' - INTERVAL {STABLE} SECOND THEN 'not_stable_for_required_interval'
WHEN base <> sha THEN 'baseline_sha256_mismatch' END AS reason FROM f""")
def freeze_states(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumns({"source_path": F.col("o_orderkey").cast("string"), "sha": F.sha2(F.col("o_orderkey").cast("string"), 256)})
    base = o.select("source_path", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, None).when(F.col("o_orderkey") % 7 == 0, "other").otherwise(F.col("sha")).alias("baseline_sha256"))
    modified = F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_custkey") % 86400).cast("decimal(18,6)"))
    files = o.where("o_orderkey % 13 <> 0").select("source_path", modified.alias("modified"), F.col("sha").alias("sha256"), (F.col("o_orderstatus") != "P").alias("regular"), F.lit(True).alias("steady"))
    ts = lambda t: F.lit(t).cast("timestamp_ntz")
    return runs.freeze(base, files, ts(CUTOFF), ts(NOW), STABLE).select("o_orderkey", "status", "reason")


def items(spark, sf_dir) -> DataFrame:
    """Work items from events: each user is an asset, whose last event is its state."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("asset_id"), F.col("event_id").alias("event_seq"), "ts", "event_type", "value")
    last = runs.current(e)
    state = F.element_at(F.array(*(F.lit(s) for s in runs.ITEM_STATES)), (F.pmod(F.col("event_seq"), F.lit(6)) + 1).cast("int"))
    leased = state == "LEASED"
    return last.select("asset_id", state.alias("state"), (F.pmod(F.col("event_seq"), F.lit(4))).cast("int").alias("attempts"), F.when(leased, F.col("ts") + F.expr("INTERVAL 10 SECONDS")).alias("lease_expires_at"), F.when(leased, F.col("event_type")).alias("lease_token"))


_STATE_LIST = "['" + "','".join(runs.ITEM_STATES) + "']"
_ITEMS = f"""last AS (SELECT user_id AS asset_id, max(event_id) AS event_seq, arg_max(ts, event_id) AS ts, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id),
i AS (SELECT asset_id, {_STATE_LIST}[event_seq % 6 + 1] AS state, (event_seq % 4)::INTEGER AS attempts, CASE WHEN event_seq % 6 = 1 THEN ts + INTERVAL 10 SECOND END AS lease_expires_at, CASE WHEN event_seq % 6 = 1 THEN event_type END AS lease_token FROM last)"""
_WHEN = "2024-01-20 00:00:00"


@query(f"WITH {_ITEMS} SELECT asset_id, CASE WHEN state = 'LEASED' AND lease_expires_at <= TIMESTAMP '{_WHEN}' THEN 'PENDING' ELSE state END AS state, attempts FROM i")
def lease_recovery(spark, sf_dir):
    return runs.recover_leases(items(spark, sf_dir), F.lit(_WHEN).cast("timestamp_ntz")).select("asset_id", "state", "attempts")


@query(f"""WITH {_ITEMS} SELECT asset_id, 'LEASED' AS state, attempts + 1 AS attempts, 'w1' AS lease_owner FROM i
WHERE state IN ('PENDING', 'RETRYABLE_FAILED') OR (state = 'LEASED' AND lease_expires_at <= TIMESTAMP '{_WHEN}') ORDER BY asset_id LIMIT 100""")
def claim_batch(spark, sf_dir):
    """A top-k: the first 100 claimable items of all."""
    c = runs.claim(items(spark, sf_dir), 100, 300, F.lit(_WHEN).cast("timestamp_ntz"), "w1", "t1")
    return c.select("asset_id", "state", "attempts", "lease_owner")


@query(f"""WITH {_ITEMS}, o AS (SELECT user_id AS asset_id, min(event_type) AS token FROM events GROUP BY user_id)
SELECT o.asset_id, coalesce(i.state = 'LEASED' AND i.lease_token = o.token, false) AS accepted FROM o LEFT JOIN i USING (asset_id)""")
def lease_transition(spark, sf_dir):
    said = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("asset_id")).agg(F.min("event_type").alias("lease_token")).withColumn("state", F.lit("COMPLETE"))
    return runs.transition(items(spark, sf_dir), said).select("asset_id", "accepted")


@query("""WITH s AS (SELECT event_type AS run_id, ['PENDING','LEASED','RETRYABLE_FAILED','COMPLETE','SOURCE_CHANGED','FAILED'][event_id % 6 + 1] AS state, count(*) AS n FROM events GROUP BY ALL)
SELECT run_id, state, n, (sum(n) OVER (PARTITION BY run_id))::BIGINT AS total FROM s""")
def run_status(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    own = e.select(F.col("event_type").alias("run_id"), F.element_at(F.array(*(F.lit(s) for s in runs.ITEM_STATES)), (F.pmod("event_id", F.lit(6)) + 1).cast("int")).alias("state"))
    return runs.run_status(own).select("run_id", F.col("n").alias("total"), F.explode("states").alias("state", "n"))


_KINDS = ("COMPLETE", "SOURCE_CHANGED", "IO_RETRYABLE", "OOM", "CUDA_PROVIDER_LOST", "ADAPTER_INIT_FAILED", "DECODE_OR_INVALID")


@query(f"""WITH k AS (SELECT event_id, {list(_KINDS)!r}[event_id % 7 + 1] AS kind, 1 + user_id % 3 AS attempts, user_id % 3 AS ooms FROM events)
SELECT event_id, CASE WHEN kind IN ('COMPLETE', 'SOURCE_CHANGED') THEN kind WHEN kind = 'IO_RETRYABLE' AND attempts < 3 THEN 'RETRYABLE_FAILED' WHEN kind IN ('OOM', 'CUDA_PROVIDER_LOST', 'ADAPTER_INIT_FAILED') THEN 'RETRYABLE_FAILED' ELSE 'FAILED' END AS state,
CASE WHEN kind = 'CUDA_PROVIDER_LOST' THEN 'cuda_provider_unavailable' WHEN kind = 'ADAPTER_INIT_FAILED' THEN 'adapter_initialization_failed' WHEN kind = 'OOM' AND ooms >= 2 THEN 'gpu_oom_after_single_worker_retry' END AS pause FROM k""")
def retry_policy(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (F.pmod("event_id", F.lit(7)) + 1).cast("int"))
    return e.select("event_id", runs.retry_state(kind, 1 + F.col("user_id") % 3).alias("state"), runs.pause_reason(kind, F.col("user_id") % 3).alias("pause"))


@query(f"""WITH {_FOUND}, c AS (SELECT asset_id, min(source_path) AS path FROM f GROUP BY asset_id), n AS (SELECT c.asset_id, min(f.source_path) FILTER (WHERE f.doc_id % 4 <> 0 AND f.source_path <> c.path) AS next_path FROM c JOIN f USING (asset_id) GROUP BY ALL)
SELECT asset_id, next_path, CASE WHEN next_path IS NULL THEN 'SOURCE_CHANGED' ELSE 'RETRYABLE_FAILED' END AS state FROM n""")
def switch_duplicate(spark, sf_dir):
    """Every asset's first path has changed; three of four other paths are still frozen."""
    occ = found(spark, sf_dir).withColumn("occurrence_state", F.when(F.col("doc_id") % 4 != 0, "FROZEN").otherwise("MISSING"))
    return runs.switch_duplicates(assets.assets(occ).select("asset_id", "source_path"), occ).select("asset_id", "next_path", "state")


@query("SELECT '/library/output/' || source || '/' || doc_id || '.txt' AS source_path, 'added_deferred' AS status, 'not_in_baseline' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def added_deferred(spark, sf_dir):
    occ = found(spark, sf_dir)
    base = occ.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("source_path")
    return runs.added_deferred(occ, base, paths.is_excluded("source_path"))


@query(f"WITH {_FOUND} SELECT asset_id, min(source_path) AS source_path, count(*) AS n_occurrences FROM f GROUP BY asset_id HAVING asset_id NOT IN (SELECT asset_id FROM f JOIN labels USING (doc_id))")
def resume_pending(spark, sf_dir):
    """Assets of documents of which no copy is labelled, as after an interrupted run."""
    occ = found(spark, sf_dir)
    done = occ.join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("asset_id").distinct()
    return assets.enqueue(done, occ)


@query(f"""WITH {_FOUND}, i AS (SELECT sha256(text) AS asset_id, CASE WHEN toxic = 1 THEN 'BAD' ELSE 'COMPLETE' END AS state FROM documents JOIN labels USING (doc_id))
SELECT 'duplicate_asset' AS kind, count(*) AS n FROM (SELECT asset_id FROM i GROUP BY asset_id HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_path', count(*) FROM (SELECT source_path FROM f GROUP BY source_path HAVING count(*) > 1)
UNION ALL SELECT 'orphan_occurrence', count(*) FROM f WHERE asset_id NOT IN (SELECT asset_id FROM i) UNION ALL SELECT 'unknown_state', count(*) FROM i WHERE state = 'BAD'""")
def integrity_check(spark, sf_dir):
    occ = found(spark, sf_dir)
    own = occ.join(read(spark, sf_dir, "labels"), "doc_id").select("asset_id", F.when(F.col("toxic") == 1, "BAD").otherwise("COMPLETE").alias("state"))
    return runs.violations(own, occ)


@query("SELECT count(*) AS \"rows\", sum(length(props))::BIGINT AS payload_chars FROM events WHERE length(props) > 0")
def prune_stats(spark, sf_dir):
    return runs.prune_statistics(read(spark, sf_dir, "events"), "props")


# --- differences and review ---------------------------------------------------------------------


def diffs(spark, sf_dir) -> DataFrame:
    """Documents as frozen paths, their labels as decisions."""
    occ = found(spark, sf_dir)
    n = F.col("doc_id") % 10
    frozen = occ.select("source_path", "asset_id", F.when(n == 0, "missing").when(n == 1, "source_changed").when(n == 2, "baseline_identity_unverifiable").otherwise("processed").alias("status"), F.col("lang").alias("old_bucket"), (F.col("source") == "src3").alias("audit_locked"), F.lit(None).cast("string").alias("reason"))
    own = occ.join(read(spark, sf_dir, "labels"), "doc_id").groupBy("asset_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    low = F.when(F.col("q") == 0, F.lit("quality_low"))
    toxic = F.when(F.col("t") == 1, F.lit("safety_toxic"))
    said = own.select("asset_id", F.when(F.col("t") == 1, "hold").otherwise("keep").alias("proposed_bucket"), F.when(F.col("q") == 1, F.lit("good")).alias("identity"), (F.col("q") / 2.0).alias("confidence"), F.array_compact(F.array(toxic, low)).alias("reasons"))
    return diff.diff_rows(frozen, said)


_DIFF = f"""{_FOUND}, l AS (SELECT f.asset_id, max(quality) AS q, max(toxic) AS t FROM f JOIN labels USING (doc_id) GROUP BY ALL),
z AS (SELECT f.source_path, f.asset_id, d.lang AS old_bucket, d.source = 'src3' AS audit_locked, q, t, CASE d.doc_id % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'source_changed' WHEN 2 THEN 'baseline_identity_unverifiable' ELSE 'processed' END AS status
 FROM f JOIN documents d USING (doc_id) LEFT JOIN l ON l.asset_id = f.asset_id),
y AS (SELECT *, CASE WHEN t = 1 THEN 'hold' WHEN t = 0 THEN 'keep' END AS proposed_bucket, CASE WHEN q = 1 THEN 'good' END AS identity, status IN ('processed', 'baseline_identity_unverifiable') AS stable FROM z),
x AS (SELECT *, CASE WHEN audit_locked THEN old_bucket ELSE proposed_bucket END AS effective_bucket, CASE WHEN stable THEN 'processed' ELSE status END AS processing_state,
 list_sort(list_filter([CASE WHEN t = 1 THEN 'safety_toxic' END, CASE WHEN q = 0 THEN 'quality_low' END, CASE WHEN NOT stable THEN status END, CASE WHEN stable AND t IS NULL THEN 'decision_missing' END], lambda r: r IS NOT NULL)) AS reasons FROM y)"""


@query(f"""WITH {_DIFF} SELECT sha256(source_path) AS occurrence_id, status, processing_state, old_bucket, proposed_bucket, effective_bucket, identity, audit_locked,
CASE WHEN NOT audit_locked THEN 'candidate_only' END AS action, coalesce(array_to_string(reasons, ','), '') AS reasons FROM x""")
def diff_rows(spark, sf_dir):
    return diffs(spark, sf_dir).select("occurrence_id", "status", "processing_state", "old_bucket", "proposed_bucket", "effective_bucket", "identity", "audit_locked", "action", F.array_join("review_reasons", ",").alias("reasons"))


@query(f"WITH {_DIFF} SELECT count(*) AS occurrences, count(*) FILTER (WHERE audit_locked) AS audit_locked, count(*) FILTER (WHERE len(reasons) > 0) AS review_required FROM x")
def diff_summary(spark, sf_dir):
    return diff.summary(diffs(spark, sf_dir))


@query(f"WITH {_DIFF} SELECT 'status' AS kind, status AS name, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'bucket', effective_bucket, count(*) FROM x WHERE effective_bucket IS NOT NULL GROUP BY ALL")
def diff_counts(spark, sf_dir):
    d = diffs(spark, sf_dir)
    return diff.counts_by(d, "status").select(F.lit("status").alias("kind"), F.col("status").alias("name"), "n").union(diff.counts_by(d, "effective_bucket").select(F.lit("bucket"), "effective_bucket", "n"))


def _strata(d: DataFrame) -> DataFrame:
    toxic = F.when(F.array_contains("review_reasons", "safety_toxic"), 0.5).otherwise(0.0)
    low = F.array_contains("review_reasons", "quality_low")
    none = F.lit(None).cast("double")
    lost = (F.col("processing_state") == "processed") & F.col("identity").isNull()
    return d.withColumn("review_strata", diff.strata(F.col("audit_locked"), toxic, none, none, none, low, lost))


_STRATA = """s AS (SELECT *, list_filter([CASE WHEN audit_locked THEN 'published_lock' END, CASE WHEN t = 1 THEN 'safety_signal' END, CASE WHEN q = 0 THEN 'quality_boundary' END,
CASE WHEN processing_state = 'processed' AND identity IS NULL THEN 'unknown_identity' END], lambda r: r IS NOT NULL) AS found FROM x)"""


@query(f"WITH {_DIFF}, {_STRATA} SELECT sha256(source_path) AS occurrence_id, CASE WHEN len(found) > 0 THEN array_to_string(found, ',') ELSE 'source_outcome' END AS strata FROM s")
def review_strata(spark, sf_dir):
    return _strata(diffs(spark, sf_dir)).select("occurrence_id", F.array_join("review_strata", ",").alias("strata"))


@query(f"""WITH {_DIFF}, {_STRATA}, o AS (SELECT sha256(source_path) AS occurrence_id, CASE WHEN len(found) > 0 THEN found[1] ELSE 'source_outcome' END AS stratum FROM s),
k AS (SELECT *, sha256('r1:' || occurrence_id) AS review_id, row_number() OVER (PARTITION BY stratum ORDER BY sha256('r1:' || occurrence_id), occurrence_id) AS rn FROM o)
SELECT occurrence_id, stratum, review_id FROM k ORDER BY rn, stratum LIMIT 120""")
def review_queue(spark, sf_dir):
    """The balanced sample of 120 rows over each row's first stratum."""
    rows = _strata(diffs(spark, sf_dir)).withColumn("review_strata", F.slice("review_strata", 1, 1))
    return diff.review_queue(rows, 120, "r1")


# --- detections ---------------------------------------------------------------------------------


def lines(spark, sf_dir) -> DataFrame:
    """Line items as detector boxes on 320-pixel images."""
    x = read(spark, sf_dir, "lineitem")
    box = boxes.corner_box((F.col("l_partkey") * 37 % 80 + 10).cast("double"), (F.col("l_suppkey") * 53 % 80 + 10).cast("double"), 30 + F.col("l_quantity"), 40 + F.col("l_quantity"), 320)
    return x.select(
        F.floor(F.col("l_orderkey") / 8).alias("image"), F.col("l_returnflag").alias("label"), ((F.floor("l_extendedprice") % 90).cast("double") / 100).alias("score"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"), box.alias("box"),
    )


_BOXES = """b0 AS (SELECT l_orderkey // 8 AS image, l_returnflag AS label, (floor(l_extendedprice)::BIGINT % 90)::DOUBLE / 100 AS score, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq,
greatest(0.0, (l_partkey * 37 % 80 + 10)::DOUBLE - (30 + l_quantity) / 2) AS x, greatest(0.0, (l_suppkey * 53 % 80 + 10)::DOUBLE - (40 + l_quantity) / 2) AS y, 30 + l_quantity AS w0, 40 + l_quantity AS h0 FROM lineitem),
b1 AS (SELECT image, label, score, seq, x, y, greatest(0.0, least(w0, 320 - x)) AS w, greatest(0.0, least(h0, 320 - y)) AS h FROM b0 WHERE score >= 0.15),
b AS (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY score DESC, seq) AS rn FROM b1 WHERE w * h >= 4),
step AS (SELECT image, label, 0::BIGINT AS rn, []::STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS boxes, 0::BIGINT AS seq, 0::DOUBLE AS score, false AS took FROM (SELECT DISTINCT image, label FROM b)
 UNION ALL SELECT s.image, s.label, b.rn, CASE WHEN ok THEN list_append(s.boxes, {'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}) ELSE s.boxes END, b.seq, b.score, ok FROM step s JOIN b ON b.image = s.image AND b.label = s.label AND b.rn = s.rn + 1,
 LATERAL (SELECT len(list_filter(s.boxes, lambda k: greatest(0.0, least(b.x + b.w, k.x + k.w) - greatest(b.x, k.x)) * greatest(0.0, least(b.y + b.h, k.y + k.h) - greatest(b.y, k.y))
  / (b.w * b.h + k.w * k.h - greatest(0.0, least(b.x + b.w, k.x + k.w) - greatest(b.x, k.x)) * greatest(0.0, least(b.y + b.h, k.y + k.h) - greatest(b.y, k.y))) > 0.45)) = 0 AS ok)),
kept AS (SELECT image, label, seq, score FROM step WHERE took)"""


@query(f"WITH RECURSIVE {_BOXES} SELECT image, label, seq, score FROM kept")
def nms(spark, sf_dir):
    return detect.suppressed(lines(spark, sf_dir), "image", "label", "score", "seq", F.col("box")).select("image", "label", "seq", "score")


@query(f"WITH RECURSIVE {_BOXES} SELECT image, count(*) AS n, coalesce(max(score) FILTER (WHERE label = 'R'), 0.0) AS explicit_score, coalesce(max(score) FILTER (WHERE label = 'A'), 0.0) AS covered_score FROM kept GROUP BY image")
def detection_summary(spark, sf_dir):
    kept = detect.suppressed(lines(spark, sf_dir), "image", "label", "score", "seq", F.col("box"))
    return detect.summaries(kept, ("R",), ("A",)).select("image", "n", "explicit_score", "covered_score")


@query("""WITH t AS (SELECT l_orderkey, 'tag' || l_linenumber AS name, (l_partkey % 100) / 100.0::DOUBLE AS score FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, name) AS n FROM t WHERE name NOT IN ('tag1', 'tag2'))
SELECT o_orderkey AS image, coalesce(string_agg(name, ',' ORDER BY n) FILTER (WHERE n <= 3 AND score >= 0.25), '') AS tags, coalesce(max(rating), 0.0)::DOUBLE AS tag1
FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) LEFT JOIN r ON l_orderkey = o_orderkey LEFT JOIN (SELECT l_orderkey AS k, max(score) AS rating FROM t WHERE name = 'tag1' GROUP BY ALL) q ON q.k = o_orderkey GROUP BY o_orderkey""")
def top_tags(spark, sf_dir):
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.concat(F.lit("tag"), F.col("l_linenumber").cast("string")).alias("name"), (F.col("l_partkey") % 100 / 100.0).cast("double").alias("score")).alias("t"))
    tags = x.groupBy(F.col("l_orderkey").alias("image")).agg(F.collect_list("t").alias("tags"))
    best = detect.top_tags(F.col("tags"), ("tag1", "tag2"), 3)
    return tags.select("image", F.array_join(F.transform(best, lambda t: t["name"]), ",").alias("tags"), detect.ratings_of(F.col("tags"), ("tag1",))["tag1"].alias("tag1"))


# --- moves --------------------------------------------------------------------------------------


def plan(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    n = F.col("doc_id")
    folder = F.when(n % 4 == 0, F.concat(F.lit("krea2_turbo/_json/"), "lang", F.lit("/2024/"), "source")).otherwise(F.col("source"))
    rows = d.select(
        F.concat(F.lit(f"{ROOT}/"), folder, F.lit("/img"), (n % 50).cast("string"), F.lit("_"), (n % 3).cast("string"), F.lit(".PNG")).alias("source_path"), "doc_id",
        F.when(n % 5 == 0, "").otherwise(F.col("lang")).alias("entity"), F.when(n % 6 == 0, "").otherwise(F.col("source")).alias("subject"), F.when(n % 2 == 0, "other").otherwise("En:gine").alias("engine"),
        F.when(n % 9 == 0, "Posted").otherwise("draft").alias("old_bucket"), F.sha2("text", 256).alias("sha256"), (n.cast("decimal(20,0)") * 86400000000000 + 1600000000000000000).alias("mtime_ns"),
    )
    return rows


def placed(spark, sf_dir) -> DataFrame:
    rows = plan(spark, sf_dir).withColumn("c", paths.nested_context("source_path", ROOT, "entity", "subject", "engine"))
    rows = rows.withColumn("d", paths.destination("source_path", ROOT, TARGET, F.col("c.entity"), F.col("c.subject"), F.col("c.engine"), paths.is_posted("old_bucket"), "mtime_ns"))
    return rows.select("doc_id", "source_path", F.col("d.path").alias("destination_path"), F.col("d.state").alias("target_state"), "sha256")


_PLAN = f"""p AS (SELECT doc_id, doc_id % 4 = 0 AS nested, sha256(text) AS sha, '{ROOT}/' || CASE WHEN doc_id % 4 = 0 THEN 'krea2_turbo/_json/' || lang || '/2024/' || source ELSE source END || '/img' || doc_id % 50 || '_' || doc_id % 3 || '.PNG' AS source_path,
 CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS entity, CASE WHEN doc_id % 6 = 0 THEN '' ELSE source END AS subject, lang, source, CASE WHEN doc_id % 2 = 0 THEN 'other' ELSE 'En_gine' END AS engine, doc_id % 9 = 0 AS posted,
 strftime(to_timestamp(doc_id * 86400 + 1600000000) AT TIME ZONE 'UTC', '%Y/%m') AS month FROM documents),
c AS (SELECT *, CASE WHEN nested AND entity = '' THEN lang ELSE entity END AS ent, CASE WHEN nested AND subject = '' THEN source ELSE subject END AS sub, CASE WHEN nested AND engine = 'other' THEN 'krea2_turbo' ELSE engine END AS eng FROM p),
d AS (SELECT *, '{TARGET}/' || CASE WHEN ent = '' OR sub = '' THEN '待分拣' ELSE ent || '/' || sub END || '/' || CASE WHEN posted THEN '已发帖' ELSE '待复核' END || '/' || month || '/' AS folder, eng || '__img' || doc_id % 50 || '_' || doc_id % 3 AS name FROM c)"""


@query(f"WITH {_PLAN} SELECT doc_id, source_path, folder || name || '.png' AS destination_path, CASE WHEN posted THEN '已发帖' ELSE '待复核' END AS target_state FROM d")
def plan_destinations(spark, sf_dir):
    return placed(spark, sf_dir).drop("sha256")


@query(f"""WITH {_PLAN}, r AS (SELECT *, row_number() OVER (PARTITION BY lower(folder || name || '.png') ORDER BY source_path, doc_id) AS n FROM d)
SELECT doc_id, folder || name || CASE WHEN n > 1 THEN '__' || substr(sha, 1, 12) ELSE '' END || '.png' AS destination_path FROM r""")
def collision_rename(spark, sf_dir):
    own = placed(spark, sf_dir).withColumn("order", F.struct("source_path", "doc_id"))
    return moves.renamed(own, "order").select("doc_id", "destination_path")


@query(f"""WITH {_FOUND} SELECT split_part(source_path, '/', 4) || '/' || lang AS directory, count(*) AS n FROM f GROUP BY ALL HAVING bool_and(doc_id % 50 <> 0)""")
def ready_directories(spark, sf_dir):
    occ = found(spark, sf_dir).withColumn("occurrence_state", F.when(F.col("doc_id") % 50 == 0, "FROZEN").otherwise("PROCESSED"))
    return moves.ready_directories(occ, F.concat_ws("/", paths.source_directory("source_path", ROOT), F.col("lang")))


@query("""WITH e AS (SELECT event_id, event_id % 5 AS a, user_id % 4 AS b, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE 'sha' END AS src, event_id % 5 <> 2 AS same, user_id % 4 > 0 AS there, CASE user_id % 4 WHEN 1 THEN 'sha' WHEN 2 THEN 'x' WHEN 3 THEN 'sha' END AS dst FROM events)
SELECT event_id, CASE WHEN dst = 'sha' AND src IS NULL THEN 'MOVED' WHEN dst = 'sha' AND src = 'sha' THEN 'COLLISION' WHEN src IS NULL THEN 'MISSING' WHEN NOT (same AND src = 'sha') THEN 'SOURCE_CHANGED' WHEN there THEN 'COLLISION' ELSE 'PLANNED' END AS state FROM e""")
def apply_matrix(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    a, b = F.col("event_id") % 5, F.col("user_id") % 4
    src = F.when(a == 0, None).when(a == 1, "other").otherwise("sha")
    dst = F.when(b.isin(1, 3), "sha").when(b == 2, "x")
    return e.select("event_id", moves.outcome(src, a != 2, b > 0, dst, F.lit("sha")).alias("o")).select("event_id", "o.state")


# --- digests ------------------------------------------------------------------------------------


@query("SELECT event_id, event_type || ':message_sha256=' || substr(sha256(coalesce(props, '')), 1, 16) AS error FROM events")
def safe_error_digest(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", digests.safe_error("event_type", "props").alias("error"))


@query("""SELECT doc_id, sha256('{"lang":"' || lang || '","prompt":' || to_json('n ' || n_chars) || ',"source":"' || source || '"}') AS sha256, 'lang,prompt,source' AS keys, 3 AS n FROM documents""")
def metadata_evidence(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    pairs = F.create_map(F.lit("source"), F.col("source"), F.lit("prompt"), F.concat(F.lit("n "), F.col("n_chars").cast("string")), F.lit("lang"), F.col("lang"))
    return d.select("doc_id", digests.metadata_evidence(pairs).alias("m")).select("doc_id", "m.sha256", F.array_join("m.keys", ",").alias("keys"), "m.n")


@query("""SELECT o_orderkey, sha256('{"graph":{"links":[],"nodes":[{"id":' || o_orderkey || ',"kind":"' || o_orderstatus || '"},[1,2,null]]},"owner":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"' || o_custkey || '"' END || CASE WHEN o_orderkey % 2 = 0 THEN ',"zoom":true' ELSE '' END || '}') AS sha256,
CASE WHEN o_orderkey % 2 = 0 THEN 'graph,owner,zoom' ELSE 'graph,owner' END AS keys, (2 + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::INTEGER AS n FROM orders""")
def metadata_nested(spark, sf_dir):
    """Evidence of nested metadata as it comes from files: keys in any order, white space between."""
    o = read(spark, sf_dir, "orders")
    owner = F.when(F.col("o_orderkey") % 5 == 0, "null").otherwise(F.concat(F.lit('"'), F.col("o_custkey").cast("string"), F.lit('"')))
    zoom = F.when(F.col("o_orderkey") % 2 == 0, '"zoom": true, ').otherwise("")
    nodes = F.concat(F.lit('"nodes": [{"kind":"'), "o_orderstatus", F.lit('", "id": '), F.col("o_orderkey").cast("string"), F.lit("}, [1, 2, null]]"))
    text = F.concat(F.lit("{ "), zoom, F.lit('"owner" : '), owner, F.lit(', "graph":{'), nodes, F.lit(',\n"links":[]}}'))
    own = o.select("o_orderkey", digests.nested_evidence(text).alias("e"))
    return own.select("o_orderkey", "e.sha256", F.array_join("e.keys", ",").alias("keys"), "e.n")
