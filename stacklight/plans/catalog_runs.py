"""Registered queries over feature runs: diffs, decisions, transitions, detector outputs and move plans, with equivalent SQL.

Documents play the paths of a run, their texts the assets, and labels what inference and review found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklight.functions import boxes, images, paths, vectors
from stacklight.operators import assets, decisions, detect, diff, moves, runs
from stacklight.plans import outputs, reprocess
from stacklight.plans.catalog import _METRICS, _OPEN, _OUTCOMES, CONFIG, GATES, GRID_M, GRID_S, ROOT, SQL, TARGET, _pairs_sql, found, known, labelled, ppm, query, read
from stacklight.sources import baseline, files
from stacklight.sources.shared import once

ITEM_STATES = ("COMPLETE", "PENDING", "LEASED", "RETRYABLE_FAILED", "FAILED", "SOURCE_CHANGED")


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def run_paths(spark, sf_dir) -> DataFrame:
    """Documents as a run's paths, two runs by the parity of doc_id."""
    n = F.col("doc_id")
    state = F.when(n % 10 == 0, "MISSING").when(n % 10 == 1, "SOURCE_CHANGED").when(n % 10 == 2, "ADDED_DEFERRED").when(n % 10 < 5, "PROCESSED").otherwise("FROZEN")
    return found(spark, sf_dir).select(
        F.concat(F.lit("run"), (F.floor(n / 5) % 2).cast("string")).alias("run_id"), "doc_id", "source_path", F.when(n % 10 > 0, F.col("asset_id")).alias("asset_id"), F.col("lang").alias("old_bucket"),
        (F.col("source") == "src3").alias("audit_locked"), (n % 6 == 5).alias("baseline_identity_unverifiable"), state.alias("occurrence_state"),
    )


def run_items(spark, sf_dir) -> DataFrame:
    """Assets of labelled documents as a run's items, with features as adapters write them."""
    own = found(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id").groupBy("asset_id").agg(F.min("doc_id").alias("m"), F.max("quality").alias("q"), F.max("toxic").alias("t"))
    m = F.col("m")
    tags = F.transform(F.sequence(F.lit(0).cast("bigint"), m % 12), lambda i: F.struct(F.concat(F.lit("tag"), i.cast("string")).alias("name"), ((12 - i) / 12.0).alias("score")))
    tagger = F.struct((m % 10 / 100.0).alias("rating_explicit"), (m % 40 / 100.0).alias("rating_sensitive"), (m % 20 / 100.0).alias("rating_questionable"), tags.alias("top_tags"))
    features = F.struct(
        F.struct((m % 8).cast("double").alias("entropy_bits"), (m % 30 / 200.0).alias("dark_clip_ratio")).alias("technical"),
        F.struct(tagger.alias("wd14_moat"), F.struct((F.col("t") * 0.5).alias("explicit_score")).alias("nudenet")).alias("analysis"),
    )
    state = _pick(ITEM_STATES, m)
    return own.select("asset_id", "m", "q", "t", state.alias("state"), F.when(state == "COMPLETE", F.to_json(features)).alias("features"))


def said(spark, sf_dir) -> DataFrame:
    """Decisions for the items: identities of the good ones that divide by no 4."""
    i = run_items(spark, sf_dir)
    identity = F.when((F.col("q") == 1) & (F.col("m") % 4 > 0), "good")
    reasons = F.when(identity.isNull(), F.array(F.lit("identity_unknown"))).otherwise(F.array(F.lit("status_policy_not_calibrated")))
    return i.where("m % 9 > 0").select("asset_id", F.when(F.col("t") == 1, "hold").otherwise("keep").alias("proposed_bucket"), identity.alias("identity"), (F.col("q") / 2.0).alias("confidence"), reasons.alias("reasons"))


_FOUND = "f AS (SELECT doc_id, lang, source, text, n_chars, '/library/output/' || source || '/' || doc_id || '.txt' AS source_path, sha256(text) AS asset_id FROM documents)"
_RUN = f"""{_FOUND},
p AS (SELECT 'run' || doc_id // 5 % 2 AS run_id, doc_id, source_path, CASE WHEN doc_id % 10 > 0 THEN asset_id END AS asset_id, lang AS old_bucket, source = 'src3' AS audit_locked, doc_id % 6 = 5 AS unverifiable,
 CASE WHEN doc_id % 10 = 0 THEN 'MISSING' WHEN doc_id % 10 = 1 THEN 'SOURCE_CHANGED' WHEN doc_id % 10 = 2 THEN 'ADDED_DEFERRED' WHEN doc_id % 10 < 5 THEN 'PROCESSED' ELSE 'FROZEN' END AS occurrence_state FROM f),
i AS (SELECT asset_id, min(doc_id) AS m, max(quality) AS q, max(toxic) AS t, {list(ITEM_STATES)!r}[min(doc_id) % 6 + 1] AS state FROM f JOIN labels USING (doc_id) GROUP BY asset_id),
s AS (SELECT asset_id, CASE WHEN t = 1 THEN 'hold' ELSE 'keep' END AS proposed_bucket, CASE WHEN q = 1 AND m % 4 > 0 THEN 'good' END AS identity,
 CASE WHEN q = 1 AND m % 4 > 0 THEN ['status_policy_not_calibrated'] ELSE ['identity_unknown'] END AS reasons FROM i WHERE m % 9 > 0)"""
_RUN_DIFF = f"""{_RUN},
a AS (SELECT p.*, i.m, i.t, i.state, CASE WHEN occurrence_state = 'PROCESSED' OR state = 'COMPLETE' THEN CASE WHEN unverifiable THEN 'baseline_identity_unverifiable' ELSE 'processed' END WHEN state = 'FAILED' THEN 'error'
 WHEN state IN ('PENDING', 'LEASED', 'RETRYABLE_FAILED') THEN lower(state) ELSE lower(occurrence_state) END AS status FROM p LEFT JOIN i ON i.asset_id = p.asset_id),
b AS (SELECT a.*, s.proposed_bucket AS proposed, s.identity, s.reasons, s.asset_id IS NOT NULL AS decided, status IN ('processed', 'baseline_identity_unverifiable') AS stable, coalesce(state, '') = 'COMPLETE' AS seen FROM a LEFT JOIN s ON s.asset_id = a.asset_id),
c AS (SELECT *, CASE WHEN stable THEN 'processed' ELSE status END AS processing_state, stable AND identity IS NULL AS unidentified FROM b),
d AS (SELECT *, unidentified AND NOT audit_locked AS waits, list_filter([CASE WHEN audit_locked THEN 'published_lock' END, CASE WHEN seen AND (t = 1 OR m % 10 >= 10) THEN 'safety_signal' END, CASE WHEN seen AND (m % 40 >= 20 OR m % 20 >= 10) THEN 'safety_boundary' END,
 CASE WHEN seen AND (m % 8 < 2 OR m % 30 > 20) THEN 'quality_boundary' END, CASE WHEN unidentified THEN 'unknown_identity' END], lambda r: r IS NOT NULL) AS found FROM c)"""


@query(f"""WITH {_RUN_DIFF} SELECT sha256(source_path) AS occurrence_id, status, processing_state, CASE WHEN waits THEN '待复核' ELSE proposed END AS proposed_bucket, CASE WHEN waits THEN '待复核' WHEN audit_locked THEN old_bucket ELSE proposed END AS effective_bucket, identity,
CASE WHEN NOT audit_locked THEN 'candidate_only' END AS action, CASE WHEN len(found) > 0 THEN array_to_string(found, ',') ELSE 'source_outcome' END AS strata,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(reasons, []), CASE WHEN stable THEN [] ELSE [status] END, CASE WHEN stable AND NOT decided THEN ['decision_missing'] ELSE [] END,
 CASE WHEN waits THEN ['identity_reference_decision_pending', 'status_policy_not_calibrated'] ELSE [] END))), ','), '') AS reasons,
CASE WHEN seen THEN least(8, m % 12 + 1) END AS tags, CASE WHEN seen THEN m % 8 < 2 OR m % 30 > 20 END AS quality_boundary FROM d""")
def run_diff(spark, sf_dir):
    rows = diff.run_diff(run_paths(spark, sf_dir), run_items(spark, sf_dir), said(spark, sf_dir))
    tags = F.when(F.col("evidence").isNotNull(), F.size("evidence.top_tags")).cast("bigint")
    return rows.select("occurrence_id", "status", "processing_state", "proposed_bucket", "effective_bucket", "identity", "action", F.array_join("review_strata", ",").alias("strata"), F.array_join("review_reasons", ",").alias("reasons"), tags.alias("tags"), F.col("evidence.quality_boundary").alias("quality_boundary"))


@query(f"""WITH {_RUN_DIFF}, o AS (SELECT sha256(source_path) AS occurrence_id, source_path, unnest(CASE WHEN len(found) > 0 THEN found[1:1] ELSE ['source_outcome'] END) AS stratum FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('run0:' || occurrence_id), occurrence_id) AS rn FROM o)
SELECT occurrence_id, source_path, stratum FROM k ORDER BY rn, stratum LIMIT 60""")
def review_paths(spark, sf_dir):
    """The review sample of a run's diff with its paths."""
    rows = diff.run_diff(run_paths(spark, sf_dir), run_items(spark, sf_dir), said(spark, sf_dir)).withColumn("review_strata", F.slice("review_strata", 1, 1))
    return diff.with_paths(diff.review_queue(rows, 60, "run0"), rows).select("occurrence_id", "source_path", "stratum")


@query(f"""WITH {_RUN_DIFF}, z AS (SELECT list_distinct(list_concat(coalesce(reasons, []), CASE WHEN stable THEN [] ELSE [status] END)) AS why, source_path FROM d),
y AS (SELECT source_path, list_filter([CASE WHEN len(list_filter(why, lambda r: r LIKE 'safety%')) > 0 THEN 'safety' END, CASE WHEN len(list_filter(why, lambda r: r LIKE 'identity%')) > 0 THEN 'identity' END, CASE WHEN len(list_filter(why, lambda r: r LIKE 'quality%')) > 0 THEN 'quality' END,
 CASE WHEN len(list_filter(why, lambda r: r LIKE 'source%')) > 0 THEN 'source' END, CASE WHEN len(list_filter(why, lambda r: r LIKE 'baseline%')) > 0 THEN 'baseline' END], lambda r: r IS NOT NULL) AS kinds FROM z)
SELECT source_path, CASE WHEN len(kinds) > 0 THEN array_to_string(kinds, ',') ELSE 'general' END AS strata FROM y""")
def reason_strata(spark, sf_dir):
    """Strata from the reasons alone, for rows that carry none of their own."""
    frozen = diff.run_states(run_paths(spark, sf_dir), run_items(spark, sf_dir)).withColumn("reason", F.lit(None).cast("string"))
    rows = diff.diff_rows(frozen, said(spark, sf_dir))
    return rows.select("source_path", F.array_join(diff.strata_of_reasons(F.col("review_reasons")), ",").alias("strata"))


# --- decisions ----------------------------------------------------------------------------------

_DECISIONS = [("d0", "run0", "c1", "r1", "l1", "COMPLETE"), ("d1", "run1", "c1", "r1", "l1", "CREATED"), ("d2", "run1", "c2", "r1", "l1", "FAILED")]
_DECISION_RUNS = "decision_id string, run_id string, config_fingerprint string, reference_fingerprint string, labels_fingerprint string, status string"


def decision_runs(spark) -> DataFrame:
    return spark.createDataFrame(_DECISIONS, _DECISION_RUNS)


def results(spark, sf_dir) -> DataFrame:
    """Two results for some assets of each decision: the later one counts."""
    items = run_paths(spark, sf_dir).where("asset_id is not null").select("run_id", "asset_id", "doc_id").join(decision_runs(spark), "run_id")
    state = F.when(F.col("doc_id") % 3 > 0, "ACCEPTED").otherwise("UNKNOWN")
    return items.where("doc_id % 7 > 0").select("decision_id", "asset_id", F.col("doc_id").alias("event_seq"), F.concat(F.lit("b"), (F.col("doc_id") % 4).cast("string")).alias("proposed_bucket"), F.when(state == "ACCEPTED", "hero").alias("identity"), (F.col("doc_id") % 100 / 100.0).alias("confidence"), state.alias("decision_state"), F.array().cast("array<string>").alias("reasons"))


_RESULTS = """dr(decision_id, run_id) AS (VALUES ('d0', 'run0'), ('d1', 'run1'), ('d2', 'run1')),
r AS (SELECT decision_id, asset_id, max(doc_id) AS n FROM p JOIN dr USING (run_id) WHERE asset_id IS NOT NULL AND doc_id % 7 > 0 GROUP BY ALL)"""


@query(f"""WITH {_RUN}, {_RESULTS} SELECT dr.decision_id, p.source_path, p.occurrence_state, CASE WHEN n % 3 > 0 THEN 'ACCEPTED' WHEN n % 3 = 0 THEN 'UNKNOWN' END AS decision_state, CASE WHEN n % 3 > 0 THEN 'hero' END AS identity,
CASE WHEN audit_locked THEN old_bucket ELSE 'b' || n % 4 END AS effective_bucket FROM p JOIN dr USING (run_id) LEFT JOIN r ON r.decision_id = dr.decision_id AND r.asset_id = p.asset_id""")
def decision_diffs(spark, sf_dir):
    occ = run_paths(spark, sf_dir)
    kept = decisions.recorded(results(spark, sf_dir), decision_runs(spark), occ.where("asset_id is not null"))
    return decisions.decision_diffs(occ, decision_runs(spark), kept).select("decision_id", "source_path", "occurrence_state", "decision_state", "identity", "effective_bucket")


@query(f"""WITH {_RUN}, {_RESULTS}, w AS (SELECT CASE decision_id WHEN 'd0' THEN 'd1' ELSE 'd0' END AS decision_id, asset_id FROM r WHERE decision_id <> 'd2')
SELECT decision_id, asset_id FROM w WHERE asset_id NOT IN (SELECT p.asset_id FROM p JOIN dr USING (run_id) WHERE dr.decision_id = w.decision_id AND p.asset_id IS NOT NULL)""")
def decision_membership(spark, sf_dir):
    """Results filed under the other decision: those whose asset is no part of its run."""
    wrong = results(spark, sf_dir).where("decision_id <> 'd2'").select(F.when(F.col("decision_id") == "d0", "d1").otherwise("d0").alias("decision_id"), "asset_id").distinct()
    return decisions.strangers(wrong, decision_runs(spark), run_paths(spark, sf_dir).where("asset_id is not null"))


@query("""WITH a AS (SELECT 'd' || (c_custkey - 1) AS decision_id, 'run' || c_custkey % 2 AS run_id, 'c' || (1 + c_custkey % 2) AS config FROM customer)
SELECT decision_id, CASE WHEN decision_id NOT IN ('d0', 'd1', 'd2') THEN 'new' WHEN decision_id = 'd0' AND run_id = 'run0' AND config = 'c1' THEN 'complete' WHEN decision_id = 'd1' AND run_id = 'run1' AND config = 'c1' THEN 'resumed' ELSE 'refused' END AS outcome, decision_id NOT IN ('d0', 'd1', 'd2') AS created FROM a""")
def decision_reuse(spark, sf_dir):
    """Asking for decision runs again: equal inputs resume, others are refused, unknown ids are created once."""
    c = read(spark, sf_dir, "customer").select("c_custkey")
    asked = c.select(F.concat(F.lit("d"), (F.col("c_custkey") - 1).cast("string")).alias("decision_id"), F.concat(F.lit("run"), (F.col("c_custkey") % 2).cast("string")).alias("run_id"), F.concat(F.lit("c"), (1 + F.col("c_custkey") % 2).cast("string")).alias("config_fingerprint"), F.lit("r1").alias("reference_fingerprint"), F.lit("l1").alias("labels_fingerprint"))
    new = decisions.created(decision_runs(spark), asked.union(asked)).select("decision_id", F.lit(True).alias("created"))
    return decisions.reuse(decision_runs(spark), asked).join(new, "decision_id", "left").withColumn("created", F.coalesce("created", F.lit(False)))


# --- transitions --------------------------------------------------------------------------------


def leased(spark, sf_dir) -> DataFrame:
    i = run_items(spark, sf_dir)
    return i.withColumns({"lease_token": F.when(F.col("state") == "LEASED", F.concat(F.lit("t"), (F.col("m") % 3).cast("string"))), "error": F.lit(None).cast("string"), "features": F.concat(F.lit("f"), F.col("m").cast("string"))})


def outcomes(spark, sf_dir) -> DataFrame:
    """Every item is said to have ended under one token: a third of the leases fit."""
    end = _pick(("COMPLETE", "SOURCE_CHANGED", "RETRYABLE_FAILED", "FAILED"), F.floor(F.col("m") / 6))
    return run_items(spark, sf_dir).select("asset_id", F.lit("t1").alias("lease_token"), end.alias("state"), F.when(end == "COMPLETE", F.concat(F.lit("new"), F.col("m").cast("string"))).alias("features"), F.when(end.endswith("FAILED"), "E:message_sha256=0").alias("error"))


_ENDS = "e AS (SELECT *, ['COMPLETE', 'SOURCE_CHANGED', 'RETRYABLE_FAILED', 'FAILED'][m // 6 % 4 + 1] AS said, state = 'LEASED' AND m % 3 = 1 AS hit FROM i)"


@query(f"""WITH {_RUN}, {_ENDS} SELECT asset_id, CASE WHEN hit THEN said ELSE state END AS state, CASE WHEN NOT hit AND state = 'LEASED' THEN 't' || m % 3 END AS lease_token,
CASE WHEN NOT hit THEN 'f' || m WHEN said = 'COMPLETE' THEN 'new' || m END AS features, CASE WHEN hit AND said LIKE '%FAILED' THEN 'E:message_sha256=0' END AS error FROM e""")
def item_transitions(spark, sf_dir):
    return runs.ended(leased(spark, sf_dir), outcomes(spark, sf_dir)).select("asset_id", "state", "lease_token", "features", "error")


@query(f"""WITH {_RUN}, {_ENDS} SELECT source_path, CASE WHEN occurrence_state = 'FROZEN' AND hit AND said = 'COMPLETE' THEN 'PROCESSED' WHEN occurrence_state = 'FROZEN' AND hit AND said = 'SOURCE_CHANGED' THEN 'SOURCE_CHANGED' ELSE occurrence_state END AS occurrence_state
FROM p LEFT JOIN e ON e.asset_id = p.asset_id""")
def occurrence_cascade(spark, sf_dir):
    accepted = runs.transition(leased(spark, sf_dir), outcomes(spark, sf_dir)).where("accepted")
    return runs.cascaded(run_paths(spark, sf_dir), accepted).select("source_path", "occurrence_state")


@query(f"WITH {_RUN} SELECT source_path, CASE WHEN doc_id % 8 = 0 THEN ['MISSING', 'SOURCE_CHANGED', 'ADDED_DEFERRED'][doc_id // 8 % 3 + 1] ELSE occurrence_state END AS occurrence_state FROM p")
def occurrence_marks(spark, sf_dir):
    occ = run_paths(spark, sf_dir)
    marks = occ.where("doc_id % 8 = 0").select("source_path", _pick(("MISSING", "SOURCE_CHANGED", "ADDED_DEFERRED"), F.floor(F.col("doc_id") / 8)).alias("mark"))
    return runs.marked(occ, marks).select("source_path", "occurrence_state")


@query(f"""WITH {_RUN}, j AS (SELECT DISTINCT p.run_id, i.asset_id, i.state FROM p JOIN i USING (asset_id)) SELECT run_id, 'item' AS kind, state, count(*) AS n FROM j GROUP BY ALL
UNION ALL SELECT run_id, 'occurrence', occurrence_state, count(*) FROM p GROUP BY ALL""")
def run_counts(spark, sf_dir):
    occ = run_paths(spark, sf_dir)
    return runs.run_counts(occ.select("run_id", "asset_id").join(run_items(spark, sf_dir), "asset_id").select("run_id", "asset_id", "state").distinct(), occ)


@query(f"""WITH {_RUN}, c AS (SELECT occurrence_state AS state FROM p WHERE doc_id % 3 > 0 UNION ALL SELECT occurrence_state FROM p WHERE doc_id % 3 = 0 UNION ALL SELECT 'RESUMED' FROM p WHERE doc_id % 3 = 0)
SELECT state, count(*) AS n FROM c GROUP BY state""")
def create_counts(spark, sf_dir):
    """A run's creation goes on after a third of its paths are there."""
    occ = run_paths(spark, sf_dir)
    new = occ.where("doc_id % 3 > 0").withColumn("status", F.lower("occurrence_state"))
    deferred = F.col("status") == "added_deferred"
    return runs.create_counts(new.where(~deferred), new.where(deferred), occ.where("doc_id % 3 = 0"))


@query(f"WITH {_RUN} SELECT asset_id, state, CASE WHEN state = 'PENDING' THEN 0 ELSE 0 END::BIGINT AS payload_chars FROM i")
def pruned_items(spark, sf_dir):
    """Items after pruning: states stay, payloads are gone."""
    finished = decision_runs(spark).where("status <> 'CREATED'")
    left = runs.prune(leased(spark, sf_dir), "features", decision_runs=finished)
    return left.select("asset_id", "state", F.coalesce(F.length("features"), F.lit(0)).cast("bigint").alias("payload_chars"))


@query(f"""WITH {_FOUND}, e AS (SELECT * FROM f WHERE doc_id % 11 > 0)
SELECT source_path, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 9 = 0 THEN 'changed' ELSE 'same' END AS outcome FROM f""")
def verified_sources(spark, sf_dir):
    """Size, time and digest of what is listed now against what was recorded."""
    d = found(spark, sf_dir).withColumn("mtime_ns", F.col("doc_id") * 1000)
    recorded = d.select("source_path", F.col("n_chars").alias("size"), "mtime_ns", "asset_id")
    n = F.col("doc_id")
    now = d.where("doc_id % 11 > 0").select("source_path", F.when(n % 5 == 0, -1).otherwise(F.col("n_chars")).alias("size"), F.when(n % 7 == 0, -1).otherwise(F.col("mtime_ns")).alias("mtime_ns"), F.when(n % 9 == 0, "other").otherwise(F.col("asset_id")).alias("asset_id"))
    return files.unchanged(now, recorded).select("source_path", "outcome")


@query(f"""WITH {_RUN_DIFF} SELECT asset_id, array_to_string(list_sort(list(source_path)), ',') AS paths FROM d WHERE stable AND asset_id IS NOT NULL GROUP BY asset_id""")
def unique_assets(spark, sf_dir):
    """What inference runs on: each stable content once, with its paths in order."""
    return assets.unique_assets(diff.run_states(run_paths(spark, sf_dir), run_items(spark, sf_dir))).select("asset_id", F.array_join("paths", ",").alias("paths"))


@query("SELECT source || '/' || n_chars % 20 || '.png' AS source_path, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def repeated_paths(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return baseline.repeated_paths(d.select(F.concat("source", F.lit("/"), (F.col("n_chars") % 20).cast("string"), F.lit(".png")).alias("source_path")))


@query("SELECT doc_id, 'source:' || source || ':' || n_chars AS row, 'lang,n_chars,source,tags' AS header, '[\"' || lang || '\",\"x\"]' AS tags FROM documents")
def flat_report(spark, sf_dir):
    """A report's rows as a CSV holds them: columns in name order, nested cells as JSON."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.array("lang", F.lit("x")).alias("tags"), "lang")
    flat = outputs.flat(d)
    header = ",".join(c for c in flat.columns if c != "doc_id")
    return flat.select("doc_id", F.concat(F.lit("source:"), "source", F.lit(":"), F.col("n_chars").cast("string")).alias("row"), F.lit(header).alias("header"), "tags")


@query("""WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/lib/Output/' || source WHEN 1 THEN '/lib/' || source || '/OUTPUT/x' ELSE '/lib/' || source END || '/' || doc_id || '.png' AS path FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/lib/Output' WHEN 1 THEN regexp_extract(path, '^(.*/OUTPUT)/', 1) ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS root FROM p""")
def feature_roots(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    n = F.col("doc_id") % 3
    folder = F.when(n == 0, F.concat(F.lit("/lib/Output/"), "source")).when(n == 1, F.concat(F.lit("/lib/"), "source", F.lit("/OUTPUT/x"))).otherwise(F.concat(F.lit("/lib/"), "source"))
    return d.select("doc_id", paths.feature_root(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png"))).alias("root"))


@query("""WITH p AS (SELECT doc_id, ' a<b>:' || source || repeat('x', (doc_id % 150)::BIGINT) || '/.' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'z' END || '. ' AS raw FROM documents),
q AS (SELECT doc_id, regexp_replace(regexp_replace(trim(CASE WHEN doc_id % 13 = 0 THEN ' .. ' ELSE raw END), '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '[. ]+$', '') AS t FROM p)
SELECT doc_id, coalesce(nullif(substr(t, 1, 120), ''), 'image') AS name FROM q""")
def safe_components(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    n = F.col("doc_id")
    raw = F.concat(F.lit(" a<b>:"), "source", F.repeat(F.lit("x"), (n % 150).cast("int")), F.lit("/."), F.when(n % 4 == 0, "").otherwise("z"), F.lit(". "))
    return d.select("doc_id", paths.safe_component(F.when(n % 13 == 0, " .. ").otherwise(raw), "image").alias("name"))


# --- vectors ------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), b AS (SELECT id + 1 AS id, v AS w FROM v)
SELECT id, floor(list_dot_product(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))) * 1e6 + 0.5)::BIGINT AS cosine_ppm FROM v JOIN b USING (id)""")
def vector_cosine(spark, sf_dir):
    """Each vector with the one before it; all must have 64 components."""
    v = labelled(spark, sf_dir).select("id", vectors.with_dimensions("vector", 64).alias("v"))
    before = v.select((F.col("id") + 1).alias("id"), F.col("v").alias("w"))
    return v.join(before, "id").select("id", ppm(vectors.cosine("v", "w")).alias("cosine_ppm"))


_HALF = "CASE WHEN abs(x) < 6.103515625e-05 THEN round_even(x * 16777216, 0) / 16777216 ELSE round_even(x / pow(2, floor(log2(abs(x))) - 10), 0) * pow(2, floor(log2(abs(x))) - 10) END"


@query(f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS raw FROM embeddings), u AS (SELECT id, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS u FROM v),
h AS (SELECT id, list_transform(u, lambda x: {_HALF}) AS h FROM u), b AS (SELECT id, h, list_transform(h, lambda x: x / sqrt(list_dot_product(h, h))) AS b FROM h)
SELECT id, (2 * len(h))::BIGINT AS n_bytes, floor(b[1] * 1e9 + 0.5)::BIGINT AS first_ppb, floor(b[64] * 1e9 + 0.5)::BIGINT AS last_ppb, floor(list_sum(list_transform(b, lambda x: abs(x))) * 1e9 + 0.5)::BIGINT AS sum_ppb FROM b""")
def float16_codec(spark, sf_dir):
    """Half-precision bytes and back, against rounding to 11 bits in arithmetic."""
    v = labelled(spark, sf_dir).select("id", vectors.half_bytes("vector").alias("half")).withColumn("back", vectors.from_half_bytes("half"))
    ppb = lambda c: F.floor(c * 1e9 + 0.5).cast("bigint")
    return v.select("id", F.length("half").cast("bigint").alias("n_bytes"), ppb(F.col("back")[0]).alias("first_ppb"), ppb(F.col("back")[63]).alias("last_ppb"), ppb(F.aggregate("back", F.lit(0.0), lambda s, x: s + F.abs(x))).alias("sum_ppb"))


SQL["float16_roundtrip"] = f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS raw FROM embeddings), u AS (SELECT id, list_transform(raw, lambda x: x / sqrt(list_dot_product(raw, raw))) AS u FROM v),
h AS (SELECT id, u, list_transform(u, lambda x: {_HALF}) AS h FROM u), b AS (SELECT id, u, h, list_transform(h, lambda x: x / sqrt(list_dot_product(h, h))) AS b FROM h)
SELECT id, (2 * len(h))::INTEGER AS n_bytes, floor((1 - list_dot_product(b, u)) * 1e6 + 0.5)::BIGINT AS lost_ppm FROM b"""


# --- detector outputs ---------------------------------------------------------------------------

_CLASSES = len(boxes.CLASSES)


def raw_outputs(spark, sf_dir) -> DataFrame:
    """image, outputs: two raw detector outputs for every image of eight orders, rows of 22 values in line order; some images have none."""
    x = read(spark, sf_dir, "lineitem")
    part, supp, size = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    scores = (((part * (j + 3) + supp) % 97 * size / 5000.0) for j in range(_CLASSES))
    row = F.array((part * 37 % 300 + 10).cast("double"), (supp * 53 % 300 + 10).cast("double"), 30 + size, 40 + size, *scores)
    rows = x.where("l_orderkey % 5 > 0").select(F.floor(F.col("l_orderkey") / 8).alias("image"), (F.col("l_linenumber") % 2).alias("o"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), part.alias("part"), row.alias("row")).alias("r"))
    of = lambda o: F.transform(F.array_sort(F.collect_list(F.when(F.col("o") == o, F.col("r")))), lambda r: r["row"])
    found_rows = rows.groupBy("image").agg(F.array(of(0), of(1)).alias("outputs"))
    images = read(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 8).alias("image")).distinct()
    return images.join(found_rows, "image", "left").withColumn("outputs", F.coalesce("outputs", F.array().cast("array<array<array<double>>>")))


_RAW = f"""r0 AS (SELECT l_orderkey // 8 AS image, l_linenumber % 2 AS o, l_orderkey * 10 + l_linenumber AS seq, l_partkey AS part, list_transform(range({_CLASSES}), lambda j: (l_partkey * (j + 3) + l_suppkey) % 97 * l_quantity / 5000.0::DOUBLE) AS scores,
greatest(0.0::DOUBLE, (l_partkey * 37 % 300 + 10)::DOUBLE - (30 + l_quantity) / 2) AS x, greatest(0.0::DOUBLE, (l_suppkey * 53 % 300 + 10)::DOUBLE - (40 + l_quantity) / 2) AS y, 30 + l_quantity AS w0, 40 + l_quantity AS h0 FROM lineitem WHERE l_orderkey % 5 > 0),
r1 AS (SELECT image, o, seq, part, list_max(scores) AS score, list_position(scores, list_max(scores)) AS c, x, y, greatest(0.0, least(w0, 320 - x)) AS w, greatest(0.0, least(h0, 320 - y)) AS h FROM r0),
r2 AS (SELECT *, row_number() OVER (PARTITION BY image, o, c ORDER BY score DESC, seq, part) AS rn FROM r1 WHERE score >= 0.15 AND w * h >= 4),
step AS (SELECT image, o, c, 0::BIGINT AS rn, []::STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] AS boxes, 0::DOUBLE AS score, 0::DOUBLE AS area, false AS took FROM (SELECT DISTINCT image, o, c FROM r2)
 UNION ALL SELECT s.image, s.o, s.c, b.rn, CASE WHEN ok THEN list_append(s.boxes, {{'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}}) ELSE s.boxes END, b.score, b.w * b.h, ok FROM step s JOIN r2 b ON b.image = s.image AND b.o = s.o AND b.c = s.c AND b.rn = s.rn + 1,
 LATERAL (SELECT len(list_filter(s.boxes, lambda k: greatest(0.0, least(b.x + b.w, k.x + k.w) - greatest(b.x, k.x)) * greatest(0.0, least(b.y + b.h, k.y + k.h) - greatest(b.y, k.y))
  / (b.w * b.h + k.w * k.h - greatest(0.0, least(b.x + b.w, k.x + k.w) - greatest(b.x, k.x)) * greatest(0.0, least(b.y + b.h, k.y + k.h) - greatest(b.y, k.y))) > 0.45)) = 0 AS ok)),
kept AS (SELECT image, o, c, score, area FROM step WHERE took)"""


@query(f"""WITH RECURSIVE {_RAW}, im AS (SELECT DISTINCT o_orderkey // 8 AS image FROM orders)
SELECT im.image, count(c) AS n, coalesce(max(score) FILTER (WHERE c IN (3, 4, 5, 7, 15)), 0.0)::DOUBLE AS explicit_score, coalesce(max(score) FILTER (WHERE c IN (1, 16, 17, 18)), 0.0)::DOUBLE AS covered_score,
count(DISTINCT c) AS classes, least(24, count(c)) AS listed, coalesce(floor(sum(area) / 102400 * 1e3 + 0.5), 0)::BIGINT AS area_permille FROM im LEFT JOIN kept USING (image) GROUP BY im.image""")
def detector_summary(spark, sf_dir):
    """From raw detector rows to a summary for every image, those without boxes included: one projection after the rows are gathered."""
    d = raw_outputs(spark, sf_dir).select("image", detect.detected("outputs").alias("found"))
    s = d.select("image", F.size("found").cast("bigint").alias("n"), detect.summary_of("found").alias("s"), F.aggregate("found", F.lit(0.0), lambda a, b: a + b["w"] * b["h"]).alias("area"))
    return s.select("image", "n", F.col("s.explicit_score").alias("explicit_score"), F.col("s.covered_score").alias("covered_score"), F.size("s.class_maxima").cast("bigint").alias("classes"), F.size("s.detections").cast("bigint").alias("listed"), F.floor(F.col("area") / 102400 * 1e3 + 0.5).cast("bigint").alias("area_permille"))


# --- move plans ---------------------------------------------------------------------------------


def baseline_rows(spark, sf_dir) -> DataFrame:
    """Documents as rows of a baseline, sidecars among them, some twice, with what a listing says of each path."""
    d = read(spark, sf_dir, "documents")
    n = F.col("doc_id")
    suffix = F.when(n % 4 == 0, ".txt").otherwise(".PNG")
    rows = d.select(
        F.concat(F.lit(f"{ROOT}/"), "source", F.lit("/"), "lang", F.lit("/img"), (n % 40).cast("string"), F.lit("_"), (F.floor(n / 40)).cast("string"), suffix).alias("source_path"), n.alias("doc_id"), "source", "lang",
        F.col("lang").alias("entity"), F.when(n % 6 == 0, "").otherwise(F.col("source")).alias("subject"), F.lit("Engine").alias("engine"), F.when(n % 9 == 0, "Posted").otherwise("draft").alias("old_bucket"),
        F.sha2("text", 256).alias("sha256"), (F.floor(n / 100) * 86400000000000 + 1600000000000000000).alias("mtime_ns"), F.col("n_chars").alias("source_size"),
    )
    return rows.withColumn("place", n).union(rows.where("doc_id % 23 = 0").withColumn("place", n + 1_000_000_000))


def feature_paths(rows: DataFrame) -> DataFrame:
    """The feature run's paths: a seventh is not processed, src3 has one open, src4 is locked out by the request."""
    b = rows.where("place < 1000000000")
    n = F.col("doc_id")
    return b.withColumn("occurrence_state", F.when((F.col("source") == "src3") & (n % 3 == 0), "FROZEN").when(n % 7 == 0, "MISSING").otherwise("PROCESSED"))


def move_rows(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    occ = feature_paths(rows)
    ready = moves.ready_directories(occ, paths.source_directory("source_path", ROOT)).where("directory <> 'src4'")
    done = occ.where("occurrence_state = 'PROCESSED'")
    known = done.select("source_path", F.col("source_size").alias("size"), F.when(F.col("doc_id") % 19 == 0, -1).otherwise(F.col("mtime_ns")).alias("mtime_ns"), "sha256")
    return moves.selected(rows, ROOT, ready, existing, done, known)


_MOVES = f"""b AS (SELECT doc_id, source, lang, '{ROOT}/' || source || '/' || lang || '/img' || doc_id % 40 || '_' || doc_id // 40 || CASE WHEN doc_id % 4 = 0 THEN '.txt' ELSE '.PNG' END AS source_path,
 CASE WHEN doc_id % 4 = 0 THEN '.txt' ELSE '.png' END AS suffix, sha256(text) AS sha, strftime(to_timestamp(doc_id // 100 * 86400 + 1600000000) AT TIME ZONE 'UTC', '%Y/%m') AS month FROM documents),
m AS (SELECT *, '{TARGET}/' || CASE WHEN doc_id % 6 = 0 THEN '待分拣' ELSE lang || '/' || source END || '/' || CASE WHEN doc_id % 9 = 0 THEN '已发帖' ELSE '待复核' END || '/' || month || '/Engine__img' || doc_id % 40 || '_' || doc_id // 40 || suffix AS destination_path FROM b
 WHERE source NOT IN ('src3', 'src4') AND (suffix = '.txt' OR doc_id % 7 > 0) AND NOT (doc_id % 7 > 0 AND doc_id % 19 = 0))"""


@query(f"WITH {_MOVES} SELECT source_path, destination_path, sha AS sha256 FROM m")
def move_plan(spark, sf_dir):
    return moves.planned(move_rows(once(baseline_rows(spark, sf_dir))), ROOT, TARGET).select("source_path", "destination_path", "sha256")


@query(f"WITH {_MOVES} SELECT source_path, destination_path FROM m WHERE source NOT IN ('src0', 'src1', 'src2')")
def move_sync(spark, sf_dir):
    """What directories that settled later add to a journal that has the first three."""
    rows = once(baseline_rows(spark, sf_dir))
    plan = moves.planned(move_rows(rows), ROOT, TARGET)
    journal = plan.where(paths.source_directory("source_path", ROOT).isin("src0", "src1", "src2")).select("source_path", "destination_path")
    new = moves.planned(move_rows(rows, journal), ROOT, TARGET)
    return moves.appended(new, journal).select("source_path", "destination_path")


# --- images, tags, times and journals -----------------------------------------------------------


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: least(255, greatest(0, floor((x::DOUBLE + 1) * 127.5)))::BIGINT) AS a FROM embeddings),
b AS (SELECT vec_id, unnest(a) AS v FROM p), h AS (SELECT vec_id, v, count(*) AS n FROM b GROUP BY ALL),
e AS (SELECT vec_id, floor(-sum(n / 64 * log2(n / 64)) * 1e3 + 0.05)::BIGINT AS entropy, floor(coalesce(sum(n) FILTER (WHERE v < 3), 0) / 64 * 1e6 + 0.5)::BIGINT AS dark, floor(sum(n * v) / 64 * 1e2 + 0.5)::BIGINT AS luminance FROM h GROUP BY vec_id),
g AS (SELECT vec_id, a, unnest(range(1, 7)) AS y FROM p), g2 AS (SELECT vec_id, a, y, unnest(range(1, 7)) AS x FROM g),
k AS (SELECT vec_id, least(255, greatest(0, 9 * a[y*8+x+1] - (a[(y-1)*8+x] + a[(y-1)*8+x+1] + a[(y-1)*8+x+2] + a[y*8+x] + a[y*8+x+1] + a[y*8+x+2] + a[(y+1)*8+x] + a[(y+1)*8+x+1] + a[(y+1)*8+x+2]))) AS e FROM g2)
SELECT e.vec_id, entropy, dark, luminance, edge FROM e JOIN (SELECT vec_id, floor(avg(e) * 36 + 0.5)::BIGINT AS edge FROM k GROUP BY vec_id) USING (vec_id)""")
def raster_evidence(spark, sf_dir):
    """The library's technical evidence of 8x8 rasters made from the vectors."""
    pixel = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5))).cast("int"))
    e = read(spark, sf_dir, "embeddings").select("vec_id", pixel.alias("a")).withColumn("e", images.raster_evidence("a", 8, 8))
    whole = lambda c, k: F.floor(F.col(f"e.{c}") * k + 0.5).cast("bigint")
    return e.select("vec_id", F.floor(F.col("e.entropy_bits") * 1e3 + 0.05).cast("bigint").alias("entropy"), whole("dark_clip_ratio", 1e6).alias("dark"), whole("luminance_mean", 1e2).alias("luminance"), whole("edge_mean", 36).alias("edge"))


@query("""WITH t AS (SELECT l_orderkey, list('tag' || l_linenumber ORDER BY l_linenumber, l_partkey) AS names, list((l_partkey % 100) / 100.0::DOUBLE ORDER BY l_linenumber, l_partkey) AS scores FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(names) AS n, names[1] AS first, floor(list_sum(scores) * 1e6 + 0.5)::BIGINT AS sum_ppm FROM t""")
def tag_scores(spark, sf_dir):
    """A tagger's names with its probabilities, by position."""
    x = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_partkey") % 100 / 100.0).cast("double").alias("p")))).alias("rows"))
    z = x.select("l_orderkey", detect.zipped(F.transform("rows", lambda r: F.concat(F.lit("tag"), r["l_linenumber"].cast("string"))), F.transform("rows", lambda r: r["p"])).alias("z"))
    return z.select("l_orderkey", F.size("z").cast("bigint").alias("n"), F.col("z")[0]["name"].alias("first"), ppm(F.aggregate("z", F.lit(0.0), lambda s, t: s + t["score"])).alias("sum_ppm"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at FROM events")
def utc_texts(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", paths.utc_text("ts").alias("at"))


@query("""WITH e AS (SELECT event_id, ['CUDA error: out of memory', 'CUDAExecutionProvider failed', 'the cuda Provider is gone', 'cuda_error_out_of_memory', 'a file is missing'][event_id % 5 + 1] AS m FROM events)
SELECT event_id, CASE WHEN contains(lower(m), 'out of memory') OR contains(lower(m), 'out_of_memory') THEN 'OOM' WHEN lower(m) LIKE '%cuda%provider%' THEN 'CUDA_PROVIDER_LOST' END AS kind FROM e""")
def error_kinds(spark, sf_dir):
    m = _pick(("CUDA error: out of memory", "CUDAExecutionProvider failed", "the cuda Provider is gone", "cuda_error_out_of_memory", "a file is missing"), F.col("event_id"))
    return read(spark, sf_dir, "events").select("event_id", runs.error_kind(m).alias("kind"))


@query(f"WITH {_FOUND} SELECT asset_id, source_path FROM f WHERE asset_id IN (SELECT asset_id FROM f JOIN labels USING (doc_id) WHERE toxic = 1)")
def asset_paths(spark, sf_dir):
    """All paths of the assets that a toxic label names."""
    occ = found(spark, sf_dir)
    bad = occ.join(read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return runs.occurrences_of(occ, bad).select("asset_id", "source_path")


def move_journal(spark, sf_dir) -> DataFrame:
    """Orders as moves, their line items as events of them."""
    x = read(spark, sf_dir, "lineitem")
    return x.select(F.concat(F.lit("/library/"), F.col("l_orderkey").cast("string")).alias("source_path"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("bigint").alias("event_seq"), _pick(moves.STATES, F.col("l_partkey") + F.col("l_linenumber")).alias("state"))


_JOURNAL = f"""j AS (SELECT '/library/' || l_orderkey AS source_path, l_linenumber * 1000000 + l_partkey AS event_seq, {list(moves.STATES)!r}[(l_partkey + l_linenumber) % 6 + 1] AS state FROM lineitem),
c AS (SELECT source_path, arg_max(state, event_seq) AS state FROM j GROUP BY source_path)"""


@query(f"WITH {_JOURNAL} SELECT state, count(*) AS n FROM c GROUP BY state")
def move_states(spark, sf_dir):
    return moves.state_counts(move_journal(spark, sf_dir))


@query(f"WITH {_JOURNAL} SELECT source_path, state FROM c WHERE state IN ('PLANNED', 'FAILED') ORDER BY source_path LIMIT 100")
def open_moves(spark, sf_dir):
    """The next 100 moves to execute."""
    return moves.open_moves(move_journal(spark, sf_dir), 100).select("source_path", "state")


@query(f"""{_OPEN}, {_pairs_sql(GRID_S, GRID_M)}, {_OUTCOMES}, {_METRICS}, pick AS (SELECT min_similarity, min_margin FROM r WHERE accepted >= {GATES.accepted} AND unknown_total >= {GATES.unknown} AND accepted_accuracy >= {GATES.accuracy} AND unknown_false_accept_rate <= {GATES.false_accept}
ORDER BY coverage DESC, accepted_accuracy DESC, unknown_false_accept_rate, min_similarity DESC, min_margin DESC LIMIT 1)
SELECT id AS asset_id, CASE WHEN score >= min_similarity AND margin >= min_margin THEN 'ACCEPTED' ELSE 'UNKNOWN' END AS decision_state, '待复核' AS proposed_bucket, CASE WHEN score >= min_similarity AND margin >= min_margin THEN nearest END AS identity,
floor(greatest(0.0, least(1.0, score)) * 1e6 + 0.5)::BIGINT AS confidence_ppm, CASE WHEN score >= min_similarity AND margin >= min_margin THEN 'status_policy_not_calibrated' ELSE 'identity_unknown' END AS reasons FROM best, pick""")
def decided(spark, sf_dir):
    """Decisions by the thresholds that the calibration recommends; none where it recommends none."""
    v = labelled(spark, sf_dir)
    rows = openset_rows(v)
    return rows.select("asset_id", "decision_state", "proposed_bucket", "identity", ppm(F.col("confidence")).alias("confidence_ppm"), F.array_join("reasons", ",").alias("reasons"))


def openset_rows(v: DataFrame) -> DataFrame:
    report, rows = reprocess.decide(v.withColumnRenamed("id", "asset_id"), v, known(v), GRID_S, GRID_M, CONFIG.top_k, GATES)
    if rows is None:
        empty = "asset_id bigint, decision_state string, proposed_bucket string, identity bigint, confidence double, reasons array<string>"
        return v.sparkSession.createDataFrame([], empty)
    return rows


@query("""WITH r AS (SELECT doc_id, source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.PNG' END AS source FROM documents) SELECT source AS source_path, 'draft' AS old_bucket FROM r""")
def baseline_sidecars(spark, sf_dir):
    """A baseline as moves read it: rows of all kinds."""
    d = read(spark, sf_dir, "documents")
    side = F.col("doc_id") % 3 == 0
    raw = d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(side, ".txt").otherwise(".PNG")).alias("Path"), F.when(side, "sidecar").otherwise("Image").alias("Asset_Kind"), F.lit("draft").alias("Status"))
    return baseline.normalised(raw, images_only=False).select("source_path", "old_bucket")
