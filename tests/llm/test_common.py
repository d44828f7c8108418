"""Memory of Python workers: bounded batches, and what tasks give back."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stacklight.llm import bpe, chosen_path, chunk_dedup, toxicity
from stacklight.llm.common import BATCH_BYTES, BATCH_SETTING, mapped, released, whole_groups

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])


def test_batches_to_workers_are_bounded(spark):
    spark.conf.unset(BATCH_SETTING)
    rows = spark.range(0, 6000, 1, 1).select("id", F.repeat(F.lit("x"), 4000).alias("text"))
    got = mapped(rows, sizes, "size bigint, n bigint").collect()
    assert sum(r["n"] for r in got) == 6000 and max(r["size"] for r in got) < 2 * BATCH_BYTES
    long = spark.range(0, 3, 1, 1).select("id", F.repeat(F.lit("x"), 3 * BATCH_BYTES).alias("text"))
    assert [r["n"] for r in mapped(long, sizes, "size bigint, n bigint").collect()] == [1, 1, 1]
    spark.conf.set(BATCH_SETTING, str(64 << 20))  # a setting of the user's stays
    assert max(r["n"] for r in mapped(rows, sizes, "size bigint, n bigint").collect()) > 5000
    spark.conf.unset(BATCH_SETTING)


@pytest.mark.parametrize("operator", [lambda d: bpe.round_trip(d, PATH, PATTERN), chunk_dedup.exact_duplicates, chosen_path.join, lambda d: toxicity.scores(d, toxicity._begun(toxicity.Settings(table_bits=8), np.full(256, 9), np.full(256, 3), 20, 6)[0])])
def test_operators_of_the_pipeline_send_such_batches(spark, operator):
    spark.conf.unset(BATCH_SETTING)
    docs = spark.createDataFrame([(1, "one two three four five six", "en"), (2, None, None)], "doc_id bigint, text string, lang string")
    assert operator(docs).count() == 2 and spark.conf.get(BATCH_SETTING, None) == str(BATCH_BYTES)
    spark.conf.unset(BATCH_SETTING)


def test_other_operators_tasks_empty_the_codec():
    one = bpe.codec(PATH, PATTERN)
    assert list(released(iter, caches=False)([1, 2])) == [1, 2] and bpe.codec(PATH, PATTERN) is one
    assert list(released(iter)([1, 2])) == [1, 2] and bpe.codec.cache_info().currsize == 0


@pytest.mark.parametrize("step", [1, 3, 7, 100])
def test_groups_stay_whole_over_small_batches(step):
    rng = np.random.default_rng(step)
    keys = np.sort(rng.choice([0, 1, 5, 6, 9, 11], 80, p=[0.1, 0.5, 0.05, 0.2, 0.1, 0.05]))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + step]), pa.array(np.arange(a, min(80, a + step)))], ["k", "v"]) for a in range(0, 80, step)]
    got = list(whole_groups(batches, 1))
    assert np.concatenate([t.column("v").to_numpy() for t in got]).tolist() == list(range(80))
    seen = [set(t.column("k").to_pylist()) for t in got]
    assert sum(map(len, seen)) == len(set(keys.tolist()))
