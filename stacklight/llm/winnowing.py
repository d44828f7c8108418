"""Benchmark decontamination by winnowing, in DataFrame operations only.

A window is ``span`` words in a row of an item; an item of fewer words, but not none, is one
window. Texts on both sides are winnowed: of each window's k-gram hashes the smallest is its
fingerprint. Equal windows have equal fingerprints, so the fingerprints of a document that no
item has go, and no shared window is lost. One that stays is extended to the windows around it,
which are compared, as words, with the distinct windows of the items; what they cover are the
hit words.

Documents are read once and never shuffled: they are cut into segments of 64 windows, and a
fingerprint carries its segment's words, so work and memory go with a text's length. The items'
fingerprints and windows are distinct and broadcast only when a count shows that they are few;
beyond, both sides are shuffled. Neither join makes more rows than documents have windows.
Documents with the same windows share one list of items, so a passage that many documents and
many items have isn't multiplied out.

Defined results: words are runs of characters other than ASCII signs, in lower case as to
A-Z; null and empty texts have none; rows that repeat an id are documents of their own, so are those
without one; items without an id hit words and are named by none; items that repeat an id are
one; other columns are ignored; without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.llm.common import BROADCAST_ROWS, kept

#: Words of a window; windows of a segment, in which documents are winnowed.
SPAN, SEGMENT = 10, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that part words, once A-Z are in lower case.
_SIGNS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def gram_and_window(span: int) -> tuple[int, int]:
    """(words of a k-gram, k-grams of a window) for windows of `span` words: their sum is span + 1."""
    gram = max(min(span, 3), (span + 2) // 3)
    return gram, span - gram + 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a lambda's variable isn't inlined again."""
    return F.transform(F.array(value), body)[0]


def words_of(text: str | Column) -> Column:
    """The words of a text, in lower case."""
    own = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    parted = F.translate(own, _UPPER + _SIGNS, _LOWER + " " * len(_SIGNS))
    return F.filter(F.split(parted, " "), lambda w: w != "")


def _sliding(values: Column, size: int, both: Callable[[Column, Column], Column], then: Callable[[Column], Column]) -> Column:
    """`then` of `both` over each element and the size - 1 after it, by doubling; the last size - 1 are of no use."""

    def grown(now: Column, have: int) -> Column:
        if have == size:
            return then(now)
        step = min(have, size - have)
        return _let(F.zip_with(now, F.slice(now, step + 1, F.size(now)), both), lambda more: grown(more, have + step))

    return grown(values, 1)


def prints_of(words: Column, span: int) -> Column:
    """The fingerprint of each window of a segment: the smallest hash of its k-grams."""
    gram, window = gram_and_window(span)
    own = lambda m: F.slice(m, 1, F.greatest(F.least(F.size(m) - (span - 1), F.lit(SEGMENT)), F.lit(0)))
    least = lambda grams: _sliding(grams, window, lambda a, b: F.least(a, b), own)
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _sliding(h, gram, lambda a, b: F.xxhash64(a, b), least))


def segments(words: Column, span: int) -> Column:
    """(start, words) of each stretch of SEGMENT windows of at most `span` words; a text's last windows lie in the last one."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(SEGMENT))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(words, s + 1, SEGMENT + span - 1).alias("words")))


def _entries(spans: Iterable[int]) -> Column:
    """(span, print) of the distinct fingerprints of a segment."""
    of = lambda n: F.transform(F.array_distinct(prints_of(F.col("words"), n)), lambda p: F.struct(F.lit(n).alias("span"), p.alias("print")))
    return F.concat(*map(of, spans))


def _windows(spans: Iterable[int]) -> Column:
    """(at, window: its words joined by blanks) of all windows of a segment that have the row's fingerprint."""
    window = lambda i: F.array_join(F.slice("words", i + 1, F.col("span")), " ")
    prints = F.coalesce(*(F.when(F.col("span") == n, prints_of(F.col("words"), n)) for n in spans))
    return F.array_compact(F.transform(prints, lambda p, i: F.when(p == F.col("print"), F.struct((F.col("start") + i).alias("at"), window(i).alias("window")))))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """span, print, window, item: every window of every item."""
    own = items.select(F.col(id_col).cast("string").alias("item"), words_of(text_col).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    parts = own.select("item", F.least("n", F.lit(span)).alias("span"), F.explode(segments(F.col("words"), span)).alias("part")).select("item", "span", "part.*")
    prints = F.coalesce(*(F.when(F.col("span") == n, prints_of(F.col("words"), n)) for n in range(1, span + 1)))
    cut = parts.select("item", "span", "start", "words", F.explode(F.array_distinct(prints)).alias("print"))
    return cut.select("item", "span", "print", F.explode(_windows(range(1, span + 1))).alias("hit")).select("span", "print", "hit.window", "item")


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast when a count shows that it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN) -> DataFrame:
    """id_col, n_words, n_hit, spans (start, end of maximal hit runs, in words), items (sorted ids with occurring windows); a row for each document."""
    windows = kept(item_windows(items, item_id, item_text, span))
    distinct = kept(windows.select("span", "print", "window").distinct().withColumn("number", F.monotonically_increasing_id()))
    prints = distinct.select("span", "print").distinct().withColumn("known", F.lit(True))
    spans = [r[0] for r in distinct.select("span").distinct().collect()]  # at most `span` numbers
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(text_col).alias("words"))
    # The first part stands for the document itself; its start is the number of words.
    itself = lambda w: F.array(F.struct(F.size(w).alias("start"), F.lit(None).cast("array<string>").alias("words")))
    parts = own.select("row", "id", F.explode(_let(F.col("words"), lambda w: F.concat(itself(w), segments(w, span)))).alias("part")).select("row", "id", "part.*")
    none = F.array(F.struct(F.lit(0).alias("span"), F.lit(None).cast("bigint").alias("print")))
    entries = F.when(F.col("words").isNull(), none).otherwise(_entries(spans) if spans else F.slice(none, 1, 0))
    cut = parts.select("row", "id", "start", "words", F.explode(entries).alias("entry")).select("row", "id", "start", "words", "entry.*")
    scanned = kept(cut.join(_small(prints), ["span", "print"], "left").where("span = 0 or known").drop("known"))
    hits = scanned.where("span > 0").select("row", "span", F.explode(_windows(spans or [span])).alias("hit")).select("row", "hit.at", (F.col("hit.at") + F.col("span")).alias("end"), "hit.window")
    hits = hits.join(_small(distinct.select("window", "number")), "window").drop("window")
    by_place = Window.partitionBy("row").orderBy("at", "end")
    before = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("head", F.when(F.col("at") > before, 1).otherwise(0)).withColumn("part", F.sum("head").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = hits.groupBy("row", "part").agg(F.min("at").alias("start"), F.max("end").alias("end"), F.collect_set("number").alias("numbers"))
    pieces = pieces.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("numbers"))
    found = kept(pieces.withColumn("which", F.sha2(F.array_join(F.transform("numbers", lambda n: n.cast("string")), ","), 256)))
    named = found.groupBy("which").agg(F.any_value("numbers").alias("numbers")).select("which", F.explode("numbers").alias("number"))
    known = windows.join(distinct.select("window", "number"), "window").select("number", "item").distinct()
    named = named.join(known, "number").groupBy("which").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = found.join(named, "which", "left").select("row", "n_hit", "spans", "items")
    out = scanned.where("span = 0").select("row", F.col("id").alias(id_col), F.col("start").cast("bigint").alias("n_words")).join(found, "row", "left")
    none = F.array()
    return out.select(id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("spans", none.cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce("items", none.cast("array<string>")).alias("items"))


def oracle_sql(span: int = SPAN) -> str:
    """The contract's digest for DuckDB, by a join of all windows of both sides."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
        i AS MATERIALIZED (SELECT item_id::VARCHAR AS item, words, least({span}, len(words)) AS span FROM (SELECT item_id, {words} AS words FROM benchmark) WHERE len(words) > 0),
        w AS MATERIALIZED (SELECT DISTINCT item, span, array_to_string(words[s + 1:s + span], ' ') AS win FROM (SELECT item, span, words, unnest(range(0, len(words) - span + 1)) AS s FROM i)),
        k AS MATERIALIZED (SELECT DISTINCT span, win FROM w),
        dw AS (SELECT r, span, s, array_to_string(words[s + 1:s + span], ' ') AS win
               FROM (SELECT r, span, words, unnest(range(0, len(words) - span + 1)) AS s FROM d, (SELECT DISTINCT span FROM k) WHERE len(words) >= span)),
        h AS MATERIALIZED (SELECT r, span, s, win FROM dw JOIN k USING (span, win)),
        n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + span)) AS p FROM h) GROUP BY r),
        t AS (SELECT r, count(item) AS n_items, coalesce(string_agg(item, ',' ORDER BY item), '') AS items FROM (SELECT DISTINCT r, item FROM h JOIN w USING (span, win)) GROUP BY r)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)"""


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **kwargs) -> DataFrame:
    """docs without documents that hold any window of an item; rows without an id stay."""
    hit = kept(contamination(docs, items, id_col, **kwargs).where(F.col("n_hit") > 0).where(F.col(id_col).isNotNull()).select(id_col).distinct())
    return docs.join(_small(hit), id_col, "left_anti").select(docs.columns)
