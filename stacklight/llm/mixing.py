"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens are summed into cells, one for each combination of margins (source, language,
topic). Raking scales the cells' weights to each margin's target shares in turn, for a block of
``ROUNDS`` rounds, or with a tolerance for further blocks until no margin's sum is off its
target by more than that share of all tokens, ``MOST_BLOCKS`` at most. What is left comes back as
``residual``: targets that no weights can meet together, as over empty cells, leave one. A document of cell c is then kept with probability min(1, scale * weight(c) /
tokens(c)); the scale is chosen so that the expected tokens are ``rate`` times all tokens,
which takes a few rounds because cells that reach probability 1 can't give more. A document
is kept when the number that md5 makes of its id is below its probability, so a choice
depends on nothing else and repeats.

Default targets flatten a margin: each value's share goes with its token share to the power
``flatten``; 1 leaves it alone and 0 makes all values equal. The cells are one partial
aggregation; the rounds work on the cells alone. Probabilities come back to the documents
by a broadcast only when a count shows that there are few cells; otherwise by a shuffled
join that adaptive execution may split. While a count shows few cells, a block of rounds is one
stage of windows over a single partition of them; beyond, sums are aggregated and joined.

Defined results: a null margin value is the value "(none)"; null and blank texts have 0
tokens; a cell without tokens has probability min(1, rate); repeated rows are chosen alike; a target for a
value that no document has is left out and the rest are rescaled; where targets are given, a value
without one has share 0, so its documents go; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.llm.common import kept

#: Up to so many cells (about 100 bytes each) are broadcast.
BROADCAST_CELLS = 50_000
#: Up to so many cells a margin's sums are windows, which one task may see whole; beyond, they are aggregated before a shuffle and joined.
WINDOW_CELLS = 100_000
#: Rounds in a block, and the most blocks.
ROUNDS, MOST_BLOCKS = 8, 12
SCALE_ROUNDS, NONE = 6, "(none)"
MARGINS: Mapping[str, float] = {"source": 0.8, "lang": 0.9, "topic": 0.9}
RATE = 0.7


def topic_of(text: str | Column = "text") -> Column:
    """A topic by the signs that a text carries. Fixed rules, first match first."""
    t = F.col(text) if isinstance(text, str) else text
    return (
        F.when(t.contains(" | "), "tables").when(t.contains("icense"), "licensed").when(t.contains("@"), "contacts").otherwise("prose")
    )


def tokens_of(text: str | Column = "text") -> Column:
    """Words between blanks, tabs and line ends."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("bigint")


def draw(doc_id: str | Column = "doc_id", salt: str = "mix") -> Column:
    """A number in [0, 1) that md5 makes of an id."""
    key = F.concat(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")), F.lit(f":{salt}"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def default_targets(cells: DataFrame, margin: str, flatten: float) -> DataFrame:
    """margin, share (not normalised): token share to the power `flatten`."""
    return cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(flatten)).alias("share"))


def _rounds(out: DataFrame, margins: list[str], rounds: int, few: bool) -> DataFrame:
    """A block of rounds over cells with weight and a goal for each margin."""
    out = out.coalesce(1) if few else out
    for _ in range(rounds):
        for m in margins:
            if few:
                out = out.withColumn("__sum", F.sum("weight").over(Window.partitionBy(m)))
            else:
                out = out.join(out.groupBy(m).agg(F.sum("weight").alias("__sum")), m)
            factor = F.when(F.col("__sum") > 0, F.coalesce(f"__goal_{m}", F.lit(0.0)) / F.col("__sum")).otherwise(0.0)
            out = out.withColumn("weight", F.col("weight") * factor).drop("__sum")
        out = out if few else kept(out)  # cuts the lineage of the rounds before
    return kept(out) if few else out


def largest_residual(raked: DataFrame, margins: list[str]) -> float:
    """The most that a margin's sum is off its goal, as a share of all weights."""
    worst = 0.0
    for m in margins:
        sums = raked.groupBy(m).agg(F.sum("weight").alias("s"), F.first(f"__goal_{m}").alias("g"))
        row = sums.agg(F.max(F.abs(F.col("s") - F.coalesce("g", F.lit(0.0)))).alias("off"), F.sum("s").alias("whole")).first()
        worst = max(worst, float(row["off"] or 0) / (float(row["whole"] or 0) or 1.0))
    return worst


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS, tolerance: float | None = None) -> tuple[DataFrame, float]:
    """(cells with `weight`: tokens scaled until every margin's sums go with its targets while the total stays, largest residual)."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m, t in targets.items():
        t = t.join(cells.select(m).distinct(), m, "left_semi").select(m, "share")
        whole = float(t.agg(F.sum("share")).first()[0] or 0) or 1.0
        out = out.join(t.select(m, (F.col("share") / whole * total).alias(f"__goal_{m}")), m, "left")
    out, margins = kept(out), list(targets)
    few = cells.limit(WINDOW_CELLS + 1).count() <= WINDOW_CELLS
    for _ in range(1 if tolerance is None else MOST_BLOCKS):
        out = _rounds(out, margins, rounds, few)
        residual = largest_residual(out, margins)
        if tolerance is not None and residual <= tolerance:
            break
    return out.drop(*(f"__goal_{m}" for m in margins)), residual


def probabilities(raked: DataFrame, rate: float = RATE) -> DataFrame:
    """raked with `probability`; the scale is found by a few one-row aggregations."""
    gain = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    scale, total = rate, float(raked.agg(F.sum("tokens")).first()[0] or 0)
    for _ in range(SCALE_ROUNDS):
        full = gain * F.lit(scale) >= 1
        row = raked.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        rest = float(row["rest"] or 0)
        if rest <= 0:
            break
        scale = max(0.0, rate * total - float(row["full"] or 0)) / rest
    return raked.withColumn("probability", F.coalesce(F.least(F.lit(1.0), gain * F.lit(scale)), F.lit(min(1.0, rate))))


def _planned(docs: DataFrame, topic: Column | None, tokens: Column | None, margins: Mapping[str, float], targets: Mapping[str, DataFrame] | None, rate: float, tolerance: float | None) -> DataFrame:
    """docs with __cell_<margin>, __tokens, __probability and __residual."""
    topic = topic_of() if topic is None else topic
    tokens = tokens_of() if tokens is None else tokens
    cell = {m: F.coalesce((topic if m == "topic" else F.col(m)).cast("string"), F.lit(NONE)) for m in margins}
    cells = kept(docs.select(*(c.alias(m) for m, c in cell.items()), tokens.alias("n")).groupBy(*margins).agg(F.sum("n").alias("tokens")))
    goals = {m: default_targets(cells, m, p) for m, p in margins.items()} | dict(targets or {})
    raked, residual = rake(cells, goals, tolerance=tolerance)
    plan = kept(probabilities(raked, rate))
    names = {m: f"__cell_{m}" for m in margins}
    right = plan.select(*(F.col(m).alias(names[m]) for m in margins), F.col("probability").alias("__probability"))
    if right.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        right = F.broadcast(right)
    own = docs.select("*", *(c.alias(names[m]) for m, c in cell.items()), tokens.alias("__tokens"))
    return own.join(right, list(names.values())).withColumn("__residual", F.lit(residual))


def sampled(docs: DataFrame, topic: Column | None = None, tokens: Column | None = None, id_col: str = "doc_id", margins: Mapping[str, float] = MARGINS, targets: Mapping[str, DataFrame] | None = None, rate: float = RATE, tolerance: float | None = None) -> DataFrame:
    """docs with n_tokens, topic, probability, selected and residual (of all margins) added (or replaced); every row of docs."""
    both = _planned(docs, topic, tokens, margins, targets, rate, tolerance)
    chosen = draw(id_col) < F.col("__probability")
    extra = {"topic": F.col("__cell_topic")} if "topic" in margins else {}
    both = both.withColumns(extra | {"n_tokens": F.col("__tokens"), "probability": F.col("__probability"), "selected": chosen, "residual": F.col("__residual")})
    return both.drop(*(f"__cell_{m}" for m in margins), "__tokens", "__probability", "__residual")


def drawn(docs: DataFrame, topic: Column | None = None, tokens: Column | None = None, id_col: str = "doc_id", margins: Mapping[str, float] = MARGINS, targets: Mapping[str, DataFrame] | None = None, rate: float = RATE, tolerance: float | None = None) -> DataFrame:
    """The selected rows of docs, with docs' own columns."""
    return _planned(docs, topic, tokens, margins, targets, rate, tolerance).where(draw(id_col) < F.col("__probability")).select(docs.columns)


def oracle_sql(margins: Mapping[str, float] = MARGINS, rate: float = RATE) -> str:
    """The same computation for DuckDB: every round is a common table expression."""
    keys = ", ".join(margins)
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
            coalesce(CASE WHEN contains(text, ' | ') THEN 'tables' WHEN contains(text, 'icense') THEN 'licensed'
                 WHEN contains(text, '@') THEN 'contacts' ELSE 'prose' END, '{NONE}') AS topic,
            coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0)::BIGINT AS n_tokens FROM documents)""",
        f"w AS (SELECT {keys}, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE AS weight FROM d GROUP BY ALL)",
    ]
    for m, p in margins.items():
        steps.append(f"t_{m} AS (SELECT {m}, pow(sum(tokens)::DOUBLE, {p}) AS share FROM w GROUP BY {m})")
        steps.append(f"g_{m} AS (SELECT {m}, share / (SELECT sum(share) FROM t_{m}) * (SELECT sum(tokens)::DOUBLE FROM w) AS goal FROM t_{m})")
    at = "w"
    for r in range(ROUNDS):
        for m in margins:
            name = f"w{r}_{m}"
            steps.append(f"{name} AS MATERIALIZED (SELECT {', '.join(f'a.{k}' for k in margins)}, a.tokens, a.weight * (goal / sum(a.weight) OVER (PARTITION BY a.{m})) AS weight FROM {at} a JOIN g_{m} g ON g.{m} = a.{m})")
            at = name
    off = " UNION ALL ".join(f"SELECT max(abs(s - goal)) AS off FROM (SELECT {m}, sum(weight) AS s FROM {at} GROUP BY {m}) JOIN g_{m} USING ({m})" for m in margins)
    steps.append(f"r AS MATERIALIZED (SELECT max(off) / (SELECT sum(weight) FROM {at}) AS residual FROM ({off}))")
    scale = f"SELECT {rate}::DOUBLE AS s"
    for r in range(SCALE_ROUNDS):
        steps.append(f"s{r} AS MATERIALIZED ({scale})")
        full = f"weight / tokens * (SELECT s FROM s{r}) >= 1"
        scale = f"SELECT greatest(0, {rate} * sum(tokens) - coalesce(sum(tokens) FILTER (WHERE {full}), 0)) / sum(weight) FILTER (WHERE NOT ({full})) AS s FROM {at}"
    steps.append(f"s AS MATERIALIZED ({scale})")
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
        SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens,
               floor(coalesce(least(1.0, weight / tokens * (SELECT s FROM s)), {rate}) * 1e6 + 0.5)::BIGINT AS probability_ppm,
               CAST('0x' || substr(md5(d.doc_id::VARCHAR || ':mix'), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0
                   < coalesce(least(1.0, weight / tokens * (SELECT s FROM s)), {rate}) AS selected,
               floor((SELECT residual FROM r) * 1e6 + 0.5)::BIGINT AS residual_ppm
        FROM d JOIN {at} c ON {' AND '.join(f'c.{m} = d.{m}' for m in margins)}"""
    )
