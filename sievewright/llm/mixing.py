"""Sampling documents so that source, language and topic meet target token weights (iterative proportional fitting)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import Columns, small_side, write_table

#: Target weight of a value of each dimension: its share of the tokens to this power (1 keeps the corpus as it is).
ALPHAS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Share of all tokens that the sample has, in expectation.
TOKENS_KEPT = 0.7
#: Fitting ends when no margin is off its target by more than this share; targets that contradict each other end it, too.
TOLERANCE, ROUNDS = 1e-10, 500
SEED = "mix-1"
#: Contingency cells that are raked in the driver's memory; a larger table of them takes the same rounds as joins.
DRIVER_CELLS = 1_000_000
#: Topics of documents that have no column of them: the first pattern that occurs (SQL LIKE); everything else is prose.
TOPICS = (("legal", "%license%"), ("table", "% | %"), ("contact", "%@%"), ("data", "%://%"))


def topic_of(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(low.like(pattern), F.lit(name)).otherwise(out)
    return out


def rake(cells: list[tuple], targets: list[dict], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of the cells (a key for each dimension, then tokens) that fit the targets."""
    weights = np.array([c[-1] for c in cells], dtype=float)
    codes, goals = [], []
    for d, goal in enumerate(targets):
        keys = list(goal)
        place = {k: i for i, k in enumerate(keys)}
        codes.append(np.array([place[c[d]] for c in cells], dtype=np.int64))
        goals.append(np.array([goal[k] for k in keys], dtype=float))
    for _ in range(rounds):
        off = 0.0
        for code, goal in zip(codes, goals, strict=True):
            now = np.bincount(code, weights, len(goal))
            off = max(off, float(np.abs(now - goal).max(initial=0) / max(goal.max(initial=0), 1e-300)))
            weights = weights * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[code]
        if off <= tolerance:
            break
    return weights


def _scale(budget: float, sums) -> float:
    """The factor at which the sum of min(tokens, factor x weight) is budget; sums(factor) gives the tokens of the cells
    that are full at it and the weight of the others. Only ever more cells are full, so it ends."""
    factor, was = 0.0, -1.0
    while factor > was:
        full, rest = sums(factor)
        if rest <= 0:
            return float("inf")
        was, factor = factor, max(factor, (budget - full) / rest)
    return factor


def _targets(cells: DataFrame, dims: list[str], alphas: dict[str, float], explicit: dict) -> dict[str, DataFrame]:
    """For each dimension (value, goal), goals adding up to 1."""
    out = {}
    for d in dims:
        own = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")
        if explicit.get(d):
            raw = F.lit(0.0)
            for value, weight in explicit[d].items():
                raw = F.when(F.col(d).eqNullSafe(F.lit(value)), F.lit(float(weight))).otherwise(raw)
        else:
            raw = F.pow(F.col("tokens"), F.lit(float(alphas[d])))
        raws = own.select(d, raw.alias("raw"))
        total = raws.agg(F.sum("raw").alias("raw_total"))
        out[d] = raws.crossJoin(F.broadcast(total)).select(d, F.expr("case when raw_total > 0 then raw / raw_total else 0D end").alias("goal"))
    return out


def _rake_joined(cells: DataFrame, targets: dict[str, DataFrame], rounds: int) -> DataFrame:
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for d, goals in targets.items():
            sums = now.groupBy(d).agg(F.sum("weight").alias("now"))
            factor = sums.join(goals, sums[d].eqNullSafe(goals[d])).select(sums[d].alias("key"), F.expr("case when now > 0 then goal / now else 0D end").alias("factor"))
            now = now.join(factor, now[d].eqNullSafe(factor["key"]), "left").select(*cells.columns, (F.col("weight") * F.coalesce("factor", F.lit(0.0))).alias("weight"))
        now = write_table(now, "raked")
        off = [now.groupBy(d).agg(F.sum("weight").alias("now")).alias("n").join(goals.alias("g"), F.col(f"n.{d}").eqNullSafe(F.col(f"g.{d}"))).agg(F.max(F.abs(F.col("now") - F.col("goal"))) / F.max("goal")).first()[0] for d, goals in targets.items()]
        if all(x is None or x <= TOLERANCE for x in off):
            break
    return now


def mixing_probabilities(docs: DataFrame, alphas: dict[str, float] | None = None, targets: dict[str, dict] | None = None, rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS,
                         tokens_kept: float = TOKENS_KEPT, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None):
    """(rows, cells): the inner rows with their dimensions and tokens, and a sampling probability for each cell.

    The cells are those of source x language x topic, counted over all documents. Fitting starts at their token
    counts and alternates between the three margins. The fitted weights are scaled to a budget of tokens, tokens_kept
    of all: a cell that has fewer than its share is taken whole, and the others share what is left by their weights, so
    a rare value can't hold back the rest. topic_col: a column of topics; without one they are topic_of() the text.
    """
    dims = ["source", "lang", "topic"]
    t = Columns(docs)
    text = F.coalesce(t(text_col), F.lit(""))
    topic = t(topic_col).cast("string") if topic_col else topic_of(text)
    rows = t.df.withColumns({"__source": t(source_col).cast("string"), "__lang": t(lang_col).cast("string"), "__topic": topic, "__tokens": F.regexp_count(text, F.lit(r"\S+")).cast("long")})
    cells = write_table(rows.groupBy(*[F.col(f"__{d}").alias(d) for d in dims]).agg(F.sum("__tokens").alias("tokens")), "mix-cells")
    goals = _targets(cells, dims, alphas or ALPHAS, targets or {})
    some = cells.where("tokens > 0")
    spark = docs.sparkSession
    budget = tokens_kept * (cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0)
    if cells.count() <= driver_cells:
        own = [tuple(r) for r in some.collect()]
        goal = [{r[0]: r[1] for r in goals[d].collect()} for d in dims]
        weights, tokens = rake(own, goal, rounds) if own else np.zeros(0), np.array([c[-1] for c in own], dtype=float)

        def sums(factor: float) -> tuple[float, float]:
            full = factor * weights >= tokens
            return float(tokens[full & (weights > 0)].sum()), float(weights[~full].sum())

        fitted = spark.createDataFrame([(*c, float(w)) for c, w in zip(own, weights, strict=True)], "source string, lang string, topic string, tokens bigint, weight double")
    else:
        fitted = write_table(_rake_joined(some, goals, rounds), "mix-fitted")

        def sums(factor: float) -> tuple[float, float]:
            full = F.lit(factor) * F.col("weight") >= F.col("tokens")
            r = fitted.agg(F.sum(F.when(full & (F.col("weight") > 0), F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
            return float(r["full"] or 0), float(r["rest"] or 0)

    factor = min(_scale(budget, sums), 1e300)
    return t, rows, fitted.select(*dims, F.least(F.lit(1.0), F.lit(factor) * F.col("weight") / F.col("tokens")).alias("prob"))


def _sampled(docs: DataFrame, seed: str, id_col: str, text_col: str, kw: dict):
    t, rows, prob = mixing_probabilities(docs, text_col=text_col, **kw)
    prob = small_side(prob, F.lit(50) + sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("source", "lang", "topic")), F.lit(0)))
    joined = rows.join(prob, F.col("__source").eqNullSafe(prob["source"]) & F.col("__lang").eqNullSafe(prob["lang"]) & F.col("__topic").eqNullSafe(prob["topic"]), "left")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(t(id_col).cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return t, joined.withColumn("__draw", draw).where((F.col("__tokens") > 0) & (F.col("__draw") < F.coalesce("prob", F.lit(0.0))))


def sample_mixture(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that are drawn, with the columns of docs.

    A draw depends on the seed and the id alone: it is the same on every attempt and any partitioning, and rows that
    repeat an id in one cell are drawn or left together. A null source or language is a value of its own, with its
    own target. Documents without a token (null or empty text) weigh nothing and are never drawn. Rows with a null id
    share one draw. Very long texts count by their tokens like any other. An empty table stays empty. Other columns
    only travel along, whatever their names.
    """
    t, drawn = _sampled(docs, seed, id_col, text_col, kw)
    return t.restore(drawn)


def mixture_sample_ids(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents drawn by sample_mixture(): id, source, lang, topic, tokens and the probability of the draw."""
    t, drawn = _sampled(docs, seed, id_col, text_col, kw)
    return drawn.select(t(id_col).alias(id_col), F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), F.round("prob", 6).alias("prob"))


def _mixing_sql() -> str:
    topic = "case " + " ".join(f"when lower(coalesce(text, '')) like '{p}' then '{n}'" for n, p in TOPICS) + " else 'prose' end"
    parts = [f"rows_ as materialized (select doc_id, source, lang, {topic} topic, len(regexp_extract_all(coalesce(text, ''), '\\S+')) tokens from documents)",
             "cells as materialized (select source, lang, topic, cast(sum(tokens) as double) tokens from rows_ group by all having sum(tokens) > 0)"]
    for d, a in ALPHAS.items():
        parts.append(f"goal_{d} as materialized (select {d} k, pow(sum(tokens), {a}::double) / sum(pow(sum(tokens), {a}::double)) over () goal from cells group by {d})")
    at = "cells_0"
    parts.append("cells_0 as materialized (select *, tokens weight from cells)")
    n = 0
    for _ in range(40):  # far beyond convergence
        for d in ALPHAS:
            n += 1
            parts.append(f"cells_{n} as materialized (select source, lang, topic, tokens, weight * goal / sum(weight) over (partition by {d}) weight from {at} join goal_{d} on {d} is not distinct from k)")
            at = f"cells_{n}"
    parts += [f"""steps as materialized (select *, ({TOKENS_KEPT}::double * sum(tokens) over () - coalesce(sum(tokens) over (order by weight / tokens desc, source, lang, topic rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by weight / tokens desc, source, lang, topic rows between current row and unbounded following) s from {at})""",
              "probs as materialized (select source, lang, topic, least(1.0::double, coalesce((select max(s) from steps where s * weight / tokens <= 1), 1e300::double) * weight / tokens) prob from steps)"]
    return f"""with {', '.join(parts)}
select r.doc_id, r.source, r.lang, r.topic, cast(r.tokens as bigint) n_tokens, round(prob, 6) prob
from rows_ r join probs p on r.source is not distinct from p.source and r.lang is not distinct from p.lang and r.topic = p.topic
where tokens > 0 and cast(('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')), 1, 12)) as bigint) / 281474976710656.0::double < prob"""


MIXING_SQL = _mixing_sql()
