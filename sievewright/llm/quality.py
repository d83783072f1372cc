"""Quality rules as a short-circuit cascade, ordered by rejections per cost."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.llm.common import Columns, write_table

#: Rows on which costs and selectivities are estimated, about; verdicts don't depend on the order they give.
SAMPLE_ROWS = 2000
#: The sample is repeated until a rule takes this many seconds more than reading it does; the least of so many runs counts.
LEAST_SECONDS, RUNS = 0.1, 2


@dataclass(frozen=True)
class Rule:
    """reject: Spark SQL over the column `text` (never null); sql: the same for DuckDB."""

    name: str
    reject: str
    sql: str


_WORDS = "(1 + length(text) - length(replace(replace(text, ' ', ''), '{nl}', '')))"
_SPARK_WORDS, _DUCK_WORDS = _WORDS.replace("{nl}", "\\n"), _WORDS.replace("'{nl}'", "chr(10)")
RULES = (
    Rule("empty", "trim(text) = ''", "trim(text, ' ') = ''"),
    Rule("symbols", f"regexp_count(text, '[#%&*$~^]') > 0.3 * {_SPARK_WORDS}", f"len(regexp_extract_all(text, '[#%&*$~^]')) > 0.3 * {_DUCK_WORDS}"),
    Rule("exclamations", f"length(text) - length(replace(text, '!', '')) > 0.3 * {_SPARK_WORDS}", f"length(text) - length(replace(text, '!', '')) > 0.3 * {_DUCK_WORDS}"),
    Rule("capitals", f"regexp_count(text, '[A-Z]{{4,}}') > 0.5 * {_SPARK_WORDS}", f"len(regexp_extract_all(text, '[A-Z]{{4,}}')) > 0.5 * {_DUCK_WORDS}"),
    Rule("tables", f"length(text) - length(replace(text, '|', '')) > 0.1 * {_SPARK_WORDS}", f"length(text) - length(replace(text, '|', '')) > 0.1 * {_DUCK_WORDS}"),
    Rule("repeated_lines", "size(array_distinct(split(text, '\\n'))) < 0.5 * size(split(text, '\\n'))", "len(list_distinct(string_split(text, chr(10)))) < 0.5 * len(string_split(text, chr(10)))"),
    Rule("repeated_words", "size(filter(zip_with(split(text, ' '), slice(split(text, ' '), 2, greatest(size(split(text, ' ')) - 1, 0)), (a, b) -> a = b), x -> x)) > 0.3 * size(split(text, ' '))",
         "len(list_filter(list_zip(string_split(text, ' '), string_split(text, ' ')[2:]), lambda z: z[1] = z[2])) > 0.3 * len(string_split(text, ' '))"),
    Rule("digits", "regexp_count(text, '[0-9]') > 0.5 * length(text)", "len(regexp_extract_all(text, '[0-9]')) > 0.5 * length(text)"),
    Rule("long_words", f"length(text) > 30 * {_SPARK_WORDS}", f"length(text) > 30 * {_DUCK_WORDS}"),
)


@dataclass(frozen=True)
class Estimate:
    """seconds: of one pass over the sample; hits: the sample's patterns (bit i: rule i rejects) that it rejects."""

    rule: Rule
    seconds: float
    hits: frozenset[int]


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[Estimate], dict[int, int]]:
    """Each rule's seconds and what it rejects on a sample of about sample_rows rows, and how often each pattern of
    rejections occurs there.

    The sample is picked by a hash of the id (rows without one aren't in it) and read by one task. So that neither
    starting a job nor compiling it counts, each rule runs over so many copies of it that this is little, and the
    time that reading them takes is subtracted. Null texts count as empty; copies of a row count each time; an empty
    table has no patterns; other columns are ignored.
    """
    slim = Columns(docs).select(id=id_col, text=text_col)
    every = max(1, slim.select("id").count() // sample_rows)
    sample = write_table(slim.where(F.pmod(F.xxhash64(F.lit("rules"), "id"), F.lit(every)) == 0).select(F.coalesce("text", F.lit("")).alias("text")), "rules-sample").coalesce(1)
    bits = sum((F.when(F.coalesce(F.expr(r.reject), F.lit(False)), F.lit(1 << i)).otherwise(0) for i, r in enumerate(rules)), F.lit(0))
    patterns = {r["bits"]: r["count"] for r in sample.groupBy(bits.cast("int").alias("bits")).count().collect()}  # 2 ** rules at most
    reading: dict[int, float] = {}

    def timed(expr: str, copies: int) -> float:
        repeated = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(copies)))).agg(F.count_if(F.expr(expr)).alias("n"))
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            repeated.collect()
            took.append(time.perf_counter() - began)
        return min(took)

    out = []
    for i, rule in enumerate(rules):
        copies = 1
        while True:
            if copies not in reading:
                reading[copies] = timed("octet_length(text) < 0", copies)
            took = timed(rule.reject, copies) - reading[copies]
            if took >= LEAST_SECONDS or copies >= 4096 or not patterns:
                break
            copies *= max(2, round(1.5 * LEAST_SECONDS / max(took, LEAST_SECONDS / 20)))
        out.append(Estimate(rule, max(took, 1e-6) / copies, frozenset(p for p in patterns if p >> i & 1)))
    return out, patterns


def cascade(text: Column, rules: list[Rule]) -> Column:
    """The name of the first rule of the list that rejects, or null; later rules aren't evaluated after it.

    The conditions are branches of one CASE, which Spark evaluates in turn and only as far as needed.
    """
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.expr(rule.reject), F.lit(rule.name)).otherwise(out)
    return out


def ordered(estimates: list[Estimate], patterns: dict[int, int]) -> list[Rule]:
    """Each time the rule with the most rejections a second among the rows that the rules before it let through; of
    rules that reject none, the cheapest first; equals by name."""
    left, todo, out = dict(patterns), list(estimates), []
    while todo:
        best = min(todo, key=lambda e: (-sum(left.get(p, 0) for p in e.hits) / e.seconds, e.seconds, e.rule.name))
        left = {p: n for p, n in left.items() if p not in best.hits}
        todo.remove(best)
        out.append(best.rule)
    return out


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep) of every row: keep is whether no rule rejects its text.

    The rules run in the order of rejections per second on a sample, each judged on what those before it leave; the
    verdict is the same in any order. A null text counts as empty and is rejected. Null ids are returned; repeated rows
    get equal verdicts; a very long text is read whole; an empty table gives no rows; other columns are ignored.
    """
    order = ordered(*estimate(docs, rules, sample_rows, id_col, text_col))
    slim = Columns(docs).select(id=id_col, text=text_col).select("id", F.coalesce("text", F.lit("")).alias("text"))
    return slim.select(F.col("id").alias(id_col), cascade(F.col("text"), order).isNull().alias("keep"))


QUALITY_SQL = "select doc_id, not (" + " or ".join(f"({r.sql})" for r in RULES) + ") keep from (select doc_id, coalesce(text, '') as text from documents)"
