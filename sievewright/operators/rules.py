"""Association rules with antecedents and consequents of any size."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.coerce import col, stripped
from sievewright.roles import Roles
from sievewright.storage import write_table

MIN_SUPPORT, MIN_CONFIDENCE, TOP = 0.02, 0.3, 50
#: An itemset of k items has 2 ** k - 2 splits; longer ones than this are refused rather than split.
MAX_ITEMS = 20
RULES_SCHEMA = "antecedents array<string>, consequents array<string>, support double, confidence double, lift double"


def _item(label: str, value: Column) -> Column:
    text = stripped(value.cast("string"))
    return F.when(text != "", F.concat(F.lit(f"{label}="), text))


def transactions(df: DataFrame, labels: Mapping[str, str] | None = None, terms: str | None = None, compat: bool = False, roles: Roles = Roles(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, items): for each row its set of items, sorted.

    labels: column -> label of the item "label=value". terms: a column with a list of terms, plain (1,3) or as a list
    literal (['1', '3']); '0' and nothing are no terms. A row whose terms are the text nan is left out if compat.
    """
    labels = labels or {roles.category: "Facility Type", roles.risk: "Risk", roles.result: "Results"}
    terms = terms or roles.terms
    parts = [_item(label, col(c)) for c, label in labels.items() if c in df.columns]
    listed = F.array().cast("array<string>")
    if terms in df.columns:
        raw = stripped(col(terms).cast("string"))
        if compat:
            df = df.where(raw.isNull() | (F.lower(raw) != "nan"))
        bare = F.when(raw.startswith("["), F.regexp_replace(raw, r"^\[+|\]+$", "")).otherwise(raw)
        one = F.transform(F.split(bare, ","), lambda t: F.regexp_replace(stripped(t), "^[' \"]+|[' \"]+$", ""))
        some = raw.isNotNull() & ~F.lower(raw).isin("", "0", "nan")
        listed = F.when(some, F.transform(F.filter(one, lambda t: t != ""), lambda t: F.concat(F.lit("Violation="), t))).otherwise(listed)
    items = F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>"), listed)))
    return df.select(*[col(k) for k in keep], items.alias("items"))


def frequent_itemsets(baskets: DataFrame, min_support: float = MIN_SUPPORT, items: str = "items") -> DataFrame:
    """(items, freq): sets of items that a share of at least min_support of the baskets contains, sorted inside."""
    model = FPGrowth(itemsCol=items, minSupport=min_support).fit(baskets)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").cast("bigint").alias("freq"))


def association_rules(baskets: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, top: int | None = TOP, items: str = "items") -> DataFrame:
    """(antecedents, consequents, support, confidence, lift) of every split of every frequent itemset, by lift.

    Ties in lift go by support, then antecedents, then consequents; top: so many (None or 0: all).
    """
    baskets = write_table(baskets.select(col(items)), "baskets")  # counted once and read by both passes of FP-growth
    total = baskets.count()
    if not total:
        return baskets.sparkSession.createDataFrame([], RULES_SCHEMA)
    sets = write_table(frequent_itemsets(baskets, min_support, items), "itemsets")
    wide = F.assert_true(F.size("items") <= MAX_ITEMS, f"an itemset has more than {MAX_ITEMS} items").isNull()
    masks = sets.where("size(items) > 1").where(wide).select("items", "freq", F.explode(F.expr("sequence(1, shiftleft(1, size(items)) - 2)")).alias("mask"))
    splits = masks.select("freq", F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1) = 1)").alias("antecedents"), F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1) = 0)").alias("consequents"))
    of = lambda side: sets.select(F.col("items").alias(side), F.col("freq").alias(f"{side}_freq"))
    both = splits.join(of("antecedents"), "antecedents").join(of("consequents"), "consequents")
    n = F.lit(float(total))
    confidence = F.col("freq") / F.col("antecedents_freq")
    rules = both.where(confidence >= min_confidence).select("antecedents", "consequents", (F.col("freq") / n).alias("support"), confidence.alias("confidence"), (confidence / (F.col("consequents_freq") / n)).alias("lift"))
    ordered = rules.orderBy(F.col("lift").desc(), F.col("support").desc(), "antecedents", "consequents")
    return ordered.limit(top) if top else ordered
