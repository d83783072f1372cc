"""Key figures of entities, and the riskiest of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions.coerce import col, half_even, safe_divide, stripped, stripped_text
from sievewright.functions.text import parsed_terms
from sievewright.operators.modes import group_mode
from sievewright.roles import Roles
from sievewright.storage import write_table

RESULTS = {"pass_count": "Pass", "pass_w_conditions_count": "Pass w/ Conditions", "fail_count": "Fail", "out_of_business_count": "Out of Business", "no_entry_count": "No Entry", "not_ready_count": "Not Ready", "business_not_located_count": "Business Not Located"}
RISKS = {"risk1_high_count": "Risk 1 (High)", "risk2_medium_count": "Risk 2 (Medium)", "risk3_low_count": "Risk 3 (Low)"}


def _prepared(df: DataFrame, roles: Roles, compat: bool) -> DataFrame:
    clean = stripped_text if compat else (lambda c: stripped(c.cast("string")))
    texts = [x for x in (roles.entity, roles.result, roles.risk, roles.terms, roles.name, roles.category, roles.city) if x in df.columns]
    out = df.withColumns({x: clean(col(x)) for x in texts})
    return out.where((col(roles.entity) != "") & col(roles.entity).isNotNull()).withColumn("__terms", parsed_terms(col(roles.terms)))


def frequent_terms(df: DataFrame, roles: Roles = Roles(), top: int = 3) -> DataFrame:
    """(entity, unique_violation_terms, top3_violation_terms): 'term(count)' of the most frequent terms, of equals the
    one met first. Entities without terms are absent."""
    each = df.select(col(roles.entity).alias("e"), col(roles.row_id).alias("r"), F.posexplode_outer("__terms").alias("pos", "term")).where("term is not null")  # an inner one also filters before it, by working the terms out once more
    counts = each.groupBy("e", "term").agg(F.count("*").alias("n"), F.min(F.struct("r", "pos")).alias("met"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("e").orderBy(F.col("n").desc(), "met")))
    best = F.when(F.col("rank") <= top, F.struct("rank", F.concat(F.col("term").cast("string"), F.lit("("), F.col("n").cast("string"), F.lit(")")).alias("text")))
    return ranked.groupBy(F.col("e").alias(roles.entity)).agg(F.count("*").cast("int").alias("unique_violation_terms"), F.array_join(F.transform(F.array_sort(F.collect_list(best)), lambda s: s["text"]), "; ").alias("top3_violation_terms"))


def _figures(df: DataFrame, roles: Roles, compat: bool, digits: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows that entities have, written to the shared folder; counts, rates and index of each entity)."""
    used = [x for x in (roles.entity, roles.row_id, roles.result, roles.risk, roles.name, roles.category, roles.city, roles.year) if x in df.columns]
    rows = write_table(_prepared(df, roles, compat).select(*[col(x) for x in used], "__terms"), "kpi-rows")  # read by the counts, the modes and the terms
    fold = (lambda c: c) if compat else F.lower
    result, risk = fold(col(roles.result)), fold(col(roles.risk))
    is_ = lambda c, v: c == (v if compat else v.lower())
    n = F.size("__terms")
    aggs = [F.count("*").alias("total_inspections"), F.count_if(is_(result, "Pass") | is_(result, "Pass w/ Conditions") | is_(result, "Fail")).alias("evaluated_inspections")]
    aggs += [F.count_if(is_(result, v)).alias(k) for k, v in RESULTS.items()]
    aggs += [F.count_if(n > 0).alias("inspections_with_violations"), F.sum(n).alias("total_violations")]
    aggs += [F.count_if(is_(risk, v)).alias(k) for k, v in RISKS.items()]
    if roles.year in df.columns:
        aggs.append(F.count_distinct(col(roles.year)).alias("inspection_years"))
    base = write_table(rows.groupBy(col(roles.entity)).agg(*aggs), "kpis").withColumn("avg_violations_per_inspection", F.col("total_violations") / F.col("total_inspections"))
    top = base.agg(F.max("avg_violations_per_inspection").alias("top")).select(F.when(F.col("top") > 0, F.col("top")).otherwise(1.0).alias("__top"))
    c = F.col
    rates = {
        "pass_rate_evaluated": safe_divide(c("pass_count") + c("pass_w_conditions_count"), c("evaluated_inspections")), "strict_pass_rate": safe_divide(c("pass_count"), c("evaluated_inspections")),
        "fail_rate_evaluated": safe_divide(c("fail_count"), c("evaluated_inspections")), "violation_inspection_rate": safe_divide(c("inspections_with_violations"), c("total_inspections")),
        "high_risk_inspection_rate": safe_divide(c("risk1_high_count"), c("total_inspections")),
        "non_operational_result_rate": safe_divide(c("out_of_business_count") + c("no_entry_count") + c("not_ready_count") + c("business_not_located_count"), c("total_inspections")),
    }
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    index = zero(c("fail_rate_evaluated")) * 0.45 + zero(c("violation_inspection_rate")) * 0.30 + zero(c("avg_violations_per_inspection") / c("__top")) * 0.15 + zero(c("non_operational_result_rate")) * 0.10
    out = base.crossJoin(F.broadcast(top)).withColumns(rates).withColumn("risk_index", index).drop("__top")  # one row
    if digits is not None:
        out = out.withColumns({k: half_even(c(k), digits) for k in [*rates, "risk_index"]} | {"avg_violations_per_inspection": half_even(c("avg_violations_per_inspection"), digits - 1)})
    return rows, out


def _with_details(figures: DataFrame, rows: DataFrame, roles: Roles) -> DataFrame:
    """The most frequent name, category and city, and the terms, of the entities that figures has."""
    out = figures
    for x in (roles.name, roles.category, roles.city):
        if x in rows.columns:
            out = out.join(group_mode(rows, [roles.entity], [x], tie="first", order=roles.row_id), roles.entity, "left")
    out = out.join(frequent_terms(rows, roles), roles.entity, "left")
    return out.withColumns({"unique_violation_terms": F.coalesce("unique_violation_terms", F.lit(0)), "top3_violation_terms": F.coalesce("top3_violation_terms", F.lit(""))})


def entity_kpis(df: DataFrame, roles: Roles = Roles(), compat: bool = False, digits: int | None = 4) -> DataFrame:
    """Counts, rates and the risk index of every entity.

    Rates are null where nothing is there to divide by, and count as 0 in the index, which is built from unrounded
    values: 0.45 fail rate + 0.30 rate of inspections with violations + 0.15 average violations over the greatest
    average + 0.10 rate of non-operational results. compat: risks are compared with their case, and a null is 'nan'.
    digits=None leaves rates unrounded.
    """
    rows, figures = _figures(df, roles, compat, digits)
    return _with_details(figures, rows, roles)


def riskiest(kpis: DataFrame, min_inspections: int = 5, top: int = 100, roles: Roles = Roles()) -> DataFrame:
    """Entities of at least min_inspections, by risk index, fail rate, violations, then id."""
    order = [F.col(x).desc_nulls_last() for x in ("risk_index", "fail_rate_evaluated", "total_violations")]
    return kpis.where(F.col("total_inspections") >= min_inspections).orderBy(*order, col(roles.entity)).limit(top)


def riskiest_entities(df: DataFrame, min_inspections: int = 5, top: int = 100, roles: Roles = Roles(), compat: bool = False, digits: int | None = 4) -> DataFrame:
    """riskiest() of entity_kpis(): the order needs figures alone, so details are worked out for the entities it takes."""
    rows, figures = _figures(df, roles, compat, digits)
    best = write_table(riskiest(figures, min_inspections, top, roles), "riskiest")
    own = rows.join(F.broadcast(best.select(col(roles.entity))), roles.entity, "left_semi")  # top rows at most
    return riskiest(_with_details(best, own, roles), min_inspections, top, roles)
