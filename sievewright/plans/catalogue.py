"""Queries of the driver: one for each operator, over the inspection-shaped projection or the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import text as t
from sievewright.operators import clean, dependencies, entity, impute, kpi, modes, profile, repair, rules, star
from sievewright.plans import oracle as o
from sievewright.plans.inspections import inspections, table
from sievewright.storage import write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_inspections(inspections(spark, d))


_INSP = {"inspection_id": "int64", "dba_name": "object", "aka_name": "object", "license_no": "int64", "facility_type": "object", "risk": "object", "address": "object", "zip": "int64", "inspection_date": "object", "inspection_type": "object", "results": "object", "violations": "object", "latitude": "float64", "longitude": "float64"}


def _per_column(select: str) -> str:
    return " union all ".join(select.format(c=c, kind=kind) for c, kind in _INSP.items())


@query("select (select count(*) from orders) as rows, cast(6 as bigint) as columns")
def profile_overview(spark, d):
    return profile.overview(table(spark, d, "orders"))


@query(o.insp(_per_column("select '{c}' as column, '{kind}' data_type, count(distinct {c}) unique_values, count(*) - count({c}) null_values, round_even((count(*) - count({c})) * 100.0::double / count(*), 2) null_percentage from insp")))
def profile_columns(spark, d):
    return profile.column_summary(inspections(spark, d))


_TOP = "select '{c}' as column, value, count, rank from (select cast({c} as varchar) value, count(*) count, cast(row_number() over (order by count(*) desc, cast({c} as varchar) nulls last) as int) rank from insp group by {c}) where rank <= 5"


@query(o.insp(_per_column(_TOP)))
def profile_top_values(spark, d):
    return profile.value_counts(inspections(spark, d))


_NUM = [c for c, k in _INSP.items() if k != "object"]


@query(o.insp(" union all ".join(f"select '{c}' as column, cast(min({c}) as double) least, cast(max({c}) as double) most, round(avg({c}), 6) mean, round(stddev_samp({c}), 6) deviation from insp" for c in _NUM)))
def profile_numbers(spark, d):
    p = profile.column_profile(inspections(spark, d)).where(F.col("column").isin(_NUM))
    return p.select("column", "least", "most", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


_LINES = "select '{c}' as column, string_agg(case when v is null then 'NaN' when length(v) > 30 then v[1:27] || '...' else v end || ': ' || format('{{:,}}', n), chr(10) order by n desc, v nulls last) value_distribution from (select cast({c} as varchar) v, count(*) n from insp group by 1 order by n desc, v nulls last limit 5)"
_TEXT = [c for c, k in _INSP.items() if k == "object"]


@query(o.insp(" union all ".join("(" + _LINES.format(c=c) + ")" for c in _TEXT)))
def profile_distribution(spark, d):
    return profile.column_profile(inspections(spark, d)).where(F.col("column").isin(_TEXT)).select("column", "value_distribution")


@query(o.insp(_per_column("select '{c}' as column, (count(*) - count({c})) * 100.0::double / count(*) percentage from insp")))
def missing_pct(spark, d):
    return profile.missing_percentage(inspections(spark, d))


@query(o.insp("select coalesce(facility_type, 'MISSING') as value, count(*) as count from insp group by 1 order by 2 desc, 1 limit 15"))
def category_distribution(spark, d):
    return profile.category_distribution(inspections(spark, d), "facility_type", 15)


# ---------------------------------------------------------------- cleaning and terms


@query(o.clean("select * from clean"))
def clean_inspections(spark, d):
    return cleaned(spark, d)


_ODD = "case inspection_id % 17 when 0 then 'x' when 1 then 'Infinity' when 2 then '1e30' when 3 then '60601.7' else cast({c} as {text}) end"
_WHOLE = "try_cast(trunc(try_cast({c} as double)) as bigint) {c}"


@query(o.insp(f"select inspection_id, {_WHOLE.format(c='zip')}, {_WHOLE.format(c='license_no')} from (select * replace ({', '.join(_ODD.format(c=c, text='varchar') + ' as ' + c for c in ('zip', 'license_no'))}) from insp) where zip is not null and license_no is not null and license_no <> '0' and inspection_type is not null and risk is not null and risk <> 'All'"))
def coerced_numbers(spark, d):
    odd = inspections(spark, d).withColumns({c: F.expr(_ODD.format(c=c, text="string")) for c in ("zip", "license_no")})
    return clean.clean_inspections(odd).select("inspection_id", "zip", "license_no")


@query(o.insp("select i.inspection_id, violation_terms from insp i left join terms t on t.inspection_id = i.inspection_id", o.TERMS))
def violation_terms(spark, d):
    return inspections(spark, d).select("inspection_id", t.violation_terms(F.col("violations")).alias("violation_terms"))


@query(o.insp("select inspection_id, n term from numbers where n <> 0", o.TERMS))
def parsed_terms(spark, d):
    return inspections(spark, d).select("inspection_id", F.explode(t.parsed_terms(t.violation_terms(F.col("violations")))).alias("term"))


@query("select c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') as name from customer")
def normalized_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", t.normalized_name(F.col("c_name")).alias("name"))


# ---------------------------------------------------------------- rules

_ITEMS = """items as materialized (select inspection_id, 'Facility Type=' || trim(facility_type) item from clean where trim(facility_type) <> '' union select inspection_id, 'Risk=' || trim(risk) from clean where trim(risk) <> '' union select inspection_id, 'Results=' || trim(results) from clean where trim(results) <> ''{terms})"""
_WITH_TERMS = _ITEMS.format(terms=" union select inspection_id, 'Violation=' || unnest(string_split(violation_terms, ',')) from clean where violation_terms is not null")
#: Level by level: the inspections that hold each frequent set, prolonged by each later item.
_SETS = """total as materialized (select count(*) n, 0.02::double * count(*) least from clean),
holders(items, inspection_id) as (select [item], inspection_id from items qualify count(*) over (partition by item) >= (select least from total)
 union all select items, inspection_id from (select list_append(h.items, i.item) items, h.inspection_id from holders h join items i on i.inspection_id = h.inspection_id and i.item > h.items[-1]) qualify count(*) over (partition by items) >= (select least from total)),
sets as materialized (select items, count(*) freq from holders group by items)"""
_RULES = f"""{_WITH_TERMS}, {_SETS},
splits as (select items, freq, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) a, list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 0) c from (select items, freq, unnest(range(1, (1 << len(items)) - 1)) m from sets where len(items) > 1)),
rules as (select a, c, s.freq / n::double support, s.freq / x.freq::double confidence, (s.freq / x.freq::double) / (y.freq / n::double) lift from splits s join sets x on x.items = a join sets y on y.items = c, total where s.freq / x.freq::double >= 0.3)"""
_RULE_COLUMNS = "select array_to_string(a, ', ') antecedents, array_to_string(c, ', ') consequents, support, confidence, lift from rules"


@query(o.clean("select c.inspection_id, coalesce(string_agg(item, ', ' order by item), '') as items from clean c left join items i on i.inspection_id = c.inspection_id group by 1", _WITH_TERMS))
def transactions_items(spark, d):
    return rules.transactions(cleaned(spark, d), keep=("inspection_id",)).select("inspection_id", t.set_text(F.col("items")).alias("items"))


def _mined(select: str, *ctes: str) -> str:
    return o.clean(select, *ctes).replace("with ", "with recursive ", 1)


@query(_mined("select array_to_string(items, ', ') as items, freq from sets", _WITH_TERMS, _SETS))
def frequent_itemsets(spark, d):
    sets = rules.frequent_itemsets(write_table(rules.transactions(cleaned(spark, d)), "baskets"))
    return sets.select(t.set_text(F.col("items")).alias("items"), "freq")


def _flat_rules(spark, d, top):
    found = rules.association_rules(rules.transactions(cleaned(spark, d)), top=top)
    return found.select(t.set_text(F.col("antecedents")).alias("antecedents"), t.set_text(F.col("consequents")).alias("consequents"), "support", "confidence", "lift")


@query(_mined(_RULE_COLUMNS, _RULES))
def association_rules(spark, d):
    return _flat_rules(spark, d, None)


@query(_mined(_RULE_COLUMNS + " order by lift desc, support desc, a, c limit 50", _RULES))
def association_rules_topk(spark, d):
    return _flat_rules(spark, d, 50)


# ---------------------------------------------------------------- dependencies

_PAIRS = dependencies.chart_pairs()
_RAW_PAIRS = [("l_orderkey", "l_linestatus"), ("l_partkey", "l_returnflag"), ("l_suppkey", "l_shipdate")]
_CONF = "case when total_groups > 0 then round_even(1 - violating_groups / total_groups, 4) end"


@query(o.insp("select lhs, rhs, " + _CONF + " confidence from (" + " union all ".join(o.fd_counts("insp", a, b) for a, b in _PAIRS) + " union all " + " union all ".join(o.fd_counts("lineitem", a, b) for a, b in _RAW_PAIRS) + ")"))
def fd_confidence(spark, d):
    i, lines = inspections(spark, d), table(spark, d, "lineitem")
    out = dependencies.fd_confidence(i, *_PAIRS[0])
    for df, pairs in ((i, _PAIRS[1:]), (lines, _RAW_PAIRS)):
        for a, b in pairs:
            out = out.unionByName(dependencies.fd_confidence(df, a, b))
    return out


_LEFTS = ["zip", "license_no", "latitude", "address", "longitude", "inspection_id"]
_RIGHTS = ["zip", "dba_name", "latitude", "aka_name", "longitude", "address", "facility_type"]


@query(o.clean("select *, round_even(violating_groups * 100.0::double / total_groups, 2) violation_rate, round_even(100 * round_even(1 - violating_groups / total_groups, 4), 2) accuracy, violating_groups = 0 holds_exactly from (" + " union all ".join(o.fd_counts("clean", a, b, True) for a in _LEFTS for b in _RIGHTS if a != b) + ")"))
def fd_discovery(spark, d):
    return dependencies.detect(cleaned(spark, d))


@query(o.insp("select lhs || ' -> ' || rhs fd, violating_groups, total_groups from (" + " union all ".join(o.fd_counts("insp", a, b) for a, b in _PAIRS) + ")"))
def fd_violation_counts(spark, d):
    return dependencies.violation_counts(inspections(spark, d), _PAIRS)


@query(o.insp("select lhs || ' -> ' || rhs fd, " + _CONF + " confidence from (" + " union all ".join(o.fd_counts("insp", a, b) for a, b in _PAIRS) + ")"))
def fd_confidence_ranking(spark, d):
    return dependencies.confidence_ranking(inspections(spark, d), _PAIRS)


# ---------------------------------------------------------------- repair


@query(o.clean("select inspection_id, address, zip from r1", o.NORMAL, o.repair("norm", "r1", "address", "zip")))
def fd_repair_single(spark, d):
    return repair.repair_fd(repair.normalise_texts(cleaned(spark, d)), "address", "zip")[0].select("inspection_id", "address", "zip")


_REPAIRED = ["inspection_id", "dba_name", "aka_name", "license_no", "facility_type", "risk", "address", "zip"]


def _repaired(spark, d):
    """What repairs read and change of every row: no other column is computed and written."""
    return repair.repair_all(cleaned(spark, d).select(*_REPAIRED))


@query(o.clean("select inspection_id, dba_name, aka_name, license_no, facility_type, risk, address, zip from r5", *o.chain()))
def fd_repair_chain(spark, d):
    return _repaired(spark, d)[0].select(*_REPAIRED)


@query(o.clean(" union all ".join(o.log(f"r{i}", a, b) for i, (a, b) in enumerate(o.REPAIRS, 1)), *o.chain()))
def fd_repair_log(spark, d):
    log = _repaired(spark, d)[2]
    pairs = F.transform(F.array_sort(F.map_entries("replaced_values")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return log.select("fd", "lhs_value", "rhs_column", "standardised_to", F.array_join(pairs, "; ").alias("replaced"), "rows_repaired")


def _summary(i: int, a: str, b: str) -> str:
    before, after = ("norm" if i == 1 else f"r{i - 1}"), f"r{i}"
    conf = lambda t: f"(select {_CONF} from ({o.fd_counts(t, a, b)}))"
    return f"select '{a} -> {b}' fd, {conf(before)} confidence_before, {conf(after)} confidence_after, round_even({conf(after)} - {conf(before)}, 4) delta, (select count(distinct k) from {after}_v where v is distinct from m) lhs_values_repaired, (select cast(coalesce(sum(n), 0) as bigint) from {after}_v where v is distinct from m) rows_repaired"


@query(o.clean(" union all ".join(_summary(i, a, b) for i, (a, b) in enumerate(o.REPAIRS, 1)), *o.chain()))
def fd_repair_summary(spark, d):
    return _repaired(spark, d)[1]


# ---------------------------------------------------------------- modes and imputation


@query(o.clean("select license_no, arg_max(risk, (n, -f)) risk from (select license_no, risk, count(*) n, min(inspection_id) f from clean group by 1, 2) group by 1"))
def mode_majority(spark, d):
    return modes.group_mode(cleaned(spark, d), ["license_no"], ["risk"], tie="first", order="inspection_id")


@query(o.insp("select latitude, longitude, m address from modes", o.strict_mode("modes", "insp", "latitude, longitude", "address")))
def mode_strict(spark, d):
    return modes.group_mode(inspections(spark, d), ["latitude", "longitude"], ["address"], tie="unique", min_count=2)


@query(o.insp("select zip, la latitude, lo longitude from modes", o.pair_mode("modes", "insp")))
def mode_pair(spark, d):
    return modes.group_mode(inspections(spark, d), ["zip"], ["latitude", "longitude"], tie="first", min_count=2, order="inspection_id")


@query(o.insp("select license_no, zip from (select license_no, zip, row_number() over (partition by license_no order by count(*) desc, zip) r from insp where license_no is not null and zip is not null group by 1, 2) where r = 1"))
def mode_smallest(spark, d):
    return modes.group_mode(inspections(spark, d), ["license_no"], ["zip"], tie="smallest")


@query(o.insp("select inspection_id, coalesce(i.address, m) address from insp i left join modes p on p.latitude = i.latitude and p.longitude = i.longitude", o.strict_mode("modes", "insp", "latitude, longitude", "address")))
def impute_by_location(spark, d):
    return impute.fill_by_location(inspections(spark, d), "address").select("inspection_id", "address")


@query(o.insp("select inspection_id, coalesce(latitude, la) latitude, coalesce(longitude, lo) longitude from insp i left join modes p on p.zip = i.zip", o.pair_mode("modes", "insp")))
def impute_geo_by_zip(spark, d):
    return impute.fill_place_by_zip(inspections(spark, d)).select("inspection_id", "latitude", "longitude")


@query(o.insp("select inspection_id, coalesce(i.facility_type, m, 'Others') facility_type from insp i left join modes p on p.license_no = i.license_no", o.strict_mode("modes", "insp", "license_no", "facility_type")))
def impute_facility_by_license(spark, d):
    return impute.fill_category_by_license(inspections(spark, d)).select("inspection_id", "facility_type")


@query(o.clean("select * from final", *o.chain(), *o.imputed()))
def repair_and_impute(spark, d):
    return repair.repair_and_impute(cleaned(spark, d))


# ---------------------------------------------------------------- entities


@query(o.entities("select * from ukeys", "keys"))
def union_keys(spark, d):
    return entity.union_keys(cleaned(spark, d))


@query(o.entities("select license_no, i, j, sim_name, sim_zip, round(sim_geo, 6) sim_geo, sim_facility, round(score, 6) score from scored", "pairs"))
def pair_similarity(spark, d):
    p = entity.pair_scores(entity.union_keys(cleaned(spark, d)))
    return p.withColumns({"sim_geo": F.round("sim_geo", 6), "score": F.round("score", 6)})


@query(o.entities("select c.license_no, c.node, c.component, s.seq from comp c join seqs s on s.license_no = c.license_no and s.component = c.component", "clusters"))
def entity_clusters(spark, d):
    keys = write_table(entity.union_keys(cleaned(spark, d)), "keys")
    return entity.clusters(keys, entity.links(keys)).withColumn("seq", F.col("seq").cast("bigint"))


@query(o.entities("select * from ekeys", "clusters"))
def entity_keys(spark, d):
    return entity.entity_keys(cleaned(spark, d))


@query(o.entities("select * from canon", "canonical"))
def canonical_attributes(spark, d):
    return entity.canonical(entity.entity_keys(cleaned(spark, d)))


@query(o.entities("select * from unified", "unified"))
def unify_zip(spark, d):
    return entity.resolve(cleaned(spark, d))


def _merged(spark, d):
    """Each query reads it once or writes what it uses of it. Keys and rows are cleaned apart: keys need no violations."""
    return star.merge_back(cleaned(spark, d), entity.resolve(cleaned(spark, d)))


@query(o.entities("select inspection_id, entity_id, dba_name, facility_type, zip, latitude, longitude from merged"))
def merged_inspections(spark, d):
    return _merged(spark, d).select("inspection_id", "entity_id", "dba_name", "facility_type", "zip", "latitude", "longitude")


@query(o.entities("select * from dim"))
def restaurant_dim(spark, d):
    return star.entity_table(_merged(spark, d))


@query(o.entities("select row_number() over (order by inspection_id) inspection_no, restaurant_id, inspection_type, risk, results, violations, violation_terms, inspection_year, inspection_month, inspection_day from merged m left join dim on dim.entity_id is not distinct from m.entity_id"))
def inspections_fact(spark, d):
    merged = write_table(_merged(spark, d), "merged")
    return star.inspection_table(merged, star.entity_table(merged))


# ---------------------------------------------------------------- key figures


@query(o.kpis("select * from kpi"))
def entity_kpis(spark, d):
    return kpi.entity_kpis(_merged(spark, d))


@query(o.kpis("select entity entity_id, unique_violation_terms, top3_violation_terms from term_best"))
def top_violation_terms(spark, d):
    rows = _merged(spark, d).where("entity_id is not null")
    return kpi.frequent_terms(rows.withColumn("__terms", t.parsed_terms(F.col("violation_terms"))))


@query(o.kpis("select * from kpi where total_inspections >= 5 order by risk_index desc, fail_rate_evaluated desc nulls last, total_violations desc, entity_id limit 100"))
def high_risk_rank(spark, d):
    return kpi.riskiest_entities(_merged(spark, d))
