"""DuckDB SQL that the catalogue's queries are compared with, written independently of the operators."""

from __future__ import annotations

from sievewright.plans.inspections import INSP_SQL

_HEAD = """case when contains(c, ' - Comments:') then string_split(c, ' - Comments:')[1] when contains(c, 'Comments:') then string_split(c, 'Comments:')[1]
 when contains(c, ' - ') then string_split(c, ' - ')[1] when contains(c, 'COMMENTS:') then string_split(c, 'COMMENTS:')[1] else c end"""
#: (inspection_id, n): the clause numbers, from one row a clause.
TERMS = rf"""clauses as materialized (select inspection_id, {_HEAD} h from (select inspection_id, trim(unnest(string_split(violations, '|'))) c from insp where violations is not null)),
numbers as materialized (select distinct inspection_id, cast(unnest(case when regexp_extract(h, '^\s*(\d+)\.\s', 1) <> '' then [regexp_extract(h, '^\s*(\d+)\.\s', 1)] else regexp_extract_all(h, '\b(\d+)\.\s+[A-Z]', 1) end) as bigint) n from clauses),
terms as materialized (select inspection_id, string_agg(cast(n as varchar), ',' order by n) violation_terms from numbers group by 1)"""
CLEAN = """clean as materialized (select i.inspection_id, dba_name, aka_name, license_no, coalesce(facility_type, 'Others') facility_type, risk, address, cast(zip as bigint) zip, inspection_type, results, violations, latitude, longitude,
 cast(year(strptime(inspection_date, '%m/%d/%Y')) as int) inspection_year, cast(month(strptime(inspection_date, '%m/%d/%Y')) as int) inspection_month, cast(day(strptime(inspection_date, '%m/%d/%Y')) as int) inspection_day, violation_terms
 from insp i left join terms t on t.inspection_id = i.inspection_id
 where zip is not null and license_no is not null and license_no <> 0 and inspection_type is not null and risk is not null and risk <> 'All')"""


def insp(select: str, *ctes: str) -> str:
    return f"with {', '.join([INSP_SQL, *ctes])}\n{select}"


def clean(select: str, *ctes: str) -> str:
    return insp(select, TERMS, CLEAN, *ctes)


# ---------------------------------------------------------------- dependencies and repair


def fd_counts(table: str, lhs: str, rhs: str, drop: bool = False) -> str:
    where = f"{lhs} is not null" + (f" and {rhs} is not null" if drop else "")
    return f"select '{lhs}' lhs, '{rhs}' rhs, count(*) total_groups, count(*) filter (where d > 1) violating_groups from (select {lhs}, count(distinct {rhs}) d from {table} where {where} group by 1)"


NORMAL = """norm as materialized (select * replace (upper(trim(dba_name)) as dba_name, upper(trim(aka_name)) as aka_name, upper(trim(address)) as address, upper(trim(facility_type)) as facility_type, upper(trim(risk)) as risk, cast(zip as varchar) as zip) from clean)"""


def repair(before: str, after: str, lhs: str, rhs: str) -> str:
    """CTEs <after>_v (values of groups to repair) and <after> (repaired rows)."""
    return f"""{after}_n as materialized (select {lhs} k, {rhs} v, count(*) n, min(inspection_id) f from {before} where {lhs} is not null group by 1, 2),
{after}_m as materialized (select k, arg_max(v, (n, -f)) m from {after}_n where v is not null group by k having count(*) between 2 and 3),
{after}_v as materialized (select x.k, x.v, x.n, y.m from {after}_n x join {after}_m y on x.k = y.k),
{after} as materialized (select b.* replace (coalesce(m, {rhs}) as {rhs}) from {before} b left join {after}_m on k = {lhs})"""


REPAIRS = [("address", "zip"), ("license_no", "address"), ("license_no", "zip"), ("license_no", "risk"), ("license_no", "facility_type")]


def chain() -> list[str]:
    out, before = [NORMAL], "norm"
    for i, (a, b) in enumerate(REPAIRS, 1):
        out.append(repair(before, f"r{i}", a, b))
        before = f"r{i}"
    return out


def log(step: str, lhs: str, rhs: str) -> str:
    return f"""select '{lhs} -> {rhs}' fd, cast(k as varchar) lhs_value, '{rhs}' rhs_column, cast(m as varchar) standardised_to,
 coalesce(string_agg(cast(v as varchar) || '=' || cast(n as varchar), '; ' order by cast(v as varchar)) filter (where v is not null), '') replaced, cast(sum(n) as bigint) rows_repaired
 from {step}_v where v is distinct from m group by k, m"""


def strict_mode(name: str, table: str, keys: str, value: str, least: int = 2) -> str:
    """A CTE with the value that is more frequent than any other in its group, and occurs `least` times."""
    ks = keys.split(", ")
    some = " and ".join(f"{k} is not null" for k in [*ks, value])
    return f"""{name} as materialized (select {keys}, max(v) m from (select {keys}, {value} v, n, max(n) over (partition by {keys}) top from (select {keys}, {value}, count(*) n from {table} where {some} group by {keys}, {value})) where n = top group by {keys} having count(*) = 1 and max(n) >= {least})"""


def imputed() -> list[str]:
    """CTEs over the repaired rows r5 up to `final`."""
    return [
        strict_mode("by_place_a", "r5", "latitude, longitude", "address"),
        "i1 as materialized (select r5.* replace (coalesce(r5.address, m) as address) from r5 left join by_place_a p on p.latitude = r5.latitude and p.longitude = r5.longitude)",
        strict_mode("by_place_z", "i1", "latitude, longitude", "zip"),
        "i2 as materialized (select i1.* replace (coalesce(i1.zip, m) as zip) from i1 left join by_place_z p on p.latitude = i1.latitude and p.longitude = i1.longitude)",
        pair_mode("by_zip", "i2"),
        "i3 as materialized (select i2.* replace (coalesce(i2.latitude, la) as latitude, coalesce(i2.longitude, lo) as longitude) from i2 left join by_zip p on p.zip = i2.zip)",
        strict_mode("by_license", "i3", "license_no", "facility_type"),
        "i4 as materialized (select i3.* replace (coalesce(i3.facility_type, m, 'Others') as facility_type) from i3 left join by_license p on p.license_no = i3.license_no)",
        "final as materialized (select * replace (coalesce(aka_name, dba_name) as aka_name, coalesce(violations, '0') as violations, coalesce(violation_terms, '0') as violation_terms) from i4 where latitude is not null and longitude is not null and zip is not null)",
    ]


def pair_mode(name: str, table: str) -> str:
    return f"{name} as materialized (select zip, arg_max(latitude, (n, -f)) la, arg_max(longitude, (n, -f)) lo from (select zip, latitude, longitude, count(*) n, min(inspection_id) f from {table} where zip is not null and latitude is not null and longitude is not null group by 1, 2, 3) group by zip having max(n) > 1)"


# ---------------------------------------------------------------- entities

KEY = "license_no, dba_name, zip, latitude, longitude, facility_type"


def keys(table: str) -> str:
    some = " and ".join(f"{k} is not null" for k in KEY.split(", "))
    return f"""ukeys as materialized (select *, cast(sum(cnt) over (partition by license_no) as bigint) total_records, count(*) over (partition by license_no) diff_info_cnt,
 cast(row_number() over (partition by license_no order by cnt desc, {KEY}) - 1 as int) node from (select {KEY}, count(*) cnt from {table} where {some} group by all))"""


#: CTEs that score all pairs of a licence's keys: LCS one character at a time, over rows of the dynamic programme.
PAIRS = """prep as materialized (select *, regexp_replace(upper(dba_name), '[^A-Z0-9]', '', 'g') nm from ukeys where diff_info_cnt > 1),
raw_pairs as materialized (select a.license_no, a.node i, b.node j, a.nm na, b.nm nb, case when a.zip = b.zip then 1.0::double else 0.0::double end sim_zip,
 12742000.0::double * atan2(sqrt(h), sqrt(1 - h)) d, case when lower(trim(a.facility_type)) = lower(trim(b.facility_type)) and trim(a.facility_type) <> '' then 1.0::double else 0.0::double end sim_facility
 from (select a, b, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2) h from prep a join prep b on a.license_no = b.license_no and a.node < b.node)),
names as materialized (select distinct na, nb from raw_pairs),
lcs(na, nb, k, r) as (select na, nb, 0, list_transform(range(length(nb) + 1), lambda x: 0) from names
 union all select na, nb, k + 1, list_prepend(0, list_transform(range(1, length(nb) + 1), lambda x: list_max(list_transform(range(1, x + 1), lambda y: greatest(r[y + 1], case when nb[y] = na[k + 1] then r[y] + 1 else 0 end))))) from lcs where k < length(na)),
ratio as materialized (select na, nb, case when length(na) > 0 and length(nb) > 0 then round_even(100 * (2 * r[-1] / (length(na) + length(nb))), 0) / 100 else 0.0 end sim_name from lcs where k = length(na)),
pairs as materialized (select license_no, i, j, sim_name, sim_zip, case when d < 0.1 then 1.0 when d <= 100 then 0.9 when d <= 500 then 0.9 - 0.3 * (d - 100) / 400 when d <= 5000 then 0.6 * pow((5000 - d) / 4500, 2) else 0.0 end::double sim_geo, sim_facility
 from raw_pairs p join ratio n on p.na = n.na and p.nb = n.nb),
scored as materialized (select *, 0.55::double * sim_name + 0.2::double * sim_zip + 0.2::double * sim_geo + 0.05::double * sim_facility score from pairs)"""
#: CTEs that give each node its component and each component its place.
CLUSTERS = """edges as materialized (select license_no, i a, j b from scored where score >= 0.5 union all select license_no, j, i from scored where score >= 0.5),
reach(license_no, a, b) as (select license_no, node, node from prep union select r.license_no, r.a, e.b from reach r join edges e on e.license_no = r.license_no and e.a = r.b),
comp as materialized (select license_no, a node, cast(min(b) as int) component from reach group by 1, 2),
seqs as materialized (select license_no, component, row_number() over (partition by license_no order by count(*) desc, component) seq from comp group by 1, 2),
ekeys as materialized (select u.*, cast(u.license_no as varchar) || '_' || cast(coalesce(seq, 0) as varchar) entity_id from ukeys u left join comp c on c.license_no = u.license_no and c.node = u.node left join seqs s on s.license_no = c.license_no and s.component = c.component)"""
CANONICAL = "canon as materialized (select *, " + ", ".join(f"first_value({c}) over w {c}_std" for c in ("dba_name", "facility_type", "zip", "latitude", "longitude")) + " from ekeys window w as (partition by entity_id order by cnt desc, license_no, node rows between unbounded preceding and unbounded following))"
UNIFIED = """rounded as materialized (select * replace (round_even(latitude_std, 6) as latitude_std, round_even(longitude_std, 6) as longitude_std) from canon),
spot as materialized (select latitude_std, longitude_std, zip_std z from (select latitude_std, longitude_std, zip_std, row_number() over (partition by latitude_std, longitude_std order by count(*) desc, zip_std) r from rounded group by 1, 2, 3) where r = 1),
unified as materialized (select r.* replace (s.z as zip_std) from rounded r join spot s on s.latitude_std = r.latitude_std and s.longitude_std = r.longitude_std)"""
MERGED = """merged as materialized (select c.* replace (coalesce(dba_name_std, c.dba_name) as dba_name, coalesce(facility_type_std, c.facility_type) as facility_type, coalesce(zip_std, c.zip) as zip, coalesce(latitude_std, c.latitude) as latitude, coalesce(longitude_std, c.longitude) as longitude), entity_id
 from clean c left join unified u on u.license_no = c.license_no and u.dba_name = c.dba_name and u.zip = c.zip and u.latitude = c.latitude and u.longitude = c.longitude and u.facility_type = c.facility_type)"""
DIMENSION = """dim as materialized (select row_number() over (order by entity_id nulls last) restaurant_id, * from (select entity_id, license_no, dba_name, aka_name, facility_type, address, zip, latitude, longitude from (select *, row_number() over (partition by entity_id order by inspection_id) r from merged) where r = 1))"""


def entities(select: str, upto: str = "merged", *more: str) -> str:
    ctes = {"keys": [keys("clean")], "pairs": [keys("clean"), PAIRS], "clusters": [keys("clean"), PAIRS, CLUSTERS], "canonical": [keys("clean"), PAIRS, CLUSTERS, CANONICAL], "unified": [keys("clean"), PAIRS, CLUSTERS, CANONICAL, UNIFIED], "merged": [keys("clean"), PAIRS, CLUSTERS, CANONICAL, UNIFIED, MERGED, DIMENSION]}[upto]
    return clean(select, *ctes, *more).replace("with ", "with recursive ", 1)


# ---------------------------------------------------------------- key figures

KPIS = """term_rows as materialized (select entity, inspection_id, unnest(range(1, len(ts) + 1)) pos, unnest(ts) term from (select entity, inspection_id, list_filter(list_transform(string_split(coalesce(violation_terms, ''), ','), lambda x: try_cast(x as bigint)), lambda x: x is not null and x <> 0) ts from ent)),
term_counts as materialized (select entity, term, count(*) n, min((inspection_id, pos)) met from term_rows group by 1, 2),
term_best as materialized (select entity, cast(count(*) as int) unique_violation_terms, string_agg(cast(term as varchar) || '(' || cast(n as varchar) || ')', '; ' order by r) filter (where r <= 3) top3_violation_terms from (select *, row_number() over (partition by entity order by n desc, met) r from term_counts) group by 1),
per_row as materialized (select e.*, (select count(*) from term_rows t where t.inspection_id = e.inspection_id) nv from ent e),
base as materialized (select entity, count(*) total_inspections, count(*) filter (where results in ('Pass', 'Pass w/ Conditions', 'Fail')) evaluated_inspections, count(*) filter (where results = 'Pass') pass_count, count(*) filter (where results = 'Pass w/ Conditions') pass_w_conditions_count,
 count(*) filter (where results = 'Fail') fail_count, count(*) filter (where results = 'Out of Business') out_of_business_count, count(*) filter (where results = 'No Entry') no_entry_count, count(*) filter (where results = 'Not Ready') not_ready_count, count(*) filter (where results = 'Business Not Located') business_not_located_count,
 count(*) filter (where nv > 0) inspections_with_violations, cast(sum(nv) as bigint) total_violations, count(*) filter (where risk = 'Risk 1 (High)') risk1_high_count, count(*) filter (where risk = 'Risk 2 (Medium)') risk2_medium_count, count(*) filter (where risk = 'Risk 3 (Low)') risk3_low_count, count(distinct inspection_year) inspection_years
 from per_row group by 1),
rates as materialized (select *, cast(total_violations as double) / total_inspections av, case when evaluated_inspections > 0 then cast(pass_count + pass_w_conditions_count as double) / evaluated_inspections end p1, case when evaluated_inspections > 0 then cast(pass_count as double) / evaluated_inspections end p2,
 case when evaluated_inspections > 0 then cast(fail_count as double) / evaluated_inspections end fr, cast(inspections_with_violations as double) / total_inspections vr, cast(risk1_high_count as double) / total_inspections hr, cast(out_of_business_count + no_entry_count + not_ready_count + business_not_located_count as double) / total_inspections nr from base),
modes as materialized (select entity, arg_max(v, (n, -f)) filter (where c = 'd') dba_name, arg_max(v, (n, -f)) filter (where c = 'f') facility_type from (select entity, 'd' c, trim(dba_name) v, count(*) n, min(inspection_id) f from ent where dba_name is not null group by all union all select entity, 'f', trim(facility_type), count(*), min(inspection_id) from ent where facility_type is not null group by all) group by 1),
kpi as materialized (select r.entity entity_id, total_inspections, evaluated_inspections, pass_count, pass_w_conditions_count, fail_count, out_of_business_count, no_entry_count, not_ready_count, business_not_located_count, inspections_with_violations, total_violations, risk1_high_count, risk2_medium_count, risk3_low_count, inspection_years,
 round_even(av, 3) avg_violations_per_inspection, round_even(p1, 4) pass_rate_evaluated, round_even(p2, 4) strict_pass_rate, round_even(fr, 4) fail_rate_evaluated, round_even(vr, 4) violation_inspection_rate, round_even(hr, 4) high_risk_inspection_rate, round_even(nr, 4) non_operational_result_rate,
 round_even(coalesce(fr, 0) * 0.45::double + vr * 0.30::double + (av / (select case when max(av) > 0 then max(av) else 1 end from rates)) * 0.15::double + nr * 0.10::double, 4) risk_index, m.dba_name, m.facility_type, coalesce(unique_violation_terms, 0) unique_violation_terms, coalesce(top3_violation_terms, '') top3_violation_terms
 from rates r left join modes m on m.entity = r.entity left join term_best b on b.entity = r.entity)"""


def kpis(select: str) -> str:
    """Key figures of the resolved entities; inspections without one don't count."""
    return entities(select, "merged", "ent as materialized (select entity_id entity, * exclude (entity_id) from merged where entity_id is not null)", KPIS)
