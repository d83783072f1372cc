import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievewright.functions import text as t
from sievewright.operators import charts, clean, dependencies, entity, impute, kpi, modes, profile, repair, rules, star
from sievewright.plans import pipeline
from sievewright.plans.inspections import inspections
from sievewright.roles import FILE_NAMES, Roles
from sievewright.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def insp(spark):
    return inspections(spark, SF).cache()


@pytest.fixture(scope="module")
def cleaned(insp):
    return clean.clean_inspections(insp).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_profile_of_small_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (2, None, None)], "n int, t string, e double")
    assert tuple(profile.overview(df).collect()[0]) == (3, 3)
    got = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert (got["n"]["unique_values"], got["t"]["null_values"], got["t"]["null_percentage"]) == (2, 1, 33.33)
    assert got["t"]["value_distribution"] == "a: 2\nNaN: 1" and got["e"]["value_distribution"] == "NaN: 3" and got["n"]["mean"] == pytest.approx(5 / 3)
    many = spark.range(50).select(F.col("id").cast("double").alias("x"))
    assert profile.column_profile(many).collect()[0]["value_distribution"] == "Range: [0.00, 49.00], Mean: 24.50, Std: 14.58"
    assert [r["column"] for r in profile.mostly_null(profile.column_summary(df)).collect()] == ["e"]
    none = profile.column_profile(df.limit(0)).collect()
    assert len(none) == 3 and all(r["value_distribution"] == "No data" and r["null_percentage"] is None for r in none)
    assert rows(profile.missing_percentage(df, compat_text=True))[-1] == ("t", 0.0)
    assert profile.category_distribution(df, "gone") is None
    assert [tuple(r) for r in profile.category_distribution(df, "t").collect()] == [("a", 2), ("MISSING", 1)]


def test_profiles_take_one_row_a_value(spark, insp):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (profile.column_summary(insp), profile.column_profile(insp)):
        assert "Expand" not in plan(df)
    numbers = profile.column_profile(insp).select("column", "least", "most", "mean", "deviation")
    assert "Window" not in plan(numbers) and "Generate explode" in plan(numbers)
    odd = spark.createDataFrame([(0.0, ["a, b"], "0.0"), (-0.0, ["a", "b"], "-0.0"), (float("nan"), None, "NaN"), (float("nan"), ["a", "b"], None), (None, ["a, b"], "NaN")], "x double, a array<string>, t string")
    want = [("x", "float64", 2, 1, 20.0), ("a", "object", 2, 1, 20.0), ("t", "object", 3, 1, 20.0)]
    assert [tuple(r) for r in profile.column_summary(odd).collect()] == want
    assert [tuple(r)[:5] for r in profile.column_profile(odd).collect()] == want


def test_cleaning_keeps_unparseable_numbers_as_null(spark):
    base = {"inspection_id": 1, "license_no": "5", "zip": "60601", "inspection_type": "C", "risk": "Risk 1 (High)", "inspection_date": "02/03/2021", "violations": "1. A B", "facility_type": None, "city": "x", "state": "y", "location": "z"}
    changes = [{}, {"zip": "x"}, {"zip": None}, {"license_no": "0"}, {"license_no": "x"}, {"license_no": None}, {"risk": "All"}, {"risk": None}, {"inspection_type": None}]
    df = spark.createDataFrame([{**base, **ch, "inspection_id": i} for i, ch in enumerate(changes)], ", ".join(f"{k} {'bigint' if k == 'inspection_id' else 'string'}" for k in base))
    got = {r["inspection_id"]: r for r in clean.clean_inspections(df).collect()}
    assert set(got) == {0, 1, 4} and got[1]["zip"] is None and got[4]["license_no"] is None
    assert got[0]["facility_type"] == "Others" and got[0]["violation_terms"] == "1" and got[0]["inspection_month"] == 2
    assert not {"city", "state", "location", "inspection_date"} & set(clean.clean_inspections(df).columns)
    odd = ["Infinity", "1e30", "60601.7", "-inf", "6060x", "nan", "", " 60601 ", "9223372036854775807"]
    whole = [None, None, 60601, None, None, None, None, 60601, 9223372036854775807]
    many = spark.createDataFrame([{**base, "inspection_id": i, "zip": v, "license_no": v} for i, v in enumerate(odd)], df.schema)
    assert [(r["zip"], r["license_no"]) for r in clean.clean_inspections(many).orderBy("inspection_id").collect()] == [(x, x) for x in whole]
    assert [r["zip"] for r in repair.normalise_texts(many).orderBy("inspection_id").collect()] == [None if x is None else str(x) for x in whole]
    assert clean.default_license(df.where("license_no is null")).collect()[0]["license_no"] == "0"


def test_cleaning_is_one_narrow_stage(cleaned, insp):
    plan = clean.clean_inspections(insp.sparkSession.createDataFrame([], insp.schema))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_names_with_blanks_and_signs(spark, insp):
    named = insp.toDF(*[getattr(FILE_NAMES, next(k for k, v in vars(Roles()).items() if v == c)) for c in insp.columns])
    a, b = clean.clean_inspections(named, FILE_NAMES), clean.clean_inspections(insp)
    assert rows(a) == rows(b)
    assert rows(impute.final_cleaning(repair.repair_all(a, roles=FILE_NAMES)[0], FILE_NAMES)) == rows(impute.final_cleaning(repair.repair_all(b)[0]))
    assert rows(entity.resolve(a, roles=FILE_NAMES)) == rows(entity.resolve(b))


@pytest.mark.parametrize("values, first, unique, smallest", [("bbaa", "b", None, "a"), ("a", "a", None, "a"), ("aab", "a", "a", "a"), ("cab", "c", None, "a")])
def test_modes(spark, values, first, unique, smallest):
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(values)] + [(90, 1, None), (91, None, "z")], "id int, k int, v string")
    of = lambda **kw: next((r["v"] for r in modes.group_mode(df, ["k"], ["v"], **kw).collect()), None)
    assert (of(tie="first", order="id"), of(tie="unique", min_count=2), of(tie="smallest")) == (first, unique, smallest)
    with pytest.raises(ValueError):
        modes.group_mode(df, ["k"], ["v"], tie="first")


def test_pair_mode_fills_each_coordinate(spark):
    df = spark.createDataFrame([(1, "z", 1.0, 2.0), (2, "z", 1.0, 2.0), (3, "z", None, 9.0), (4, "z", 5.0, None), (5, None, None, None)], "inspection_id int, zip string, latitude double, longitude double")
    assert rows(impute.fill_place_by_zip(df).select("inspection_id", "latitude", "longitude")) == [(1, 1.0, 2.0), (2, 1.0, 2.0), (3, 1.0, 9.0), (4, 5.0, 2.0), (5, None, None)]


def test_dependency_measures(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", None), (None, 7)], "l string, r int")
    assert dependencies.fd_confidence(df, "l", "r").collect()[0]["confidence"] == 0.6667
    got = dependencies.discover(df, ["l"], ["r", "l"]).collect()
    assert [tuple(r) for r in got] == [("l", "r", 2, 1, 50.0, 50.0, False)]
    assert dependencies.fd_confidence(df.limit(0), "l", "r").collect()[0]["confidence"] is None
    assert dependencies.fd_confidence(df.limit(0), "l", "r", empty=0.0).collect()[0]["confidence"] == 0.0
    assert dependencies.discover(df, ["x"], ["y"]).count() == 0 and dependencies.confidence_ranking(df, [("x", "y")]) is None
    assert dependencies.fd_confidence(df, ["l", "r"], "r").collect()[0]["confidence"] == 1.0


def test_discovery_shuffles_once_a_left_side(spark):
    df = spark.createDataFrame([(1, "a", "b", "c")], "license_no int, risk string, zip string, address string")
    plan = dependencies.discover(df, ["license_no"], ["risk", "zip", "address"], ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_repair(spark):
    df = spark.createDataFrame([(1, "k", "x"), (2, "k", "x"), (3, "k", "y"), (4, "k", None), (5, None, "q"), (6, "m", "1"), (7, "m", "2"), (8, "m", "3"), (9, "m", "4"), (10, "t", "b"), (11, "t", "a"), (12, "n", None), (13, "n", "z")], "inspection_id int, l string, r string")
    fixed, log = repair.repair_fd(df, "l", "r")
    assert [r["r"] for r in fixed.orderBy("inspection_id").collect()] == ["x", "x", "x", "x", "q", "1", "2", "3", "4", "b", "b", None, "z"]
    assert rows(log) == [("l -> r", "k", "r", "x", {"y": 1}, 2), ("l -> r", "t", "r", "b", {"a": 1}, 1)]
    again, log = repair.repair_fd(fixed, "l", "r", cut=True)
    assert rows(again) == rows(fixed) and log.count() == 0


def test_repair_never_lowers_confidence(cleaned):
    _, summary, log = repair.repair_all(cleaned)
    got = summary.collect()
    assert len(got) == 5 and all(r["confidence_after"] >= r["confidence_before"] for r in got)
    assert sum(r["rows_repaired"] for r in got) == sum(r["rows_repaired"] for r in log.collect())
    out = repair.normalise_texts(cleaned.limit(1).withColumn("zip", F.lit(None).cast("bigint")), compat=True).collect()[0]
    assert out["zip"] == "<NA>"


def test_transactions(spark):
    df = spark.createDataFrame([(1, " Cafe ", None, "Pass", "1, 3"), (2, None, "", "Fail", "0"), (3, None, None, None, "['2','2']"), (4, None, None, "Pass", "nan"), (5, None, None, None, "[4,5]")], "id int, facility_type string, risk string, results string, violation_terms string")
    got = dict(rows(rules.transactions(df, keep=("id",))))
    assert got == {1: ["Facility Type=Cafe", "Results=Pass", "Violation=1", "Violation=3"], 2: ["Results=Fail"], 3: ["Violation=2"], 4: ["Results=Pass"], 5: ["Violation=4", "Violation=5"]}
    assert set(dict(rows(rules.transactions(df, keep=("id",), compat=True)))) == {1, 2, 3, 5}


def test_rules_against_brute_force(spark):
    baskets = [set("abc"), set("abd"), set("ab"), set("bcd"), set("abcd"), set("d"), set()]
    got = rules.association_rules(spark.createDataFrame([(sorted(b),) for b in baskets], "items array<string>"), 0.25, 0.5, None).collect()
    n, support = len(baskets), Counter(s for b in baskets for k in range(1, 5) for s in itertools.combinations(sorted(b), k))
    want = {}
    for s, f in support.items():
        if f / n >= 0.25 and len(s) > 1:
            for k in range(1, len(s)):
                for a in itertools.combinations(s, k):
                    c = tuple(x for x in s if x not in a)
                    if f / support[a] >= 0.5:
                        want[a, c] = (f / n, f / support[a], f / support[a] / (support[c] / n))
    assert {(tuple(r[0]), tuple(r[1])): pytest.approx(tuple(r)[2:]) for r in got} == want
    assert [r["lift"] for r in got] == sorted((r["lift"] for r in got), reverse=True)
    assert any(len(r["consequents"]) > 1 for r in got)
    assert rules.association_rules(spark.createDataFrame([], "items array<string>")).count() == 0


def test_clusters_against_union(spark):
    keys = spark.createDataFrame([("L", i, 6) for i in range(6)] + [("M", i, 3) for i in range(3)] + [("S", 0, 1)], "license_no string, node int, diff_info_cnt int")
    edges = spark.createDataFrame([("L", 4, 5), ("L", 1, 4), ("L", 0, 2)], "license_no string, i int, j int")
    got = {(r["license_no"], r["node"]): (r["component"], r["seq"]) for r in entity.clusters(keys, edges).collect()}
    assert got == {("L", 0): (0, 2), ("L", 2): (0, 2), ("L", 1): (1, 1), ("L", 4): (1, 1), ("L", 5): (1, 1), ("L", 3): (3, 3), ("M", 0): (0, 1), ("M", 1): (1, 2), ("M", 2): (2, 3)}


def test_edges_stay_inside_entities_and_prefilter_drops_none(cleaned):
    keys = entity.union_keys(cleaned)
    every = entity.pair_scores(keys).where("score >= 0.5").select("license_no", "i", "j", "score")
    assert rows(every) == rows(entity.pair_scores(keys, threshold=0.5).select("license_no", "i", "j", "score"))
    some = cleaned.dropna(subset=Roles().key)
    assert keys.agg(F.sum("cnt")).collect()[0][0] == some.count()


def test_links_connect_what_pairs_connect(spark, cleaned):
    keys = entity.union_keys(cleaned).localCheckpoint()
    links = entity.links(keys).localCheckpoint()
    assert rows(entity.clusters(keys, links)) == rows(entity.clusters(keys, entity.pair_scores(keys, threshold=0.5)))
    assert rows(entity.links(keys, threshold=0.7)) == rows(entity.pair_scores(keys, threshold=0.7).select("license_no", "i", "j"))
    made = [(7, n, z, la, lo, "bar") for n, z, la, lo in itertools.product(["A B", "a-b", "A B INC", "ZZZZZZ", "", "-", "QX QX QX"], [60601, 60602], [41.5, 41.9], [-87.7])]
    many = entity.union_keys(spark.createDataFrame(made, "license_no bigint, dba_name string, zip bigint, latitude double, longitude double, facility_type string")).localCheckpoint()
    got = entity.links(many)
    assert rows(entity.clusters(many, got)) == rows(entity.clusters(many, entity.pair_scores(many, threshold=0.5)))
    assert got.count() <= 7 * 6 / 2 + len(made) < entity.pair_scores(many, threshold=0.5).count()  # a star a name, a link two names


def test_joins_that_are_not_used_are_not_made(spark, cleaned):
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")
    fixed = repair.repair_all(cleaned)[0]
    assert joins(fixed) == 5 and joins(fixed.select("inspection_id", "risk")) == 1 and joins(fixed.select("inspection_id", "dba_name")) == 0
    filled = impute.final_cleaning(cleaned)
    assert joins(filled.select("facility_type")) < joins(filled)


def test_star_keys(cleaned):
    merged, dim, fact = star.structure(cleaned)
    assert fact.count() == cleaned.count() == merged.count()
    ids = [r[0] for r in dim.select("restaurant_id").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1)) and "entity_id" not in dim.columns
    assert fact.join(dim, "restaurant_id", "left_anti").count() == 0
    assert sorted(r[0] for r in fact.select("inspection_no").collect()) == list(range(1, cleaned.count() + 1))
    small = star.inspection_table(merged, star.entity_table(merged), bucket_rows=7)
    assert rows(small) == rows(fact)


def test_risk_index_by_hand(spark):
    df = spark.createDataFrame([(1, "e", "Fail", "risk 1 (HIGH)", "1,1,2", 2020), (2, "e", "Pass", "Risk 3 (Low)", "0", 2021), (3, "q", "No Entry", None, None, 2020), (4, None, "Pass", None, "5", 2020), (5, " ", "Pass", None, "5", 2020)], "inspection_id int, entity_id string, results string, risk string, violation_terms string, inspection_year int")
    got = {r["entity_id"]: r for r in kpi.entity_kpis(df).collect()}
    assert set(got) == {"e", "q"}
    e, q = got["e"], got["q"]
    assert (e["risk_index"], e["total_violations"], e["unique_violation_terms"], e["top3_violation_terms"], e["risk1_high_count"], e["inspection_years"]) == (pytest.approx(0.45 * 0.5 + 0.3 * 0.5 + 0.15), 3, 2, "1(2); 2(1)", 1, 2)
    assert q["risk_index"] == pytest.approx(0.1) and q["pass_rate_evaluated"] is None and q["top3_violation_terms"] == ""
    literal = {r["entity_id"]: r for r in kpi.entity_kpis(df, compat=True).collect()}
    assert set(literal) == {"e", "q", "nan"} and literal["e"]["risk1_high_count"] == 0
    assert [r["entity_id"] for r in kpi.riskiest(kpi.entity_kpis(df), 1).collect()] == ["e", "q"] and kpi.riskiest(kpi.entity_kpis(df), 5).count() == 0


def test_details_of_the_riskiest_alone(cleaned, monkeypatch):
    merged = star.structure(cleaned)[0].localCheckpoint()
    want = [tuple(r) for r in kpi.riskiest(kpi.entity_kpis(merged), 2, 7).collect()]
    seen = []
    terms = kpi.frequent_terms
    monkeypatch.setattr(kpi, "frequent_terms", lambda rows, roles: seen.append(rows.select("entity_id").distinct().count()) or terms(rows, roles))
    got = kpi.riskiest_entities(merged, 2, 7)
    assert [tuple(r) for r in got.collect()] == want and len(want) == 7 and seen == [7]
    assert kpi.riskiest_entities(merged, 10**6).count() == 0


def test_terms_are_not_worked_out_to_filter_by_them(spark):
    df = spark.createDataFrame([(1, "e", "1,1,2"), (2, "e", "0"), (3, "q", None)], "inspection_id int, entity_id string, violation_terms string")
    got = kpi.frequent_terms(df.withColumn("__terms", t.parsed_terms(F.col("violation_terms"))))
    assert rows(got) == [("e", 2, "1(2); 2(1)")] and "Filter (size(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_pipeline_end_to_end(spark, insp, tmp_path):
    p = pipeline.prepare(insp)
    assert p.profile.count() == len(insp.columns) and p.rules.count() <= 50 and p.dependencies.count() == 38
    assert p.kpis.agg(F.sum("total_inspections")).collect()[0][0] == p.merged.where("entity_id is not null").count()
    assert p.riskiest.count() <= 100 and set(p.charts) >= {"missing_value_percentage", "fd_confidence_ranking", "category_distribution_results"}
    assert p.repaired.where("latitude is null or longitude is null or zip is null").count() == 0
    p.write(str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 9
    assert tables.read_csv(spark, str(tmp_path / "inspections")).count() == p.inspections.count()
    assert tables.read_csv(spark, str(tmp_path / "association_rules")).columns == p.rules.columns


def test_pictures(insp, tmp_path):
    pytest.importorskip("matplotlib")
    assert len(charts.draw(charts.chart_frames(insp), str(tmp_path))) == 6
