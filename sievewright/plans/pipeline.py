"""The preparation pipeline: profile, clean, mine rules, detect and repair dependencies, resolve entities, rank them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators import charts, clean, dependencies, kpi, profile, repair, rules, star
from sievewright.roles import Roles
from sievewright.sources.tables import write_csv
from sievewright.storage import write_table


@dataclass
class Prepared:
    """Every result, lazy; cleaned, repaired and merged rows are tables in the shared folder, because several come from each."""

    profile: DataFrame
    mostly_null: DataFrame
    cleaned: DataFrame
    rules: DataFrame
    dependencies: DataFrame
    repaired: DataFrame
    repair_summary: DataFrame
    repair_log: DataFrame
    merged: DataFrame
    entities: DataFrame
    inspections: DataFrame
    kpis: DataFrame
    riskiest: DataFrame
    charts: dict[str, DataFrame]

    def write(self, folder: str) -> None:
        """The reports and tables as CSV folders: small reports in one file, rows in as many as there are tasks."""
        flat = lambda a: F.array_join(a, ", ")
        write_csv(self.profile, f"{folder}/profile", one_file=True)
        write_csv(self.rules.withColumns({c: flat(c) for c in ("antecedents", "consequents")}), f"{folder}/association_rules", one_file=True)
        write_csv(self.dependencies, f"{folder}/dependencies", one_file=True)
        write_csv(self.repair_summary, f"{folder}/repair_summary", one_file=True)
        write_csv(self.repair_log.withColumn("replaced_values", F.to_json("replaced_values")), f"{folder}/repair_log")
        write_csv(self.entities, f"{folder}/entities")
        write_csv(self.inspections, f"{folder}/inspections")
        write_csv(self.kpis, f"{folder}/entity_kpis")
        write_csv(self.riskiest, f"{folder}/high_risk", one_file=True)


def prepare(raw: DataFrame, roles: Roles = Roles(), compat: bool = False, min_support: float = rules.MIN_SUPPORT, min_confidence: float = rules.MIN_CONFIDENCE, top_rules: int = rules.TOP, min_inspections: int = 5, top_entities: int = 100) -> Prepared:
    """All steps over one raw table. Rows that several results read, and the small tables that steps apply, are written
    to the shared folder at once; the results themselves wait for an action."""
    raw = clean.default_license(raw, roles)
    report = profile.column_profile(raw)
    cleaned = write_table(clean.clean_inspections(raw, roles), "cleaned")
    found_rules = rules.association_rules(rules.transactions(cleaned, compat=compat, roles=roles), min_support, min_confidence, top_rules)
    fixed, summary, log = repair.repair_all(cleaned, roles=roles, compat=compat)
    repaired = write_table(repair.final_cleaning(fixed, roles), "repaired")
    merged, entities, inspections = star.structure(repaired, roles)
    kpis = kpi.entity_kpis(merged, roles, compat)
    return Prepared(report, profile.mostly_null(report), cleaned, found_rules, dependencies.detect(cleaned, roles), repaired, summary, log, merged, entities, inspections, kpis, kpi.riskiest(kpis, min_inspections, top_entities, roles), charts.chart_frames(repaired, roles, compat))
