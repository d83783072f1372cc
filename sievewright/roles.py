"""Which column plays which part: operators take names from here instead of assuming one dataset."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    """Column names of an inspection-shaped table. row_id orders the rows; it must be unique where order matters."""

    row_id: str = "inspection_id"
    name: str = "dba_name"
    alias: str = "aka_name"
    license: str = "license_no"
    category: str = "facility_type"
    risk: str = "risk"
    address: str = "address"
    city: str = "city"
    state: str = "state"
    zip: str = "zip"
    date: str = "inspection_date"
    kind: str = "inspection_type"
    result: str = "results"
    findings: str = "violations"
    terms: str = "violation_terms"
    lat: str = "latitude"
    lon: str = "longitude"
    location: str = "location"
    year: str = "inspection_year"
    month: str = "inspection_month"
    day: str = "inspection_day"
    entity: str = "entity_id"

    @property
    def key(self) -> list[str]:
        """The columns that tell the variants of an entity apart."""
        return [self.license, self.name, self.zip, self.lat, self.lon, self.category]

    @property
    def standard(self) -> list[str]:
        """The columns that get one value for each entity."""
        return [self.name, self.category, self.zip, self.lat, self.lon]


#: Names as published city inspection files spell them.
FILE_NAMES = Roles(
    row_id="Inspection ID", name="DBA Name", alias="AKA Name", license="License #", category="Facility Type", risk="Risk", address="Address",
    city="City", state="State", zip="Zip", date="Inspection Date", kind="Inspection Type", result="Results", findings="Violations",
    terms="Violation Terms", lat="Latitude", lon="Longitude", location="Location", year="Inspection Year", month="Inspection Month",
    day="Inspection Day", entity="Entity_ID",
)
