"""Schemas of the survey tables, in canonical names."""

_SITE = "county string, site_code int, name string"
_WATERSHEDS = "primary_watershed string, secondary_watershed string, watershed_code string"

SITES = (
    f"{_SITE}, {_WATERSHEDS}, assessment_date_raw string, surface_area_ha double, volume_m3 double, "
    "max_depth_m double, mean_depth_m double, area_under_6m_ha double, shoreline_dev double, "
    "easting double, northing double"
)
CATCHES = (
    f"{_SITE}, category string, alias string, {_WATERSHEDS}, captured_date_raw string, species_name string, "
    "easting double, northing double, captured_by string, notes string, origin string, effort double, "
    "effort_unit string, number_caught double, catch_per_unit_effort double, average_length_cm double, "
    "average_weight_g double, historical string"
)
RECORDS_UTM = "province string, location string, country string, year string, easting double, northing double, utm_zone string"
RECORDS_LONLAT = "system string, county string, year string, zone string, lat double, lon double"
DECISIONS = "record_id string, match_decision string, match_status_confirmed string"
OVERRIDES = "record_name string, site_name string, new_status string"
CROSSWALK = "from_name string, to_name string"
SPECIES_CODES = "species_code double, common_name string, scientific_name string"
CODED_SITES = "latitude double, longitude double, fish_species string"
EFFORT = "easting double, northing double, resample_count int"
SITE_LIST = (
    "group string, lake string, river string, site string, code string, latitude double, longitude double, date_raw string"
)
LAYER_GEOMETRY = "rings array<array<struct<x:double,y:double>>>, xmin double, ymin double, xmax double, ymax double"

# Columns of a catch that no analysis uses.
CATCH_NOTES = (
    "captured_by", "notes", "origin", "effort", "effort_unit", "number_caught", "catch_per_unit_effort",
    "average_length_cm", "average_weight_g", "historical",
)
