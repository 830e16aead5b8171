"""Lookup tables and names that decide results and therefore are stated as data."""

from __future__ import annotations

# --- Fixed values: canonical units per category, and the category of each variable -------------------
CANONICAL_UNITS = {
    "concentration": "g/L",
    "temperature": "C",
    "dissolved_oxygen": "%",
    "time": "h",
    "volume": "L",
    "ph": None,
}

VARIABLE_CATEGORY = {
    "dissolved_oxygen": "dissolved_oxygen",
    "ph": "ph",
    "temperature": "temperature",
    "biomass": "concentration",
    "glucose": "concentration",
    "volume": "volume",
    "lactate": "concentration",
    "ammonia": "concentration",
    "glutamine": "concentration",
    "glutamate": "concentration",
    "product_titer": "concentration",
}

# --- Fixed values: unit conversions as (from, to, subtract, multiply, divide); None = not possible ----
UNIT_CONVERSIONS = (
    ("mg/mL", "g/L", 0.0, 1.0, 1.0),
    ("mg/L", "g/L", 0.0, 1.0, 1000.0),
    ("g/mL", "g/L", 0.0, 1000.0, 1.0),
    ("ug/mL", "g/L", 0.0, 1.0, 1000.0),
    ("mol/L", "g/L", None, None, None),  # needs a molecular weight
    ("K", "C", 273.15, 1.0, 1.0),
    ("F", "C", 32.0, 5.0, 9.0),
    ("min", "h", 0.0, 1.0, 60.0),
    ("s", "h", 0.0, 1.0, 3600.0),
    ("mL", "L", 0.0, 1.0, 1000.0),
)

# --- Fixed values: unit strings of a unit row, and header suffixes ------------------------------------
KNOWN_UNITS = (
    "g/L", "mg/mL", "mg/L", "g/mL", "ug/mL", "mol/L", "K", "C", "F", "min", "h", "s", "mL", "L", "%",
    "pct", "rpm",
)

HEADER_SUFFIX_UNITS = {
    "g_L": "g/L",
    "mg_mL": "mg/mL",
    "mg_L": "mg/L",
    "g_mL": "g/mL",
    "ug_mL": "ug/mL",
    "K": "K",
    "C": "C",
    "F": "F",
    "min": "min",
    "h": "h",
    "s": "s",
    "mL": "mL",
    "L": "L",
    "pct": "%",
}

# --- Fixed values: questionable-value limits (warn, keep the row) -------------------------------------
QUESTIONABLE_RANGES = {
    "ph": (0.0, 14.0),
    "biomass": (0.0, None),
    "dissolved_oxygen": (0.0, None),
}

# --- Fixed values: variable vocabulary ----------------------------------------------------------------
VOCABULARY = {
    "dissolved_oxygen": ["DO", "dO2", "DO_%", "dissolved_oxygen", "pO2", "DO_sat", "DO_pct", "dissolved_O2"],
    "ph": ["pH", "PH", "ph_value", "pH_value"],
    "temperature": ["temp", "temperature", "T", "temp_C", "reactor_temp", "T_C", "temp_K", "jacket_temp"],
    "biomass": [
        "OD", "OD600", "optical_density", "cell_density", "biomass", "DCW", "dry_cell_weight", "OD_600",
    ],
    "glucose": ["glucose", "glc", "sugar", "carbon_source", "glucose_g_L", "Glc", "residual_glucose"],
    "volume": ["volume", "vol", "working_volume", "V", "reactor_volume", "vol_L"],
    "feed_rate": ["feed", "feed_rate", "feed_pump", "F_rate", "feed_flow"],
    "agitation": ["rpm", "agitation", "stirrer", "stir_speed", "RPM", "stirrer_speed"],
    "airflow": ["air", "airflow", "aeration", "vvm", "gas_flow", "air_flow", "sparge"],
    "lactate": ["lactate", "lac", "lactic_acid"],
    "ammonia": ["ammonia", "NH3", "NH4", "ammonium"],
    "glutamine": ["glutamine", "gln", "Gln"],
    "glutamate": ["glutamate", "glu", "Glu"],
    "viability": ["viability", "cell_viability", "viab", "viable_pct"],
    "product_titer": ["titer", "product", "mAb", "product_titer", "IgG"],
}
MATCH_THRESHOLD = 70

# --- Fixed values: time column names and elapsed-time suffixes ----------------------------------------
TIMESTAMP_NAMES = (
    "time", "timestamp", "datetime", "elapsed", "hours", "t", "time_h", "time_min", "elapsed_h", "elapsed_min",
)

# --- Fixed values: workbook sheet names, assay header words, metadata keys ----------------------------
METADATA_SHEETS = (
    "metadata", "info", "setup", "batch_info", "run_info", "batch_metadata", "experiment_info",
)
ASSAY_HEADERS = ("method", "uncertainty", "hplc", "lc-ms", "cell_count", "assay")
METADATA_KEYS = ("strain", "media", "scale_liters", "operator")

# --- Fixed values: default source mappings (source, target, unit) -------------------------------------
DEFAULT_MAPPINGS = {
    "influxdb": {
        "timestamp_field": "_time",
        "variables": [
            ("dissolved_oxygen", "dissolved_oxygen", "%"),
            ("ph", "ph", None),
            ("temperature", "temperature", "C"),
            ("agitation", "agitation_speed", "rpm"),
            ("optical_density", "optical_density", None),
        ],
        "metadata": {"reactor_id": "bioreactor_id"},
        "external_id_field": None,
    },
    "pi": {
        "timestamp_field": "timestamp",
        "variables": [
            ("DO", "dissolved_oxygen", "%"),
            ("PH", "ph", None),
            ("TEMP", "temperature", "C"),
            ("AGIT", "agitation_speed", "rpm"),
            ("OD600", "optical_density", None),
        ],
        "metadata": {"reactor_tag": "bioreactor_id"},
        "external_id_field": None,
    },
    "labvantage": {
        "timestamp_field": "analysis_date",
        "variables": [
            ("result_value", "assay_result", None),
            ("titer", "titer", "g/L"),
            ("viability", "viability", "%"),
            ("vcd", "viable_cell_density", "cells/mL"),
            ("glucose", "glucose", "g/L"),
        ],
        "metadata": {"sample_id": "lims_sample_id", "test_name": "assay_method"},
        "external_id_field": "sample_id",
    },
    "scinote": {
        "timestamp_field": "created_at",
        "variables": [
            ("titer", "titer", "g/L"),
            ("viability", "viability", "%"),
            ("cell_count", "viable_cell_density", "cells/mL"),
            ("optical_density", "optical_density", None),
            ("ph", "ph", None),
        ],
        "metadata": {"experiment_name": "eln_experiment_name", "task_name": "eln_task_name"},
        "external_id_field": "experiment_id",
    },
}

# --- Fixed values: detection defaults -----------------------------------------------------------------
MAX_SAMPLES = 10_000
NAN_GAP_LIMIT = 5
RATE_TOLERANCE = 0.10
VARIANCE_FLOOR = 1e-10

# --- Fixed values: roles, permissions and the permission each audit action needs ----------------------
ROLE_PERMISSIONS = {
    "viewer": ("read",),
    "editor": ("read", "write", "sign"),
    "admin": ("read", "write", "delete", "sign", "manage_users", "manage_roles"),
}
ACTION_PERMISSION = {"create": "write", "update": "write", "delete": "delete", "sign": "sign"}

# --- Fixed values: fields that may be empty for an action ---------------------------------------------
EMPTY_ALLOWED = {"create": ("old_value_hash",), "delete": ("new_value_hash",)}

# --- Fixed values: regulatory checklist (item, regulation, section, requirement, check, fields) -------
CHECKLIST = (
    ("CFR11-10d", "21_CFR_Part_11", "11.10(d)", "Limit system access to authorized individuals",
     "access_control", ()),
    ("CFR11-10e", "21_CFR_Part_11", "11.10(e)", "Secure, computer-generated, time-stamped audit trail",
     "audit_entry_format", ("entry_id", "timestamp", "user_id", "action", "entity_type", "entity_id")),
    ("CFR11-10f", "21_CFR_Part_11", "11.10(f)", "Operational system checks for sequencing",
     "hash_chain", ()),
    ("CFR11-10g", "21_CFR_Part_11", "11.10(g)", "Authority checks",
     "access_control", ()),
    ("CFR11-10k", "21_CFR_Part_11", "11.10(k)", "Audit trail for record changes",
     "field_completeness", ("old_value_hash", "new_value_hash", "user_id", "timestamp", "reason")),
    ("CFR11-50", "21_CFR_Part_11", "11.50", "Signature manifestation: name, date/time, meaning",
     "signature", ()),
    ("CFR11-70", "21_CFR_Part_11", "11.70", "Signatures linked to records",
     "signature", ()),
    ("CFR11-100", "21_CFR_Part_11", "11.100", "Unique to one individual",
     "access_control", ()),
    ("CFR11-200", "21_CFR_Part_11", "11.200", "Two identification components at signing",
     "signature", ()),
    ("AX11-9", "EU_Annex_11", "Clause 9", "Audit trail based on risk assessment",
     "audit_entry_format", ()),
    ("AX11-12.1", "EU_Annex_11", "Clause 12.1", "Security measures for data and changes",
     "hash_chain", ()),
    ("AX11-12.4", "EU_Annex_11", "Clause 12.4", "Audit trail available in intelligible form",
     "field_completeness", ()),
    ("AX11-14", "EU_Annex_11", "Clause 14", "Electronic signatures with same impact as handwritten",
     "signature", ()),
)
REGULATIONS = ("21_CFR_Part_11", "EU_Annex_11")
