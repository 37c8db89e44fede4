"""Study constants: boxes, species tables, thresholds, bin edges and weights."""

from __future__ import annotations

from typing import NamedTuple


class Box(NamedTuple):
    south: float
    north: float
    west: float
    east: float


# --- fixed values: study boxes, windows and grid steps ---
TRAIN_BOX = Box(south=-39.0, north=-27.0, west=148.5, east=158.5)
PREDICT_BOX = Box(south=-36.5, north=-32.0, west=150.5, east=154.5)
EXTENDED_BOX = Box(south=-44.5, north=-25.0, west=145.0, east=160.5)
FULL_START = "2002-06-01"
FIRST_RUN_START = "2015-01-01"
FIRST_RUN_END = "2025-12-31"
CELL_DEG = 0.05
FINE_CELL_DEG = 0.005
WEATHER_CELL_DEG = 0.5
BACKGROUND_RATIO = 10
TRAINABLE_RECORDS = 300
LOW_CONFIDENCE_RECORDS = 100
UNCERTAINTY_LIMIT_M = 10_000.0
UNCERTAINTY_HIGH_QUALITY_M = 1_000.0
MATCH_DISTANCE_LIMIT_KM = 10.0
LANDMARK = (-34.05, 151.8)
FAD_TYPE = "fad_demo"

# --- fixed values: temporal split cuts ---
TRAIN_UNTIL = "2020-12-31"
VALIDATION_UNTIL = "2022-12-31"

# --- fixed values: audit limits ---
SATURATION_LIMIT_PCT = 20.0
CLIPPING_LIMIT_PCT = 5.0
SHALLOW_SHARE_LIMIT = 0.4
DEFAULT_MIN_DEPTH_M = 50.0
MIN_DEPTH_M = {"yellowfin_tuna": 50.0, "mahi_mahi": 30.0, "striped_marlin": 100.0}
DEFAULT_DISPLAY_DEPTH_M = 5.0
DISPLAY_DEPTH_M = {"mahi_mahi": 8.0, "southern_bluefin_tuna": 50.0, "yellowtail_kingfish": 5.0}
BACKGROUND_RATIOS = (3, 5, 10)
BACKGROUND_STRATEGIES = (
    "random_ocean_background",
    "offshore_constrained_background",
    "target_group_background",
    "environment_stratified_background",
    "spatial_buffered_background",
)
AUDIT_WARNING = "Model under audit: nearshore saturation detected. Do not use as real prediction."
AUDIT_STATUS = "under_audit_nearshore_saturation_detected"

# --- fixed values: export limits by rating ---
EXPORT_LIMITS = {"Prime": 5000, "Good": 6000, "Possible": 8000, "Low": 5000}

# --- fixed values: modelled species (id, scientific name, common name) ---
MODELLED_SPECIES = (
    ("yellowfin_tuna", "Thunnus albacares", "Yellowfin Tuna"),
    ("mahi_mahi", "Coryphaena hippurus", "Mahi Mahi / Dolphinfish"),
    ("striped_marlin", "Kajikia audax", "Striped Marlin"),
    ("southern_bluefin_tuna", "Thunnus maccoyii", "Southern Bluefin Tuna"),
    ("yellowtail_kingfish", "Seriola lalandi", "Yellowtail Kingfish"),
)

# --- fixed values: right-closed bin edges, None = open end ---
DEPTH_BINS = (None, 0, 20, 50, 100, 200, 500, 1000, None)
SHELF_BINS = (None, 5, 20, 50, 100, 200, None)
COAST_BINS = (None, 10, 25, 50, 100, 200, None)
CONTRAST_DEPTH_BINS = (-1, 20, 50, 100, 200, 500, 1000, 2000, 7000)
STRATUM_DEPTH_BINS = (-1, 50, 100, 200, 500, 1000, 5000)
STRATUM_SHELF_BINS = (-1, 5, 20, 50, 100, 200, 10000)
DISTANCE_BAND_EDGES = (-0.1, 20, 50, 100, 1000)
DISTANCE_BAND_NAMES = (
    "nearshore_0_20km",
    "mid_20_50km",
    "offshore_50_100km",
    "far_offshore_100km_plus",
)
FOCUS_WEIGHTS = (1.0, 0.9, 0.68, 0.48)
FOCUS_WEIGHT_UNKNOWN = 0.75
CONTRAST_WEIGHTS = {"coast": 0.58, "depth": 0.20, "overall": 0.12, "front": 0.06, "current": 0.04}

# --- fixed values: coastline knots (lat, lon), south to north ---
COAST_KNOTS = ((-36.5, 150.72), (-35.1, 150.78), (-34.2, 151.16), (-33.6, 151.34), (-32.0, 151.82))
KM_PER_DEGREE = 111.32
AUDIT_COAST_LON = 150.5
AUDIT_KM_PER_DEGREE = 92.0

# --- fixed values: lunar calendar ---
SYNODIC_MONTH_DAYS = 29.530588853
REFERENCE_NEW_MOON = "2000-01-06"

# --- fixed values: rule score weights and per-species replacements ---
RULE_WEIGHTS = {
    "sst": 0.22, "front": 0.14, "current": 0.10, "bathy": 0.10, "structure": 0.13,
    "fad": 0.06, "shelf_canyon": 0.09, "season": 0.08, "chlorophyll": 0.04, "eddy": 0.04,
}
RULE_WEIGHT_CHANGES = {
    "mahi_mahi": {"fad": 0.18, "structure": 0.14, "shelf_canyon": 0.03, "bathy": 0.06},
    "offshore_kingfish": {"structure": 0.22, "current": 0.13, "fad": 0.02, "bathy": 0.13},
    "blue_marlin": {"sst": 0.25, "bathy": 0.14, "front": 0.10},
}
RULE_COMPONENT_NAMES = {
    "sst": "SST suitability",
    "front": "SST front / gradient",
    "current": "Current edge",
    "bathy": "Bathymetry / depth class",
    "structure": "POI structure",
    "fad": "FAD proximity",
    "shelf_canyon": "Shelf/canyon proximity",
    "season": "Season/month",
    "chlorophyll": "Chlorophyll edge placeholder",
    "eddy": "SLA / eddy placeholder",
}
SEASON_SCORES = {"prime": 100.0, "good": 78.0, "possible": 52.0, "low": 25.0}
SEASON_UNKNOWN = 50.0

# --- fixed values: rule-scored species ---
RULE_PROFILES = (
    ("yellowfin_tuna", "Yellowfin Tuna", (20.0, 24.5), (17.5, 27.0),
     ("shelf_break", "deep", "very_deep"), ("shelf_break", "canyon", "offshore_bank"),
     {"Jan": "good", "Feb": "good", "Mar": "prime", "Apr": "prime", "May": "prime", "Jun": "good",
      "Jul": "possible", "Aug": "possible", "Sep": "possible", "Oct": "good", "Nov": "good", "Dec": "good"}),
    ("southern_bluefin_tuna", "Southern Bluefin Tuna", (14.0, 18.5), (11.5, 21.0),
     ("shelf_break", "deep", "very_deep"), ("shelf_break", "canyon", "current_edge"),
     {"Jan": "low", "Feb": "low", "Mar": "possible", "Apr": "possible", "May": "good", "Jun": "prime",
      "Jul": "prime", "Aug": "prime", "Sep": "good", "Oct": "possible", "Nov": "low", "Dec": "low"}),
    ("striped_marlin", "Striped Marlin", (20.0, 24.0), (18.0, 26.0),
     ("shelf_break", "deep"), ("shelf_break", "current_edge", "offshore_bank"),
     {"Jan": "prime", "Feb": "prime", "Mar": "prime", "Apr": "good", "May": "possible", "Jun": "low",
      "Jul": "low", "Aug": "low", "Sep": "possible", "Oct": "good", "Nov": "good", "Dec": "prime"}),
    ("blue_marlin", "Blue Marlin", (23.0, 27.0), (20.5, 29.0),
     ("deep", "very_deep"), ("current_edge", "seamount", "offshore_bank"),
     {"Jan": "prime", "Feb": "prime", "Mar": "prime", "Apr": "good", "May": "possible", "Jun": "low",
      "Jul": "low", "Aug": "low", "Sep": "possible", "Oct": "good", "Nov": "good", "Dec": "prime"}),
    ("mahi_mahi", "Mahi Mahi / Dolphinfish", (22.0, 27.0), (19.5, 29.0),
     ("shelf", "shelf_break", "deep"), ("fad_demo", "current_edge", "floating_structure"),
     {"Jan": "prime", "Feb": "prime", "Mar": "prime", "Apr": "good", "May": "possible", "Jun": "low",
      "Jul": "low", "Aug": "low", "Sep": "possible", "Oct": "good", "Nov": "good", "Dec": "prime"}),
    ("offshore_kingfish", "Offshore Yellowtail Kingfish", (18.0, 22.5), (15.0, 25.0),
     ("shelf", "shelf_break"), ("reef", "seamount", "ridge", "offshore_bank"),
     {"Jan": "good", "Feb": "good", "Mar": "good", "Apr": "good", "May": "possible", "Jun": "possible",
      "Jul": "possible", "Aug": "possible", "Sep": "good", "Oct": "good", "Nov": "good", "Dec": "good"}),
    ("longtail_tuna", "Longtail Tuna", (22.0, 27.0), (19.0, 29.0),
     ("shelf", "shelf_break"), ("current_edge", "harbour_departure", "fad_demo"),
     {"Jan": "prime", "Feb": "prime", "Mar": "good", "Apr": "good", "May": "possible", "Jun": "low",
      "Jul": "low", "Aug": "low", "Sep": "possible", "Oct": "good", "Nov": "good", "Dec": "prime"}),
)
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# --- fixed values: model feature names ---
MINIMUM_FEATURES = (
    "sst_c", "sst_gradient", "sst_front_strength", "sst_3d_change", "sst_7d_change",
    "depth_m", "slope",
    "distance_to_200m_contour", "distance_to_500m_contour", "distance_to_1000m_contour",
    "distance_to_shelf_break",
    "month_sin", "month_cos", "day_of_year_sin", "day_of_year_cos",
)
OPTIONAL_FEATURES = (
    "current_speed", "current_direction_degrees", "current_edge_score", "zos", "sla_gradient",
    "eddy_score", "chl_log", "chl_gradient", "chl_edge_score",
    "distance_to_nearest_fad_km", "distance_to_browns_mountain_km", "distance_to_nearest_poi_km",
    "moon_age_days", "moon_phase_fraction", "moon_illumination", "moon_phase_sin", "moon_phase_cos",
    "surface_pressure_hpa_mean", "surface_pressure_hpa_min", "surface_pressure_hpa_max",
    "pressure_msl_hpa_mean", "wind_speed_10m_kmh_mean", "wind_speed_10m_kmh_max",
    "precipitation_mm_sum", "wind_direction_10m_deg_circular_mean",
    "o2", "dissolved_oxygen", "oxygen_saturation",
)
FLAG_FEATURES = (
    "has_sst", "has_bathymetry", "has_physics", "has_chl", "has_structure", "has_lunar",
    "has_weather", "has_oxygen",
    "sst_missing_flag", "physics_missing_flag", "chl_missing_flag", "oxygen_missing_flag",
)
COORDINATE_FEATURES = ("grid_lat", "grid_lon")
CURRENT_FEATURES = (
    "uo", "vo", "current_speed", "current_direction_degrees", "current_edge_score", "zos",
    "sla_gradient", "eddy_score",
)
NULL_MODEL_FEATURES = {
    "coordinates_only_null_model": COORDINATE_FEATURES,
    "month_only_null_model": ("month_sin", "month_cos", "day_of_year_sin", "day_of_year_cos"),
    "depth_distance_only_null_model": (
        "depth_m", "slope", "distance_to_200m_contour", "distance_to_500m_contour",
        "distance_to_1000m_contour", "distance_to_shelf_break",
    ),
    "sst_bathy_season_only": (
        "sst_c", "sst_gradient", "sst_front_strength", "depth_m", "slope",
        "month_sin", "month_cos", "day_of_year_sin", "day_of_year_cos",
    ),
}

# --- fixed values: provenance columns ---
PROVENANCE_COLUMNS = (
    "dataset_name", "source_name", "source_url_or_access_method", "download_date", "spatial_bbox",
    "time_range", "variables", "raw_file_path", "processed_file_path", "estimated_size_mb",
    "actual_size_mb", "license_or_terms_note", "used_for_training", "notes",
)
