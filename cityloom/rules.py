"""Thresholds, class tables and code tables that results depend on."""

from __future__ import annotations

# Storey height assumed when a height is turned into floors, and the height that marks a supertall building.
METERS_PER_FLOOR = 4.0
SUPERTALL_HEIGHT_M = 160
IOU_MIN = 0.30
IOU_STRICT = 0.70
RESIDENTIAL_FLOOR_CUTOFF = 10
MATCH_TOLERANCE_M = 10.0
SUPERTALL_FLOORS = 40

# POI signals: code prefix, largest distance, and the parcel classes the hit building must lie in (if any).
MALL_RULES = [{"prefix": "0601", "max_dist": 150.0, "classes": None}]
HOTEL_RULES = [
    {"prefix": "1001", "max_dist": 150.0, "classes": None},
    {"prefix": "1002", "max_dist": 150.0, "classes": [1, 2]},
]
MIXED_USE_CLASS = 1

# Parcel class -> label (None: not labelled by land use).
CLASS_LABELS = {
    0: "residential",
    1: "office",
    2: None,
    3: None,
    4: "transportation",
    5: "transportation",
    6: "government_office",
    7: "education",
    8: "healthcare",
    9: "sport_culture",
    10: None,
}
# Labels that stand for several true labels.
BUNDLES = {"sport_culture": ["sports", "culture"]}
PROFILE_CLASSES = {3: "industrial", 10: "park_greenspace"}

# Storey-height bands by floor count (both ends included).
FLOOR_BANDS = [(1, 3, "1-3"), (4, 6, "4-6"), (7, 9, "7-9"), (10, 18, "10-18"), (19, 30, "19-30"), (31, 39, "31-39")]
ANOMALY_FLOORS = (7, 12)
OBSERVED_FLOOR_EDGES = [0, 3, 6, 12, 30, 200]
OBSERVED_FLOOR_LABELS = ["1-3", "4-6", "7-12", "13-30", ">30"]

# POI code table: exact six-digit codes, then four-digit groups, then two-digit groups; "skip" gives no vote.
POI_SUB_CODES = {"120203": "mixed_use", "120303": "residential", "120304": "government_office"}
POI_MID_CODES = {
    "120100": "office",
    "120200": "office",
    "120300": "residential",
    "160300": "skip",
    "060100": "shopping_mall",
    "060300": "shopping_mall",
    "060400": "shopping_mall",
    "060500": "shopping_mall",
    "060600": "shopping_mall",
    "060700": "shopping_mall",
    "060200": "skip",
    "060800": "skip",
    "060900": "skip",
    "061000": "skip",
    "061100": "skip",
    "061200": "skip",
    "061300": "skip",
    "061400": "skip",
    "080100": "sports",
    "080200": "sports",
    "080300": "skip",
    "080400": "hotel",
    "080500": "skip",
    "080600": "culture",
    "140100": "culture",
    "140200": "exhibition",
    "140300": "exhibition",
    "140400": "culture",
    "140500": "culture",
    "140600": "culture",
    "140700": "culture",
    "140800": "culture",
    "140900": "culture",
    "141000": "culture",
    "141100": "office",
    "141200": "education",
    "141300": "education",
    "141400": "skip",
    "141500": "skip",
    "150100": "transportation",
    "150200": "transportation",
    "150300": "transportation",
    "150400": "transportation",
    "150500": "transportation",
    "150600": "transportation",
    "150700": "skip",
    "150800": "skip",
    "150900": "skip",
    "151000": "transportation",
    "151100": "skip",
    "151200": "transportation",
    "151300": "transportation",
}
POI_BIG_CODES = {
    "010000": "skip",
    "020000": "skip",
    "030000": "skip",
    "040000": "skip",
    "050000": "skip",
    "060000": "skip",
    "070000": "skip",
    "080000": "skip",
    "090000": "healthcare",
    "100000": "hotel",
    "110000": "skip",
    "120000": "other_public",
    "130000": "government_office",
    "140000": "skip",
    "150000": "skip",
    "160000": "office",
    "170000": "office",
    "180000": "skip",
    "190000": "skip",
    "200000": "skip",
    "220000": "skip",
    "970000": "skip",
    "990000": "skip",
}

# Scan of POI cells.
DENSE_CLASSES = [1, 2]
TARGET_CLASSES = [0, 1, 2]
AREA_THRESHOLDS_HA = [5, 8, 10]
REQUEST_BUFFER = 1.12
REQUEST_RESERVE = 150

# Same-model rule and window sampling.
AREA_REL_TOL = 0.05
HEIGHT_ABS_TOL_M = 0.5
DISTANCE_TOL_M = 250.0
KEEP_PER_CLUSTER = 3
MIN_FOOTPRINT_M2 = 100.0
HALFWIDTH_STEP_M = 300
MAX_HALFWIDTH_M = 3000
SAMPLE_SEED = 42
# key, latitude, longitude, first half-width, rows wanted
WINDOWS = [
    ("lujiazui", 31.238, 121.501, 800, 40),
    ("xujiahui", 31.194, 121.436, 800, 40),
    ("xinzhuang", 31.116, 121.385, 800, 40),
    ("zhangjiang", 31.203, 121.604, 900, 40),
    ("lingang", 30.912, 121.918, 1500, 40),
]
HIDDEN_COLUMNS = [
    "height",
    "height_m",
    "estimated_floor",
    "storeys_pred",
    "archetype",
    "archetype_pred",
    "predicted_type",
]

# Features and model.
NEIGHBOUR_RADIUS_M = 100.0
ASPECT_MIN_SIDE_M = 0.5
MODEL_SEED = 20260712
CV_CELL_M = 5000.0
CV_FOLDS = 5
MODEL_TREES = 500
MODEL_MAX_DEPTH = 30
MIN_LEARNABLE = 5
BOOTSTRAP_N = 10_000
CONFIDENCE_EDGES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
LIST_FLOOR_EDGES = [1, 4, 7, 10, 19, 33]
LIST_QUOTAS = {"hotel": 16, "bundle": 18, "floors": 7, "low_conf": 20, "window": 10}

# Energy.
J_PER_KWH = 3.6e6
METERS = {
    "lighting": ["InteriorLights:Electricity"],
    "equipment": ["InteriorEquipment:Electricity"],
    "cooling": ["DistrictCooling:Facility"],
    "heating": ["DistrictHeatingWater:Facility", "DistrictHeating:Facility"],
}
ZONE_VARIABLES = {
    "cooling": "Zone Ideal Loads Supply Air Total Cooling Energy",
    "heating": "Zone Ideal Loads Supply Air Total Heating Energy",
}
HEIGHT_BINS = {"low": 2, "multi": 5, "high": 15, "supertall": 35}
STOREY_HEIGHTS = {
    "government_office": 3.9,
    "office": 3.9,
    "hotel": 3.6,
    "shopping_mall": 5.4,
    "healthcare": 4.2,
    "education": 3.9,
    "sport_culture": 6.0,
    "transportation": 6.0,
    "exhibition": 6.0,
    "other_public": 3.9,
    "mixed_use_podium": 5.1,
    "mixed_use_tower": 3.9,
    "residential_mid_rise": 3.0,
    "residential_high_rise": 3.0,
}
MATRIX_EXCLUDED = [
    ("residential_mid_rise", "high"),
    ("residential_mid_rise", "supertall"),
    ("residential_high_rise", "low"),
    ("residential_high_rise", "multi"),
]
SHOEBOX_SIDE_M = (10.0, 10.0)
COP_COOLING = 3.5
COP_HEATING = 2.5
PUBLIC_NMBE_LIMIT = 10.0
RESIDENTIAL_NMBE_LIMIT = 20.0
RESIDENTIAL_EUI_BOUNDS = (31.5, 48.8)

# Raster.
TILE_EDGES_M = [30, 35, 38, 39, 40, 41, 42, 45, 50, 100, 700]

# Study areas as lon/lat boxes (west, south, east, north).
STUDY_AREAS = {
    "full_city": (120.85, 30.65, 122.20, 31.90),
    "xuhui": (121.40, 31.15, 121.50, 31.25),
    "pudong_lujiazui": (121.48, 31.22, 121.55, 31.27),
}
EXPECTED_ROWS_2023 = 412_099
ROW_BAND = (838_000, 850_000)
EOL_STAGE = [  # the first word found in the product name, else in the category, decides
    ("cmu", "C3-balancing"),
    ("medium density concrete block", "C3-balancing"),
    ("aac", "C4"),
    ("brick", "C4"),
    ("concrete", "C4"),
    ("glass", "C4"),
    ("steel", "C3"),
    ("aluminum", "C3"),
]
