"""Fixed values that must equal the original application's for equal results.

FIXED VALUES — do not edit: air-quality bands, category labels and colours,
guideline limits, substance columns, day labels, lag sets, thresholds and
forecast constants, in their natural order.
"""

# ---------------------------------------------------------------- FIXED VALUES
# Measured parameters of the wide hourly series.
NUMERIC_COLS = ["P0", "P1", "P2", "humidity", "temperature"]
LAG_VARIABLES = ["P0", "P1", "P2"]
LAGS = [1, 2, 3, 4, 5, 24]
MIN_HOURS = 1000
DATE_CUTOFF = "2024-01-01"
MIN_ROWS_PER_LOCATION = 24
TEMPERATURE_MAX = 60.0

# Site dimension: id -> (name, lat, lon)
SENSOR_LOCATIONS = [
    (76, "Westlands", -1.261, 36.782),
    (3573, "South B", -1.289, 36.825),
    (3966, "Kibera", -1.311, 36.817),
    (3967, "Kibera II", -1.309, 36.812),
    (3981, "CBD", -1.269, 36.819),
    (4013, "Upper Hill", -1.284, 36.823),
]

SUBSTANCE_MAP = {"PM2.5": "P2", "PM10": "P1"}
SUBSTANCE_UNITS = {"PM2.5": "µg/m³", "PM10": "µg/m³"}

DAY_EN_TO_FR = {
    "Monday": "Lun", "Tuesday": "Mar", "Wednesday": "Mer",
    "Thursday": "Jeu", "Friday": "Ven", "Saturday": "Sam", "Sunday": "Dim",
}
DAY_ORDER_FR = ["Lun", "Mar", "Mer", "Jeu", "Ven", "Sam", "Dim"]

# 24-hour guideline limits; any other substance uses 15.
WHO_THRESHOLDS = {"PM2.5": 15, "PM10": 45}
WHO_DEFAULT = 15

# Breakpoints (c_lo, c_hi, i_lo, i_hi), both ends inclusive, first match wins.
AQI_BP_PM25 = [
    (0.0, 12.0, 0, 50),
    (12.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300),
    (250.5, 500.4, 301, 500),
]
AQI_BP_PM10 = [
    (0, 54, 0, 50),
    (55, 154, 51, 100),
    (155, 254, 101, 150),
    (255, 354, 151, 200),
    (355, 424, 201, 300),
    (425, 604, 301, 500),
]

# Category: (upper AQI bound inclusive, label, hex colour, marker colour); last is the fallback.
AQI_CATEGORIES = [
    (50, "BON", "#00e400", "green"),
    (100, "MODÉRÉ", "#f0c800", "gold"),
    (150, "MALSAIN SENSIBLES", "#ff7e00", "orange"),
    (200, "MALSAIN", "#ff0000", "red"),
    (300, "TRÈS MALSAIN", "#8f3f97", "purple"),
    (None, "DANGEREUX", "#7e0023", "maroon"),
]

# Forecasting
TARGET_LAGS = {
    "P2": ["P2_lag_1", "P2_lag_2", "P2_lag_3", "P2_lag_4", "P2_lag_5", "P2_lag_24"],
    "P1": ["P1_lag_1", "P1_lag_2", "P1_lag_3", "P1_lag_4", "P1_lag_5", "P1_lag_24"],
}
TRAIN_LOCATION = 3966
TEST_HOURS = 168
CHANGEPOINT_PRIOR_SCALE = 0.5
CI_Z = 1.96
CI_GROWTH = 0.04
CI_GROWTH_CAP = 100
RESIDUAL_STD_FROM_MAE = 1.2
TREND_BAND_PCT = 5
TREND_LABELS = [("↗", "hausse", "#e53e3e"), ("↘", "baisse", "#38a169"), ("→", "stable", "#d69e2e")]
MAE_QUALITY = [(5, "Bonne"), (10, "Correcte"), (None, "Moyenne")]
MAX_HORIZON = 720

# Period labels
WEEKEND_LABELS = ("weekend", "semaine")
NOTEBOOK_WEEKEND_LABELS = ("Week-end", "Semaine")
# ----------------------------------------------------------- END FIXED VALUES

# FIXED VALUES: day name -> number (Monday first), period -> code, parameter grid of the boosted trees.
DAY_MAP = {"Monday": 0, "Tuesday": 1, "Wednesday": 2, "Thursday": 3, "Friday": 4, "Saturday": 5, "Sunday": 6}
PERIOD_MAP = {"semaine": 0, "weekend": 1}
PARAM_GRID = {"max_depth": [3, 4], "n_estimators": [80, 120], "learning_rate": [0.05, 0.1], "subsample": [0.8, 1.0]}
