"""Values that results depend on, kept together as plain text."""

# --- fixed values: these must equal the published behaviour for right results ---

# Casting: words read as booleans (after trim and lower).
BOOL_TRUE_WORDS = ["true", "yes", "1", "on", "y", "t"]
BOOL_FALSE_WORDS = ["false", "no", "0", "off", "n", "f"]

# Casting: type names a config may use, by Spark type.
CAST_TYPE_NAMES = {
    "double": ["float", "float64", "double", "numeric"],
    "float": ["float32"],
    "bigint": ["int", "int64", "integer"],
    "int": ["int32"],
    "string": ["string", "str", "text", "category", "categorical"],
    "boolean": ["bool", "boolean"],
    "timestamp_ntz": ["datetime", "date", "datetime64", "datetime64[ns]"],
}

# Alias replacement: normalised word -> canonical value.
YES_WORDS = ["y", "yes", "true", "1", "on", "t", "affirmative"]
NO_WORDS = ["n", "no", "false", "0", "off", "f", "negative"]
COUNTRY_WORDS = {
    "USA": ["usa", "us", "unitedstates", "unitedstatesofamerica", "states", "america"],
    "United Kingdom": ["unitedkingdom", "uk", "greatbritain", "england"],
    "United Arab Emirates": ["uae", "unitedarabemirates"],
    "China": ["prc", "peoplesrepublicofchina"],
    "South Korea": ["southkorea", "republicofkorea", "sk"],
}

# Text cleaning: characters removed per mode.
REMOVE_SPECIAL = {
    "keep_alphanumeric": "[^a-zA-Z0-9]",
    "keep_alphanumeric_space": "[^a-zA-Z0-9\\s]",
    "letters_only": "[^a-zA-Z]",
    "digits_only": "[^0-9]",
}

# Invalid values: bounds of the named rules.
RULE_BOUNDS = {"percentage_bounds": (0.0, 100.0), "age_bounds": (0.0, 120.0)}

# Feature generation.
EPSILON = 1e-9
SEASONS = {"Winter": [12, 1, 2], "Spring": [3, 4, 5], "Summer": [6, 7, 8], "Autumn": [9, 10, 11]}
TIMES_OF_DAY = {"Morning": (5, 11), "Afternoon": (12, 16), "Evening": (17, 20)}
TIME_OF_DAY_ELSE = "Night"

# Geography.
EARTH_RADIUS_KM = 6371.0088
MILES_PER_KM = 0.6213711922

# Missing markers.
ONE_HOT_MISSING = "__mlops_missing__"
ENCODER_MISSING = "nan"

# Word tokens: two or more word characters.
WORD_PATTERN = "[\\p{L}\\p{N}_]{2,}"

# Drift thresholds.
DRIFT_THRESHOLDS = {"psi": 0.2, "ks": 0.05, "wasserstein": 0.1, "kl_divergence": 0.1}
DRIFT_ZERO_SHARE = 0.0001
DRIFT_MAX_CATEGORIES = 50

# Personal-data hints.
EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+"
PHONE_PATTERN = r"^\+?[\d\s().-]{7,20}$"
