"""Lookup tables and lists that results depend on. Nothing here is logic."""

# Incident type as reported -> category. Anything else becomes DEFAULT_CATEGORY.
INCIDENT_CATEGORY = {
    "Flood": "Flood",
    "Hurricane": "Hurricane",
    "Severe Storm(s)": "Severe Storm",
    "Severe Storm": "Severe Storm",
    "Fire": "Wildfire",
    "Tornado": "Tornado",
    "Earthquake": "Earthquake",
    "Snow": "Winter Storm",
    "Ice Storm": "Winter Storm",
    "Severe Ice Storm": "Winter Storm",
    "Freezing": "Winter Storm",
    "Coastal Storm": "Coastal Storm",
    "Typhoon": "Hurricane",
    "Mud/Landslide": "Landslide",
    "Drought": "Drought",
    "Volcanic Eruption": "Volcanic",
    "Toxic Substances": "Other",
    "Dam/Levee Break": "Other",
    "Fishing Losses": "Other",
    "Biological": "Other",
    "Terrorist": "Other",
    "Human Cause": "Other",
    "Chemical": "Other",
    "Other": "Other",
}
DEFAULT_CATEGORY = "Other"

# All categories, in first-seen order: the fixed value list of every category pivot.
CATEGORIES = list(dict.fromkeys(INCIDENT_CATEGORY.values()))

# Federal region -> state codes.
REGION_STATES = {
    1: ["09", "23", "25", "33", "44", "50"],
    2: ["34", "36", "72", "78"],
    3: ["10", "11", "24", "42", "51", "54"],
    4: ["01", "12", "13", "21", "28", "37", "45", "47"],
    5: ["17", "18", "26", "27", "39", "55"],
    6: ["05", "22", "35", "40", "48"],
    7: ["19", "20", "29", "31"],
    8: ["08", "30", "38", "46", "49", "56"],
    9: ["04", "06", "15", "32"],
    10: ["02", "16", "41", "53"],
}
STATE_REGION = {state: region for region, states in REGION_STATES.items() for state in states}
REGIONS = list(REGION_STATES)

# State code -> postal abbreviation.
STATE_ABBREVIATION = {
    "01": "AL", "02": "AK", "04": "AZ", "05": "AR", "06": "CA", "08": "CO", "09": "CT", "10": "DE",
    "11": "DC", "12": "FL", "13": "GA", "15": "HI", "16": "ID", "17": "IL", "18": "IN", "19": "IA",
    "20": "KS", "21": "KY", "22": "LA", "23": "ME", "24": "MD", "25": "MA", "26": "MI", "27": "MN",
    "28": "MS", "29": "MO", "30": "MT", "31": "NE", "32": "NV", "33": "NH", "34": "NJ", "35": "NM",
    "36": "NY", "37": "NC", "38": "ND", "39": "OH", "40": "OK", "41": "OR", "42": "PA", "44": "RI",
    "45": "SC", "46": "SD", "47": "TN", "48": "TX", "49": "UT", "50": "VT", "51": "VA", "53": "WA",
    "54": "WV", "55": "WI", "56": "WY", "72": "PR", "78": "VI",
}

# Region -> display label.
REGION_LABEL = {
    1: "R1: New England",
    2: "R2: NJ,NY",
    3: "R3: Mid-Atlantic",
    4: "R4: Southeast",
    5: "R5: Great Lakes",
    6: "R6: South-Central",
    7: "R7: Plains",
    8: "R8: Mountain",
    9: "R9: Pacific",
    10: "R10: Northwest",
}

# Survey variable code -> column name.
DEMOGRAPHIC_VARIABLES = {
    "DP05_0001E": "total_population",
    "DP05_0018E": "median_age",
    "DP03_0062E": "median_household_income",
    "DP03_0063E": "mean_household_income",
    "DP04_0089E": "median_home_value",
    "DP04_0046E": "owner_occupied_units",
    "DP04_0047E": "renter_occupied_units",
    "DP02_0068PE": "pct_bachelors_degree",
    "DP03_0009PE": "unemployment_rate",
    "DP04_0002PE": "pct_occupied_housing",
}

MACRO_SERIES = ["FEDFUNDS", "CPIAUCSL", "CSUSHPINSA", "MORTGAGE30US"]

START_YEAR = 2004
END_YEAR = 2024
TRAIN_YEAR_MAX = 2021

# Weights of the disaster exposure index.
EXPOSURE_WEIGHTS = {
    "total_disasters": 1.0,
    "flood_count": 0.5,
    "hurricane_count": 1.5,
    "wildfire_count": 1.0,
}

# Divisors that bring features to comparable magnitude before a GLM fit.
UNIT_DIVISORS = {
    "total_population": 10_000.0,
    "median_household_income": 10_000.0,
    "median_home_value": 100_000.0,
    "CPIAUCSL": 100.0,
    "CSUSHPINSA": 100.0,
    "avg_premium": 1_000.0,
    "policy_count": 10_000.0,
}

DISASTER_FEATURES = [
    "total_disasters", "flood_count", "hurricane_count", "severe_storm_count", "wildfire_count",
    "winter_storm_count", "tornado_count", "cum_disasters_3yr", "disaster_exposure_index",
    "avg_incident_duration",
]
DEMOGRAPHIC_FEATURES = [
    "total_population", "median_household_income", "median_home_value", "pct_occupied_housing",
    "unemployment_rate",
]
ECONOMIC_FEATURES = ["MORTGAGE30US", "CSUSHPINSA", "CPIAUCSL", "FEDFUNDS"]
LAGGED_FEATURES = ["total_disasters_lag1", "claim_count_lag1", "avg_claim_severity_lag1"]
FEATURE_GROUPS = {
    "disaster": DISASTER_FEATURES,
    "demographic": DEMOGRAPHIC_FEATURES,
    "economic": ECONOMIC_FEATURES,
    "lagged": LAGGED_FEATURES,
}
PREDICTIVE_FEATURES = [f for group in FEATURE_GROUPS.values() for f in group]
CLAIM_FEATURES = [
    "claim_count", "total_claims_paid", "avg_claim_severity", "log_avg_claim_severity",
    "log_total_claims_paid", "claims_per_capita", "damage_per_capita", "ha_total_damage",
    "ha_total_approved", "log_ha_total_damage",
]
SCORING_FEATURES = PREDICTIVE_FEATURES + CLAIM_FEATURES

SURGE_FEATURES = [
    "total_disasters_lag1", "claim_count_lag1", "avg_claim_severity_lag1", "avg_loss_ratio_lag1",
    "cum_disasters_3yr", "flood_count", "hurricane_count", "severe_storm_count", "avg_premium",
    "claims_per_policy", "total_population", "median_household_income", "median_home_value",
    "pct_occupied_housing", "MORTGAGE30US", "CSUSHPINSA", "CPIAUCSL",
]

SIGNALS = [
    "signal_high_severity", "signal_high_disasters", "signal_ha_damage", "signal_high_claims_paid",
]

# Ten uniform probability bins on [0, 1]; the binary64 values of k/10 as a linspace yields them.
PROBABILITY_EDGES = [
    0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0,
]

SEVERITY_FEATURES = [
    "total_disasters", "flood_count", "hurricane_count", "severe_storm_count", "wildfire_count",
    "cum_disasters_3yr", "avg_incident_duration", "total_population", "median_household_income",
    "median_home_value", "pct_occupied_housing", "avg_premium", "policy_count", "claims_per_policy",
    "MORTGAGE30US", "CSUSHPINSA", "CPIAUCSL",
]

#: Features of the surge threshold study.
SURGE_STUDY_FEATURES = [
    "total_disasters_lag1", "claim_count_lag1", "avg_claim_severity_lag1", "cum_disasters_3yr", "total_population",
    "median_household_income", "median_home_value", "unemployment_rate", "MORTGAGE30US", "CSUSHPINSA", "CPIAUCSL", "FEDFUNDS",
]
