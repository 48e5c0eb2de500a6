"""Constants of the model; values that results must equal."""

# Sectors, calm limit (m/s), and coverage rules.
N_SECTORS = 16
CALM = 0.5
MIN_DAY_HOURS = 18
MIN_YEAR_SHARE = 0.75
ZONE = "Europe/Zagreb"
# Upper limits of index levels 1 to 5, ug/m3, and colours of levels 1 to 6, of the European and a national scheme.
INDEX_LIMITS = {
    "european": {"pm25": (5, 15, 50, 90, 140), "pm10": (15, 45, 120, 195, 270), "no2": (10, 25, 60, 100, 150), "o3": (60, 100, 120, 160, 180), "so2": (20, 40, 125, 190, 275)},
    "national": {"pm25": (10, 20, 25, 50, 75), "pm10": (20, 40, 50, 100, 150), "no2": (40, 90, 120, 230, 340), "o3": (50, 100, 130, 240, 380), "so2": (100, 200, 350, 500, 750)},
}
INDEX_COLOURS = {
    "european": ("#50F0E6", "#50CCAA", "#F0E641", "#FF5050", "#960032", "#7D2181"),
    "national": ("#55EFE5", "#54CAAA", "#EFE558", "#FE5355", "#940D36", "#7D2181"),
}
NO_COLOUR = "#6F6F6F"
NO2_BREAKS = tuple(float(x) for x in INDEX_LIMITS["european"]["no2"])
# Molar masses, g/mol; the volume of a mole at 20 degrees and 1013.25 hPa follows from the gas constant.
MOLAR = {"no2": 46.0055, "nox": 46.0055, "no": 30.0061, "o3": 47.9982, "so2": 64.0638, "co": 28.0101, "c6h6": 78.11184}
MOLE_VOLUME = 8.314462618 * 293.15 / 101.325
#: ug/m3 per ppb.
PPB = {k: m / MOLE_VOLUME for k, m in MOLAR.items()}
# Relative uncertainty, reference value (ug/m3) and share of the constant part, by pollutant.
UNCERTAINTY = {"no2": (0.24, 200.0, 0.20), "o3": (0.18, 120.0, 0.79), "pm10": (0.28, 50.0, 0.25), "pm25": (0.36, 25.0, 0.50)}
# Exceedance rules: name, pollutant, averaging, limit (ug/m3).
EXCEEDANCES = (
    ("no2_1h_200", "no2", "1h", 200.0),
    ("no2_24h_50", "no2", "24h", 50.0),
    ("pm10_24h_50", "pm10", "24h", 50.0),
    ("pm10_24h_45", "pm10", "24h", 45.0),
    ("pm25_24h_25", "pm25", "24h", 25.0),
    ("so2_1h_350", "so2", "1h", 350.0),
    ("so2_24h_125", "so2", "24h", 125.0),
)
# Step of stored values by parameter.
STEPS = {"no2": 0.1, "nox": 0.1, "o3": 0.1, "pm10": 0.1, "pm25": 0.1, "so2": 0.1, "co": 0.001, "c6h6": 0.01, "ws": 0.01, "wd": 0.1, "t": 0.01, "rh": 0.1, "u10": 0.01, "wd10": 0.1, "blh": 1.0, "t2": 0.01, "cc": 0.1, "sw": 0.1}
