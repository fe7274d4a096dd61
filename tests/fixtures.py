"""Small tables made for the tests."""

from __future__ import annotations

from curbside import schemas
from curbside.functions import lookups

# Kg per area and type in a known sample, and litres per area.
TYPES = ["Glass", "Metal", "Organic", "Paper", "Plastic"]
KG = {
    "Clement Town": [23.1, 12.5, 36.1, 10.2, 15.3],
    "Clock Tower": [42.9, 31.8, 85.4, 28.9, 35.0],
    "ISBT": [27.4, 21.3, 73.9, 23.6, 30.1],
    "Prem Nagar": [25.0, 17.0, 53.6, 13.8, 17.9],
    "Rajpur Road": [33.0, 24.0, 48.8, 16.6, 19.9],
}
LITERS = {
    "Clock Tower": 573.1,
    "ISBT": 460.5,
    "Rajpur Road": 350.6,
    "Prem Nagar": 319.6,
    "Clement Town": 240.3,
}

MATERIAL_OF_TYPE = {
    "Glass": "silica",
    "Metal": "ferrous",
    "Organic": "biodegradable",
    "Paper": "cellulose",
    "Plastic": "synthetic_polymer",
}
WEEK = [day for day, _ in lookups.DAY_MULTIPLIERS]


def cells(spark):
    rows = [(a, t, kg) for a, row in KG.items() for t, kg in zip(TYPES, row)]
    return spark.createDataFrame(rows, "area string, waste_type string, weight_kg double")


def record(i: int) -> tuple:
    """The i-th record of a made-up collection log; wet waste is organic."""
    area = lookups.AREAS[i % 5]
    kind = TYPES[(i // 5) % 5]
    wet = kind == "Organic"
    weight = round(1.0 + (i * 37 % 97) / 10, 1)
    moisture = float(60 + i % 30 if wet else i % 25)
    volume = round(weight * (2.5 if wet else 1.7) + (i % 7) / 10, 1)
    return (
        i + 1, area, kind, weight, moisture, int(not wet), MATERIAL_OF_TYPE[kind],
        WEEK[(i // 25) % 7], (i // 50) % 12 + 1, volume,
    )


def collections(spark, n: int = 400):
    return spark.createDataFrame([record(i) for i in range(n)], schemas.COLLECTIONS_CSV)
