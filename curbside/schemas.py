"""Fixed schemas.  Nothing is inferred when a file is read."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


LONG, INT, DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
TEXT, DATE, TIME = T.StringType(), T.DateType(), T.TimestampType()

#: Columns of the collection CSV, in file order.
COLLECTIONS_CSV = _schema(
    ("id", LONG, True),
    ("area", TEXT, True),
    ("waste_type", TEXT, True),
    ("weight_kg", DOUBLE, True),
    ("moisture_pct", DOUBLE, True),
    ("recyclable", INT, True),
    ("material_type", TEXT, True),
    ("day_of_week", TEXT, True),
    ("month", INT, True),
    ("volume_liters", DOUBLE, True),
)

COLLECTIONS = T.StructType([*COLLECTIONS_CSV.fields, T.StructField("collection_date", DATE, True)])

REPORTS = _schema(
    ("id", LONG, True),
    ("reporter_name", TEXT, True),
    ("location", TEXT, True),
    ("waste_type", TEXT, True),
    ("description", TEXT, True),
    ("image_path", TEXT, True),
    ("status", TEXT, True),
    ("created_at", TIME, True),
)

PREDICTIONS = _schema(
    ("area", TEXT, True),
    ("predicted_volume", DOUBLE, True),
    ("prediction_date", DATE, True),
    ("confidence", DOUBLE, True),
    ("created_at", TIME, True),
)

USERS = _schema(
    ("id", LONG, True),
    ("name", TEXT, True),
    ("email", TEXT, True),
    ("role", TEXT, True),
    ("created_at", TIME, True),
)

#: Columns which may not be null, per table.
REQUIRED = {
    "collections": ["area", "waste_type"],
    "reports": ["reporter_name", "location", "waste_type"],
    "predictions": ["area"],
    "users": ["name", "email"],
}

#: Columns whose values may not repeat, per table.
UNIQUE = {"users": ["email"]}

#: Values for columns left out, per table.
DEFAULTS = {"users": {"role": "citizen"}, "reports": {"status": "pending"}}
