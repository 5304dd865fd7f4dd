"""Declared schemas of the raw tables; reading never scans to infer types."""

from pyspark.sql.types import (
    DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)

INT, BIGINT, DOUBLE, STRING, DATE = IntegerType(), LongType(), DoubleType(), StringType(), DateType()


def _table(**columns) -> StructType:
    return StructType([StructField(name, dtype) for name, dtype in columns.items()])


TABLES: dict[str, StructType] = {
    "races": _table(raceId=INT, year=INT, round=INT, circuitId=INT, name=STRING, date=DATE),
    "results": _table(
        resultId=BIGINT, raceId=INT, driverId=BIGINT, constructorId=INT, statusId=INT, positionOrder=INT,
        grid=INT, points=DOUBLE, laps=INT, fastestLapSpeed=DOUBLE,
    ),
    "drivers": _table(driverId=BIGINT, forename=STRING, surname=STRING),
    "constructors": _table(constructorId=INT, name=STRING),
    "circuits": _table(circuitId=INT, name=STRING),
    "status": _table(statusId=INT, status=STRING),
    "qualifying": _table(raceId=INT, driverId=BIGINT, position=INT),
    "pit_stops": _table(raceId=INT, driverId=BIGINT, stop=INT, lap=INT, milliseconds=BIGINT),
}
OPTIONAL = {"pit_stops"}
