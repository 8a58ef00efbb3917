"""The catalogue of parts and chips: one JSON document, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHIP = "struct<chip_x_um:double,chip_y_um:double,chip_w_um:double,chip_h_um:double,gds_off_x_um:double,gds_off_y_um:double,fov_w_nm:double,fov_h_nm:double,nm_per_px:double,notes:string>"
SCHEMA = f"schema string, parts map<string,struct<description:string,chips:map<string,{_CHIP}>>>"


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(part_id, chip_id, description, ...); keys that are not known are ignored.

    Documents of another schema give an error row count of zero chips and raise.
    """
    found = spark.read.schema(SCHEMA).json(path, multiLine=True)
    if not found.where(F.coalesce(F.col("schema"), F.lit("")) != schema).isEmpty():
        raise ValueError(f"the catalogue is not of schema {schema}")
    parts = found.select(F.explode("parts").alias("part_id", "part"))
    return parts.select("part_id", "part.description", F.explode("part.chips").alias("chip_id", "chip")).select("part_id", "chip_id", "description", "chip.*")
