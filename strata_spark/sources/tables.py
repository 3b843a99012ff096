"""Typed readers and writers.

Schemas are always declared. A sink writes in parallel, one file per
partition; a report keeps its order by carrying an ordinal column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata_spark import fixed_values as fx
from strata_spark.functions.scalars import extract, flatten_text

SERO_SCHEMA = (
    "uid string, hh_id string, sex string, age int, age_cat_10y string, age_cat_UEP string, "
    "S_interp string, N_interp string, vaccinated boolean")
PANEL_SCHEMA = (
    "uid string, sex string, age int, age_cat_10y string, age_cat_UEP string, variant string, "
    "ec50 double, inf_latest string, vacc_status_3way string")
CENSUS_SCHEMA = "Age string, Sex string, Total double"
DRAWS_SCHEMA = "fit_id string, chain int, sim int, term string, value double"


def read_csv(spark: SparkSession, path: str, schema: str, comment: str | None = None) -> DataFrame:
    """CSV with a header and declared types; empty and ``NA`` fields are null."""
    reader = spark.read.schema(schema).option("header", True).option("nullValue", "NA")
    return (reader.option("comment", comment) if comment else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("nullValue", "NA").csv(path)


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet; partition columns name the result (variant, model, age scheme)."""
    df.write.partitionBy(*partition_by).parquet(path)


def write_model_input(cells: DataFrame, path: str, params: Mapping[str, float] | None = None) -> None:
    """Model input as JSON lines: collapsed cells, with parameters on each line."""
    cells.withColumns({k: F.lit(v) for k, v in (params or {}).items()}).write.json(path)


def read_model_input(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def result_name(outcome: Column, model: Column, variant: Column, age_scheme: Column) -> Column:
    """File-style name of a result."""
    return F.concat(outcome, F.lit("_"), model, F.lit("_"), flatten_text(variant), F.lit("_"), age_scheme)


def parse_result_name(path: Column) -> dict[str, Column]:
    """Model, outcome, variant and age scheme of a result name; null where absent."""
    model = extract(path, fx.RESULT_MODEL_PATTERN)
    return {
        "model_type": model,
        "outcome_type": extract(path, fx.RESULT_OUTCOME_PATTERN),
        "variant": extract(path, rf"(?:{fx.RESULT_MODEL_PATTERN})_(.*)_age", 1),
        "age_scheme": extract(path, fx.RESULT_AGE_PATTERN),
    }
