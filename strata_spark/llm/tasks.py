"""Makes the functions that run in Python tasks importable on executors that do not have this package."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows that a task works on at a time; what it holds besides is in its own docstring.
BATCH_ROWS = 2048


def ship(spark: SparkSession) -> None:
    """Sends the package to all executors of an application, once.

    Tasks refer to its functions by name, so what a worker has remembered (vocabularies, parts of words) lasts over tasks.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}_tasks.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, str(path.relative_to(package.parent)))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema,
              rows: int = BATCH_ROWS) -> DataFrame:
    """``df.mapInArrow`` with a function of this package, which gets at most ``rows`` rows at a time."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))

    return df.mapInArrow(run, schema)
