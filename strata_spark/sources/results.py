"""Results kept by name: one partition a (variant, model, age scheme), replaced one by one.

The names are the partition folders, so what exists is known without reading a row, a wrong name is an error that lists
the right ones, and a name filter prunes folders. A write replaces the partitions that it has rows for and no other; it
becomes visible when the job commits, so a folder that is there is complete.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("variant", "model", "age_scheme")
#: Folder that stands for a missing value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class ResultStore:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), tuple(keys)

    def names(self) -> list[tuple[str | None, ...]]:
        """Names of all results, sorted, from the folders alone."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/" + "/".join(f"{k}=*" for k in self.keys))
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder) or []
        parts = [str(f.getPath().toUri().getPath()).rsplit("/", len(self.keys))[1:] for f in found]
        values = [tuple(unquote(p.split("=", 1)[1]) for p in row) for row in parts]
        return sorted((tuple(None if x == NO_VALUE else x for x in row) for row in values), key=lambda r: [(x is not None, x or "") for x in r])

    def missing(self, wanted: Iterable[Sequence[str | None]]) -> list[tuple[str | None, ...]]:
        """Those of ``wanted`` that are not there yet, in their order."""
        there = set(self.names())
        return [tuple(w) for w in wanted if tuple(w) not in there]

    def write(self, df: DataFrame, files: int = 8) -> None:
        """Replaces the results that ``df`` has rows for; all others stay."""
        absent = [k for k in self.keys if k not in df.columns]
        if absent:
            raise ValueError(f"no name column {absent}")
        named = df.withColumns({k: F.col(k).cast("string") for k in self.keys})
        # a result is written by up to ``files`` tasks, however many made its rows and however large it is
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files))
        (named.repartition(*self.keys, salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*self.keys).parquet(self.path))

    def read(self, **name: str | Sequence[str]) -> DataFrame:
        """Results with the given parts of a name, one value or several each; a value that no result has is an error."""
        unknown = [k for k in name if k not in self.keys]
        if unknown:
            raise ValueError(f"no name part {unknown}, there are {list(self.keys)}")
        there = self.names()
        if not there:
            raise ValueError(f"no results in {self.path}")
        picked = None
        for k, value in name.items():
            values = [value] if isinstance(value, str) else list(value)
            known = sorted({row[self.keys.index(k)] for row in there} - {None})
            if bad := [x for x in values if x not in known]:
                raise ValueError(f"unknown {k} {bad}, there are {known}")
            hit = F.col(k).isin(*values)
            picked = hit if picked is None else picked & hit
        # names are text whatever they look like
        kinds = self.spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
        self.spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
        try:
            df = self.spark.read.parquet(self.path)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", kinds)
        return df if picked is None else df.where(picked)

    def fill(self, wanted: Iterable[Sequence[str | None]], compute: Callable[[list[tuple[str | None, ...]]], DataFrame]) -> int:
        """Computes and writes those of ``wanted`` that are missing, in one job; returns their number."""
        absent = self.missing(wanted)
        if absent:
            self.write(compute(absent))
        return len(absent)
