"""The result of counting: counts, libraries and the scalars that later steps need."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import ExtractParams

SCALARS = "spacing int, width int, shift int, final_ext int, params string"


@dataclass(frozen=True)
class CountSet:
    """counts is long: library, chrom, start, end, n, and k or region_id (and strand) as keys."""

    counts: DataFrame
    libraries: DataFrame
    spacing: int | None = None
    width: int | None = None
    shift: int = 0
    final_ext: int | None = None
    params: ExtractParams | None = None

    def replace(self, **changes) -> CountSet:
        return dataclasses.replace(self, **changes)

    @property
    def keys(self) -> list[str]:
        return [c for c in ("region_id", "chrom", "k", "start", "end", "strand") if c in self.counts.columns]

    def ranges(self) -> DataFrame:
        """The distinct windows or regions."""
        return self.counts.select(*self.keys).distinct()

    def matrix(self, names: list[str]) -> DataFrame:
        """A row for each range with y, its counts in the order of the library names."""
        known = F.map_from_entries(F.collect_list(F.struct("library", "n")))
        y = F.transform(F.array(*map(F.lit, names)), lambda x: F.coalesce(F.col("_m")[x], F.lit(0)).cast("double"))
        return self.counts.groupBy(*self.keys).agg(known.alias("_m")).select(*self.keys, y.alias("y"))

    def write(self, folder: str) -> None:
        """Tables of counts, libraries and blacklist, and at last one row of scalars with the other parameters.

        That row commits the container: read() refuses one without it.
        """
        self.counts.write.parquet(f"{folder}/counts")
        self.libraries.write.parquet(f"{folder}/libraries")
        params = None
        if self.params is not None:
            params = {f.name: getattr(self.params, f.name) for f in dataclasses.fields(self.params)}
            discard = params.pop("discard")
            if discard is not None:
                discard.write.parquet(f"{folder}/discard")
            params["discard"] = discard is not None
        scalars = [(self.spacing, self.width, self.shift, self.final_ext, json.dumps(params) if params else None)]
        self.counts.sparkSession.createDataFrame(scalars, SCALARS).coalesce(1).write.parquet(f"{folder}/scalars")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> CountSet:
        try:
            row = spark.read.schema(SCALARS).parquet(f"{folder}/scalars").first()
        except AnalysisException:
            row = None
        if row is None:
            raise ValueError(f"{folder} holds no container, or one that was not written to its end")
        scalars = row.asDict()
        params = json.loads(scalars.pop("params") or "null")
        if params:
            discard = spark.read.parquet(f"{folder}/discard") if params.pop("discard") else None
            params = ExtractParams(**params, discard=discard)
        return cls(spark.read.parquet(f"{folder}/counts"), spark.read.parquet(f"{folder}/libraries"), params=params, **scalars)


def as_ranges(x: CountSet | DataFrame) -> DataFrame:
    """Ranges of a count set, or the frame itself if it has chrom, start and end."""
    if isinstance(x, CountSet):
        return x.ranges()
    if not {"chrom", "start", "end"} <= set(getattr(x, "columns", ())):
        raise TypeError("ranges need chrom, start and end")
    return x
