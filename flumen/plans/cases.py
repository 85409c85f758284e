"""What runs over a table of cases: each case with its own speed and frequency, its metadata kept beside its products; and
recordings brought to another's grid.

All cases are one plan: a product is one table, in a folder for each case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validity import finite
from ..operators import fill, phase, regrid, stats
from ..sources import catalog, fields
from ..sources.fields import VOXEL


@dataclass
class CaseRuns:
    """Verbs over the samples of several cases (volume is a case_id) and the table of these cases. Products go below
    root, into the folder of processing_id, else into the first of root/run, root/run_02, ... that isn't there yet."""

    samples: DataFrame
    cases: DataFrame
    root: str = ""
    processing_id: str | None = None
    mode: str = "nan"
    mask: str = "component"
    min_fraction: float = 0.0

    def _own(self, table: DataFrame, column: str) -> DataFrame:
        """table with a column of each row's case; an error where a case hasn't any, which would lose its rows."""
        own = self.cases.select(F.col("case_id").alias("volume"), F.col(column).alias(f"_{column}"))
        lacking = self.samples.select("volume").distinct().join(own.filter(F.col(f"_{column}") > 0), "volume", "left_anti").agg(F.min("volume")).first()[0]
        if lacking is not None:
            raise ValueError(f"case {lacking} has no {column}")
        return table.join(own, "volume")

    def mean(self, ratios: bool = True) -> DataFrame:
        """Temporal means, with the wake's ratios to each case's own speed."""
        mean = stats.temporal_mean(self.samples, self.mode, self.mask, self.min_fraction)
        return stats.wake_ratios(self._own(mean, "u_inf"), F.col("_u_inf")).drop("_u_inf") if ratios else mean

    def kinetic_energy(self) -> DataFrame:
        return stats.kinetic_energy(self.samples, self.mean(ratios=False), self.mode, self.mask)

    def stresses(self, *which: str) -> DataFrame:
        return stats.reynolds_stresses(self.samples, self.mean(ratios=False), which or ("all",), self.mode, self.mask)

    def phase_average(self, bins: int, offset: float = 0.0) -> DataFrame:
        """Phase averages at each case's own frequency."""
        phased = phase.with_phase(self._own(self.samples, "frequency_hz"), bins, F.col("_frequency_hz"), offset=offset)
        return phase.phase_average(phased, self.mode, self.mask, self.min_fraction)

    def filled(self, **how) -> DataFrame:
        return fill.fill(self.samples, **how)

    def slab(self, width: int, axis: str = "z", center: float = 0.0, coord: str | None = None) -> DataFrame:
        return fields.center_slab(self.samples, width, axis, center, coord)

    def folder(self) -> str:
        """Where this object's products go; the same for all of them."""
        if self.processing_id is None:
            self.processing_id = catalog.available(self.samples.sparkSession, f"{self.root}/run").rsplit("/", 1)[1]
        return f"{self.root}/{self.processing_id}"

    def save(self, product: str, table: DataFrame, overwrite: bool = False) -> str:
        """A product with a folder for each case, and the cases' metadata beside it; not over one that is there, unless
        asked to."""
        path = f"{self.folder()}/{product}"
        how = "overwrite" if overwrite else "errorifexists"
        table.write.mode(how).partitionBy("volume").parquet(path)
        self.cases.withColumn("processing_id", F.lit(self.processing_id)).coalesce(1).write.mode("overwrite").parquet(f"{path}.cases")
        return path


def aligned(samples: DataFrame, targets: DataFrame, axis: str = "z", coord: str = "z", fill_values: tuple[float, ...] = ()) -> DataFrame:
    """samples brought to target planes (volume, idx, <coord>) along one axis. A vector is interpolated where all its
    components are finite and no fill value at both neighbours; filled says whether a neighbour with some weight was."""
    ok = fields.with_validity(samples, "nan", fill_values).withColumn("_filled", F.coalesce(F.col("filled"), F.lit(False)).cast("double") if "filled" in samples.columns else F.lit(0.0))
    clean = ok.withColumns({c: F.when(F.col("valid"), F.col(c)) for c in ("u", "v", "w")})
    out = regrid.align_axis(clean, axis, coord, targets, ("u", "v", "w", "_filled"))
    return out.withColumn("filled", F.coalesce(F.col("_filled") > 0, F.lit(False)) & F.col("u").isNotNull()).drop("_filled")


def valid_fraction(out: DataFrame, n_times: DataFrame) -> DataFrame:
    """The part of a volume's frames (n_times) at which each voxel has a vector."""
    by = out.groupBy(*VOXEL).agg(F.count_if(finite(F.col("u"))).alias("n_valid")).join(n_times, "volume")
    return by.withColumn("fraction", F.col("n_valid") / F.col("n_times"))


def align_product(spark: SparkSession, source: str, reference: str, output: str, axis: str = "z", fill_values: tuple[float, ...] = ()) -> dict[str, int]:
    """A recording on the planes of another one, as a product: samples at output, the valid part of each voxel's frames
    and where all came from beside it. Both recordings have a coordinate column for each axis (x, y, z); those of the
    other two axes must be the same. Written to output.partial, and renamed once it is whole and the inputs are still
    what they were. Returns how many vectors are valid and how many are missing of all frames and voxels."""
    partial = f"{output}.partial"
    for place in (output, partial):
        if catalog.exists(spark, place):
            raise FileExistsError(place)
    stamps = {p: catalog._stamp(spark, p) for p in (source, reference)}
    samples, grid = spark.read.parquet(source), spark.read.parquet(reference)
    coords = lambda t, a: t.groupBy("volume", F.col(f"i{a}").alias("idx")).agg(F.min(F.col(a).cast("double")).alias(a))
    for a in {"x", "y", "z"} - {axis}:
        # One grid for all volumes of the recording: the reference's.
        own, other = coords(samples, a), coords(grid, a).select("idx", a).distinct()
        volumes = samples.select("volume").distinct()
        if not own.exceptAll(volumes.crossJoin(other).select("volume", "idx", a)).isEmpty() or not volumes.crossJoin(other).select("volume", "idx", a).exceptAll(own).isEmpty():
            raise ValueError(f"the coordinates along {a} differ; only {axis} is aligned")
    targets = samples.select("volume").distinct().crossJoin(coords(grid, axis).select("idx", axis).distinct())
    aligned(samples, targets, axis, axis, fill_values).write.parquet(partial)
    out = spark.read.parquet(partial)
    n_times = stats.n_times(samples)
    valid_fraction(out, n_times).write.mode("overwrite").parquet(f"{output}.fraction")
    planes = targets.groupBy("volume").agg(F.count("*").alias("planes"))
    rest = [a for a in ("x", "y", "z") if a != axis]
    cells = samples.groupBy("volume").agg(F.count_distinct(*(f"i{a}" for a in rest)).alias("lines")).join(planes, "volume").join(n_times, "volume")
    size = cells.agg(F.sum(F.col("lines") * F.col("planes") * F.col("n_times"))).first()[0] or 0
    valid = out.filter(finite(F.col("u"))).count()
    if {p: catalog._stamp(spark, p) for p in stamps} != stamps:
        raise ValueError("an input changed while it was read")
    Path, conf = catalog._files(spark)
    Path(partial).getFileSystem(conf).rename(Path(partial), Path(output))
    attrs = {"source": source, "reference": reference, "axis": axis, "invalid_samples": "nan", "valid_vectors": str(valid), "missing_vectors": str(size - valid)}
    attrs |= {f"{k}_{n}": str(x) for k, p in (("source", source), ("reference", reference)) for n, x in zip(("size", "modified"), stamps[p])}
    spark.createDataFrame(sorted(attrs.items()), "name string, value string").coalesce(1).write.parquet(f"{output}.attrs")
    return {"valid": valid, "missing": size - valid}
