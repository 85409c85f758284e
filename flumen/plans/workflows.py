"""Workflows: what is usually asked for together, as one object over samples, and batches over many volumes.

Batches need no loop: every operator groups by volume, so one job treats all volumes of a table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import energy, fill, freeflow, phase, stats, vortex
from ..sources import catalog
from ..sources.fields import VOXEL
from .lineage import cut


@dataclass
class Engine:
    """Verbs over samples with the validity they share."""

    samples: DataFrame
    mode: str = "nan"
    mask: str = "component"
    min_fraction: float = 0.0
    u_inf: float | None = None

    def mean(self) -> DataFrame:
        return stats.temporal_mean(self.samples, self.mode, self.mask, self.min_fraction, self.u_inf)

    def kinetic_energy(self) -> DataFrame:
        return stats.kinetic_energy(self.samples, self.mean(), self.mode, self.mask)

    def stresses(self, *which: str) -> DataFrame:
        return stats.reynolds_stresses(self.samples, self.mean(), which or ("all",), self.mode, self.mask)

    def phase_average(self, bins: int, frequency: float | None = None, signal: DataFrame | None = None, offset: float = 0.0) -> DataFrame:
        return phase.phase_average(phase.with_phase(self.samples, bins, frequency, signal, offset), self.mode, self.mask, self.min_fraction, self.u_inf)

    def harmonics(self, bins: int, frequency: float, offset: float = 0.0) -> DataFrame:
        return phase.first_harmonic(self.phase_average(bins, frequency, offset=offset), bins)

    def filled(self, **how) -> DataFrame:
        return fill.fill(self.samples, **how)

    def characterise(self, max_lag: int = 20, spacing: float = 1.0, blocks: int = 4, probe: tuple[int, int, int] = (0, 0, 0), time_step: float = 1.0, min_pairs: int = 1) -> dict[str, DataFrame]:
        """A free flow's tables: mean, energy, stresses, intensity, profiles, blocks; correlations of each component
        along each axis, and in time at a probe (iz, iy, ix); their integral scales, and the length that goes with the
        probe's time scale."""
        mean = self.mean()
        te = stats.kinetic_energy(self.samples, mean, self.mode, self.mask)
        first, last = self.samples.agg(F.min("ti"), F.max("ti")).first()
        primes = cut(freeflow.fluctuations(self.samples, mean))
        rho = cut(freeflow.spatial_correlations(primes, max_lag, min_pairs))
        in_time = cut(freeflow.temporal_correlations(primes, probe, max_lag, min_pairs))
        return {
            "mean": mean, "energy": te, "stresses": stats.reynolds_stresses(self.samples, mean, ("all",), self.mode, self.mask), "intensity": stats.moments(self.samples, VOXEL, self.mode, self.mask),
            "profiles": stats.plane_profiles(mean, te), "blocks": stats.blocks(self.samples, mean, blocks, first, last) if first is not None else mean.limit(0),
            "correlations": rho, "in_time": in_time, "scales": freeflow.scales(rho, in_time, mean, probe, spacing, time_step),
        }

    def forcing_response(self, bins: int, frequency: float, component: str = "u", offset: float = 0.0, min_samples: int = 1, slabs: DataFrame | None = None) -> dict[str, DataFrame]:
        """Energy budget of a component at each voxel, and reduced over each volume; with slabs (slab, from_, to, in
        units of ix) also over these, each voxel by the part of its cell that lies in a slab."""
        phased = phase.with_phase(self.samples, bins, frequency, None, offset)
        voxels = energy.budget(phased, VOXEL, component, bins, frequency, offset, min_samples)
        whole = stats.weighted(voxels.filter("total is not null").withColumn("weight", F.lit(1.0)), list(energy.BUDGET), "weight", ["volume"])
        found = {"voxels": voxels, "volumes": whole}
        if slabs is not None:
            cells = self.samples.select("volume", F.col("ix").alias("idx")).distinct().select("volume", "idx", (F.col("idx") - 0.5).alias("low"), (F.col("idx") + 0.5).alias("high"))
            found["slabs"] = energy.slab_budget(voxels, cells, slabs)
        return found


def detect_vortices(field: DataFrame, keys: list[str], value: str = "swirl", kind: str = "p95", min_size: int = 1) -> DataFrame:
    """Components of a swirl field (keys, ix, iy, iz, value) at or above one of its thresholds."""
    level = vortex.thresholds(field, keys, value).filter(F.col("kind") == kind).drop("kind")
    active = field.join(level, keys).filter(F.col(value) >= F.col("level"))
    return vortex.component_stats(vortex.label(active, keys), keys, value, min_size=min_size)


def batch(found: DataFrame, process: Callable[[str], DataFrame], output: Callable[[str], str], manifest: str, settings: catalog.Settings, limit: int | None = None, dry_run: bool = False, overwrite: bool = False) -> list[tuple[str, str, str | None]]:
    """One product for each input file (found has path), the first `limit` in order of path: what is there already stays
    unless it may be overwritten, what fails is noted and the others go on. The manifest gets a row for each input after
    each of them, so that a run that breaks off is known up to there."""
    spark, rows = found.sparkSession, []
    paths = found.select("path").distinct().orderBy("path")
    for path in [r["path"] for r in (paths if limit is None else paths.limit(limit)).toLocalIterator()]:
        target = output(path)
        try:
            if catalog.exists(spark, target) and not overwrite:
                row = (path, "exists", None)
            elif dry_run:
                row = (path, "dry-run", None)
            else:
                catalog.write_product(process(path), target, overwrite)
                row = (path, "processed", None)
        except Exception as e:  # noted with the input it comes from
            row = (path, "failed", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
        catalog.write_manifest(spark, manifest, [row], settings)
        rows.append(row)
    return rows
