"""Decompositions of many volumes as one plan: each volume has a result or a reason, and what is done stays done."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Snapshots of a volume at most, values of a task that sums products, degrees of freedom in a block of it.
MOST, VALUES, CHUNK = 2_000, 500_000, 1_024


def decompose_volumes(snapshots: DataFrame, modes: int = 20, min_fraction: float = 0.0, drop: float = 1e-12, most: int = MOST) -> dict[str, DataFrame]:
    """As pod.decompose, for every volume of snapshots (volume, snapshot, dof, value) at once: spectra, modes, coefficients
    (each with volume) and status: volume, status (processed or failed), reason, n_snapshots, n_dofs, n_modes.

    Products of snapshots are summed in tasks of bounded size for each volume; a volume's covariance of snapshots, most^2 / 2
    numbers, is decomposed in a task. A volume that can't be (fewer than two snapshots or more than `most`, nothing with
    enough of them, no variance, numbers that overflow) fails alone."""
    known = snapshots.select("volume", "snapshot", "dof", F.col("value").cast("double").alias("value"))
    size = known.groupBy("volume").agg(F.count_distinct("snapshot").alias("n_snapshots"))
    mean = known.filter("value is not null").groupBy("volume", "dof").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).join(size, "volume")
    kept = mean.filter(F.col("n") >= F.greatest(F.ceil(min_fraction * F.col("n_snapshots")), F.lit(1))).select("volume", "dof", "mean")
    counts = size.join(kept.groupBy("volume").agg(F.count("*").alias("n_dofs")), "volume", "left").withColumn("n_dofs", F.coalesce("n_dofs", F.lit(0)))
    early = F.when(F.col("n_snapshots") < 2, "fewer than two snapshots").when(F.col("n_snapshots") > most, f"more than {most} snapshots").when(F.col("n_dofs") == 0, "nothing with enough snapshots")
    counts = cut(counts.withColumn("reason", early))
    good = counts.filter("reason is null").select("volume", "n_snapshots")
    # A volume that goes on has no more than `most` snapshots to number.
    number = (F.row_number().over(Window.partitionBy("volume").orderBy("snapshot")) - 1).alias("at")
    places = cut(known.select("volume", "snapshot").distinct().join(good.select("volume"), "volume").select("volume", "snapshot", number))
    x = known.filter("value is not null").join(kept, ["volume", "dof"]).join(places, ["volume", "snapshot"])
    x = cut(x.select("volume", "dof", "at", (F.col("value") - F.col("mean")).alias("x")))
    parts = x.groupBy("volume").agg(F.ceil(F.count("*") / VALUES).alias("_n")).join(good, "volume")
    kind = x.schema["volume"].dataType.simpleString()

    def products(group: pa.Table) -> pa.Table:
        n = group["n_snapshots"][0].as_py()
        at, of, v = group["at"].to_numpy(), pd.factorize(group["dof"].to_pandas())[0], group["x"].to_numpy()
        order = np.argsort(of, kind="stable")
        at, of, v = at[order], of[order], v[order]
        g = np.zeros((n, n))
        for s in range(0, int(of[-1]) + 1, CHUNK):
            p, q = np.searchsorted(of, (s, s + CHUNK))
            block = np.zeros((CHUNK, n))
            np.add.at(block, (of[p:q] - s, at[p:q]), v[p:q])
            g += block.T @ block
        i, j = np.triu_indices(n)
        return pa.table({"volume": pa.array([group["volume"][0].as_py()] * len(i), group.schema.field("volume").type), "i": i.astype(np.int32), "j": j.astype(np.int32), "g": g[i, j]})

    dealt = x.join(parts, "volume").withColumn("_part", F.pmod(F.xxhash64("dof"), F.col("_n"))).drop("_n")
    sums = dealt.groupBy("volume", "_part").applyInArrow(products, f"volume {kind}, i int, j int, g double").groupBy("volume", "i", "j").agg(F.sum("g").alias("g"))

    def eigen(group: pd.DataFrame) -> pd.DataFrame:
        volume, n = group["volume"].iloc[0], int(group["j"].max()) + 1
        try:
            g = np.zeros((n, n))
            g[group["i"], group["j"]] = g[group["j"], group["i"]] = group["g"]
            values, vectors = np.linalg.eigh(g / n)
            total = float(np.trace(g)) / n
            order = [k for k in np.argsort(values)[::-1] if values[k] > drop * total][:modes]
            if not order:
                raise ValueError("no variance")
            part = np.cumsum([values[k] / total for k in order])
            rows = [(volume, m + 1, values[k] / 2, values[k] / total, part[m], math.sqrt(values[k] * n), vectors[:, k].tolist(), None) for m, k in enumerate(order)]
        except Exception as e:  # this volume's reason; the others go on
            rows = [(volume, 0, None, None, None, None, None, str(e) or type(e).__name__)]
        return pd.DataFrame(rows, columns=["volume", "mode", "energy", "fraction", "cumulative", "scale", "vector", "reason"])

    found = cut(sums.groupBy("volume").applyInPandas(eigen, f"volume {kind}, mode int, energy double, fraction double, cumulative double, scale double, vector array<double>, reason string"))
    done = found.filter("reason is null")
    entries = done.select("volume", "mode", "scale", F.posexplode("vector").alias("at", "e"))
    phi = x.join(entries, ["volume", "at"]).groupBy("volume", "mode", "dof").agg((F.sum(F.col("x") * F.col("e")) / F.first("scale")).alias("phi"))
    phi = cut(phi)
    sign = phi.groupBy("volume", "mode").agg(F.signum(F.max_by("phi", F.struct(F.abs("phi"), "dof"))).alias("sign"))
    status = counts.join(found.groupBy("volume").agg(F.max("mode").alias("n_modes"), F.max("reason").alias("_late")), "volume", "left")
    reason = F.coalesce("reason", "_late")
    return {
        "spectra": done.select("volume", "mode", "energy", "fraction", "cumulative"),
        "modes": phi.join(sign, ["volume", "mode"]).select("volume", "mode", "dof", (F.col("phi") * F.col("sign")).alias("phi")),
        "coefficients": entries.join(sign, ["volume", "mode"]).join(places, ["volume", "at"]).select("volume", "mode", "snapshot", (F.col("e") * F.col("scale") * F.col("sign")).alias("a")),
        "status": status.select("volume", F.when(reason.isNull(), "processed").otherwise("failed").alias("status"), reason.alias("reason"), "n_snapshots", "n_dofs", F.coalesce("n_modes", F.lit(0)).alias("n_modes")),
    }


def batch_decompose(snapshots: DataFrame, folder: str, retry: bool = False, **settings) -> DataFrame:
    """decompose_volumes with its tables in a folder, by volume, and a manifest of status and settings. Volumes that the
    manifest has with the same settings are left as they are (failed ones too, unless they are to be tried again), so a run
    that broke off goes on; tables of a volume are replaced as a whole, and the manifest is written last."""
    from ..sources.catalog import exists

    spark = snapshots.sparkSession
    made_with = ", ".join(f"{k}={v}" for k, v in sorted(settings.items()))
    manifest = f"{folder}/manifest"
    todo = snapshots
    if exists(spark, manifest):
        before = spark.read.parquet(manifest).filter(F.col("settings") == made_with)
        before = before.filter("status = 'processed'") if retry else before
        todo = snapshots.join(before.select("volume").distinct(), "volume", "left_anti")
    found = decompose_volumes(todo, **settings)
    for name in ("spectra", "modes", "coefficients"):
        found[name].write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("volume").parquet(f"{folder}/{name}")
    status = cut(found["status"].withColumns({"settings": F.lit(made_with), "at": F.current_timestamp()}))
    status.write.mode("append").parquet(manifest)
    return status
