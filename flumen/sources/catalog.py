"""Cases, products and manifests."""

from __future__ import annotations

import fnmatch
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.order import few

from .text import case_label

CASE = "case_id string, label string, motion_type string, distance_raw string, distance double, frequency_hz double, u_inf double, rotor_diameter double, files map<string,string>"


@dataclass
class Settings:
    """What a batch ran with; written along with its manifest."""

    mode: str = "nan"
    mask: str = "component"
    min_fraction: float = 0.0
    more: dict[str, str] = field(default_factory=dict)


def _distance(raw) -> float | None:
    try:
        return float(str(raw).rstrip("D"))
    except ValueError:
        return None


def cases(spark: SparkSession, registry: dict, base: str = "") -> DataFrame:
    """A table of cases from a mapping (under `cases`, or bare); file paths that aren't absolute are taken from base."""
    rows = []
    number = lambda x: None if x is None else float(x)
    for name, c in (registry.get("cases") or registry).items():
        if c.get("downstream_distance") is None:
            raise ValueError(f"case {name} has no downstream_distance")
        files = {k: v if not base or str(v).startswith("/") or "://" in str(v) else f"{base}/{v}" for k, v in (c.get("files") or {}).items() if v}
        raw = str(c["downstream_distance"])
        rows.append((name, c.get("label", name), c.get("motion_type"), raw, _distance(raw), number(c.get("frequency_hz")), number(c.get("u_inf")), number(c.get("rotor_diameter")), files))
    return spark.createDataFrame(rows, CASE)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from a YAML file."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    return cases(spark, yaml.safe_load(text), path.rsplit("/", 1)[0])


def incomplete(table: DataFrame, *, u_inf: bool = True, phase: bool = False) -> DataFrame:
    """case_id and reason for cases that lack what an average needs."""
    needs = [(F.col("files").getItem("velocity").isNull(), "no velocity file")]
    needs += [(F.col("u_inf").isNull(), "no u_inf")] * u_inf
    needs += [(F.col("files").getItem("phase_signal").isNull() & F.coalesce(F.col("frequency_hz") <= 0, F.lit(True)), "no phase signal or frequency")] * phase
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in needs)))
    return table.select("case_id", F.array_join(reasons, "; ").alias("reason")).filter("reason <> ''")


def discover(spark: SparkSession, root: str, pattern: str = "*.parquet", exclude: tuple[str, ...] = ("*_z0",)) -> DataFrame:
    """path, size, modified, case and distance of the files below a folder, but for those with an excluded path part."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    bad = [fnmatch.translate(p).replace("(?s:", "(?s)(").replace(r"\Z", "$").replace(r"\z", "$") for p in exclude]
    for p in bad:
        found = found.filter(~F.exists(F.split("path", "/"), lambda part: part.rlike(f"^{p}")))
    return found.dropDuplicates(["path"]).select("*", *case_label(F.col("path")))


def fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, size, modified and SHA-256 of files; each file in a task."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def incomplete_matrix(found: DataFrame) -> DataFrame:
    """Pairs of case and distance that are missing although both occur, or that occur twice, with the reason."""
    pairs = found.select("case").distinct().crossJoin(few(found.select("distance").distinct()))
    by = found.groupBy("case", "distance").agg(F.count("*").alias("n"))
    out = pairs.join(by, ["case", "distance"], "left")
    return out.select("case", "distance", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").alias("reason")).filter("reason is not null")


def _files(spark: SparkSession):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()


def exists(spark: SparkSession, path: str) -> bool:
    Path, conf = _files(spark)
    p = Path(path)
    return p.getFileSystem(conf).exists(p)


def available(spark: SparkSession, base: str) -> str:
    """base, or base_02, base_03, ... , the first that isn't there yet."""
    n = 1
    while exists(spark, base if n == 1 else f"{base}_{n:02d}"):
        n += 1
    return base if n == 1 else f"{base}_{n:02d}"


def resolve(spark: SparkSession, root: str, case_id: str, product: str, processing_id: str | None = None) -> str:
    """The one place of a product of a case; fails if there is none, or several and no processing_id."""
    Path, conf = _files(spark)
    glob = Path(f"{root}/{processing_id or case_id + '*'}/{product}")
    found = [s.getPath().toString() for s in glob.getFileSystem(conf).globStatus(glob) or []]
    if not found:
        raise FileNotFoundError(f"{product} of {case_id} below {root}")
    if len(found) > 1:
        raise ValueError(f"several {product} of {case_id}, name a processing_id: {found}")
    return found[0]


def write_product(df: DataFrame, path: str, overwrite: bool = False, attrs: dict[str, str] | None = None) -> None:
    """A product as Parquet; not over one that is there, unless asked to. The attributes go into a table beside it."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    if attrs:
        df.sparkSession.createDataFrame(sorted(attrs.items()), "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}.attrs")


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A report with a header, in one file: for results that are small by nature."""
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


MANIFEST = "path string, status string, reason string"
STATUS = ("processed", "exists", "skipped", "dry-run", "failed")


def write_manifest(spark: SparkSession, path: str, rows: list[tuple[str, str, str | None]], settings: Settings) -> None:
    """What a batch did with each input: a status of STATUS and a reason; appended, with the settings."""
    wrong = {s for _, s, _ in rows} - set(STATUS)
    if wrong:
        raise ValueError(f"no status: {wrong}")
    s = asdict(settings)
    put = F.create_map(*(F.lit(str(x)) for k, v in s.items() if k != "more" for x in (k, v)), *(F.lit(x) for k, v in s["more"].items() for x in (k, v)))
    spark.createDataFrame(rows, MANIFEST).withColumns({"settings": put, "at": F.current_timestamp()}).coalesce(1).write.mode("append").parquet(path)


def coverage_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, retained, total, percent and error from JSON summaries; those that aren't coverage summaries are left out,
    broken ones have an error."""
    raw = spark.read.schema("retained long, total long, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(paths).withColumn("path", F.input_file_name())
    bad = F.when(F.col("_broken").isNotNull(), "not JSON").when((F.col("retained") < 0) | (F.col("retained") > F.col("total")) | (F.col("total") <= 0), "counts don't fit")
    return raw.withColumn("error", bad).filter("error is not null or (retained is not null and total is not null)").select("path", "retained", "total", F.when(F.col("error").isNull(), 100.0 * F.col("retained") / F.col("total")).alias("percent"), "error")


def forcing_frequency(table: DataFrame, explicit: float | None = None) -> DataFrame:
    """case_id, frequency and where it comes from: explicit, none for a static case, else the case's own."""
    static = F.lower(F.coalesce("motion_type", F.lit(""))) == "static"
    f = F.when(F.lit(explicit is not None), F.lit(explicit)).when(static, F.lit(None)).otherwise(F.col("frequency_hz"))
    source = F.when(F.lit(explicit is not None), "explicit").when(static, "static").when(F.col("frequency_hz").isNotNull(), "case").otherwise("none")
    return table.select("case_id", f.cast("double").alias("frequency"), source.alias("source"))


def with_reference(table: DataFrame, explicit: float | None = None) -> DataFrame:
    """cases with u_ref: the explicit speed, else the case's own; a row without either is marked by has_u_ref."""
    u = F.coalesce(F.lit(explicit).cast("double"), F.col("u_inf"))
    return table.withColumns({"u_ref": u, "has_u_ref": u.isNotNull() & (u != 0)})


def inherited_mode(attrs: dict[str, str], explicit: str | None = None) -> str:
    """The validity mode of a product: explicit, else as stored with it, else nan."""
    return explicit or attrs.get("invalid_samples") or "nan"


def phase_list(text: str) -> list[float]:
    """Angles in degrees from a comma list, within a turn."""
    return [float(x) % 360 for x in text.split(",") if x.strip()]


def component_list(text: str, known: tuple[str, ...] = ("u", "v", "w")) -> list[str]:
    """Components from a comma list, without repeats, in order."""
    found = list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))
    if not set(found) <= set(known):
        raise ValueError(f"components are some of {known}")
    return found


def write_mask(mask: DataFrame, path: str, settings: dict[str, str], source: str) -> None:
    """A product of the voxels (iz, iy, ix) that a run may use, with the settings it comes from and its source's place,
    size and time of change beside it."""
    spark = mask.sparkSession
    size, modified = _stamp(spark, source)
    attrs = {**{k: str(v) for k, v in settings.items()}, "source": source, "source_size": str(size), "source_modified": str(modified)}
    write_product(mask.select("iz", "iy", "ix"), path, attrs=attrs)


def read_mask(spark: SparkSession, path: str, settings: dict[str, str], source: str) -> DataFrame:
    """The mask's voxels; fails if it is empty, has repeated voxels, was made with other settings, or its source has
    changed since."""
    mask = spark.read.parquet(path)
    if {"iz", "iy", "ix"} - set(mask.columns):
        raise ValueError(f"{path} is no mask")
    have = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}.attrs").collect()}  # a handful
    size, modified = _stamp(spark, source)
    want = {**{k: str(v) for k, v in settings.items()}, "source": source, "source_size": str(size), "source_modified": str(modified)}
    wrong = sorted(k for k, v in want.items() if have.get(k) != v)
    if wrong:
        raise ValueError(f"the mask at {path} doesn't fit: {wrong}")
    n, distinct = mask.agg(F.count("*"), F.count_distinct("iz", "iy", "ix")).first()
    if not n or n != distinct:
        raise ValueError(f"the mask at {path} is empty or has repeated voxels")
    return mask


def _stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes and time of change of a file, or of all files of a folder."""
    Path, conf = _files(spark)
    p = Path(path)
    fs = p.getFileSystem(conf)
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


BANDS = "case string, distance double, low double, high double, band_energy double, fraction double, total double"


def band_tables(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Band energies of cases from reports; fails if they can't be right (see compare.broken_bands)."""
    from ..operators.compare import broken_bands

    rows = spark.read.schema(BANDS).option("header", True).csv(paths)
    broken = broken_bands(rows, ["case", "distance"]).orderBy("case", "distance").limit(5).collect()
    if broken:
        raise ValueError(f"band tables that can't be right: {[tuple(r) for r in broken]}")
    return rows


def in_order_of_x(volumes: DataFrame, x: str = "x") -> DataFrame:
    """volume and place: volumes of a case in the order of their mean x."""
    from ..plans.order import running

    means = volumes.groupBy("volume").agg(F.avg(x).alias("mean_x"))
    return running(means, [F.col("mean_x"), F.col("volume")], {"place": F.lit(1)})
