"""Readers of what operators have written: planes of means, of one phase bin and of harmonics, with the roles of their
axes; saved intensities; where the products of a case are; which cases move, and how often.

A plane is a row for each of its voxels: volume, axis, index and value say where it lies, horizontal_axis and
vertical_axis what its axes are, horizontal and vertical the voxel's coordinates along them. Coordinates come from an axes
table (volume, axis, idx, coord); without one they are the indices. An index below zero counts from the end of each
volume. A plane that some volume doesn't have is an IndexError: finding that out reads the index column once.
"""

from __future__ import annotations

import fnmatch
import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validity import finite, is_close, speed
from . import catalog
from .fields import VOXEL
from .text import case_label

#: For each axis a plane stands on: its horizontal and vertical axis; the velocity along each.
ROLES = {"z": ("x", "y"), "y": ("x", "z"), "x": ("y", "z")}
ALONG = {"x": "u", "y": "v", "z": "w"}
QUANTITIES = ("amplitude", "phase", "a", "b", "offset", "r2")


def _need(table: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in table.columns]
    if missing:
        raise KeyError(f"the product lacks {missing}")


def _one_of(what: str, value: str, known) -> None:
    if value not in known:
        raise ValueError(f"{what} is one of {list(known)}, not {value!r}")


def _at(table: DataFrame, axis: str, index: int) -> DataFrame:
    """The plane's rows, in every volume."""
    _one_of("axis", axis, ROLES)
    at = F.col(f"i{axis}")
    size = table.groupBy("volume").agg((F.max(at) + 1).alias("_planes"))
    short = size.filter((F.lit(index) >= F.col("_planes")) | (F.lit(-index) > F.col("_planes"))).agg(F.min("volume"), F.min_by("_planes", "volume")).first()
    if short[0] is not None:
        raise IndexError(f"no plane {index} along {axis} in {short[0]}, which has {short[1]}")
    if index >= 0:
        return table.filter(at == index)
    return table.join(size, "volume").filter(at == F.col("_planes") + index).drop("_planes")


def _with_roles(table: DataFrame, axis: str, axes: DataFrame | None) -> DataFrame:
    """Rows of a plane (VOXEL and more) with their place and the roles of the axes; VOXEL's indices are left out."""
    roles = {"value": axis, "horizontal": ROLES[axis][0], "vertical": ROLES[axis][1]}
    out = table.withColumn("index", F.col(f"i{axis}"))
    for name, a in roles.items():
        if axes is None:
            out = out.withColumn(name, F.col(f"i{a}").cast("double"))
        else:
            coords = axes.filter(F.col("axis") == a).select("volume", F.col("idx").alias(f"i{a}"), F.col("coord").cast("double").alias(name))
            out = out.join(coords, ["volume", f"i{a}"], "left")
    rest = [c for c in table.columns if c not in VOXEL]
    place = [F.lit(axis).alias("axis"), F.col("index"), F.col("value"), F.lit(roles["horizontal"]).alias("horizontal_axis"), F.lit(roles["vertical"]).alias("vertical_axis"), "horizontal", "vertical"]
    return out.select("volume", *place, *rest)


def _in_plane(axis: str) -> list[Column]:
    return [F.col(ALONG[a]).alias(f"vector_{side}") for side, a in zip(("horizontal", "vertical"), ROLES[axis])]


def mean_plane(mean: DataFrame, axis: str, index: int, axes: DataFrame | None = None) -> DataFrame:
    """A plane of a temporal mean: u, v, w, the two that lie in the plane, their counts and the speed. A product without
    counts of each component has those of whole vectors for all three, one without any has none; one without a speed has
    that of the mean components."""
    _need(mean, *VOXEL, "u_mean", "v_mean", "w_mean")
    means = [F.col(f"{c}_mean") for c in ALONG.values()]
    whole = F.col("vector_count") if "vector_count" in mean.columns else F.lit(None).cast("long")
    count = lambda c: (F.col(f"{c}_count") if f"{c}_count" in mean.columns else whole).alias(f"{c}_count")
    fast = F.col("speed_from_mean") if "speed_from_mean" in mean.columns else speed(*means)
    picked = _at(mean, axis, index).select(*VOXEL, *(m.alias(c) for m, c in zip(means, ALONG.values())), *map(count, ALONG.values()), whole.alias("vector_count"), fast.alias("speed"))
    return _with_roles(picked, axis, axes).select("*", *_in_plane(axis))


def _bin(bins: int, index: int) -> int:
    if not -bins <= index < bins:
        raise IndexError(f"no phase bin {index} of {bins}")
    return index % bins


def _vectors(averages: DataFrame, field: str) -> DataFrame:
    """Phase averages (a row for each component) as vectors with their counts."""
    one = lambda c, value: F.max(F.when(F.col("component") == c, F.col(value)))
    by = averages.groupBy(*VOXEL, "phase_bin").agg(*(one(c, field).alias(c) for c in ALONG.values()), *(one(c, "phase_count").alias(f"{c}_count") for c in ALONG.values()), F.max("bin_frames").alias("bin_frames"))
    phase = (F.col("phase_bin") + 0.5) * (2 * math.pi)
    return by.withColumn("_turn", phase)


def phase_plane(averages: DataFrame, bins: int, phase_bin: int, axis: str, index: int, field: str = "phase_mean", axes: DataFrame | None = None) -> DataFrame:
    """A plane of one phase bin, of its means or of their coherent parts: as mean_plane, with the bin's phase. Only rows
    of this bin and plane are put together."""
    _one_of("field", field, ("phase_mean", "coherent"))
    _need(averages, *VOXEL, "component", "phase_bin", "phase_count", "bin_frames", field)
    picked = _vectors(_at(averages, axis, index).filter(F.col("phase_bin") == _bin(bins, phase_bin)), field)
    turn = F.col("_turn") / bins
    picked = picked.withColumns({"field": F.lit(field), "phase": turn, "phase_degrees": F.degrees(turn), "speed": speed(F.col("u"), F.col("v"), F.col("w"))}).drop("_turn")
    return _with_roles(picked, axis, axes).select("*", *_in_plane(axis))


def phase_series(averages: DataFrame, bins: int, iz: int, iy: int, ix: int, field: str = "phase_mean") -> DataFrame:
    """All bins at one voxel of each volume: u, v, w, counts, frames and phase; bins that nothing falls into are missing."""
    _one_of("field", field, ("phase_mean", "coherent"))
    here = averages.filter((F.col("iz") == iz) & (F.col("iy") == iy) & (F.col("ix") == ix))
    turn = F.col("_turn") / bins
    return _vectors(here, field).withColumns({"phase": turn, "phase_degrees": F.degrees(turn)}).drop("_turn")


def harmonic_plane(harmonics: DataFrame, axis: str, index: int, component: str = "u", quantity: str = "amplitude", axes: DataFrame | None = None) -> DataFrame:
    """A plane of one quantity of a component's first harmonic (as column data)."""
    _one_of("component", component, ALONG.values())
    _one_of("quantity", quantity, QUANTITIES)
    _need(harmonics, *VOXEL, "component", quantity)
    picked = _at(harmonics, axis, index).filter(F.col("component") == component)
    return _with_roles(picked.select(*VOXEL, "component", F.lit(quantity).alias("quantity"), F.col(quantity).alias("data")), axis, axes)


def displayed(plane: DataFrame, min_count: int, limit: Column | None = None) -> DataFrame:
    """What an inspector shows of a plane: arrows of zero length where a component has fewer than min_count samples (or
    than the limit, which may differ between rows), the speed as it is, and which voxels are accepted (all, where one
    sample is enough)."""
    if min_count <= 1 and limit is None:
        return plane.withColumn("accepted", F.lit(True))
    least = F.lit(min_count) if limit is None else limit
    ok = F.coalesce((F.col("u_count") >= least) & (F.col("v_count") >= least) & (F.col("w_count") >= least), F.lit(False))
    shown = {c: F.when(ok, F.col(c)).otherwise(0.0) for c in ("vector_horizontal", "vector_vertical")}
    return plane.withColumns({**shown, "accepted": ok})


def around(axes: DataFrame, axis: str, center: float, half_width: float) -> DataFrame:
    """volume, idx and coord of an axis within half_width of the center, ends included. A volume without any is an error
    that names its nearest coordinate."""
    one = axes.filter(F.col("axis") == axis)
    inside = F.col("coord").between(center - half_width, center + half_width)
    away = F.struct(F.abs(F.col("coord") - center), F.col("idx"))
    empty = one.groupBy("volume").agg(F.count_if(inside).alias("n"), F.min_by(F.struct("coord", "idx"), away).alias("near")).filter("n = 0").agg(F.min_by("near", "volume"), F.min("volume")).first()
    if empty[1] is not None:
        raise ValueError(f"no {axis} within [{center - half_width:g}, {center + half_width:g}] in {empty[1]}; the nearest is {empty[0].coord:g} at {empty[0].idx}")
    return one.filter(inside).select("volume", "idx", "coord")


# Where products are. A product is a folder of Parquet files; what is listed here is folders, of which a case has a few.

#: What a mean must have to be one.
MEAN_COLUMNS = frozenset((*VOXEL, "u_mean", "v_mean", "w_mean"))
FOUND = "path string, label string"


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    Path, conf = catalog._files(spark)
    glob = Path(pattern)
    return [s.getPath().toString() for s in glob.getFileSystem(conf).globStatus(glob) or []]


def _below(spark: SparkSession, root: str, name: str) -> list[str]:
    """Folders or files of a name anywhere below a folder; products aren't looked into."""
    Path, conf = catalog._files(spark)
    found, todo = [], [root]
    while todo:
        p = Path(todo.pop())
        fs = p.getFileSystem(conf)
        for s in fs.listStatus(p) if fs.exists(p) and fs.getFileStatus(p).isDirectory() else []:
            if s.getPath().getName() == name:
                found.append(s.getPath().toString())
            elif s.isDirectory() and not s.getPath().getName().startswith((".", "_")):
                todo.append(s.getPath().toString())
    return found


def _has(spark: SparkSession, path: str, columns: frozenset[str]) -> bool:
    """Whether a product can be opened and has the columns; only its footer is read."""
    try:
        return catalog.exists(spark, path) and columns <= set(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def _label(spark: SparkSession, path: str) -> str:
    """The label a product was stored with, else its folder's name."""
    if catalog.exists(spark, f"{path}.attrs"):
        row = spark.read.parquet(f"{path}.attrs").filter("name = 'label'").first()
        if row:
            return row["value"]
    return path.rstrip("/").split("/")[-2]


def _excluded(path: str, patterns: tuple[str, ...]) -> bool:
    return any(fnmatch.fnmatchcase(part, p) for part in path.split("/") for p in patterns)


def _cased(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = [(p, _label(spark, p)) for p in sorted(set(paths))]
    return spark.createDataFrame(rows, FOUND).select("*", *case_label(F.col("label")))


def mean_products(spark: SparkSession, inputs: list[str], siblings: bool = False, exclude: tuple[str, ...] = ("*_z0",), name: str = "mean") -> DataFrame:
    """path, label, case and distance of the means that inputs name: products, folders that hold one, or folders to be
    searched. What lacks a mean's columns is none; a path with an excluded part is left out. With siblings a product
    stands for all distances of its case: the products in the folders beside its own whose label tells the same case."""
    usable = lambda p: not _excluded(p, exclude) and _has(spark, p, MEAN_COLUMNS)
    found: list[str] = []
    for given in (i.rstrip("/") for i in inputs):
        direct = given if given.split("/")[-1] == name else f"{given}/{name}"
        if not catalog.exists(spark, direct):
            found += filter(usable, _below(spark, given, name))
        elif usable(direct):
            if siblings:
                beside = _cased(spark, list(filter(usable, _listed(spark, f"{direct.rsplit('/', 2)[0]}/*/{name}"))))
                own = _cased(spark, [direct]).first()["case"]
                found += [r["path"] for r in beside.filter(F.col("case") == own).collect()]
            else:
                found += _listed(spark, direct)
    return _cased(spark, found)


def phase_products(spark: SparkSession, place: str, manifest: str = "manifest", name: str = "phase_average") -> DataFrame:
    """path, label, case and distance of phase averages: a product itself, else those that a folder's manifest notes as
    processed and those found below it, each once and only where there is something."""
    place = place.rstrip("/")
    found = _listed(spark, place) if place.split("/")[-1] == name else _below(spark, place, name)
    if place.split("/")[-1] != name and catalog.exists(spark, f"{place}/{manifest}"):
        noted = spark.read.parquet(f"{place}/{manifest}")
        if "output" in noted.columns:
            rows = noted.filter("status = 'processed' and output is not null").select("output").distinct()
            found += [p for r in rows.toLocalIterator() for p in _listed(spark, r["output"])]
    return _cased(spark, found)


#: Where a case's intensity may have been saved, the first that is there counts.
SAVED_INTENSITY = ("turbulence_intensity", "turbulence_intensity_saved_mean/turbulence_intensity", "turbulence_intensity/turbulence_intensity")


def intensity_volumes(spark: SparkSession, root: str, case: str, candidates: tuple[str, ...] = SAVED_INTENSITY) -> tuple[DataFrame, list[str]]:
    """Saved intensities (x, y, z, ti_percent) of all folders `<case>_...` below root, as one table with the folder's name
    as volume and its place in the order of mean x; and the folders of the case that have none. Coordinates that aren't
    finite are an error, as is a case without any."""
    needs = frozenset(("x", "y", "z", "ti_percent"))
    parts, without = None, []
    for folder in sorted(_listed(spark, f"{root.rstrip('/')}/*")):
        name = folder.split("/")[-1]
        if not name.lower().startswith(f"{case.lower()}_"):
            continue
        path = next((p for c in candidates if _has(spark, p := f"{folder}/{c}", needs)), None)
        if path is None:
            without.append(name)
            continue
        one = spark.read.parquet(path).select(F.lit(name).alias("volume"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "ti_percent")))
        parts = one if parts is None else parts.unionByName(one)
    if parts is None:
        raise ValueError(f"no saved intensity of {case!r} below {root}")
    broken = parts.filter(~(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))).agg(F.min("volume")).first()[0]
    if broken is not None:
        raise ValueError(f"coordinates of {broken} aren't finite")
    # Each coordinate of the axis counts once, however many voxels have it.
    order = catalog.in_order_of_x(parts.select("volume", "x").distinct()).select("volume", "place")
    return parts.join(order, "volume"), without


# Which cases move, and how often


def is_static(motion_type: Column, *names: Column) -> Column:
    """A case that is called static, by its type or by a token of one of its names (case, label, folder)."""
    said = F.lower(F.coalesce(motion_type, F.lit(""))) == "static"
    for n in names:
        said = said | F.coalesce(n, F.lit("")).rlike(r"(?i)(^|[_\W])static([_\W]|$)")
    return said


def moving(table: DataFrame, names: tuple[str, ...] = ("case_id", "label"), include_static: bool = False) -> DataFrame:
    """The cases that move; an error where none of them does, unless static ones are asked for."""
    if include_static:
        return table
    out = table.filter(~is_static(F.col("motion_type"), *map(F.col, names)))
    if out.isEmpty():
        raise ValueError(f"only static cases: {sorted(r[0] for r in table.select(names[0]).distinct().limit(20).collect())}")
    return out


def matching(table: DataFrame, part: str | None, names: tuple[str, ...] = ("case_id", "label")) -> DataFrame:
    """Cases with the part in one of their names, whatever its case; an error that says what there is where none has."""
    if part is None:
        return table
    hit = F.lit(False)
    for n in names:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(n)), F.lit(part.lower())), F.lit(False))
    out = table.filter(hit)
    if out.isEmpty():
        raise ValueError(f"no case has {part!r} in its name; there are {sorted(r[0] for r in table.select(names[0]).distinct().limit(20).collect())}")
    return out


def resolved_frequency(table: DataFrame, known: DataFrame | None = None, adjacent: DataFrame | None = None, explicit: float | None = None) -> DataFrame:
    """case_id, frequency, where it comes from, and an error, for cases (case_id, label, motion_type, and stored: the
    frequency kept with the recording). In this order: an explicit one; none for a static case; the stored one, an error
    if known (label, frequency) says another; the known one; the only one that phase averages beside the recording
    (adjacent: case_id, frequency) have, an error if they have several; none. Only positive numbers are frequencies."""
    if explicit is not None and not (math.isfinite(explicit) and explicit > 0):
        raise ValueError("a frequency is positive")
    good = lambda c: F.when(finite(F.col(c)) & (F.col(c) > 0), F.col(c).cast("double"))
    spark = table.sparkSession
    known = spark.createDataFrame([], "label string, frequency double") if known is None else known
    adjacent = spark.createDataFrame([], "case_id string, frequency double") if adjacent is None else adjacent
    beside = adjacent.groupBy("case_id").agg(F.min(good("frequency")).alias("_low"), F.max(good("frequency")).alias("_high"))
    by_label = known.groupBy("label").agg(F.max(good("frequency")).alias("_known"), F.lit(True).alias("_listed"))
    t = table.withColumn("_stored", good("stored")).join(by_label, "label", "left").join(beside, "case_id", "left")
    stored, listed = F.col("_stored"), F.col("_known")
    cases = [
        (F.lit(explicit is not None), F.lit(explicit), "explicit", None),
        (is_static(F.col("motion_type"), F.col("label")), F.lit(None), "static", None),
        (stored.isNotNull() & listed.isNotNull() & ~is_close(stored, listed), F.lit(None), "none", "stored and known frequency differ"),
        (stored.isNotNull(), stored, "stored", None),
        (F.coalesce(F.col("_listed"), F.lit(False)), listed, "known", None),
        (F.col("_low") == F.col("_high"), F.col("_low"), "adjacent", None),
        (F.col("_low") < F.col("_high"), F.lit(None), "none", "several frequencies beside it"),
    ]
    says = lambda pick, last: _first(cases, pick, last)
    return t.select("case_id", says(lambda c: c[1].cast("double"), F.lit(None).cast("double")).alias("frequency"), says(lambda c: F.lit(c[2]), F.lit("none")).alias("source"), says(lambda c: F.lit(c[3]).cast("string"), F.lit(None).cast("string")).alias("error"))


def _first(cases: list, pick, last: Column) -> Column:
    out = F.when(cases[0][0], pick(cases[0]))
    for c in cases[1:]:
        out = out.when(c[0], pick(c))
    return out.otherwise(last)
