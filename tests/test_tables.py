"""Tables in several blocks, also in files of many splits; spellings of columns."""

from __future__ import annotations

import pytest

from flumen.operators.vortex import infer_columns
from flumen.sources import text

HEAD = 'TITLE = "a field"\nVARIABLES = "X [mm]", "Y", "Z"\n"lambda_ci^2"\n"Velocity_X"\n'


def block(zone, n, title=None, size=None):
    lines = [f'ZONE T="{title or zone}"' + (f", I={size[0]}, J={size[1]}" if size else "")] + ([f" K={size[2]}, F=POINT"] if size else [])
    return "\n".join(lines + [f"{i}.5  {zone}  -1.0E+00 {zone * 1000 + i} NaN" for i in range(n)]) + "\n"


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("split", [False, True])
def test_zones_are_numbered_across_splits(spark, tmp_path, split, request):
    if split:
        request.getfixturevalue("small_splits")
    sizes = [40, 0, 1, 90, 7]
    for name in ("a.dat", "b.dat"):
        (tmp_path / name).write_text(HEAD.replace("X [mm]", "coord_x") + "".join(block(z + 1, n, size=(n, 1, 1) if z != 2 else None) + "# a note\n\n" for z, n in enumerate(sizes)))
    rows, zones = text.zoned_table(spark, str(tmp_path))
    if split:
        assert rows.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    got = sorted((z.file[-5:], z.zone, z.title, z.i, z.j, z.k, z.n) for z in zones.collect())
    assert got == [(f, z + 1, str(z + 1), *((n, 1, 1) if z != 2 else (None,) * 3), n) for f in ("a.dat", "b.dat") for z, n in enumerate(sizes)]
    found = sorted((r.file[-5:], r.zone, r.row, r.x, r.y, r.z, r.swirl) for r in rows.collect())
    assert found == [(f, z + 1, i, i + 0.5, z + 1.0, -1.0, (z + 1) * 1000.0 + i) for f in ("a.dat", "b.dat") for z, n in enumerate(sizes) for i in range(n)]


def test_rows_before_any_zone_and_other_separators(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# made by hand\nposition_x; pos_y; zcoordinate; swirling_strength_squared\n1; 2; 3; 4\n5;6;7;1.5D+01\n")
    rows, zones = text.zoned_table(spark, str(tmp_path / "t.csv"))
    assert [(r.zone, r.row, r.x, r.swirl) for r in rows.orderBy("row").collect()] == [(0, 0, 1.0, 4.0), (0, 1, 5.0, 15.0)]
    assert [(z.zone, z.title, z.n) for z in zones.collect()] == [(0, None, 2)]
    assert [(r.x, r.swirl) for r in text.field_table(spark, str(tmp_path / "t.csv")).collect()] == [(1.0, 4.0), (5.0, 15.0)]


def test_a_row_of_another_width_is_an_error(spark, tmp_path):
    (tmp_path / "t.dat").write_text(HEAD.replace("X [mm]", "x") + "ZONE\n1 2 3 4 5\n1 2 3\n")
    with pytest.raises(Exception, match="the header has 5 columns, a row has 3"):
        text.zoned_table(spark, str(tmp_path / "t.dat"))[0].collect()


@pytest.mark.parametrize("first", ["1 2 3 4", "-1.0E+00,2,3,nan"])
def test_numbers_without_a_header_are_refused(first):
    with pytest.raises(ValueError, match="header"):
        text.table_header([first, first])


def test_signals_keep_the_order_of_the_file(spark, tmp_path, small_splits):
    (tmp_path / "phase.txt").write_text("".join(f"{i}, {i / 7}\n" + ("\n" if i % 5 == 0 else "") for i in range(400)))
    got = sorted((r.ti, r.phase) for r in text.phase_signal(spark, str(tmp_path / "phase.txt")).collect())
    assert got == [(i, i / 7) for i in range(400)]


@pytest.mark.parametrize("names", [["X", "Y", "Z", "Lambda_ci^2"], ["coord_x", "coord_y", "coord_z", "swir"], ["PosX", "PosY", "PosZ", "lambda_2"], ["x_coordinate", "y_coordinate", "z_coordinate", "swirling_2"]])
def test_spellings(names):
    assert list(infer_columns([*names, "u_velocity", "uy", "Velocity Z"]).values()) == [*names, "u_velocity", "uy", "Velocity Z"]
