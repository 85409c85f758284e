"""Tiles of grids: what needs neighbours is dealt out by blocks of bounded size instead of being joined with them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Voxels along each edge of a tile.
SIZE = 32


def by_tile(cells: DataFrame, keys: list[str], axes: list[str], columns: list[str], work: Callable[[np.ndarray, dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]], out: StructType, size: int = SIZE, carry: list[str] = ()) -> DataFrame:
    """One call of `work` for each tile, of the tile's cells and those that border it at its upper ends (its halo), so
    that each cell meets the ones ahead of it in some tile. work gets the tile's first indices, the columns, and the
    places of its rows within the tile (rows by axes, 0 to size); it returns columns of `out`, to which keys are added.
    Columns to carry are those of the rows whose numbers it returns as "rows". A cell comes once for each tile it is in:
    about 1 + axes / size times on average."""
    dealt = cells.select(*keys, *axes, *(c for c in dict.fromkeys([*columns, *carry]) if c not in axes))
    names, schema = [f"_tile_{a}" for a in axes], StructType([cells.schema[k] for k in keys] + [cells.schema[c] for c in carry] + out.fields)
    for a, t in zip(axes, names):
        own = F.floor(F.col(a) / size)
        dealt = dealt.withColumn(t, F.explode(F.when(F.pmod(F.col(a), F.lit(size)) == 0, F.array(own - 1, own)).otherwise(F.array(own))))

    arrow = to_arrow_schema(schema)

    def call(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        origin = np.array([group[t][0].as_py() for t in names]) * size
        at = np.stack([group[a].to_numpy() for a in axes], 1).astype(np.int64) - origin
        if (at.min(0) == size).any():  # nothing but a halo
            return arrow.empty_table()
        found = work(origin, {c: group[c].to_numpy() for c in columns}, at)
        rows = found.pop("rows", None)
        n = len(next(iter(found.values())))
        own = {k: pa.array([group[k][0].as_py()] * n, arrow.field(k).type) for k in keys} | {c: group[c].take(pa.array(rows)) for c in carry}
        return pa.table(own | {c: pa.array(list(v) if getattr(v, "ndim", 1) > 1 else v, arrow.field(c).type) for c, v in found.items()}, arrow)

    return dealt.groupBy(*keys, *names).applyInArrow(call, schema)
