"""Joins of a large, possibly skewed side with a lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

# Most rows of a lookup table that may be copied to every executor.
BROADCAST_ROWS = 200_000
# Most bytes of it, before any overhead.
BROADCAST_BYTES = 256 << 20
# A key with more rows than this on the large side is joined by broadcast.
HEAVY_ROWS = 1_000_000


def fits_broadcast(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `table` is within the row limit and the byte limit.

    One aggregate over the table: its rows, and the bytes of its texts; other
    columns count eight bytes each.
    """
    texts = [f.name for f in table.schema.fields if isinstance(f.dataType, T.StringType)]
    text_bytes = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in texts]
    got = table.agg(
        F.count(F.lit(1)).alias("rows"), sum(text_bytes, F.lit(0).cast("bigint")).alias("bytes")
    ).first()
    size = got["bytes"] + 8 * got["rows"] * (len(table.columns) - len(texts))
    return got["rows"] <= rows and size <= BROADCAST_BYTES


def heavy_keys(
    frequencies: DataFrame, key: str, count: str, heavy_rows: int, most_keys: int
) -> DataFrame | None:
    """Keys with too many rows for one task, at most `most_keys` of them; None if there are none.

    More than `most_keys` keys cannot each hold over 1/most_keys of all rows, so
    raising the limit to that share bounds their number.
    """
    got = frequencies.agg(F.sum(count).alias("rows"), F.max(count).alias("most")).first()
    limit = max(heavy_rows, (got["rows"] or 0) // most_keys)
    if (got["most"] or 0) <= limit:
        return None
    return cut_lineage(frequencies.filter(F.col(count) > limit).select(key))


SEARCH = object()


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    frequencies: DataFrame | None = None,
    count: str = "n",
    broadcast_rows: int = BROADCAST_ROWS,
    heavy_rows: int = HEAVY_ROWS,
    heavy=SEARCH,
) -> DataFrame:
    """Inner join of `rows` with `table` (unique `key`), safe against hot keys.

    A table within the broadcast limits is broadcast. A larger one is split by
    how often its keys occur in `rows`: the few heavy keys are broadcast, so
    their rows stay where they are, and only the light rest is shuffled. Every
    row is in exactly one of the two parts. `frequencies` (key, count) saves a
    counting pass where the caller knows them, and `heavy` (the result of
    `heavy_keys`) the search where several joins share it.
    """
    if fits_broadcast(table, broadcast_rows):
        return rows.join(F.broadcast(table), key)
    if heavy is SEARCH:
        if frequencies is None:
            frequencies = rows.groupBy(key).agg(F.count(F.lit(1)).alias(count))
        heavy = heavy_keys(frequencies, key, count, heavy_rows, broadcast_rows)
    if heavy is None:
        return rows.join(table, key)
    heavy_table = table.join(F.broadcast(heavy), key, "left_semi")
    hot = rows.join(F.broadcast(heavy_table), key)
    light_rows = rows.join(F.broadcast(heavy), key, "left_anti")
    light_table = table.join(F.broadcast(heavy), key, "left_anti")
    return hot.unionByName(light_rows.join(light_table, key))
