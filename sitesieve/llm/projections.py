"""Near duplicates among embeddings by collision counting over one-dimensional projections, of which one is sorted.

Each vector is projected on many random directions. Two vectors collide in a projection if one lies in the
window centred on the other; pairs that collide often enough are verified by their cosine. For a pair
at the threshold the difference of two projections is normal with a known spread, so the least number of
collisions is set from the binomial law to miss such a pair with a given small probability.

The table is sorted by the first projection and cut into blocks; only blocks whose ranges come within the
widest difference a similar pair can have are brought together. A block is a stretch of a file in the shared
folder, written once and read by each of its pairs, so what moves is names of blocks and no copy of a block. Inside
such a pair of blocks collisions are counted in tiles, so no pair of vectors is ever a row; what leaves is per vector
the number of its links and edges that connect what is linked. Equal vectors are collapsed first and counted by their number.

Rules for odd rows: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, and vectors of different lengths do not link; ids may be null or repeated, every row counts; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_folder, cut_lineage, open_shared, remove
from .base import join_rows
from .components import components

SEED = 20240229
PROJECTIONS = 24
# Half-width of a window in spreads of the difference of a pair at the threshold.
WIDTH = 1.6
MISS = 1e-7
BLOCK = 4096
TILE = 256
# Candidates of a tile up to this number are verified one by one, more by one product.
FEW = 2048
# Pairs of blocks that a task compares, if there are more than four times as many per core.
PAIRS_AT_ONCE = 8
# A row per vector: its number, and the block that holds it.
PLACED = "v bigint, block bigint, size int, low double, high double, n bigint, file string, start bigint"


def directions(dimensions: int, projections: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dimensions, projections))


def spread_of(cosine: float) -> float:
    """Standard deviation of the difference of two projections of unit vectors with this cosine."""
    return math.sqrt(2 - 2 * cosine)


def least_collisions(projections: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold stays below with probability `miss` at most."""
    p = math.erf(width / math.sqrt(2))
    below = 0.0
    for k in range(projections + 1):
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > miss:
            return k
    return projections


def _first_window(cosine: float) -> float:
    """The first projection of a similar pair differs by more with probability 6e-7 only."""
    return 5 * spread_of(cosine)


def _stored(vectors: DataFrame) -> str:
    """The type in which components are stored; all sums are of doubles."""
    return "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"


def _pack(stored: str):
    """Usable vectors as bytes; of the others nothing but a mark."""
    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            # a null component is NaN, and so is the length of its vector
            x = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
            filled, length = sizes > 0, np.zeros(len(sizes))
            if filled.any():
                with np.errstate(over="ignore", invalid="ignore"):
                    length[filled] = np.sqrt(np.add.reduceat(x * x, ends[:-1][filled]))
            usable = np.isfinite(length) & (length > 0)
            with np.errstate(over="ignore", invalid="ignore"):
                data, width = x.astype(stored).tobytes(), int(stored[-1])
            packed = [data[a * width : b * width] if ok else None for a, b, ok in zip(ends[:-1], ends[1:], usable)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["vec_id", "vector"])

    return run


def _first_projection(stored: str):
    def run(batches):
        for batch in batches:
            packed = batch.column("vector").to_pylist()
            sizes = np.array([len(v) for v in packed], np.int64)
            along = np.zeros(len(packed))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(packed[k] for k in rows), stored).reshape(len(rows), -1).astype("<f8")
                along[rows] = (x / np.linalg.norm(x, axis=1)[:, None]) @ directions(x.shape[1], 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(along)], [*batch.schema.names, "along"])

    return run


def _blocks(size: int, folder: str):
    """Consecutive rows of a sorted partition as blocks of at most `size` vectors of one length, in a file of the partition.

    Per vector: its content, first id and copies, its number and its block. A file of an attempt that failed is named by no row.
    """
    def run(batches):
        from pyspark import TaskContext

        part, number, at, out, name = TaskContext.get().partitionId(), 0, 0, None, f"{folder}/{uuid.uuid4().hex}.block"
        for batch in batches:
            lengths = pc.binary_length(batch.column("vector")).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(lengths)) + 1), len(lengths)]
            for a, b in zip(edges[:-1], edges[1:]):
                for s in range(a, b, size):
                    rows, block = batch.slice(s, min(size, b - s)), part << 32 | number
                    n, along, numbers = rows.num_rows, rows.column("along"), block * size + np.arange(min(size, b - s))
                    if out is None:
                        fs, path = open_shared(name)
                        fs.create_dir(path.rpartition("/")[0], recursive=True)
                        out = fs.open_output_stream(path)
                    data = b"".join([
                        numbers.astype("<i8").tobytes(), rows.column("copies").to_numpy().astype("<i8").tobytes(), *rows.column("vector").to_pylist()])
                    out.write(data)
                    same = [(block, pa.int64()), (int(lengths[s]), pa.int32()), (along[0].as_py(), pa.float64()), (along[-1].as_py(), pa.float64()),
                            (n, pa.int64()), (name, pa.string()), (at, pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("content"), rows.column("first_id"), rows.column("copies"), pa.array(numbers, pa.int64()),
                         *[pa.array([value] * n, kind) for value, kind in same]],
                        ["content", "first_id", "copies", "v", "block", "size", "low", "high", "n", "file", "start"],
                    )
                    number, at = number + 1, at + len(data)
        if out is not None:
            out.close()

    return run


def _read_block(file: str, start: int, n: int, size: int, stored: str):
    """Numbers, copies and vectors of a block."""
    fs, path = open_shared(file)
    with fs.open_input_file(path) as stream:
        data = stream.read_at(n * (16 + size), start)
    if len(data) != n * (16 + size):
        raise OSError(f"a block of {file} is cut off")
    vectors = np.frombuffer(data, stored, offset=16 * n).reshape(n, -1).astype("<f8")
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n), vectors


class _Links:
    """Groups of connected rows of two blocks, and the number of links of each row."""

    def __init__(self, n: int):
        self.parent, self.links = np.arange(n), np.zeros(n, np.int64)

    def connect(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every row points at the root of its group, before and after."""
        while True:
            x, y = self.parent[a], self.parent[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))
            while (self.parent[self.parent] != self.parent).any():
                self.parent = self.parent[self.parent]


def _count_tile(p: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
    """Per pair of rows the number of projections in which they collide (quantised to 16 bits)."""
    total = np.zeros((p.shape[1], q.shape[1]), np.uint8)
    gap = np.empty(total.shape, np.uint16)
    near = np.empty(total.shape, bool)
    for a, b in zip(p, q):
        # the window from -width to +width becomes one comparison of unsigned numbers that wrap around
        np.subtract((a + np.uint16(width))[:, None], b[None, :], out=gap)
        np.less_equal(gap, np.uint16(2 * width), out=near)
        np.add(total, near.view(np.uint8), out=total)
    return total


def _quantised(x: np.ndarray, unit: float) -> np.ndarray:
    return (np.rint(x / unit).astype(np.int64) & 0xFFFF).astype(np.uint16)


def link_blocks(x, y, copies_x, copies_y, same: bool, cosine: float, projections: int = PROJECTIONS):
    """Links among the rows of two blocks (or within one): counts weighted by copies, and a spanning set of edges."""
    ux, uy = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
    axes = directions(x.shape[1], projections)
    unit = spread_of(cosine) / 512
    # a step more on either side makes up for rounding
    width, least = int(WIDTH * 512) + 2, least_collisions(projections)
    p, q = _quantised(ux @ axes, unit).T.copy(), _quantised(uy @ axes, unit).T.copy()
    state, n = _Links(len(x) + len(y)), len(x)
    for s in range(0, len(x), TILE):
        rows = slice(s, s + TILE)
        t = s if same else 0
        total = _count_tile(p[:, rows], q[:, t:], width)
        a, b = np.nonzero(total >= least)
        if not len(a):
            continue
        if len(a) <= FEW:
            cos = np.einsum("ij,ij->i", ux[a + s], uy[b + t])
        else:
            cos = (ux[rows] @ uy[t:].T)[a, b]
        keep = cos >= cosine
        a, b = a[keep] + s, b[keep] + t
        if same:
            a, b = a[a < b], b[a < b]
        np.add.at(state.links, a, copies_y[b])
        np.add.at(state.links, b if same else b + n, copies_x[a])
        state.connect(a, b if same else b + n)
    return state


def _link(cosine: float, stored: str):
    """Links of listed pairs of blocks, which are read from their files."""
    def run(batches):
        held, block = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    block, held = row["block"], _read_block(row["file"], row["start"], row["n"], row["size"], stored)
                numbers, copies, x = held
                same = row["other"] == block
                others = held if same else _read_block(row["other_file"], row["other_start"], row["other_n"], row["size"], stored)
                state = link_blocks(x, others[2], copies, others[1], same, cosine)
                ids = np.concatenate([numbers, others[0]])
                seen = np.flatnonzero(state.links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[seen]), pa.array(state.links[seen]), pa.array(ids[state.parent[seen]])],
                    ["v", "links", "root"],
                )

    return run


def _block_pairs(blocks: DataFrame, reach: float) -> DataFrame:
    """Pairs of blocks of one length whose ranges come within `reach` of each other, with the places of both in their files."""
    cells = blocks.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / reach), F.floor(F.col("high") / reach) + 1)))
    names = {"block": "other", "low": "other_low", "high": "other_high", "n": "other_n", "file": "other_file", "start": "other_start"}
    # ranges that come within reach of each other share a cell
    close = cells.join(cells.withColumnsRenamed(names), ["size", "cell"]).filter(
        (F.col("other_low") <= F.col("high") + reach) & (F.col("low") <= F.col("other_high") + reach) & (F.col("block") <= F.col("other"))
    )
    return close.select("size", "block", "file", "start", "n", "other", "other_file", "other_start", "other_n").distinct()


def near_vectors(vectors: DataFrame, cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of `vectors` (`vec_id`, `embedding`)."""
    kind, stored, spark = vectors.schema["vec_id"].dataType.simpleString(), _stored(vectors), vectors.sparkSession
    packed = vectors.select("vec_id", "embedding").mapInArrow(_pack(stored), f"vec_id {kind}, vector binary")
    packed = packed.withColumn("content", F.when(F.col("vector").isNotNull(), F.unhex(F.md5("vector"))))
    # vectors are packed again where they are needed, as writing them would take as much disk as the table
    rows = cut_lineage(packed.select("vec_id", "content"))
    distinct = packed.filter("content is not null").groupBy("content").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")
    )
    along = distinct.mapInArrow(
        _first_projection(stored), f"content binary, first_id {kind}, copies bigint, vector binary, along double"
    )
    # vectors of another length are kept apart
    size = rows.filter("content is not null").agg(F.count_distinct("content")).first()[0]
    parts = max(1, -(-size // block))
    length = F.octet_length("vector")
    sorted_rows = along.repartitionByRange(parts, length, "along", "content").sortWithinPartitions(length, "along", "content")
    folder = f"{cut_folder(spark)}/{uuid.uuid4().hex}"
    numbered = cut_lineage(sorted_rows.mapInArrow(
        _blocks(block, folder), f"content binary, first_id {kind}, copies bigint, {PLACED}"))
    pairs = cut_lineage(_block_pairs(numbered.select("block", "size", "low", "high", "n", "file", "start").distinct(), _first_window(cosine)))
    n_pairs, cores = max(1, pairs.count()), spark.sparkContext.defaultParallelism
    met = pairs.repartition(min(n_pairs, max(4 * cores, n_pairs // PAIRS_AT_ONCE))).sortWithinPartitions("block", "other")
    found = cut_lineage(met.mapInArrow(_link(cosine, stored), "v bigint, links bigint, root bigint"))
    remove(spark, folder)
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("v").alias("a"), F.col("root").alias("b")))
    known = numbered.select("v", "content", "first_id", "copies").join(links, "v", "left").join(joined, "v", "left")
    known = known.withColumn("label", F.coalesce("component", "v"))
    classes = known.groupBy("label").agg(F.min("first_id").alias("component_id"))
    per_content = known.join(classes, "label").select(
        "content", (F.coalesce("links", F.lit(0).cast("bigint")) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    named = join_rows(rows.select("vec_id", "content"), per_content, "left", ("content",))
    component = F.coalesce("component_id", "vec_id")
    return named.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )

