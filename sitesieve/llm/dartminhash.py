"""Near duplicates by DartMinHash signatures, banded joining and exact verification.

A document is the multiset of its five-word shingles: the weight of a shingle is how often it occurs, the
similarity of two documents the sum of the smaller weights over the sum of the larger ones. Darts are thrown
by hash into the plane of (weight, rank) above each shingle, about one per unit cell; those below the
shingle's weight hit. Each hit belongs to one coordinate, and the earliest (lowest rank) per coordinate is
the signature: two documents agree in a coordinate with the probability of their similarity. Only as many
ranks are opened as fill all coordinates, so short and long documents cost about the same.

Exact copies are collapsed before anything else. Documents that agree in a band share a bucket. In a bucket
members are compared with a leader, not with each other; there are more leaders from round to round, a leader
leaves the bucket once all others met it, members known to be connected are not compared again, nor are two whose
distances from the first leader differ by more than a link is long (distances obey the triangle inequality),
nor two whose signatures agree too seldom for a link, by a bound that a pair at the threshold misses with
probability 1e-6. A pair leaves the bucket of the first band that it shares and no other. So no pair in a bucket
goes untried unless it is connected anyway, and none is tried in every band. What is compared is compared exactly.

Rules for odd rows: null and empty texts and texts without words are no copies of anything, unless (with some
character in them) equal in full; ids may be null or repeated; a repeated row is a copy of the other; other
columns are not looked at.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, release
from .base import ROWS_OF_FILE, checked_broadcast, cut_few, join_rows, slices, spare
from .components import components, nearer_roots
from .shingles import U, chunks, mix, shingle_sets

WIDTH = 5
SIMILARITY = 0.8
# A pair at the threshold is missed with probability (1 - 0.8**5) ** 32 < 4e-6.
BANDS, ROWS = 32, 5
# Coordinates of a signature; those beyond the bands serve the estimate alone, which keeps two bits of each.
COORDINATES = 640
# A pair at the threshold is dropped by the estimate with this probability at most.
MISS = 1e-6
# Times the leaders of a bucket that the next round has.
MORE_LEADERS = 32
# Pairs that a task compares, if there are more than four times as many as cores take.
PAIRS_OF_TASK = 10_000
# Pairs of members and leaders that a task looks at (1.7 microseconds each), if they are more than the cores take.
MET_OF_TASK = 2_000_000
# Rows of a few numbers, and whole texts, that are worth a file.
NARROW_ROWS, TEXT_ROWS = 10 * ROWS_OF_FILE, 2_000
# Leaders of a round, of 450 bytes each, that may be copied to every executor.
LEADERS_SENT = 64_000
# Shingles that a task remembers, of the texts it met last (32 MB).
REMEMBERED = 1 << 21
# Cells worked on at once (some 130 bytes each).
CELLS = 1 << 17

_RANK_BITS = U(40)
# Cumulated probabilities of 0, 1, 2, ... darts in a cell, times 2^32.
_DARTS = np.array([math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(13)]) * 2.0**32
_NONE = U(0xFFFFFFFFFFFFFFFF)


def _throw(elements, weights, docs, low, high, coordinates, best) -> None:
    """Throw the darts of the rank cells low..high-1 of each document and keep the earliest in `best`."""
    deep = (high - low)[docs]
    wide = np.ceil(weights).astype(np.int64)
    per = deep * wide
    which = np.repeat(np.arange(len(elements)), per)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per)
    across, rank = nth // deep[which], nth % deep[which] + low[docs[which]]
    cell = mix(elements[which] + across.astype(U) * U(0xD6E8FEB86659FD93) + rank.astype(U) * U(0xA0761D6478BD642F))
    darts = np.searchsorted(_DARTS, (cell >> U(32)).astype(np.float64), side="right")
    hit = np.repeat(np.arange(len(cell)), darts)
    number = np.arange(len(hit)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = mix(cell[hit] + (number.astype(U) + U(1)) * U(0xE7037ED1A0B428DB))
    place = mix(dart)
    inside = across[hit] + (place >> U(32)).astype(np.float64) / 2.0**32 < weights[which[hit]]
    key = (rank[hit].astype(U) << _RANK_BITS) | (dart >> U(24))
    slot = docs[which[hit]] * coordinates + ((place & U(0xFFFFFFFF)) * U(coordinates) >> U(32)).astype(np.int64)
    np.minimum.at(best, slot[inside], key[inside])


def signatures(elements: np.ndarray, weights: np.ndarray, docs: np.ndarray, n_docs: int, coordinates: int) -> np.ndarray:
    """One row of `coordinates` 64-bit values per document; documents without elements get none (all ones).

    Weights may be fractions. They are best of the order of one: a cell is one unit of weight wide.
    """
    total = np.bincount(docs, weights, n_docs)
    wanted = coordinates * math.log(coordinates) + 2 * coordinates
    best = np.full(n_docs * coordinates, _NONE)
    low = np.zeros(n_docs, np.int64)
    high = np.ceil(wanted / np.maximum(total, 1e-300)).clip(1, 1 << 22).astype(np.int64)
    weights = weights.astype(np.float64)
    run = np.cumsum(np.ceil(weights).astype(np.int64) * high[docs]) // CELLS
    bounds = [0, *(np.flatnonzero(np.diff(run)) + 1), len(run)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        if a < b:
            _throw(elements[a:b], weights[a:b], docs[a:b], low, high, coordinates, best)
    while True:
        short = (best.reshape(n_docs, coordinates) == _NONE).any(axis=1) & (total > 0)
        if not short.any():
            return best.reshape(n_docs, coordinates)
        rows = short[docs]
        low, high = high, high * 2
        _throw(elements[rows], weights[rows], docs[rows], low, high, coordinates, best)


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    got = np.broadcast_to(np.arange(bands, dtype=U), (len(signature), bands)).copy()
    for k in range(rows):
        got = mix(got * U(31) + parts[:, :, k])
    return got


def two_bits(signature: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 coordinates to an integer."""
    bits = (mix(signature) & U(3)).reshape(len(signature), -1, 32) << (U(2) * np.arange(32, dtype=U))
    return np.bitwise_or.reduce(bits, axis=2)


def least_agreements(least: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The number of agreeing coordinates (in two bits) that a pair at the threshold falls below with `miss` at most."""
    p = least + (1 - least) / 4
    below = 0.0
    for k in range(coordinates + 1):
        below += math.exp(
            math.lgamma(coordinates + 1) - math.lgamma(k + 1) - math.lgamma(coordinates - k + 1)
            + k * math.log(p) + (coordinates - k) * math.log1p(-p)
        )
        if below > miss:
            return k
    return coordinates


def words_of(bands: int, prefix: str = "") -> list[Column]:
    """The words of `bits` and those of `marks` as columns of their own, named with a prefix.

    Conditions on array elements, or on fewer columns, become one method too long for Java to compile. A join of more
    than `spark.sql.codegen.maxFields` columns (100) has them in short methods: 1.7 instead of 13.6 microseconds a pair.
    """
    bits = [F.coalesce(F.get("bits", F.lit(i)), F.lit(0)).alias(f"{prefix}w{i}") for i in range(COORDINATES // 32)]
    return bits + [F.coalesce(F.get("marks", F.lit(i)), F.lit(0)).alias(f"{prefix}m{i}") for i in range(bands)]


def agreements(prefix: str, coordinates: int = COORDINATES) -> Column:
    """Number of coordinates that agree in their two bits, of two sets of `words_of`, the second one named with a prefix."""
    apart = [f"w{i} ^ {prefix}w{i}" for i in range(coordinates // 32)]
    counts = " + ".join(f"bit_count((({x}) | shiftright({x}, 1)) & {0x5555555555555555}L)" for x in apart)
    return F.expr(f"{coordinates} - ({counts})")


def shares_earlier(prefix: str, bands: int) -> Column:
    """Whether two sets of `words_of` (32 bits of each band) agree in a band before that of the row.

    Two different bands pass for the same one with probability 2^-32, which hides a pair with 1e-8 at most.
    """
    same = [f"band > {i} AND m{i} = {prefix}m{i}" for i in range(bands - 1)]
    return F.expr(" OR ".join(["false", *same]))


def _sketch(width: int, bands: int, rows: int):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
            totals, coded, bits = [np.zeros(0, np.int64)], [np.zeros((0, bands), U)], [np.zeros((0, COORDINATES // 32), U)]
            for piece in chunks(texts):
                elements, weights, docs = shingle_sets(piece, width)
                totals.append(np.bincount(docs, weights, len(piece)).astype(np.int64))
                got = signatures(elements, weights, docs, len(piece), COORDINATES)
                coded.append(band_hashes(got[:, : bands * rows], bands, rows))
                bits.append(two_bits(got))
            lists = []
            for parts in (coded, bits):
                whole = np.concatenate(parts).view(np.int64)
                lists.append(pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), whole.shape[1]).cast(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(np.concatenate(totals)), *lists], ["id", "content", "total", "bands", "bits"]
            )

    return run


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two (elements, weights) pairs."""
    _, left, right = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][left], b[1][right]).sum()
    return common / (a[1].sum() + b[1].sum() - common)


def _verify(width: int):
    def run(batches):
        known: OrderedDict = OrderedDict()
        held = 0

        def multiset(v, text):
            nonlocal held
            if v in known:
                known.move_to_end(v)
            else:
                elements, weights, _ = shingle_sets([text.encode("utf-8", "replace")], width)
                known[v] = (elements, weights)
                held += len(elements) + 1
                while held > REMEMBERED and len(known) > 2:
                    held -= len(known.popitem(last=False)[1][0]) + 1
            return known[v]

        for batch in (part for whole in batches for part in slices(whole)):
            a, b, left, right = (batch.column(c).to_pylist() for c in ("a", "b", "left", "right"))
            sims = [float(similarity(multiset(b[k], right[k]), multiset(a[k], left[k]))) for k in range(len(a))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sims, pa.float64())], ["a", "b", "label_a", "label_b", "sim"]
            )

    return run


def content_of(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def contents_of(documents: DataFrame, id_column: str, width: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, content) of every row, and per distinct text its number, first id, size and bands."""
    keyed = documents.select(F.col(id_column).alias("id"), content_of(F.col("text")).alias("content"), "text")
    sketched = cut_lineage(
        keyed.mapInArrow(_sketch(width, bands, rows), f"id {keyed.schema['id'].dataType.simpleString()}, content binary, total bigint, bands array<bigint>, bits array<bigint>")
    )
    n_rows = sketched.count()
    # written before it is sorted, as a sort reads its input twice
    distinct = cut_few(sketched.groupBy("content").agg(
        F.min("id").alias("first_id"), F.first("total").alias("total"), F.first("bands").alias("bands"),
        F.first("bits").alias("bits"),
    ), n_rows)
    # smaller numbers for smaller ids: the first of near copies tends to lead its buckets
    numbered = cut_few(distinct.sort("first_id", "content").withColumn("v", F.monotonically_increasing_id()), n_rows)
    release(distinct)
    return sketched.select("id", "content"), numbered


def buckets_of(numbered: DataFrame) -> DataFrame:
    """(key, v, band) of the bands that at least two texts share."""
    members = numbered.filter("total > 0").select("v", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return members.join(shared, "key")


def similar_edges(
    documents: DataFrame, id_column: str, numbered: DataFrame, width: int, least: float, bands: int
) -> DataFrame | None:
    """Edges (a, b) between numbers of texts, enough to connect all that are similar; None if no two share a bucket."""
    spark = documents.sparkSession
    n_texts = numbered.count()
    members = cut_few(buckets_of(numbered), n_texts * bands, NARROW_ROWS)
    wanted = members.select("v").distinct().join(numbered, "v")
    wanted = cut_few(wanted.select(
        "v", "first_id", "content", "total", "bits", F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("marks")
    ), n_texts)
    keyed = documents.select(F.col(id_column).alias("first_id"), content_of(F.col("text")).alias("content"), "text")
    slim = wanted.select("first_id", "content", "v")
    # one row of each wanted text; spread by id and text, so very many copies are no hot key
    texts = join_rows(keyed, checked_broadcast(slim), "inner", ("first_id", "content"))
    texts = cut_few(texts.select("v", "text").dropDuplicates(["v"]), n_texts, TEXT_ROWS)
    # `near` is how near a member is to the first leader of its bucket, once that is known
    n_open, n_met = bucket_sizes(members, 1)
    open_members = cut_few(members.join(wanted.select("v", "total", "bits", "marks"), "v").select(
        "key", "v", "band", "total", "bits", "marks", F.lit(None).cast("double").alias("near"), F.col("v").alias("label")
    ), n_open)
    edges, leaders_per_bucket = None, 1
    while n_open:
        leaders, pairs = _meet(open_members, n_open, n_met, leaders_per_bucket, least, bands)
        sent = _sender(leaders)
        # pairs of one bucket lie together: spread them, as each is much work
        spread = max(4 * spark.sparkContext.defaultParallelism, -(-pairs.count() // PAIRS_OF_TASK))
        both = pairs.repartition(spread, "a", "b").join(texts.select(F.col("v").alias("a"), F.col("text").alias("left")), "a").join(
            texts.select(F.col("v").alias("b"), F.col("text").alias("right")), "b"
        ).select("a", "b", "label_a", "label_b", "left", "right")
        # the joins may have split hot numbers into more parts than the pairs ask for
        compared = cut_lineage(both.coalesce(spread).mapInArrow(_verify(width), "a bigint, b bigint, label_a bigint, label_b bigint, sim double"))
        found = compared.filter(F.col("sim") >= least)
        edges = found.select("a", "b") if edges is None else edges.unionByName(found.select("a", "b"))
        # leaders have met everyone in their bucket
        left = open_members.join(sent(leaders.select("key", F.col("leader").alias("v"))), ["key", "v"], "left_anti")
        if leaders_per_bucket == 1:
            seen = left.drop("near").join(sent(leaders.select("key", "leader")), "key").withColumns(
                {"a": F.greatest("v", "leader"), "b": F.least("v", "leader")}
            )
            left = seen.join(compared.select("a", "b", F.col("sim").alias("near")), ["a", "b"], "left").drop("a", "b", "leader")
        if not found.isEmpty():
            # only the labels that met are joined anew; what two tasks hold apart meets in a later round
            joined = cut_few(nearer_roots(found.select("label_a", "label_b")), n_open, NARROW_ROWS)
            joined = joined.withColumnsRenamed({"v": "label", "root": "component"})
            left = left.join(joined, "label", "left").withColumn("label", F.coalesce("component", "label"))
        # a bucket of one component needs no more comparisons
        mixed = left.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
        remaining = cut_few(left.join(mixed, "key").select(*open_members.columns), n_open)
        for done in (open_members, leaders, pairs):
            release(done)
        leaders_per_bucket *= MORE_LEADERS
        open_members, (n_open, n_met) = remaining, bucket_sizes(remaining, leaders_per_bucket)
    return edges


def bucket_sizes(members: DataFrame, leaders_per_bucket: int) -> tuple[int, int]:
    """The members of all buckets, and at most how many pairs they and the leaders make."""
    n = F.col("n")
    met = F.sum(n * F.least(n, F.lit(leaders_per_bucket)))
    got = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n).alias("n"), met.alias("met")).first()
    return got["n"] or 0, got["met"] or 0


def _sender(leaders: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What marks leaders for a broadcast if they are few."""
    return F.broadcast if leaders.count() <= LEADERS_SENT else lambda df: df


def _meet(
    open_members: DataFrame, n_open: int, n_met: int, leaders_per_bucket: int, least: float, bands: int
) -> tuple[DataFrame, DataFrame]:
    """The leaders of every bucket, and the pairs (a, b, label_a, label_b) of members with leaders to be compared."""
    slot = F.pmod(F.xxhash64("v", F.lit(leaders_per_bucket)), F.lit(leaders_per_bucket)).alias("slot")
    first = F.min(F.struct("v", "near", "total", "bits", "marks", "label")).alias("f")
    of_leader = {"v": "leader", **{c: f"leader_{c}" for c in ("near", "total", "bits", "marks", "label")}}
    leaders = cut_few(open_members.groupBy("key", slot).agg(first).select(
        "key", *(F.col(f"f.{c}").alias(name) for c, name in of_leader.items())
    ), n_open)
    # few leaders go to their members, which are dealt evenly, so a hot bucket needs no split
    spark = open_members.sparkSession
    sent = _sender(leaders)
    if sent is F.broadcast:
        open_members = open_members.repartition(max(4 * spark.sparkContext.defaultParallelism, -(-n_met // MET_OF_TASK)))
    # distances (1 - similarity) obey the triangle inequality: far apart as seen from the first leader is far apart
    apart = F.abs(F.col("near") - F.col("leader_near")) > 1 - least + 1e-9
    # of two leaders of a bucket, one meets the other
    if leaders_per_bucket > 1:
        leads = leaders.select("key", F.col("leader").alias("v"), F.lit(True).alias("leads"))
        open_members = open_members.join(sent(leads), ["key", "v"], "left")
    else:
        open_members = open_members.withColumn("leads", F.lit(None).cast("boolean"))
    own = open_members.select("key", "v", "band", "total", "near", "label", "leads", *words_of(bands))
    others = leaders.select("key", "leader", "leader_total", "leader_near", "leader_label", F.col("leader_bits").alias("bits"), F.col("leader_marks").alias("marks"))
    others = others.select(*others.columns[:5], *words_of(bands, "leader_"))
    met = own.join(sent(others), "key").filter(
        (F.col("leads").isNull() | (F.col("v") > F.col("leader"))) & (F.col("label") != F.col("leader_label"))
        & (F.least("total", "leader_total") >= least * F.greatest("total", "leader_total"))
        & ~F.coalesce(apart, F.lit(False)) & ~shares_earlier("leader_", bands)
        & (agreements("leader_") >= least_agreements(least))
    )
    later = F.col("v") > F.col("leader")
    pairs = met.select(
        F.greatest("v", "leader").alias("a"), F.least("v", "leader").alias("b"),
        F.when(later, F.col("label")).otherwise(F.col("leader_label")).alias("label_a"),
        F.when(later, F.col("leader_label")).otherwise(F.col("label")).alias("label_b"),
    )
    # else a hot bucket is split into as many parts as its share; parts beyond what the pairs ask for go together
    return leaders, cut_few(pairs, n_met, MET_OF_TASK, 4)


def near_duplicates(
    documents: DataFrame, id_column: str = "doc_id", width: int = WIDTH, least: float = SIMILARITY,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(id, content, class_id, kept, n_texts) per row of `documents` (`id_column`, `text`).

    `class_id` is the smallest id of the texts connected by similarities of `least` or more, and `kept`
    marks the rows with this id and its text; `n_texts` counts the distinct texts of the class.
    """
    rows_of, numbered = contents_of(documents, id_column, width, bands, rows)
    edges = similar_edges(documents, id_column, numbered, width, least, bands)
    named = numbered.select("v", "content", "first_id")
    if edges is None:
        named = named.withColumn("label", F.col("v"))
    else:
        named = named.join(components(edges), "v", "left").withColumn("label", F.coalesce("component", "v"))
    first = F.struct(F.col("first_id").isNull(), "first_id", "content")
    classes = named.groupBy("label").agg(
        F.min("first_id").alias("class_id"), F.min_by("content", first).alias("lead"), F.count(F.lit(1)).alias("n_texts")
    )
    known = named.select("content", "label").join(classes, "label").select(
        "content", "class_id", "n_texts", (F.col("content") == F.col("lead")).alias("leads")
    )
    joined = rows_of.join(known, "content")
    # an empty text is no copy of another empty text
    empty = F.col("content") == F.unhex(F.md5(F.lit("")))
    class_id = F.when(empty, F.col("id")).otherwise(F.col("class_id"))
    return joined.select(
        F.col("id").alias(id_column), class_id.alias("class_id"),
        (empty | F.col("leads") & F.col("id").eqNullSafe(F.col("class_id"))).alias("kept"),
        F.when(empty, F.lit(1).cast("bigint")).otherwise(F.col("n_texts")).alias("n_texts"), "content",
    )


def one_of_each(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row of every class of near duplicates, with all its columns."""
    content = spare("content", documents)
    judged = near_duplicates(documents, id_column).select(id_column, F.col("content").alias(content), "kept")
    judged = cut_lineage(judged)
    n_rows, key = judged.count(), (id_column, content)
    gone = cut_few(judged.filter("not kept").select(*key).distinct(), n_rows, NARROW_ROWS)
    # rows that repeat both id and text are all marked as kept
    empty = content_of(F.lit(""))
    twice = judged.filter(F.col("kept") & (F.col(content) != empty)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    twice = cut_few(twice.filter("n > 1").select(*key), n_rows, NARROW_ROWS)
    rows = documents.withColumn(content, content_of(F.col("text")))
    rows = join_rows(rows, checked_broadcast(gone), "left_anti", key)
    single = join_rows(rows, checked_broadcast(twice), "left_anti", key)
    repeated = join_rows(rows, checked_broadcast(twice), "left_semi", key).dropDuplicates(list(key))
    return single.unionByName(repeated).select(*documents.columns)
