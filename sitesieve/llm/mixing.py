"""A mix of sources at target weights: every document is emitted a whole number of times.

The words of every source are added up, the words of all sources are shared out by weight, and a source's share
over its own words is its rate. A document is emitted floor(rate) times, and once more if a number drawn from
the hash of its id and text is below the rest of the rate. No source gives more than `most` times its words; what
it cannot give goes to the others by weight, until no source is above its limit. DataFrame functions only. Texts
are read twice and never shuffled: what moves are sums per source, and the table of sources (broadcast where its
counted size allows, otherwise joined with hot sources kept apart).

Rules for odd rows: a null or blank text has size 0 and is never emitted; a null source is a source of its own, the
last one; a null id is drawn by its text; rows with the same id and text are drawn alike; an empty table gives an
empty mix; columns of the documents are kept, helper columns get names that they do not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import lookup_join
from ..session import cut_lineage
from .base import spare

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix"
# Hexadecimal digits of a draw: 52 bits, exact as a double.
DIGITS = 13


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def draw_of(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed, the id and the text alone."""
    parts = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(parts), 1, DIGITS), 16, 10).cast("long") / F.lit(float(16 ** DIGITS))


def source_key(source: Column) -> Column:
    """A text that sorts like the source, null last, and is never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source_size, target, rate) of every source of `sized` (source_key, size).

    Sources are numbered in order by a range sort, a source's number being its place in its sorted part plus
    the sizes of the parts before, and take the weights in turn.
    """
    sums = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    ordered = cut_lineage(sums.orderBy("source_key").withColumn("place", F.monotonically_increasing_id()))
    parts = ordered.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # one row per sorted part
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("place") - F.shiftleft("part", 33)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int")).cast("decimal(19,0)")
    numbered = cut_lineage(
        ordered.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(before), "part")
        .select("source_key", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("decimal(19,0)").alias("limit"))
    )

    rest, shares = _level(numbered)
    share = F.lit(rest).cast("decimal(19,0)") * F.col("weight")
    # with no source left below its limit, all are at it
    above = F.lit(shares == 0) | (share > F.col("limit") * F.lit(shares).cast("decimal(19,0)"))
    target = F.when(above, F.col("limit").cast("double")).otherwise(share.cast("double") / F.lit(float(shares or 1)))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return numbered.withColumn("target", target).select("source_key", "source_size", "target", rate.alias("rate"))


def _level(numbered: DataFrame) -> tuple[int, int]:
    """Words and weights of the sources below their limit: each gets words / weights for a unit of weight.

    A round puts the sources whose share is above their limit at the limit and shares out the rest anew. The
    level only rises, so the sources at their limit only become more, and the rounds end.
    """
    total = numbered.agg(F.sum("source_size").alias("w"), F.sum("weight").alias("s")).first()
    words, weights = int(total["w"] or 0), int(total["s"] or 0)
    rest, shares, full = words, weights, 0
    while shares:
        above = F.lit(rest).cast("decimal(19,0)") * F.col("weight") > F.col("limit") * F.lit(shares).cast("decimal(19,0)")
        got = numbered.filter(above).agg(F.count(F.lit(1)).alias("n"), F.sum("limit").alias("w"), F.sum("weight").alias("s")).first()
        if got["n"] == full:
            break
        full, rest, shares = got["n"], words - int(got["w"] or 0), weights - int(got["s"] or 0)
    return rest, shares


def with_copies(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """`sized` (source_key, size, draw) with source_size, target and the number of copies of each row."""
    found = lookup_join(sized, targets, "source_key")
    whole = F.floor("rate")
    more = (F.col("draw") < F.col("rate") - whole).cast("long")
    copies = F.when(F.col("size") > 0, whole.cast("long") + more).otherwise(F.lit(0).cast("long"))
    return found.withColumn("copies", copies).drop("rate")


def sized_rows(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source_key, size, draw) of every document; texts are read once."""
    return documents.select(
        "doc_id", source_key(F.col("source")).alias("source_key"), size_of(F.col("text")).alias("size"),
        draw_of(F.col("doc_id"), F.col("text"), seed).alias("draw"),
    )


def mix_plan(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every document."""
    sized = cut_lineage(sized_rows(documents, seed))
    return with_copies(sized, source_targets(sized, weights, most)).select("doc_id", "size", "source_size", "target", "copies")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: the documents, each as many times as it is drawn.

    Rows never leave their task unless the table of sources is too large for a broadcast.
    """
    names = {c: spare(c, documents) for c in ("source_key", "size", "draw", "copies", "copy")}
    targets = source_targets(sized_rows(documents, seed).select("source_key", "size"), weights, most)
    targets = targets.select(F.col("source_key").alias(names["source_key"]), F.col("rate").alias(spare("rate", documents)))
    rate = targets.columns[1]
    rows = documents.withColumns({
        names["source_key"]: source_key(F.col("source")), names["size"]: size_of(F.col("text")),
        names["draw"]: draw_of(F.col("doc_id"), F.col("text"), seed),
    })
    found = lookup_join(rows, targets, names["source_key"])
    copies = F.floor(rate) + (F.col(names["draw"]) < F.col(rate) - F.floor(rate)).cast("long")
    emitted = found.filter(F.col(names["size"]) > 0).withColumn(names["copies"], copies.cast("int")).filter(F.col(names["copies"]) > 0)
    return emitted.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).select(*documents.columns)
