"""Benchmark passages in training documents, found through a distributed positional inverted index.

The index holds postings (term, document, position) of training words. Each benchmark window is looked up
by its rarest terms first: their posting lists, shifted back by the term's place in the window, are
intersected, and what is left is compared word by word with the document. DataFrame functions only.

Rules for odd rows: null texts have no words; a row is identified by its id (null is an id) and its text, so
rows that repeat an id are judged one by one and repeated rows get the same result; items with a null id
are called "null"; other columns of the inputs are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut_lineage
from .base import checked_broadcast, join_rows, spare, text_key

# What stands between words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
# Posting lists that are intersected before words are compared.
LISTS = 3


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z; other letters keep their case."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    # a split allocates far less than the extraction of all matches; only its first and last part can be empty
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BETWEEN), "")


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, window_id, words): every run of `width` words; a shorter item is one window."""
    words = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words_of(F.col("text")).alias("w")
    ).filter(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1))))
    found = words.select("item_id", "w", start.alias("s")).select("item_id", F.slice("w", F.col("s"), width).alias("words"))
    return found.select("item_id", F.md5(F.array_join("words", " ")).alias("window_id"), "words").distinct()


def tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, pos, term) of every word of every document."""
    return documents.select(
        "doc_id", text_key(F.col("text")).alias("text_key"), F.posexplode(words_of(F.col("text"))).alias("pos", "term")
    )


def term_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) over all documents, for the given terms."""
    return tokens(documents).select("term").join(checked_broadcast(terms), "term").groupBy("term").agg(
        F.count(F.lit(1)).alias("n")
    )


def rarest_terms(windows: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """(window_id, term, at, lists): the places of a window's rarest terms; none if a term never occurs."""
    placed = windows.select("window_id", F.size("words").alias("width"), F.posexplode("words").alias("at", "term"))
    ranked = placed.join(counts, "term").withColumn(
        "rank", F.row_number().over(Window.partitionBy("window_id").orderBy("n", "at"))
    ).withColumn("known", F.count(F.lit(1)).over(Window.partitionBy("window_id")))
    return ranked.filter((F.col("known") == F.col("width")) & (F.col("rank") <= lists)).select(
        "window_id", "term", "at", F.least(F.col("width"), F.lit(lists)).alias("lists")
    )


def intersect_lists(postings: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, text_key, window_id, start) where all looked-up terms of a window stand in their places."""
    shifted = postings.join(checked_broadcast(keys), "term").select(
        "doc_id", "text_key", "window_id", "lists", "at", (F.col("pos") - F.col("at")).alias("start")
    )
    # a repeated row repeats its postings: places are counted once (a window has at most 63 words)
    seen = F.expr("bit_count(bit_or(shiftleft(1L, at)))")
    return (
        shifted.filter("start >= 0").groupBy("doc_id", "text_key", "window_id", "start")
        .agg(seen.alias("seen"), F.first("lists").alias("lists")).filter("seen = lists")
        .select("doc_id", "text_key", "window_id", "start")
    )


def exact_phrases(documents: DataFrame, candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_key, hits): per document the candidates whose words are all equal."""
    by_id = windows.select("window_id", "words").dropDuplicates(["window_id"])
    found = candidates.join(checked_broadcast(by_id), "window_id").groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("start", "window_id", "words")).alias("found")
    )
    keys = candidates.select("doc_id", "text_key").distinct()
    keyed = documents.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    few = join_rows(keyed, checked_broadcast(keys), "left_semi").dropDuplicates(["doc_id", "text_key"])
    both = join_rows(few.select("doc_id", "text_key", words_of(F.col("text")).alias("w")), found)
    equal = F.filter("found", lambda c: F.slice(F.col("w"), c["start"] + 1, F.size(c["words"])) == c["words"])
    return both.select("doc_id", "text_key", equal.alias("hits")).filter(F.size("hits") > 0)


def near_terms(postings: DataFrame, first: str, second: str, distance: int) -> DataFrame:
    """(doc_id, text_key, pos, other): places of `first` with `second` at most `distance` words away.

    A posting meets only those of the own and the two neighbouring stretches of `distance + 1` words.
    """
    wide = distance + 1
    lead = postings.filter(F.col("term") == first).select("doc_id", "text_key", "pos").distinct().withColumn(
        "cell", F.explode(F.array(*[F.floor(F.col("pos") / wide) + k for k in (-1, 0, 1)]))
    )
    near = postings.filter(F.col("term") == second).select("doc_id", "text_key", F.col("pos").alias("other")).distinct().withColumn(
        "cell", F.floor(F.col("other") / wide)
    )
    met = join_rows(lead, near, keys=("doc_id", "text_key", "cell"))
    gap = F.abs(F.col("pos") - F.col("other"))
    return met.filter((gap <= distance) & (gap > 0)).select("doc_id", "text_key", "pos", "other")


def build_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored postings (doc_id, text_key, pos, term) of the given terms."""
    return cut_lineage(tokens(documents).join(checked_broadcast(terms), "term"))


def find_windows(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, hits) of documents with benchmark windows, and the windows of the items."""
    windows = cut_lineage(item_windows(items))
    terms = windows.select(F.explode("words").alias("term")).distinct()
    counts = cut_lineage(term_counts(documents, terms))
    keys = cut_lineage(rarest_terms(windows.select("window_id", "words").dropDuplicates(["window_id"]), counts))
    postings = build_index(documents, keys.select("term").distinct())
    candidates = cut_lineage(intersect_lists(postings, keys))
    return cut_lineage(exact_phrases(documents, candidates, windows)), windows


def contamination(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hits, windows = find_windows(documents, items)
    covered = F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + F.size(c["words"]) - 1)))
    n_hit = hits.select("doc_id", "text_key", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    per_item = hits.select("doc_id", "text_key", F.explode("hits.window_id").alias("window_id")).distinct().join(
        checked_broadcast(windows.select("window_id", "item_id")), "window_id"
    )
    ids = F.array_sort(F.collect_set("item_id"))
    item_sets = per_item.groupBy("doc_id", "text_key").agg(ids.alias("ids"))
    found = join_rows(n_hit, item_sets)
    docs = documents.select(
        "doc_id", text_key(F.col("text")).alias("text_key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words")
    )
    none = F.array().cast("array<string>")
    joined = join_rows(docs, found, "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("ids", none).alias("ids"),
    )
    return joined.select(
        "doc_id", "text_key", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `documents` that are not contaminated."""
    hits = cut_lineage(contamination(documents, items).filter("contaminated").select("doc_id", "text_key").distinct())
    key = spare("text_key", documents)
    keyed = documents.withColumn(key, text_key(F.col("text")))
    hits = checked_broadcast(hits.withColumnRenamed("text_key", key))
    return join_rows(keyed, hits, "left_anti", ("doc_id", key)).select(*documents.columns)
