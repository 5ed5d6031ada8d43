"""Text column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip_last_label(domain: Column, strict: bool = False) -> Column:
    """Domain name without its last dot-separated label.

    A name without a dot is kept as it is; with `strict` it loses its last
    character instead, which is what slicing at "not found" does.
    """
    last = F.substring_index(domain, ".", -1)
    without = F.left(domain, F.length(domain) - F.length(last) - F.lit(1))
    no_dot = F.left(domain, F.length(domain) - F.lit(1)) if strict else domain
    return F.when(F.instr(domain, ".") > 0, without).otherwise(no_dot)


def join_list(values: Column) -> Column:
    """Elements as text, separated by single blanks; a null list gives ''."""
    texts = F.transform(values, lambda x: x.cast("string"))
    return F.coalesce(F.array_join(texts, " ", "None"), F.lit(""))


def letters_and_digits(text: Column) -> Column:
    """Lower-cased text with everything but a-z and 0-9 removed."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def count_tag(structure: Column, tag: str) -> Column:
    """How often `tag` occurs in a flattened page structure, without overlap."""
    if not tag:
        raise ValueError("tag must not be empty")
    removed = F.length(structure) - F.length(F.replace(structure, F.lit(tag), F.lit("")))
    return (removed / F.lit(len(tag))).cast("bigint")


def model_text(segmented_domain: Column, meta_text: Column, body_text: Column) -> Column:
    """`<domain words>. <meta text> <body text>`; missing parts count as ''."""
    empty = F.lit("")
    return F.concat(
        F.coalesce(segmented_domain, empty), F.lit(". "),
        F.coalesce(meta_text, empty), F.lit(" "), F.coalesce(body_text, empty),
    )


@F.pandas_udf(StringType())
def _without_marks(texts: pd.Series) -> pd.Series:
    def plain(text):
        if text is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    return texts.map(plain)


def strip_accents(text: Column) -> Column:
    """Compatibility-decompose and drop combining marks.

    Only rows with a non-ASCII character carry their text to Python; the others
    send a null, so plain-ASCII data stays in the JVM.
    """
    foreign = F.when(text.rlike("[^\\x00-\\x7F]"), text)
    return F.coalesce(_without_marks(foreign), text)


def terms(text: Column) -> Column:
    """Lower-cased, accent-free runs of non-blank characters."""
    return non_blank(strip_accents(F.lower(text)))


def non_blank(text: Column) -> Column:
    """Runs of non-blank characters."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def words_and_marks(text: Column) -> Column:
    """Model tokens: lower-cased words, and every other visible character alone."""
    pattern = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
