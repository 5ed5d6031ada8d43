"""Secret scan over document histories with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text (a blob). The ledger remembers which blob
was scanned under which version of the rules; only pairs it does not hold are scanned, each once, however
many paths share the blob. Findings are joined back to all paths.

Rules for odd rows: a null text is the empty text; a null path is a path; repeated rows share one scan and
each get the findings; columns other than path and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .base import checked_broadcast, join_rows, spare

# Kinds in order, each with its pattern and the shortest length of the group that counts.
BASE_RULES = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    ("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 1),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
RULES = BASE_RULES + MORE_RULES
LEDGER = "blob string, rules string, spans array<struct<kind:string,start:bigint,end:bigint>>"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def rules_version(rules=RULES) -> str:
    """A rule set is known by its content: any change makes every blob unseen."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _compiled(rules):
    """Per rule its kind, pattern, group, least length, and whether letters may be in either case."""
    out = []
    for kind, pattern, group, least in rules:
        if kind == "hex":
            # a run is the longest one anyway, so short ones can be left to the pattern
            pattern = pattern[:-1] + "{%d,}" % least
        out.append((kind, re.compile(pattern, re.A | (re.I if kind == "assign" else 0)), group, least))
    return out


_MAY_ASSIGN = re.compile(r"[:=]")


def find_spans(text: str, compiled) -> list[tuple[str, int, int]]:
    """All findings in one text, by start, then kind as listed; ends are exclusive code points."""
    found = []
    for rank, (kind, pattern, group, least) in enumerate(compiled):
        if kind == "access" and "AKIA" not in text or kind == "assign" and not _MAY_ASSIGN.search(text):
            continue
        if kind == "pem" and "-----BEGIN" not in text or kind == "jwt" and "eyJ" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(rules):
    def run(batches):
        compiled = _compiled(rules)
        for batch in batches:
            rows = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t or "", compiled)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, SPANS)], ["blob", "spans"])

    return run


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class BlobLedger:
    """Findings per (blob, rule version) in a folder of Parquet files that only grows."""

    def __init__(self, spark: SparkSession, folder: str | None = None, rules=RULES):
        self.spark, self.rules, self.version = spark, rules, rules_version(rules)
        self.folder = folder or f"{shared_folder(spark).rstrip('/')}/blob-ledger-{uuid.uuid4().hex}"

    def entries(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.folder).filter(F.col("rules") == self.version)

    def scan(self, versions: DataFrame, path: str, text: str = "text") -> None:
        """Scan the blobs of `versions` that the ledger lacks and append their findings.

        One row stands for all rows of a blob. Texts move once, spread by path and blob, so that a
        blob with very many paths is no hot key; a repeated batch adds nothing.
        """
        rows = versions.select(F.col(path).alias("path"), F.col(text).alias("text"), blob_id(F.col(text)).alias("blob"))
        # min skips nulls: a blob whose paths are all null has the null path
        first = rows.select("path", "blob").groupBy("blob").agg(F.min("path").alias("path"))
        unseen = first.join(self.entries().select("blob"), "blob", "left_anti").hint("shuffle_hash")
        once = join_rows(rows, unseen, "left_semi", ("path", "blob"))
        found = once.select("blob", "text").mapInArrow(
            _scan(self.rules), "blob string, spans array<struct<kind:string,start:bigint,end:bigint>>"
        )
        # rows that repeat both path and text have been scanned together
        found.dropDuplicates(["blob"]).select("blob", F.lit(self.version).alias("rules"), "spans").write.mode("append").parquet(self.folder)

    def findings(self, versions: DataFrame, path: str, text: str = "text") -> DataFrame:
        """(path, blob, spans) of every row of `versions`; an empty list where nothing was found."""
        rows = versions.select(path, blob_id(F.col(text)).alias("blob"))
        hits = self.entries().filter(F.size("spans") > 0).select("blob", "spans")
        none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
        return rows.join(hits, "blob", "left").select(path, "blob", F.coalesce("spans", none).alias("spans"))


def span_digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_documents(documents: DataFrame, ledger: BlobLedger) -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans, and all spans."""
    ledger.scan(documents, "doc_id")
    found = ledger.findings(documents, "doc_id")
    kinds = [kind for kind, *_ in BASE_RULES]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id", *[count(k) for k in kinds], F.sha2(span_digest(base), 256).alias("base_sha256"),
        span_digest(F.col("spans")).alias("spans"), "blob",
    )


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """`text` with every span replaced; overlapping spans become one mark."""
    out, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(text: Column, spans: Column) -> Column:
    """`text` without its secrets."""
    @F.arrow_udf("string")
    def clean(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([redact(t or "", s or ()) for t, s in zip(texts.to_pylist(), lists.to_pylist())], pa.string())

    return clean(text, spans)


def redact_documents(documents: DataFrame, ledger: BlobLedger) -> DataFrame:
    """`documents` with every secret in `text` replaced; `n_chars`, where there is one, follows the new text."""
    ledger.scan(documents, "doc_id")
    blob, spans = spare("blob", documents), spare("spans", documents)
    hits = ledger.entries().filter(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    met = documents.join(checked_broadcast(hits), blob_id(F.col("text")) == F.col(blob), "left").drop(blob)
    found = F.col(spans).isNotNull()
    # only texts with secrets go through Python
    changed = met.filter(found).withColumn("text", redacted(F.col("text"), F.col(spans)))
    if "n_chars" in documents.columns:
        length = F.char_length("text").cast(documents.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", length)
    return met.filter(~found).unionByName(changed).select(*documents.columns)
