"""Secret scans over an incremental blob ledger.

A text is a blob, named by the SHA-256 of its bytes.  The ledger holds one row for each (blob, rule version)
that was ever scanned, with its findings.  A run scans only blobs that the ledger lacks, each once however
many paths and versions hold it, appends them, and joins the findings back to all paths.

Texts are scanned where they lie: only their hashes are shuffled, to find the blobs that occur more than once or
are in the ledger, and only the texts that may be such blobs are moved.
"""

from __future__ import annotations

import hashlib
import inspect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.llm.shared import cut, fresh, lean, shared_dir, split_by

# The base kinds, in the order in which they are listed.
BASE = {
    "assign": (re.compile(r"(?P<name>[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?(?P<value>[A-Za-z0-9+/_.=-]+)"), 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 16),
}
# Further kinds.
MORE = {
    "private_key": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    "web_token": re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*"),
    "prefixed": re.compile(r"(?:gh[pousr]_|xox[abprs]-|sk_live_|rk_live_|glpat-)[A-Za-z0-9_-]{16,}"),
}
_DENSE = re.compile(r"[A-Za-z0-9+/_-]{24,}")
#: Bits a character from which a run of letters, digits and signs counts as random.
DENSE_BITS = 4.0
KINDS = [*BASE, *MORE, "dense"]


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then by kind as listed."""
    out = []
    for kind, (pattern, least) in BASE.items():
        for m in pattern.finditer(text):
            if len(m["value"] if kind == "assign" else m[0]) >= least:
                out.append((m.start(), m.end(), kind))
    for kind, pattern in MORE.items():
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    for m in _DENSE.finditer(text):
        run, n = m[0], len(m[0])
        if re.search(r"[a-z]", run) and re.search(r"[A-Z]", run) and re.search(r"[0-9]", run):
            bits = -sum(c / n * math.log2(c / n) for c in Counter(run).values())
            if bits >= min(DENSE_BITS, 0.9 * math.log2(n)) and not any(s < m.end() and m.start() < e for s, e, _ in out):
                out.append((m.start(), m.end(), "dense"))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


#: Named in the ledger: a digest of the rules, so that texts are scanned anew once a rule changes.
RULE_VERSION = hashlib.sha256(repr((BASE, MORE, _DENSE, DENSE_BITS, inspect.getsource(find))).encode()).hexdigest()[:16]
_SPANS = "array<struct<kind: string, start: long, end: long>>"
LEDGER = f"blob binary, spans {_SPANS}, rule_version string"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [[{"kind": k, "start": s, "end": e} for s, e, k in find(text)] for text in batch["text"]]
        yield pd.DataFrame({"blob": batch["blob"], "spans": found})


def blob_of(text) -> F.Column:
    """The name of a text's blob; a null text is an empty one."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def ledger_path(spark: SparkSession, corpus: str) -> str:
    """The ledger of a corpus, below the folder that all runs share."""
    return f"{shared_dir(spark)}/tidemark/ledgers/secrets-{hashlib.sha256(corpus.encode()).hexdigest()[:16]}"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob, spans, rule_version) of every scan so far; no rows before the first."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # Not createDataFrame: rows from Python, even none, start a second daemon with workers in every executor
        none = F.lit(None)
        return spark.range(1).where("false").select(none.cast("binary").alias("blob"), none.cast(_SPANS).alias("spans"), none.cast("string").alias("rule_version"))


def append_ledger(added: DataFrame, path: str) -> None:
    """Append scanned blobs to the ledger at ``path``; a blob that two runs append has equal findings."""
    added.write.mode("append").parquet(path)


def scan_new(docs: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan each blob of docs(text) that ``ledger`` lacks under ``rule_version``: the rows to append to it."""
    texts = docs.select(blob_of(F.col("text")).alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = ledger.where(F.col("rule_version") == rule_version).select("blob")
    blobs = texts.groupBy("blob").agg(F.count("*").alias("n"))
    # Blobs that need care: those seen before, and those of several rows, of which one is scanned
    again = cut(blobs.where("n > 1").select("blob").unionByName(blobs.join(known, "blob", "left_semi").select("blob")).distinct(), "again")
    near, alone = split_by(texts, again, "blob")
    once = near.join(known, "blob", "left_anti").groupBy("blob").agg(F.first("text").alias("text"))
    return cut(alone.unionByName(once).mapInPandas(lean(_scan), f"blob binary, spans {_SPANS}").withColumn("rule_version", F.lit(rule_version)), "scanned")


def scan_blobs(docs: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION, keys: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Scan docs(text, and the columns ``keys`` that name a row, as doc_id or path and version) against ``ledger``.

    Returns (findings, added): (keys, blob, spans) for every row of docs, and the rows to append to the ledger.
    A null text is an empty one.  Repeated rows and null keys are kept; equal texts are scanned once, and texts in
    the ledger not at all.  Repeated rows of the ledger count once.  An empty table scans nothing.  Other columns
    are ignored.
    """
    added = scan_new(docs, ledger, rule_version)
    known = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    # Few blobs have findings; the rest needn't be joined
    some = known.unionByName(added.where(F.size("spans") > 0).select("blob", "spans")).dropDuplicates(["blob"])
    rows = docs.select(*keys, blob_of(F.col("text")).alias("blob"))
    findings = rows.join(some, "blob", "left").select(*keys, "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))
    return findings, added


def listed(spans, kinds: list[str] | None = None) -> F.Column:
    """kind:start:end of spans, of the given kinds, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, ledger: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs(doc_id, text).

    ``ledger``: the path of the ledger, which is read first and gets what this run scans."""
    found, added = scan_blobs(docs, read_ledger(docs.sparkSession, ledger))
    append_ledger(added, ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(F.col("spans"), list(BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _redacted(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, found in zip(texts, spans):
        done, parts = 0, []
        for s in found:
            if s["end"] > done:
                parts += [text[done : max(done, s["start"])], "<secret>" if s["start"] >= done else ""]
                done = s["end"]
        out.append("".join(parts) + text[done:])
    return pd.Series(out)


def redact_secrets(docs: DataFrame, ledger: str) -> DataFrame:
    """docs, with every span that the scan finds in its texts replaced by ``<secret>`` and n_chars counted anew.

    Rows without findings are as they were, null texts included.  Overlapping spans give one mark.  Repeated rows and
    all other columns stay.  ``ledger``: see ``secret_digest``.
    """
    known = read_ledger(docs.sparkSession, ledger)
    added = scan_new(docs, known)
    append_ledger(added, ledger)
    blob, spans = fresh(docs, "_blob"), fresh(docs, "_spans")
    found = known.where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).unionByName(added.where(F.size("spans") > 0)).dropDuplicates(["blob"])
    found = cut(found.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), "findings")
    near, clean = split_by(docs.withColumn(blob, blob_of(F.col("text"))), found, blob)
    near = near.join(found, blob, "left")
    hit = near.where(F.col(spans).isNotNull()).withColumn("text", F.pandas_udf(_redacted, StringType())("text", spans))
    hit = hit.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else hit
    return clean.select(docs.columns).unionByName(near.where(F.col(spans).isNull()).select(docs.columns)).unionByName(hit.select(docs.columns))
