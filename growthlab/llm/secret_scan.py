"""Incremental secret scan over content-addressed blobs (operator 3).

Every version of a path is addressed by the SHA-256 of its text.  The ledger holds the
findings of each (blob, rule version) pair already scanned, including pairs without a
finding.  A scan

1. hashes all versions (hash and path only, no text, leave this step),
2. anti-joins the distinct blobs with the ledger for the current rule version,
3. fetches the text of one version per pending blob and applies the rules to it,
4. appends the results to the ledger, and
5. joins the ledger back to every path that holds the blob.

A blob that a third of all paths share is scanned once.  Step 2 groups (hash, path)
pairs with a map-side minimum; step 3 joins on unique ids; step 5 joins only blobs that
have findings, and adaptive execution splits a hot blob there.

Spans are code points, end exclusive, leftmost and non-overlapping per kind.

Defined cases: a null or empty text has no span; null ids are kept as null; rows that
share an id are separate versions; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlab.functions.ordered import materialize
from growthlab.llm.common import order_id, small_batches, text_of
from growthlab.session import drop_path, scratch_path

RULE_VERSION = 2
BASE_KINDS = ["assign", "access", "hex"]
#: Kinds in listed order: the base ones, then those this method adds.
KINDS = BASE_KINDS + ["private_key", "web_token", "hosted_token", "url_password"]

# The patterns of the contract.  A run of hexadecimal digits, or of the
# characters after AKIA, that is too short fails as a whole, so the minimum length can be
# part of the pattern; an assignment that fails still consumes its characters, so there
# the length is tested afterwards.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# its header lines (Proc-Type, DEK-Info) hold single hyphens
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[^-]*(?:-(?!----)[^-]*)*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?")
WEB_TOKEN = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
HOSTED_TOKEN = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})")
URL_PASSWORD = re.compile(r"[a-z0-9]://[^\s/:@]+:([^\s/@]{3,})@")

SCHEMA = "blob string, rule_version int, n_assign long, n_access long, n_hex long, base string, spans string"


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every secret in a text, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [(m.start(), 3, m.end()) for m in PRIVATE_KEY.finditer(text)]
    if "eyJ" in text:
        found += [(m.start(), 4, m.end()) for m in WEB_TOKEN.finditer(text)]
    if "_" in text or "xox" in text:
        found += [(m.start(), 5, m.end()) for m in HOSTED_TOKEN.finditer(text)]
    if "://" in text:
        found += [(m.start(1), 6, m.end(1)) for m in URL_PASSWORD.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ledger rows of a task's blobs; of rows that repeat a blob the last few thousand are
    remembered and not scanned again."""
    done: dict[str, None] = {}
    for batch in batches:
        rows: dict[str, list] = {c: [] for c in ("blob", "rule_version", "n_assign", "n_access", "n_hex", "base", "spans")}
        for blob, text in zip(batch["blob"].to_pylist(), batch["text"]):
            if blob in done:
                continue
            done[blob] = None
            if len(done) > REMEMBERED:
                del done[next(iter(done))]
            spans = find_spans(text.as_py() or "")
            kinds = [k for _, k, _ in spans]
            rows["blob"].append(blob)
            rows["rule_version"].append(RULE_VERSION)
            for k, c in enumerate(("n_assign", "n_access", "n_hex")):
                rows[c].append(kinds.count(k))
            rows["base"].append(joined([s for s in spans if s[1] < len(BASE_KINDS)]))
            rows["spans"].append(joined(spans))
        yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "rule_version" else pa.int64() if c[:2] == "n_" else pa.string())
                                          for c, v in rows.items()})


#: Blobs that a task remembers to have scanned.
REMEMBERED = 10_000


def versions(docs: DataFrame) -> DataFrame:
    """(doc_id, blob): the content address of every version."""
    return docs.select("doc_id", F.sha2(text_of(F.col("text")), 256).alias("blob"))


def pending_blobs(known: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """(blob, id): blobs that the ledger has not seen under the current rule version,
    each with the smallest id that holds it."""
    blobs = known.groupBy("blob").agg(F.min(order_id()).alias("id"))
    if ledger is None:
        return blobs
    return blobs.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")


def scan_into(docs: DataFrame, ledger_path: str, ledger: DataFrame | None = None) -> None:
    """Scans the pending blobs of ``docs`` and appends the results to the ledger."""
    pending = pending_blobs(versions(docs), ledger)
    texts = docs.select(order_id().alias("id"), text_of(F.col("text")).alias("text")).withColumn("blob", F.sha2("text", 256))
    # an id may have several versions, hence the blob in the key; rows that repeat id and blob
    # give a ledger row once
    todo = texts.join(pending, ["id", "blob"]).select("blob", "text")
    todo.mapInArrow(_scan, SCHEMA).dropDuplicates(["blob"]).write.mode("append").parquet(ledger_path)


def findings(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) for every version of ``docs``."""
    hits = (ledger.where((F.col("rule_version") == RULE_VERSION) & (F.col("spans") != ""))
            .dropDuplicates(["blob"]).drop("rule_version"))
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n_assign", "n_access", "n_hex")}
    none = {c: F.coalesce(c, F.lit("")).alias(c) for c in ("base", "spans")}
    return versions(docs).join(hits, "blob", "left").select("doc_id", *zero.values(), *none.values())


def scan_secrets(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Scans what the ledger at ``ledger_path`` lacks (a new ledger when none is named) and
    returns the findings of every version."""
    spark = docs.sparkSession
    small_batches(spark)
    ledger, own = None, ledger_path is None
    if own:
        ledger_path = scratch_path(spark, "secret-ledger")
    else:
        try:
            ledger = spark.read.schema(SCHEMA).parquet(ledger_path)
        except Exception as e:  # no ledger yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    scan_into(docs, ledger_path, ledger)
    ledger = spark.read.schema(SCHEMA).parquet(ledger_path)
    if own:  # only blobs with a span are needed further on
        ledger = materialize(ledger.where(F.col("spans") != ""))
        drop_path(spark, ledger_path)
    return findings(docs, ledger)
