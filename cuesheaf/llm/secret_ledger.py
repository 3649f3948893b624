"""Secret scans with an incremental blob ledger.

Every version of a document is addressed by the SHA-256 of its content. The ledger holds the
(blob, rules_version) pairs that were scanned, the findings those that hold a secret. A run scans only
pairs that the ledger lacks, each blob once however many paths hold it, and joins findings back
to all paths. Texts move in a shuffle only if they hold a keyword of a rule. Versions arrive in
batches (scan_batches): each one is scanned against the stored ledger of those before it.

Defined cases: a null text is the empty blob; a null path is a path; a very long text is one blob like others; spans that tie in
their start are in the order of the kinds; repeated rows are paths of their own; an empty table scans nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized_broadcast, small_batches, stored

VERSION = "1"
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Further rules of the method, after the base kinds: key blocks, bearer and provider tokens.
EXTRA = {
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "provider": re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,})"),
}
#: A text in which no rule can match holds none of these; (?i) is ASCII here.
KEYWORDS = r"(?i)pass(?:word|wd)[\"']?\x20*[:=]|(?:secret|token|api_?key)[\"']?\x20*[:=]|(?-i)AKIA|[0-9a-f]{32}|-----BEGIN |eyJ|gh[pousr]_|xox[abprs]-|AIza|sk_live_"
SPAN = "struct<kind:string,start:long,end:long>"


def scan(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text by start, then kind as listed; code points, end exclusive."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for k, rule in enumerate(EXTRA.values(), 3):
        found += [(m.start(), k, m.end()) for m in rule.finditer(text)]
    kinds = (*KINDS, *EXTRA)
    return [(kinds[k], s, e) for s, k, e in sorted(found)]


def blobs(versions: DataFrame) -> DataFrame:
    """(path, blob, hinted) of versions (path, text)."""
    t = F.coalesce("text", F.lit(""))
    return versions.select("path", F.sha2(t, 256).alias("blob"), t.rlike(KEYWORDS).alias("hinted"))


def unseen_findings(versions: DataFrame, ledger: DataFrame | None = None, version: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """New ledger rows (blob, rules_version) and new findings (blob, rules_version, spans), both stored.

    Of each blob that the ledger lacks for this version, one hinted text is scanned; a blob that
    is not hinted is recorded with no finding, as no rule can match in it.
    """
    seen = blobs(versions)
    new = seen.groupBy("blob").agg(F.min("path").alias("path"), F.max("hinted").alias("hinted"))
    if ledger is not None:
        done = ledger.filter(F.col("rules_version") == version).select("blob")
        new = new.join(done, "blob", "left_anti")
    new = stored(new)
    wanted = new.filter("hinted").select(F.col("path").alias("w_path"), F.col("blob").alias("w_blob"))
    t = F.coalesce("text", F.lit(""))
    texts = versions.select("path", t.alias("text")).filter(F.col("text").rlike(KEYWORDS)).withColumn("blob", F.sha2("text", 256))
    texts = texts.join(sized_broadcast(wanted), F.col("path").eqNullSafe(F.col("w_path")) & (F.col("blob") == F.col("w_blob")), "left_semi").dropDuplicates(["blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in small_batches(batches):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(x)] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["blob", "spans"])

    found = texts.select("blob", "text").mapInArrow(run, f"blob string, spans array<{SPAN}>").filter(F.size("spans") > 0)
    rows = F.lit(version).alias("rules_version")
    return new.select("blob", rows), stored(found.select("blob", rows, "spans"))


def joined_back(versions: DataFrame, findings: DataFrame, version: str = VERSION) -> DataFrame:
    """(path, blob, spans) of every row of versions (path, text), from stored findings."""
    now = findings.filter(F.col("rules_version") == version).select(F.col("blob").alias("f_blob"), "spans")
    out = blobs(versions).select("path", "blob").join(sized_broadcast(now, 200_000), F.col("blob") == F.col("f_blob"), "left")
    empty = F.array().cast(f"array<{SPAN}>")
    return out.select("path", "blob", F.coalesce("spans", empty).alias("spans"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, version: str = VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings of every path (path, blob, spans), the whole ledger and all findings after the run."""
    more, found = unseen_findings(versions, ledger, version)
    found = found if findings is None else findings.unionByName(found)
    ledger = more if ledger is None else ledger.unionByName(more)
    return joined_back(versions, found, version), ledger, found


def scan_batches(versions: DataFrame, batches: int = 2, version: str = VERSION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """scan_versions over all versions (path, text), which arrive in batches by a hash of the path.

    The ledger and the findings of a batch are stored before the next one, which scans only the
    blobs that are still unseen; the findings are joined back to the paths of all batches at the end.
    """
    ledger = findings = None
    for k in range(batches):
        part = versions.filter(F.pmod(F.xxhash64("path"), F.lit(batches)) == k)
        more, found = unseen_findings(part, ledger, version)
        ledger = stored(more if ledger is None else ledger.unionByName(more))
        findings = found if findings is None else stored(findings.unionByName(found))
    return joined_back(versions, findings, version), ledger, findings


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every found span of text replaced by a mark; columns stay, n_chars follows the text.

    Overlapping spans become one mark. Only names that start with two underscores are used beside
    the columns of docs.
    """
    spans, _, _ = scan_versions(docs.select(F.col("doc_id").alias("path"), "text"))
    found = spans.filter(F.size("spans") > 0).dropDuplicates(["path", "blob"])
    found = stored(found.select(F.col("path").alias("__path"), F.col("blob").alias("__of"), F.col("spans").alias("__spans")))
    d = docs.withColumn("__blob", F.sha2(F.coalesce("text", F.lit("")), 256))
    d = d.join(sized_broadcast(found), F.col("doc_id").eqNullSafe(F.col("__path")) & (F.col("__blob") == F.col("__of")), "left")
    text = F.col("text")
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(a, s):
        gap = F.concat(F.substr(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit(mark))
        return F.struct(F.concat(a["done"], F.when(s["start"] >= a["at"], gap).otherwise(F.lit(""))).alias("done"), F.greatest(a["at"], s["end"]).alias("at"))

    kept = F.aggregate("__spans", start, step, lambda a: F.concat(a["done"], F.substr(text, a["at"].cast("int") + 1)))
    new = F.when(F.col("__spans").isNull(), text).otherwise(kept)
    columns = {"text": new, "n_chars": F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length(new).cast("long"))} if "n_chars" in docs.columns else {"text": new}
    return d.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns))


def digest(paths: DataFrame) -> DataFrame:
    """The query's columns of the findings of every path."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(k) for k in KINDS]
    own = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return paths.select(F.col("path").alias("doc_id"), *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
