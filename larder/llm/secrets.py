"""Secret scans with an incremental blob ledger.

Every historical version of a path is a blob, addressed by the SHA-256 of its content. The ledger is a Parquet table
(blob, rules, findings) with a row for each blob and rule version that was scanned, findings or none. A run reduces its
versions to distinct blobs, drops those the ledger holds under this rule version, scans the rest once each, appends
them, and joins findings back to all paths and versions.

Each distinct blob crosses one shuffle; a blob that many paths share is reduced before it. The join back moves narrow
rows, which adaptive execution can split for a hot blob.

Rules: the three base kinds, and added kinds (private keys, signed web tokens, known token prefixes, credentials in
URLs). Spans are code points, end exclusive; each kind is matched leftmost, without overlap.

Defined cases: null text is empty and has no findings. A very long text is one blob and scanned as a whole; it must fit a row.
Repeated rows each appear in the result, and null or repeated keys are kept as they are. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import digest, read_table, staged, text_or_empty

#: kind -> (pattern, group whose length counts, its least length, strings of which one must be in the text)
#: The first three are fixed by the contract and listed in its order.
RULES = {
    "assign": (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, (":", "=")),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    "hex": (r"[0-9a-f]{24,}", 0, 24, ()),
    "private_key": (r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\x09-\x0D\x20]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", 0, 0, ("-----BEGIN ",)),
    "web_token": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0, ("eyJ",)),
    "prefixed_token": (r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 0, ("gh", "xox", "sk_live_", "AIza")),
    "url_credential": (r"[a-z][a-z0-9+.-]{1,15}://[^\x09-\x0D\x20:/@]{1,64}:[^\x09-\x0D\x20:/@]{3,128}@", 0, 0, ("://",)),
}
BASE = ("assign", "access", "hex")
SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER_SCHEMA = f"blob binary, rules string, findings {SPANS}"


def rules_version(rules: dict = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()


def scanner(rules: dict = RULES):
    """A function from a text to its spans (start, order of the kind, kind, end), sorted."""
    compiled = [(k, kind, re.compile(p), group, least, needs) for k, (kind, (p, group, least, needs)) in enumerate(rules.items())]

    def scan(text: str) -> list[tuple[int, int, str, int]]:
        found = []
        for k, kind, pattern, group, least, needs in compiled:
            if needs and not any(n in text for n in needs):
                continue
            for m in pattern.finditer(text):
                a, b = m.span(group)
                if b - a >= least:
                    found.append((m.start(), k, kind, m.end()))
        return sorted(found)

    return scan


def scan_blobs(blobs: DataFrame, rules: dict = RULES) -> DataFrame:
    """(blob, rules, findings) of (blob, text) rows."""
    version = rules_version(rules)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for b in batches:
            found = [[{"kind": kind, "start": a, "end": e} for a, _, kind, e in scan(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("blob"), pa.array([version] * len(found)), pa.array(found, pa.list_(span))], ["blob", "rules", "findings"])

    return blobs.select("blob", "text").mapInArrow(run, LEDGER_SCHEMA)


def scan_history(versions: DataFrame, ledger: str, keys: list[str], rules: dict = RULES, text: str = "text") -> DataFrame:
    """`keys` (path and version columns), blob and findings per row of `versions`; the ledger gains unseen blobs."""
    spark, version = versions.sparkSession, rules_version(rules)
    content = text_or_empty(text)
    paths = versions.select(*keys, digest(content).alias("blob"))
    unseen = versions.select(digest(content).alias("blob"), content.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    known = read_table(spark, ledger, LEDGER_SCHEMA)
    if known is not None:
        unseen = unseen.join(known.filter(F.col("rules") == version), "blob", "left_anti")
    scan_blobs(unseen, rules).write.mode("append").parquet(ledger)
    stored = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).filter(F.col("rules") == version)
    # written first, so that the join has two plain exchanges and a hot blob can be split
    findings = staged(stored.groupBy("blob").agg(F.first("findings").alias("findings")), "findings")
    return paths.join(findings, "blob").select(*keys, "blob", "findings")
