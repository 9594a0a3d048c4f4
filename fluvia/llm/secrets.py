"""Secret scans with an incremental blob ledger.

Every version of a text is a blob, addressed by its SHA-256. The ledger holds the (blob, rule
version) pairs that were scanned, with their findings. A run scans only blobs that the ledger lacks
for the rule version, each once however many paths or repeated rows carry it, and joins findings back to all paths.
Texts move once, by blob; copies are folded in each task before that, so a hot blob moves once a task.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException
from pyspark.sql import functions as F

from .base import map_arrow, table, written

RULE_VERSION = 1
#: Base rules (fixed values): kind, pattern, least length, group measured.
BASE = (
    ("assign", re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 12, 1),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 16, 0),
)
#: Further rules of the scan (fixed values): well-known token shapes.
MORE = (
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    ("ghtoken", re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}")),
    ("slack", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}")),
)
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
_ASSIGN_HINT = re.compile(r"[pP][aA][sS][sS][wW]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]")
ENTROPY = 4.2
FINDINGS = "array<struct<kind: string, start: int, end: int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base findings: leftmost and non-overlapping for each kind, by start and then kind."""
    found = []
    for order, (kind, pattern, least, group) in enumerate(BASE):
        if kind == "access" and "AKIA" not in text or kind == "assign" and not _ASSIGN_HINT.search(text):
            continue
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def more_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Findings that the base rules lack: token shapes, and mixed-case strings with digits of high entropy."""
    found = [(kind, m.start(), m.end()) for kind, pattern in MORE for m in pattern.finditer(text)]
    for m in _MIXED.finditer(text):
        s = m.group()
        if re.search("[a-z]", s) and re.search("[A-Z]", s) and re.search("[0-9]", s) and _entropy(s) >= ENTROPY:
            found.append(("entropy", m.start(), m.end()))
    starts, ends = [], []  # stretches already taken, apart and in order
    for _, a, b in sorted(base, key=lambda s: s[1:]):
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out: list[tuple[str, int, int]] = []
    for kind, a, b in found:
        at = bisect_left(starts, b)
        if not at or ends[at - 1] <= a:
            starts.insert(at, a)
            ends.insert(at, b)
            out.append((kind, a, b))
    return out


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """(blob, rule_version, base, more) for each row (blob, text): the findings of one scan."""

    def make():
        def work(cols: dict) -> dict:
            base = [base_spans(t or "") for t in cols["text"]]
            more = [more_spans(t or "", b) for t, b in zip(cols["text"], base, strict=True)]
            rows = lambda xs: [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in xs]
            return {"blob": cols["blob"], "rule_version": [RULE_VERSION] * len(base), "base": rows(base), "more": rows(more)}

        return work

    return map_arrow(blobs.select("blob", "text"), make, f"blob binary, rule_version int, base {FINDINGS}, more {FINDINGS}")


def scan(versions: DataFrame, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan ``versions`` (path_id, text): findings (path_id, base, more) for every row, and the ledger rows to append.

    A path may have several versions and repeated rows; null ids are kept. ledger: rows of earlier runs, as returned here; None for an empty one.
    A blob that the ledger has for ``RULE_VERSION`` isn't scanned. Null texts are the empty blob. Other columns are ignored;
    an empty table gives no findings and no ledger rows.
    """
    hashed = versions.select("path_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"), "text")
    paths = written(hashed.select("path_id", "blob"), "paths")
    texts = hashed
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == RULE_VERSION)
        unseen = written(paths.select("blob").distinct().join(known.select("blob"), "blob", "left_anti"), "unseen")
        texts = hashed.join(unseen, "blob", "left_semi")
    # one text a blob, folded in each task before the shuffle: every unseen blob is scanned once
    new = written(scan_blobs(texts.groupBy("blob").agg(F.any_value("text").alias("text"))), "ledger")
    all_rows = new if ledger is None else new.unionByName(known.select(new.columns))
    hits = all_rows.where("size(base) + size(more) > 0").select("blob", "base", "more")
    none = F.array().cast(FINDINGS)
    found = paths.join(hits, "blob", "left").select("path_id", F.coalesce("base", none).alias("base"), F.coalesce("more", none).alias("more"))
    return found, new


def scan_with_ledger(versions: DataFrame, path: str) -> DataFrame:
    """Findings as ``scan`` gives them, with the ledger kept at ``path``: read where it is there, and what was scanned now appended.

    Two runs at once may both scan a blob; its rows are then equal, and one of them counts. A run that fails
    before its append leaves the ledger as it was.
    """
    spark = versions.sparkSession
    try:
        ledger = spark.read.parquet(path).dropDuplicates(["blob", "rule_version"])
    except AnalysisException:
        ledger = None
    found, new = scan(versions, ledger)
    new.write.mode("append").parquet(path)
    return found


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and the list of all spans, from ``found`` (path_id, base, more)."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda c: F.array_join(F.transform(c, line), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    order = {k: i for i, k in enumerate([*(r[0] for r in BASE), *(r[0] for r in MORE), "entropy"])}
    ranks = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    keyed = F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"].alias("start"), ranks[s["kind"]].alias("o"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select(
        F.col("path_id").alias("doc_id"),
        *(count(r[0]).alias(f"n_{r[0]}") for r in BASE),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(keyed)).alias("spans"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of every document; with ``fluvia.secrets.ledger`` set to a shared folder, the ledger there is used and kept."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path_id"), "text")
    kept = spark.conf.get("fluvia.secrets.ledger", None)
    return digest(scan_with_ledger(docs, kept) if kept else scan(docs)[0])
