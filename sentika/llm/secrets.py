"""Secret scan over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger keeps one row
for each blob and rule version that has been scanned, with its findings. A scan looks only at
blobs that the ledger lacks for the rules at hand, appends them, and joins the ledger's findings
back to all paths and versions that hold the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentika.llm.common import written
from sentika.session import scratch_path

FINDINGS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"sha binary, rule_version string, findings {FINDINGS}"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    flags: int = 0

    def finder(self):
        return re.compile(self.pattern, self.flags | re.ASCII)


#: The kinds, in the order in which spans of one start are listed.
RULES: tuple[Rule, ...] = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        2,
        re.IGNORECASE,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)


def rule_version(rules: Sequence[Rule] = RULES) -> str:
    """Changes whenever a rule does."""
    return hashlib.sha256(repr([tuple(vars(r).values()) for r in rules]).encode()).hexdigest()[:16]


def _quick(rule: Rule):
    """The rule's finder, with the length in the pattern where that finds the same matches sooner.

    A run of one character class is matched whole from its start, so a minimum on it skips
    exactly the matches that would be dropped for their length.
    """
    if rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern):
        return re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}", rule.flags | re.ASCII)
    return rule.finder()


def _scanner(rules: Sequence[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [(k, r, _quick(r)) for k, r in enumerate(rules)]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = [
                    (m.start(), k, m.end())
                    for k, r, finder in finders
                    for m in finder.finditer(text or "")
                    if m.end(r.group) - m.start(r.group) >= r.least
                ]
                rows.append([{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(found)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch({"sha": batch.column(0), "findings": pa.array(rows, kind)})

    return run


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; nothing has been scanned where there is none yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan(
    versions: DataFrame,
    ledger_path: str | None = None,
    rules: Sequence[Rule] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Findings of every path: the id, the blob's ``sha`` and its ``findings``.

    One row for each input row; a null text is the empty blob; null and repeated ids stay rows of
    their own; other columns are not read; an empty table scans nothing. Offsets count code
    points, the end is exclusive; findings are ordered by start, then rule.

    ``ledger_path`` keeps what is scanned for later calls (default: a fresh one in scratch). One
    writer at a time: rows scanned twice would only be stored twice, findings stay the same.
    """
    spark, version = versions.sparkSession, rule_version(rules)
    ledger_path = ledger_path or scratch_path(spark, "blob-ledger")
    text = F.coalesce(F.col(text_col), F.lit(""))
    addressed = versions.select(
        F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), text.alias("text")
    )
    paths = written(addressed.select("id", "sha"), "blob-paths")
    known = read_ledger(spark, ledger_path).where(F.col("rule_version") == version)
    # one holder of each unseen blob is read: copies are never shuffled by content with their texts
    unseen = paths.groupBy("sha").agg(F.min("id").alias("holder")).join(known, "sha", "left_anti")
    texts = addressed.alias("a").join(
        unseen.alias("u"), F.expr("a.sha = u.sha AND a.id <=> u.holder"), "left_semi"
    )
    found = texts.select("sha", "text").mapInArrow(_scanner(rules), f"sha binary, findings {FINDINGS}")
    # rows repeated with their id are scanned together; the ledger takes the blob once
    fresh = found.groupBy("sha").agg(F.first("findings").alias("findings"))
    fresh.select("sha", F.lit(version).alias("rule_version"), "findings").write.mode("append").parquet(ledger_path)
    known = read_ledger(spark, ledger_path).where((F.col("rule_version") == version) & (F.size("findings") > 0))
    # written, so that a blob with very many paths can be split in the join
    once = written(known.groupBy("sha").agg(F.first("findings").alias("findings")), "blob-findings")
    return paths.join(once, "sha", "left").select(
        F.col("id").alias(id_col), "sha", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings")
    )


def count_of(kind: str) -> Column:
    return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")


def spans_text() -> Column:
    """``kind:start:end`` of all findings, comma-joined."""
    one = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    return F.array_join(F.transform("findings", one), ",")
