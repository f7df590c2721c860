"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger
is a table with one row per blob and scan: the rule versions that were applied
and what they found. A batch is reduced to its distinct blobs, those are joined
with the ledger, and only pairs of blob and rule version that it lacks are
scanned and appended; findings then go back to all paths by the blob's address.
A new version of one rule therefore scans every blob for that rule alone.

Everything is an expression of Spark SQL. A match's place is the summed length,
in code points, of the gaps and matches before it: ``split`` gives the gaps,
``regexp_extract_all`` the matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` of which group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    #: A pattern that is found in every text with a valid match, perhaps in others too.
    probe: str | None = None
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]%s)"""
#: A key or hex run that is too short holds no longer one, so its length may stand in the pattern. A value that is
#: too short can hold the next keyword and uses it up, so its length is looked at after the match.
BASE_RULES = (
    Rule("assign", _ASSIGN % "+", 2, 8, _ASSIGN % "{8}"),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE_RULES + MORE_RULES

SPANS = "array<struct<start:int,end:int>>"
LEDGER = "blob binary, rules array<string>, found array<struct<rule:string,start:int,end:int>>"
#: Spans are gathered in runs of this many, so that appending one never copies all before it.
RUN = 256


def spans(text: Column, rule: Rule) -> Column:
    """Start and end, in code points, of each match of ``rule`` in ``text``."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("core"),
    )
    none = F.array().cast(SPANS)

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["hit"]), F.lit(0))
        full = F.size(acc["run"]) >= RUN
        run = F.when(full, none).otherwise(acc["run"])
        ok = F.length(part["core"]) >= rule.least
        return F.struct(
            end.alias("at"),
            F.when(full, F.concat(acc["runs"], F.array(acc["run"]))).otherwise(acc["runs"]).alias("runs"),
            F.when(ok, F.concat(run, F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(run).alias("run"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("runs"), none.alias("run"))
    return F.aggregate(parts, start, step, lambda acc: F.concat(F.flatten(acc["runs"]), acc["run"]))


class SecretLedger:
    """The ledger of scanned blobs in the table ``table``."""

    def __init__(self, spark: SparkSession, table: str, rules: Sequence[Rule] = RULES):
        self.spark, self.table, self.rules = spark, table, tuple(rules)

    def create(self) -> None:
        """Makes the ledger, empty, if there is none."""
        self.spark.createDataFrame([], LEDGER).write.mode("ignore").format("parquet").saveAsTable(self.table)

    def read(self) -> DataFrame:
        """Rows (blob, rules, found): a row for each time that a blob was scanned."""
        return self.spark.table(self.table) if self.spark.catalog.tableExists(self.table) else self.spark.createDataFrame([], LEDGER)

    def _unseen(self, blobs: DataFrame) -> DataFrame:
        """Rows (blob, text, todo): the rule versions, not none, that each of the distinct ``blobs`` still lacks."""
        keys = F.array(*[F.lit(r.key) for r in self.rules])
        seen = self.read().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = blobs.join(seen.hint("merge"), "blob", "left").select("blob", "text", F.when(F.col("seen").isNull(), keys).otherwise(F.array_except(keys, "seen")).alias("todo"))
        return todo.where(F.size("todo") > 0)

    def add(self, docs: DataFrame) -> DataFrame:
        """Scans what is new in ``docs`` (doc_id, text), appends it, and returns ``findings`` of them."""
        self.scan(docs)
        return self.findings(docs)

    def findings(self, docs: DataFrame) -> DataFrame:
        """A row per row of ``docs``: what the ledger has on it, for the present rule versions.

        Columns: doc_id, blob and found, an array of (start, rule_no, end, kind)
        by start, then the rule's place in ``rules``. Null texts count as empty.
        Rows that repeat give repeated rows; null doc_ids pass through; other
        columns are not read; an empty table gives no rows.
        """
        number = F.create_map(*[x for i, r in enumerate(self.rules) for x in (F.lit(r.key), F.struct(F.lit(i).alias("no"), F.lit(r.kind).alias("kind")))])
        valid = F.filter("found", lambda s: F.array_contains(F.array(*[F.lit(r.key) for r in self.rules]), s["rule"]))
        known = (
            self.read().where(F.size("found") > 0).groupBy("blob").agg(F.flatten(F.collect_list(valid)).alias("found"))
            .select("blob", F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), number[s["rule"]]["no"].alias("rule_no"), s["end"].alias("end"), number[s["rule"]]["kind"].alias("kind")))).alias("found"))
        )
        rows = docs.select("doc_id", F.unhex(F.sha2(text_or_empty().cast("binary"), 256)).alias("blob"))
        none = F.array().cast("array<struct<start:int,rule_no:int,end:int,kind:string>>")
        return rows.join(known, "blob", "left").select("doc_id", "blob", F.coalesce("found", none).alias("found"))

    def scan(self, docs: DataFrame) -> None:
        """Scans the pairs of blob and rule version in ``docs`` that the ledger lacks, and appends them."""
        text = text_or_empty()
        versions = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
        self.create()
        blobs = self._unseen(versions.groupBy("blob").agg(F.first("text").alias("text")))

        def found(rule: Rule) -> Column:
            named = F.transform(spans(F.col("text"), rule), lambda s: F.struct(F.lit(rule.key).alias("rule"), s["start"].alias("start"), s["end"].alias("end")))
            due = F.array_contains("todo", rule.key) & F.col("text").rlike(rule.probe or rule.pattern)
            return F.when(due, named).otherwise(F.array().cast("array<struct<rule:string,start:int,end:int>>"))

        scanned = blobs.select("blob", F.col("todo").alias("rules"), F.concat(*map(found, self.rules)).alias("found"))
        scanned.write.mode("append").format("parquet").saveAsTable(self.table)


def span_text(found: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
