"""Secret scans with a ledger of blobs, all in DataFrame operations.

Every historical version of every path is content-addressed. Only pairs of a blob and a rule version that the ledger
does not know are scanned; findings are kept by blob and joined back to all paths that ever held it.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.llm import spans as S
from snapfold.llm.common import columns_of, cut, fresh, register, shared_dir, spread


class Rule(NamedTuple):
    version: int
    kind: S.Kind
    #: Finds only valid matches inside marked ones, for redaction.
    valid_pattern: str


def _has(word: str):
    return lambda t: F.contains(t, F.lit(word))


_VALUE = "[A-Za-z0-9+/_.=-]"
_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
_any = lambda v: F.lit(True)
# A key block runs to its END marker, whatever is between but another marker. Without one it runs over header fields and
# base64: long runs, then lines that hold nothing else or end in padding. Line ends may be escaped or spaces.
_SEP, _LINE, _B64 = r"(?:\s|\\[nr])", r"(?:\r?\n|\r|(?:\\r)?\\n)", "[A-Za-z0-9+/=]"
_FIELDS = rf"(?:{_SEP}*+(?:Proc-Type|DEK-Info)\x20*+:(?:[^\r\n\\])*+)*+"
_BASE64 = rf"(?:{_SEP}*+{_B64}{{16,}}+)*+(?:{_LINE}[\x20\t]*+{_B64}++[\x20\t]*+(?={_LINE}|\z|\x01))*+(?:{_SEP}++[A-Za-z0-9+/]++={{1,2}}+)?+"
_PEM = rf"-----BEGIN [A-Z ]*?PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*?PRIVATE KEY-----|{_FIELDS}{_BASE64})"
# The last two and pem add common formats to the three base kinds. pem comes first, lest another rule masks part of a marker.
RULES = {
    "pem": Rule(3, S.Kind(_PEM, _has("PRIVATE KEY-----"), _any), _PEM),
    "assign": Rule(1, S.Kind(rf"{_ASSIGN}{_VALUE}++", lambda t: t.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), lambda v: F.length(F.regexp_extract(v, rf"^{_ASSIGN}({_VALUE}+)$", 1)) >= 8), rf"{_ASSIGN}{_VALUE}{{8,}}+"),
    "access": Rule(1, S.Kind(r"AKIA[A-Z0-9]++", _has("AKIA"), lambda v: F.length(v) >= 16), r"AKIA[A-Z0-9]{12,}+"),
    "hex": Rule(1, S.Kind(r"(?<![0-9a-f])[0-9a-f]{32,}+", lambda t: t.rlike("(?<![0-9a-f])[0-9a-f]{32}"), _any), r"[0-9a-f]{32,}+"),
    "hosted": Rule(1, S.Kind(r"gh[pousr]_[A-Za-z0-9]{36,}+", lambda t: t.rlike("gh[pousr]_[A-Za-z0-9]{36}"), _any), r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    "jwt": Rule(1, S.Kind(r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", _has(".eyJ"), _any), r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
}
BASE = ["assign", "access", "hex"]
#: Most blobs (64 characters each) that a broadcast may hold.
LOOKUP = 50_000


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def scan(versions: DataFrame, ledger: str, text: str = "text", rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """Scan what the ledger in folder ``ledger`` does not know yet, add it there, and return all its findings for these rules.

    versions: any rows with a text, one for each version of each path. Returns (blob, kind, start, end). The ledger is
    two tables: scanned (blob, rule, version) and findings (blob, rule, version, start, end). Findings are written
    first, so a run that breaks off in between scans again, and readers take distinct findings.
    """
    spark = versions.sparkSession
    known = _read(spark, f"{ledger}/scanned", "blob string, rule string, version int")
    current = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(r.version).alias("version")) for name, r in rules.items()))
    t = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(blob_of(F.col(text)).alias("blob")).distinct()
    pairs = blobs.select("blob", F.inline(current)).join(known, ["blob", "rule", "version"], "left_anti")
    unseen = cut(pairs.groupBy("blob").agg(F.collect_set("rule").alias("rules")))  # an array of at most len(rules)
    # Most texts pass no rule's gate; only the others move.
    gates = F.array_compact(F.array(*(F.when(r.kind.gate(t), F.lit(name)) for name, r in rules.items())))
    open_ = versions.select(blob_of(F.col(text)).alias("blob"), t.alias("text"), gates.alias("gates")).where(F.size("gates") > 0)
    open_ = open_.dropDuplicates(["blob"]).join(unseen, "blob").where(F.arrays_overlap("gates", "rules"))
    kinds = {name: r.kind for name, r in rules.items()}
    found = S.find(open_.select("blob", "text", "rules"), kinds, ["blob", "rules"]).where(S.valid(kinds) & F.expr("array_contains(rules, kind)"))
    version = F.lit(0)
    for name, r in rules.items():
        version = F.when(F.col("kind") == name, F.lit(r.version)).otherwise(version)
    found.select("blob", F.col("kind").alias("rule"), version.alias("version"), "start", "end").write.mode("append").parquet(f"{ledger}/findings")
    versioned = unseen.select("blob", F.explode("rules").alias("kind")).select("blob", F.col("kind").alias("rule"), version.alias("version"))
    versioned.write.mode("append").parquet(f"{ledger}/scanned")
    findings = _read(spark, f"{ledger}/findings", "blob string, rule string, version int, start long, end long")
    wanted = F.lit(False)
    for name, r in rules.items():
        wanted = wanted | ((F.col("rule") == name) & (F.col("version") == r.version))
    return findings.where(wanted).select("blob", F.col("rule").alias("kind"), "start", "end").distinct()


def new_ledger(spark: SparkSession) -> str:
    """The path of an empty ledger. It goes with the intermediate tables when they are released; a ledger to keep has a path of its own."""
    path = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    register(path)
    return path


def report(docs: DataFrame, ledger: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, counts of base spans by kind, base_sha256 and all spans.

    A null text is an empty blob without findings; repeated rows and texts share a blob, and each row gets its findings.
    A null id stays null. An empty table gives an empty result; extra columns are ignored.
    """
    found = scan(docs, ledger or new_ledger(docs.sparkSession), text)
    counts = [F.count_if(F.col("kind") == n).alias(f"n_{n}") for n in BASE]
    per = found.groupBy("blob").agg(*counts, S.joined(F.col("kind").isin(BASE), BASE).alias("base_"), S.joined(F.lit(True), BASE).alias("spans"))
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), blob_of(F.col(text)).alias("blob")))
    out = spread(rows, "blob")(per, "left")  # a blob may stand for a great part of all rows
    none = F.lit("")
    return out.select("doc_id", *(F.coalesce(f"n_{n}", F.lit(0)).cast("long").alias(f"n_{n}") for n in BASE), F.sha2(F.coalesce("base_", none), 256).alias("base_sha256"), F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, ledger: str | None = None, text: str = "text", mask: str = "[SECRET]", rules: Mapping[str, Rule] = RULES) -> DataFrame:
    """docs with every found secret replaced by ``mask`` in texts that have findings; other texts stay as they are.

    A null text stays null. Rows are independent: repeated rows and ids are masked alike, an empty table stays empty,
    and other columns, whatever their names, pass through.
    """
    found = scan(docs, ledger or new_ledger(docs.sparkSession), text, rules).select(F.col("blob").alias("_hit")).distinct()
    t = F.coalesce(F.col(text), F.lit(""))
    gate = F.lit(False)
    for r in rules.values():
        gate = gate | r.kind.gate(t)
    blob, hit = fresh(docs, "_blob"), fresh(docs, "_hit")
    found = cut(found.select(F.col("_hit").alias(blob), F.lit(True).alias(hit)))
    if found.limit(LOOKUP + 1).count() <= LOOKUP:  # few enough to go to every task: one pass, no text moves
        open_, clean = docs.withColumn(blob, F.when(gate, blob_of(F.col(text)))).join(F.broadcast(found), blob, "left"), None
    else:  # only texts that pass a gate move
        open_ = spread(docs.where(gate).withColumn(blob, blob_of(F.col(text))), blob)(found, "left")
        clean = docs.where(~gate).select(columns_of(docs))
    # The mark and the escape of a text's own marks are characters that no rule knows.
    escape, own, itself = "\u0002", "\u0003", "\u0004"
    new = F.replace(F.replace(F.col(text), F.lit(escape), F.lit(escape + itself)), F.lit(S.MARK), F.lit(escape + own))
    for r in rules.values():
        # Fence in all matches first, so that a match too short to count still hides what it covers.
        new = F.regexp_replace(new, r.kind.pattern, f"{S.MARK}$0{S.MARK}")
        new = F.translate(F.regexp_replace(new, f"{S.MARK}{r.valid_pattern}{S.MARK}", mask), S.MARK, "")
    new = F.replace(F.replace(new, F.lit(escape + own), F.lit(S.MARK)), F.lit(escape + itself), F.lit(escape))
    masked = open_.withColumn(text, F.when(F.col(hit), new).otherwise(F.col(text))).select(columns_of(docs))
    return masked if clean is None else clean.union(masked)
