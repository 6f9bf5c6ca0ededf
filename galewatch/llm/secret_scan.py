"""Secret scans over an incremental ledger of content-addressed blobs (built-in functions only).

Every version of a text is a blob, named by its SHA-256. The ledger holds a row per blob and rule version that has been
scanned, with its findings, none included. A scan takes only pairs that the ledger lacks, one text per blob, appends
them, and joins the ledger back to every path (here: document).

The rule version is a hash of the patterns, so rules that are edited never serve old findings. The ledger is partitioned
by it, and every scan adds a folder of its own: scans may overlap. Two that scanned the same blob both have a row for it,
with the same findings; one of them counts.

Defined cases: a null text is the empty blob, without findings; a null doc_id is kept; repeated rows each get their
blob's findings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galewatch.functions.tables import path_exists
from galewatch.llm.common import joined_spans, shared_dir, table, text_of, with_spans

KINDS = ("assign", "access", "hex")

#: The base rules, written so that a length bound is part of the pattern where that gives the same matches.
BASE = {
    "assign": r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?+\x20*+[:=]\x20*+[\"']?+[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
#: Provider formats that the base rules do not know; their spans are of the kind `access`.
MORE = {"provider": r"(?<![A-Za-z0-9_-])(?:gh[oprsu]_[A-Za-z0-9]{36,}+|sk_live_[A-Za-z0-9]{24,}+|xox[abprs]-[A-Za-z0-9-]{20,}+|AIza[A-Za-z0-9_-]{35}+(?![A-Za-z0-9_-]))|-----BEGIN\x20[A-Z\x20]{0,40}PRIVATE\x20KEY-----"}
ASSIGN_HEAD = r"^[A-Za-z_]+[\"']?+\x20*+[:=]\x20*+[\"']?+"
#: To be changed where findings change without a change of a pattern.
CODE_VERSION = "3"
FINDING = "struct<start:int,rank:int,kind:string,end:int,base:boolean>"


def rule_version() -> str:
    return hashlib.sha256(repr((CODE_VERSION, sorted(BASE.items()), sorted(MORE.items()), ASSIGN_HEAD)).encode()).hexdigest()[:16]


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """blob, text -> blob, findings."""
    rows = with_spans(blobs.select("blob", F.col("text").alias("_text")), "_text", {f"_{k}": p for k, p in (BASE | MORE).items()})

    def told(name: str, kind: str, base: bool) -> Column:
        spans = F.col(f"_{name}")
        if name == "assign":
            spans = F.filter(spans, lambda s: F.length(F.regexp_replace(s["hit"], ASSIGN_HEAD, "")) >= 6)
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(base).alias("base")))

    found = F.concat(*[told(k, k, True) for k in KINDS], told("provider", "access", False))
    return rows.select("blob", found.cast(f"array<{FINDING}>").alias("findings"))


def scan(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, text -> doc_id, blob, findings. `ledger`: folder of the ledger, made where missing.

    Without one, the ledger starts empty in the shared folder. A run that is repeated adds nothing.
    """
    spark = docs.sparkSession
    path = ledger or f"{shared_dir(spark)}/galewatch-{uuid.uuid4().hex}/ledger"
    own = f"{path}/rules={rule_version()}"
    schema = f"blob string, findings array<{FINDING}>"
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("blob", F.sha2("text", 256))
    # One text per unseen blob: the smallest doc_id is picked from (blob, doc_id) alone, so texts move once, unsorted.
    picked = rows.groupBy("blob").agg(F.min("doc_id").alias("_doc"))
    if path_exists(spark, own):
        picked = picked.join(spark.read.schema(schema).parquet(f"{own}/scan=*").select("blob"), "blob", "left_anti")
    picked = picked.withColumnRenamed("blob", "_blob")
    texts = rows.join(picked, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("blob") == F.col("_blob")), "left_semi")
    # Repeated rows of one document give the same blob more than once: the findings are the same, one row stays.
    scan_blobs(texts).groupBy("blob").agg(F.first("findings").alias("findings")).write.parquet(f"{own}/scan={uuid.uuid4().hex}")
    known = spark.read.schema(schema).parquet(f"{own}/scan=*").groupBy("blob").agg(F.first("findings").alias("findings"))
    return rows.select("doc_id", "blob").join(known, "blob").select("doc_id", "blob", "findings")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda s: s["base"])
    plain = lambda xs: joined_spans(F.transform(xs, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"])))
    count = lambda k: F.size(F.filter("findings", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(plain(base), 256).alias("base_sha256"), plain(F.col("findings")).alias("spans"))
