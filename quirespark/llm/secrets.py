"""Secret scans with an incremental blob ledger.

Every text is a blob, addressed by its SHA-256. A ledger lists, for each blob, the rules and versions that it was
scanned for and what they found; only (blob, rule, version) triples outside it are scanned, each blob once however many
rows hold it, and findings are joined from the ledger back to all rows. A first run has an empty ledger; a later
one with the returned ledger and new rule versions or new texts scans just those. DataFrame functions only.

A rule's matches are leftmost and non-overlapping; those that fail its length test are dropped.
Positions are code points, end exclusive.

Defined results: null text is empty; empty text has no finding; every row gets its own result,
equal doc_ids too; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Kinds in their order. In `hex` and `access` the length is part of the pattern: a run of the
#: class is matched from its start, so those that are too short never hide another match. A key without its END
#: line ends with the last of its lines, which have 16 or more letters; 60 of them hold the longest usual keys.
RULES = [
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", 1, r"[0-9a-f]{24,}", base=True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[A-Za-z0-9+/=\x09-\x0D\x20]*-----END [A-Z ]{0,20}PRIVATE KEY-----|(?:[\x09-\x0D\x20]+[A-Za-z0-9+/=]{16,}){0,60})"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
]
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans: what split() leaves between the matches tells where they start."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))

    def located() -> Column:
        gaps = F.split(text, rule.pattern, -1)
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))

        def step(held: Column, pair: Column) -> Column:
            start = held["at"] + F.length(pair["g"])
            end = start + F.length(pair["m"])
            span = F.struct(start.cast("long").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.cast("long").alias("end"))
            own = F.regexp_extract(pair["m"], rule.pattern, rule.group) if rule.group else pair["m"]
            return F.struct(end.cast("long").alias("at"), F.when(F.length(own) >= rule.least, F.concat(held["out"], F.array(span))).otherwise(held["out"]).alias("out"))

        pairs = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("g"), matches.alias("m"))
        return F.aggregate(pairs, zero, step)["out"]

    return F.when(F.size(matches) > 0, located())


_ENTRIES = f"array<struct<kind:string,version:int,spans:{SPANS}>>"


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"blob binary, entries {_ENTRIES}")


def unseen(blobs: DataFrame, ledger: DataFrame, rules: list[Rule]) -> DataFrame:
    """blobs(blob, ...) with ranks, the places in rules of those that the ledger doesn't list for the blob; only where there is any."""
    listed = F.coalesce(F.transform("entries", lambda e: F.struct(e["kind"].alias("kind"), e["version"].alias("version"))), F.array().cast("array<struct<kind:string,version:int>>"))
    held = blobs.join(ledger.select("blob", "entries"), "blob", "left").withColumn("listed", listed).drop("entries")
    new = [F.when(~F.array_contains("listed", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), F.lit(k)) for k, r in enumerate(rules)]
    return held.withColumn("ranks", F.filter(F.array(*new), lambda k: k.isNotNull())).drop("listed").where(F.size("ranks") > 0)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): findings(doc_id, blob, spans) for each row of docs(doc_id, text), and the ledger with what was scanned now.

    The ledger is (blob binary, entries), a row for each blob; without one, an empty one is begun.
    """
    before = empty_ledger(docs.sparkSession) if ledger is None else ledger
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    addressed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    paths = cut(addressed.select("doc_id", "blob"), "paths")
    holders = paths.groupBy("blob").agg(F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("holder"))
    wanted = cut(unseen(holders, before, rules), "unseen", True)
    keyed = addressed.select("blob", F.coalesce("doc_id", F.lit(-(2**63))).alias("holder"), "text")
    texts = keyed.join(wanted, ["blob", "holder"])
    found = [F.when(F.array_contains("ranks", F.lit(k)), F.coalesce(_spans(F.col("text"), r, k), F.array().cast(SPANS))).alias(f"spans_{k}") for k, r in enumerate(rules)]
    each = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.col(f"spans_{k}").alias("spans")) for k, r in enumerate(rules)])
    scanned = texts.select("blob", *found).select("blob", F.filter(each, lambda e: e["spans"].isNotNull()).cast(_ENTRIES).alias("new"))
    scanned = cut(scanned.groupBy("blob").agg(F.first("new").alias("new")), "scanned")  # equal rows have scanned it alike
    none = F.array().cast(_ENTRIES)
    after = before.join(scanned, "blob", "full_outer").select("blob", F.concat(F.coalesce("entries", none), F.coalesce("new", none)).alias("entries"))
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    own = F.filter("entries", lambda e: F.array_contains(current, F.struct(e["kind"].alias("kind"), e["version"].alias("version"))))
    by_blob = after.select("blob", F.array_sort(F.flatten(F.transform(own, lambda e: e["spans"]))).alias("spans")).where(F.size("spans") > 0)
    findings = paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    return findings, after


def said(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with each run of overlapping spans replaced."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(held: Column, s: Column) -> Column:
        fresh = s["start"] >= held["at"]
        gap = F.substr(text, (held["at"] + 1).cast("int"), (s["start"] - held["at"]).cast("int"))
        return F.struct(F.greatest(held["at"], s["end"]).alias("at"), F.when(fresh, F.concat(held["out"], gap, F.lit(mask))).otherwise(held["out"]).alias("out"))

    done = F.aggregate(spans, zero, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int")))).otherwise(text)
