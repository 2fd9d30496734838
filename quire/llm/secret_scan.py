"""Secrets in texts, over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. Only
blobs that the ledger has not seen with the current version of a rule are
scanned; findings belong to blobs and are joined back to all their paths.
DataFrame operations only: ``split`` and ``regexp_extract_all`` with the same
pattern give the gaps and the matches in turn, so their lengths add up to the
offsets of the matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern, and what its matches must have to count: the length of group ``group``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    version: int = 1


#: The base kinds, in their order.
BASE_RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, base=True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, base=True),
    Rule("hex", "[0-9a-f]+", 0, 24, base=True),
]
#: Formats of other keys.
MORE_RULES = [
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url", r"\b[a-z][a-z0-9+.-]{1,30}://[^\s/:@]+:[^\s/:@]+@"),
]
RULES = BASE_RULES + MORE_RULES
#: Matches that one fold gathers.
STRETCH = 256
LEDGER = "blob string, rule string, version int"


def _quick(rule: Rule) -> str:
    """The same pattern that no longer matches what is too short, where this is one run of characters."""
    return f"{rule.pattern[:-1]}{{{rule.least - 4 if rule.kind == 'access' else rule.least},}}" if rule.kind in ("access", "hex") else rule.pattern


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule in a text, as an array of (start, rank, kind, end, base), in code points."""
    pattern = F.lit(_quick(rule))
    gaps = F.split(text, _quick(rule), -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    one = "struct<start:int,end:int,size:int>"
    zipped = F.arrays_zip(whole.alias("whole"), part.alias("part"), F.slice(gaps, 1, F.size(whole)).alias("gap"))
    begun = lambda at, kind: F.struct(at.alias("at"), F.array().cast(kind).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["whole"])
        return F.struct(end.alias("at"), F.concat(acc["all"], F.array(F.struct(start.alias("start"), end.alias("end"), F.length(x["part"]).alias("size")))).alias("all"))

    def stretch(acc: Column, found: Column) -> Column:
        return F.aggregate(found, begun(acc["at"], f"array<{one}>"), step, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["all"], F.array(x["all"])).alias("all")))

    def offsets(matches: Column) -> Column:
        """Offsets add up from match to match; in stretches, as a fold copies what it has gathered."""
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / STRETCH).cast("int")), lambda k: F.slice(matches, k * STRETCH + 1, F.lit(STRETCH)))
        return F.aggregate(parts, begun(F.lit(0), f"array<array<{one}>>"), stretch, lambda acc: F.flatten(acc["all"]))

    steps = F.transform(F.array(zipped), offsets)[0]
    held = F.filter(steps, lambda s: s["size"] >= rule.least)
    typed = F.transform(held, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), s["end"].alias("end"), F.lit(rule.base).alias("base")))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,base:boolean>>")
    return F.when(text.rlike(_quick(rule)), typed).otherwise(none)


def scan_blobs(blobs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``(blob, text, due)`` -> ``(blob, spans)`` for blobs with a span; ``due`` names the rules to apply (null: all)."""
    each = [F.when(F.col("due").isNull() | F.array_contains("due", r.kind), _spans(F.col("text"), r, i)).otherwise(F.array()) for i, r in enumerate(rules)]
    return blobs.select("blob", F.array_sort(F.concat(*each)).alias("spans")).where(F.size("spans") > 0)


def secret_scan(versions: DataFrame, path_cols: list[str], text_col: str = "text", ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: list[Rule] = RULES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scan the versions' unseen blobs. Returns (result, findings, ledger).

    ``ledger``: ``(blob, rule, version)`` already scanned, ``findings``: ``(blob,
    spans)`` of earlier scans; none at first. The result has ``path_cols``, the
    ``blob`` and all its ``spans``, for every row of ``versions``: an array of
    (start, rank, kind, end, base), ordered, empty without findings. The other
    two are to be kept for the next call.

    A null text is an empty blob. Rows that repeat a path or a content are all
    returned and are scanned once. ``path_cols`` may hold nulls; other columns
    are ignored.
    """
    addressed = versions.select(*path_cols, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("__blob", F.sha2("__text", 256))
    blobs = addressed.select(F.col("__blob").alias("blob"), F.col("__text").alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        due = blobs.withColumn("due", F.lit(None).cast("array<string>"))
    else:
        current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
        seen = ledger.where(current[F.col("rule")] == F.col("version")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        due = blobs.join(seen, "blob", "left").withColumn("due", F.array_except(kinds, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("due") > 0).drop("seen")
    fresh = scan_blobs(due, rules)
    if findings is not None:
        # findings of rules that were scanned anew are replaced
        anew = due.select("blob", "due").withColumnRenamed("due", "__due")
        old = findings.join(anew, "blob", "left").select("blob", F.expr("filter(spans, s -> not coalesce(array_contains(__due, s.kind), false))").alias("spans"))
        fresh = old.unionByName(fresh).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).where(F.size("spans") > 0)
    entries = due.select("blob", F.explode(F.coalesce("due", F.array(*[F.lit(r.kind) for r in rules]))).alias("rule"))
    version = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    entries = entries.withColumn("version", version[F.col("rule")])
    known = entries if ledger is None else ledger.unionByName(entries).distinct()
    result = addressed.select(*path_cols, F.col("__blob")).join(fresh.select(F.col("blob").alias("__b"), F.col("spans").alias("__spans")), F.col("__blob") == F.col("__b"), "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,base:boolean>>")
    return result.select(*path_cols, F.col("__blob").alias("blob"), F.coalesce("__spans", none).alias("spans")), fresh, known
