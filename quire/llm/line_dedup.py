"""Repeated runs of lines, by a suffix array over line ids.

Lines become ids, and a document's lines a sequence. Prefix doubling ranks all
suffixes by their first 1, 2, 4, ... lines: the rank of a block of 2k lines is
the place of its pair (rank of the first k, rank of the next k) among all
pairs, which a range sort gives without a global window. Suffixes that agree
on a stretch of lines are an interval of the suffix array; it is named by its
length and the ranks of the two overlapping power-of-two blocks that cover it,
so no neighbours are looked up. Each interval of runs with enough words keeps its
first occurrence; later ones that go along with it merge into maximal runs, the
longest common stretches of both, and these are deleted.

Only lines that occur twice can lie in a repeated run, so documents are first
cut at lines that occur once, and stretches with too few words are left out.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import stored

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A document: whether it has an id, the id, and a hash of the text, as ids may repeat.
_ROW = ["known", "doc", "version"]


def _row(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """The key of a document, without nulls, so that joins keep it; rows without id come first in its order."""
    instead = F.lit(0).cast(docs.schema[id_col].dataType)
    return [F.col(id_col).isNotNull().alias("known"), F.coalesce(F.col(id_col), instead).alias("doc"), F.xxhash64(text_col).alias("version")]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    split = F.split(F.col(text_col), "\n", -1)
    return docs.select(*_row(docs, id_col, text_col), F.posexplode(split).alias("ln", "line")).withColumns(
        {"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")}
    )


def _named(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``: numbers in the order of ``keys``, equal for equal keys.

    Range-sorted partitions number their distinct keys in order, so the order
    of the numbers is that of the keys; they are written before use, since a
    second evaluation could cut the ranges elsewhere.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = rows.select(*keys).distinct().repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    names = stored(order.withColumn(name, F.monotonically_increasing_id()))
    return rows.join(names, keys)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Every later copy of a shortest run of lines with ``min_words`` words.

    Returns ``(known, doc, version, ln, n_lines, first)``: the run starts at line
    ``ln`` (from 0) and an equal run starts at ``first`` before, in order of
    document, version (a hash of the text, for ids that repeat) and line. Shortest from its first line or
    from its last; the union of these covers every longer repeated run.
    """
    lines = _lines(docs, id_col, text_col)
    twice = lines.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1").select("h1", "h2")
    kept = lines.withColumn("w", F.regexp_count("line", F.lit(WORD))).drop("line").join(twice, ["h1", "h2"])
    # neighbours in a document; rows that repeat a document whole count as one
    kept = kept.repartition(*_ROW).dropDuplicates([*_ROW, "ln"])
    of_doc = Window.partitionBy(*_ROW).orderBy("ln")
    kept = kept.withColumn("seg", F.col("ln") - F.row_number().over(of_doc))
    seg = [*_ROW, "seg"]
    in_seg = Window.partitionBy(*seg).orderBy("ln")
    kept = kept.withColumns({"words": F.sum("w").over(Window.partitionBy(*seg)), "upto": F.sum("w").over(in_seg)}).where(F.col("words") >= min_words)
    kept = kept.withColumn("before", F.col("upto") - F.col("w"))
    # lines in the shortest run from here, and up to here: those that begin (end) fewer than min_words words away
    near = min_words - 1
    ahead = F.count("*").over(Window.partitionBy(*seg).orderBy("before").rangeBetween(0, near)) - F.row_number().over(Window.partitionBy(*seg, "before").orderBy("ln")) + 1
    behind = F.count("*").over(Window.partitionBy(*seg).orderBy("upto").rangeBetween(-near, 0)) - F.row_number().over(Window.partitionBy(*seg, "upto").orderBy(F.desc("ln"))) + 1
    kept = kept.withColumns(
        {
            "ahead": F.when(F.col("words") - F.col("before") >= min_words, ahead),
            "behind": F.when(F.col("upto") >= min_words, behind),
        }
    )
    rows = stored(kept.select(*seg, "ln", "h1", "h2", "ahead", "behind"))
    most = rows.agg(F.greatest(F.max("ahead"), F.max("behind"))).first()[0] or 0

    ranked, k = _named(rows, ["h1", "h2"], "r0").drop("h1", "h2"), 0
    while 2 << k <= most:
        following = F.coalesce(F.lead(f"r{k}", 1 << k).over(in_seg), F.lit(-1))
        pairs = stored(ranked.withColumn("following", following))
        ranked, k = _named(pairs, [f"r{k}", "following"], f"r{k + 1}").drop("following"), k + 1
    ranked = stored(ranked)

    runs = ranked.where("ahead is not null").select(*_ROW, "ln", F.col("ahead").alias("n_lines"))
    runs = runs.union(ranked.where("behind is not null").select(*_ROW, (F.col("ln") - F.col("behind") + 1).alias("ln"), F.col("behind").alias("n_lines"))).distinct()
    level = sum((F.col("n_lines") >= (2 << i)).cast("int") for i in range(k)) + F.lit(0)
    runs = runs.withColumn("level", level)
    ranks = F.element_at(F.array(*[f"r{i}" for i in range(k + 1)]), F.col("level") + 1)
    table = ranked.select(*_ROW, "ln", *[f"r{i}" for i in range(k + 1)])
    first = runs.join(table, [*_ROW, "ln"]).select(*_ROW, "ln", "n_lines", "level", ranks.alias("head"), (F.col("ln") + F.col("n_lines") - F.expr("shiftleft(1, level)")).alias("at"))
    second = first.join(table.withColumnRenamed("ln", "at"), [*_ROW, "at"]).select(*_ROW, "ln", "n_lines", "head", ranks.alias("tail"))
    found = stored(second)
    place = F.struct(*_ROW, "ln")
    intervals = found.groupBy("n_lines", "head", "tail").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    return found.join(intervals, ["n_lines", "head", "tail"]).where(place > F.col("first")).select(*_ROW, "ln", "n_lines", "first")


def maximal_runs(runs: DataFrame) -> DataFrame:
    """``(known, doc, version, ln, n_lines, first)``: the later copies of ``repeated_runs`` merged to maximal runs.

    Copies of one document that overlap or touch and have the same first
    occurrence, as far on as they are themselves, are one stretch on which the
    two agree: their longest common run there. ``first`` is its start in the
    first occurrence.
    """
    of = [*_ROW, "first.known", "first.doc", "first.version"]
    rows = runs.select(*_ROW, "ln", "n_lines", "first", (F.col("ln") - F.col("first.ln")).alias("__shift"))
    w = Window.partitionBy(*of, "__shift").orderBy("ln", "n_lines")
    end = F.max(F.col("ln") + F.col("n_lines")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.coalesce((F.col("ln") > end).cast("int"), F.lit(0))).withColumn("__run", F.sum("__new").over(w))
    merged = rows.groupBy(*_ROW, *[F.col(c).alias(f"__{c.replace('.', '_')}") for c in of[3:]], "__shift", "__run")
    out = merged.agg(F.min("ln").alias("ln"), (F.max(F.col("ln") + F.col("n_lines")) - F.min("ln")).alias("n_lines"), F.min("first").alias("first"))
    return out.select(*_ROW, "ln", "n_lines", "first")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` without the later copies of repeated runs of lines.

    All columns stay; ``text_col`` loses the deleted lines, and
    ``lines_total``, ``lines_removed`` are added (they replace columns of these
    names). A run is lines in a row of one text, compared exactly, with
    ``min_words`` words or more; its first copy in order of id and line stays.
    Shorter repeated lines stay everywhere.

    A null text stays null with no lines; an empty one has one empty line. A
    text that loses all lines becomes empty. Rows with a null id come first in
    the order. Rows that repeat id and text are one document and are all
    returned alike; rows that repeat an id with other texts are separate.
    """
    runs = maximal_runs(repeated_runs(docs, id_col, text_col, min_words))
    gone = runs.select(*_ROW, F.explode(F.expr("sequence(ln, ln + cast(n_lines as int) - 1)")).alias("ln"))
    gone = gone.groupBy(*_ROW).agg(F.collect_set("ln").alias("__gone")).select(F.struct(*_ROW).alias("__row"), "__gone")
    lines = F.split(F.col(text_col), "\n", -1)
    names = [c for c in docs.columns if c not in ("lines_total", "lines_removed")]
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    known = gone.select(*[F.col(f"__row.{c}").alias(f"__{c}") for c in _ROW], "__gone")
    keyed = docs.select(*names, F.struct(*_row(docs, id_col, text_col)).alias("__at"))
    same = [F.col(f"__at.{c}") == F.col(f"__{c}") for c in _ROW]
    out = keyed.join(known, same, "left")
    return out.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in names],
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).alias("lines_total"),
        F.coalesce(F.size("__gone"), F.lit(0)).alias("lines_removed"),
    )
