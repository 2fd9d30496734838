"""Collocation mining by best-first branch and bound.

A phrase grows word by word from its prefix. The score of a phrase with the count a is
a * a / (f(first part) * f(rest)) at its worst cut, and neither part is rarer than the
phrase, so no phrase that grows from a prefix can score more than f(prefix) over the
count of the prefix without its last word. Two passes count all words and all word pairs;
longer phrases are counted only where their bound, with their largest possible count,
still reaches the best scores found so far. What is counted in a round is the frontier:
prefixes that a phrase above the mark can grow from, and pairs above the mark whose
survival a longer phrase decides. The mark falls, and the frontier grows, until in each
language at least ``best`` phrases at or above the mark survive; nothing unknown can
stand above it then, ties included.

All counts are sums over the whole corpus, grouped by phrase and summed in the
partitions first, so a frequent phrase is no hot key. Frontiers are broadcast only if
they are counted to be small, and meet the corpus in a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import dropped, small, stored

#: Where a text is cut into pieces; no phrase reaches across.
PIECES = r"[.,;:!?\x0A-\x0D]+"
GAPS = r"[\x20\x09]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shares of a count are whole numbers of this.
UNIT = 1_000_000
#: Words of the longest phrase.
LONGEST = 3


def pieces(docs: DataFrame, lang_col: str, text_col: str, no_lang: str) -> DataFrame:
    """``(lang, w)``: the words of each piece that has any."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(no_lang)).alias("lang"), F.explode(F.split(text, PIECES)).alias("piece"))
    return rows.select("lang", F.array_remove(F.split("piece", GAPS), "").alias("w")).where(F.size("w") > 0)


def _score(a: str, left: str, right: str) -> Column:
    """floor(UNIT * a * a / (left * right)) in whole numbers of up to 38 digits."""
    wide = lambda c: f"cast({c} as decimal(19,0))"
    return F.expr(f"({wide(a)} * {wide(a)} * cast({UNIT} as decimal(7,0))) div ({wide(left)} * {wide(right)})")


def _narrow(df: DataFrame, *texts: str, rows: int = 500_000, size: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows, and the bytes of its text columns, are counted to be few."""
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(sum((F.octet_length(c) for c in texts), F.lit(0)).cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def counted_words(words: DataFrame, least: int) -> DataFrame:
    """``(lang, a, n)``: words that occur ``least`` times, and the sum of all rarer ones (a null)."""
    single = words.select("lang", F.explode("w").alias("a")).groupBy("lang", "a").agg(F.count("*").alias("n"))
    return stored(single.groupBy("lang", F.when(F.col("n") >= least, F.col("a")).alias("a")).agg(F.sum("n").alias("n")))


def counted_pairs(words: DataFrame, least: int) -> DataFrame:
    """``(lang, a, b, n)``: pairs of neighbours that occur ``least`` times."""
    pairs = words.select("lang", F.inline(F.arrays_zip("w", F.slice("w", F.lit(2), F.size("w"))))).toDF("lang", "a", "b").where("b is not null")
    return pairs.groupBy("lang", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _key(a: str, b: str) -> Column:
    return F.xxhash64("lang", a, b)


def _grown(words: DataFrame, frontier: DataFrame, least: int) -> DataFrame:
    """``(lang, a, b, c, n)``: phrases of three words that grow from a pair of the frontier, or end with one that is ``open``.

    The frontier meets the words by hash; where that lets another phrase in, its
    count is right too. A frontier that isn't small lets all phrases in.
    """
    after = lambda k: F.slice("w", F.lit(k), F.size("w"))
    rows = words.where(F.size("w") >= LONGEST).select("lang", F.inline(F.arrays_zip("w", after(2), after(3)))).toDF("lang", "a", "b", "c").where("c is not null")
    keys = frontier.groupBy(_key("a", "b").alias("key")).agg(F.max("open").alias("open"))
    if keys.count() <= FRONTIER:
        keys = F.broadcast(keys)
        rows = rows.withColumns({"x": _key("a", "b"), "y": _key("b", "c")})
        rows = rows.join(keys.select(F.col("key").alias("x"), F.lit(True).alias("grows")), "x", "left").join(keys.where("open").select(F.col("key").alias("y"), "open"), "y", "left").where("grows or open")
    return rows.groupBy("lang", "a", "b", "c").agg(F.count("*").alias("n")).where(F.col("n") >= least)


#: Pairs of a frontier that still go to every task, as numbers.
FRONTIER = 1_000_000
#: The first frontier reaches to this many times ``best`` known phrases, the next ones each to GROWTH times as many.
FIRST, GROWTH = 2, 4


def _at_mark(score: str) -> Column:
    return (F.col(score) > F.col("mark")) | ((F.col(score) == F.col("mark")) & (F.col("n") >= F.col("mark_n")))


def _marks(known: DataFrame, open_: DataFrame, rank: int) -> DataFrame:
    """``(lang, mark, mark_n)``: score and count of the known phrase of that rank in each open language; -1 where there are fewer."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"))
    top = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rank).groupBy("lang").agg(F.count("*").alias("many"), F.min(F.struct("score", "n")).alias("last"))
    full = F.col("many") >= rank
    return stored(open_.join(top, "lang", "left").select("lang", F.when(full, F.col("last.score")).otherwise(-1).alias("mark"), F.when(full, F.col("last.n")).otherwise(0).alias("mark_n")), 1)


def collocations(docs: DataFrame, best: int = 2000, least: int = 10, cover: int = 50, lang_col: str = "lang", text_col: str = "text", no_lang: str = "und") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score, cut)``: each language's first ``best`` phrases of two or three words.

    Texts are lower-cased (A-Z), cut into pieces at ``PIECES`` and into words at
    blanks and tabs. ``a`` counts a phrase's occurrences within pieces, overlaps
    included; phrases with ``a >= least`` are candidates. ``cut`` is the number of
    words of the first part, with the count ``l`` (the rest: ``r``), at which
    floor(1000000 * a * a / (l * r)) is lowest, the smallest of equal ones.
    Candidates within a longer one that occurs in at least ``cover`` % of their
    places are dropped. Order: score and ``a`` falling, then the phrase by its
    bytes. ``n`` counts all words of the language.

    Null texts and texts without words give nothing; null languages are ``no_lang``;
    repeated rows count as often as they stand; other columns are ignored; a table
    without candidates gives no rows.
    """
    words = pieces(docs, lang_col, text_col, no_lang)
    single = counted_words(words, least)
    known = single.where("a is not null").select("lang", F.col("a").alias("w"), F.col("n").alias("f"))
    ones = _narrow(known, "w")
    one = lambda w, f: ones.select("lang", F.col("w").alias(w), F.col("f").alias(f))
    two = counted_pairs(words, least).join(one("a", "l"), ["lang", "a"]).join(one("b", "r"), ["lang", "b"])
    two = stored(two.select("lang", "a", "b", "n", "l", "r", _score("n", "l", "r").alias("score"), F.expr(f"cast(n as decimal(19,0)) * {UNIT} div l").alias("bound")))
    pairs = _narrow(two.select("lang", "a", "b", "n"), "a", "b")
    pair = lambda a, b, f: pairs.select("lang", F.col("a").alias(a), F.col("b").alias(b), F.col("n").alias(f))

    open_ = stored(two.select("lang").distinct(), 1)
    results, three, rank = None, None, FIRST * best
    while open_.limit(1).count():
        seen = two.select("lang", "score", "n") if three is None else two.select("lang", "score", "n").unionByName(three.select("lang", "score", "n"))
        marks = _marks(seen, open_, rank)
        near = small(marks)
        frontier = stored(two.join(near, "lang").where(_at_mark("bound")).select("lang", "a", "b", "n", "l", "r", "score", _at_mark("score").alias("open")))
        grown = _grown(words.join(small(open_), "lang", "left_semi"), frontier, least)
        grown = grown.join(pair("a", "b", "f12"), ["lang", "a", "b"]).join(pair("b", "c", "f23"), ["lang", "b", "c"]).join(one("a", "f1"), ["lang", "a"]).join(one("c", "f3"), ["lang", "c"])
        scored = grown.withColumns({"s1": _score("n", "f1", "f23"), "s2": _score("n", "f12", "f3")})
        first = F.col("s1") <= F.col("s2")
        either = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
        old, three = three, stored(scored.select("lang", "a", "b", "c", "n", either("f1", "f12").alias("l"), either("f23", "f3").alias("r"), F.least("s1", "s2").alias("score"), F.when(first, 1).otherwise(2).alias("cut")))
        longer = three.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("p"), F.col("n").alias("m")).groupBy("lang", "p.a", "p.b").agg(F.max("m").alias("m"))
        kept = frontier.where("open").join(longer, ["lang", "a", "b"], "left").where(F.col("m").isNull() | (100 * F.col("m").cast("decimal(20,0)") < cover * F.col("n").cast("decimal(20,0)")))
        kept = kept.select("lang", F.concat_ws(" ", "a", "b").alias("phrase"), "n", "l", "r", "score", F.lit(1).alias("cut"))
        above = three.join(near, "lang").where(_at_mark("score")).select("lang", F.concat_ws(" ", "a", "b", "c").alias("phrase"), "n", "l", "r", "score", "cut")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase")
        top = stored(kept.unionByName(above).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best))
        done = stored(top.groupBy("lang").agg(F.count("*").alias("many")).join(marks, "lang", "right").where((F.coalesce("many", F.lit(0)) >= best) | (F.col("mark") < 0)).select("lang"), 1)
        settled = top.join(small(done), "lang", "left_semi")
        results = settled if results is None else results.unionByName(settled)
        left = stored(open_.join(done, "lang", "left_anti"), 1)
        dropped(old, frontier, marks, open_)
        open_, rank = left, rank * GROWTH
    if results is None:
        results = two.select("lang", F.lit("").alias("phrase"), "n", "l", "r", "score", F.lit(1).alias("cut"), F.lit(1).alias("rank")).where("false")
    totals = single.groupBy("lang").agg(F.sum("n").alias("words"))
    out = results.join(small(totals), "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r", F.col("words").alias("n"), F.col("score").cast("long").alias("score"), "cut")
