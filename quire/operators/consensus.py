"""One reading from several predictions of the same item."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_ascii, normalise, script_dominant

#: Confidence below which a preferred engine is not preferred.
PREFERRED_CONF = 0.30


def _first_text(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def _best(options: list[tuple[Column, Column]], ok: list[Column]) -> Column:
    """The option of the highest confidence among those that are ok; of equals the first."""
    rows = F.array(*[F.when(o, F.struct(c.alias("c"), F.lit(-i).alias("i"), t.alias("text"))) for i, ((t, c), o) in enumerate(zip(options, ok, strict=True))])
    return F.array_max(F.array_compact(rows))


def pick_best(t1: Column, c1: Column, t2: Column, c2: Column, t3: Column, c3: Column) -> Column:
    """struct<text, conf>: the engine strong in the script of the first text, else the most confident.

    Engine 1 is preferred for CJK text, engine 3 for ASCII, both from a
    confidence of 0.30 on. All empty: engine 1.
    """
    ref = _first_text(t1, t2, t3)
    cjk = script_dominant(ref)
    best = _best([(t1, c1), (t2, c2), (t3, c3)], [t1 != "", t2 != "", t3 != ""])
    pair = lambda t, c: F.struct(t.alias("text"), c.alias("conf"))
    return (
        F.when(cjk & (t1 != "") & (c1 >= PREFERRED_CONF), pair(t1, c1))
        .when(~cjk & is_ascii(ref) & (F.trim(ref) != "") & (t3 != "") & (c3 >= PREFERRED_CONF), pair(t3, c3))
        .when(best.isNull(), pair(t1, c1))
        .otherwise(pair(best["text"], best["c"]))
    )


def cross_verify(votes: DataFrame, high: float = 0.95, moderate: float = 0.85, compatibility: bool = False) -> DataFrame:
    """``votes`` (t1, c1, t2, c2, t3, c3) with ``tier``, ``reason`` and ``suggested_text``.

    Texts are compared in normal form. In turn: all empty; all equal; two equal
    (the text of the more confident of them, earlier engine first); all within
    one edit and of 3 characters or more; one confidence of ``high``; the best
    of ``moderate``; else red. Null texts count as empty, null confidences as 0.
    """
    t = [F.coalesce(f"t{i}", F.lit("")) for i in (1, 2, 3)]
    c = [F.coalesce(F.col(f"c{i}").cast("double"), F.lit(0.0)) for i in (1, 2, 3)]
    df = votes.withColumns({f"__n{i}": normalise(x, compatibility) for i, x in enumerate(t)})
    n = [F.col(f"__n{i}") for i in range(3)]
    same = lambda i, j: (n[i] != "") & (n[i] == n[j])
    agreed = F.when(same(0, 1) | same(0, 2), n[0]).when(same(1, 2), n[1])
    winner = _best(list(zip(t, [F.round(x, 4) for x in c], strict=True)), [x == agreed for x in n])
    within = lambda a, b: F.levenshtein(a, b, 1) >= 0  # noqa: E731  the bounded form takes time in proportion to the length
    close = (F.least(*[F.length(x) for x in n]) >= 3) & within(n[0], n[1]) & within(n[0], n[2]) & within(n[1], n[2])
    ok = [(x >= high) & (y != "") for x, y in zip(c, t, strict=True)]
    longest = F.array_max(F.array_compact(F.array(*[F.when(o, F.struct(F.length(y).alias("l"), F.lit(-i).alias("i"), y.alias("text"))) for i, (o, y) in enumerate(zip(ok, t, strict=True))])))["text"]
    from_high = F.when(script_dominant(longest) & ok[0], t[0]).when(is_ascii(longest) & ok[2], t[2]).otherwise(_best(list(zip(t, c, strict=True)), ok)["text"])
    best = pick_best(t[0], c[0], t[1], c[1], t[2], c[2])
    cases = [
        ((n[0] == "") & (n[1] == "") & (n[2] == ""), "green", "C_all_empty", F.lit("")),
        (same(0, 1) & same(0, 2), "green", "A_strict_consensus", _first_text(*t)),
        (agreed.isNotNull(), "green", "B_majority", winner["text"]),
        (close, "yellow", "D_edit_close", best["text"]),
        (ok[0] | ok[1] | ok[2], "yellow", "D_prime_single_high_conf", from_high),
        (best["conf"] >= moderate, "yellow", "G_moderate_conf_fallback", best["text"]),
        (F.lit(True), "red", "F_disagree", best["text"]),
    ]
    pick = lambda k: reduce(lambda chain, case: chain.when(case[0], F.lit(case[k]) if k < 3 else case[k]), cases[1:], F.when(cases[0][0], F.lit(cases[0][k]) if k < 3 else cases[0][k]))
    return df.withColumns({"tier": pick(1), "reason": pick(2), "suggested_text": pick(3)}).drop("__n0", "__n1", "__n2")


def rescue(verified: DataFrame, moderate: float = 0.85, compatibility: bool = False) -> DataFrame:
    """A fourth prediction (t4, c4) for red rows: yellow if it agrees with engine 2 or 3, or is sure of itself."""
    new = normalise(F.coalesce("t4", F.lit("")), compatibility)
    n1, n2, n3 = (normalise(F.coalesce(f"t{i}", F.lit("")), compatibility) for i in (1, 2, 3))
    open_ = (F.col("tier") == "red") & (new != "") & (new != n1)
    reason = F.when(open_ & (n2 == new), "G_crop_agrees_with_2").when(open_ & (n3 == new), "G_crop_agrees_with_3").when(open_ & (F.coalesce("c4", F.lit(0.0)) >= moderate), "G_crop_moderate_conf")
    return verified.withColumns(
        {
            "tier": F.when(reason.isNotNull(), "yellow").otherwise(F.col("tier")),
            "suggested_text": F.when(reason.isNotNull(), F.col("t4")).otherwise(F.col("suggested_text")),
            "reason": F.coalesce(reason, F.col("reason")),
        }
    )


def vote_long(votes: DataFrame, item: list[str], text: str = "txt", conf: str = "conf", order: str = "k") -> DataFrame:
    """Majority over any number of predictions in long form: the normal form most votes have, its best text.

    Ties: more confidence in all, then the earliest prediction. A partial sum a
    normal form; no list of votes is gathered.
    """
    forms = votes.withColumn("norm", normalise(text)).where("norm <> ''").groupBy(*item, "norm").agg(
        F.count("*").alias("votes"),
        F.sum(conf).alias("conf"),
        F.min(order).alias("first"),
        F.max_by(text, F.struct(F.col(conf), -F.col(order))).alias("text"),
    )
    top = F.max_by(F.struct("norm", "text", "votes"), F.struct("votes", "conf", -F.col("first")))
    return forms.groupBy(*item).agg(top.alias("top"), F.sum("votes").alias("of")).select(*item, "top.*", "of")
