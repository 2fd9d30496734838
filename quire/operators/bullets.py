"""List markers of a class of texts: one template a column of texts, and markers inferred where one is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Gap between columns of texts, share of texts with a marker, largest and smallest side of a good marker, its side if none is good.
COLUMN_GAP, MARKED_SHARE, LARGEST, SMALLEST, DEFAULT_SIDE = 34.0, 0.35, 24.0, 4.0, 10.0


def marker_score(w: Column, h: Column) -> Column:
    """How far a marker's shape is from a square of 5 to 16 pixels, to nine digits; lower is better."""
    w, h = F.greatest(w, F.lit(1.0)), F.greatest(h, F.lit(1.0))
    aspect = F.abs(F.log(F.greatest(F.lit(0.1), F.least(F.lit(10.0), w / h))))
    return F.round(aspect + (F.greatest(F.lit(0.0), h - 16) * 0.25 + F.greatest(F.lit(0.0), 5 - h)), 9)


def bullet_priors(texts: DataFrame, classes: DataFrame, markers: DataFrame, least: int = 3) -> DataFrame:
    """(page_id, class_idx, column, idx, x1, new_x1, path, marker_x, marker_y, marker_w, marker_h, inferred).

    ``texts``: page_id, idx, box, ignored (a marker was cut from its text);
    ``classes``: page_id, idx, class_idx; ``markers``: page_id, idx (of its text),
    path, box. Classes of ``least`` texts of which two, and 35 %, have a marker are
    cut into columns where left edges lie more than ``COLUMN_GAP`` apart. In a
    column with a marker all texts get one: that of the best shape (ties: lower,
    then further left, then first), at the median left edge of the markers, at the
    text's half height; ``inferred`` are those of texts that had none. Texts move to
    the median left edge of the marked ones if they are near. Several markers of a
    text count as the best of them, markers without path or box as none.
    """
    cls, col = ["page_id", "class_idx"], ["page_id", "class_idx", "column"]
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    given = markers.where("path is not null and x1 is not null and x2 is not null and y1 is not null and y2 is not null")
    one = F.min(F.struct(marker_score(w, h).alias("score"), h.alias("h"), F.col("x1").alias("x"), w.alias("w"), "path")).alias("m")
    rows = texts.join(classes, ["page_id", "idx"]).join(given.groupBy("page_id", "idx").agg(one), ["page_id", "idx"], "left")
    n, marked = F.count("*"), F.count_if(F.col("m").isNotNull() | F.coalesce("ignored", F.lit(False)))
    enough = rows.groupBy(*cls).agg(n.alias("n"), marked.alias("k")).where((F.col("n") >= least) & (F.col("k") >= F.greatest(F.lit(2), F.ceil(F.col("n") * MARKED_SHARE))))
    order = Window.partitionBy(*cls).orderBy("x1", "idx")
    rows = rows.join(enough.select(*cls), cls, "left_semi").withColumn("__new", F.coalesce((F.col("x1") - F.lag("x1").over(order) > COLUMN_GAP).cast("int"), F.lit(0)))
    rows = rows.withColumn("column", F.sum("__new").over(order))
    have = rows.where("m is not null")
    good = F.col("m.w").between(SMALLEST, LARGEST) & F.col("m.h").between(SMALLEST, LARGEST)
    middle = lambda c: F.percentile(c, 0.5)
    stats = have.groupBy(*col).agg(
        F.min(F.struct("m.score", "m.h", "x1", "idx", "m.w", "m.path")).alias("t"),
        middle("x1").alias("body"),
        middle("m.x").alias("marker_x"),
        middle(F.when(good, F.col("m.w"))).alias("good_w"),
        middle(F.when(good, F.col("m.h"))).alias("good_h"),
    )
    fits = (F.col("t.w") > 0) & (F.col("t.h") > 0) & (F.col("t.w") <= LARGEST) & (F.col("t.h") <= LARGEST)
    side = lambda c: F.when(fits, F.col(f"t.{c}")).otherwise(F.coalesce(f"good_{c}", F.lit(DEFAULT_SIDE)))
    out = rows.join(stats, col).withColumns({"marker_w": F.round(side("w"), 3), "__h": side("h")})
    new = F.when(F.abs(F.col("x1") - F.col("body")) <= COLUMN_GAP, F.round("body", 3)).otherwise(F.col("x1").cast("double"))
    return out.select(*cls, "column", "idx", "x1", new.alias("new_x1"), "t.path", F.round("marker_x", 3).alias("marker_x"), F.round(F.col("y1") + h / 2 - F.col("__h") / 2, 3).alias("marker_y"), "marker_w", F.round("__h", 3).alias("marker_h"), F.col("m").isNull().alias("inferred"))
