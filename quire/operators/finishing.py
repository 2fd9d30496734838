"""Passes that finish texts after they are classed: columns, stacks, run colours, cells, and the steps around them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.geometry import Box, overlap_1d
from quire.functions.text import strip, visible
from quire.operators.greedy import per_page
from quire.operators.islands import avg2_cluster, gap_cluster, median_cluster
from quire.operators.slots import size_class
from quire.session import TEXT_ROWS, dropped, stored

#: Marks that a label of a stack or a table cell doesn't hold, and those that a compact Latin label doesn't.
SENTENCE_MARKS = "，。！？；;,:："
LABEL_MARKS = SENTENCE_MARKS + "、/\\()（）[]{}<>《》"
#: What ``visible`` doesn't count.
_SPACES = re.compile(r"[ \t\n\x0b\f\r]")
#: Columns that clearing takes away again.
ANNOTATIONS = ("class_idx", "new_size", "new_x1", "new_x", "reasons", "style_table_column_x", "inferred")
#: Emission order of the kinds of elements.
KINDS = ("text", "image", "shape")


def _without(text: Column, marks: str) -> Column:
    return F.translate(text, marks, "") == text


def compact_latin_label(text: Column) -> Column:
    """Up to 16 visible characters without white space or marks, two or more and 55 % of them Latin letters."""
    s = strip(F.coalesce(text, F.lit("")))
    letters, n = F.regexp_count(s, F.lit("[A-Za-z]")), visible(s)
    return (s != "") & (n <= 16) & ~s.rlike(r"\s") & _without(s, LABEL_MARKS) & (letters >= 2) & (letters >= 0.55 * F.greatest(n, F.lit(1)))


def short_stack_text(text: Column) -> Column:
    """Up to 14 visible characters without marks of sentences."""
    s = strip(F.coalesce(text, F.lit("")))
    return (s != "") & (visible(s) <= 14) & _without(s, SENTENCE_MARKS)


def table_label(text: Column, width: Column, height: Column) -> Column:
    """A short text in a box that is small enough for a cell of a table."""
    return short_stack_text(text) & (visible(F.coalesce(text, F.lit(""))) > 0) & (width > 0) & (height > 0) & (width <= 180) & (height <= 44)


def modal_cluster(df: DataFrame, key: list[str], value: str, gap: float = 7, least: int = 2) -> DataFrame:
    """(key, target): the median of the fullest cluster; of clusters almost as full (one fewer) as the fullest all are looked at, but more members win, then the rightmost.

    A key whose clusters all have fewer than ``least`` members gives no row.
    """
    sizes = gap_cluster(df, key, value, gap).groupBy(*key, "cluster").agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("median"))
    most = F.max("n").over(Window.partitionBy(*key))
    open_ = sizes.withColumn("most", most).where((F.col("n") >= F.greatest(F.lit(least), F.col("most") - 1)))
    return open_.groupBy(*key).agg(F.round(F.max_by("median", F.struct("n", "median")), 3).alias("target"))


def _column_targets(rows: DataFrame, key: list[str], reach: float) -> DataFrame:
    """Columns of ``rows`` (key, idx, x, w, h, cy) that are lists of like labels: (key, column, target), with their members."""
    numbered = median_cluster(rows, key, "x", reach).withColumnRenamed("cluster", "column")
    column = [*key, "column"]
    shape = numbered.groupBy(*column).agg(F.count("*").alias("n"), (F.max("cy") - F.min("cy")).alias("tall"), F.percentile(F.greatest("h", F.lit(1.0)), 0.5).alias("mh"), (F.max("x") - F.min("x")).alias("spread"), (F.max(F.greatest("w", F.lit(1.0))) / F.min(F.greatest("w", F.lit(1.0)))).alias("ratio"))
    shape = shape.where((F.col("n") >= 3) & (F.col("tall") > 1.6 * F.col("mh")) & (F.col("spread") <= reach) & (F.col("ratio") <= 1.75))
    both = numbered.join(shape.select(*column, "mh"), column)
    down = Window.partitionBy(*column).orderBy("cy")
    step = F.coalesce((F.col("cy") - F.lag("cy").over(down) > F.greatest(F.lit(8.0), 0.45 * F.col("mh"))).cast("int"), F.lit(1))
    lines = both.withColumn("line", step).groupBy(*column).agg(F.sum("line").alias("lines")).where("lines >= 3").select(*column)
    found = both.join(lines, column)
    return found.join(modal_cluster(found, column, "x"), column)


def table_like_scopes(members: DataFrame, key: list[str], least_rows: int = 3) -> DataFrame:
    """Scopes with six texts or more in ``least_rows`` rows that spread over 90 pixels: (key)."""
    sizes = members.groupBy(*key).agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("wide")).where("n >= 6 and wide >= 90").select(*key)
    rows = avg2_cluster(members.join(sizes, key), key, "cy", 10).groupBy(*key).agg(F.count("*").alias("rows"))
    return rows.where(F.col("rows") >= least_rows).select(*key)


def table_column_snap(texts: DataFrame, contains: DataFrame, reach: float = 34) -> DataFrame:
    """(page_id, idx, x1, new_x): labels in a column of a table-like scope take the column's modal left edge.

    ``texts``: page_id, idx, x1, y1, x2, y2, label (may be a cell's label);
    ``contains``: (page_id, text_idx, container_idx, area). Scopes go from the
    smallest; what a scope has aligned, larger ones leave alone, so the n-th
    table-like scopes of all pages make one round. Only scopes with the three
    labels that a column needs count. There are as many rounds as the page with
    most of them has; each reads the labels that no round before has aligned.
    """
    box = Box.of()
    rows = texts.select("page_id", "idx", F.col("x1").cast("double").alias("x"), box.width.cast("double").alias("w"), box.height.cast("double").alias("h"), box.cy.cast("double").alias("cy"), "label")
    of = contains.select("page_id", F.col("text_idx").alias("idx"), F.col("container_idx").alias("scope"), "area")
    members = rows.join(of, ["page_id", "idx"])
    scopes = table_like_scopes(members, ["page_id", "scope"])
    labels = members.where("label").join(scopes, ["page_id", "scope"])
    enough = labels.groupBy("page_id", "scope").agg(F.count("*").alias("n")).where("n >= 3").select("page_id", "scope")
    left = labels.join(enough, ["page_id", "scope"])
    left = stored(left.withColumn("rank", F.dense_rank().over(Window.partitionBy("page_id").orderBy("area", "scope"))))
    aligned: DataFrame | None = None
    for k in range(1, (left.agg(F.max("rank")).first()[0] or 0) + 1):
        here = left.where(F.col("rank") == k)
        found = _column_targets(here.select("page_id", "scope", "idx", "x", "w", "h", "cy"), ["page_id", "scope"], reach)
        off = F.abs(F.col("x") - F.col("target"))
        found = found.withColumn("new_x", F.when((off <= reach) & (off >= 0.15), F.col("target")).otherwise(F.col("x")))
        moved = F.max((F.col("new_x") != F.col("x")).cast("int")).over(Window.partitionBy("page_id", "scope", "column"))
        new = stored(found.withColumn("moved", moved).where("moved = 1").groupBy("page_id", "idx").agg(F.min_by("new_x", "scope").alias("new_x")))
        was, aligned = aligned, new if aligned is None else stored(aligned.unionByName(new))
        old, left = left, stored(left.where(F.col("rank") > k).join(new.select("page_id", "idx"), ["page_id", "idx"], "left_anti"))
        dropped(old, was, new if was is not None else None)
    dropped(left)
    if aligned is None:
        return texts.select("page_id", "idx", "x1", F.col("x1").cast("double").alias("new_x"))
    return texts.join(aligned, ["page_id", "idx"], "left").select("page_id", "idx", "x1", F.coalesce("new_x", F.col("x1").cast("double")).alias("new_x"))


def reliability(text: Column, box: Box) -> Column:
    """How far a label's measured place can be trusted: its length, and its size up to a bound."""
    bounded = lambda v, most: F.least(F.lit(most), F.greatest(F.lit(0.0), v))
    return visible(F.coalesce(text, F.lit(""))) + bounded(box.width / 40.0, 8.0) + bounded(box.height / 8.0, 4.0)


def stack_center(pairs: DataFrame) -> DataFrame:
    """``pairs`` (page_id, a, b and text, x1, y1, x2, y2 of both, with _a and _b) that are a stack of two short labels, with ``center``.

    Stacked: centres apart by 0.42 heights (8 at least) to 1.85 (38 at least),
    more than half over each other, and centred alike within 0.42 widths (24 at
    least). The centre is that of the more reliable label, the first on a tie.
    """
    a, b = Box.of("_a"), Box.of("_b")
    one = lambda v: F.greatest(v.cast("double"), F.lit(1.0))
    aw, bw, ah, bh = one(a.width), one(b.width), one(a.height), one(b.height)
    down, across = F.abs(a.cy - b.cy), F.abs(a.cx - b.cx)
    stacked = (
        short_stack_text(F.col("text_a"))
        & short_stack_text(F.col("text_b"))
        & (down >= F.greatest(F.lit(8.0), 0.42 * F.least(ah, bh)))
        & (down <= F.greatest(F.lit(38.0), 1.85 * (ah + bh) / 2))
        & (overlap_1d(a.x1, a.x2, b.x1, b.x2) >= 0.55 * F.least(aw, bw))
        & (across > 1)
        & (across <= F.greatest(F.lit(24.0), 0.42 * F.least(aw, bw)))
    )
    score = lambda s, box: F.struct(reliability(F.col(f"text_{s}"), box).alias("r"), visible(f"text_{s}").alias("v"))
    return pairs.where(stacked).withColumn("center", F.when(score("a", a) >= score("b", b), a.cx).otherwise(b.cx).cast("double"))


def colour_snap(r: Column, g: Column, b: Column, line: tuple[Column, Column, Column], tolerance: int = 60, grey: int = 20, luminance: float = 130) -> Column:
    """Does a character's colour count as its line's? Within ``tolerance`` per channel, or both grey and near in luminance."""
    close = reduce(lambda x, y: x & y, [F.abs(x - y) <= tolerance for x, y in zip((r, g, b), line, strict=True)])
    is_grey = lambda x, y, z: (F.abs(x - y) < grey) & (F.abs(y - z) < grey) & (F.abs(x - z) < grey)
    light = lambda x, y, z: 0.299 * x + 0.587 * y + 0.114 * z
    return close | (is_grey(r, g, b) & is_grey(*line) & (F.abs(light(r, g, b) - light(*line)) < luminance))


_RUN = "array<struct<text:string,r:int,g:int,b:int>>"


def _near(x: tuple, y: tuple, tolerance: int) -> bool:
    """Are all channels known and within ``tolerance``?"""
    return all(p is not None and q is not None and abs(p - q) <= tolerance for p, q in zip(x, y, strict=True))


def _same(x: tuple, y: tuple) -> bool | None:
    """SQL's equality of all channels: None if it hangs on an unknown one."""
    known = [p == q for p, q in zip(x, y, strict=True) if p is not None and q is not None]
    return False if not all(known) else True if len(known) == len(x) else None


def _line_runs(colours: list[tuple], starts: list[int], seen: list[int], whole: list[bool], line: tuple, tolerance: int) -> tuple[list[int], list[tuple]]:
    """(starts, colours) of the runs of a line, given as stretches of one colour.

    ``seen``: visible characters of each stretch; ``whole``: no character is null.
    """
    runs: list[list] = []
    for colour, start, n, known in zip(colours, starts, seen, whole, strict=True):
        last = runs[-1] if runs else None
        if last and (colour[0] is None or last[0][0] is None or _near(colour, last[0], tolerance)):
            last[0] = colour if last[0][0] is None else last[0]
            last[2] += n
            last[3] &= known
        else:
            runs.append([colour, start, n, known])
    at: list[int] = []
    out: list[tuple] = []
    for colour, start, n, known in runs:
        colour = tuple(v if v is not None else w for v, w in zip(colour, line, strict=True))
        noise = known and n < 2 and _same(colour, line) is False
        if out and (noise or _same(colour, out[-1])):
            continue
        at.append(start)
        out.append(line if noise else colour)
    return at, out


def _fuzzy_runs(chars: pa.Array, r: pa.Array, g: pa.Array, b: pa.Array, tolerance: int) -> pa.Array:
    """The runs of a batch of lines. Characters are only compared and counted as whole columns; Python goes from one change of colour to the next."""
    flat = chars.flatten()
    n = len(flat)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(chars), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    parts = dict(zip(("ch", *"rgb"), flat.flatten(), strict=True))
    sides = [parts[k].cast(pa.int64()) for k in "rgb"]
    # unknown channels differ from all known values
    codes = [pc.fill_null(v, np.iinfo(np.int64).min).to_numpy() for v in sides]
    change = np.zeros(n, bool)
    for v in codes:
        change[1:] |= v[1:] != v[:-1]
    change[ends[:-1][ends[:-1] < n]] = True
    # colours known in part are near none, not even themselves
    valid = [v.is_valid().to_numpy(zero_copy_only=False) for v in sides]
    change |= valid[0] & ~(valid[1] & valid[2])
    starts = np.flatnonzero(change)
    kinds = parts["ch"].dictionary_encode()
    width = np.array([0 if c is None else len(_SPACES.sub("", c)) for c in kinds.dictionary.to_pylist()] or [0])
    lost = parts["ch"].is_null().to_numpy(zero_copy_only=False)
    visible_ = np.where(lost, 0, width[pc.fill_null(kinds.indices, 0).to_numpy()])
    seen = np.add.reduceat(visible_, starts).tolist() if n else []
    whole = (~np.logical_or.reduceat(lost, starts)).tolist() if n else []
    colours = list(zip(*[v.take(starts).to_pylist() for v in sides], strict=True))
    first = np.searchsorted(starts, ends).tolist()
    starts = starts.tolist()

    at: list[int] = []
    found: list[tuple] = []
    sizes = [0]
    for i, line in enumerate(zip(r.to_pylist(), g.to_pylist(), b.to_pylist(), strict=True)):
        p, q = first[i], first[i + 1]
        if p < q:
            where, what = _line_runs(colours[p:q], starts[p:q], seen[p:q], whole[p:q], line, tolerance)
            at += where
            found += what
        sizes.append(len(at))
    # a run's text is a stretch of the characters, which stand one after the other already
    ch = parts["ch"].cast(pa.large_string())
    places = np.frombuffer(ch.buffers()[1], np.int64, n + 1, ch.offset * 8) if n else np.zeros(1, np.int64)
    cuts = np.array([*at, n], np.int64)
    whole_runs = ~np.logical_or.reduceat(lost, cuts[:-1]) if at else np.zeros(0, bool)
    mask = pa.py_buffer(np.packbits(whole_runs, bitorder="little").tobytes())
    text = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(places[cuts].tobytes()), ch.buffers()[2] if n else pa.py_buffer(b""), mask).cast(pa.string())
    channels = [pa.array([c[k] for c in found], pa.int32()) for k in range(3)]
    runs = pa.StructArray.from_arrays([text, *channels], names=["text", *"rgb"])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), runs, mask=chars.is_null())


def fuzzy_rle(lines: DataFrame, key: list[str], tolerance: int = 40) -> DataFrame:
    """(key, runs): neighbouring characters of like colour as runs.

    ``lines``: key, chars array<struct<ch, r, g, b>> in order (r null: not
    known), and the line's colour ``r, g, b``. A character joins the run while
    within ``tolerance`` of its first colour; without a colour it joins anyhow.
    Runs of another colour than the line's with fewer than two visible
    characters go to the run before, or take the line's colour. Linear in the
    characters of a line: Arrow batches are folded from one change of colour to
    the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS):
                some = batch.slice(at, TEXT_ROWS)
                runs = _fuzzy_runs(*[some.column(c) for c in ("__chars", "__r", "__g", "__b")], tolerance)
                yield pa.RecordBatch.from_arrays([*[some.column(k) for k in key], runs], names=[*key, "runs"])

    schema = ", ".join(f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in key)
    return lines.select(*key, *[F.col(c).alias(f"__{c}") for c in ("chars", *"rgb")]).mapInArrow(run, f"{schema}, runs {_RUN}")


def style_cells(cells: DataFrame) -> DataFrame:
    """``cells`` (row, col, rows, text) with fill, color, bold, align and size by place and content of the cell."""
    text = F.coalesce("text", F.lit(""))
    header, total = F.col("row") == 0, F.col("row") == F.col("rows") - 1
    number = (F.col("col") > 0) & text.rlike(r"\p{Nd}")
    dark = header | (total & (F.col("col") == 0))
    hot = F.col("text").isin("5", "3", "1") & F.col("col").isin(1, 4)
    number_colour = F.when(hot, "#D43E3E").when(text == "0", "#777777").otherwise("#054798")
    return cells.withColumns(
        {
            "fill": F.when(dark, "#08498D").when(total, "#EEF4FB").when(F.col("row") % 2 == 1, "#F7FAFE").otherwise("#EEF3FA"),
            "color": F.when(dark, "#FFFFFF").when(total & F.col("col").isin(1, 2, 4), "#C01818").when(total, "#054798").when(number, number_colour).when(F.col("col") == 0, "#666666").otherwise("#222222"),
            "bold": dark | total | number,
            "align": F.when(dark | total | (F.col("col") > 0), "center").otherwise("left"),
            "size": F.when(dark, 8).when(total & number, 18).when(total, 9).when(number, 16).otherwise(8),
        }
    )


def ruled_prefilter(segments: DataFrame, key: list[str], width: Column, height: Column, rows: Column, cols: Column) -> DataFrame:
    """(key, across, down, ok): are there enough long lines both ways for a table of ``rows`` by ``cols``?

    ``segments``: key, x1, y1, x2, y2, horizontal. A line is long from 0.45 of
    the width, or 0.35 of the height. The four sizes are columns of ``segments``.
    """
    need = lambda n: F.least(F.lit(2), F.greatest(F.lit(1), n - 1))
    across = F.count_if(F.col("horizontal") & (F.col("x2") - F.col("x1") >= 0.45 * width))
    down = F.count_if(~F.col("horizontal") & (F.col("y2") - F.col("y1") >= 0.35 * height))
    out = segments.groupBy(*key).agg(across.alias("across"), down.alias("down"), F.max(need(rows)).alias("__r"), F.max(need(cols)).alias("__c"))
    return out.select(*key, "across", "down", ((F.col("across") >= F.col("__r")) & (F.col("down") >= F.col("__c"))).alias("ok"))


def ruled_candidates(segments: DataFrame, gap: float = 60, least: int = 4, spread: float = 0.55) -> DataFrame:
    """(page_id, x1, y1, x2, y2, rows, cols): grids of ruled lines on a page.

    ``segments``: page_id, idx, x1, y1, x2, y2, horizontal. From each horizontal
    line on, those follow that lie within ``gap`` of the last and half under it;
    ``least`` of them with gaps of like size (deviation over mean up to
    ``spread``), 250 by 90 pixels or more, and ``least`` vertical lines make a
    grid. A grid that lies mostly in a larger one goes. Pages are streamed, so
    a page is all that a task holds.
    """

    def work(page: list) -> Iterator[tuple]:
        flat = sorted((s for s in page if s.horizontal), key=lambda s: ((s.y1 + s.y2) / 2, s.x1, s.idx))
        upright = [s for s in page if not s.horizontal]
        found = []
        for i, first in enumerate(flat):
            run = [first]
            for s in flat[i + 1 :]:
                last = run[-1]
                if (s.y1 + s.y2 - last.y1 - last.y2) / 2 > gap:
                    break
                if min(last.x2, s.x2) - max(last.x1, s.x1) >= 0.5 * min(last.x2 - last.x1, s.x2 - s.x1):
                    run.append(s)
            if len(run) < least:
                continue
            steps = np.diff([(s.y1 + s.y2) / 2 for s in run])
            x1, y1, x2, y2 = min(s.x1 for s in run), min(s.y1 for s in run), max(s.x2 for s in run), max(s.y2 for s in run)
            if steps.mean() <= 0 or steps.std() / steps.mean() > spread or x2 - x1 < 250 or y2 - y1 < 90:
                continue
            across = sum(x1 - 8 <= (v.x1 + v.x2) / 2 <= x2 + 8 and max(0, min(y2, v.y2) - max(y1, v.y1)) >= 0.3 * (y2 - y1) for v in upright)
            if across >= least:
                found.append((x1, y1, x2, y2, max(2, len(run) - 1), max(2, across - 1)))
        kept: list[tuple] = []
        for c in sorted(found, key=lambda c: (-(c[2] - c[0]) * (c[3] - c[1]), c)):
            own = (c[2] - c[0]) * (c[3] - c[1])
            if all(max(0, min(c[2], k[2]) - max(c[0], k[0])) * max(0, min(c[3], k[3]) - max(c[1], k[1])) <= 0.5 * own for k in kept):
                kept.append(c)
                yield page[0].page_id, *c

    sides = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    return per_page(segments.select("page_id", "idx", *sides, "horizontal"), work, "page_id long, x1 double, y1 double, x2 double, y2 double, rows int, cols int")


def split_rows(signal: DataFrame, key: list[str], pos: str, on: str, gap: int = 4, least: int = 36) -> DataFrame:
    """(key, start, stop): stretches of ``least`` positions of a signal, which breaks of up to ``gap`` positions don't end.

    ``signal`` has a row for every position; a break of fewer than ``gap`` at
    its very end belongs to the last stretch. Keys with fewer than two stretches
    give no row: they stay whole.
    """
    w = Window.partitionBy(*key).orderBy(pos)
    lit = signal.withColumn("__all", F.max(pos).over(Window.partitionBy(*key)) + 1).where(F.col(on))
    new = F.coalesce((F.col(pos) - F.lag(pos).over(w) > gap + 1).cast("int"), F.lit(0))
    runs = lit.withColumn("__n", new).withColumn("__run", F.sum("__n").over(w)).groupBy(*key, "__run").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("stop"), F.max("__all").alias("__all"))
    runs = runs.withColumn("stop", F.when(F.col("__all") - F.col("stop") < gap, F.col("__all")).otherwise(F.col("stop"))).where(F.col("stop") - F.col("start") >= least)
    return runs.withColumn("__m", F.count("*").over(Window.partitionBy(*key))).where("__m >= 2").drop("__m", "__run", "__all")


def split_axis(gaps: DataFrame, size: DataFrame, key: list[str]) -> DataFrame:
    """(key, start, stop): the blocks between the gaps of ``gap_runs``, up to ``size`` (key, size); keys without a gap give no row."""
    w = Window.partitionBy(*key).orderBy("start")
    before = gaps.select(*key, F.coalesce(F.lag("stop").over(w), F.lit(0)).alias("start"), F.col("start").alias("stop"))
    after = gaps.groupBy(*key).agg(F.max("stop").alias("start")).join(size, key).select(*key, "start", F.col("size").alias("stop"))
    return before.unionByName(after).where("stop > start")


def active_history(jobs: DataFrame, key: list[str], active: tuple = ("queued", "running")) -> DataFrame:
    """(key, active, history): jobs still to end, and all others."""
    busy = F.coalesce(F.col("status").isin(*active), F.lit(False))
    return jobs.groupBy(*key).agg(F.count_if(busy).alias("active"), F.count_if(~busy).alias("history"))


def sibling_slot(texts: DataFrame, contains: DataFrame, containers: DataFrame, siblings: DataFrame) -> DataFrame:
    """(page_id, a, b): texts at the same relative place of two sibling containers.

    ``siblings``: (page_id, a, b) of containers, a < b. Relative left, top, width
    and height agree within 0.08, 0.10, 0.22 and 0.16; pairs meet on cells of the
    relative place, so the texts of a container aren't all paired.
    """
    c = containers.select("page_id", F.col("idx").alias("container_idx"), *[F.col(k).alias(f"{k}_c") for k in ("x1", "y1", "x2", "y2")])
    inside, outer = Box.of(), Box.of("_c")
    w, h = (F.greatest(v.cast("double"), F.lit(1.0)) for v in (outer.width, outer.height))
    rows = texts.join(contains.select("page_id", F.col("text_idx").alias("idx"), "container_idx"), ["page_id", "idx"]).join(c, ["page_id", "container_idx"])
    rows = rows.select("page_id", "idx", "container_idx", ((inside.x1 - outer.x1) / w).alias("l"), ((inside.y1 - outer.y1) / h).alias("t"), (inside.width / w).alias("w"), (inside.height / h).alias("h"))
    cell = lambda v, step: F.floor(F.col(v) / step).cast("long")
    side = lambda s: rows.select("page_id", F.col("container_idx").alias(s), F.col("idx").alias(f"idx_{s}"), *[F.col(k).alias(f"{k}_{s}") for k in "ltwh"])
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = side("a").join(siblings.select("page_id", "a", "b"), ["page_id", "a"])
    a = a.withColumn("i", F.explode(F.transform(near, lambda d: cell("l_a", 0.08) + d))).withColumn("j", F.explode(F.transform(near, lambda d: cell("t_a", 0.10) + d)))
    b = side("b").withColumns({"i": cell("l_b", 0.08), "j": cell("t_b", 0.10)})
    limits = {"l": 0.08, "t": 0.10, "w": 0.22, "h": 0.16}
    close = reduce(lambda x, y: x & y, [F.abs(F.col(f"{k}_a") - F.col(f"{k}_b")) <= v for k, v in limits.items()])
    pairs = a.join(b, ["page_id", "b", "i", "j"]).where(close & (F.col("idx_a") != F.col("idx_b")))
    return pairs.select("page_id", F.least("idx_a", "idx_b").alias("a"), F.greatest("idx_a", "idx_b").alias("b")).distinct()


def merge_finalizers(texts: DataFrame, classes: DataFrame, passes: tuple = ("center", "size", "align")) -> DataFrame:
    """The passes over classed texts in their fixed order: ``texts`` with x1, x2, size and align changed.

    center: members of a class of two whose centres are within 24 take the
    class's mean centre; size and align: as ``size_class``.
    """

    def center(rows: DataFrame) -> DataFrame:
        of = Window.partitionBy("page_id", "class_idx")
        cx = (F.col("x1") + F.col("x2")) / 2.0
        shift = F.when(F.col("class_idx").isNotNull() & (F.count("*").over(of) == 2) & (F.max(cx).over(of) - F.min(cx).over(of) <= 24), F.avg(cx).over(of) - cx).otherwise(0.0)
        return rows.withColumn("__shift", shift).withColumns({"x1": F.col("x1") + F.col("__shift"), "x2": F.col("x2") + F.col("__shift")}).drop("__shift")

    def styled(rows: DataFrame, name: str) -> DataFrame:
        plain = rows.drop("class_idx")
        new = size_class(plain, classes).select("page_id", "idx", F.col("new_size" if name == "size" else name).alias("__new"))
        return rows.join(new, ["page_id", "idx"], "left").withColumn(name, F.coalesce("__new", name)).drop("__new")

    steps = {"center": center, "size": lambda r: styled(r, "size"), "align": lambda r: styled(r, "align")}
    rows = texts.join(classes.select("page_id", "idx", "class_idx"), ["page_id", "idx"], "left")
    for name in ("center", "size", "align"):
        if name in passes:
            rows = rows.transform(steps[name])
    return rows.drop("class_idx")


def clear_annotations(elements: DataFrame) -> DataFrame:
    """``elements`` as before the passes: rows that a pass inferred go, and so do its columns. Once or twice, the result is the same."""
    kept = elements.where(~F.coalesce("inferred", F.lit(False))) if "inferred" in elements.columns else elements
    return kept.drop(*ANNOTATIONS)


def role_lists(boxes: DataFrame) -> DataFrame:
    """(page_id, text, image, shape): names of a page's elements by kind, each list in emission order."""
    named = F.struct("idx", F.concat_ws("_", "kind", "idx").alias("name"))
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, named))), lambda s: s["name"]).alias(k) for k in KINDS]
    return boxes.groupBy("page_id").agg(*lists)
