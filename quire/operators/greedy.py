"""Greedy choices among conflicting rows, and order-dependent work within a page."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.graph import components
from quire.session import cut


def greedy_suppress(rows: DataFrame, conflicts: DataFrame, key: list[str], priority: list[str], rounds: int = 3, held: int = 100_000) -> DataFrame:
    """Rows that a greedy pass by priority keeps: a row stays unless it conflicts with one kept before.

    ``conflicts``: pairs (key_a, key_b) of ``rows``, in any direction;
    ``priority`` orders ascending and must be unique with the key. The same set
    as the sequential pass. ``rounds`` rounds of local winners come first: a row
    without an undecided conflict of higher priority stays, and its neighbours
    go; they decide nearly all, hubs of any size among them. What is left, such
    as chains of falling priority, is cut into components, and those of at most
    ``held`` conflicts are passed in order of priority, each in one task. Larger
    components go on with rounds, until all is decided.
    """
    rank = F.struct(*priority, *key)
    nodes = rows.select(*key, rank.alias("rank")).distinct()
    ka, kb = [f"{k}_a" for k in key], [f"{k}_b" for k in key]
    both = conflicts.select(*ka, *kb).union(conflicts.select(*kb, *ka)).distinct()
    named = lambda suffix: nodes.select(*[F.col(k).alias(f"{k}{suffix}") for k in key], F.col("rank").alias(f"rank{suffix}"))
    ends = lambda e: e.select(*[F.col(f"{k}_a").alias(k) for k in key]).union(e.select(*[F.col(f"{k}_b").alias(k) for k in key])).distinct()
    edges = cut(both.join(named("_a"), ka).join(named("_b"), kb).where("rank_a < rank_b").select(*ka, *kb, "rank_b"))  # a goes before b
    open_ = cut(ends(edges))
    gone: list[DataFrame] = []
    while open_.limit(1).count():
        for _ in range(rounds):
            beaten = edges.select(*[F.col(f"{k}_b").alias(k) for k in key]).distinct()
            won = cut(open_.join(beaten, key, "left_anti"))
            lost = cut(edges.join(won.select(*[F.col(k).alias(f"{k}_a") for k in key]), ka, "left_semi").select(*[F.col(f"{k}_b").alias(k) for k in key]).distinct())
            gone.append(lost)
            decided = won.union(lost)
            open_ = cut(open_.join(decided, key, "left_anti"))
            drop = lambda e, ks: e.join(decided.select(*[F.col(k).alias(n) for k, n in zip(key, ks, strict=True)]), ks, "left_anti")  # noqa: B023,E731
            edges = cut(drop(drop(edges, ka), kb))
            if not edges.limit(1).count():  # whoever is open is beaten by nobody
                return rows.join(reduce(DataFrame.union, gone), key, "left_anti")
        lost, edges = _settled(edges, key, held)
        gone.append(lost)
        open_ = cut(ends(edges))
    return rows.join(reduce(DataFrame.union, gone), key, "left_anti") if gone else rows


def _settled(edges: DataFrame, key: list[str], held: int) -> tuple[DataFrame, DataFrame]:
    """Keys that lose in the components of at most ``held`` edges, and the edges of the other components.

    Nodes are known by a hash while components are sought: two keys of one hash
    only join their components. In order of the later node, the earlier one of an
    edge is always decided before.
    """
    ka, kb = [f"{k}_a" for k in key], [f"{k}_b" for k in key]
    hashed = edges.select("*", F.xxhash64(*ka).alias("__src"), F.xxhash64(*kb).alias("__dst"))
    label = components(hashed, "__src", "__dst")
    placed = hashed.join(label, hashed["__src"] == label["node"], "left").select(*edges.columns, F.coalesce("component", "__src").alias("__component"))
    placed = cut(placed)
    sizes = placed.groupBy("__component").agg((F.count("*") <= held).alias("__fits"))
    placed = cut(placed.join(sizes, "__component"))
    n = len(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, lost = None, set()
        for batch in batches:
            out = []
            for c, *pair in batch.itertuples(index=False, name=None):
                if c != component:
                    component, lost = c, set()
                a, b = tuple(pair[:n]), tuple(pair[n:])
                if a not in lost and b not in lost:
                    lost.add(b)
                    out.append(b)
            yield pd.DataFrame(out, columns=key)

    schema = ", ".join(f"`{k}` {edges.schema[f'{k}_b'].dataType.simpleString()}" for k in key)
    dealt = placed.where("__fits").repartition("__component").sortWithinPartitions("__component", "rank_b").select("__component", *ka, *kb)
    return cut(dealt.mapInPandas(run, schema)), placed.where("not __fits").select(*edges.columns)


def per_page(df: DataFrame, work: Callable[[list], Iterator[tuple]], schema: str, key: str = "page_id") -> DataFrame:
    """Order-dependent work on the rows of one page at a time, ordered by idx.

    Pages are dealt out and sorted by Spark; ``work`` gets the rows of a page as
    named tuples and gives tuples of ``schema``. A task goes through its pages
    one after the other, across Arrow batches, so small pages cost no call each
    and a page is all that is held.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page: list = []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                if page and getattr(page[0], key) != getattr(row, key):
                    out += work(page)
                    page = []
                page.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
        if page and (out := list(work(page))):
            yield pd.DataFrame(out, columns=names)

    return df.repartition(key).sortWithinPartitions(key, "idx").mapInPandas(run, schema)


class _Sets:
    """Disjoint sets over the rows of a page."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def components_capped(pages: DataFrame, cap: float = 1.6) -> DataFrame:
    """(page_id, idx, size, new_size): pairs joined in order unless sizes of the cluster would differ by more than ``cap``.

    ``pages``: page_id, idx, size, partners (array of later idx). The members of
    a cluster take its smallest size.
    """

    def work(page: list) -> Iterator[tuple]:
        at = {r.idx: n for n, r in enumerate(page)}
        sets, low, high = _Sets(len(page)), [r.size for r in page], [r.size for r in page]
        for i, r in enumerate(page):
            for j in sorted(at[p] for p in (r.partners if r.partners is not None else ()) if p in at):
                a, b = sorted((sets.find(i), sets.find(j)))
                lo, hi = min(low[a], low[b]), max(high[a], high[b])
                if a != b and hi <= cap * lo:
                    sets.up[b] = a
                    low[a], high[a] = lo, hi
        for i, r in enumerate(page):
            yield r.page_id, r.idx, r.size, low[sets.find(i)]

    return per_page(pages.select("page_id", "idx", F.col("size").cast("double").alias("size"), "partners"), work, "page_id long, idx long, size double, new_size double")


def greedy_colour(pages: DataFrame, palette: int = 8) -> DataFrame:
    """(page_id, idx, colour): by degree, then top and left, the first colour that no overlapping box has.

    ``pages``: page_id, idx, x1, y1, conflicts (array of idx). Colours from
    ``palette`` on are made up as needed.
    """

    def work(page: list) -> Iterator[tuple]:
        near = {r.idx: set(r.conflicts if r.conflicts is not None else ()) for r in page}
        colour: dict[int, int] = {}
        for r in sorted(page, key=lambda r: (-len(near[r.idx]), r.y1, r.x1, r.idx)):
            used = {colour[n] for n in near[r.idx] if n in colour}
            colour[r.idx] = next(c for c in range(palette + len(used) + 1) if c not in used)
        for r in page:
            yield r.page_id, r.idx, colour[r.idx]

    return per_page(pages.select("page_id", "idx", "x1", "y1", "conflicts"), work, "page_id long, idx long, colour int")


def fuzzy_group(pages: DataFrame, colour_tolerance: int = 25, height_ratio: float = 1.25) -> DataFrame:
    """(page_id, idx, seed): each box joins the first earlier seed that is like it, else is one.

    Alike: same length class and script flag, all colour channels within the
    tolerance, heights within the ratio of the seed's.
    ``pages``: page_id, idx, bucket, cjk, r, g, b, height.
    """

    step = colour_tolerance + 1
    near = list(product((-1, 0, 1), repeat=3))

    def work(page: list) -> Iterator[tuple]:
        seeds: dict[tuple, list] = {}  # by class, script and cell of colour: (place, row)
        for place, r in enumerate(page):
            cell = (r.r // step, r.g // step, r.b // step)
            like = [
                (at, s)
                for d in near
                for at, s in seeds.get((r.bucket, r.cjk, cell[0] + d[0], cell[1] + d[1], cell[2] + d[2]), ())
                if max(abs(s.r - r.r), abs(s.g - r.g), abs(s.b - r.b)) <= colour_tolerance and max(s.height, r.height) <= height_ratio * min(s.height, r.height)
            ]
            if not like:
                seeds.setdefault((r.bucket, r.cjk, *cell), []).append((place, r))
            yield r.page_id, r.idx, min(like, key=lambda x: x[0])[1].idx if like else r.idx

    return per_page(pages.select("page_id", "idx", "bucket", "cjk", "r", "g", "b", "height"), work, "page_id long, idx long, seed long")


def propagate_confident(rows: DataFrame, key: list[str], value: str, conf: str = "confidence", least: float = 0.60) -> DataFrame:
    """Unsure members take the value most sure members of their group have; of equals the first seen."""
    sure = rows.where(F.col(conf) >= least).groupBy(*key, value).agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    mode = sure.groupBy(*key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("__mode"))
    return rows.join(mode, key, "left").withColumn(value, F.when(F.col(conf) >= least, F.col(value)).otherwise(F.coalesce("__mode", F.col(value)))).drop("__mode")


def majority(rows: DataFrame, key: list[str], flag: str) -> DataFrame:
    """A flag that at least half of a group has, on every row."""
    vote = rows.groupBy(*key).agg((F.count_if(F.col(flag)) * 2 >= F.count("*")).alias("__vote"))
    return rows.join(vote, key).withColumn(flag, F.col("__vote")).drop("__vote")


def table_accept(candidates: DataFrame, cells: DataFrame, score: float = 0.5, filled: float = 0.5) -> DataFrame:
    """Candidates with a finite score of ``score``, two rows and columns, and cells that span enough of the grid.

    ``cells``: page_id, table_id, rowspan, colspan.
    """
    area = cells.groupBy("page_id", "table_id").agg(F.sum(F.col("rowspan") * F.col("colspan")).alias("spanned"))
    good = ~F.isnan("score") & (F.abs("score") != float("inf")) & (F.col("score") >= score) & (F.col("rows") >= 2) & (F.col("cols") >= 2)
    return candidates.where(good).join(area, ["page_id", "table_id"]).where(F.col("spanned") / (F.col("rows") * F.col("cols")) >= filled)


def grid_metrics(samples: DataFrame, key: list[str], index: str = "i", value: str = "v", count: str = "n", step: int = 5) -> DataFrame:
    """Boundaries of a grid: (key, bounds). Upper medians of the samples of each index; gaps are interpolated, then each is at least ``step`` beyond the one before.

    ``count``: the number of boundaries of the key, on every row.
    """
    upper = F.element_at(F.array_sort(F.collect_list(value)), (F.floor(F.count(value) / 2) + 1).cast("int"))
    each = samples.groupBy(*key, count, index).agg(upper.cast("double").alias("m"))
    one = each.groupBy(*key, count).agg(F.array_sort(F.collect_list(F.struct(index, "m"))).alias("known"))

    def at(i):
        exact = F.filter("known", lambda k: k[index] == i)
        low, high = F.filter("known", lambda k: k[index] < i), F.filter("known", lambda k: k[index] > i)
        a, b = F.element_at(low, -1), F.get(high, F.lit(0))
        between = a["m"] + (b["m"] - a["m"]) * (i - a[index]) / (b[index] - a[index])
        return F.when(F.size(exact) > 0, F.get(exact, F.lit(0))["m"]).when(F.size(low) == 0, b["m"]).when(F.size(high) == 0, a["m"]).otherwise(between)

    bounds = F.transform(F.sequence(F.lit(0), F.col(count).cast("int") - 1), at)
    rising = F.aggregate(bounds, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(F.greatest(x, F.element_at(acc, -1) + step)))))
    return one.select(*key, rising.alias("bounds"))
