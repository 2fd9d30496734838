"""Mixing overlapping sources to target weights, as a min-cost flow.

A document may belong to several sources. Documents of the same membership
pattern are alike, so the flow runs between patterns and sources: each pattern
offers its words once for each allowed repetition, at a cost that rises with
every repetition, and each source asks for its quota. Successive shortest paths
route the words. A pattern's flow is then met by its own documents: whole
repetitions of all, and one more of those with the smallest seeded hashes.

Spark aggregates documents to patterns and finds the cut among the hashes; the
flow works on sums by pattern, whose number is bounded and checked.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import stored

#: Membership patterns in all, at most: only their sums are brought to the driver.
MAX_PATTERNS = 100_000
#: Hash buckets of the cut, a level, and levels: 2**36 buckets in the end.
BUCKETS, LEVELS = 4096, 3


def quotas(sizes: dict, weights: dict, total: float, limit: float) -> dict:
    """Shares of ``total`` by weight, none above ``limit`` times the source's size; the excess is shared again."""
    left, fixed = dict(sizes), {}
    while left:
        rest = total - sum(fixed.values())
        whole = sum(weights[s] for s in left)
        over = [s for s in left if rest * weights[s] / whole > limit * left[s]]
        if not over:
            return fixed | {s: rest * weights[s] / whole for s in left}
        for s in over:
            fixed[s] = float(limit * left.pop(s))
    return fixed


def min_cost_flow(offers: dict, members: dict, wanted: dict, repeats: int) -> dict:
    """Words that each pattern gives to each of its sources: {(pattern, source): words}.

    ``offers``: words of each pattern, ``members``: its sources, ``wanted``: words
    of each source. The k-th repetition of a word costs k - 1. As much as possible
    is routed, and the cheapest way is taken; ties go to the first in order.
    """
    need = dict(wanted)
    flow: dict = {}
    holders: dict = {}
    for p, ss in members.items():
        for s in ss:
            holders.setdefault(s, []).append(p)
    # Costs lie on the repetitions of patterns alone: so for each k in turn, route what
    # repetition k can give. Each phase levels the nodes once, and then blocks all shortest
    # ways, which may move earlier flow between sources; phases are few.
    for _ in range(repeats):
        room = dict(offers)
        while _levelled_flow(room, need, members, holders, flow):
            pass
    return {k: v for k, v in flow.items() if v > 0}


def _levelled_flow(room: dict, need: dict, members: dict, holders: dict, flow: dict) -> int:
    """One phase: words routed along all shortest ways from patterns with room to sources in need."""
    level = {("p", p): 0 for p, n in room.items() if n > 0}
    queue, deepest = deque(level), None
    while queue:
        kind, x = node = queue.popleft()
        if deepest is not None and level[node] >= deepest:
            break
        for y in members[x] if kind == "p" else holders[x]:
            other = ("s" if kind == "p" else "p", y)
            if other not in level and (kind == "p" or flow.get((y, x), 0) > 0):
                level[other] = level[node] + 1
                queue.append(other)
                if kind == "p" and need[y] > 0 and deepest is None:
                    deepest = level[other]
    if deepest is None:
        return 0
    routed, onward = 0, {}
    for start in [p for p, n in room.items() if n > 0]:
        while room[start] > 0:
            path = [("p", start)]
            while path and not (path[-1][0] == "s" and need[path[-1][1]] > 0):
                kind, x = node = path[-1]
                ways, i = members[x] if kind == "p" else holders[x], onward.get(node, 0)
                while i < len(ways):
                    other = ("s" if kind == "p" else "p", ways[i])
                    if level.get(other) == level[node] + 1 <= deepest and (kind == "p" or flow.get((ways[i], x), 0) > 0):
                        break
                    i += 1
                onward[node] = i
                if i < len(ways):
                    path.append(other)
                    continue
                path.pop()
                if path:  # a dead end: its neighbour needn't look there again
                    onward[path[-1]] += 1
            if not path:
                break
            amount = min(room[start], need[path[-1][1]], *[flow[b, a] for (kind, a), (_, b) in zip(path, path[1:]) if kind == "s"])  # noqa: B905
            for (kind, a), (_, b) in zip(path, path[1:]):  # noqa: B905
                key = (a, b) if kind == "p" else (b, a)
                flow[key] = flow.get(key, 0) + (amount if kind == "p" else -amount)
            room[start] -= amount
            need[path[-1][1]] -= amount
            routed += amount
    return routed


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _bucket(level: int) -> Column:
    """The level's digit of the document's hash, from 0 to BUCKETS - 1."""
    return F.shiftrightunsigned(F.col("__hash"), 64 - 12 * (level + 1)).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _cuts(docs: DataFrame, want: dict) -> dict:
    """{pattern: edge}: the hash prefix, as a number, below which a pattern's documents are taken.

    ``want`` gives words by pattern. Level by level the digit is found at which
    the sum passes the wanted words; only that bucket is looked at in the next.
    """
    found = {p: ([], n) for p, n in want.items()}
    upto = Window.partitionBy("pattern").orderBy("bucket")
    for level in range(LEVELS if want else 0):
        inside = docs.sparkSession.createDataFrame([(p, d, n) for p, (d, n) in found.items()], "pattern string, digits array<int>, wanted long")
        digits = F.array(*[_bucket(i) for i in range(level)]).cast("array<int>")
        here = docs.join(F.broadcast(inside), "pattern").where(digits == F.col("digits")).groupBy("pattern", "wanted", _bucket(level).alias("bucket")).agg(F.sum("size").alias("words"))
        cut = here.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") > F.col("wanted"))
        cut = cut.groupBy("pattern").agg(F.min(F.struct("bucket", "words", (F.col("wanted") - F.col("upto") + F.col("words")).alias("left"))).alias("cut")).collect()  # a row a pattern
        at = {r["pattern"]: r["cut"] for r in cut}
        found = {p: ([*d, at[p]["bucket"]], at[p]["left"]) if p in at else ([*d, BUCKETS - 1], 0) for p, (d, n) in found.items()}
    # the last bucket holds one document as a rule: it goes in if that comes nearer
    nearer = {p for p in found if p in at and at[p]["words"] < 2 * at[p]["left"]} if found else set()
    edges = {}
    for p, (digits, _) in found.items():
        edges[p] = sum(d * BUCKETS ** (LEVELS - 1 - i) for i, d in enumerate(digits)) + (p in nearer)
    return edges


def mix_sources(docs: DataFrame, weights: dict | None = None, share: float = 1.5, repeats: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "source", cycle: tuple = (5, 2, 1)) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``.

    ``sources_col`` is a source name or an array of names. Sources get ``weights``,
    or else those of ``cycle`` in turn, by code point, null last; they share
    ``share`` times all words, but none gets more than ``repeats`` times its own.
    ``size`` counts a text's words (null: 0), ``source_size`` and ``target`` belong
    to the document's source (to its sources together, for an array), and
    ``copies`` (0 to ``repeats``) says how often the mix takes the document.

    The choice depends on the seed, the id and the text only, so reruns agree
    and rows that repeat id and text share their fate. Texts without words are
    never taken. Null and empty source lists are the source null. Columns of the
    four names are replaced; all others stay. An empty table gives no rows.
    """
    names = ("size", "source_size", "target", "copies")
    keep = [c for c in docs.columns if c not in names]
    several = dict(docs.dtypes)[sources_col].startswith("array")
    pattern = F.when(F.size(sources_col) > 0, F.array_sort(F.array_distinct(sources_col))) if several else F.when(F.col(sources_col).isNotNull(), F.array(sources_col))
    pattern = F.to_json(F.struct(pattern.alias("s")))
    sized = docs.select(*keep).withColumns({"size": word_count(F.col(text_col)), "pattern": pattern, "__hash": F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))})
    narrow = stored(sized.select("pattern", "size", "__hash"))

    sums = narrow.groupBy("pattern").agg(F.sum("size").alias("words"))
    listed = sums.select("pattern", "words", F.from_json("pattern", "s array<string>")["s"].alias("sources")).limit(MAX_PATTERNS + 1).collect()
    if len(listed) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    offers = {r["pattern"]: r["words"] for r in sorted(listed, key=lambda r: r["pattern"])}
    members = {r["pattern"]: list(r["sources"] or [None]) for r in listed}
    sizes: dict = {}
    for p, ss in members.items():
        for s in ss:
            sizes[s] = sizes.get(s, 0) + offers[p]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = weights or {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    target = quotas({s: sizes[s] for s in order}, weights, share * sum(offers.values()), repeats)
    flow = min_cost_flow(offers, members, {s: int(target[s]) for s in order}, repeats)

    taken = {p: 0 for p in offers}
    for (p, _), n in flow.items():
        taken[p] += n
    base = {p: min(taken[p] // n, repeats) if n else 0 for p, n in offers.items()}
    cuts = _cuts(narrow, {p: taken[p] - base[p] * offers[p] for p in offers if offers[p] and base[p] < repeats})
    rows = []
    for p in offers:
        rows.append((p, sum(sizes[s] for s in members[p]), float(sum(target[s] for s in members[p])), base[p], cuts.get(p, 0)))
    plan = F.broadcast(docs.sparkSession.createDataFrame(rows, "pattern string, source_size long, target double, base int, edge long"))
    digit = F.shiftrightunsigned(F.col("__hash"), 64 - 12 * LEVELS)
    more = (digit < F.col("edge")).cast("int")
    copies = F.when(F.col("size") > 0, F.col("base") + more).otherwise(0)
    return sized.join(plan, "pattern").select(*keep, "size", "source_size", "target", copies.alias("copies"))
