"""Quality classifier by co-training of two views of a document.

One view reads the text (its words, letters, marks, words said again), the
other the page's metadata (source, language, length, layout). Each is a naive
Bayes model over bins: surface features and hashed words for the text, binned
numbers and names for the metadata. In each round a view labels the unlabelled
documents that it is most confident of, a growing share of them, and the other
view learns from these as from given labels. Labelled documents kept out of the
fit calibrate both views; the calibrated views are added up to one score for
every document.

Counts, pseudo-labels and calibration cover all documents. Partitions sum their
counts before the shuffle; tables of a bounded number of bins (words, steps of
scores, names of a share of the labels) come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.jaccard import token_sets
from quire.llm.schemas import extended
from quire.session import TEXT_ROWS, small, stored

#: Bins of a feature.
BINS = 16
#: Bins of words, by their hash.
WORDS = 1 << 18
#: A name (a source, a language) has a weight of its own if it is on one in so many labelled documents; so there are at most as many.
NAME_SHARE = 10_000
#: Every so many-th labelled document, by hash, calibrates instead of fitting.
HELD_OUT = 4
#: So many pseudo-labels count as much as one given label.
TRUST = 4
#: Steps a unit of log odds, in the tables of calibration and of confidence.
STEPS = 2

SURFACE = ["upper", "exclaim", "symbols", "digits", "marks", "stops", "distinct", "twice", "same_lines", "word_length", "other"]
LAYOUT = ["length", "lines", "line_length"]
NAMES = ["lang", "source"]
_MARKS = np.zeros(256, bool)
_MARKS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _share(part: float, whole: float) -> int:
    """Bin of a share, finer near 0: 0, up to 1/256, 1/128, ..., 1."""
    if not part or not whole:
        return 0
    return min(BINS - 1, max(1, 2 * 8 + math.ceil(2 * math.log2(part / whole)) - 1))


def _log(x: float) -> int:
    return min(BINS - 1, int(math.log2(x + 1)))


def text_bins(text: str) -> list[int]:
    """The surface features of one text; an empty one is 0 throughout."""
    words, lines, low = text.split(), text.split("\n"), text.lower()
    code = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256) if text else np.zeros(256, int)
    if len(low) == len(text):
        upper = int((np.frombuffer(text.encode("utf-32-le"), np.uint32) != np.frombuffer(low.encode("utf-32-le"), np.uint32)).sum())
    else:
        upper = sum(map(str.isupper, text))
    n, k = len(text), len(words)
    full = [x for x in lines if x]
    return [
        _share(upper, n),
        _share(code[33], n),
        _share(sum(code[list(b"#*$%&|<>")]), n),
        _share(code[48:58].sum(), n),
        _share(code[_MARKS].sum(), n),
        _share(code[46], k),
        min(BINS - 1, int(BINS * len(set(words)) / k)) if k else 0,
        _share(sum(map(eq, words, words[1:])), k),
        _share(len(full) - len(set(full)), len(full)),
        min(BINS - 1, int(sum(map(len, words)) / k)) if k else 0,
        _share(code[128:].sum(), n),
    ]


def _names(docs: DataFrame, given: DataFrame, column: str) -> dict:
    """{name: its bin}, of the names on a share of the labelled documents; all others are bin 0."""
    counts = docs.select("doc_id", F.col(column).alias("name")).join(small(given), "doc_id").groupBy("name").agg(F.count("*").alias("n"))
    counts = stored(counts)
    total = counts.agg(F.sum("n")).first()[0] or 0
    held = sorted((r["name"] for r in counts.where(F.col("n") * NAME_SHARE >= total).collect()), key=lambda x: (x is None, x or ""))
    return {name: i + 1 for i, name in enumerate(held)}


class Views:
    """The places of bins in each view's table of weights."""

    def __init__(self, names: dict[str, dict]):
        self.names = names
        self.text_at = [i * BINS for i in range(len(SURFACE) + 1)]
        widths = [BINS] * len(LAYOUT) + [len(names[n]) + 1 for n in NAMES]
        self.meta_at = np.cumsum([0, *widths]).tolist()
        self.width = {"text_view": self.text_at[-1] + WORDS, "meta_view": self.meta_at[-1]}
        #: bins that exclude each other, as (first, number of bins); words are single
        self.features = {"text_view": [(at, BINS) for at in self.text_at[:-1]], "meta_view": list(zip(self.meta_at, widths, strict=False))}

    def text(self, text: str, words: np.ndarray) -> np.ndarray:
        surface = np.array(text_bins(text), np.int32) + np.array(self.text_at[:-1], np.int32)
        return np.concatenate([surface, (np.unique(words & (WORDS - 1)) + self.text_at[-1]).astype(np.int32)])

    def meta(self, n: int | None, lines: int, names: list) -> list[int]:
        n = max(n or 0, 0)
        bins = [_log(n), _log(lines), _log(n / lines if lines else 0), *(self.names[k].get(x, 0) for k, x in zip(NAMES, names, strict=True))]
        return [x + y for x, y in zip(bins, self.meta_at, strict=False)]


def _few_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, ``TEXT_ROWS`` rows at a time, as what is made of a batch takes several times its memory."""
    for batch in batches:
        for at in range(0, len(batch), TEXT_ROWS):
            yield batch.slice(at, TEXT_ROWS)


def _binned(rows: DataFrame, views: Views, first: list[str]) -> DataFrame:
    """``first`` and ``(text_view, meta_view)``: the places of a document's bins; the surface comes before the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _few_rows(batches):
            texts, n, *names = (part.column(i) for i in range(len(first), len(first) + 2 + len(NAMES)))
            a, b = [], []
            for t, words, size, *own in zip(texts, token_sets(texts, 1), n.to_pylist(), *(x.to_pylist() for x in names), strict=True):
                t = t.as_py() or ""
                a.append(views.text(t, words))
                b.append(views.meta(size, t.count("\n") + 1 if t else 0, own))
            ends = np.cumsum([0, *map(len, a)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(first)], pa.ListArray.from_arrays(ends, np.concatenate(a)), pa.array(b, pa.list_(pa.int32()))], [*first, "text_view", "meta_view"])

    return rows.mapInArrow(run, extended(rows.select(*first), "text_view array<int>, meta_view array<int>"))


def _scores(column: pa.ListArray, weights: np.ndarray, surface: int) -> np.ndarray:
    """Bias, the sum of the first ``surface`` bins' weights, and the mean of the others', in steps."""
    ends = np.asarray(column.offsets)
    total = np.concatenate(([0.0], np.cumsum(weights[1:][np.asarray(column.values)[ends[0] : ends[-1]]])))
    ends = ends - ends[0]
    split = np.minimum(ends[:-1] + surface, ends[1:])
    rest = (total[ends[1:]] - total[split]) / np.maximum(ends[1:] - split, 1)
    return np.rint(STEPS * (weights[0] + total[split] - total[ends[:-1]] + rest)).astype(np.int64)


_PARTS = {"text_view": len(SURFACE), "meta_view": len(LAYOUT) + len(NAMES)}


def _steps(batch: pa.RecordBatch, weights: dict) -> dict[str, np.ndarray]:
    return {v: _scores(batch.column(batch.schema.get_field_index(v)), weights[v], _PARTS[v]) for v in _PARTS}


def _count(weights: dict | None, taught: dict, width: dict):
    """Counts (view, bin, good, n) of a partition, bin -1 for the documents; unlabelled ones as the other view labels them.

    A given label counts ``TRUST``, one of the other view 1.
    """

    def labels(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        state, h = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("state", "h"))
        steps = _steps(batch, weights) if weights else None
        out = {}
        for view, other in zip(_PARTS, reversed(_PARTS)):  # noqa: B905
            label = np.where(state <= 1, state, -1)
            if steps:
                for good, (cut, part) in taught[other].items():
                    ahead = (steps[other] - cut) * (1 if good else -1)
                    label[(state == 3) & ((ahead > 0) | (ahead == 0) & (h < part))] = 2 + good
            out[view] = label
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {v: np.zeros((2, width[v] + 1), np.int64) for v in _PARTS}
        for batch in _few_rows(batches):
            for view, label in labels(batch).items():
                column = batch.column(batch.schema.get_field_index(view))
                ends = np.asarray(column.offsets)
                each = np.repeat(label, np.diff(ends))
                bins = np.asarray(column.values)[ends[0] : ends[-1]]
                for kind in (0, 1, 2, 3):  # bad and good, given ones first
                    times = TRUST if kind < 2 else 1
                    sums[view][kind % 2, 1:] += times * np.bincount(bins[each == kind], minlength=width[view])
                    sums[view][kind % 2, 0] += times * (label == kind).sum()
        for i, view in enumerate(_PARTS):
            bad, good = sums[view]
            at = np.flatnonzero(bad + good)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array((at - 1).astype(np.int32)), pa.array(good[at]), pa.array((bad + good)[at])], ["view", "bin", "good", "n"])

    return run


def _tally(weights: dict):
    """Steps of each document in both views: (state, text, meta)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            steps = _steps(batch, weights)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("state")), *(pa.array(steps[v]) for v in _PARTS)], ["state", *_PARTS])

    return run


def _fit(good: np.ndarray, n: np.ndarray, features: list[tuple[int, int]]) -> np.ndarray:
    """Log odds: [bias, one weight a bin], smoothed by one document a bin; place 0 of the counts holds the documents."""
    g, b = good[0], n[0] - good[0]
    width = np.full(len(n) - 1, 2.0)  # a word is there or not
    for at, size in features:
        width[at : at + size] = size
    weights = np.log((good[1:] + 1) / (g + width)) - np.log((n[1:] - good[1:] + 1) / (b + width))
    return np.concatenate(([math.log((g + 1) / (b + 1))], weights))


def _isotonic(table: dict[int, tuple[float, float]]) -> tuple[list[int], list[float]]:
    """Steps and chances to be good, non-decreasing (pool adjacent violators); between the pools they rise in a line."""
    pools: list[list] = []
    for step in sorted(table):
        g, n = table[step]
        pools.append([g, n, step, step])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g, n, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + g, pools[-1][1] + n, pools[-1][2], last]
    ends = [(step, (g + 0.5) / (n + 1)) for g, n, first, last in pools for step in (first, last)] or [(0, 0.5)]
    return [x for x, _ in ends], np.maximum.accumulate([y for _, y in ends]).tolist()


def _chance(steps: np.ndarray, table: tuple[list[int], list[float]]) -> np.ndarray:
    return np.interp(steps, table[0], table[1])


def _confident(counts: dict[int, int], chance: tuple, good: int, quota: float, sure: float) -> tuple[int, float, float]:
    """The ``quota`` most confident unlabelled documents of a class: (the last step, its share, how many)."""
    taken, cut, part = 0.0, (1 << 40) * (1 if good else -1), 0.0
    for step in sorted(counts, reverse=bool(good)):
        p = float(_chance(np.array([step]), chance)[0])
        if taken >= quota or (p if good else 1 - p) < sure:
            break
        part = min(1.0, (quota - taken) / counts[step])
        taken, cut = taken + part * counts[step], step
    return cut, part, taken


def quality_classifier(
    docs: DataFrame,
    labels: DataFrame,
    rounds: int = 3,
    grow: float = 0.02,
    sure: float = 0.8,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    label_col: str = "quality",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    length_col: str = "n_chars",
    row_col: str | None = None,
    report: list | None = None,
) -> DataFrame:
    """``(doc_id, text_score, meta_score, score, keep)`` of every document.

    ``labels`` holds ``id_col`` and ``label_col`` (1 good, 0 bad). The scores are
    chances to be good: of each calibrated view, and of both together, with the
    views taken as independent given the label. ``keep`` is score >= threshold.

    In round k each view labels ``k * grow`` of the unlabelled documents for the
    other view, shared out to the classes as the labels are: those it is most
    confident of, and only where its calibrated chance of the class is ``sure``
    or more. ``TRUST`` such labels count like a given one. ``report`` takes a row
    (round, teaching view, class, documents) for each.

    Labels that are null or whose document is missing count for nothing, several
    of one document by majority (ties: good). Without any label the scores are
    0.5. Null texts, names and lengths have bins of their own or count as empty;
    rows that repeat an id are all returned. ``row_col`` names a column that
    comes back with each row's verdict.
    """
    given = stored(labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("good")))
    source = docs.select(F.col(id_col).alias("doc_id"), *([F.col(row_col)] if row_col else []), F.col(text_col).cast("string").alias("__text"), F.col(length_col).cast("long").alias("__n"), F.col(lang_col).cast("string").alias("__lang"), F.col(source_col).cast("string").alias("__source"))
    views = Views({n: _names(source, given, f"__{n}") for n in NAMES})
    # state: 0 bad, 1 good, 2 held out (with its label in ``good``), 3 unlabelled
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    state = F.when(F.col("good").isNull(), 3).when(held, 2).otherwise(F.col("good"))
    h = F.pmod(F.xxhash64("doc_id", "__text"), F.lit(1 << 20)) / float(1 << 20)
    first = ["doc_id", *([row_col] if row_col else []), "state", "good", "h"]
    rows = source.join(small(given), "doc_id", "left").withColumns({"state": state.cast("long"), "good": F.coalesce("good", F.lit(-1)).cast("long"), "h": h})
    rows = stored(_binned(rows.select(*first, "__text", "__n", *[f"__{n}" for n in NAMES]), views, first), batch=TEXT_ROWS)

    weights, taught, chance, prior = None, {}, {}, 0.0
    for k in range(rounds + 1):
        counted = rows.select("state", "h", *_PARTS).mapInArrow(_count(weights, taught, views.width), "view int, bin int, good long, n long")
        sums = counted.groupBy("view", "bin").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).toPandas()
        weights = {}
        for i, view in enumerate(_PARTS):
            mine = sums[sums["view"] == i]
            good, n = (np.zeros(views.width[view] + 1) for _ in range(2))
            good[mine["bin"] + 1], n[mine["bin"] + 1] = mine["good"] / TRUST, mine["n"] / TRUST
            weights[view] = _fit(good, n, views.features[view])
        scored = rows.where("state >= 2").select(F.when(F.col("state") == 2, F.col("good")).otherwise(-1).alias("state"), *_PARTS).mapInArrow(_tally(weights), "state long, text_view long, meta_view long")
        pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("step")) for v in _PARTS])).alias("x")
        table = scored.select("state", pairs).groupBy("x.view", "x.step", "state").agg(F.count("*").alias("n")).collect()
        held_out = [r for r in table if r["state"] >= 0]
        for view in _PARTS:
            steps: dict[int, tuple] = {}
            for r in held_out:
                if r["view"] == view:
                    g, n = steps.get(r["step"], (0, 0))
                    steps[r["step"]] = (g + r["n"] * r["state"], n + r["n"])
            chance[view] = _isotonic(steps)
        n = sum(r["n"] for r in held_out if r["view"] == "text_view")
        good = sum(r["n"] for r in held_out if r["view"] == "text_view" and r["state"])
        prior = math.log((good + 0.5) / (n - good + 0.5))
        for view in _PARTS:
            open_ = {r["step"]: r["n"] for r in table if r["view"] == view and r["state"] < 0}
            share = {1: (good + 0.5) / (n + 1), 0: (n - good + 0.5) / (n + 1)}
            taught[view] = {}
            for label in (0, 1):
                cut, part, many = _confident(open_, chance[view], label, (k + 1) * grow * share[label] * sum(open_.values()), sure)
                taught[view][label] = (cut, part)
                if report is not None and k < rounds:
                    report.append((k + 1, view, label, round(many)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few_rows(batches):
            steps = _steps(batch, weights)
            p = {v: _chance(steps[v], chance[v]) for v in _PARTS}
            both = sum(np.log(x / (1 - x)) for x in p.values()) - prior
            score = 1 / (1 + np.exp(-both))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(p[v]) for v in _PARTS), pa.array(score), pa.array(score >= threshold)], [*kept, "text_score", "meta_score", "score", "keep"])

    kept = [c for c in first if c not in ("state", "good", "h")]
    return rows.select(*kept, *_PARTS).mapInArrow(judge, extended(rows.select(*kept), "text_score double, meta_score double, score double, keep boolean"))
