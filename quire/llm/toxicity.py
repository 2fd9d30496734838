"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

Each class (toxic, ordinary) has a model of the next character in a word, given
the ``order - 1`` before it, and backs off to a Kneser-Ney model of both classes
together. From a class's count of a window (a character and its context) goes a
discount: Kneser-Ney's own, what the shared model leads to expect, and ``sure``
standard deviations of that (texts as the units of chance, not words); what is left is the class's own, all else is smoothed
by the shared model. So expressions that are rare, or about as frequent in both
classes, say nothing for either. The ratio of the two likelihoods of a place
depends only on its window: one value where a class has something of its own, and
one for its context otherwise. A document's log ratio is the sum of these values
over its distinct words, divided by the root of their number (so that documents of
any length vary alike by chance); a rising curve, fitted on labelled documents
scored by models that haven't read them, makes it a score. A text counts each of
its words once, and of near copies (texts with a common least hash of their
shingles) one counts, so that neither a word said over and over nor a text of many
copies speaks for its class alone. A text counts each of its words once, so that neither a word said
over and over nor a long text speaks for its class alone.

Counts come from all labelled texts, and are summed in partitions before the
shuffle. Windows of which no class has anything of its own add nothing and are left
out. The others go to the tasks as one sorted table if it has at most
``model_rows`` rows, counted first; beyond that, documents and values meet in a
join by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.quality_classifier import _chance, _isotonic
from quire.llm.schemas import extended
from quire.session import TEXT_ROWS, dropped, small, stored

#: Words are what stands between these, after lower-casing.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The length of the longest window, the next character included.
ORDER = 6
#: Rows of a model that still goes to every task (some 20 bytes each).
MODEL_ROWS = 3_000_000
#: Labelled documents are split in so many parts by their id; see ``toxicity``.
PARTS = 3
#: Symbols before and behind a word; no character has such a code.
FIRST, LAST = 0x110000, 0x110001
#: The fitted labels are split in so many folds, by id; each is scored by a model of the others.
FOLDS = 4
#: The versions of the model: of all fitted labels, and without one fold.
VERSIONS = ["a", *(f"w{k}" for k in range(FOLDS))]
#: Bytes of text taken apart at once; the windows of their words take some thirty times that.
BLOCK = 4 << 20
_BASE, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _key(sums: np.ndarray, length: int, context: bool = False) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(sums + np.uint64(2 * length + context) * _SEED).view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that column ``text`` has ``BLOCK`` bytes at most, or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < len(size):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + BLOCK, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a batch, each place's word, and the document of each place."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), GAPS)
    words, row = pc.list_flatten(split), pc.list_parent_indices(split)
    full = pc.greater(pc.binary_length(words), 0)
    words, row = words.filter(full).dictionary_encode(), row.filter(full)
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False), row.to_numpy(zero_copy_only=False)


def _once(codes: np.ndarray, row: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word of a document once."""
    row, codes = np.divmod(np.unique(row.astype(np.int64) * words + codes), max(words, 1))
    return codes, row


class Windows:
    """All windows of a list of words, side by side: each place but a word's first symbol ends one."""

    def __init__(self, words: pa.Array, order: int) -> None:
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        ends = np.cumsum(size)
        self.starts, total = ends - size, int(ends[-1]) if len(ends) else 0
        symbols = np.full(total, FIRST, np.uint64)
        symbols[ends - 1] = LAST
        inner = np.ones(total, bool)
        inner[self.starts] = inner[ends - 1] = False
        symbols[inner] = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        self.word = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(total) - self.starts[self.word]
        self.order, self.sums = order, [np.zeros(total, np.uint64)]
        with np.errstate(over="ignore"):
            power = np.uint64(1)
            for m in range(1, order + 1):
                power *= _BASE
                before = np.zeros(total, np.uint64)
                before[m - 1 :] = symbols[: total - m + 1] * power if m > 1 else symbols * power
                self.sums.append(self.sums[-1] + before)

    def ending(self) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(length, opens its word, places) of the longest windows."""
        for m in range(2, self.order + 1):
            yield m, True, np.flatnonzero(self.place == m - 1)
        yield self.order, False, np.flatnonzero(self.place >= self.order)

    def keys(self, length: int, at: np.ndarray, context: bool = False) -> np.ndarray:
        """Keys of the windows of a length that end at ``at``, or of their contexts."""
        return _key(self.sums[length - context][at - context], length - context, context)


_TAUGHT = [f"{c}{k}" for c in "to" for k in range(FOLDS)]
_SUMS = [*_TAUGHT, "squares"]
_GRAMS = "size int, opens boolean, gram long, tail long, head long, " + ", ".join(f"{c} long" for c in _SUMS)


def _expanded(codes: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``codes`` the places of its word, where ``word`` (rising) has the word of each place: (number in codes, place)."""
    size = np.bincount(word, minlength=words)
    first = np.cumsum(size) - size
    many = size[codes]
    ends = np.cumsum(many)
    return np.repeat(np.arange(len(codes)), many), np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[codes] - ends + many, many)


def _count(order: int) -> Callable:
    """Batches (text, kind) to the windows of all orders, how often each kind (place in ``_TAUGHT``) has them, and the sum of the squares of how often each text has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, 0):
            words, codes, row = _words(batch.column(0))
            if not len(words):
                continue
            codes, row = _once(codes, row, len(words))
            kind = batch.column(1).to_numpy(zero_copy_only=False)[row]
            times = np.bincount(codes * len(_TAUGHT) + kind, minlength=len(_TAUGHT) * len(words)).reshape(-1, len(_TAUGHT))
            w = Windows(words, order)

            def rows(m: int, opens: bool, at: np.ndarray, counted: bool) -> pa.RecordBatch:
                gram, first, back = np.unique(w.keys(m, at), return_index=True, return_inverse=True)
                n = np.zeros((len(_SUMS), len(gram)), np.int64)
                if counted:
                    for k in range(len(_TAUGHT)):
                        n[k] = np.bincount(back, times[w.word[at], k], len(gram))
                    of, place = _expanded(codes, w.word[at], len(words))
                    pairs, many = np.unique(row[of] * len(gram) + back[place], return_counts=True)
                    n[-1] = np.bincount(pairs % max(len(gram), 1), many.astype(np.float64) ** 2, len(gram))
                one = at[first]
                fixed = [pa.array(np.full(len(gram), m, np.int32)), pa.array(np.full(len(gram), opens))]
                keys = [pa.array(x) for x in (gram, w.keys(m - 1, one), w.keys(m, one, context=True))]
                return pa.RecordBatch.from_arrays([*fixed, *keys, *map(pa.array, n)], ["size", "opens", "gram", "tail", "head", *_SUMS])

            for m, opens, at in w.ending():
                yield rows(m, opens, at, True)
            for m in range(1, order):
                yield rows(m, False, np.flatnonzero(w.place >= m), False)

    return run


#: Least hashes of a text's shingles of five words; texts of a class that share one teach once.
SKETCH, SHINGLE = 8, 5


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, toxic, hash, text): the text becomes the least hashes of its shingles (of all its words, if they are fewer)."""
    for batch in _blocks(batches, 3):
        words, codes, row = _words(batch.column(3))
        out = np.zeros((SKETCH, batch.num_rows), np.int64)
        if len(words):
            hashed = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)[codes]
            with np.errstate(over="ignore"):
                rolled, power = np.zeros(len(hashed), np.uint64), np.uint64(1)
                for k in range(SHINGLE):
                    power *= _BASE
                    there = row[: len(row) - k] == row[k:]
                    rolled[: len(row) - k] += np.where(there, hashed[k:] * power, 0).astype(np.uint64)
                first = np.flatnonzero(np.diff(row, prepend=-1))
                whole = np.append(row[: 1 - SHINGLE] == row[SHINGLE - 1 :], np.zeros(min(SHINGLE - 1, len(row)), bool)) if len(row) >= SHINGLE else np.zeros(len(row), bool)
                whole[first] = True
                for k in range(SKETCH):
                    least = np.minimum.reduceat(np.where(whole, _mixed(rolled ^ (np.uint64(k + 1) * _SEED)), ~np.uint64(0)), first)
                    out[k, row[first]] = least.view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, out)], [*batch.schema.names[:3], *(f"m{k}" for k in range(SKETCH))])


def _apart(labelled: DataFrame) -> DataFrame:
    """One text (doc_id, toxic, hash) of each lot of near copies in a class: a smallest id for each least hash, hash after hash."""
    names = [f"m{k}" for k in range(SKETCH)]
    rows = labelled.select("doc_id", "toxic", "hash", "text").mapInArrow(_sketch, extended(labelled.select("doc_id", "toxic", "hash"), ", ".join(f"{m} long" for m in names)))
    for m in names:
        rows = rows.groupBy("toxic", m).agg(F.min(F.struct("doc_id", "hash", *(x for x in names if x != m))).alias("x")).select("toxic", m, "x.*")
    return stored(rows.select("doc_id", "toxic", "hash"), batch=TEXT_ROWS)


def _discount(ones: Column, twos: Column) -> Column:
    """Kneser-Ney's discount from how many grams were seen once and twice; between 0.1 and 0.95."""
    return F.least(F.greatest(F.coalesce(F.try_divide(ones, ones + 2 * twos), F.lit(0.75)), F.lit(0.1)), F.lit(0.95))


def _seen(times: Column, exactly: int) -> Column:
    return F.count_if(times == exactly).cast("double")


def _shared(grams: DataFrame, order: int) -> DataFrame:
    """The longest windows with the chance ``p`` that the model of both classes gives their last character.

    Shorter ones count by how many characters stand before them somewhere, not by how often they occur.
    """
    level = None
    for m in range(1, order + 1):
        mine = grams.where(F.col("size") == m)
        if m < order:
            before = grams.where(F.col("size") == m + 1).groupBy(F.col("tail").alias("gram")).agg(F.count("*").alias("before"))
            mine = mine.join(before, "gram", "left").withColumn("times", F.when(F.col("opens"), F.expr("+".join(_TAUGHT))).otherwise(F.coalesce("before", F.lit(0)))).drop("before")
        else:
            mine = mine.withColumn("times", F.expr("+".join(_TAUGHT)))
        cuts = mine.groupBy("opens").agg(_discount(_seen(F.col("times"), 1), _seen(F.col("times"), 2)).alias("cut"))
        heads = mine.groupBy("opens", "head").agg(F.sum("times").alias("all"), F.count("*").alias("kinds"))
        mine = mine.join(heads, ["opens", "head"]).join(F.broadcast(cuts), "opens")  # two rows
        if m == 1:
            mine = mine.withColumn("lower", 1 / (F.col("kinds") + 1.0))
        else:
            mine = mine.join(level.select(F.col("gram").alias("tail"), F.col("p").alias("lower")), "tail")
        p = (F.greatest(F.col("times") - F.col("cut"), F.lit(0.0)) + F.col("cut") * F.col("kinds") * F.col("lower")) / F.col("all")
        mine = stored(mine.select("gram", "head", "opens", *_SUMS, p.alias("p")))
        found = mine.where("opens") if m < order else mine
        windows = found if level is None else windows.unionByName(found)
        level = mine.where("not opens")
    return windows


def _model(taught: DataFrame, order: int, sure: float) -> DataFrame:
    """``(key, a, x, y)``: what a window, and a context whose window is unknown, add to the log ratio of a document."""
    counted = taught.select("text", "kind").mapInArrow(_count(order), _GRAMS)
    grams = stored(counted.groupBy("size", "opens", "gram", "tail", "head").agg(*[F.sum(c).alias(c) for c in _SUMS]), batch=TEXT_ROWS)
    windows = _shared(grams, order)
    counts = {c + v: F.expr(" + ".join(f"{c}{k}" for k in range(FOLDS) if v != f"w{k}")) for c in "to" for v in VERSIONS}
    cuts = windows.agg(*[_discount(_seen(n, 1), _seen(n, 2)).alias(k) for k, n in counts.items()]).first()
    heads = windows.groupBy("head").agg(*[F.sum(n).alias(f"all_{k}") for k, n in counts.items()])

    def own(k: str) -> Column:
        """The share of a context's count that a class has of a window for itself."""
        expected = F.col(f"all_{k}") * F.col("p")
        spread = F.sqrt(expected * F.col("squares") / F.expr(" + ".join(_TAUGHT)))
        return F.coalesce(F.try_divide(F.greatest(counts[k] - cuts[k] - expected - sure * spread, F.lit(0.0)), F.col(f"all_{k}")), F.lit(0.0))

    windows = stored(windows.join(heads, "head").select("gram", "head", "p", *[own(k).alias(k) for k in counts]).where(" + ".join(counts) + " > 0"))
    heads = windows.groupBy("head").agg(*[(1 - F.sum(k)).alias(f"rest_{k}") for k in counts])
    rest = {v: F.log(f"rest_t{v}") - F.log(f"rest_o{v}") for v in VERSIONS}
    chance = lambda k: F.log(F.col(k) + F.col(f"rest_{k}") * F.col("p"))
    seen = windows.join(heads, "head").select(F.col("gram").alias("key"), *[(chance(f"t{v}") - chance(f"o{v}") - rest[v]).alias(v) for v in VERSIONS])
    return stored(seen.unionByName(heads.select(F.col("head").alias("key"), *[rest[v].alias(v) for v in VERSIONS])))


def _places(w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all longest windows and contexts of the words, and the words they are in."""
    keys, word = [], []
    for m, _, at in w.ending():
        for context in (False, True):
            keys.append(w.keys(m, at, context))
            word.append(w.word[at])
    return np.concatenate(keys), np.concatenate(word)


def _summed(model, order: int, kept: list[str]) -> Callable:
    """Batches whose last column is the text: it becomes the number of words and the three log ratios."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = model.value
        for batch in _blocks(batches, len(kept)):
            words, codes, row = _words(batch.column(batch.num_columns - 1))
            codes, row = _once(codes, row, len(words))
            out = np.zeros((batch.num_rows, len(VERSIONS)))
            if len(words) and len(known):
                keys, word = _places(Windows(words, order))
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                for k in range(len(VERSIONS)):
                    of_word = np.bincount(word[hit], values[at[hit], k], len(words))
                    out[:, k] = np.bincount(row, of_word[codes], batch.num_rows)
            n = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n), *(pa.array(out[:, k]) for k in range(len(VERSIONS)))], [*kept, "n_words", *VERSIONS])

    return run


def _emitted(order: int) -> Callable:
    """Batches (row, text) to (row, key, n_words): a row for each place, and one without key that has the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, 1):
            words, codes, row = _words(batch.column(1))
            codes, row = _once(codes, row, len(words))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            counts = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(counts)], ["row", "key", "n_words"])
            if not len(words):
                continue
            keys, word = _places(Windows(words, order))
            by_word = np.argsort(word, kind="stable")
            keys = keys[by_word]
            for k in range(0, len(codes), 100_000):
                of, at = _expanded(codes[k : k + 100_000], word[by_word], len(words))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[k : k + 100_000][of]]), pa.array(keys[at]), pa.nulls(len(at), pa.int64())], ["row", "key", "n_words"])

    return run


def _ratios(rows: DataFrame, model: DataFrame, order: int, model_rows: int) -> DataFrame:
    """``rows`` (their last column is the text) with n_words and the log ratios of the three versions."""
    spark, kept = rows.sparkSession, rows.columns[:-1]
    if model.count() <= model_rows:
        table = model.toPandas().sort_values("key")
        sent = spark.sparkContext.broadcast((table["key"].to_numpy(np.int64), table[list(VERSIONS)].to_numpy(np.float64)))
        schema = rows.select(*kept).schema.add("n_words", "long")
        for v in VERSIONS:
            schema = schema.add(v, "double")
        return rows.mapInArrow(_summed(sent, order, kept), schema)
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()))
    met = rows.select("__row", rows.columns[-2]).mapInArrow(_emitted(order), "row long, key long, n_words long").join(model, "key", "left")
    sums = met.groupBy(F.col("row").alias("__row")).agg(F.sum("n_words").alias("n_words"), *[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in VERSIONS])
    return rows.drop(rows.columns[-2]).join(sums, "__row").drop("__row")


#: Steps a unit of the normalised ratio in the curve's table, and the last step.
STEPS, LAST_STEP = 50, 500


def _score(table: tuple[list[int], list[float]]) -> Callable:
    """Batches whose last column is the ratio: it becomes the chance that the curve gives it; a hundredth of it rises by the ratio itself, so that it never stands still."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            p = 0.99 * _chance(np.clip(STEPS * ratio, -LAST_STEP, LAST_STEP), table) + 0.01 / (1 + np.exp(-np.clip(ratio, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*batch.schema.names[:-1], "score"])

    return run


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_part: int = 1,
    threshold: float = 0.7,
    order: int = ORDER,
    sure: float = 2.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    model_rows: int = MODEL_ROWS,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_words, log_ratio)`` of every document.

    ``labels`` holds ``id_col`` and ``label_col`` (1 toxic, 0 ordinary). The part
    of an id is crc32 of it as text, modulo 3; labels of ``held_part`` are never
    read. The labelled texts of the two other parts teach the models, near copies
    in a class once; each fold of them is scored by what the others taught,
    so no text is judged by its own label, and the curve is fitted on these
    scores. All other documents are scored by all of them together.

    ``n_words`` counts distinct words, ``log_ratio`` is the log likelihood ratio a
    word. Null labels and those of
    unknown documents teach nothing, several of one id by majority (ties:
    toxic). Null, empty and wordless texts have ratio 0 and the score of that;
    without any fitted label all scores are 0.5, with labels of one class they
    lean to it. A null id is in no part (``held_out`` false). Repeated rows are all
    returned; further columns are ignored.
    """
    part = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(PARTS))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")
    given = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (part(F.col("doc_id")) != held_part))
    given = stored(given.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    labelled = source.join(small(given), "doc_id").withColumn("hash", F.xxhash64("text"))
    once = _apart(labelled)
    taught = labelled.join(small(once), ["doc_id", "toxic", "hash"], "left_semi").withColumn("kind", FOLDS * (1 - F.col("toxic")) + fold)
    model = _model(taught, order, sure)
    rows = source.join(small(given), "doc_id", "left").select("doc_id", "toxic", F.coalesce(part(F.col("doc_id")), F.lit(-1)).cast("int").alias("part"), "text")
    own = F.when(F.col("toxic").isNull(), F.col("a")).otherwise(F.array(*VERSIONS[1:])[fold])
    scored = stored(_ratios(rows, model, order, model_rows).select("doc_id", "toxic", "part", "n_words", (own / F.greatest("n_words", F.lit(1))).alias("log_ratio"), (own / F.sqrt(F.greatest("n_words", F.lit(1)))).alias("normal")), batch=TEXT_ROWS)
    step = F.greatest(F.least(F.floor(STEPS * F.col("normal")), F.lit(LAST_STEP)), F.lit(-LAST_STEP))
    table = scored.where("toxic is not null").groupBy(step.alias("step")).agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).collect()  # a row for a step
    curve = _isotonic({r["step"]: (r["toxic"], r["n"]) for r in table})
    dropped(given, once, model)
    out = scored.select("doc_id", (F.col("part") == held_part).alias("held_out"), "n_words", "log_ratio", "normal").mapInArrow(_score(curve), extended(scored.select("doc_id"), "held_out boolean, n_words long, log_ratio double, score double"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", "log_ratio")
