"""Similarity join of documents on word n-gram sets, by grouped prefix filtering.

A document's set holds the distinct n-grams of its words. Tokens have one
global order: first those that few documents hold, by hash value, then the
frequent ones, rarest first. Two sets of Jaccard similarity t or more share a
token among the first ``n - ceil(t n) + 1`` of each, so only these prefixes
are joined:

1. equal sets collapse into one; each set gives its first tokens by hash;
2. these are counted, and frequent ones move behind all others. Sets that lose
   tokens of their prefix that way give more, which are counted too, until
   every set has a whole prefix of infrequent tokens or has given all;
3. sets with the same prefix and size form one group; groups that share an
   infrequent token make pairs, filtered by size, position and common tokens;
   their members are verified on their full sets;
4. what else can link are sets with too few infrequent tokens to fill a prefix
   ("common" ones), by their frequent tokens alone, as those that share an
   infrequent one have met in 3. Of these, sets alike in frequent tokens and
   size form one unit.

Lists of frequent tokens may be long, so they are not paired off. A star first
measures each unit against one centre, and what it joins is one component.
Outside the list's largest component, groups of units with the same size and
number of frequent tokens left from the list's token on are compared first, and
only groups that could hold a link between components are expanded to units. In
the list of the first token that two units share, both counts bound what they
may share, so this loses no link between components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.graph import components
from quire.session import TEXT_ROWS, dropped, small, stored

#: A token that more sets than this hold, as far as they gave it, is frequent.
LONG_LIST = 64
#: Tokens that a set gives beyond its prefix, as some of them may be frequent.
SPARE = 8
#: Stars before all pairs that could link are verified.
STAR_ROUNDS = 6
#: Bytes of text hashed at once, which bounds the memory of a task.
BLOCK = 2 << 20
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 512

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: The bytes of a block that belong to the word, by how many these are.
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _hash_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words data[begin:end]: blocks of 8 bytes, each mixed in before the next."""
    size = end - begin
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    block = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    h = _mix(size.astype(np.uint64) * _STEP)
    live, at = np.arange(len(size)), 0
    while len(live):
        if at >= LONG_WORD:
            for i in live:
                h[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
            break
        left = size[live] - at
        h[live] = _mix(h[live] * _STEP ^ (block[begin[live] + at] & _MASK[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    return h


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` (UTF-8), and the offset where each begins.

    ``cuts``: offsets at which a word ends in any case, as a text ends there.
    """
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _hash_words(_LOWER[data], begin, end), begin


def _long_text(data: np.ndarray) -> np.ndarray:
    """The word hashes of one text of any length, block by block."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(word_hashes(data[at:end], np.empty(0, np.int64))[0])
        at = end
    return np.concatenate(parts)


def _ngrams(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted set of n-gram hashes of one document; short texts have one."""
    k = min(size, len(words))
    if k == 0:
        return np.empty(0, np.int64)
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * _STEP + words[i : len(words) - k + 1 + i])
    h = np.sort(h.view(np.int64))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def token_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The n-gram set of every text of an Arrow column; null has the empty set."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = i + 1
        if offsets[j] - offsets[i] > BLOCK:
            yield _ngrams(_long_text(data[offsets[i] : offsets[j]]), size)
            i = j
            continue
        while j < len(column) and offsets[j + 1] - offsets[i] <= BLOCK:
            j += 1
        cuts = offsets[i : j + 1] - offsets[i]
        words, begin = word_hashes(data[offsets[i] : offsets[j]], cuts)
        at = np.searchsorted(begin, cuts)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield _ngrams(words[a:b], size)
        i = j


def _arrays(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate([*sets, np.empty(0, np.int64)]))


def _prefix(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def _emit(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, first = [], [], []
            for s in token_sets(batch.column(1), size):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                first.append(s[: _prefix(len(s), num, den) + SPARE].copy() if len(s) else s)
            pair = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), _arrays(first)],
                ["row_id", "doc_id", "n", "k1", "k2", "toks"],
            )

    return run


def _full(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), _arrays(list(token_sets(part.column(1), size)))], ["set_id", "tokens"])

    return run


def _stretch(size: int):
    """Tokens of each set from place ``at`` to place ``upto``, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 1000):
                part = batch.slice(begin, 1000)
                bounds = zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)
                toks = [s[a:b].copy() for s, (a, b) in zip(token_sets(part.column(1), size), bounds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2).cast(pa.int64()), part.column(3).cast(pa.int64()), _arrays(toks)], ["set_id", "n", "at", "toks"])

    return run


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document with its set size, links and connected component.

    Words are runs of non-white-space, A-Z read as a-z. Documents link when
    ``den * |A & B| >= num * |A | B|``. Returns ``(doc_id, n_shingles,
    component_id, copies)``: ``component_id`` is the smallest id reachable by
    links, ``copies`` counts the documents with an equal set (itself included).

    Texts that are null, empty or blank have an empty set and link with
    nothing. Texts of fewer than ``ngram`` words have their whole word sequence
    as one token. A row with a null id keeps its size and has a null component.
    Rows that repeat an id are the same document: all are returned, and their
    links count together. Other columns are ignored, so their names can't clash.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # rows whose id has several texts go by a hash, so that each row_id has one set
    version = F.xxhash64("text")
    repeated = stored(texts.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times"), (F.min(version) != F.max(version)).alias("several")).where("times > 1").select("doc_id", "several"))
    any_repeated = repeated.limit(1).count() > 0
    any_several = any_repeated and repeated.where("several").limit(1).count() > 0
    if any_several:
        several = small(repeated.where("several"))
        texts = texts.join(several, "doc_id", "left").select("text", "doc_id", F.when(F.col("several"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("row_id"))
    else:
        texts = texts.withColumn("row_id", F.col("doc_id"))
    texts = texts.select("row_id", "text", "doc_id")
    sets = stored(texts.mapInArrow(_emit(ngram, num, den), "row_id long, doc_id long, n long, k1 long, k2 long, toks array<long>"), batch=TEXT_ROWS)
    filled = sets.where("n > 0 and doc_id is not null")
    equal = stored(filled.groupBy("k1", "k2", "n").agg(F.min("row_id").alias("set_id"), F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    once, single = filled, texts
    if any_repeated:
        once, single = (_once(rows, repeated) for rows in (filled, texts))
    links, found = _links(single.select("row_id", "text"), once, equal.select("set_id"), ngram, num, den)
    if any_several:
        # an id with several texts is one document, which links all its sets
        own = filled.where("row_id <> doc_id").join(equal, ["k1", "k2", "n"]).select(F.col("doc_id").alias("src"), F.col("set_id").alias("dst"))
        found = components(links.unionByName(own.distinct()))
    label = equal.join(found.withColumnRenamed("node", "set_id"), "set_id", "left").select("k1", "k2", "n", "copies", "least", F.coalesce("component", "set_id").alias("component"))
    if any_several:
        # a hash can stand for a component; its name is the smallest id
        label = stored(label)
        label = label.join(label.groupBy("component").agg(F.min("least").alias("lowest")), "component").withColumn("component", F.col("lowest"))
    label = label.select("k1", "k2", "n", "copies", "component")
    return sets.select("doc_id", "n", "k1", "k2").join(label, ["k1", "k2", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
    )


def _once(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row of each ``row_id``; only the rows of repeated ids are shuffled."""
    ids = small(repeated.select("doc_id"))
    odd = stored(rows.join(ids, "doc_id", "left_semi").select(*rows.columns).dropDuplicates(["row_id"]))
    return rows.join(ids, "doc_id", "left_anti").select(*rows.columns).unionByName(odd)


def _read_sets(texts: DataFrame, ids: DataFrame, ngram: int) -> DataFrame:
    """The full sets of the documents in ``ids``."""
    rows = texts.withColumnRenamed("row_id", "set_id").join(small(ids), "set_id", "left_semi")
    return rows.select("set_id", "text").mapInArrow(_full(ngram), "set_id long, tokens array<long>")


def _listed(parts: list[DataFrame]) -> DataFrame:
    """``(set_id, n, idx, tok)``: the tokens given so far, and their places in their set by hash."""
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("set_id", "n", "at", F.posexplode("toks").alias("i", "tok")).select("set_id", "n", (F.col("at") + F.col("i")).alias("idx"), "tok")


def _counted(texts: DataFrame, chosen: DataFrame, ngram: int, num: int, den: int) -> DataFrame:
    """``(set_id, n, idx, tok, cnt)``: the given tokens that several sets gave.

    Goes on until each set has given a prefix of infrequent tokens, or all.
    """
    parts, spent = [chosen], [chosen]
    width = F.expr(_width(num, den))
    counts = stored(_listed(parts).groupBy("tok").agg(F.count("*").alias("cnt")).where("cnt > 1"))
    while True:
        hot = stored(counts.where(F.col("cnt") > LONG_LIST).select("tok"))
        # what frequent tokens take from each set's tokens so far
        lost = stored(_listed(parts).join(small(hot), "tok").groupBy("set_id").agg(F.count("*").alias("hot")))
        given = reduce(DataFrame.unionByName, parts).join(small(lost), "set_id").groupBy("set_id", "n", "hot").agg(F.sum(F.size("toks")).alias("at"))
        missing = width - (F.col("at") - F.col("hot"))
        short = given.where((F.col("at") < F.col("n")) & (missing > 0))
        short = stored(short.select("set_id", F.col("n").alias("n"), "at", F.least("n", F.col("at") + 2 * missing + SPARE).alias("upto")))
        spent += [hot, lost, short, counts]
        if not short.limit(1).count():
            # the counts grow with the corpus, so both sides are dealt by token at every size
            out = stored(_listed(parts).join(counts.hint("merge"), "tok").select("set_id", "n", "idx", "tok", "cnt"))
            dropped(*spent)
            return out
        rows = texts.withColumnRenamed("row_id", "set_id").join(small(short), "set_id").select("set_id", "text", "n", "at", "upto")
        more = stored(rows.mapInArrow(_stretch(ngram), "set_id long, n long, at long, toks array<long>"), batch=TEXT_ROWS)
        fresh = stored(_listed([more]).groupBy("tok").agg(F.count("*").alias("cnt")))
        before = _listed(parts).join(small(fresh.select("tok")), "tok").groupBy("tok").agg(F.count("*").alias("cnt"))
        both = before.unionByName(fresh).groupBy("tok").agg(F.sum("cnt").alias("cnt")).where("cnt > 1")
        counts = stored(counts.unionByName(both).groupBy("tok").agg(F.max("cnt").alias("cnt")))
        parts.append(more)
        spent += [more, fresh]


def _prefixes(counted: DataFrame, num: int, den: int) -> DataFrame:
    """``(set_id, n, cold, hot)``: infrequent prefix tokens with their places, and a common set's frequent tokens.

    Frequent tokens lie behind all others, rarest first; only a set with too few
    others, which has then given all of its tokens, has them in its prefix.
    Of the infrequent ones, those that no other set gave are left out.
    """
    width = F.expr(_width(num, den)).cast("int")
    rows = counted.groupBy("set_id", "n").agg(F.array_sort(F.collect_list(F.struct("idx", "tok", "cnt"))).alias("x"))
    # a token's place moves up by the frequent ones before it: its place here less that among the infrequent
    at = F.transform("x", lambda y, i: F.struct(y["idx"].alias("idx"), y["tok"].alias("tok"), (y["cnt"] > LONG_LIST).alias("hot"), y["cnt"].alias("cnt"), i.alias("i")))
    rows = rows.select("set_id", "n", at.alias("x"), F.filter(at, lambda y: ~y["hot"]).alias("cold"), F.filter(at, lambda y: y["hot"]).alias("hot"))
    cold = F.transform("cold", lambda y, j: F.struct((y["idx"] - y["i"] + j).cast("int").alias("pos"), y["tok"].alias("tok")))
    hot = F.transform(F.array_sort(F.transform("hot", lambda y: F.struct(y["cnt"].alias("cnt"), y["tok"].alias("tok")))), lambda y: y["tok"])
    rows = rows.select("set_id", "n", F.filter(cold, lambda y: y["pos"] < width).alias("cold"), F.when(F.col("n") - F.size("hot") < width, hot).alias("hot"))
    return rows.where("size(cold) > 0 or hot is not null")


def _links(texts: DataFrame, sets: DataFrame, ids: DataFrame, ngram: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links (src, dst) that join the same components as all links do, and these components (node, component)."""
    chosen = sets.withColumnRenamed("row_id", "set_id").join(ids, "set_id", "left_semi").select("set_id", "n", F.lit(0).cast("long").alias("at"), "toks")
    counted = _counted(texts, stored(chosen), ngram, num, den)
    keyed = stored(_prefixes(counted, num, den))
    dropped(counted)
    links, label = _cold_links(texts, keyed, ngram, num, den)
    return _common_links(keyed.where("hot is not null").select("set_id", "n", "hot"), links, label, num, den)


def _cold_links(texts: DataFrame, keyed: DataFrame, ngram: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links between sets that share an infrequent token of their prefixes, and their components; at most ``LONG_LIST`` sets hold one."""
    width = F.expr(_width(num, den)).cast("int")
    none = F.array().cast("array<long>")
    frequent = F.when(F.col("hot").isNull(), none).otherwise(F.slice("hot", F.lit(1), width - F.col("n").cast("int") + F.size("hot")))
    prefixed = stored(keyed.where("size(cold) > 0").select("set_id", "n", F.struct("cold", frequent.alias("hot")).alias("prefix")))
    grouped = stored(prefixed.groupBy("n", "prefix").agg(F.min("set_id").alias("group_id"), F.count("*").alias("members")))
    lists = grouped.select("group_id", "n", F.size("prefix.hot").alias("more"), F.explode("prefix.cold").alias("p")).select(F.col("p.tok").alias("key"), "group_id", "n", F.col("p.pos").alias("pos"), "more")
    many = grouped.where("members > 1")
    member = stored(prefixed.join(many, ["n", "prefix"]).select("group_id", "set_id"))

    a, b = (lists.select("key", *[F.col(c).alias(f"{c}{s}") for c in ("group_id", "n", "pos", "more")]) for s in "ab")
    pairs = a.join(b, "key").where("group_ida < group_idb").where(_near("na", "nb", "posa", "posb", num, den))
    pairs = pairs.groupBy("group_ida", "group_idb", "na", "nb").agg(F.count("*").alias("common"), F.first(F.least("morea", "moreb")).alias("more"))
    pairs = stored(pairs.where(_enough(num, den)).select(F.col("group_ida").alias("src"), F.col("group_idb").alias("dst"), "common"))
    # each group's best partner first, then the pairs that aren't of one component yet
    ends = F.explode(F.array(F.struct("src", F.col("dst").alias("other")), F.struct(F.col("dst").alias("src"), F.col("src").alias("other")))).alias("e")
    best = pairs.select("common", ends).groupBy("e.src").agg(F.max_by("e.other", F.struct("common", -F.col("e.other"))).alias("dst"))
    best = best.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    own = member.where("set_id <> group_id").select(F.col("group_id").alias("src"), F.col("set_id").alias("dst"))
    tried = stored(best.union(own).distinct())
    links = _verify(texts, tried, ngram, num, den)
    label = _settled(links)
    a, b = (label.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")) for end in ("src", "dst"))
    open_ = pairs.join(a, "src", "left").join(b, "dst", "left").where(F.coalesce("csrc", "src") != F.coalesce("cdst", "dst")).select("src", "dst")
    open_ = stored(open_.join(tried, ["src", "dst"], "left_anti"))
    if open_.limit(1).count():
        links = stored(links.union(_verify(texts, open_, ngram, num, den)))
        dropped(label)
        tried, label = tried.union(open_), _settled(links)

    # members of groups that make a pair, and of one group, if they aren't of one component yet
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("group_id")).union(member.select("group_id")).distinct()
    of = ends.select("group_id", F.col("group_id").alias("set_id")).union(member).distinct()
    of = stored(_labelled(of, label.withColumnRenamed("node", "set_id")))
    several = pairs.join(small(many.select(F.col("group_id").alias("src"), F.lit(1).alias("one"))), "src", "left").join(small(many.select(F.col("group_id").alias("dst"), F.lit(1).alias("two"))), "dst", "left").where("one is not null or two is not null").select("src", "dst")
    several = several.union(many.select("group_id", F.col("group_id")))
    a, b = (of.select(F.col("group_id").alias(g), F.col("set_id").alias(f"set_id{s}"), F.col("component").alias(f"c{s}")) for g, s in (("src", "a"), ("dst", "b")))
    rest = several.join(a, "src").join(b, "dst").where("ca <> cb")
    rest = rest.select(F.least("set_ida", "set_idb").alias("src"), F.greatest("set_ida", "set_idb").alias("dst")).distinct()
    rest = stored(rest.join(tried, ["src", "dst"], "left_anti"))
    if not rest.limit(1).count():
        return links, label
    links = stored(links.union(_verify(texts, rest, ngram, num, den)))
    return links, _settled(links)


def _common_links(common: DataFrame, links: DataFrame, label: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``links``, and those between common sets that share only frequent tokens; ``label``: the components.

    Without a shared infrequent token two sets share at most the frequent ones
    of either, so a unit (sets of one size with the same frequent tokens that
    link with each other) links with another unit as one set or not at all.
    """
    width = F.expr(_width(num, den)).cast("int")
    held = F.size("hot").cast("long")
    alike = (num + den) * held >= 2 * num * F.col("n")
    keyed = stored(common.withColumn("alone", F.when(~alike, F.col("set_id"))))
    if not keyed.limit(1).count():
        return links, label
    units = stored(keyed.groupBy("n", "hot", "alone").agg(F.min("set_id").alias("unit"), F.count("*").alias("members")))
    several = units.where("members > 1").select("n", "hot", "unit")
    links = stored(links.union(keyed.where("alone is null").join(several, ["n", "hot"]).where("set_id <> unit").select(F.col("unit").alias("src"), F.col("set_id").alias("dst"))))
    listed = units.select("unit", "n", held.alias("h"), F.posexplode(F.slice("hot", F.lit(1), width - F.col("n").cast("int") + F.size("hot"))).alias("pos", "key"))
    listed = listed.withColumn("r", F.col("h") - F.col("pos"))
    listed = stored(listed.join(listed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "key").select("key", "unit", "n", "h", "r"))
    rows = listed.count()
    sets = units.select("unit", "n", "hot")
    centre = listed.groupBy("key").agg(F.min(F.struct(F.col("n") - F.col("h"), F.xxhash64("unit"), "unit", "n", "h")).alias("top")).select("key", *_as("top.", "a"))
    for k in range(STAR_ROUNDS + 1):
        star = listed.select("key", *_as("", "b")).join(small(centre), "key").where(_could("h", num, den)).where("unita <> unitb")
        links = stored(links.union(_alike(sets, star, num, den, rows)))
        label = _settled(links)
        now = stored(listed.join(label.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit")), rows)
        main = now.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
        now = stored(now.join(small(stored(main, rows)), "key").withColumn("inside", F.col("component") == F.col("main")).drop("main"), rows)
        # groups of equal counts first: could they hold a link between components, if this is the first token shared?
        groups = stored(now.groupBy("key", "n", "r", "inside").agg(F.count("*").alias("c")), rows)
        a = groups.where("not inside").select("key", F.col("n").alias("na"), F.col("r").alias("ra"), F.col("c").alias("ca"))
        b = groups.select("key", F.col("n").alias("nb"), F.col("r").alias("rb"), F.col("c").alias("cb"), F.col("inside").alias("insideb"))
        itself = (F.col("na") == F.col("nb")) & (F.col("ra") == F.col("rb")) & ~F.col("insideb")
        once = F.col("insideb") | (F.struct("na", "ra") <= F.struct(F.col("nb").alias("na"), F.col("rb").alias("ra")))
        open_ = stored(a.join(b, "key").where(_could("r", num, den)).where(once & ~(itself & (F.col("cb") == 1))))
        # where few are open, expanding them is in proportion
        spent = [now, groups, open_, label]
        if k == STAR_ROUNDS or (open_.agg(F.sum(F.col("ca") * F.col("cb"))).first()[0] or 0) <= 2 * rows:
            break
        ends = open_.select("key", F.col("na").alias("n"), F.col("ra").alias("r")).union(open_.where("not insideb").select("key", "nb", "rb")).distinct()
        outside = now.where("not inside").join(ends, ["key", "n", "r"])
        centre = stored(outside.groupBy("key").agg(F.min(F.struct(F.col("n") - F.col("h"), F.xxhash64("unit", F.lit(k)), "unit", "n", "h")).alias("top")).select("key", *_as("top.", "a")), rows)
        dropped(*spent)

    outside = now.where("not inside").select("key", *_as("", "a"), F.col("r").alias("ra"), F.col("component").alias("ka"))
    partner = open_.select("key", "na", "ra", "nb", "rb", "insideb")
    ends = now.select("key", *_as("", "b"), F.col("r").alias("rb"), F.col("component").alias("kb"), F.col("inside").alias("insideb"))
    rest = outside.join(partner, ["key", "na", "ra"]).join(ends, ["key", "nb", "rb", "insideb"]).where("ka <> kb")
    more = stored(_alike(sets, rest, num, den))
    if not more.limit(1).count():
        return links, label
    links = stored(links.union(more))
    return links, _settled(links)


def _as(prefix: str, suffix: str) -> list[Column]:
    return [F.col(f"{prefix}{c}").alias(f"{c}{suffix}") for c in ("unit", "n", "h")]


def _could(held: str, num: int, den: int) -> Column:
    """Could units overlap enough by their frequent tokens alone? ``held``: all of these (h), or those left from the shared one on (r)."""
    return (num + den) * F.least(f"{held}a", f"{held}b") >= num * (F.col("na") + F.col("nb"))


def _alike(sets: DataFrame, pairs: DataFrame, num: int, den: int, rows: int | None = None) -> DataFrame:
    """The pairs of units that link by their frequent tokens, as (src, dst); ``rows``: about how many pairs there are at most."""
    pairs = stored(pairs.select(F.least("unita", "unitb").alias("src"), F.greatest("unita", "unitb").alias("dst")).distinct(), rows)
    a, b = (sets.select(F.col("unit").alias(end), F.col("n").alias(f"n{s}"), F.col("hot").alias(f"hot{s}")) for end, s in (("src", "a"), ("dst", "b")))
    both = pairs.join(a, "src").join(b, "dst").withColumn("both", F.size(F.array_intersect("hota", "hotb")))
    return both.where((num + den) * F.col("both") >= num * (F.col("na") + F.col("nb"))).select("src", "dst")


def _settled(links: DataFrame) -> DataFrame:
    """The components of stored links, stored; a link has two nodes."""
    return stored(components(links), 2 * links.count())


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Add the component; a set without links is its own."""
    return rows.join(label, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))


def _width(num: int, den: int) -> str:
    """Tokens of a prefix, of a set of n: n - ceil(n num / den) + 1."""
    return f"(n - (n * {num} + {den - 1}) div {den} + 1)"


def _near(na: str, nb: str, posa: str, posb: str, num: int, den: int) -> Column:
    """Size and position: can sets that share a token at posa and posb have the overlap they need?"""
    least, most = F.least(na, nb), F.greatest(na, nb)
    room = F.least(F.col(na) - F.col(posa), F.col(nb) - F.col(posb)) + F.least(posa, posb)
    return (den * least >= num * most) & ((num + den) * room >= num * (F.col(na) + F.col(nb)))


def _enough(num: int, den: int) -> Column:
    """Do the prefixes share so many tokens that the rest can make up the overlap?

    Common tokens up to the end of the prefix that ends first are in both
    prefixes; beyond it that set has ceil(n num / den) - 1 tokens left.
    """
    left = F.ceil(F.greatest("na", "nb") * num / den) - 1
    return (num + den) * (F.col("common") + F.col("more") + left) >= num * (F.col("na") + F.col("nb"))


def _verify(texts: DataFrame, pairs: DataFrame, ngram: int, num: int, den: int) -> DataFrame:
    """The pairs (src, dst) that link, verified on whole sets; stored."""
    pairs = stored(pairs.distinct())
    ids = stored(pairs.select(F.col("src").alias("set_id")).union(pairs.select("dst")).distinct())
    sets = stored(_read_sets(texts, ids, ngram), batch=TEXT_ROWS)
    a = sets.select(F.col("set_id").alias("src"), F.col("tokens").alias("ta"))
    b = sets.select(F.col("set_id").alias("dst"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    rows = pairs.join(a, "src").join(b, "dst").select("src", "dst", F.size("ta").alias("na"), F.size("tb").alias("nb"), both.alias("both"))
    out = stored(rows.where(den * F.col("both") >= num * (F.col("na") + F.col("nb") - F.col("both"))).select("src", "dst"))
    dropped(pairs, ids, sets)
    return out
