import random
import re

import pytest

from quire.llm import jaccard

SCHEMA = "doc_id long, text string, n int, component_id string"


def brute(rows, ngram, num, den):
    sets = {}
    for i, (key, text) in enumerate(rows):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets[i] = frozenset(tuple(w[j : j + ngram]) for j in range(max(1, len(w) - ngram + 1))) if w else frozenset()
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b) and rows[i][0] is not None and rows[j][0] is not None:
                x, y = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[y] = x
    return sorted((key, len(sets[i]), find(key) if key is not None else None) for i, (key, _) in enumerate(rows) if key is not None)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    line = " ".join(rng.choices(vocab, k=12))
    for _ in range(25):  # groups of near copies, chains included
        text = rng.choices(vocab, k=rng.choice([3, 8, 30, 60, 150]))
        if rng.random() < 0.5:
            text = line.split() + text
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            new = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                new[rng.randrange(len(new))] = rng.choice(vocab)
            rows.append((at * 7 % 1000, " ".join(new) if rng.random() < 0.8 else " \n".join(new).upper()))
            at += 1
            if rng.random() < 0.5:
                text = new
    return rows


@pytest.mark.parametrize(("seed", "ngram", "num", "den", "long_list"), [(1, 4, 85, 100, 3), (3, 2, 60, 100, 2)])
def test_matches_brute_force(spark, monkeypatch, seed, ngram, num, den, long_list):
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], SCHEMA)
    got = jaccard.ngram_jaccard_join(df, ngram=ngram, num=num, den=den).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, ngram, num, den)


def test_odd_rows(spark):
    long_text = " ".join(f"word{i}" for i in range(300_000))
    rows = [(5, None), (6, ""), (7, " \n\t"), (None, "a b c"), (3, "a b c"), (9, "A  B\nC"), (2, "a b"), (2, "x y z"), (1, "X y z"), (11, long_text), (10, long_text + " end"), (4, "é É"), (8, "É é")]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], SCHEMA)
    got = jaccard.ngram_jaccard_join(df, ngram=5, num=80, den=100).collect()
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in got)
    assert found == [(-1, 1, None), (1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 3), (10, 299_997, 10), (11, 299_996, 10)]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard.ngram_jaccard_join(df).count() == 0


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = ["The quick Brown fox\njumps over it", "é ü " * 50, "", None, "one"]
    whole = list(jaccard.token_sets(pa.array(texts), 3))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    assert all(np.array_equal(a, b) for a, b in zip(whole, jaccard.token_sets(pa.array(texts), 3), strict=True))


def test_repeated_rows_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_LIST", 2)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(12):  # pairs just above the threshold, one of each repeated many times
        text = rng.choices(vocab, k=100)
        near = list(text)
        for at in rng.sample(range(2, 97), 2):
            near[at] = "x"
        rows += [(10 * i, " ".join(text))] * rng.choice([3, 5]) + [(10 * i + 1, " ".join(near))]
    for i in range(6):  # one id, several texts, each with a near copy elsewhere
        for j in range(2):
            text = rng.choices(vocab, k=100)
            rows += [(500 + i, " ".join(text)), (500 + i, " ".join(text)), (600 + 10 * i + j, " ".join([*text[:-1], "y"]))]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], SCHEMA)
    got = jaccard.ngram_jaccard_join(df, ngram=4, num=85, den=100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 85, 100)


def test_repeated_rows_keep_their_positions(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG_LIST", 2)
    rng, seen, plain = random.Random(9), [], jaccard._prefixes
    common = rng.choices([f"w{i}" for i in range(400)], k=60)
    rows = [(i, " ".join([*common, *rng.choices("abcdefgh", k=20)])) for i in range(6)]

    def prefixes(*args):
        out = plain(*args)
        seen.append(sorted(map(str, out.collect())))
        return out

    monkeypatch.setattr(jaccard, "_prefixes", prefixes)
    for given in (rows, rows + rows[:2] * 3):
        jaccard.ngram_jaccard_join(spark.createDataFrame(given, "doc_id long, text string"), ngram=4, num=85, den=100)
    assert seen[0] and seen[0] == seen[1]


def near_copies(seed, size):
    """Large groups: copies with words put in, changed and left out, chains of copies, and short texts around a shared passage."""
    rng, rows = random.Random(seed), []
    word = lambda: f"x{rng.randrange(10**6)}"
    first, passage, chain = ([f"w{rng.randrange(300)}" for _ in range(k)] for k in (120, 90, 80))
    for i in range(size):
        text = list(first)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            at = rng.randrange(len(text))
            text[at : at + rng.choice([0, 1, 1])] = rng.choice([[], [word()], [word(), word()], first[:3]])
        rows.append(text)
        rows.append([*[word() for _ in range(rng.randrange(14))], *passage, *(first[: rng.choice([0, 0, 4, 9])])])
        if i % 2:
            chain = list(chain)
            chain[rng.randrange(len(chain))] = rng.choice(first)
            rows.append(chain)
    return [(i * 37 % 10007, " ".join(t)) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "long_list", "rounds", "num"), [(11, 16, 6, 85), (12, 4, 0, 80)])
def test_large_groups_match_brute_force(spark, monkeypatch, seed, long_list, rounds, num):
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", rounds)
    rows = near_copies(seed, 200)
    got = jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), ngram=4, num=num, den=100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, num, 100)


def test_words_of_any_length_have_hashes_of_their_own(spark):
    """The two words of a Thue-Morse sequence have equal polynomial hashes for every odd base modulo 2**64."""
    morse = [bin(i).count("1") % 2 for i in range(4096)]
    words = [["".join(two[m] for m in morse[:k]) for two in ("ab", "ba")] for k in (512, 4096)]
    rows = [(10 * i + j, w) for i, pair in enumerate(words) for j, w in enumerate(pair)] + [(30 + k, "a" * k) for k in range(7, 18)]
    got = jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), ngram=4, num=85, den=100).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 1 for r in got)


def test_lists_of_late_tokens_need_no_stars(spark, monkeypatch):
    """Units that share tokens, but too late in their lists to link, make no open pairs; one pair links."""
    rounds, plain = [], jaccard._settled
    monkeypatch.setattr(jaccard, "_settled", lambda links: (rounds.append(1), plain(links))[1])
    own = lambda i: [1000 * i + j for j in range(14)]
    rng = random.Random(5)
    hot = [[*own(i), *sorted(rng.sample(range(10**7, 10**7 + 120), 86))] for i in range(200)]
    hot.append([*hot[7][:-2], 10**8, 10**8 + 1])
    common = spark.createDataFrame([(i, 100, h) for i, h in enumerate(hot)], "set_id long, n long, hot array<long>")
    links, _ = jaccard._common_links(common, spark.createDataFrame([], "src long, dst long"), None, 80, 100)
    assert {tuple(r) for r in links.collect()} == {(7, 200)} and len(rounds) <= 2
