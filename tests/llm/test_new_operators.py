"""Toxicity, collocations and whitening against plain versions, and odd rows."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.llm import collocations as co
from quire.llm import html_extract
from quire.llm import toxicity as tox
from quire.llm import whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, score string, key string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", "y", "z") for i, t, lang in rows], DOCS)


def plain_collocations(rows, best, least, cover):
    n, f = Counter(), {}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(100 * b >= cover * a for q, b in cand.items() if len(q) > len(p) and p in (q[:2], q[1:])):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), k, counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s, k) for i, (s, a, p, k, left, right) in enumerate(sorted(kept)[:best])]
    return sorted(out)


@pytest.mark.parametrize("best, frontier", [(3, 1_000_000), (12, 0), (500, 1_000_000)])
def test_collocations_equal_brute_force(spark, monkeypatch, best, frontier):
    monkeypatch.setattr(co, "FRONTIER", frontier)
    rng = random.Random(best)
    vocab = ["the", "Of", "a", "ß", "x1", "new", "york", "city", "w" * 500]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randrange(40))).replace("a", rng.choice(["a", "a.", "a\n"])), rng.choice(["en", "de", None])) for i in range(150)]
    rows += [(500, None, "fr"), (501, "", "fr"), (502, "new york city " * 300, "en"), (503, "one two", "xx"), (None, "New\tYork City", None)] + rows[:5]
    got = co.collocations(docs(spark, rows), best=best, least=4, cover=50)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, best, 4, 50)


def test_collocations_of_nothing(spark):
    assert co.collocations(docs(spark, [])).count() == 0
    assert co.collocations(docs(spark, [(1, "a b c", "en")])).count() == 0


def test_exact_scores_past_64_bits(spark):
    a = 3_000_000_019
    row = spark.createDataFrame([(a, a + 1, a + 2)], "a long, l long, r long").select(co._score("a", "l", "r").alias("s")).first()
    assert row.s == 1_000_000 * a * a // ((a + 1) * (a + 2))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long, component string")


def check_whitening(got, ids, matrix, components):
    x = np.floor(64 * matrix.astype(np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    e, vec = np.linalg.eigh(centred.T @ centred / n)
    e, vec = e[::-1], vec[:, ::-1]
    rows = {(r.vec_id, r.component): r for r in got}
    k = max(r.component for r in got)
    assert len(rows) == n * k and k == min(components, int((e > 1e-13 * e[0]).sum()))
    w = np.array([[rows[i, c].whitened for c in range(1, k + 1)] for i in ids])
    want = centred @ vec[:, :k] / np.sqrt(e[:k])
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-6
    assert np.abs(np.cov(w.T, bias=True) - np.eye(k)).max() < 1e-9
    for i, row in zip(ids, x.tolist()):
        r = rows[i, 1]
        assert r.deviation == sum((n * v - int(s)) ** 2 for v, s in zip(row, sums)) and r.n == n and r.identity_error < 1e-9
    assert all(math.isclose(rows[ids[0], c].explained, e[c - 1] / e.sum(), rel_tol=1e-6) for c in range(1, k + 1))


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 9)) * np.array([100, 30, 10, 5, 3, 2, 1, 1, 1]) + 50
    m[:, 7] = 3.0  # without variance
    m[:, 8] = 2 * m[:, 0]  # floors apart from another by a rounding at most
    rows = [(i, [float(v) for v in r], 0, 1, "c") for i, r in enumerate(m)]
    bad = [(1000, None, 0, 1, "c"), (1001, [float("nan")] * 9, 0, 1, "c"), (1002, [float("inf")] * 9, 0, 1, "c"), (1003, [None] * 9, 0, 1, "c"), (1004, [], 0, 1, "c"), (1005, [1.0], 0, 1, "c")]
    check_whitening(whitening.whiten(vectors(spark, rows + bad), components=8).collect(), list(range(300)), m, 8)


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0, 1, "c")] * 3)).count() == 0
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0, 1, "c"), (None, [2.0, 4.0], 0, 1, "c"), (1, [2.0, 4.0], 0, 1, "c")])).collect()
    assert len(got) == 3 and {r.component for r in got} == {1} and sum(r.vec_id is None for r in got) == 1


def test_centre_is_exact():
    c = whitening.Centre(3, [10, -1])
    x = np.array([[4, 0], [1 << 40, -5]])
    assert c.deviation(x) == [(12 - 10) ** 2 + 1, None]
    assert np.allclose(c.take(x)[0], [2 / 3, 1 / 3])


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def texts(n, seed):
    """Ordinary syllables; toxic texts hold some words that grow from one stem."""
    rng = random.Random(seed)
    parts = ["ba", "lo", "mi", "ter", "sun", "gra", "del", "vo", "rin", "ka"]
    word = lambda: "".join(rng.choices(parts, k=rng.randrange(1, 4)))
    out = []
    for i in range(n):
        bad = i % 4 == 0
        words = [word() for _ in range(rng.randrange(20, 60))]
        if bad:
            for _ in range(4):
                words[rng.randrange(len(words))] = "zurkel" + rng.choice(parts)
        out.append((i, " ".join(words), "en", bad))
    return out


def test_toxicity_finds_stems_in_held_out_texts(spark):
    made = texts(600, 1)
    rows = [(i, t, lang) for i, t, lang, _ in made] + [(9000, None, None), (9001, "", "en"), (9002, "... !!", "en"), (None, "zurkelba zurkello", "en"), (9003, "zurkelba " * 20_000, "en")]
    labels = spark.createDataFrame([(i, 0, int(b)) for i, _, _, b in made] + [(1, 0, None), (7777, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    # wrong labels of held-out texts change nothing
    wrong = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    results = []
    for given, bound in ((labels, tox.MODEL_ROWS), (wrong, 0)):
        got = {r.doc_id: r for r in tox.toxicity(docs(spark, rows), given, model_rows=bound).collect()}
        assert len(got) == len(rows)
        results.append(got)
    first, second = results
    for i, r in first.items():
        assert r.held_out == (i is not None and held(i)) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert math.isclose(r.score, second[i].score, abs_tol=1e-9)
    apart = [first[i] for i, _, _, _ in made if held(i)]
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in apart)
    assert right >= 0.97 * len(apart)
    assert first[9000].score == first[9001].score == first[9002].score and first[9000].n_words == 0 and first[9003].n_words == 1


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in tox.toxicity(docs(spark, [(1, "a b", "en"), (2, None, None)]), none).collect()} == {0.5}
    assert tox.toxicity(docs(spark, []), none).count() == 0


@pytest.mark.parametrize("name", ["op11_toxicity", "op12_collocations", "op13_whitening"])
def test_query_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert rows or name == "op12_collocations"
    if name == "op11_toxicity":
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize(
    "source, text",
    [
        ('<article><div style="overflow:hidden"><p>Body of the story.</p></div><p>Tail.</p></article>', "Body of the story. Tail."),
        ('<p title="the hidden truth">Body text</p>', "Body text"),
        ('<div data-id="menu"><p>Body</p></div>', "Body"),
        ("<html><head><meta charset=x><body><p>Body text.</p>", "Body text."),
        ("<head><title>T</title><p>x</p>", "x"),
        ("a < b <3 </> <!x> c <b", "a < b <3 c"),
        ("<p>q <!-- c --> w <!--> e", "q w e"),
        ('<div class=nav>n</div><p hidden>h</p><p>k<br/>l</p><p a="1>2" a=hidden>m</p>', "k l m"),
        ("<div id='&#109;enu'>x</div>y", "y"),
    ],
)
def test_pages_keep_their_text(source, text):
    assert html_extract.main_text(html_extract.Page(source), set())[0] == text


@pytest.mark.parametrize("part", ['<b"', '<b "', "<a b='", "<b/", "<", "<!--", "</", "<div>"])
def test_odd_pages_take_linear_time(part):
    began = time.process_time()
    html_extract.Page(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 30


def test_boxes_of_any_depth_are_known():
    deep = "<article><p>own text of the page, long enough to be the larger part</p>" + "<div>" * 12 + "<p>site</p>" + "</div>" * 12 + "</article>"
    page = html_extract.Page(deep)
    site = {page.tokens[at] for at, *_, text in page.blocks if text == "site"}
    assert html_extract.main_text(page, site)[0].startswith("own text") and "site" not in html_extract.main_text(page, site)[0]
