"""The pipeline's stages on rows whose id is null, repeated, or that of several texts."""

import random

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_duplicates(rows):
    """Groups linked at 80 % of five-word shingles keep one row, of the smallest id, null last; rows without words repeat no id and text."""
    sets = []
    for _, text in rows:
        w = (text or "").split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    kept = {r for r, s in zip(rows, sets, strict=True) if not s}
    for g in set(group):
        mine = [rows[i] for i in range(len(rows)) if group[i] == g and sets[i]]
        if mine:
            kept.add(min(mine, key=lambda r: (r[0] is None, r[0])))
    return sorted(kept, key=str)


def test_duplicate_stage_keeps_one_row_a_group(spark):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(500)], k=60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (1, a), (2, b), (2, c), (3, c + " end"), (None, d), (None, d), (None, e), (4, e + " end"), (5, ""), (5, ""), (6, None), (7, a + " end"), (8, text())]
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.duplicate_stage(spark, df, "").collect()]
    assert sorted(got, key=str) == plain_duplicates(rows)


def test_quality_stage_judges_each_row(spark, tmp_path):
    rng = random.Random(7)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80)) + "."
    bad = "LOUD!! " * 60
    rows = [(i, bad if i % 5 == 0 else good(), "en", "spam" if i % 5 == 0 else "news") for i in range(600)]
    spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 600, 3)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    odd = [(None, good(), "en", "news"), (None, bad, "en", "spam"), (900, good(), "en", "news"), (900, bad, "en", "spam"), (901, good(), "en", None), (902, good(), None, "news")]
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows + odd + odd[:1]], DOCS)
    got = [tuple(r)[:4] for r in corpus_pipeline.quality_stage(spark, df, str(tmp_path)).collect()]
    for r in odd:
        assert got.count(r) == (0 if r[1] == bad else 2 if r is odd[0] else 1)
    assert sum(1 for r in got if r[1] != bad) >= 480 and not any(r[1] == bad for r in got if r[0] is None or r[0] == 900)
