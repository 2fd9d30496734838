"""What a Python worker holds at once, and keeps for the stages after."""

import pyarrow as pa

from quire.llm import queries
from quire.llm import quality_classifier as qc
from quire.llm import sentencepiece_codec as sp
from quire.llm import toxicity as tox
from quire.session import PART_ROWS, TEXT_ROWS, batches_of, compiled_from, stored


def test_text_batches_are_bounded_inside_only(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

    rows = stored(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), batch=TEXT_ROWS)
    assert [r.n for r in rows.collect()] == [TEXT_ROWS] * 5 and spark.conf.get(key) == before
    with batches_of(spark, None):
        assert spark.conf.get(key) == before


def test_classifier_takes_few_rows_of_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array([[i, i] for i in range(2500)], pa.list_(pa.int32()))], ["text_view"])
    parts = list(qc._few_rows(iter([batch.slice(0, 0), batch])))
    assert [len(p) for p in parts] == [1000, 1000, 500]
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()


def test_codec_cache_is_trimmed_and_ids_stay(monkeypatch):
    monkeypatch.setattr(sp, "CACHE_PARTS", 40)
    monkeypatch.setattr(sp, "KEPT_PARTS", 10)
    texts = [" ".join(f"word{i}x{j}" for j in range(8)) for i in range(30)] + [None, ""]
    c = sp.Codec(queries.model_file())
    got = [list(map(int, ids.split(","))) if ids else [] for t in texts for _, ids, _ in sp._encoded([t], c)]
    assert got == [c.lib.encode(t or "") for t in texts] and len(c.seen) <= 40
    first = list(c.seen)[:10]
    c.trim()
    assert list(c.seen) == first


def test_toxicity_takes_texts_apart_in_blocks(monkeypatch):
    monkeypatch.setattr(tox, "BLOCK", 50)
    texts = ["a" * 20, None, "b" * 30, "", "c" * 200, "é" * 20, "d" * 11, "e"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(tox._blocks(iter([batch.slice(0, 0), batch, batch.slice(5)]), 1))
    assert sum((p.column(0).to_pylist() for p in parts), []) == [*range(24), *range(5, 24)]
    size = lambda p: sum(len((t or "").encode()) for t in p.column(1).to_pylist())
    assert all(size(p) <= 50 or p.num_rows == 1 or size(p) == 200 for p in parts) and min(map(len, parts)) > 0


def test_counts_of_blocks_add_up_to_those_of_a_batch(monkeypatch):
    texts = [f"word{i % 7} common word{i % 3}x" for i in range(60)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([i % len(tox._TAUGHT) for i in range(len(texts))], pa.int32())], ["text", "kind"])

    def summed():
        made = [b for b in tox._count(tox.ORDER)(iter([batch]))]
        table = pa.Table.from_batches(made).group_by(["size", "opens", "gram", "tail", "head"]).aggregate([(c, "sum") for c in tox._SUMS])
        return len(made), sorted(map(tuple, (r.values() for r in table.to_pylist())))

    whole, counts = summed()
    monkeypatch.setattr(tox, "BLOCK", 200)
    blocks, again = summed()
    assert blocks > whole and again == counts


def test_full_codec_cache_keeps_most_and_decodes_alike(monkeypatch):
    """Of a full cache three parts in five stay, so that frequent ones aren't learnt again; texts still decode to the library's."""
    monkeypatch.setattr(sp, "CACHE_PARTS", 100)
    monkeypatch.setattr(sp, "KEPT_PARTS", 5)
    c, learnt, merge = sp.Codec(queries.model_file()), [], sp.Codec.merge
    monkeypatch.setattr(sp.Codec, "merge", lambda self, p: (learnt.append(p), merge(self, p))[1])
    common = " ".join(f"word{i}x" for i in range(12))
    for i in range(40):
        text = f"{common} new{i}a new{i}b �▁ é日\x00"
        (n, ids, back), lib = next(sp._encoded([text], c)), c.lib.encode(text)
        assert ids == ",".join(map(str, lib)) and n == len(lib) and back == c.lib.decode(lib)
    assert len(learnt) == len(set(learnt)) and len(c.seen) <= 100


def test_small_tables_are_not_compiled(spark):
    key = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(key)
    with compiled_from(spark, 10):
        assert spark.conf.get(key) == "false"
    for rows in (None, PART_ROWS):
        with compiled_from(spark, rows):
            assert spark.conf.get(key) == before
    assert spark.conf.get(key) == before and stored(spark.range(5), 5).count() == 5
