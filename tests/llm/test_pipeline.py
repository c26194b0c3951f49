"""The pipeline, stage by stage, on a small table."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        out.append(docs)
    return out


def test_columns_and_numbers(spark, stages):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert [s.columns for s in stages[:3]] == [documents.columns] * 3
    counts = [documents.count(), *(s.count() for s in stages)]
    assert counts[0] > counts[1] > counts[2] == counts[3] <= counts[4]


def test_one_of_each_group_stays(spark, stages):
    from test_small import grams

    rows = [(r.doc_id, grams(r.text, 5)) for r in stages[1].select("doc_id", "text").collect()]
    for i, (_, a) in enumerate(rows):
        for _, b in rows[:i]:
            both = len(a & b)
            assert not both or 100 * both < 80 * len(a | b)


def test_no_private_data_is_left(stages):
    from tiltmine.llm import surrogates

    before = {r.doc_id: r.text for r in stages[1].collect()}
    for r in stages[2].collect():
        real = {before[r.doc_id][a:b] for a, b, kind in surrogates.find(before[r.doc_id]) if not kind.startswith("given")}
        assert not any(x in r.text for x in real) and (real or r.text == before[r.doc_id])


def test_run_is_the_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1])


def test_odd_tables(spark):
    """Nulls, empty and long texts, repeated rows, extra columns and no rows: every stage gives rows for what is left."""
    from tiltmine.llm import ngram_join, packing, surrogates

    import public_tokenizers

    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, long), (2, long), (3, None), (4, ""), (5, "a b"), (5, "a b"), (None, "Mr Smith, password: ______"), (6, "Mr A and Mr E and Mr I"), (7, " \t ")]
    docs = spark.createDataFrame([(i, t, None, "s", 0, 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, cid long, found int")
    kept = ngram_join.one_of_each(docs, corpus_pipeline.NEAR)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), *((True, i) for i in (1, 3, 4, 5, 6, 7))]
    changed = surrogates.anonymise(kept, b"a key")
    assert changed.columns == docs.columns and {r.doc_id: r.text for r in changed.collect()}[1] == long
    pieces = packing.pack_documents(changed, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in pieces} == {None, 1, 3, 4, 5, 6, 7} and max(r.length for r in pieces) == 4096
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name
