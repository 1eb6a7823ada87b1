"""The pipeline against its contracts by brute force, and the registered queries."""

import pytest

from . import fixtures as fx

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from ferrule.llm import quality
    from ferrule.llm.labelled import remainder

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, stages = docs.columns, corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["quality", "exact_dedup", "ngram_join", "decontaminate", "packing"]
    after = []
    for i, (_, stage) in enumerate(stages):
        docs = corpus_pipeline.Scratch(spark, "t").keep(stage(spark, docs, SF), f"s{i}")
        if i < 4:
            assert docs.columns == columns
            after.append([(r.doc_id, r.text) for r in docs.collect()])
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels, "quality", remainder(3) != 1)
    good = {r.doc_id for r in quality.score(spark.read.parquet(f"{SF}/documents.parquet"), model).where("score >= 0.5").collect()}
    assert {i for i, _ in after[0]} == good
    last: dict = {}
    for i, t in after[0]:
        key = (t or "").translate(fx.LOWER)
        last[key] = max(last.get(key, i), i)
    assert {i for i, _ in after[1]} == set(last.values())
    component = fx.components(after[1])
    assert {i for i, _ in after[2]} == {i for i, t in after[1] if component.get(t, i) == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {i for i, _ in after[3]} == {i for i, t in after[2] if not fx.hits(t, items)[1]}
    assert {r.doc_id for r in docs.collect()} == {i for i, _ in after[3]}
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_rows_without_id_and_repeated_ids_lose_their_near_copies(spark):
    """Each stage defines what becomes of rows without doc_id, of repeated doc_ids and of repeated rows."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (7, long + " more"), (7, "another text"), (None, long + " end"), (None, "alone"), (9, None), (5, "alone"), (5, "alone")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)

    def kept(name, df):
        return corpus_pipeline.Scratch(spark, "t").keep(stages[name](spark, df, SF), "s")

    distinct = kept("exact_dedup", docs)
    assert sorted((r.doc_id or 0, r.text or "") for r in distinct.collect()) == sorted([(1, long), (7, long + " more"), (7, "another text"), (0, long + " end"), (5, "alone"), (9, "")])
    apart = kept("ngram_join", distinct)
    assert sorted((r.doc_id or 0, r.text or "") for r in apart.collect()) == sorted([(1, long), (7, "another text"), (5, "alone"), (9, "")])
    clean = kept("decontaminate", apart)
    assert clean.count() == 4 and clean.columns == docs.columns and kept("packing", clean).count() == 4


def test_an_empty_corpus_passes_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.Scratch(spark, "t").keep(stage(spark, docs, SF), "s")
    assert docs.count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= names
