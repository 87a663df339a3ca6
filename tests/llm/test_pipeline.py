"""The pipeline against the stages' own results, brute force where SQL has no form of them."""

from __future__ import annotations

import corpus_pipeline as pipeline

from cairn.llm import queries
from tests.llm.test_llm import brute_components, brute_contaminated


def test_stages(spark, sf_dir):
    from cairn.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, frames = [], [docs]
    for name, stage in pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], sf_dir), name))
        kept.append({r["doc_id"] for r in frames[-1].select("doc_id").collect()})
    assert all(f.columns == docs.columns for f in frames[1:-1])
    predicted = {r["doc_id"]: r["predicted"] for r in queries.op9_quality(spark, sf_dir).collect()}
    assert kept[0] == {i for i, p in predicted.items() if p}
    rows = [(r["doc_id"], r["text"]) for r in frames[1].collect()]
    want, _ = brute_components(rows, 5, 80)
    assert kept[1] == {i for i, c in want.items() if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {i for i, _ in brute_contaminated([(r["doc_id"], r["text"]) for r in frames[2].collect()], items)}
    assert not kept[2] & bad and len(kept[1]) - len(kept[2]) <= len(bad) + 2
    assert kept[3] == kept[2] and kept[4] == kept[3]
    tokens = frames[-1].orderBy("start").collect()
    assert len(tokens) == frames[-2].count() and [r["doc_id"] for r in tokens] == sorted(r["doc_id"] for r in tokens)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(tokens[:-1], tokens[1:], strict=True))


def test_rows_without_id_or_repeated_pass(spark, sf_dir):
    docs = spark.createDataFrame([(None, "a b c d e f", "en", "s", 3), (1, "a b c d e f", "en", "s", 3), (1, "a b c d e f", "en", "s", 3), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    left = pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "2", "None"]
    clean = pipeline.drop_contaminated(spark, left, sf_dir)
    mixed = pipeline.mix_sources(spark, clean, sf_dir)
    assert {r["doc_id"] for r in mixed.collect()} == {None, 1, 2} and mixed.columns == docs.columns


def test_rows_of_one_id_keep_all_their_texts(spark, sf_dir):
    """Of rows that repeat an id and a text the one of the smallest hash stays; a linked document goes with all its texts."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "en", "b", 1), (1, long, "en", "a", 1), (1, "another text of its own here", "en", "a", 1), (2, long + " end", "en", "a", 1), (2, "the second one's further text", "en", "a", 1), (3, None, "en", "a", 1), (3, None, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted((r["doc_id"], str(r["text"])) for r in pipeline.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert left == [(1, "another text of its own here"), (1, long), (3, "None")]
    again = pipeline.drop_near_duplicates(spark, docs.repartition(3, "source"), sf_dir)
    assert {r["source"] for r in again.collect() if r["text"] == long} == {r["source"] for r in pipeline.drop_near_duplicates(spark, docs, sf_dir).collect() if r["text"] == long}


def test_clashing_columns_are_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).selectExpr("*", "1 as _quality", "2 as mix_pass", "3 as mix_source", "4 as bad_id", "5 as _gone", "6 as score", "7 as row", "8 as component_id")
    for _, stage in pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, sf_dir)
        assert docs_out.columns == docs.columns
        assert {tuple(r) for r in docs_out.select(*docs.columns[5:]).collect()} <= {(1, 2, 3, 4, 5, 6, 7, 8)}
        docs = docs_out
    assert docs.count() > 0 and pipeline.token_ids(spark, docs, sf_dir).count() == docs.count()


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
