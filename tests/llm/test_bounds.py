"""Bounds that operators state: what reaches the driver, what is shuffled, and columns and names that once broke them."""

from __future__ import annotations

import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import common, components, decontaminate, divergence, language_id, language_model, mixing, quality, textvec
from cairn.llm.common import stored_at


@pytest.fixture
def collected(monkeypatch):
    """Rows of each table that the driver asks for."""
    seen, own = [], DataFrame.toArrow

    def spied(self):
        table = own(self)
        seen.append(table.num_rows)
        return table

    import pyspark.sql.classic.dataframe as classic

    own = classic.DataFrame.toArrow
    monkeypatch.setattr(classic.DataFrame, "toArrow", spied)
    return seen


def test_language_sample_is_bounded_whatever_ids_repeat(spark, collected):
    same = spark.range(4000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("the house of number "), "id").alias("text"), F.lit("en").alias("lang"))
    other = spark.range(300).select("id", F.concat(F.lit("das Haus der Zahl "), "id").alias("text"), F.lit("de").alias("lang")).toDF("doc_id", "text", "lang")
    model = language_id.train(same.unionByName(other), per_language=60, total=100)
    assert model["langs"] == ["de", "en"] and max(collected) <= 100
    assert language_id.predict(other, model).where("lang_pred = 'de'").count() == 300


def test_quality_sample_is_bounded_whatever_ids_repeat(spark, collected):
    docs = spark.range(2000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, sample=50)
    assert max(collected) <= 50
    assert quality.scored(docs, model).where("score between 0 and 1").count() == 2000


def test_no_source_is_not_the_source_named_null(spark):
    rows = [(i, "a b c", s) for i, s in enumerate([None, "null", "null\x00", "null", None, "x"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slim = mixing.slim(docs).groupBy("mix_source").count().collect()
    assert sorted(r["count"] for r in slim) == [1, 1, 2, 2]
    out = mixing.mixed(docs).where("mix_pass = 0")
    assert sorted((r["doc_id"], r["source"] or "") for r in out.collect()) == sorted((i, s or "") for i, _, s in rows)


def test_near_duplicates_keep_columns_of_maps(spark, sf_dir):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, {"a": 1, "b": 2}), (2, text, None), (3, "other words here", {}), (1, text, {"b": 2})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `m.x` map<string,int>").withColumn("deep", F.array(F.struct(F.create_map(F.lit("k"), F.lit(1)).alias("m"))))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_a_large_benchmark_shuffles_documents_once(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    assert want
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    store = spark.sparkContext._jsc.sc().statusStore()
    again = docs.unionByName(docs.where("doc_id % 5 = 0"))  # repeated rows too
    before = {s.stageId() for s in _stages(store)}
    got = sorted(map(tuple, decontaminate.contaminated(again, items).collect()))
    assert got == want
    shuffled = sum(s.shuffleWriteBytes() for s in _stages(store) if s.stageId() not in before)
    size = again.agg(F.sum(F.octet_length("text"))).first()[0]
    assert shuffled < 5 * size


def test_components_plan_one_check_a_round(spark, monkeypatch):
    rounds, own = [], components.stored_at
    monkeypatch.setattr(components, "stored_at", lambda df, name: rounds.append(name) or own(df, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(60, 61), (62, 61), (7, 7)], "a long, b long")
    queries = spark._jsparkSession.sharedState().statusStore()
    before = queries.executionsCount()
    found = components.components(edges)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert queries.executionsCount() - before <= 1 + 3 * (len(rounds) // 2)
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(1, 41)} | {(61, 60), (62, 60)}


def test_stored_tables_leave_no_freed_memory_with_the_driver(spark):
    jvm = spark.sparkContext._jvm

    def resident():
        with open(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Rss:")) / 1024

    if not common.tidy_driver(spark):
        pytest.skip("this JVM has no such command")
    common.stored(spark.range(3), "first")
    made = [jvm.java.util.zip.Deflater() for _ in range(1500)]
    for i, x in enumerate(made):  # some stay, so that no block of memory is free as a whole
        if i % 8:
            x.end()
    before = resident()
    common.stored(spark.range(3), "again")
    assert before - resident() > 100


def _stages(store):
    found = store.stageList(None, False, False, spark_doubles(store), None)
    return [found.apply(i) for i in range(found.size())]


def spark_doubles(store):
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    return context._gateway.new_array(context._jvm.double, 0)


class Rows:
    """Stands for a table whose tasks' function is wanted."""

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInArrow(self, f, _):
        return f


def asked_of_a_bucket(n, groups, slices=4):
    """Tokens, a few repeated triples and looked up tokens of n in all, as the answering task of one bucket gets them."""
    rng, lm = np.random.default_rng(5), language_model
    names = textvec.mix(np.arange(1, groups + 1, dtype=np.uint64))
    rows = []
    for s in range(slices):
        m = n // slices
        group = names[(rng.random(m) ** 2 * groups).astype(int)]
        far, place, doc = rng.integers(0, 400, m).astype(np.uint32), (rng.random(m) ** 3 * 5000).astype(np.uint16), rng.integers(0, 2000, m).astype(np.uint16) | rng.choice([lm.LEARNED, np.uint16(0)], m)
        order = np.argsort(group)
        group, far, place, doc = group[order], far[order], place[order], doc[order]
        first = lm.runs(group)
        rows.append((0, s, lm.TOKENS, lm._head(len(first), m) + group[first].tobytes() + first.astype(np.uint32).tobytes() + far.tobytes() + place.tobytes() + doc.tobytes()))
        at, k = np.arange(0, m, 50), len(range(0, m, 50))
        rows.append((0, s, lm.TRIPLES, lm._head(k) + group[at].tobytes() + far[at].tobytes() + np.full(k, 70, np.uint32).tobytes() + at.astype(np.uint32).tobytes() + place[at].tobytes()))
    k = n // 20
    word = rng.integers(0, 500, k)
    more = (textvec.mix(word.astype(np.uint64)), names[rng.integers(0, groups, k)], rng.random(500)[word] * 1e-6, np.arange(slices), rng.integers(0, 400, k).astype(np.uint32), rng.integers(0, 3, k).astype(np.uint32), rng.integers(0, slices, k).astype(np.uint32), rng.integers(0, 2000, k).astype(np.uint16))
    rows.insert(0, (0, -1, lm.LOOKED, lm._head(k, slices) + b"".join(x.tobytes() for x in more)))
    bucket, slice_id, kind, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(slice_id, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "slice", "kind", "blob"])


def test_language_model_seats_a_bucket_in_parts(monkeypatch):
    """A task's memory follows its input's bytes, not the seating of a whole bucket; its answers are those of the whole."""
    n, lm = 1_500_000, language_model
    batch = asked_of_a_bucket(n, 3000)
    top = types.SimpleNamespace(value={"top_p": np.full(5000, 1e-4), "n": n, "v": 6000})
    settings = {"d": [0.7, 0.8], "theta": [1.0, 1.0], "burn_in": 1, "kept": 1}

    def answered():
        tracemalloc.start()
        out = list(lm._answered(Rows(), top, settings, 1)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak, [x for b in out for x in zip(*(c.to_pylist() for c in b.columns), strict=True)], out

    peak, got, out = answered()
    assert peak < 90 * n
    monkeypatch.setattr(lm, "PART", 1 << 40)
    peak, want, _ = answered()
    assert peak > 140 * n
    assert len(got) == len(want) == 4 + 4 + 2 * 4 + 1
    for (*x, found), (*y, expected) in zip(got, want, strict=True):
        m = int(np.frombuffer(found[:8], np.int64)[0])
        at, end = (8 + 16 * m, len(found)) if x[1] == lm.HISTOGRAM else (8, 8 + 8 * m)  # where the logarithms are
        assert x == y and found[:at] + found[end:] == expected[:at] + expected[end:]
        np.testing.assert_allclose(np.frombuffer(found[at:end]), np.frombuffer(expected[at:end]), rtol=1e-9)


def test_language_model_hands_over_few_bytes(spark):
    blobs = [bytes(700_000)] * 20 + [bytes(9_000_000), b""]
    out = list(language_model._batches(blobs, bucket=np.arange(22, dtype=np.int32)))
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(22))
    assert max(sum(map(len, b.column(1).to_pylist())) for b in out[:-1]) <= language_model.BATCH_BYTES + 700_000
    assert list(language_model._batches([], bucket=np.zeros(0, np.int32))) == []

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    d = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) as t").mapInArrow(sizes, "n long")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = [r["n"] for r in stored_at(d, "sizes", size=language_model.BATCH_BYTES)[0].collect()]
    assert sum(rows) == 40 and max(rows) <= 5
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_tries_are_counted_in_little_memory():
    """A task's memory is a few times its texts, most of whose terms occur once."""
    rng = np.random.default_rng(4)
    data = rng.choice(np.frombuffer(b"abcdefghijklmnopqrst       ", np.uint8), 1 << 21)
    ends, groups = np.arange(2048, len(data) + 1, 2048), [("en", f"s{i}") for i in range(20)]
    group = rng.integers(0, 20, len(ends)).astype(np.int32)
    tracemalloc.start()
    trie = divergence.Trie.counted(data, ends, group, groups)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(trie.terms) > 150_000 and peak < 20 * len(data)  # 25 when all was kept to the end


def test_few_pieces_are_decoded_and_written_at_a_time(spark, sf_dir, monkeypatch):
    """Stored pieces lie in small row groups, and are scanned a few rows at a time."""
    seen, own = [], common.stored_at
    names = "spark.sql.parquet.columnarReaderBatchSize", "parquet.block.size"

    def noted(df, name, *a, **k):
        seen.append((name, *(int(spark.conf.get(x, "-1")) for x in names)))
        return own(df, name, *a, **k)

    monkeypatch.setattr(common, "stored_at", noted)
    monkeypatch.setattr(divergence, "stored_at", noted)
    before = [spark.conf.get(x, None) for x in names]
    assert divergence.divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=4, best=3, held=20_000, size=500).count() > 0
    found = {name: (rows, group) for name, rows, group in seen}
    assert all(0 < found[x][0] <= 64 and 0 < found[x][1] <= 1 << 24 for x in ("tries", "ranges", "kept", "met"))
    assert [spark.conf.get(x, None) for x in names] == before
