"""Readers of text formats and sinks, on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cairn.sources import readers


def write(path, text):
    path.write_text(text)
    return str(path)


def test_tables_with_comments_and_strict_schema(spark, tmp_path):
    path = write(tmp_path / "a.tsv", "# note\nk\tv\n1\tx\n2\ty\n")
    assert [tuple(r) for r in readers.table(spark, path, "k int, v string", comment="#").orderBy("k").collect()] == [(1, "x"), (2, "y")]
    bad = write(tmp_path / "b.tsv", "k\tv\nno\tx\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.table(spark, bad, "k int, v string").collect()


def test_receipts(spark, tmp_path):
    path = write(tmp_path / "r.json", json.dumps({"schema": "gate/1", "hashes": {"a": "x"}}, indent=1))
    row = readers.receipts(spark, path, "schema string, hashes map<string,string>").first()
    assert row["schema"] == "gate/1" and row["hashes"] == {"a": "x"}


def test_panel_keeps_order_and_counts(spark, tmp_path):
    lines = readers.numbered_lines(spark, write(tmp_path / "p.txt", "g2\ng1\n\ng3\ng1\n"))
    rows = readers.panel(lines).orderBy("gene_pos").collect()
    assert [(r["gene"], r["occurs"]) for r in rows] == [("g2", 1), ("g1", 2), ("g3", 1), ("g1", 2)]


def test_matrix_market_truncation_and_filter(spark, tmp_path):
    lines = readers.numbered_lines(spark, write(tmp_path / "m.mtx", "%%MatrixMarket\n%c\n1 1 2\n2 1 3\n1 2 4\n9 3 5\n2 3"))
    assert readers.matrix_market(lines).count() == 4
    cut = readers.matrix_market(lines, nnz=5)
    assert sorted(tuple(r) for r in cut.collect()) == [(1, 1, 2.0), (1, 2, 4.0), (2, 1, 3.0)]
    kept = readers.column_filtered(cut, cut.where("col = 2").select("col"))
    assert [(r["row"], r["col"], r["v"]) for r in kept.collect()] == [(1, 1, 4.0)]
    assert tuple(readers.in_bounds(readers.matrix_market(lines), 5, 5).first()) == (1, 0, 0)


def test_blocks_and_start_sites(spark, tmp_path):
    lines = readers.numbered_lines(spark, write(tmp_path / "s.soft", "x\n^SAMPLE = A\n!a\n!b\n^SAMPLE = B\n!c\n")).withColumn("f", F.lit(1))
    got = {r["block"]: r["n"] for r in readers.blocks(lines, r"\^SAMPLE", ["f"]).groupBy("block").agg(F.count("*").alias("n")).collect()}
    assert got == {"A": 2, "B": 1}
    features = spark.createDataFrame([("c1", 5, 9, "-", 'gene_name "G";'), ("c1", 2, 7, "-", 'gene_name "G";'), ("c1", 1, 2, "+", 'x "y";')], "chrom string, start int, end int, strand string, attributes string")
    assert [tuple(r) for r in readers.start_sites(features).collect()] == [("G", "c1", "-", 9)]


def test_manifest_and_lock(spark, tmp_path):
    d = tmp_path / "files"
    d.mkdir()
    for name, text in (("a", "1"), ("b", "2")):
        (d / name).write_text(text)
    found = readers.manifest(spark, str(d)).collect()
    want = spark.createDataFrame([(r["name"], r["sha256"]) for r in found] + [("c", "0")], "name string, sha256 string")
    (d / "b").write_text("3")
    (d / "e").write_text("4")
    got = {r["name"]: r["status"] for r in readers.locked(readers.manifest(spark, str(d)), want).collect()}
    assert got == {"a": "OK", "b": "CHANGED", "c": "MISSING", "e": "EXTRA"}


def test_published_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, s string")
    assert readers.published(df, str(tmp_path / "out")).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        readers.published(df, str(tmp_path / "out"))


def test_nested_archive(spark, tmp_path):
    import io
    import zipfile

    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("meta/cells.csv", "k,v\n1,2\n")
        z.writestr("other.bin", "x")
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.writestr("deep.zip", inner.getvalue())
    rows = readers.archived(spark, str(tmp_path / "outer.zip"), r"cells\.csv$").collect()
    assert [tuple(r) for r in rows] == [("outer.zip", "meta/cells.csv", "k,v\n1,2\n")]


@pytest.mark.parametrize(("kind", "read"), [("csv", lambda spark, p: readers.table(spark, p, "a int, b string")), ("json", lambda spark, p: spark.read.schema("a int, b string").json(p))])
def test_replaced_files_are_whole(spark, tmp_path, kind, read):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([(i, f"x{i}") for i in range(20)], "a int, b string")
    readers.replaced(first, path, kind)
    assert sorted(map(tuple, read(spark, path).collect())) == sorted(map(tuple, first.collect()))
    readers.replaced(first.where("a = 3"), path, kind)
    assert [tuple(r) for r in read(spark, path).collect()] == [(3, "x3")]
    with pytest.raises(Exception, match="(?i)zero"):
        readers.replaced(first.selectExpr("a div (a - 5) as a", "b"), path, kind)
    assert [tuple(r) for r in read(spark, path).collect()] == [(3, "x3")]
    assert [x.name for x in tmp_path.iterdir() if x.name.endswith(".old")] == []


def test_row_numbers_are_whole_and_in_order(spark):
    rows = spark.range(0, 500).selectExpr("cast((id * 37) % 101 as int) as v", "id").repartition(7)
    got = [(r["row"], r["v"], r["id"]) for r in readers.row_numbers(rows, ["v", "id"]).orderBy("row").collect()]
    assert [g[0] for g in got] == list(range(500)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert readers.row_numbers(rows.limit(0), ["v", "id"]).count() == 0


def test_submission_is_checked_and_written_once(spark, tmp_path):
    cells = spark.createDataFrame([("c", "a", [0.0, 1.0]), ("c", "b", [2.0, 0.0]), ("d", "a", [1.0, 1.0])], "cell string, state string, x array<double>")
    assert {r["cell"] for r in readers.submission(cells, ["g1", "g2"], str(tmp_path / "s")).collect()} == {"c", "c-1", "d"}
    with pytest.raises(Exception, match="(?i)exists"):
        readers.submission(cells, ["g1", "g2"], str(tmp_path / "s"))
    for bad in ([-1.0, 0.0], [1.0], [float("nan"), 0.0], [None, 1.0], None):
        with pytest.raises(ValueError, match="panel"):
            readers.submission(spark.createDataFrame([("c", "a", bad)], cells.schema), ["g1", "g2"], str(tmp_path / "t"))
