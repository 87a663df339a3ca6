"""Annotated matrices as folders of files that any Hadoop store holds, read with only the layers and columns asked for.

    obs.parquet        one row a cell: ``row`` (its place), ``cell``, further columns, coordinates as arrays
    var.parquet        one row a gene: ``gene_pos`` (from 1), ``gene``, further columns
    X/, layers/<name>  blocks of consecutive rows as NumPy archives with the members data, indices, indptr (CSR), start (the
                       first row) and shape (rows, genes)
    uns.json           free metadata

A block is one row of a task's input and should hold some ten MB. Blocks are written by ``write_matrix`` and can come from any
tool that saves CSR arrays. Reading a layer opens the files of that layer alone.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _folder(path: str, layer: str | None) -> str:
    return f"{path.rstrip('/')}/{'X' if layer is None else 'layers/' + layer}"


def _block(content: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """First row, row starts, genes from 1, values of a block; a block that contradicts itself is an error."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        data, indices, indptr, shape, start = (np.asarray(z[k]) for k in ("data", "indices", "indptr", "shape", "start"))
    rows, genes = (int(v) for v in shape)
    if len(indptr) != rows + 1 or indptr[-1] != len(data) or len(data) != len(indices) or (np.diff(indptr) < 0).any() or len(indices) and not 0 <= indices.min() <= indices.max() < genes:
        raise ValueError("a block's arrays don't fit each other")
    return int(start), indptr, indices.astype(np.int64) + 1, data.astype(float)


def layers(spark: SparkSession, path: str) -> list[str]:
    """Names of the layers beside X."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/layers")
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(hadoop)) if files.exists(hadoop) else []


def entries(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """row, gene_pos, v of the stored values of X or of a layer."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                start, indptr, genes, values = _block(content.as_py())
                at = np.repeat(np.arange(start, start + len(indptr) - 1), np.diff(indptr))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(genes), pa.array(values)], ["row", "gene_pos", "v"])

    blocks = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(_folder(path, layer)).select("content")
    return blocks.mapInArrow(rows, "row long, gene_pos long, v double")


def read_matrix(spark: SparkSession, path: str, columns: list[str] | None = None, panel: DataFrame | None = None, layer: str | None = None) -> DataFrame:
    """row, cell, the asked-for columns of obs (all, if not named) and x: the layer's values, 0 where nothing is stored.

    ``panel`` (gene, gene_pos): its genes in its order instead of the matrix's own; genes that the matrix lacks are an error, as
    are genes that it has twice. Whole rows are put together in the task that reads their block, without a shuffle.
    """
    root = path.rstrip("/")
    var = spark.read.parquet(f"{root}/var.parquet").select("gene_pos", "gene").collect()  # the genes: some ten thousand
    width = len(var)
    if panel is None:
        wanted = np.arange(1, width + 1)
    else:
        where: dict = {}
        for r in var:
            where.setdefault(r["gene"], []).append(r["gene_pos"])
        names = [r["gene"] for r in panel.select("gene", "gene_pos").orderBy("gene_pos").collect()]
        bad = [g for g in names if len(where.get(g, [])) != 1]
        if bad:
            raise ValueError(f"genes that the matrix lacks or has twice: {bad[:10]}")
        wanted = np.array([where[g][0] for g in names], np.int64)
    target = np.full(width + 1, -1)
    target[wanted] = np.arange(len(wanted))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                start, indptr, genes, values = _block(content.as_py())
                out = np.zeros((len(indptr) - 1, len(wanted)))
                at, to = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr)), target[genes]
                np.add.at(out, (at[to >= 0], to[to >= 0]), values[to >= 0])
                ends = pa.array(np.arange(0, out.size + 1, max(len(wanted), 1))[: len(out) + 1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(out))), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["row", "x"])

    blocks = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(_folder(path, layer)).select("content")
    obs = spark.read.parquet(f"{root}/obs.parquet")
    keep = obs.columns if columns is None else ["row", "cell", *(c for c in columns if c not in ("row", "cell"))]
    return obs.select(*keep).join(blocks.mapInArrow(rows, "row long, x array<double>"), "row")


def read_uns(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(f"{path.rstrip('/')}/uns.json").collect()))


def write_matrix(cells: DataFrame, genes: list[str], path: str, order: list[str], x: str = "x", extra: dict[str, str] | None = None, uns: dict | None = None, block_rows: int = 4096) -> str:
    """Writes a table of cells (cell, an array ``x``, further columns) as an annotated matrix, rows in ``order``.

    ``extra`` names columns with arrays that become layers. Nothing that exists is overwritten. Rows are numbered by ranges of
    the order; each block of rows is encoded in one task and written by Spark as one file.
    """
    from cairn.operators.lineage import settled
    from cairn.operators.ranks import row_numbers

    spark, root, extra = cells.sparkSession, path.rstrip("/"), extra or {}
    rows = settled(row_numbers(cells, order, "row"))
    arrays = [x, *extra.values()]
    wrong = F.lit(False)
    for c in arrays:
        wrong = wrong | F.coalesce(F.size(c) != len(genes), F.lit(True))
    if rows.where(wrong).limit(1).count():
        raise ValueError("rows whose length isn't that of the genes")
    rows.drop(*arrays).write.parquet(f"{root}/obs.parquet")
    spark.createDataFrame([(i + 1, g) for i, g in enumerate(genes)], "gene_pos long, gene string").coalesce(1).write.parquet(f"{root}/var.parquet")
    width = len(genes)

    def encode(key, table):
        table = table.sort_by("row")
        values = np.array(table["v"].to_pylist(), float).reshape(table.num_rows, width)
        at, gene = np.nonzero(values)
        stream = io.BytesIO()
        np.savez_compressed(stream, data=values[at, gene], indices=gene, indptr=np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(values)))]), shape=np.array(values.shape), start=np.int64(table["row"][0].as_py()))
        return pa.table({"name": [f"block-{key[0].as_py():08d}.npz"], "content": pa.array([stream.getvalue()], pa.binary())})

    for layer, column in [(None, x), *extra.items()]:
        blocks = rows.select("row", F.col(column).alias("v"), F.floor(F.col("row") / block_rows).alias("block")).groupBy("block").applyInArrow(encode, "name string, content binary")
        write_files(blocks, _folder(root, layer))
    write_files(spark.createDataFrame([("uns.json", json.dumps(uns or {}).encode())], "name string, content binary"), root)
    return root


def write_files(files: DataFrame, folder: str) -> None:
    """Rows of name, content as files of a folder, one each, none overwritten: the executors give their rows to the driver's file
    system one by one, so no more than a row is held here."""
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in files.toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['name']}")
        stream = target.getFileSystem(conf).create(target, False)
        try:
            stream.write(r["content"])
        finally:
            stream.close()


def series_table(lines: DataFrame) -> DataFrame:
    """sample, probe, value of a series-matrix file's table: what lies between its begin and end lines, a header of samples first.

    lines: file, line, value. Fields are quoted or not; missing and non-numeric values are null. Each sample's number in the
    header is joined to the fields of each line, so files of any number of lines are read line by line.
    """
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.when(F.lower("value").startswith("!series_matrix_table_begin"), F.col("line"))).over(w)
    ended = F.max(F.when(F.lower("value").startswith("!series_matrix_table_end"), F.col("line"))).over(w)
    inside = lines.withColumns({"_b": begun, "_e": ended}).where(F.col("_b").isNotNull() & (F.col("line") > F.col("_b")) & F.coalesce(F.col("_e") < F.col("_b"), F.lit(True)))
    inside = inside.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("line")))
    fields = F.transform(F.split("value", "\t"), lambda v: F.regexp_replace(F.trim(v), '^"|"$', ""))
    cells = inside.select("file", "_n", fields.alias("_f")).select("file", "_n", F.col("_f")[0].alias("probe"), F.posexplode(F.slice("_f", 2, F.greatest(F.size("_f") - 1, F.lit(0)))).alias("_i", "_v"))
    header = cells.where("_n = 1").select("file", "_i", F.col("_v").alias("sample"))
    return cells.where("_n > 1").join(header, ["file", "_i"]).select("file", "sample", "probe", F.expr("try_cast(nullif(nullif(_v, ''), 'null') AS DOUBLE)").alias("value"))
