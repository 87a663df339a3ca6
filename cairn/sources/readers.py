"""Readers of text formats. Each takes lines as ``spark.read.text`` gives them (``value``), so that any store will do; where
order matters there is a ``line`` number. Sinks write once, and are read back and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.ranks import row_numbers
from pyspark.sql.window import Window


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, line of a text file: partitions of one file are in order, and so are their ids."""
    return spark.read.text(path).withColumn("line", F.monotonically_increasing_id())


def table(spark: SparkSession, path: str, schema: str, separator: str = "\t", comment: str | None = None) -> DataFrame:
    """A separated file with a header; a line that doesn't fit the schema is an error."""
    reader = spark.read.schema(schema).option("header", True).option("sep", separator).option("mode", "FAILFAST")
    return (reader.option("comment", comment) if comment else reader).csv(path)


def receipts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def panel(lines: DataFrame) -> DataFrame:
    """gene, gene_pos of a list of one symbol a line, with how often each occurs (1 in a sound panel)."""
    rows = lines.select(F.trim("value").alias("gene"), "line").where("gene <> ''")
    n = rows.groupBy("gene").agg(F.count("*").alias("occurs"))
    return row_numbers(rows.join(n, "gene"), ["line"], "gene_pos").select("gene", (F.col("gene_pos") + 1).alias("gene_pos"), "occurs")


def aligned(entries: DataFrame, names: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries in the panel's order; genes that the panel lacks go. names: gene_pos, gene; wanted: gene, gene_pos."""
    target = wanted.select("gene", F.col("gene_pos").alias("target"))
    mapping = names.join(target, "gene").select(F.col("gene_pos").alias("gene"), "target")
    return entries.join(mapping, "gene").drop("gene").withColumnRenamed("target", "gene")


def matrix_market(lines: DataFrame, nnz: int | None = None) -> DataFrame:
    """row, col, value of coordinate lines; comments go. If there are fewer than announced, so does the last column,
    which a cut file holds in part."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("%")).select(*(F.get(parts, F.lit(i)).try_cast(kind).alias(n) for i, (n, kind) in enumerate((("row", "long"), ("col", "long"), ("v", "double")))))
    rows = rows.where("row is not null and col is not null and v is not null")
    if nnz is None:
        return rows
    whole = rows.agg(F.count("*").alias("_n"), F.max("col").alias("_last"))
    return rows.crossJoin(F.broadcast(whole)).where((F.col("_n") >= nnz) | (F.col("col") < F.col("_last"))).drop("_n", "_last")


def column_filtered(entries: DataFrame, kept: DataFrame) -> DataFrame:
    """Entries of kept columns (col), renumbered from 1 in their order. Kept columns are numbered by one window over them."""
    number = kept.select("col").distinct().withColumn("new", F.row_number().over(Window.orderBy("col")).cast("long"))
    return entries.join(number, "col").drop("col").withColumnRenamed("new", "col")


def in_bounds(entries: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """One row of checks: entries out of bounds, negative ones, repeated places."""
    places = entries.groupBy("row", "col").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    bad = ~F.col("row").between(1, n_rows) | ~F.col("col").between(1, n_cols)
    return places.agg(F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("out_of_bounds"), F.count_if(F.col("low") < 0).alias("negative"), F.count_if(F.col("n") > 1).alias("repeated"))


def blocks(lines: DataFrame, marker: str, by: list[str], order: str = "line") -> DataFrame:
    """Lines after a marker line belong to its block: the last marker before, carried forward within a file."""
    name = F.regexp_extract("value", rf"^{marker}\s*=\s*(.*)$", 1)
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("value").rlike(rf"^{marker}\s*=")
    return lines.withColumn("block", F.last(F.when(head, name), ignorenulls=True).over(w)).where(~head & F.col("block").isNotNull())


def start_sites(features: DataFrame) -> DataFrame:
    """Per gene the start of transcription: the least start on the plus strand, the largest end on the minus one.

    features: chrom, start, end, strand, attributes.
    """
    gene = F.regexp_extract("attributes", 'gene_name "([^"]+)"', 1)
    rows = features.select("chrom", "start", "end", "strand", gene.alias("gene")).where("gene <> ''")
    g = rows.groupBy("gene").agg(F.min("chrom").alias("chrom"), F.min("strand").alias("strand"), F.min("start").alias("low"), F.max("end").alias("high"))
    return g.select("gene", "chrom", "strand", F.when(F.col("strand") == "-", F.col("high")).otherwise(F.col("low")).alias("tss"))


def interval_means(intervals: DataFrame, windows: DataFrame, bin_size: int) -> DataFrame:
    """Length-weighted mean of intervals over each window, by bins of fixed size as the key of the range join.

    intervals: chrom, start, end, value; windows: name, chrom, start, end; half open.
    """
    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))

    a = spread(intervals).select("chrom", "bin", F.col("start").alias("s"), F.col("end").alias("e"), "value")
    rows = spread(windows).join(a, ["chrom", "bin"])
    low = F.greatest("start", "s", F.col("bin") * bin_size)
    high = F.least("end", "e", (F.col("bin") + 1) * bin_size)
    rows = rows.withColumn("length", high - low).where("length > 0")
    return rows.groupBy("name").agg((F.sum(F.col("value") * F.col("length")) / F.sum("length")).alias("mean"), F.max("value").alias("top"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256 of files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def locked(found: DataFrame, expected: DataFrame) -> DataFrame:
    """name, status of files against a manifest: OK, CHANGED, MISSING or EXTRA."""
    both = expected.select("name", F.col("sha256").alias("want")).join(found.select("name", F.col("sha256").alias("got")), "name", "full")
    status = F.when(F.col("got").isNull(), "MISSING").when(F.col("want").isNull(), "EXTRA").when(F.col("got") == F.col("want"), "OK").otherwise("CHANGED")
    return both.select("name", status.alias("status"))


def published(df: DataFrame, path: str) -> DataFrame:
    """Written once - an existing target is an error - read back, and compared with what was to be written."""
    from cairn.operators.contracts import set_difference

    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    lost = set_difference(df, back, "lost", "added").first()
    if lost["lost"] or lost["added"]:
        raise ValueError(f"{path}: {lost['lost']} rows lost, {lost['added']} added")
    return back


def archived(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """archive, name, text of the members of zip and tar archives whose name matches; archives inside archives are opened."""
    import re

    def members(batches):
        import io
        import tarfile
        import zipfile

        import pandas as pd

        def walk(content: bytes, archive: str):
            stream = io.BytesIO(content)
            if zipfile.is_zipfile(stream):
                z = zipfile.ZipFile(stream)
                inner = [(n, z.read(n)) for n in z.namelist()]
            else:
                try:
                    t = tarfile.open(fileobj=io.BytesIO(content))
                except tarfile.ReadError:
                    return
                inner = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
            for name, data in inner:
                if re.search(r"\.(zip|tar|tgz|tar\.gz)$", name):
                    yield from walk(data, archive)
                elif re.search(pattern, name):
                    yield archive, name, data.decode("utf-8", "replace")

        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"], strict=True) for r in walk(c, p.rsplit("/", 1)[-1])]
            yield pd.DataFrame(rows, columns=["archive", "name", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, name string, text string")


def replaced(df: DataFrame, path: str, kind: str = "csv", sep: str = "\t") -> str:
    """Text rows (csv with a header, or json) written beside ``path`` and then put in its place: never a part, but for
    a moment between two renames nothing. Where readers can't wait, use ``ledger.commit``. Fails, with the old files kept, if
    the rows can't be written."""
    import uuid

    spark = df.sparkSession
    path = path.rstrip("/")
    fresh, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    writer = df.write.option("sep", sep).option("header", True) if kind == "csv" else df.write
    writer.format(kind).save(fresh)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target) and not files.rename(target, hadoop(old)):
        raise OSError(f"{path} can't be moved")
    if not files.rename(hadoop(fresh), target):
        files.rename(hadoop(old), target)
        raise OSError(f"{fresh} can't be moved")
    files.delete(hadoop(old), True)
    return path


def provenance(out: DataFrame, parent: DataFrame, name: str, parent_name: str, out_order: list[str], parent_order: list[str]) -> DataFrame:
    """The ledger of rows: out_row, parent_row (null without a parent), out_name, parent_name. ``parent_name`` is a column of both."""
    a = row_numbers(out.select(F.col(name).alias("out_name"), F.col(parent_name).alias("parent_name"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(out_order))), [f"_o{i}" for i in range(len(out_order))], "out_row")
    b = row_numbers(parent.select(F.col(parent_name).alias("parent_name"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(parent_order))), [f"_o{i}" for i in range(len(parent_order))], "parent_row")
    return a.join(b.select("parent_name", "parent_row"), "parent_name", "left").select("out_row", "parent_row", "out_name", "parent_name")


def submission(cells: DataFrame, panel: list[str], path: str, genes: list[str] | None = None, coords: str | None = None) -> DataFrame:
    """A table of cells (cell, state, x and, if named, ``coords``; further columns go) as it is handed in, written once.

    ``genes``: the genes of x, if they aren't the panel's; x is put in the panel's order, genes beyond it go, one that is lacking
    or there twice is an error. Names that repeat get their number. Values are checked against the panel's length and sign,
    coordinates for three finite numbers.
    """
    kept = ["cell", "state", "x", *([coords] if coords else [])]
    rows = cells.select(*kept)
    if genes is not None:
        places = [[i for i, g in enumerate(genes) if g == name] for name in panel]
        lacking = [g for g, at in zip(panel, places, strict=True) if len(at) != 1]
        if lacking:
            raise ValueError(f"genes that the cells lack or have twice: {lacking[:10]}")
        if rows.where(F.coalesce(F.size("x") != len(genes), F.lit(True))).limit(1).count():
            raise ValueError("rows that don't fit the panel")
        order = F.array(*(F.lit(at[0]) for at in places))
        rows = rows.withColumn("x", F.transform(order, lambda i: F.get("x", i)))
    again = F.row_number().over(Window.partitionBy("cell").orderBy("state", "x"))
    named = rows.withColumn("_k", again)
    rows = named.select(F.when(F.col("_k") > 1, F.concat_ws("-", F.col("cell").cast("string"), (F.col("_k") - 1).cast("string"))).otherwise(F.col("cell").cast("string")).alias("cell"), *kept[1:])
    wrong = rows.where((F.size("x") != len(panel)) | F.coalesce(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (v < 0)), F.lit(True)))
    if wrong.limit(1).count():
        raise ValueError("rows that don't fit the panel")
    if coords and rows.where(F.coalesce((F.size(coords) < 3) | F.exists(F.slice(coords, 1, 3), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))).limit(1).count():
        raise ValueError("rows without three finite coordinates")
    return published(rows, path)
