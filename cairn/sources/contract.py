"""The whole contract of a candidate matrix: what the locked board asks for, and what may not differ from the locked parent.

A lock names an index of boards and the digest of its bytes; the index names for each board its panel file, that file's digest
and what cells, metadata and coordinates it needs. Candidate and parent are annotated matrices (folders). Everything about rows
is gathered in one pass over each, as counts and as sums of hashes that carry the row's place; what reaches the driver is one row.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import annotated, gates

LOCK = "index string, index_sha256 string"
BOARD = (
    "task string, board string, genes_file string, genes_sha256 string, n_genes long, min_cells long, max_cells long, obs_required array<string>, "
    "uns_required array<string>, obsm_required array<string>, needs_coords boolean"
)


@dataclass
class Checks:
    """Results by name: how much is wrong, and what."""

    rows: list[tuple[str, int, str]] = field(default_factory=list)

    def add(self, name: str, bad, detail: str = "") -> bool:
        self.rows.append((name, int(bad), detail[:500]))
        return not bad

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "name string, bad long, detail string").withColumn("passed", F.col("bad") == 0)


def folder_digest(spark: SparkSession, root: str) -> str:
    """One digest of the names and bytes of all files of a folder."""
    files = gates.digests(spark, root).where(~F.col("path").rlike(r"(^|/)[._]")).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "path", "sha256"))).alias("f"))
    return files.select(F.sha2(F.array_join("f", "\n"), 256)).first()[0]


def _hashes(*columns: str | Column) -> Column:
    """A sum of hashes that is the same whatever the partitions."""
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0))


def _coords(m: DataFrame, name: str) -> Column:
    return F.col(name).cast("array<double>") if name in m.columns else F.lit(None).cast("array<double>")


def gathered(m: DataFrame, width: int, obs: list[str], coords: list[str], coords_name: str) -> Row:
    """All that is asked of a matrix's rows (row, cell, x, further columns), in one pass."""
    wrong = lambda f: F.coalesce(F.sum(F.size(F.filter("x", f))), F.lit(0))
    place = lambda c: F.count_if(F.coalesce((F.size(c) < 3) | F.exists(F.slice(c, 1, 3), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True)))
    return m.agg(
        F.count("*").alias("n"), F.coalesce(F.max("row") + 1, F.lit(0)).alias("last"), F.count_if(F.trim(F.coalesce(F.col("cell").cast("string"), F.lit(""))) == "").alias("unnamed"),
        F.count_if(F.coalesce(F.size("x") != width, F.lit(True))).alias("width"), wrong(lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("not_finite"), wrong(lambda v: v < 0).alias("negative"),
        _hashes("row", "cell").alias("order"), _hashes("row", *obs).alias("obs") if obs else F.lit(0).alias("obs"), _hashes("row", "x").alias("values"), _hashes("row", _coords(m, coords_name)).alias("coords"),
        *(place(_coords(m, c)).alias(f"bad_{c}") for c in coords),
    ).first()


def layer_digest(spark: SparkSession, path: str, layer: str | None) -> tuple:
    """Number and digest of a layer's stored values."""
    e = annotated.entries(spark, path, layer).where("v <> 0")
    return tuple(e.agg(F.count("*"), _hashes("row", "gene_pos", "v")).first())


def _document(spark: SparkSession, root: str, name: str | None, schema: str) -> tuple[Row | None, str | None]:
    """A JSON file below a root as a row, and its digest; nothing for a name that leaves the root or isn't there."""
    if not name or not spark.range(1).select(gates.safe(F.lit(name))).first()[0]:
        return None, None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None, None
    r = spark.read.format("binaryFile").load(path.toString()).select(F.from_json(F.decode("content", "UTF-8"), schema).alias("doc"), F.sha2("content", 256).alias("sha"), "content").first()
    return r["doc"], r["sha"]


def validate(spark: SparkSession, candidate: str, parent: str, parent_sha256: str, root: str, lock: str, task: str, board: str, normalization: str, coords: str = "spatial_3D", keeps_coords: bool = False, round_trip: str | None = None) -> DataFrame:
    """name, bad, detail, passed of every check; a check that can't be made for want of another is counted as failed.

    ``root`` holds the lock, the index and panel files. ``normalization`` must stand in the candidate's metadata as
    ``contract.normalization``. ``keeps_coords``: the parent's coordinates may not change. ``round_trip``: a new folder to which the
    candidate is written and read back.
    """
    out = Checks()
    lock_doc, _ = _document(spark, root, lock, LOCK)
    out.add("lock", lock_doc is None)
    index, index_sha = _document(spark, root, lock_doc and lock_doc["index"], f"boards map<string, struct<{', '.join(p.replace(' ', ': ', 1) for p in BOARD.split(', '))}>>")
    out.add("index_digest", index is None or index_sha != lock_doc["index_sha256"])
    mine = [(k, b) for k, b in ((index and index["boards"]) or {}).items() if (b["task"] or "").upper() == task.upper() and (b["board"] or "").lower() == board.lower()]
    if not out.add("board", len(mine) != 1, ", ".join(k for k, _ in mine)):
        return out.table(spark)
    rule = mine[0][1]
    panel_row, panel_sha = _document(spark, root, rule["genes_file"], "x string")
    panel = []
    if panel_sha:
        panel = [g for g in (r["value"].strip() for r in spark.read.option("wholetext", True).text(f"{root.rstrip('/')}/{rule['genes_file']}").selectExpr("explode(split(value, '\\n')) AS value").collect()) if g]
    out.add("panel_digest", panel_sha is None or panel_sha != rule["genes_sha256"])
    out.add("panel_size", not panel or rule["n_genes"] not in (None, len(panel)), f"{len(panel)} genes, {rule['n_genes']} declared")
    out.add("parent_digest", folder_digest(spark, parent) != parent_sha256)

    genes = [r["gene"] for r in spark.read.parquet(f"{candidate.rstrip('/')}/var.parquet").orderBy("gene_pos").collect()]  # a panel's length
    uns = annotated.read_uns(spark, candidate)
    m, p = annotated.read_matrix(spark, candidate), annotated.read_matrix(spark, parent)
    missing = lambda want, have: sorted(set(want or []) - set(have))
    needed = [c for c in rule["obsm_required"] or [] if c in m.columns]
    obs = [c for c in m.columns if c not in ("row", "x", coords)]
    both = [c for c in obs if c in p.columns]
    got, old = gathered(m, len(panel), both, needed, coords), gathered(p, len(panel), both, [], coords)
    low, high = rule["min_cells"], rule["max_cells"]
    out.add("cell_range", not (low or 0) <= got["n"] <= (high if high is not None else got["n"]), f"{got['n']} cells, {low} to {high}")
    out.add("rows_whole", got["n"] != got["last"], f"{got['n']} rows, numbered up to {got['last']}")
    out.add("gene_order", sum(a != b for a, b in zip(genes, panel, strict=False)) + abs(len(genes) - len(panel)), f"missing {missing(panel, genes)[:10]}, extra {missing(genes, panel)[:10]}")
    out.add("genes_unique", len(genes) - len(set(genes)))
    out.add("gene_count", abs(len(genes) - len(panel)))
    out.add("cells_unique", got["n"] - m.select("cell").distinct().count())
    out.add("cells_named", got["unnamed"])
    out.add("normalization", (uns.get("contract") or {}).get("normalization") != normalization)
    out.add("width", got["width"])
    out.add("finite", got["not_finite"])
    out.add("non_negative", got["negative"])
    for name, want, have in (("obs_required", rule["obs_required"], m.columns), ("uns_required", rule["uns_required"], uns), ("obsm_required", rule["obsm_required"], m.columns)):
        out.add(name, len(missing(want, have)), ", ".join(missing(want, have)))
    out.add("coordinates_finite", sum(got[f"bad_{c}"] for c in needed))
    asks = rule["needs_coords"] if rule["needs_coords"] is not None else bool(rule["obsm_required"])
    out.add("coordinates_absent", not asks and coords in m.columns)
    out.add("parent_order", got["order"] != old["order"] or got["n"] != old["n"])
    out.add("parent_obs", sorted(obs) != sorted(c for c in p.columns if c not in ("row", "x", coords)) or got["obs"] != old["obs"])
    same_layers = annotated.layers(spark, candidate) == annotated.layers(spark, parent)
    out.add("parent_layers", not same_layers or any(layer_digest(spark, candidate, n) != layer_digest(spark, parent, n) for n in annotated.layers(spark, parent)))
    out.add("parent_coordinates", keeps_coords and (coords not in m.columns or got["coords"] != old["coords"]))
    if round_trip is not None:
        annotated.write_matrix(m, genes, round_trip, ["row"], uns=uns)
        back = gathered(annotated.read_matrix(spark, round_trip), len(panel), both, [], coords)
        out.add("round_trip", any(back[c] != got[c] for c in ("n", "order", "obs", "values", "coords")))
    return out.table(spark)


def bound_report(checks: DataFrame, subject: str) -> str:
    """The checks as a JSON report: what was wrong by name, and whether all passed."""
    rows = {r["name"]: {"bad": r["bad"], "detail": r["detail"], "passed": r["passed"]} for r in checks.collect()}  # some twenty
    return json.dumps({"subject": subject, "passed": functools.reduce(lambda a, r: a and r["passed"], rows.values(), True), "checks": rows}, sort_keys=True)
