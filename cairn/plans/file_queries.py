"""Queries of sources, sinks and gates that work on files: each derives its files from the given tables, below the shared folder."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import contracts
from cairn.operators.lineage import shared_folder
from cairn.sources import annotated, contract, gates, ledger

from .registry import CELLS, POINTS, Tables, query, r


def put(spark: SparkSession, folder: str, files: dict[str, str]) -> dict[str, str]:
    """Writes small texts and gives the digest of each."""
    annotated.write_files(spark.createDataFrame([(n, t.encode()) for n, t in files.items()], "name string, content binary"), folder)
    return {n: hashlib.sha256(t.encode()).hexdigest() for n, t in files.items()}


def _matrix(t: Tables, path: str, drop: bool = False) -> DataFrame:
    """The embeddings as an annotated matrix: values that are not negative, raw values as a layer, a state, three coordinates."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    c = t("embeddings").select(F.col("vec_id").cast("string").alias("cell"), F.col("vec_id").alias("at"), F.col("label").cast("string").alias("state"), x.alias("raw"), F.transform(x, lambda v: F.greatest(v, F.lit(0.0))).alias("x"), F.slice(x, 1, 3).alias("spatial_3D"))
    annotated.write_matrix(c.drop("raw") if drop else c, [f"g{i}" for i in range(1, 65)], path, ["at"], extra={} if drop else {"raw": "raw"}, uns={"contract": {"normalization": "log1p"}})
    return c


@query(f"WITH {CELLS} SELECT cell::VARCHAR AS cell, state::VARCHAR AS state, list_transform(range(0, 10), lambda i: round(e[20 - i]::DOUBLE, 6) + 0.0) AS x FROM cells")
def s1_s3_annotated_matrix(t: Tables) -> DataFrame:
    """A layer of an annotated matrix, ten genes of it in a panel's order."""
    path = shared_folder(t.spark, "matrix")
    _matrix(t, path)
    panel = t.spark.range(0, 10).select(F.concat(F.lit("g"), (20 - F.col("id")).cast("string")).alias("gene"), (F.col("id") + 1).alias("gene_pos"))
    return annotated.read_matrix(t.spark, path, ["state"], panel, "raw").select("cell", "state", F.transform("x", lambda v: r(v)).alias("x"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS file, 's' || k AS sample, n_name AS probe, CASE WHEN n_nationkey % 3 <> k - 1 THEN n_nationkey * k / 4.0 END AS value FROM nation, range(1, 4) q(k)")
def s15_series_table(t: Tables) -> DataFrame:
    """Series files, one a region, with a metadata line before the table and one after it; every third value is missing."""
    values = [F.when(F.col("n_nationkey") % 3 != k - 1, (F.col("n_nationkey") * k / 4.0).cast("string")).otherwise("null" if k == 2 else "") for k in (1, 2, 3)]
    body = t("nation").select(F.col("n_regionkey").cast("string").alias("file"), (F.col("n_nationkey") + 10).cast("long").alias("line"), F.concat_ws("\t", F.concat(F.lit('"'), "n_name", F.lit('"')), *values).alias("value"))
    frame = [(0, '!Series_title\t"x"'), (1, "!series_matrix_table_begin"), (2, '"ID_REF"\t"s1"\t"s2"\t"s3"'), (1000, "!series_matrix_table_end"), (1001, "!after\ty\tz")]
    edge = t("nation").select(F.col("n_regionkey").cast("string").alias("file")).distinct().select("file", F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("line"), F.lit(v).alias("value")) for n, v in frame))).alias("e")).select("file", "e.*")
    return annotated.series_table(body.unionByName(edge))


@query(f"WITH {CELLS}, n AS (SELECT count(*) AS n FROM cells), c AS (SELECT unnest(['lock', 'index_digest', 'board', 'panel_digest', 'panel_size', 'parent_digest', 'rows_whole', 'gene_order', 'genes_unique', 'gene_count', 'cells_unique', 'cells_named', 'normalization', 'width', 'finite', 'obs_required', 'uns_required', 'obsm_required', 'coordinates_finite', 'coordinates_absent', 'parent_order', 'parent_coordinates', 'round_trip']) AS name, 0 AS bad UNION ALL SELECT 'cell_range', CASE WHEN n BETWEEN 100 AND 100000000 THEN 0 ELSE 1 END FROM n UNION ALL SELECT 'non_negative', (SELECT count(*) FROM (SELECT unnest(e) AS v FROM cells) WHERE v < 0) UNION ALL SELECT 'parent_layers', 1 UNION ALL SELECT 'parent_obs', CASE WHEN (SELECT count(*) FROM cells WHERE cell = 3) > 0 THEN 1 ELSE 0 END) SELECT name, CAST(bad AS BIGINT) AS bad, bad = 0 AS passed FROM c")
def v1_v2_full_contract(t: Tables) -> DataFrame:
    """The whole contract of a candidate with negative values, without its parent's layer and with one other state, against the
    board that its parent is locked to."""
    root = shared_folder(t.spark, "contract")
    parent = _matrix(t, f"{root}/parent")
    state = F.when(F.col("cell") == "3", "other").otherwise(F.col("state"))
    annotated.write_matrix(parent.select("cell", "at", state.alias("state"), F.col("raw").alias("x"), "spatial_3D"), [f"g{i}" for i in range(1, 65)], f"{root}/candidate", ["at"], uns={"contract": {"normalization": "log1p"}})
    panel = put(t.spark, root, {"panel.txt": "".join(f"g{i}\n" for i in range(1, 65))})["panel.txt"]
    board = {"task": "T", "board": "b", "genes_file": "panel.txt", "genes_sha256": panel, "n_genes": 64, "min_cells": 100, "max_cells": 100_000_000, "obs_required": ["state"], "uns_required": ["contract"], "obsm_required": ["spatial_3D"], "needs_coords": True}
    index = put(t.spark, root, {"index.json": json.dumps({"boards": {"T:b": board}})})["index.json"]
    put(t.spark, root, {"lock.json": json.dumps({"index": "index.json", "index_sha256": index})})
    checks = contract.validate(t.spark, f"{root}/candidate", f"{root}/parent", contract.folder_digest(t.spark, f"{root}/parent"), root, "lock.json", "t", "B", "log1p", keeps_coords=True, round_trip=f"{root}/again")
    return checks.select("name", "bad", "passed")


_HASH = "('0x' || substr(md5(c), 1, 7))::BIGINT"


@query(f"WITH RECURSIVE {CELLS}, v AS (SELECT q.kind, cell, CASE WHEN kind = 'swapped' AND cell = 2 THEN 4 WHEN kind = 'swapped' AND cell = 4 THEN 2 ELSE cell END AS place, array_to_string(list_transform(e, lambda x, i: CAST(round(x::DOUBLE * 1000000) + CASE WHEN q.kind = 'changed' AND cell = 5 AND i = 7 THEN 1 ELSE 0 END AS BIGINT)), ',') AS c FROM cells, (VALUES ('same'), ('swapped'), ('changed')) q(kind)), k AS (SELECT kind, c, row_number() OVER (PARTITION BY kind ORDER BY place) - 1 AS i FROM v), p AS (SELECT 0::BIGINT AS i, 1::BIGINT AS b UNION ALL SELECT i + 1, b * 1000003 % 2147483647 FROM p WHERE i < (SELECT count(*) FROM cells)) SELECT kind, count(*) AS rows, CAST(sum({_HASH} % 2147483647 * b % 2147483647) % 2147483647 AS BIGINT) AS digest FROM k JOIN p USING (i) GROUP BY kind")
def v4_ordered_digest(t: Tables) -> DataFrame:
    """The digest of all cells' values in order, as they are, with two cells swapped, and with one value changed by a millionth."""
    kinds = t.spark.sql("SELECT * FROM VALUES ('same'), ('swapped'), ('changed') AS q(kind)")
    one = F.when((F.col("kind") == "changed") & (F.col("cell") == 5), 1).otherwise(0)
    text = F.array_join(F.transform("embedding", lambda v, i: (F.round(v.cast("double") * 1_000_000) + F.when(i == 6, one).otherwise(0)).cast("long").cast("string")), ",")
    at = F.when((F.col("kind") == "swapped") & (F.col("cell") == 2), 4).when((F.col("kind") == "swapped") & (F.col("cell") == 4), 2).otherwise(F.col("cell"))
    rows = t("embeddings").withColumnRenamed("vec_id", "cell").crossJoin(F.broadcast(kinds)).select("kind", at.alias("at"), text.alias("c"))
    out = [contracts.ordered_digest(rows.where(F.col("kind") == k), ["at"], ["c"]).withColumn("kind", F.lit(k)) for k in ("same", "swapped", "changed")]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("kind", "rows", "digest")


@query(f"WITH {POINTS} SELECT unnest(['rows', 'cells', 'states', 'expression', 'neighbours']) AS name, unnest([true, true, true, false, true]) AS kept FROM (SELECT count(*) AS n FROM points) WHERE n > 0")
def v4_rewrite_invariants(t: Tables) -> DataFrame:
    """What a rewrite that halves one value of one cell keeps: all but the expression."""
    m = t.cells().join(t.points().select("cell", *(F.col(c).alias(f"{c}1") for c in "xyz")), "cell")
    least = m.agg(F.min("cell").alias("least"))
    half = m.crossJoin(F.broadcast(least)).withColumn("x", F.when(F.col("cell") == F.col("least"), F.transform("x", lambda v, i: F.when(i == 9, v / 2 + 1).otherwise(v))).otherwise(F.col("x"))).drop("least")
    return contracts.rewrite_invariants(m, half.repartition(5), ["cell"], 4, ["state"]).select("name", "kept")


_PAIRS = "e AS (SELECT DISTINCT 'S' || a.l_suppkey AS src, 'S' || b.l_suppkey AS dst, a.l_returnflag AS flag FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


def snapshot(spark: SparkSession, root: str, name: str, edges: list[tuple], panel: list[str], declared: dict | None = None, changed: str | None = None) -> None:
    """One snapshot below a root: an edge file, its manifest and a panel. ``declared`` overrides what the manifest says;
    ``changed`` replaces the edge file's text after it was digested."""
    text = "\t".join(gates.EDGE_COLUMNS) + "\n" + "".join("\t".join(map(str, e)) + "\n" for e in edges)
    genes = "".join(f"{g}\n" for g in panel)
    met = {g for e in edges for g in e[2:4]} & set(panel)
    doc = {
        "schema_version": "snapshot.v1", "source_name": "pairs", "source_url": "local", "license": "none", "source_query": {"datasets": "d", "organisms": "7", "partners_panel_sha256": hashlib.sha256(genes.encode()).hexdigest()}, "schema": {"organism_taxon_id": 7},
        "data_path": "edges.tsv", "bytes": len(text.encode()), "sha256": hashlib.sha256(text.encode()).hexdigest(), "directed_edges": len(edges), "target_mapping": {"panel_reference": f"{name}/panel.txt", "panel_gene_count": len(panel), "edge_symbols_overlapping_panel": len(met)},
    }
    put(spark, f"{root}/{name}", {"edges.tsv": text if changed is None else changed, "panel.txt": genes, "manifest.json": json.dumps(doc | (declared or {}))})


@query(f"WITH {_PAIRS} SELECT 'good/manifest.json' AS subject, flag AS kind, count(*) AS n, CAST(sum(CASE flag WHEN 'A' THEN 1 WHEN 'R' THEN -1 END) AS BIGINT) AS signs FROM e WHERE src IN ('S1', 'S2', 'S3') GROUP BY flag")
def s21_v5_audited_snapshot(t: Tables) -> DataFrame:
    """Edges of the snapshots that are what their manifests say: of three with one table of edges, one has a changed byte and one
    another taxon."""
    a, b = (t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("at"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias(n), *(["l_returnflag"] if n == "src" else [])) for n in ("src", "dst"))
    pairs = a.join(b.withColumn("at", F.col("at") - 1), ["l_orderkey", "at"]).where(F.col("src").isin("S1", "S2", "S3")).select("src", "dst", "l_returnflag").distinct().orderBy("src", "dst", "l_returnflag").collect()  # the edges of a file
    edges = [(p["src"], p["dst"], p["src"], p["dst"], True, p["l_returnflag"] == "A", p["l_returnflag"] == "R", True, p["l_returnflag"] == "A", p["l_returnflag"] == "R") for p in pairs]
    root, panel = shared_folder(t.spark, "snapshots"), sorted({x for e in edges for x in e[2:4]})
    snapshot(t.spark, root, "good", edges, panel)
    snapshot(t.spark, root, "changed", edges, panel, changed="\t".join(gates.EDGE_COLUMNS) + "\n")
    snapshot(t.spark, root, "other", edges, panel, declared={"schema": {"organism_taxon_id": 8}})
    found = gates.audited_edges(t.spark, root, gates.audit_snapshots(t.spark, root, "snapshot.v1", 7))
    kind = F.when(F.col("is_stimulation"), "A").when(F.col("is_inhibition"), "R").otherwise("N")
    return found.groupBy("subject", kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("sign").cast("long").alias("signs"))


@query("SELECT o_orderpriority, count(*) AS n, 2 AS version, true AS refused FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def z6_k3_versioned_table(t: Tables) -> DataFrame:
    """A table replaced as a whole under a lock; a second writer that has seen the version before is refused."""
    path, orders = shared_folder(t.spark, "table"), t("orders").select("o_orderkey", "o_orderpriority")
    with ledger.lock(t.spark, path, "writer"):
        first = ledger.commit(orders, path, 0)
        ledger.commit(orders.where("o_orderkey % 2 = 0"), path, first)
    try:
        ledger.commit(orders.limit(1), path, first)
        refused = False
    except ledger.Taken:
        refused = True
    now = ledger.version(t.spark, path)
    return ledger.current(t.spark, path).groupBy("o_orderpriority").agg(F.count("*").alias("n")).withColumns({"version": F.lit(now), "refused": F.lit(refused)})


def route_artifact(spark: SparkSession, root: str, passes: dict[str, bool]) -> tuple[gates.Rules, dict]:
    """An artifact folder whose report has one route for each condition, with all files that it is bound to; those that do not pass are
    on hold. Gives the rules and the report, which is written by the caller."""
    rules = gates.Rules("report.v1", "JOIN", "gate.v1", "manifest.v1", ["L1"], {c: ["g1"] for c in passes}, ["ranks"], "ranks", "PASS_RANKS_ONLY")
    routes = []
    for c, good in passes.items():
        texts = {f"{c}/prior.json": json.dumps({"lane": "L1", "condition_ids": [c], "records": [{"condition_id": c}]}), f"{c}/evidence.tsv": f"target\tstate\ng1\t{c}\n", f"{c}/ranks.tsv": "g1\t1\n", f"{c}/source.txt": c}
        sha = put(spark, root, texts)
        listed = [{"path": n, "bytes": len(texts[n].encode()), "sha256": sha[n]} for n in (f"{c}/prior.json", f"{c}/evidence.tsv")]
        manifest = put(spark, root, {f"{c}/files.json": json.dumps({"schema": "manifest.v1", "files": listed})})
        state = {"status": "PASS" if good else "HOLD"}
        routes.append({
            "route_id": f"{c}::L1", "status": "PASS" if good else "HOLD", "blocks_submission": False, "candidate_generation": good, "evidence_paths": [x["path"] for x in listed], "evidence_hashes": {x["path"]: x["sha256"] for x in listed},
            "prior_path": f"{c}/prior.json", "prior_sha256": sha[f"{c}/prior.json"], "evidence_path": f"{c}/evidence.tsv", "evidence_sha256": sha[f"{c}/evidence.tsv"], "artifact_manifest_path": f"{c}/files.json", "artifact_manifest_sha256": manifest[f"{c}/files.json"],
            "source_artifacts": {"s": {"path": f"{c}/source.txt", "sha256": sha[f"{c}/source.txt"]}}, "source_hashes": {"s": sha[f"{c}/source.txt"]}, "blockers": [] if good else ["too few cells"],
            "method_status": {"ranks": {"status": "PASS", "targets": {"g1": {"status": "PASS_RANKS_ONLY", "outputs": [{"path": f"{c}/ranks.tsv", "sha256": sha[f"{c}/ranks.tsv"]}]}}}},
            "state_join_gate": state, "selected_gene_stability": state, "evidence_family_stability": state,
        })
    outcome = "PRIOR_GATE_PASS" if all(passes.values()) else "PARTIAL_ROUTE_PASS" if any(passes.values()) else "HOLD_AS_COMPONENT"
    report = {
        "schema": "report.v1", "task_id": "JOIN", "gate_id": "gate.v1", "outcome": outcome, "status": rules.outcomes[outcome], "criteria": [{"name": "cells", "result": "PASS" if all(passes.values()) else "FAIL"}],
        "candidate_generation": False, "server_submission": False, "blocks_submission": False, "blockers": [], "routes": routes,
    }
    return rules, report


@query("SELECT 'state' || label || '::L1' AS route_id FROM embeddings GROUP BY label HAVING count(*) FILTER (vec_id % 2 = 1) >= count(*) FILTER (vec_id % 2 = 0)")
def v3_route_gate(t: Tables) -> DataFrame:
    """Routes that may be used: those of states with as many cells of stage 1 as of stage 0, from a report bound to its files."""
    g = t.cells().groupBy("state").agg((F.count_if(F.col("stage") == 1) >= F.count_if(F.col("stage") == 0)).alias("good")).orderBy("state").collect()  # a row for each state
    root = shared_folder(t.spark, "routes")
    rules, report = route_artifact(t.spark, root, {f"state{x['state']}": x["good"] for x in g})
    put(t.spark, root, {"gate_report.json": json.dumps(report)})
    return gates.active_routes(t.spark, root, gates.audit_routes(t.spark, root, rules)).select("route_id")
