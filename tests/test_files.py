"""Annotated matrices, ledgers, contracts and gates on files: what is kept, and each thing that is refused."""

from __future__ import annotations

import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.operators import contracts
from cairn.plans import file_queries as fq
from cairn.sources import annotated, contract, gates, ledger, readers


def mini(spark, path, x=((1.0, 2.0, 99.0), (1.0, 2.0, 99.0)), cells=("c1", "c2"), states=("A", "A"), genes=("g1", "g2", "unused"), coords=((0.0, 1.0, 2.0), (3.0, 4.0, 5.0)), uns=None, layer=True, **options):
    rows = [(i, c, s, list(map(float, v)), [2 * float(y) for y in v], list(p) if p is not None else None) for i, (c, s, v, p) in enumerate(zip(cells, states, x, coords, strict=True))]
    df = spark.createDataFrame(rows, "at long, cell string, celltype string, x array<double>, counts array<double>, spatial_3D array<double>")
    if all(p is None for p in coords):
        df = df.drop("spatial_3D")
    df = df if layer else df.drop("counts")
    return annotated.write_matrix(df, list(genes), str(path), ["at"], extra={"counts": "counts"} if layer else {}, uns=uns if uns is not None else {"contract": {"normalization": "log1p"}}, **options)


# Annotated matrices


def test_either_layer_in_the_panels_order(spark, tmp_path):
    path = mini(spark, tmp_path / "m", block_rows=1)
    assert annotated.layers(spark, path) == ["counts"]
    panel = spark.createDataFrame([("g2", 1), ("g1", 2)], "gene string, gene_pos int")
    got = {r["cell"]: (r["row"], r["x"], r["celltype"]) for r in annotated.read_matrix(spark, path, ["celltype"], panel).collect()}
    assert got == {"c1": (0, [2.0, 1.0], "A"), "c2": (1, [2.0, 1.0], "A")}
    whole = annotated.read_matrix(spark, path, layer="counts")
    assert {r["cell"]: r["x"] for r in whole.collect()} == {"c1": [2.0, 4.0, 198.0], "c2": [2.0, 4.0, 198.0]}
    assert set(whole.columns) == {"row", "cell", "at", "celltype", "spatial_3D", "x"}
    assert annotated.read_matrix(spark, path, []).columns == ["row", "cell", "x"]
    assert annotated.entries(spark, path).agg(F.sum("v")).first()[0] == 204.0
    assert annotated.read_uns(spark, path) == {"contract": {"normalization": "log1p"}}


def test_matrices_are_refused(spark, tmp_path):
    path = mini(spark, tmp_path / "m")
    with pytest.raises(Exception, match="(?i)exist"):
        mini(spark, tmp_path / "m")
    for genes in (["g1", "none"], ["g1", "g1"]):
        panel = spark.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, gene_pos int")
        if len(set(genes)) == 2:
            with pytest.raises(ValueError, match="lacks"):
                annotated.read_matrix(spark, path, [], panel)
    with pytest.raises(ValueError, match="length"):
        mini(spark, tmp_path / "n", x=((1.0, 2.0), (1.0, 2.0, 3.0)))
    twice = mini(spark, tmp_path / "t", genes=("g1", "g1", "g2"))
    with pytest.raises(ValueError, match="twice"):
        annotated.read_matrix(spark, twice, [], spark.createDataFrame([("g1", 1)], "gene string, gene_pos int"))
    np.savez(tmp_path / "m" / "X" / "block-9.npz", data=[1.0], indices=[7], indptr=[0, 1], shape=[1, 3], start=5)
    with pytest.raises(Exception, match="fit each other"):
        annotated.read_matrix(spark, path).collect()


def test_blocks_are_whole_rows_in_order(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = (rng.random((50, 7)) * (rng.random((50, 7)) > 0.6)).round(3)
    df = spark.createDataFrame([(i, f"c{i}", v.tolist()) for i, v in enumerate(x)], "at long, cell string, x array<double>").repartition(5)
    path = annotated.write_matrix(df, [f"g{i}" for i in range(7)], str(tmp_path / "m"), ["at"], block_rows=8)
    assert len(list((tmp_path / "m" / "X").glob("*.npz"))) == 7
    got = annotated.read_matrix(spark, path).orderBy("row").collect()
    assert [r["cell"] for r in got] == [f"c{i}" for i in range(50)] and np.allclose([r["x"] for r in got], x)


def test_series_table(spark):
    text = ['!title\t"a"', '!Series_Matrix_Table_Begin', '"ID_REF"\t"s1"\ts2', 'p1\t1.5\tnull', '"p2"\t\tx', "!series_matrix_table_end", "p3\t1\t2"]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(text)] + [("g", 0, "none")], "file string, line long, value string")
    got = sorted((r["sample"], r["probe"], r["value"]) for r in annotated.series_table(lines).collect())
    assert got == [("s1", "p1", 1.5), ("s1", "p2", None), ("s2", "p1", None), ("s2", "p2", None)]


# Ledgers and locks


def test_of_racing_writers_one_commits(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.range(10)
    assert ledger.version(spark, path) == 0
    ledger.commit(df, path, 0)
    won, lost = [], []

    def write(k):
        try:
            won.append((k, ledger.commit(spark.range(k), path, 1)))
        except ledger.Taken:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in (3, 4, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 2 and won[0][1] == 2
    assert ledger.current(spark, path).count() == won[0][0] and ledger.current(spark, path, 1).count() == 10
    assert len(list((tmp_path / "t").glob("data-*"))) == 2  # the losers' data are gone
    with pytest.raises(ledger.Taken):
        ledger.commit(df, path, 1)
    with pytest.raises(FileNotFoundError):
        ledger.current(spark, path, 7)


def test_a_failed_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    ledger.commit(spark.createDataFrame([(1, "a")], "k int, s string"), path, 0, "csv", header="true")
    with pytest.raises(Exception, match="(?i)zero"):
        ledger.commit(spark.range(3).selectExpr("id div (id - 1) as k", "'x' as s"), path, 1, "csv")
    assert [tuple(r) for r in ledger.current(spark, path).collect()] == [(1, "a")] and ledger.version(spark, path) == 1


def test_locks_have_one_holder_and_end(spark, tmp_path):
    folder = str(tmp_path)
    with ledger.lock(spark, folder, "w"):
        with pytest.raises(ledger.Taken):
            with ledger.lock(spark, folder, "w"):
                pass
        with ledger.lock(spark, folder, "other"):
            pass
    with ledger.lock(spark, folder, "w", lease=-1):  # its lease is over at once
        with ledger.lock(spark, folder, "w") as second:
            assert json.loads(ledger.Files(spark, folder).read("w.lock"))["owner"] == second
    assert ledger.Files(spark, folder).read("w.lock") is None
    with pytest.raises(RuntimeError):
        with ledger.lock(spark, folder, "w"):
            raise RuntimeError
    assert ledger.Files(spark, folder).read("w.lock") is None
    files = ledger.Files(spark, folder)
    files.create("once", "1")
    with pytest.raises(ledger.Taken):
        files.create("once", "2")
    assert files.read("once") == "1" and not [n for n in files.names("") if n.endswith(".tmp")]


def test_submission_keeps_coordinates_and_takes_the_panels_order(spark, tmp_path):
    cells = spark.createDataFrame([("c", "a", [5.0, 1.0, 2.0], [0.0, 1.0, 2.0]), ("d", "b", [6.0, 3.0, 4.0], [3.0, 4.0, 5.0])], "cell string, state string, x array<double>, at array<double>")
    out = readers.submission(cells, ["g2", "g1"], str(tmp_path / "s"), genes=["u", "g1", "g2"], coords="at")
    assert {r["cell"]: (r["x"], r["at"]) for r in out.collect()} == {"c": ([2.0, 1.0], [0.0, 1.0, 2.0]), "d": ([4.0, 3.0], [3.0, 4.0, 5.0])}
    with pytest.raises(ValueError, match="lack"):
        readers.submission(cells, ["g2", "g9"], str(tmp_path / "t"), genes=["u", "g1", "g2"])
    with pytest.raises(ValueError, match="coordinates"):
        readers.submission(cells.withColumn("at", F.array(F.lit(1.0), F.lit(float("nan")), F.lit(0.0))), ["g1"], str(tmp_path / "u"), genes=["u", "g1", "g2"], coords="at")


# The contract


@pytest.fixture(scope="module")
def board(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("contract")
    sha = fq.put(spark, str(root), {"panel.txt": "g1\ng2\nunused\n"})["panel.txt"]
    rule = {"task": "T3", "board": "b", "genes_file": "panel.txt", "genes_sha256": sha, "n_genes": 3, "min_cells": 2, "max_cells": 4, "obs_required": ["celltype"], "uns_required": ["contract"], "obsm_required": ["spatial_3D"], "needs_coords": True}
    flat = rule | {"board": "flat", "needs_coords": False, "obsm_required": []}
    wrong = rule | {"board": "wrong", "genes_sha256": "0" * 64, "n_genes": 5, "min_cells": 3}
    index = fq.put(spark, str(root), {"index.json": json.dumps({"boards": {"a": rule, "b": flat, "c": wrong}})})["index.json"]
    fq.put(spark, str(root), {"lock.json": json.dumps({"index": "index.json", "index_sha256": index}), "bad_lock.json": json.dumps({"index": "index.json", "index_sha256": "1" * 64}), "far_lock.json": json.dumps({"index": "../index.json", "index_sha256": index})})
    parent = mini(spark, root / "parent")
    return str(root), parent, contract.folder_digest(spark, parent)


def failed(spark, board, candidate, lock="lock.json", name="b", sha=None, **options):
    root, parent, digest = board
    rows = contract.validate(spark, candidate, parent, sha or digest, root, lock, "t3", name, "log1p", keeps_coords=True, **options).collect()
    assert all(r["passed"] == (r["bad"] == 0) for r in rows)
    return {r["name"] for r in rows if not r["passed"]}


def test_a_sound_candidate_passes_all_checks(spark, board, tmp_path):
    path = mini(spark, tmp_path / "c", x=((2.0, 1.0, 88.0), (3.0, 5.0, 77.0)), layer=False)
    assert failed(spark, board, path) == {"parent_layers"}
    same = mini(spark, tmp_path / "d")
    assert failed(spark, board, same, round_trip=str(tmp_path / "again")) == set()
    rows = contract.validate(spark, same, board[1], board[2], board[0], "lock.json", "T3", "B", "log1p")
    assert rows.count() == 26 and json.loads(contract.bound_report(rows, "x"))["passed"]


@pytest.mark.parametrize(
    ("change", "names"),
    [
        ({"genes": ("g2", "g1", "unused")}, {"gene_order"}),
        ({"genes": ("g1", "g1", "unused")}, {"gene_order", "genes_unique"}),
        ({"x": ((-1.0, 2.0, 99.0), (1.0, 2.0, 99.0))}, {"non_negative", "parent_layers"}),
        ({"x": ((float("nan"), 2.0, 99.0), (1.0, float("inf"), 99.0))}, {"finite", "parent_layers"}),
        ({"coords": (None, None)}, {"obsm_required", "parent_coordinates"}),
        ({"coords": ((0.0, 1.0), (3.0, 4.0, 5.0))}, {"coordinates_finite", "parent_coordinates"}),
        ({"coords": ((0.0, 1.0, 2.5), (3.0, 4.0, 5.0))}, {"parent_coordinates"}),
        ({"cells": ("c2", "c1")}, {"parent_order", "parent_obs"}),
        ({"cells": ("c1", "c1")}, {"cells_unique", "parent_order", "parent_obs"}),
        ({"cells": ("c1", " ")}, {"cells_named", "parent_order", "parent_obs"}),
        ({"states": ("A", "B")}, {"parent_obs"}),
        ({"uns": {"log1p": {}}}, {"normalization", "uns_required"}),
    ],
)
def test_each_fault_is_named(spark, board, tmp_path, change, names):
    assert failed(spark, board, mini(spark, tmp_path / "c", **change)) == names


def test_faults_of_locks_and_boards_are_named(spark, board, tmp_path):
    same = mini(spark, tmp_path / "c")
    assert failed(spark, board, same, lock="none.json") >= {"lock", "index_digest", "board"}
    assert failed(spark, board, same, lock="bad_lock.json") == {"index_digest"}
    assert failed(spark, board, same, lock="far_lock.json") == {"index_digest", "board"}
    assert failed(spark, board, same, name="none") == {"board"}
    assert failed(spark, board, same, name="flat") == {"coordinates_absent"}
    assert failed(spark, board, same, name="wrong") == {"panel_digest", "panel_size", "cell_range"}
    assert failed(spark, board, same, sha="2" * 64) == {"parent_digest"}
    long = mini(spark, tmp_path / "l", x=((1.0, 2.0, 99.0),) * 5, cells=tuple("abcde"), states=("A",) * 5, coords=((0.0, 1.0, 2.0),) * 5)
    assert {"cell_range", "parent_order"} <= failed(spark, board, long)


# Invariants of a rewrite


def test_digests_of_parts_make_that_of_the_whole(spark):
    rows = [(i, f"v{i * i % 17}") for i in range(40)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(6)
    of = lambda d: tuple(contracts.ordered_digest(d, ["k"], ["v"]).first())
    whole, head, tail = of(df), of(df.where("k < 13")), of(df.where("k >= 13"))
    assert whole == (40, contracts.joined_digest(head[0], head[1], tail[1]))
    assert of(df.repartition(1)) == whole
    swapped = spark.createDataFrame([(5 if i == 6 else 6 if i == 5 else i, v) for i, v in rows], df.schema)
    changed = spark.createDataFrame([(i, "x" if i == 39 else v) for i, v in rows], df.schema)
    assert len({whole[1], of(swapped)[1], of(changed)[1], of(df.where("k < 39"))[1]}) == 4
    want = 0
    for i, v in rows:
        import hashlib

        want += int(hashlib.md5(v.encode()).hexdigest()[:7], 16) * pow(contracts.BASE, i, contracts.MODULUS)
    assert whole[1] == want % contracts.MODULUS


def test_rewrites_that_move_something_are_found(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"c{i}", "ab"[i % 2], rng.random(4).round(3).tolist(), *map(float, rng.standard_normal(3))) for i in range(30)]
    before = spark.createDataFrame(rows, "at long, cell string, state string, x array<double>, x1 double, y1 double, z1 double")
    kept = lambda after: {r["name"] for r in contracts.rewrite_invariants(before, after, ["at"], 3, ["state"]).collect() if not r["kept"]}
    assert kept(before.repartition(4)) == set()
    assert kept(before.withColumn("x", F.when(F.col("at") == 7, F.array(*map(F.lit, [9.0, 0.0, 0.0, 0.0]))).otherwise(F.col("x")))) == {"expression"}
    assert kept(before.withColumn("at", F.when(F.col("at") == 2, 4).when(F.col("at") == 4, 2).otherwise(F.col("at")))) == {"cells", "expression"}
    assert kept(before.withColumn("x1", F.when(F.col("at") == 3, 50.0).otherwise(F.col("x1")))) == {"neighbours"}
    assert kept(before.where("at < 29")) == {"rows", "cells", "states", "expression", "neighbours"}


# Gates


EDGES = [("p1", "p2", "A", "B", True, True, False, True, True, False), ("p2", "p3", "B", "C", True, False, True, True, False, True), ("p3", "p1", "C", "A", True, True, True, True, True, True)]


def test_snapshots_are_refused_by_name(spark, tmp_path):
    root = str(tmp_path)
    cases = {
        "good": {}, "version": {"schema_version": "x"}, "taxon": {"schema": {"organism_taxon_id": 8}}, "license": {"license": " "}, "bytes": {"bytes": 1}, "data_digest": {"sha256": "0" * 64}, "edge_count": {"directed_edges": 9},
        "data_path": {"data_path": "../good/edges.tsv"}, "source_query": {"source_query": {"datasets": "", "organisms": "7"}}, "panel_overlap": {"target_mapping": {"panel_reference": "panel_overlap/panel.txt", "panel_gene_count": 2, "edge_symbols_overlapping_panel": 1}},
        "panel_file": {"source_query": {"datasets": "d", "organisms": "7", "partners_panel_sha256": "3" * 64}},
    }
    for name, declared in cases.items():
        fq.snapshot(spark, root, name, EDGES, ["A", "C"], declared)
    fq.snapshot(spark, root, "changed", EDGES, ["A", "C"], changed="\t".join(gates.EDGE_COLUMNS) + "\n")
    fq.snapshot(spark, root, "flags", [(*EDGES[0][:4], "maybe", *EDGES[0][5:])], ["A", "C"])
    fq.snapshot(spark, root, "undirected", [(*EDGES[0][:4], False, *EDGES[0][5:])], ["A", "C"])
    fq.snapshot(spark, root, "symbols", [("p", "q", "", "B", *EDGES[0][4:])], ["A", "C"])
    checks = gates.audit_snapshots(spark, root, "snapshot.v1", 7).cache()
    got = {r["subject"].split("/")[0]: set(r["failed"]) for r in gates.verdicts(checks).collect()}
    assert got["good"] == set() and got["version"] == {"schema_version"} and got["license"] == {"license"} and got["taxon"] == {"taxon"}
    assert got["bytes"] == {"bytes", "data_digest"} and got["data_digest"] == {"data_digest"} and got["edge_count"] == {"edge_count"}
    assert {"data_path"} <= got["data_path"] and {"source_query"} <= got["source_query"] and got["panel_overlap"] == {"panel_overlap"} and got["panel_file"] == {"panel_file"}
    assert {"bytes", "data_digest", "edge_count"} <= got["changed"] and got["flags"] == {"flags"} and got["undirected"] == {"directed"} and got["symbols"] == {"symbols"}
    edges = gates.audited_edges(spark, root, checks).orderBy("source").collect()
    assert [(r["source"], r["sign"]) for r in edges] == [("p1", 1), ("p2", -1), ("p3", None)]


def report_with(spark, root, edit=None, passes=None, after=None):
    rules, report = fq.route_artifact(spark, root, passes or {"c1": True, "c2": False})
    if edit:
        edit(report)
    fq.put(spark, root, {"gate_report.json": json.dumps(report)})
    if after:
        after()
    checks = gates.audit_routes(spark, root, rules).cache()
    bad = {(r["subject"].partition("#")[2], n) for r in gates.verdicts(checks).collect() for n in r["failed"]}
    return bad, [r["route_id"] for r in gates.active_routes(spark, root, checks).collect()]


def test_sound_reports_open_their_routes(spark, tmp_path):
    assert report_with(spark, str(tmp_path / "a")) == (set(), ["c1::L1"])
    bad, routes = report_with(spark, str(tmp_path / "b"), passes={"c1": True, "c2": True})
    assert bad == set() and sorted(routes) == ["c1::L1", "c2::L1"]
    assert report_with(spark, str(tmp_path / "c"), passes={"c1": False}) == (set(), [])


def test_changed_bytes_and_ids_close_routes(spark, tmp_path):
    def change():
        (tmp_path / "c1" / "ranks.tsv").write_text("changed")
        (tmp_path / "c1" / ".ranks.tsv.crc").unlink()  # the file system's own sum would refuse the read

    bad, routes = report_with(spark, str(tmp_path), after=change)
    assert bad == {("c1::L1", "output_files")} and routes == []


def test_each_fault_of_a_report_is_named(spark, tmp_path):
    cases = {
        "route": (lambda r: r["routes"][0].update(route_id="c9::L1"), {("", "route_ids")}), "outcome": (lambda r: r.update(outcome="PRIOR_GATE_PASS", status="PASS"), {("", "outcome_routes")}), "status": (lambda r: r.update(status="PASS"), {("", "status")}),
        "hash": (lambda r: r["routes"][0].update(prior_sha256="0" * 64), {("c1::L1", "prior_is_evidence"), ("c1::L1", "bound_files")}), "climb": (lambda r: r["routes"][0]["source_artifacts"]["s"].update(path="../c1/source.txt"), {("c1::L1", "source_files")}),
        "blocked": (lambda r: r["routes"][0].update(blockers=["x"]), {("c1::L1", "generation")}), "gate": (lambda r: r["routes"][0].update(state_join_gate={"status": "HOLD"}), {("c1::L1", "gates")}), "target": (lambda r: r["routes"][0]["method_status"]["ranks"].update(targets={}), {("c1::L1", "method_targets")}),
        "ranked": (lambda r: r["routes"][0]["method_status"]["ranks"]["targets"]["g1"].update(status="PASS_SIGNED"), {("c1::L1", "ranked")}), "submits": (lambda r: r.update(server_submission=True), {("", "no_submission")}),
        "hold": (lambda r: r["routes"][1].update(candidate_generation=True), {("c2::L1", "generation")}), "sources": (lambda r: r["routes"][0].update(source_hashes={"s": "0" * 64}), {("c1::L1", "sources")}), "task": (lambda r: r.update(task_id="x"), {("", "task")}),
    }
    rules, report = fq.route_artifact(spark, str(tmp_path), {"c1": True, "c2": False})
    texts = {"gate_report_broken.json": "{", "gate_report_good.json": json.dumps(report)}
    for name, (edit, _) in cases.items():
        changed = json.loads(json.dumps(report))
        edit(changed)
        texts[f"gate_report_{name}.json"] = json.dumps(changed)
    fq.put(spark, str(tmp_path), texts)
    checks = gates.audit_routes(spark, str(tmp_path), rules).cache()
    bad: dict = {}
    for r in gates.verdicts(checks).collect():
        file, _, route = r["subject"].partition("#")
        bad.setdefault(file.removeprefix("gate_report_").removesuffix(".json"), set()).update((route, n) for n in r["failed"])
    assert bad.pop("good") == set() and {"document", "schema"} <= {n for _, n in bad.pop("broken")}
    assert ("", "route_ids") in bad.pop("route")
    assert bad == {name: want for name, (_, want) in cases.items() if name != "route"}
    # A fault of one route closes that route, a fault of the report all of them.
    assert {(r["report"], r["route_id"]) for r in gates.active_routes(spark, str(tmp_path), checks).collect()} == {("gate_report_good.json", "c1::L1"), ("gate_report_hold.json", "c1::L1")}


def test_permits_hold_with_their_review_alone(spark, tmp_path):
    policy = fq.put(spark, str(tmp_path), {"policy.md": "text"})["policy.md"]
    review = {
        "task": "T", "source_reference": "s", "policy_version": "P1", "review_status": "COMPLETED", "classification": "ALLOWED", "prohibited_records_remaining": 0, "allowed_response_roles": ["SHAPE"], "license_status": "PERMITTED",
        "source_context_review": "seen", "condition_allowlist": ["c"], "policy": {"path": "policy.md", "sha256": policy},
    }
    cases = {"good": {}, "excluded": {"classification": "EXCLUDED"}, "left": {"prohibited_records_remaining": 1}, "role": {"allowed_response_roles": ["SIGNED"]}, "policy": {"policy": {"path": "policy.md", "sha256": "0" * 64}}, "other": {"source_reference": "z"}}
    for name, change in cases.items():
        sha = fq.put(spark, str(tmp_path), {f"review_{name}.json": json.dumps(review | change)})[f"review_{name}.json"]
        fq.put(spark, str(tmp_path), {f"permit_{name}.json": json.dumps({"allowed_response_role": "SHAPE", "task": "T", "status": "APPROVED_SANITIZED", "source_reference": "s", "compliance_review": {"path": f"review_{name}.json", "sha256": sha}})})
    fq.put(spark, str(tmp_path), {"permit_unbound.json": json.dumps({"allowed_response_role": "SHAPE", "task": "T", "status": "APPROVED_SANITIZED", "source_reference": "s", "compliance_review": {"path": "review_good.json", "sha256": "0" * 64}})})
    audit = gates.audit_roles(spark, str(tmp_path), "SHAPE", "T", "P1")
    got = {r["subject"]: set(r["failed"]) for r in gates.verdicts(audit).collect()}
    want = {"good": set(), "excluded": {"allowed"}, "left": {"nothing_prohibited"}, "role": {"reviewed_role"}, "policy": {"policy_file"}, "other": {"review_subject"}}
    assert {k: got[f"permit_{k}.json"] for k in want} == want
    assert "review" in got["permit_unbound.json"]
    signed = gates.verdicts(gates.audit_roles(spark, str(tmp_path), "SIGNED", "T", "P1")).where("subject = 'permit_good.json'").first()
    assert set(signed["failed"]) == {"role", "reviewed_role"}
