"""Gates bound to files: snapshots of edges, route reports and role permits hold only if the bytes they name are unchanged.

Reports and manifests are JSON read with a schema, many at once; the files that they name are joined by path with digests of
their bytes. Every check of every subject is one row: subject, name, passed, detail. Nothing is taken from a subject that has a
row which did not pass. A path that is absolute or climbs out of its root is never looked up.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.lineage import settled

SHA = "^[0-9a-fA-F]{64}$"


def below(spark: SparkSession, root: str, path: Column, encoded: bool = False) -> Column:
    """A file's path below the root."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/") + "/"
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    return F.substring(plain(path), F.length(plain(F.lit(top))) + 1, F.lit(1 << 20))


def digests(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (below the root), bytes, sha256 of all files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(below(spark, root, F.col("path")).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def documents(spark: SparkSession, root: str, schema: str, pattern: str) -> DataFrame:
    """Whole JSON files of a folder as ``doc``, null where a file is no such document; path below the root and sha256."""
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select(below(spark, root, F.col("path")).alias("path"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"))
    return texts.select("path", "sha256", F.when(F.get_json_object("text", "$").isNotNull(), F.from_json("text", schema)).alias("doc"))


def safe(path: Column) -> Column:
    """Not empty, not absolute, not climbing."""
    return F.coalesce((path != "") & ~path.rlike(r"^/|^[A-Za-z][A-Za-z0-9+.-]*:|(^|/)\.\.(/|$)"), F.lit(False))


def same(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(a) == F.lower(b), F.lit(False))


def long(rows: DataFrame, subject: str, checks: dict[str, Column]) -> DataFrame:
    """One row for each subject and check; what can't be decided has not passed."""
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()))
    return rows.select(F.col(subject).alias("subject"), F.explode(each).alias("c")).select("subject", "c.name", "c.passed", F.lit("").alias("detail"))


def bound(claims: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """Whether files are what is claimed of them: subject, path, sha256 and bytes (null: not claimed). One row a subject."""
    found = files.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    met = claims.withColumn("_ok", safe(F.col("path"))).join(found, "path", "left")
    good = F.col("_ok") & F.coalesce(F.col("sha256").rlike(SHA), F.lit(False)) & same(F.col("sha256"), F.col("_s")) & F.coalesce(F.col("bytes") == F.col("_b"), F.col("bytes").isNull())
    bad = F.array_join(F.slice(F.array_sort(F.collect_set(F.when(~good, F.coalesce("path", F.lit("(no path)"))))), 1, 10), ", ")
    return met.groupBy("subject").agg(F.bool_and(good).alias("passed"), bad.alias("detail")).select("subject", F.lit(name).alias("name"), "passed", "detail")


def verdicts(checks: DataFrame) -> DataFrame:
    """subject, passed, failed: the names of the checks that did not pass."""
    failed = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("name"))))
    return checks.groupBy("subject").agg(F.bool_and("passed").alias("passed"), failed.alias("failed"))


# Snapshots of directed edges

# The field names and status words of the documents, below and in the other sections.
SNAPSHOT = (
    "schema_version string, source_name string, source_url string, license string, source_query struct<datasets string, organisms string, partners_panel_sha256 string>, "
    "schema struct<organism_taxon_id long>, data_path string, bytes long, sha256 string, directed_edges long, target_mapping struct<panel_reference string, panel_gene_count long, edge_symbols_overlapping_panel long>"
)
EDGE_COLUMNS = ["source", "target", "source_genesymbol", "target_genesymbol", "is_directed", "is_stimulation", "is_inhibition", "consensus_direction", "consensus_stimulation", "consensus_inhibition"]
"""Fixed values: the columns of an edge file, in order."""


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "[^/]*$", "")


def snapshot_edges(spark: SparkSession, root: str, pattern: str = "*.tsv") -> DataFrame:
    """path, header and the columns of edges of all edge files below a folder; flags are null where they are no booleans."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root).select(below(spark, root, F.col("_metadata.file_path"), True).alias("path"), "value")
    header = "\t".join(EDGE_COLUMNS)
    parts = F.split("value", "\t", -1)
    flag = lambda i: F.when(F.lower(F.trim(F.get(parts, F.lit(i)))).isin("true", "1"), True).when(F.lower(F.trim(F.get(parts, F.lit(i)))).isin("false", "0"), False)
    columns = [(F.trim(F.get(parts, F.lit(i))) if i < 4 else flag(i)).alias(c) for i, c in enumerate(EDGE_COLUMNS)]
    return lines.select("path", (F.col("value") == header).alias("header"), (F.size(parts) == len(EDGE_COLUMNS)).alias("whole"), *columns)


def audit_snapshots(spark: SparkSession, root: str, version: str, taxon: int, source: str | None = None, dataset: str | None = None, manifests: str = "*manifest.json") -> DataFrame:
    """The checks of all snapshot manifests below ``root``: declared source, license and query, taxon, bytes and digest of the data
    file, panel file, columns, flags, symbols, counts of edges and of panel symbols met."""
    docs, files = settled(documents(spark, root, SNAPSHOT, manifests)), settled(digests(spark, root))
    m = docs.select(F.col("path").alias("subject"), F.col("doc"), _parent(F.col("path")).alias("_dir"))
    told = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    d = lambda c: F.col(f"doc.{c}")
    declared = long(m, "subject", {
        "document": F.col("doc").isNotNull(), "schema_version": d("schema_version") == version, "source": told(d("source_name")) & told(d("source_url")), "license": told(d("license")),
        "source_query": told(d("source_query.datasets")) & told(d("source_query.organisms")), "source_name": F.lit(True) if source is None else same(d("source_name"), F.lit(source)), "dataset": F.lit(True) if dataset is None else same(d("source_query.datasets"), F.lit(dataset)),
        "taxon": (F.trim(d("source_query.organisms")) == str(taxon)) & (d("schema.organism_taxon_id") == taxon), "data_path": safe(d("data_path")),
        "target_mapping": told(d("target_mapping.panel_reference")) & (d("target_mapping.panel_gene_count") > 0) & (d("target_mapping.edge_symbols_overlapping_panel") >= 0),
    })
    data = m.select("subject", F.concat("_dir", d("data_path")).alias("path"), d("bytes").alias("bytes"), d("sha256").alias("sha256"))
    panel = m.select("subject", d("target_mapping.panel_reference").alias("path"), F.lit(None).cast("long").alias("bytes"), d("source_query.partners_panel_sha256").alias("sha256"))
    unpinned = panel.where("sha256 is null").join(files.select("path", F.col("sha256").alias("_s")), "path", "left").select("subject", F.lit("panel_file").alias("name"), (safe(F.col("path")) & F.col("_s").isNotNull()).alias("passed"), F.coalesce("path", F.lit("")).alias("detail"))
    bytes_ = data.select("subject", "path", "bytes").join(files.select("path", F.col("bytes").alias("_b")), "path", "left").select("subject", F.lit("bytes").alias("name"), F.coalesce(F.col("bytes") == F.col("_b"), F.lit(False)).alias("passed"), F.lit("").alias("detail"))
    edges = snapshot_edges(spark, root)
    mine = data.select("subject", "path").join(edges, "path")
    rows = mine.where("not header")
    flags = functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in EDGE_COLUMNS[4:]))
    counted = m.select("subject", d("directed_edges").alias("want"), d("target_mapping.panel_gene_count").alias("genes"), d("target_mapping.edge_symbols_overlapping_panel").alias("overlap"), d("target_mapping.panel_reference").alias("panel"))
    stats = rows.groupBy("subject").agg(F.count("*").alias("n"), F.bool_and(F.col("whole") & flags).alias("flags"), F.bool_and((F.col("source_genesymbol") != "") & (F.col("target_genesymbol") != "")).alias("symbols"), F.bool_and("is_directed").alias("directed"))
    heads = mine.groupBy("subject").agg(F.count_if("header").alias("heads"))
    symbols = spark.read.option("recursiveFileLookup", True).text(root).select(below(spark, root, F.col("_metadata.file_path"), True).alias("panel"), F.trim("value").alias("gene")).where("gene <> ''")
    named = symbols.join(counted.select("subject", "panel"), "panel").select("subject", "gene").distinct()
    met = rows.select("subject", F.explode(F.array("source_genesymbol", "target_genesymbol")).alias("gene")).distinct().join(named, ["subject", "gene"]).groupBy("subject").agg(F.count("*").alias("met"))
    table = counted.join(stats, "subject", "left").join(heads, "subject", "left").join(named.groupBy("subject").agg(F.count("*").alias("panel_n")), "subject", "left").join(met, "subject", "left")
    content = long(table, "subject", {
        "columns": F.col("heads") == 1, "flags": F.coalesce("flags", F.lit(True)), "symbols": F.coalesce("symbols", F.lit(True)), "directed": F.coalesce("directed", F.lit(True)), "edge_count": F.coalesce("n", F.lit(0)) == F.col("want"),
        "panel_genes": F.col("panel_n") == F.col("genes"), "panel_overlap": F.coalesce("met", F.lit(0)) == F.col("overlap"),
    })
    parts = [declared, bytes_, bound(data, files, "data_digest"), bound(panel.where("sha256 is not null"), files, "panel_file"), unpinned, content]
    return functools.reduce(DataFrame.unionByName, parts)


def audited_edges(spark: SparkSession, root: str, checks: DataFrame, manifests: str = "*manifest.json") -> DataFrame:
    """The edges of the snapshots all of whose checks passed, with ``sign``: 1, -1 or null where direction or sign is open."""
    good = verdicts(checks).where("passed").select("subject")
    docs = documents(spark, root, SNAPSHOT, manifests).select(F.col("path").alias("subject"), F.concat(_parent(F.col("path")), "doc.data_path").alias("path"))
    rows = docs.join(good, "subject").join(snapshot_edges(spark, root).where("not header"), "path")
    up, down = F.col("consensus_stimulation"), F.col("consensus_inhibition")
    sign = F.when(F.col("is_directed") & F.col("consensus_direction") & up & ~down & F.col("is_stimulation"), 1).when(F.col("is_directed") & F.col("consensus_direction") & down & ~up & F.col("is_inhibition"), -1)
    return rows.select("subject", *EDGE_COLUMNS, sign.alias("sign"))


# Route reports

_STATUS = "struct<status string>"
REPORT = (
    "schema string, task_id string, gate_id string, outcome string, status string, criteria array<struct<name string, result string>>, candidate_generation boolean, server_submission boolean, "
    "blocks_submission boolean, blockers array<string>, routes array<struct<route_id string, status string, blocks_submission boolean, candidate_generation boolean, evidence_paths array<string>, "
    "evidence_hashes map<string,string>, prior_path string, prior_sha256 string, evidence_path string, evidence_sha256 string, artifact_manifest_path string, artifact_manifest_sha256 string, "
    "source_artifacts map<string,struct<path string, sha256 string>>, source_hashes map<string,string>, "
    f"method_status map<string,struct<status string, targets map<string,struct<status string, reason string, outputs array<struct<path string, sha256 string>>>>>>, blockers array<string>, "
    f"state_join_gate {_STATUS}, selected_gene_stability {_STATUS}, evidence_family_stability {_STATUS}>>"
)
MANIFEST = "schema string, files array<struct<path string, bytes long, sha256 string>>"
PRIOR = "lane string, condition_ids array<string>, records array<struct<condition_id string>>"
GATES = ["state_join_gate", "selected_gene_stability", "evidence_family_stability"]


@dataclass
class Rules:
    """What a report must be about: its schema, task and gate, and for each condition its targets; routes are condition::lane."""

    schema: str
    task: str
    gate: str
    manifest_schema: str
    lanes: list[str]
    targets: dict[str, list[str]]
    methods: list[str]
    ranked_method: str = ""
    ranked_status: str = ""
    outcomes: dict[str, str] = field(default_factory=lambda: {"PRIOR_GATE_PASS": "PASS", "PARTIAL_ROUTE_PASS": "HOLD", "HOLD_AS_COMPONENT": "HOLD", "BLOCKED": "BLOCKED"})

    def routes(self) -> list[str]:
        return sorted(f"{c}::{lane}" for c in self.targets for lane in self.lanes)


def audit_routes(spark: SparkSession, root: str, rules: Rules, reports: str = "gate_report*.json") -> DataFrame:
    """The checks of all reports below an artifact folder; subjects are a report's path, or path#route_id for one of its routes."""
    docs, files = settled(documents(spark, root, REPORT, reports).withColumnRenamed("path", "report")), settled(digests(spark, root))
    d = lambda c: F.col(f"doc.{c}")
    of = lambda status: F.size(F.filter(d("routes"), lambda r: r["status"] == status))
    n = F.size(d("routes"))
    wanted = F.element_at(F.create_map(*(F.lit(v) for kv in rules.outcomes.items() for v in kv)), d("outcome"))
    by_outcome = F.when(d("outcome") == "PRIOR_GATE_PASS", (of("PASS") == n) & F.forall(d("criteria"), lambda c: c["result"].isin("PASS", "NOT_APPLICABLE"))).when(d("outcome") == "PARTIAL_ROUTE_PASS", (of("PASS") > 0) & (of("PASS") < n))
    by_outcome = by_outcome.when(d("outcome") == "HOLD_AS_COMPONENT", of("PASS") == 0).when(d("outcome") == "BLOCKED", (of("PASS") == 0) & (of("BLOCKED") > 0))
    named = lambda c: F.coalesce(F.forall(c, lambda b: F.coalesce(b != "", F.lit(False))), F.lit(True))
    whole = long(docs, "report", {
        "document": F.col("doc").isNotNull(), "schema": d("schema") == rules.schema, "task": d("task_id") == rules.task, "gate": d("gate_id") == rules.gate, "outcome": wanted.isNotNull(), "status": d("status") == wanted,
        "criteria": (F.size(d("criteria")) > 0) & F.forall(d("criteria"), lambda c: (c["name"] != "") & c["result"].isin("PASS", "FAIL", "NOT_APPLICABLE", "BLOCKED")), "outcome_routes": by_outcome,
        "no_generation": ~d("candidate_generation"), "no_submission": ~d("server_submission") & ~d("blocks_submission"), "blockers": named(d("blockers")),
        "route_ids": F.array_sort(F.transform(d("routes"), lambda r: r["route_id"])) == F.array(*map(F.lit, rules.routes())),
    })
    routes = docs.select("report", F.explode("doc.routes").alias("r")).select(F.concat_ws("#", "report", "r.route_id").alias("subject"), "r")
    r = lambda c: F.col(f"r.{c}")
    passes = r("status") == "PASS"
    condition = F.split(r("route_id"), "::")[0]
    targets = F.element_at(F.create_map(*(v for k, t in rules.targets.items() for v in (F.lit(k), F.array(*map(F.lit, sorted(t)))))), condition)
    status_word = r"^(PASS|NOT_APPLICABLE|BLOCKED|NOT_RUN|PARTIAL)(_[A-Z0-9]+)*$"
    method_ok = F.forall(F.map_values(r("method_status")), lambda m: m["status"].rlike(status_word) & (F.array_sort(F.map_keys(m["targets"])) == targets) & F.forall(F.map_values(m["targets"]), lambda t: t["status"].rlike(status_word) & t["outputs"].isNotNull() & (~t["status"].startswith("PASS") | (F.size(t["outputs"]) > 0)) & (~t["status"].startswith("NOT_APPLICABLE") | (F.coalesce(t["reason"], F.lit("")) != ""))))
    ranked = F.forall(F.map_values(F.element_at(r("method_status"), F.lit(rules.ranked_method))["targets"]), lambda t: t["status"] == rules.ranked_status) if rules.ranked_method else F.lit(True)
    hash_of = lambda p: F.element_at(r("evidence_hashes"), r(p))
    each = long(routes, "subject", {
        "status": r("status").isin("PASS", "HOLD", "BLOCKED"), "no_submission": ~r("blocks_submission"), "condition": targets.isNotNull(),
        "evidence": (F.size(r("evidence_paths")) > 0) & (F.array_sort(F.map_keys(r("evidence_hashes"))) == F.array_sort(F.array_distinct(r("evidence_paths")))),
        "prior_is_evidence": same(hash_of("prior_path"), r("prior_sha256")) & same(hash_of("evidence_path"), r("evidence_sha256")),
        "sources": (F.size(r("source_hashes")) > 0) & (F.array_sort(F.map_keys(r("source_hashes"))) == F.array_sort(F.map_keys(r("source_artifacts")))) & F.forall(F.map_entries(r("source_artifacts")), lambda e: F.element_at(r("source_hashes"), e["key"]) == e["value"]["sha256"]),
        "methods": F.array_sort(F.map_keys(r("method_status"))) == F.array(*map(F.lit, sorted(rules.methods))), "method_targets": method_ok, "blockers": r("blockers").isNotNull() & named(r("blockers")),
        "generation": F.when(passes, r("candidate_generation") & (F.size(r("blockers")) == 0)).otherwise(~r("candidate_generation")),
        "gates": functools.reduce(lambda a, b: a & b, (r(g)["status"].isin("PASS", "HOLD", "NOT_IDENTIFIABLE", "BLOCKED") & (~passes | (r(g)["status"] == "PASS")) for g in GATES)), "ranked": ~passes | ranked,
    })
    null = F.lit(None).cast("long")
    claim = lambda rows, path, sha, size=null: rows.select("subject", path.alias("path"), sha.alias("sha256"), size.alias("bytes"))
    evidence = routes.select("subject", F.explode("r.evidence_hashes").alias("p", "s"))
    three = routes.select("subject", F.explode(F.array(*(F.struct(r(f"{x}_path").alias("p"), r(f"{x}_sha256").alias("s")) for x in ("prior", "evidence", "artifact_manifest")))).alias("c")).select("subject", "c.*")
    sources = routes.select("subject", F.explode("r.source_artifacts").alias("k", "v")).select("subject", F.col("v.path").alias("p"), F.col("v.sha256").alias("s"))
    outputs = routes.select("subject", F.explode(F.map_values("r.method_status")).alias("m")).select("subject", F.explode(F.map_values("m.targets")).alias("t")).select("subject", F.explode("t.outputs").alias("o")).select("subject", F.col("o.path").alias("p"), F.col("o.sha256").alias("s"))
    manifests = routes.select("subject", r("artifact_manifest_path").alias("path"), r("evidence_paths").alias("evidence")).join(documents(spark, root, MANIFEST, "*.json").select("path", "doc"), "path", "left")
    listed = manifests.select("subject", F.explode("doc.files").alias("f")).select("subject", "f.*")
    covered = long(manifests, "subject", {"manifest": (F.col("doc.schema") == rules.manifest_schema) & (F.size(F.array_distinct(F.col("doc.files.path"))) == F.size("doc.files")), "manifest_covers": F.size(F.array_except("evidence", F.col("doc.files.path"))) == 0})
    priors = routes.select("subject", r("prior_path").alias("path"), condition.alias("condition"), F.split(r("route_id"), "::")[1].alias("lane")).join(documents(spark, root, PRIOR, "*.json").select("path", "doc"), "path", "left")
    prior = long(priors, "subject", {"prior_route": (F.col("doc.lane") == F.col("lane")) & F.array_contains("doc.condition_ids", F.col("condition")) & F.coalesce(F.forall("doc.records", lambda x: F.coalesce(x["condition_id"] == F.col("condition"), F.lit(False))), F.lit(True))})
    parts = [whole, each, covered, prior, bound(claim(listed, F.col("path"), F.col("sha256"), F.coalesce("bytes", F.lit(-1))), files, "manifest_files")]
    parts += [bound(claim(rows, F.col("p"), F.col("s")), files, name) for rows, name in ((evidence, "evidence_files"), (three, "bound_files"), (sources, "source_files"), (outputs, "output_files"))]
    return functools.reduce(DataFrame.unionByName, parts)


def active_routes(spark: SparkSession, root: str, checks: DataFrame, reports: str = "gate_report*.json") -> DataFrame:
    """report, route_id and files of the routes that may be used: their own checks and their report's passed, and their status is PASS."""
    good = settled(verdicts(checks).where("passed").select("subject"))
    routes = documents(spark, root, REPORT, reports).select(F.col("path").alias("report"), F.explode("doc.routes").alias("r")).where("r.status = 'PASS'")
    routes = routes.withColumn("subject", F.concat_ws("#", "report", "r.route_id")).join(good, "subject").join(good.withColumnRenamed("subject", "report"), "report")
    return routes.select("report", "r.route_id", *(f"r.{x}_{y}" for x in ("prior", "evidence", "artifact_manifest") for y in ("path", "sha256")))


# Role permits

PERMIT = "allowed_response_role string, task string, status string, source_reference string, compliance_review struct<path string, sha256 string>"
REVIEW = (
    "task string, source_reference string, policy_version string, review_status string, classification string, prohibited_records_remaining long, allowed_response_roles array<string>, "
    "license_status string, source_context_review string, condition_allowlist array<string>, policy struct<path string, sha256 string>"
)


def audit_roles(spark: SparkSession, root: str, role: str, task: str, policy: str, permits: str = "permit*.json") -> DataFrame:
    """The checks of all permits below a folder for one role and task: the permit, the review whose bytes it is bound to, and the policy
    whose bytes the review is bound to. A permit alone never overrides its review."""
    files = settled(digests(spark, root))
    p = documents(spark, root, PERMIT, permits).withColumnRenamed("path", "subject")
    reviews = documents(spark, root, REVIEW, "*.json").select(F.col("path").alias("_p"), F.col("sha256").alias("_s"), F.col("doc").alias("review"))
    met = p.drop("sha256").join(reviews, (F.col("doc.compliance_review.path") == F.col("_p")) & same(F.col("doc.compliance_review.sha256"), F.col("_s")) & safe(F.col("doc.compliance_review.path")), "left")
    d, v = (lambda c: F.col(f"doc.{c}")), (lambda c: F.col(f"review.{c}"))
    told = lambda c: F.coalesce(c, F.lit("")) != ""
    checks = long(met, "subject", {
        "document": F.col("doc").isNotNull(), "role": d("allowed_response_role") == role, "task": d("task") == task, "approved": d("status") == "APPROVED_SANITIZED", "review": F.col("review").isNotNull(),
        "review_subject": (v("task") == d("task")) & (v("source_reference") == d("source_reference")), "policy_version": v("policy_version") == policy, "completed": v("review_status") == "COMPLETED", "allowed": v("classification") == "ALLOWED",
        "nothing_prohibited": v("prohibited_records_remaining") == 0, "reviewed_role": F.array_contains(v("allowed_response_roles"), role), "license": v("license_status") == "PERMITTED", "context": told(v("source_context_review")) & (F.size(v("condition_allowlist")) > 0),
    })
    claims = met.select("subject", v("policy.path").alias("path"), v("policy.sha256").alias("sha256"), F.lit(None).cast("long").alias("bytes"))
    return checks.unionByName(bound(claims, files, "policy_file"))
