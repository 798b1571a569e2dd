import json

from pyspark.sql import functions as F

from tessellar.operators import reports, workspace
from tessellar.sources import reports as sources


def test_risk_of_artifacts_by_ids_and_paths(spark):
    """Ends that are no artifacts drop out, coverage stands in for tests, advisories fall on manifests, pairs with unknown paths don't count, what has no factor isn't listed."""
    artifacts = spark.createDataFrame([("1", "a.ts", "code_metadata"), ("2", "b.ts", "code_metadata"), ("3", "c.ts", "code_metadata"), ("4", "web/package.json", "config"), ("5", "d.md", "doc"), ("6", "e.md", "doc")], "id string, path string, classification string")
    edges = spark.createDataFrame([("2", "1", "imports"), ("3", "1", "calls"), ("3", "1", "imports"), ("1", "1", "calls"), ("3", "2", "tests"), ("9", "1", "imports"), ("1", "requirement", "implements"), (None, "2", "calls")], "source string, target string, relation string")
    findings = spark.createDataFrame([("d.md", "a.ts", "open"), ("d.md", None, "open"), ("d.md", "b.ts", "resolved"), ("gone", None, "open")], "path string, target string, status string")
    pairs = spark.createDataFrame([("a.ts", "b.ts", 20, "2024-01-01"), ("a.ts", "gone.ts", 20, "2024-01-01")], "a string, b string, times long, last string").withColumn("last", F.col("last").cast("date"))
    as_of = F.lit("2024-03-31").cast("date")
    got = {r.path: r for r in reports.workspace_risk(artifacts, edges, findings, pairs, as_of, spark.createDataFrame([("c.ts",)], "path string"), 10).collect()}
    assert set(got) == {"a.ts", "b.ts", "web/package.json", "d.md"}
    a = got["a.ts"]
    assert (a.item, a.findings, a.untested, float(a.fan_in), float(a.co_change), float(a.audit)) == ("1", 1, 1, 2.0, 0.5, 0.0) and a.level == "high"
    assert (got["b.ts"].untested, float(got["b.ts"].fan_in), float(got["b.ts"].co_change)) == (0, 0.0, 0.5)
    assert float(got["web/package.json"].audit) == 1.5 and got["web/package.json"].untested == 0
    assert (got["d.md"].findings, got["d.md"].level) == (2, "moderate")
    bare = {r.path: r.untested for r in reports.workspace_risk(artifacts, edges, findings).collect()}
    assert bare == {"a.ts": 1, "c.ts": 1, "d.md": 0}
    none = reports.workspace_risk(artifacts.limit(0), edges, findings).collect()
    assert none == []

    nodes = artifacts.select("id", F.lit("artifact").alias("type"), F.lit("open").alias("status"), "path", F.lit("x").alias("domain"), F.when(F.col("classification") == "code_metadata", "code").alias("unit"), F.array().cast("array<string>").alias("families"), F.array().cast("array<string>").alias("relations"), F.lit(None).cast("string").alias("summary_state"))
    scored = reports.workspace_risk(artifacts, edges, findings, pairs, as_of)
    assert [r.path for r in workspace.saved_query(nodes, "risk-top-10", scored).collect()] == ["a.ts", "c.ts", "b.ts"]


def test_webhook_deliveries(spark):
    """Each way in which a delivery is ignored or rejected, and what an accepted one gives."""
    sha, other = "a" * 40, "b" * 40
    base = {"repository": {"id": 5, "full_name": "o/r"}, "installation": {"id": 7}}
    commits = [{"id": sha, "added": ["b", "a"], "modified": ["a"], "removed": None}, {"id": other, "added": ["one"]}, {"id": "short", "added": ["a", "b"]}]
    cases = {
        "push": ("push", base | {"after": sha, "commits": commits}),
        "run": ("check_run", base | {"action": "completed", "check_run": {"head_sha": other, "conclusion": None}}),
        "flow": ("workflow_run", base | {"action": "completed", "workflow_run": {"head_sha": other, "conclusion": "failure"}}),
        "queued": ("workflow_run", base | {"action": "requested", "workflow_run": {"head_sha": other}}),
        "no action": ("check_run", base | {"check_run": {"head_sha": other}}),
        "other": ("issues", base), "no event": (None, base), "short sha": ("push", base | {"after": "abc"}), "no repository": ("push", {"after": sha, "installation": {"id": 7}}),
        "no id": ("push", base | {"after": sha, "installation": {}}), "other run": ("check_run", base | {"action": "completed", "workflow_run": {"head_sha": other}}),
    }
    rows = [(k, e, json.dumps(p)) for k, (e, p) in cases.items()] + [("broken", "push", "{no"), ("null", "push", None)]
    got = {r.delivery: r for r in sources.webhook_events(spark.createDataFrame(rows, "delivery string, event string, payload string")).collect()}
    assert {k: r.outcome for k, r in got.items()} == {
        "push": "accepted", "run": "accepted", "flow": "accepted", "queued": "ignored", "no action": "rejected", "other": "ignored", "no event": "ignored", "short sha": "rejected",
        "no repository": "rejected", "no id": "rejected", "other run": "rejected", "broken": "rejected", "null": "rejected",
    }
    push, flow = got["push"], got["flow"]
    assert [(c.sha, c.paths) for c in push.commits] == [(sha, ["a", "b"])] and (push.sha, push.action, push.repository, push.repository_id, push.installation) == (sha, None, "o/r", 5, 7)
    assert (flow.action, flow.sha, flow.conclusion, flow.commits) == ("completed", other, "failure", []) and len(flow.digest) == 64
    assert got["broken"].digest is None and got["queued"].sha is None
