"""Report readers, sinks and trial statistics on small inputs."""

import json
import math

import numpy as np

from pyspark.sql import functions as F

from tessellar.operators import assurance, progress, sinks, trials
from tessellar.sources import reports


def plain_draws(key, n):
    h = 0x811C9DC5
    for ch in key:
        h = ((h ^ ord(ch)) * 0x01000193) & 0xFFFFFFFF
    out = []
    for _ in range(n):
        h = (h + 0x6D2B79F5) & 0xFFFFFFFF
        v = ((h ^ (h >> 15)) * (h | 1)) & 0xFFFFFFFF
        v ^= (v + (((v ^ (v >> 7)) * (v | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        out.append(((v ^ (v >> 14)) & 0xFFFFFFFF) / 4294967296)
    return out


def plain_interval(values, key):
    draws, n = plain_draws(key, 2000 * len(values)), len(values)
    means = sorted(sum(values[int(draws[r * n + i] * n)] for i in range(n)) / n for r in range(2000))
    return round(means[50], 6), round(means[math.ceil(0.975 * 2000) - 1], 6)


def test_intervals_are_those_of_plain_resampling(spark):
    assert trials.draws(trials.seed_of("a\0b"), 50).tolist() == plain_draws("a\0b", 50)
    r = np.random.default_rng(0)
    rows = [(arm, i, float(v)) for arm in ("x", "y") for i, v in enumerate(r.normal(0, 3, 17))]
    got = {x.arm: (x.n, x.lower, x.upper) for x in trials.bootstrap(spark.createDataFrame(rows, "arm string, i int, v double"), "arm", "v", ["i"]).collect()}
    for arm in ("x", "y"):
        low, high = plain_interval([v for a, _, v in rows if a == arm], arm)
        assert got[arm][0] == 17 and abs(got[arm][1] - low) < 2e-6 and abs(got[arm][2] - high) < 2e-6


def test_gate_and_judgement(spark):
    rows = [(f"t{i}", "m", 1, float(i % 2), float(i % 2) + 0.2, 100, 60) for i in range(20)]
    one = trials.gate(spark.createDataFrame(rows, "task string, model string, trial int, baseline_score double, treatment_score double, baseline_tokens long, treatment_tokens long")).first()
    assert (one.units, one.delta, one.lower, one.upper, one.token_reduction, one.not_worse, one.better) == (20, 20.0, 20.0, 20.0, 40.0, True, True)
    arms = spark.createDataFrame([("m", "a", 0.5), ("m", "b", 0.7), (None, "a", 0.5), (None, "b", 0.5)], "model string, arm string, mean_score double")
    assert {(r.model, r.verdict) for r in trials.judged(arms, "a", "b", 0.1).collect()} == {("m", "better"), (None, "even")}
    facts = spark.createDataFrame([("t", "f1", ["pull_requests: write"]), ("t", "f2", ["none", "nothing"])], "task string, fact string, aliases array<string>")
    assert trials.fact_grades(facts, spark.createDataFrame([("t", "It needs PULL requests  write")], "task string, answer string")).first()["score"] == 0.5
    commits = spark.createDataFrame([("1", "fix: a", ["x", "x", "y"]), ("2", "feat: b", ["x"]), ("3", "Fix b", ["x"])], "sha string, subject string, paths array<string>")
    assert {(r.path, r.touches) for r in trials.fix_touches(commits, "(?i)^fix").collect()} == {("x", 2), ("y", 1)}
    uses = spark.createDataFrame([("a", ["t"], 10, 2, 5), ("a", ["u"], 20, 2, 0), ("b", None, 0, 0, 0)], "arm string, tools array<string>, input int, calls int, cached int")
    assert uses.groupBy().agg(trials.adoption(uses, "t")).first()[0] == 1 / 3
    assert {(r.arm, r.tokens_per_call, r.cache_share) for r in trials.tokens_a_call(uses).collect()} == {("a", 7.5, 5 / 30), ("b", None, None)}
    runs = spark.createDataFrame([("r1", {"a": 1, "b": 2}), ("r2", {"a": 1})], "run string, counts map<string,int>")
    assert {(r.title, r.n, r.runs) for r in trials.todo_duplication(runs).collect()} == {("a", 2, 2), ("b", 2, 1)}


def test_test_reports(spark):
    junit = '<testsuites><testsuite><testcase name="REQ-A1 works &lt;b&gt;" file="t/a.test.ts"/><testcase classname="t/b.test.ts" name="x"><failure message="m">no</failure></testcase><testcase name="s" file="t/c.test.ts"><skipped/></testcase></testsuite></testsuites>'
    vitest = json.dumps({"testResults": [{"name": "t/d.test.ts", "assertionResults": [{"fullName": "REQ-B2 d", "status": "passed"}, {"title": "e", "status": "pending"}]}, {"name": "t/f.test.ts", "assertionResults": [{"title": "REQ-C3", "status": "passed"}]}]})
    df = spark.createDataFrame([(1, "junit", "h", junit), (2, "vitest", "h", vitest)], "report int, format string, head_sha string, content string")
    cases = reports.test_cases(df)
    assert sorted((r.test_file, r.test_name, r.status) for r in cases.collect()) == [("t/a.test.ts", "REQ-A1 works <b>", "passed"), ("t/b.test.ts", "x", "failed"), ("t/c.test.ts", "s", "skipped"), ("t/d.test.ts", "REQ-B2 d", "passed"), ("t/d.test.ts", "e", "skipped"), ("t/f.test.ts", "REQ-C3", "passed")]
    assert reports.report_faults(df).collect() == []
    bad = spark.createDataFrame([(1, "junit", "no"), (2, "vitest", "{"), (3, "other", "x"), (4, "junit", None)], "report int, format string, content string")
    assert sorted(r.report for r in reports.report_faults(bad).collect()) == [1, 2, 3, 4]
    checks = spark.createDataFrame([("h", "completed", "success")], "head_sha string, status string, conclusion string")
    got = {r.test_file: (r.grade, r.reason[:20], r.requirement_ids) for r in reports.test_evidence(df, cases, checks, "h").collect()}
    assert got["t/f.test.ts"] == ("verified", "Passing parsed repor", ["REQ-C3"]) and got["t/a.test.ts"] == ("inferred", "Parsed test report d", ["REQ-A1"])
    assert got["t/b.test.ts"][1] == "Mapped test case did" and got["t/d.test.ts"] == ("inferred", "Mapped test case was", ["REQ-B2"])
    assert {r.grade for r in reports.test_evidence(df, cases, checks.limit(0), "h").collect()} == {"inferred"}


def test_coverage_audits_issues_and_pushes(spark):
    df = spark.createDataFrame([("a", "lcov", "TN:\nSF:/x/a.ts\nend_of_record\nSF:b.ts"), ("b", "istanbul", '{"total": {}, "b.ts": {}, "c.ts": {}}'), ("c", "istanbul", "[1]"), ("d", "lcov", "nothing")], "report string, format string, content string")
    named, faults = reports.covered_paths(df)
    assert {(r.path, r.report) for r in named.collect()} == {("/x/a.ts", "a"), ("b.ts", "a"), ("c.ts", "b")} and {r.report for r in faults.collect()} == {"c", "d"}
    audit = {"auditReportVersion": 2, "vulnerabilities": {"x": {"severity": "high", "via": ["y", {"title": "T", "url": "U"}], "isDirect": True, "range": "<1", "fixAvailable": {"isSemVerMajor": True}}, "y": {"name": "yy", "severity": "low", "via": [], "fixAvailable": True}}}
    broken = {"auditReportVersion": 2, "vulnerabilities": {"x": {"severity": "odd"}, "y": {"severity": "low"}}}
    rows = spark.createDataFrame([("1", json.dumps(audit)), ("2", json.dumps(broken)), ("3", "{"), ("4", '{"auditReportVersion": 1, "vulnerabilities": {}}')], "report string, content string")
    got = sorted((r.report, r.name, r.severity, r.is_direct, r.title or "", r.fix) for r in reports.audit_advisories(rows).collect())
    assert got == [("1", "x", "high", True, "T", "major"), ("1", "yy", "low", False, "", "patch")]
    issues = spark.createDataFrame([("i.jsonl", '{"id": "1", "title": "A", "status": "closed"}\nnot json\n\n{"id": "1", "title": "B"}\n{"id": "2", "title": " "}\n{"id": "3", "title": "C", "status": "odd"}')], "path string, text string")
    assert sorted((r.line, r.source_key, r.status, r.title) for r in reports.issue_items(issues).collect()) == [(1, "beads:i.jsonl:1", "done", "A"), (6, "beads:i.jsonl:3", "open", "C")]
    push = json.dumps({"commits": [{"id": "a" * 40, "timestamp": "2026-01-01T00:00:00Z", "added": ["b", "a"], "modified": ["a"], "removed": []}, {"id": "short", "added": ["x", "y"]}, {"id": "b" * 40, "added": ["one"]}]})
    assert [(r.sha[0], r.paths, r.counted) for r in reports.pushed_commits(spark.createDataFrame([(push,)], "payload string")).orderBy("sha").collect()] == [("a", ["a", "b"], True), ("b", ["one"], False)]


def test_manifests_and_settings(spark):
    rows = [("web/tsconfig.json", '{\n // note\n "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["./*", "../gen/*"], "cfg": ["config.ts"]}},\n}'), ("pkg/core/package.json", '{"name": "@x/core", "exports": {".": "./src/main.ts", "./sub": "./src/sub.ts"}}'), ("bad/package.json", "{")]
    got = [(r.scope, r.prefix, r.suffix, r.wildcard, r.target, r.tier) for r in reports.alias_rules(spark.createDataFrame(rows, "path string, text string")).orderBy("priority").collect()]
    assert got[:3] == [("web", "cfg", "", False, "web/src/config.ts", "resolved"), ("web", "@/", "", True, "web/src/*", "resolved"), ("web", "@/", "", True, "web/gen/*", "resolved")]
    assert ("", "@x/core/sub", "", False, "pkg/core/src/sub.ts", "resolved") in got and ("", "@x/core", "", False, "pkg/core/src/main.ts", "resolved") in got and ("", "@x/core/", "", True, "pkg/core/src/*", "reference") in got
    own = spark.createDataFrame([("c.json", '{"ignore": ["a/"], "todoFiles": ["T.md"], "progressDocs": ["P.md"]}'), ("d.json", "oops")], "path string, text string")
    assert [(r.path, r.ignore, r.todo_files, r.valid) for r in reports.settings(own).orderBy("path").collect()] == [("c.json", ["a/"], ["T.md", "P.md"], True), ("d.json", [], [], False)]


def test_local_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"hello\n")
    (tmp_path / "b.bin").write_bytes(b"a\x00b")
    got = {r.path: (r.sha, r.size, r.binary) for r in reports.local_tree(spark, str(tmp_path)).collect()}
    assert got["a/x.txt"] == ("ce013625030ba8dba906f756967f9e9ca394464a", 6, False) and got["b.bin"][1:] == (3, True)


def test_memory_keeps_its_cap(spark):
    rows = [(i, "n", f"k{i}", "a", "t", False) for i in range(13)] + [(20, "n", "k0", "a", "t", False), (21, "n", "k0", "a", "u", False), (22, "n", "k1", "a", None, True), (23, "n", "k12", "a", "t", False), (24, "n", "zz", "a", None, True), (25, "n", "k0", "b", "t", False)]
    got = {r.seq: r.outcome for r in sinks.memory_states(spark.createDataFrame(rows, "seq long, name string, entry_key string, anchor string, text string, remove boolean")).collect()}
    assert [got[i] for i in range(13)] == ["added"] * 12 + ["rejected_cap"] and [got[i] for i in range(20, 26)] == ["noop", "updated", "invalidated", "added", "noop", "added"]


def test_slugs_concepts_receipts_and_dismissals(spark):
    before = spark.createDataFrame([("repo", "i1", "old", ["older"]), ("repo", "i2", "same", [])], "scope string, identity string, slug string, previous array<string>")
    now = spark.createDataFrame([("repo", "i1", "new"), ("repo", "i2", "same"), ("repo", "i3", "fresh")], "scope string, identity string, slug string")
    assert {(r.identity, r.slug, tuple(r.previous)) for r in sinks.page_slugs(before, now).collect()} == {("i1", "new", ("older", "old")), ("i2", "same", ()), ("i3", "fresh", ())}
    concepts = spark.createDataFrame([("c1", ["a.ts", "gone"], [("uses", "c2"), ("likes", "c2"), ("uses", "c9"), ("uses", "c1")]), ("c2", ["gone"], None)], "slug string, members array<string>, links array<struct<relation:string,target:string>>")
    got = {r.slug: (r.members, [tuple(x) for x in r.links or []], r.valid) for r in sinks.valid_concepts(concepts, spark.createDataFrame([("a.ts",)], "path string"), ["uses"]).collect()}
    assert got == {"c1": (["a.ts"], [("uses", "c2")], True), "c2": ([], [], False)}
    chain = spark.createDataFrame([("r", 1, "d1", None), ("r", 2, "d2", "d1"), ("r", 3, "d3", "d1")], "repository string, created_at int, digest string, previous string")
    assert [r.continuous for r in assurance.receipt_chain(chain).orderBy("created_at").collect()] == [True, True, False]
    found = spark.createDataFrame([("f1", "open"), ("f2", "resolved"), ("f3", "open")], "id string, status string")
    given = spark.createDataFrame([("f1", 1, "why"), ("f2", 1, "why"), ("f3", 1, "  ")], "id string, at int, reason string")
    assert {(r.id, r.status) for r in assurance.dismissed(found, given).collect()} == {("f1", "dismissed"), ("f2", "resolved"), ("f3", "open")}
    old = spark.createDataFrame([("p", "REQ-1", "active"), ("p", "REQ-2", "active"), ("p", "REQ-3", "superseded")], "path string, identity string, status string")
    needs = spark.createDataFrame([("p", "REQ-1", "s"), ("p", "REQ-3", "s"), ("p", None, "free text")], "path string, id string, statement string")
    assert {(r.identity, r.state) for r in assurance.reconcile_requirements(old, needs).collect()} == {("REQ-1", "kept"), ("REQ-2", "superseded"), ("REQ-3", "revived"), ("free text", "added")}


def test_migrated_keys_and_latest(spark):
    todos = spark.createDataFrame([(1, "k1", "Do it"), (2, "k2", "Other"), (3, "k3", "Keep")], "id int, source_key string, title string")
    incoming = spark.createDataFrame([("n1", "- [ ] do  IT."), ("k3", "Keep"), ("n9", "Unknown")], "source_key string, title string")
    assert [(r.id, r.source_key) for r in progress.migrated_keys(todos, incoming).collect()] == [(1, "n1")]
    scans = spark.createDataFrame([("h", 1, "a"), ("h", 3, "b"), ("h", None, "c"), ("x", 9, "d")], "head string, done int, id string")
    assert [r.id for r in progress.latest_for(scans, "head", "h", "done", ["id"]).collect()] == ["b"]
