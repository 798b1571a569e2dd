"""Reports that tools write: test runs, coverage, dependency audits, issue exports, webhooks, manifests, settings.

Rows have a report id (or path) and its content as text; what can't be read gives diagnostics instead of failing the job.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.functions.paths import directory, joined_path
from tessellar.functions.words import clipped
from tessellar.sources.markdown import lines, requirement_ids

#: Statuses of an issue export, what any other means, and severities of an audit from worst on.
ISSUE_STATUS = {"open": "open", "in_progress": "in-progress", "in-progress": "in-progress", "blocked": "blocked", "closed": "done", "done": "done"}
AUDIT_SEVERITIES = ("critical", "high", "moderate", "low", "info")
#: A case of a JUnit file and its parts.
CASE = r"(?s)<testcase\b([^>]*?)(?:/>|>(.*?)</testcase>)"
VITEST = "struct<testResults:array<struct<name:string,assertionResults:array<struct<fullName:string,title:string,status:string>>>>>"


def _attribute(text: Column, name: str) -> Column:
    raw = F.nullif(F.regexp_extract(text, rf'\b{name}="([^"]*)"', 1), F.lit(""))
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(code), F.lit(sign))
    return raw


def test_cases(reports: DataFrame) -> DataFrame:
    """(report, n, test_file, test_name, status) of reports (report, format: junit or vitest, content): passed, failed, skipped."""
    junit = reports.where("format = 'junit'").select("report", F.posexplode(F.regexp_extract_all("content", F.lit(CASE), F.lit(0))).alias("n", "c"))
    head, body = F.regexp_extract("c", CASE, 1), F.regexp_extract("c", CASE, 2)
    file = F.coalesce(_attribute(head, "file"), _attribute(head, "classname"), F.lit(""))
    name = F.coalesce(_attribute(head, "name"), F.lit(""))
    status = F.when(body.rlike(r"<(failure|error)\b"), "failed").when(body.rlike(r"<skipped\b"), "skipped").otherwise("passed")
    out = junit.select("report", "n", file.alias("test_file"), name.alias("test_name"), status.alias("status"))
    parsed = reports.where("format = 'vitest'").select("report", F.from_json("content", VITEST).alias("j"))
    runs = parsed.select("report", F.explode("j.testResults").alias("f")).select("report", F.col("f.name").alias("test_file"), F.posexplode("f.assertionResults").alias("n", "a"))
    kinds = F.when(F.col("a.status") == "passed", "passed").when(F.col("a.status") == "failed", "failed").otherwise("skipped")
    return out.unionByName(runs.select("report", "n", "test_file", F.coalesce("a.fullName", "a.title", F.lit("")).alias("test_name"), kinds.alias("status")))


def report_faults(reports: DataFrame) -> DataFrame:
    """(report, message) of test reports that can't be read; one of them voids all."""
    junit = ~F.col("content").rlike(r"<testsuites?\b") | ~F.col("content").rlike(r"(?s)</testsuites?>|<testsuites?\b[^>]*/>")
    vitest = F.from_json("content", VITEST)["testResults"].isNull()
    bad = F.when(F.col("format") == "junit", junit).when(F.col("format") == "vitest", vitest).otherwise(True)
    return reports.where(F.coalesce(bad, F.lit(True))).select("report", F.concat(F.lit("not a "), "format", F.lit(" report")).alias("message"))


def test_evidence(reports: DataFrame, cases: DataFrame, checks: DataFrame, commit: str) -> DataFrame:
    """(test_file, grade, verdict, reason, requirement_ids, sources) of test files.

    Verified are files all of whose cases passed in reports (report, head_sha) that passed as a whole, for the analysed
    commit, with a successful check (head_sha, status, conclusion) of it; else inferred, with the first reason by report and case.
    """
    good = not checks.where((F.col("head_sha") == commit) & (F.col("status") == "completed") & (F.col("conclusion") == "success")).isEmpty()
    passed = cases.groupBy("report").agg(F.min(F.col("status") != "failed").alias("passed"))
    rows = cases.where("test_file <> ''").join(reports.select("report", "head_sha"), "report").join(passed, "report")
    own = F.when(F.col("status") == "failed", "Mapped test case did not pass.").when(F.col("status") == "skipped", "Mapped test case was skipped.")
    whole = F.when(F.col("head_sha") != commit, "The report is of another commit.").when(~F.col("passed"), "Parsed test report did not pass.").when(F.lit(not good), "No successful check run matches the analyzed commit.")
    rows = rows.withColumn("reason", F.coalesce(own, whole))
    at = F.struct("report", "n")
    out = rows.groupBy("test_file").agg(F.max(F.col("reason").isNotNull()).alias("bad"), F.min_by("reason", F.when(F.col("reason").isNotNull(), at)).alias("why"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(requirement_ids(F.col("test_name")))))).alias("requirement_ids"), F.count("*").alias("sources"))
    ok = ~F.col("bad")
    return out.select("test_file", F.when(ok, "verified").otherwise("inferred").alias("grade"), F.when(ok, "supports").otherwise("unknown").alias("verdict"), F.when(ok, "Passing parsed reports and checks match the analyzed commit.").otherwise(F.col("why")).alias("reason"), "requirement_ids", "sources")


def covered_paths(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, report, format): files that coverage reports (report, format: lcov or istanbul, content) name, each with its first report; and the reports that name none."""
    lcov = F.filter(F.transform(F.split("content", "\r?\n"), lambda x: F.when(x.startswith("SF:"), F.trim(F.substring(x, 4, 10_000)))), lambda p: p.isNotNull() & (p != ""))
    keys = F.filter(F.coalesce(F.json_object_keys("content"), F.array().cast("array<string>")), lambda k: k != "total")
    read = reports.withColumn("paths", F.when(F.col("format") == "lcov", lcov).otherwise(keys))
    named = read.select(F.explode("paths").alias("path"), "report", "format").groupBy("path").agg(F.min_by(F.struct("report", "format"), F.col("report")).alias("r")).select("path", "r.*")
    return named, read.where(F.size(F.coalesce("paths", F.array().cast("array<string>"))) == 0).select("report", F.concat(F.lit("no file in this "), "format", F.lit(" report")).alias("message"))


def audit_advisories(reports: DataFrame) -> DataFrame:
    """(report, name, severity, is_direct, range, title, url, fix) of dependency audits of the second version; a report with one bad entry gives nothing."""
    doc = "struct<auditReportVersion:int,vulnerabilities:map<string,struct<name:string,severity:string,isDirect:boolean,range:string,via:string,fixAvailable:string>>>"
    parsed = reports.select("report", F.from_json("content", doc).alias("j")).where("j.auditReportVersion = 2 and j.vulnerabilities is not null")
    each = parsed.select("report", F.explode("j.vulnerabilities").alias("key", "v"))
    known = F.col("v.severity").isin(*AUDIT_SEVERITIES)
    each = each.withColumn("_bad", F.max(~F.coalesce(known, F.lit(False))).over(W.partitionBy("report"))).where("not _bad")
    fix = F.when(F.col("v.fixAvailable") == "true", "patch").when(F.get_json_object("v.fixAvailable", "$.isSemVerMajor") == "true", "major").when(F.col("v.fixAvailable").startswith("{"), "patch").otherwise("none")
    one = F.try_element_at(F.filter(F.from_json("v.via", "array<string>"), lambda x: x.startswith("{")), F.lit(1))
    return each.select("report", F.coalesce("v.name", "key").alias("name"), "v.severity", F.coalesce("v.isDirect", F.lit(False)).alias("is_direct"), "v.range", F.get_json_object(one, "$.title").alias("title"), F.get_json_object(one, "$.url").alias("url"), F.coalesce(fix, F.lit("none")).alias("fix"))


def issue_items(exports: DataFrame) -> DataFrame:
    """(path, line, source_key, status, title) of issue exports, one JSON object a line; the first line of an id counts, lines that are none are left out."""
    rows = lines(exports, "path", "text").withColumnRenamed("doc_id", "path")
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    j = F.from_json("text", "id string, title string, status string")
    rows = rows.select("path", "line", text(j["id"]).alias("id"), text(j["title"]).alias("title"), j["status"].alias("status")).where("id is not null and title is not null")
    status = F.lit("open")
    for raw, s in ISSUE_STATUS.items():
        status = F.when(F.lower("status") == raw, s).otherwise(status)
    first = rows.groupBy("path", "id").agg(F.min_by(F.struct("line", status.alias("status"), clipped(F.col("title")).alias("title")), "line").alias("r"))
    return first.select("path", "r.line", F.concat(F.lit("beads:"), "path", F.lit(":"), "id").alias("source_key"), "r.status", "r.title")


def pushed_commits(events: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """(sha, at, paths, counted) of push events (payload): each commit's touched paths, sorted, and whether they are few enough to count pairs of."""
    commit = "struct<commits:array<struct<id:string,timestamp:string,added:array<string>,modified:array<string>,removed:array<string>>>>"
    rows = events.select(F.explode(F.from_json("payload", commit)["commits"]).alias("c"))
    none = F.array().cast("array<string>")
    paths = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(f"c.{k}", none) for k in ("added", "modified", "removed")])))
    rows = rows.select(F.col("c.id").alias("sha"), F.try_to_timestamp("c.timestamp").alias("at"), paths.alias("paths"))
    return rows.where(F.col("sha").rlike("^[0-9a-f]{40}$")).withColumn("counted", F.size("paths").between(least, most))


def webhook_events(events: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """What deliveries (delivery, event, payload) of pushes, check runs and workflow runs say: (delivery, event, outcome, action, sha, conclusion, installation, repository, repository_id, digest, commits).

    Other events are ignored, and so are runs that aren't completed; a payload that can't be read or lacks a field, or whose
    commit is no full hash, is rejected. Of both nothing but the outcome is given. ``commits`` (sha, paths) has a push's
    commits with few enough paths to count pairs of.
    """
    change = "array<struct<id:string,added:array<string>,modified:array<string>,removed:array<string>>>"
    run = "struct<head_sha:string,conclusion:string>"
    body = F.from_json("payload", f"struct<action:string,after:string,repository:struct<id:bigint,full_name:string>,installation:struct<id:bigint>,check_run:{run},workflow_run:{run},commits:{change}>")
    rows = events.select("delivery", "event", F.sha2("payload", 256).alias("digest"), body.alias("j"))
    push, none = F.col("event") == "push", F.array().cast("array<string>")
    ran = F.when(F.col("event") == "check_run", F.col("j.check_run")).when(F.col("event") == "workflow_run", F.col("j.workflow_run"))
    sha = F.when(push, F.col("j.after")).otherwise(ran["head_sha"])
    paths = lambda c: F.array_sort(F.array_distinct(F.concat(*[F.coalesce(c[k], none) for k in ("added", "modified", "removed")])))
    told = F.transform(F.coalesce("j.commits", F.array().cast(change)), lambda c: F.struct(c["id"].alias("sha"), paths(c).alias("paths")))
    counted = F.filter(told, lambda c: F.coalesce(c["sha"].rlike("^[0-9a-f]{40}$"), F.lit(False)) & F.size(c["paths"]).between(least, most))
    outcome = (
        F.when(~F.coalesce(F.col("event").isin("push", "check_run", "workflow_run"), F.lit(False)), "ignored")
        .when(F.col("j.repository").isNull() | F.col("j.installation").isNull() | (~push & F.col("j.action").isNull()), "rejected")
        .when(~push & (F.col("j.action") != "completed"), "ignored")
        .when(~F.coalesce(sha.rlike("^[0-9a-f]{40}$"), F.lit(False)), "rejected")
        .when(F.col("j.repository.id").isNull() | F.col("j.repository.full_name").isNull() | F.col("j.installation.id").isNull(), "rejected")
        .otherwise("accepted")
    )
    given = {"action": F.when(~push, F.col("j.action")), "sha": sha, "conclusion": ran["conclusion"], "installation": F.col("j.installation.id"), "repository": F.col("j.repository.full_name"), "repository_id": F.col("j.repository.id"), "digest": F.col("digest"), "commits": F.when(push, counted).otherwise(F.filter(counted, lambda c: F.lit(False)))}
    return rows.withColumn("outcome", outcome).select("delivery", "event", "outcome", *[F.when(F.col("outcome") == "accepted", c).alias(n) for n, c in given.items()])


def alias_rules(manifests: DataFrame) -> DataFrame:
    """(priority, scope, prefix, suffix, wildcard, target, tier) of module aliases that manifests (path, text) state.

    Paths of a tsconfig hold below its directory and are relative to its base; a package's name leads to its exports, or to its
    source directory. Inner scopes come first, then longer prefixes, then tsconfig before packages.
    """
    scope = directory(F.col("path"))
    ts = manifests.where(F.col("path").rlike(r"(?:^|/)(?:tsconfig|jsconfig)[\w.-]*\.json$"))
    bare = F.regexp_replace(F.regexp_replace("text", r"(?m)^\s*//.*$", ""), r",(\s*[}\]])", "$1")
    j = F.from_json(bare, "struct<compilerOptions:struct<baseUrl:string,paths:map<string,array<string>>>>")["compilerOptions"]
    rules = ts.select(scope.alias("scope"), F.coalesce(j["baseUrl"], F.lit(".")).alias("base"), F.explode(j["paths"]).alias("pattern", "targets"))
    rules = rules.select("scope", "pattern", F.posexplode("targets").alias("n", "t"), "base").select("scope", "pattern", "n", joined_path(F.col("scope"), F.col("base"), F.col("t")).alias("target"), F.lit(0).alias("source"), F.lit("resolved").alias("tier"))
    pk = manifests.where(F.col("path").rlike(r"(?:^|/)package\.json$"))
    p = F.from_json("text", "struct<name:string,main:string,exports:string>")
    named = pk.select(scope.alias("home"), p["name"].alias("name"), p["main"].alias("main"), F.from_json(p["exports"], "map<string,string>").alias("exports")).where("name is not null")
    given = named.select("home", "name", F.explode("exports").alias("sub", "to")).where(F.col("to").startswith("."))
    whole = given.select(F.lit("").alias("scope"), F.concat("name", F.substring("sub", 2, 1000)).alias("pattern"), F.lit(0).alias("n"), joined_path(F.col("home"), F.col("to")).alias("target"), F.lit(1).alias("source"), F.lit("resolved").alias("tier"))
    guess = named.select("home", "name", F.explode(F.array(F.struct(F.lit("").alias("end"), F.coalesce("main", F.lit("src/index")).alias("to")), F.struct(F.lit("/*").alias("end"), F.lit("src/*").alias("to")))).alias("g"))
    guessed = guess.select(F.lit("").alias("scope"), F.concat("name", "g.end").alias("pattern"), F.lit(9).alias("n"), joined_path(F.col("home"), F.col("g.to")).alias("target"), F.lit(2).alias("source"), F.lit("reference").alias("tier"))
    every = rules.unionByName(whole).unionByName(guessed).where("target is not null")
    star = F.col("pattern").contains("*")
    parts = every.select("scope", F.substring_index("pattern", "*", 1).alias("prefix"), F.when(star, F.substring_index("pattern", "*", -1)).otherwise("").alias("suffix"), star.alias("wildcard"), "target", "tier", "source", "n")
    order = W.orderBy(F.desc(F.length("scope")), F.desc(F.length("prefix")), "source", "prefix", "scope", "n", "target")
    return parts.withColumn("priority", F.row_number().over(order)).select("priority", "scope", "prefix", "suffix", "wildcard", "target", "tier")  # rules are few: a repository's manifests


def settings(files: DataFrame, most: int = 50) -> DataFrame:
    """(path, ignore, todo_files, section_tokens, valid) of a repository's own settings; lists are cut to 50 entries, a file that is no JSON object has none."""
    j = F.from_json("text", "struct<ignore:array<string>,todoFiles:array<string>,progressDocs:array<string>,sectionTokens:array<string>>")
    none = F.array().cast("array<string>")
    cut_ = lambda *cs: F.slice(F.concat(*[F.coalesce(c, none) for c in cs]), 1, most)
    return files.select("path", cut_(j["ignore"]).alias("ignore"), cut_(j["todoFiles"], j["progressDocs"]).alias("todo_files"), cut_(j["sectionTokens"]).alias("section_tokens"), F.col("text").rlike(r"(?s)^\s*\{.*\}\s*$").alias("valid"))


def tree_entries(tree: DataFrame, previous: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """(path, state) of a scan: skipped with a reason, unchanged (same blob), changed, added; and removed for what was there before.

    The tree has path, mode, sha, size and binary; what was there before has path and sha.
    """
    from tessellar.functions.words import skip_reason

    reason = skip_reason(F.col("mode"), F.col("size"), F.coalesce("binary", F.lit(False)), most_bytes)
    both = tree.withColumn("reason", reason).join(previous.select("path", F.col("sha").alias("before"), F.lit(True).alias("known")), "path", "full_outer")
    state = F.when(F.col("mode").isNull(), "removed").when(F.col("reason").isNotNull(), F.concat(F.lit("skipped:"), "reason")).when(F.col("known").isNull(), "added").when(F.col("before") == F.col("sha"), "unchanged").otherwise("changed")
    return both.select("path", state.alias("state"))


def local_tree(spark, root: str) -> DataFrame:
    """(path, mode, sha, size, binary, content) of a directory's files, read by Spark; the sha is the one git gives."""
    from tessellar.functions.words import git_blob_sha, is_binary

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # what is read are URLs: decoded (a plus sign is itself there), and without the root, counted in characters and not taken as a pattern
    whole = F.url_decode(F.replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    base = re.sub("^[a-z]+:/*", "/", root).rstrip("/") + "/"
    name = F.when(whole.startswith(base), F.substring(whole, len(base) + 1, 1 << 20)).otherwise(whole)
    return rows.select(name.alias("path"), F.lit("100644").alias("mode"), git_blob_sha(F.col("content")).alias("sha"), F.col("length").alias("size"), is_binary(F.col("content")).alias("binary"), "content")


def recorded_tree(spark, path: str):
    """(path, mode, type, sha, size) of a recorded tree document: a JSON object with a list of entries, over several lines."""
    doc = spark.read.schema("sha string, truncated boolean, tree array<struct<path:string,mode:string,type:string,sha:string,size:bigint>>").option("multiLine", "true").json(path)
    return doc.select(F.explode("tree").alias("e")).select("e.*")
