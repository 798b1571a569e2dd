"""Progress, teams, pilots, commits and maps: what happened when, and how far it got."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.functions.words import half_up, todo_title

#: Days after which work in progress is stale; measurements that a card needs.
STALE_DAYS = 7
THRESHOLDS = {"pack_measurements": 2, "reported_reports": 5, "served_measured_calls": 20}
METRICS = ("V1", "V2", "V3", "V4", "V5", "V6", "V7")


def timeline(**kinds: DataFrame) -> DataFrame:
    """(kind, id, at, refs) of several kinds of events, rows (id, at, refs) each."""
    out = None
    for kind, rows in kinds.items():
        own = rows.select(F.lit(kind.replace("_", "-")).alias("kind"), F.col("id").cast("string").alias("id"), "at", "refs")
        out = own if out is None else out.unionByName(own)
    return out


def newest_first() -> list[Column]:
    """The order of a timeline: unreadable instants first, then the latest, then by id."""
    return [F.col("at").desc_nulls_first(), F.col("id").asc()]


def digest(events: DataFrame, as_of: Column, visited: Column | None = None) -> DataFrame:
    """(window, n, commits, progress, findings_resolved, refs): events of today, of seven days and since a visit; refs are distinct and sorted. Without a visit that window has no row."""
    day = F.date_trunc("day", as_of)
    windows = {"today": day, "week": as_of - F.expr("interval 7 days")} | ({"since-visit": visited} if visited is not None else {})
    inside = F.array_compact(F.array(*[F.when(F.col("at") >= start, F.lit(name)) for name, start in windows.items()]))
    rows = events.select("kind", "refs", F.explode(inside).alias("window"))
    n = lambda k: F.count_if(F.col("kind") == k)
    refs = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("refs", F.array().cast("array<string>"))))))
    found = rows.groupBy("window").agg(F.count("*").alias("n"), n("commit").alias("commits"), n("progress").alias("progress"), n("finding-resolved").alias("findings_resolved"), refs.alias("refs"))
    every = events.sparkSession.createDataFrame([(w,) for w in windows], "window string")
    zero = F.lit(0).cast("long")
    return every.join(found, "window", "left").select("window", *[F.coalesce(c, zero).alias(c) for c in ("n", "commits", "progress", "findings_resolved")], F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))


def attention(todos: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """(id, reason) of tasks (id, status, updated_at): stale ones, in progress for more than seven days, and blocked ones with the last reason that an event (todo_id, status, summary, at) states."""
    stated = events.where("status = 'blocked' and trim(summary) <> ''").groupBy(F.col("todo_id").alias("id")).agg(F.max_by("summary", "at").alias("summary"))
    late = (F.col("status") == "in-progress") & (F.col("updated_at") < as_of - F.expr(f"interval {STALE_DAYS} days"))
    rows = todos.join(stated, "id", "left")
    return rows.select("id", F.when(late, "stale").when(F.col("status") == "blocked", F.coalesce("summary", F.lit("no blocker was recorded"))).alias("reason")).where("reason is not null")


def metric(completed: Column, total: Column, linked: Column | None = None) -> Column:
    """basis and percent: no-data without a total, no-links where nothing is linked, else measured; only a measured one has a percent."""
    basis = F.when(total == 0, "no-data").when((linked if linked is not None else F.lit(1)) == 0, "no-links").otherwise("measured")
    return F.struct(basis.alias("basis"), F.when(basis == "measured", half_up(completed / F.nullif(total, F.lit(0)) * 100, 0)).cast("int").alias("percent"))


def todo_matches(events: DataFrame, todos: DataFrame) -> DataFrame:
    """(event, todo): what a progress event (id, todo_id, source_key, title) is about: a task's id, else its key, else its title in normal form, the oldest of several. Three joins on equality, the first that meets counts."""
    own = todos.select(F.col("id").alias("todo"), "source_key", todo_title(F.col("title")).alias("norm"), "created_at")
    by_id = events.select(F.col("id").alias("event"), F.col("todo_id").alias("todo")).join(own, "todo").select("event", "todo", "created_at", F.lit(1).alias("place"))
    by_key = events.select(F.col("id").alias("event"), "source_key").join(own, "source_key").select("event", "todo", "created_at", F.lit(2).alias("place"))
    by_title = events.select(F.col("id").alias("event"), todo_title(F.col("title")).alias("norm")).where("norm <> ''").join(own, "norm").select("event", "todo", "created_at", F.lit(3).alias("place"))
    return by_id.unionByName(by_key).unionByName(by_title).groupBy("event").agg(F.min_by("todo", F.struct("place", "created_at", "todo")).alias("todo"))


def migrated_keys(todos: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, source_key): known tasks (id, source_key, title) that get an incoming key: same title in normal form, another key, and that key not taken. Of several, the least."""
    norm = lambda df: df.withColumn("norm", todo_title(F.col("title")))
    gone = norm(todos).join(incoming.select("source_key"), "source_key", "left_anti")
    free = norm(incoming).join(todos.select("source_key"), "source_key", "left_anti")
    pairs = gone.select("id", "norm").groupBy("norm").agg(F.min("id").alias("id")).join(free.groupBy("norm").agg(F.min("source_key").alias("source_key")), "norm")
    return pairs.select("id", "source_key")


def matched_receipts(runs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Runs (run, commit) with their receipt: that of the run, else the commit's without a run, the latest of several."""
    at = F.struct("created_at", "receipt")
    direct = receipts.where("run is not null").groupBy("run").agg(F.max_by("receipt", at).alias("own"))
    loose = receipts.where("run is null").groupBy("commit").agg(F.max_by("receipt", at).alias("other"))
    return runs.join(direct, "run", "left").join(loose, "commit", "left").select("run", "commit", F.coalesce("own", "other").alias("receipt"))


def latest_for(rows: DataFrame, key: str, value: str, at: str, columns: Sequence[str]) -> DataFrame:
    """The columns of the last completed row of each key for a value, such as a scan of the head commit."""
    done = rows.where(F.col(key) == value).where(F.col(at).isNotNull())
    return done.orderBy(F.desc(at), *columns).limit(1).select(*columns)


def team_scores(commits: DataFrame, receipts: DataFrame, prompts: DataFrame, proven: DataFrame, resolved: DataFrame, adopted: Sequence[str] = METRICS) -> DataFrame:
    """(user, V1 to V7, team_V1 to team_V7) from commits (user, sha), receipts (sha, verified, inferred), prompts (user, rubric_mean, verifiability), proven requirements (sha) and resolved findings (sha).

    V1 verified of all evidence, V2 resolved findings a commit, V3 proven requirements, V4 mean rubric, V5 commits with a
    receipt, V6 with a verified one, V7 prompts that can be verified. Null where there is nothing to divide by; the team's
    is the mean of the rounded personal values. Metrics that are not adopted are null.
    """
    own = commits.select("user", "sha").distinct()
    by_sha = receipts.groupBy("sha").agg(F.sum("verified").alias("verified"), F.sum("inferred").alias("inferred"), F.max(F.col("verified") > 0).alias("some"))
    n_proven, n_resolved = proven.groupBy("sha").agg(F.count("*").alias("proven")), resolved.groupBy("sha").agg(F.count("*").alias("resolved"))
    rows = own.join(by_sha, "sha", "left").join(n_proven, "sha", "left").join(n_resolved, "sha", "left")
    by_commit = rows.groupBy("user").agg(F.count("*").alias("commits"), F.sum("verified").alias("verified"), F.sum("inferred").alias("inferred"), F.count("some").alias("with"), F.count_if("some").alias("good"), F.sum("proven").alias("proven"), F.sum("resolved").alias("resolved"))
    by_prompt = prompts.groupBy("user").agg(F.avg("rubric_mean").alias("rubric"), F.avg(F.when(F.col("verifiability") >= 2, 1.0).otherwise(0.0)).alias("share"))
    both = by_commit.join(by_prompt, "user", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = F.nullif(F.col("commits"), F.lit(0))
    values = {
        "V1": zero("verified") / F.nullif(zero("verified") + zero("inferred"), F.lit(0)),
        "V2": F.when(n.isNotNull(), zero("resolved") / n),
        "V3": zero("proven").cast("double"),
        "V4": F.col("rubric"),
        "V5": F.col("with") / n,
        "V6": F.col("good") / n,
        "V7": F.col("share"),
    }
    shown = both.select("user", *[(half_up(c, 3) if m in adopted else F.lit(None).cast("double")).alias(m) for m, c in values.items()])
    team = shown.agg(*[half_up(F.avg(m), 3).alias(f"team_{m}") for m in METRICS])
    return shown.join(F.broadcast(team), F.lit(True), "left")  # one row


def contributions(commits: DataFrame, receipts: DataFrame, proven: DataFrame, resolved: DataFrame) -> DataFrame:
    """(user, commits, proven_ids, resolved, verified) of each user's distinct commits; ids are sorted."""
    own = commits.select("user", "sha").distinct()
    counts = own.groupBy("user").agg(F.count("*").alias("commits"))
    ids = own.join(proven, "sha").groupBy("user").agg(F.array_sort(F.collect_list("id")).alias("proven_ids"))
    done = own.join(resolved, "sha").groupBy("user").agg(F.count("*").alias("resolved"))
    good = own.join(receipts, "sha").groupBy("user").agg(F.sum("verified").alias("verified"))
    out = counts.join(ids, "user", "left").join(done, "user", "left").join(good, "user", "left")
    return out.select("user", "commits", F.coalesce("proven_ids", F.array().cast("array<string>")).alias("proven_ids"), F.coalesce("resolved", F.lit(0)).cast("long").alias("resolved"), F.coalesce("verified", F.lit(0)).cast("long").alias("verified"))


def pilot(packs: DataFrame, receipts: DataFrame, runs: DataFrame, usage: DataFrame) -> DataFrame:
    """One row: tokens that packs save, findings opened, resolved and their net change between first and last receipt, durations of runs and their change, calls served and reports, and the state of each card."""
    one = packs.agg(F.count("*").alias("packs"), F.coalesce(F.sum("selected"), F.lit(0)).alias("selected"), F.coalesce(F.sum("baseline"), F.lit(0)).alias("baseline"))
    at = F.struct("created_at", "receipt")
    two = receipts.agg(F.count("*").alias("receipts"), F.coalesce(F.sum("opened"), F.lit(0)).alias("opened"), F.coalesce(F.sum("resolved"), F.lit(0)).alias("resolved"), F.max_by("open_total", at).alias("latest_open"), F.min_by("open_total", at).alias("first_open"))
    took = (F.col("completed_at").cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double")) * 1000
    begun = F.struct("started_at", "run")
    three = runs.withColumn("ms", took).agg(F.count("*").alias("runs"), half_up(F.avg("ms"), 0).alias("average_ms"), F.min_by("ms", begun).alias("first_ms"), F.max_by("ms", begun).alias("latest_ms"))
    four = usage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "measured_calls", "reports")], F.count_if(F.col("calls") > 0).alias("served_days"))
    row = one.join(two, F.lit(True)).join(three, F.lit(True)).join(four, F.lit(True))  # four rows of one each
    state = lambda n, least: F.when(F.col(n) >= least, "ready").otherwise("insufficient-evidence")
    return row.select(
        "packs", "selected", "baseline", F.when(F.col("baseline") > 0, half_up((F.col("baseline") - F.col("selected")) / F.nullif("baseline", F.lit(0)) * 100, 1)).alias("reduction_percent"),
        "receipts", "opened", "resolved", "latest_open", F.when(F.col("receipts") >= 2, F.col("latest_open") - F.col("first_open")).alias("net_open_change"),
        "runs", "average_ms", "latest_ms", F.when((F.col("runs") >= 2) & (F.col("first_ms") > 0), half_up((F.col("latest_ms") - F.col("first_ms")) / F.nullif("first_ms", F.lit(0.0)) * 100, 1)).alias("duration_change_percent"),
        "calls", "measured_calls", "served_days", "reports",
        state("packs", THRESHOLDS["pack_measurements"]).alias("context_state"), state("measured_calls", THRESHOLDS["served_measured_calls"]).alias("served_state"), state("reports", THRESHOLDS["reported_reports"]).alias("reported_state"),
        F.when(F.col("receipts") < 2, "insufficient-evidence").otherwise("ready").alias("state"),
    )


def node_grades(nodes: DataFrame, findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, grade): broken with an open finding, verified with evidence that a run supports, else inferred."""
    open_ = findings.where("status = 'open'").select("id").distinct().withColumn("broken", F.lit(True))
    good = evidence.where("verdict = 'supports'").select("id").distinct().withColumn("verified", F.lit(True))
    rows = nodes.select("id").join(open_, "id", "left").join(good, "id", "left")
    return rows.select("id", F.when(F.col("broken"), "broken").when(F.col("verified"), "verified").otherwise("inferred").alias("grade"))


def requirement_shares(requirements: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: active requirements, those with an implementing and with a testing edge, and the percents; null without requirements."""
    active = requirements.where("status = 'active'").select("id").distinct()
    has = lambda r: edges.where(F.col("relation") == r).select(F.col("target").alias("id")).unionByName(edges.where(F.col("relation") == r).select(F.col("source").alias("id"))).distinct().withColumn(r, F.lit(1))
    rows = active.join(has("implements"), "id", "left").join(has("tests"), "id", "left")
    one = rows.agg(F.count("*").alias("requirements"), F.count("implements").alias("implemented"), F.count("tests").alias("tested"))
    share = lambda c: half_up(F.col(c) / F.nullif("requirements", F.lit(0)) * 100, 0).cast("int")
    return one.select("*", share("implemented").alias("implementation_percent"), share("tested").alias("tests_percent"))


def instruction_costs(files: DataFrame) -> DataFrame:
    """(loader, mode, files, tokens) of instruction files (path, class, tokens, globs, always): which agent loads what, and when.

    Root files always load, nested ones when work is below them; skills load on demand; rules of one agent always, by glob or on demand.
    """
    nested = F.col("path").contains("/")
    struct = lambda loader, mode: F.struct(F.lit(loader).alias("loader"), mode.alias("mode"))
    by_place = F.when(nested, "nested").otherwise("always")
    rule = F.when(F.coalesce("always", F.lit(False)), "always").when(F.size(F.coalesce("globs", F.array().cast("array<string>"))) > 0, "scoped").otherwise("on-demand")
    loads = (
        F.when(F.col("class") == "agents", F.array(struct("codex", by_place), struct("cursor", by_place)))
        .when(F.col("class") == "claude", F.array(struct("claude", by_place)))
        .when(F.col("class") == "skill", F.array(struct("claude", F.lit("on-demand"))))
        .when(F.col("class") == "cursor_rule", F.array(struct("cursor", rule)))
    )
    return files.select("tokens", F.explode(loads).alias("l")).groupBy("l.loader", "l.mode").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"))


def dominant(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """(key, value, n): the value that most rows of a key have, of equally frequent ones the one seen first."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    best = counted.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("first"), value)).alias("r"))
    return best.select(key, f"r.{value}", "r.n")


def zero_filled(rows: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """(key, n) for each of the keys, zero where no row has it."""
    counted = rows.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    return every.join(counted, "key", "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_family(edges: DataFrame, limits: DataFrame) -> DataFrame:
    """The first edges of each family by id, as many as its limit (family, most) says."""
    ranked = edges.join(F.broadcast(limits), "family").withColumn("_k", F.row_number().over(W.partitionBy("family").orderBy("id")))
    return ranked.where(F.col("_k") <= F.col("most")).drop("_k", "most")


def coalesced(events: DataFrame, node: str = "node", at: str = "ts", millis: int = 100) -> DataFrame:
    """(node, window, n, last_at): events of a node in windows of so many milliseconds, aligned to the epoch."""
    w = F.window(F.col(at).cast("timestamp"), f"{millis} milliseconds")
    return events.groupBy(node, w.alias("w")).agg(F.count("*").alias("n"), F.max(at).alias("last_at")).select(node, F.col("w.start").alias("window"), "n", "last_at")
