"""Progress, teams, evidence, sinks and trials over the star tables and events, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions.words import tokens_utf16
from tessellar.operators import progress, sinks, trials
from tessellar.sources import reports as readers
from tessellar.sources.tables import table


def _utc(c: str):
    return F.col(c).cast("timestamp")


def _last(spark: SparkSession, sf_dir: str, name: str, at: str):
    return F.lit(table(spark, sf_dir, name).agg(F.max(at)).first()[0]).cast("timestamp")


def _sum_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("refs", F.array_join("refs", ","))


def timeline_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last day, the last week and since a visit three days before the end, by kind, with what they refer to."""
    events = table(spark, sf_dir, "events")
    ref = F.array(F.concat(F.lit("k"), F.get_json_object("props", "$.k")))
    of = lambda kind: events.where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), _utc("ts").alias("at"), ref.alias("refs"))
    line = progress.timeline(commit=of("purchase"), progress=of("signup"), finding_resolved=of("error"), view=of("view"))
    as_of = _last(spark, sf_dir, "events", "ts")
    return _sum_digest(progress.digest(line, as_of, as_of - F.expr("interval 3 days")))


SQL_DIGEST = """with m as (select max(ts) m from events), w(name, start) as (select 'today', date_trunc('day', m) from m union all select 'week', m - interval 7 days from m union all select 'since-visit', m - interval 3 days from m)
select name as "window", count(*) n, count(*) filter (where event_type = 'purchase') commits, count(*) filter (where event_type = 'signup') progress, count(*) filter (where event_type = 'error') findings_resolved, string_agg(distinct r, ',' order by r) refs
from (select *, 'k' || json_extract_string(props, '$.k') r from events where event_type in ('purchase', 'signup', 'error', 'view')) join w on ts >= start group by 1"""


def attention_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: stale ones, and blocked ones with the last reason that a returned line gives."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "in-progress").when(F.col("o_orderstatus") == "O", "blocked").otherwise("done")
    todos = orders.select(F.col("o_orderkey").alias("id"), status.alias("status"), _utc("o_orderdate").alias("updated_at"))
    stated = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey", "l_shipdate").agg(F.min("l_partkey").alias("p"))
    events = stated.select(F.col("l_orderkey").alias("todo_id"), F.lit("blocked").alias("status"), F.concat(F.lit("part "), F.col("p").cast("string")).alias("summary"), F.col("l_shipdate").alias("at"))
    return progress.attention(todos, events, _last(spark, sf_dir, "orders", "o_orderdate"))


SQL_ATTENTION = """with s as (select l_orderkey k, l_shipdate d, min(l_partkey) p from lineitem where l_returnflag = 'R' group by all), b as (select k, 'part ' || arg_max(p, d) summary from s group by k)
select o_orderkey id, case when o_orderstatus = 'P' then 'stale' else coalesce(summary, 'no blocker was recorded') end reason from orders left join b on k = o_orderkey
where o_orderstatus = 'O' or (o_orderstatus = 'P' and o_orderdate < (select max(o_orderdate) from orders) - interval 7 days)"""


def progress_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of urgent customers' orders that are done, of those of customers with debts; none is measured where nothing links."""
    done = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("total"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("links"))
    rows = table(spark, sf_dir, "customer").join(done, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("done", "total", "links")])
    return rows.select("c_custkey", progress.metric(F.col("done"), F.col("total"), F.col("links")).alias("m")).select("c_custkey", "m.*")


SQL_METRICS = """with d as (select c_custkey, count(o_orderkey) t, count(*) filter (where o_orderstatus = 'F') f, count(*) filter (where o_orderpriority = '1-URGENT') l from customer left join orders on o_custkey = c_custkey group by 1)
select c_custkey, case when t = 0 then 'no-data' when l = 0 then 'no-links' else 'measured' end basis, case when t > 0 and l > 0 then floor(f / t * 100 + 0.5)::int end percent from d"""


def todo_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as progress events on orders as tasks: first lines name the id, second ones the key, third ones the title."""
    todos = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("source_key"), F.concat(F.lit("Ship order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderdate").alias("created_at"))
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    events = lines.select((o * 10 + n).alias("id"), F.when(n == 1, o).alias("todo_id"), F.when(n == 2, F.concat(F.lit("k"), o.cast("string"))).otherwise("none").alias("source_key"), F.when(n == 3, F.concat(F.lit("- [x]  ship  ORDER "), o.cast("string"), F.lit("!"))).otherwise("else").alias("title"))
    return progress.todo_matches(events, todos)


SQL_MATCHES = "select distinct (l_orderkey * 10 + l_linenumber)::bigint event, l_orderkey todo from lineitem where l_linenumber <= 3 and l_orderkey in (select o_orderkey from orders)"


def _work(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    commits = orders.where("o_orderkey % 5 <> 0").select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("sha"))
    receipts = lines.where("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("sha")).agg(F.count_if(F.col("l_linestatus") == "F").alias("verified"), F.count_if(F.col("l_linestatus") == "O").alias("inferred"))
    prompts = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.floor("value").alias("rubric_mean"), F.get_json_object("props", "$.k").cast("int").alias("k")).select("user", "rubric_mean", (F.col("k") % 4).alias("verifiability"))
    proven = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("sha"), F.concat(F.lit("REQ-"), F.col("o_orderkey").cast("string")).alias("id"))
    resolved = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("sha"))
    return commits, receipts, prompts, proven, resolved


def team_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven metrics of customers as team members, the fifth not adopted."""
    commits, receipts, prompts, proven, resolved = _work(spark, sf_dir)
    return progress.team_scores(commits, receipts, prompts, proven.select("sha"), resolved, [m for m in progress.METRICS if m != "V5"])


_SQL_WORK = """with c as (select o_custkey u, o_orderkey s, o_orderstatus st from orders where o_orderkey % 5 <> 0),
r as (select l_orderkey s, count(*) filter (where l_linestatus = 'F') v, count(*) filter (where l_linestatus = 'O') i from lineitem where l_linenumber <= 2 group by 1),
x as (select l_orderkey s, count(*) n from lineitem where l_returnflag = 'R' group by 1)"""
SQL_TEAM = _SQL_WORK + """, a as (select u, count(*) n, sum(v) v, sum(i) i, count(r.s) w, count(*) filter (where v > 0) g, count(*) filter (where st = 'F') p, coalesce(sum(x.n), 0) x from c left join r using (s) left join x using (s) group by 1),
q as (select user_id u, avg(floor(value)) m, avg(case when json_extract_string(props, '$.k')::int % 4 >= 2 then 1.0 else 0.0 end) h from events group by 1),
f as (select coalesce(a.u, q.u) "user", floor(coalesce(v, 0)::double / nullif(coalesce(v, 0) + coalesce(i, 0), 0) * 1000 + 0.5) / 1000 "V1", floor(x::double / n * 1000 + 0.5) / 1000 "V2", coalesce(p, 0)::double "V3", floor(m::double * 1000 + 0.5) / 1000 "V4", null::double "V5", floor(g::double / n * 1000 + 0.5) / 1000 "V6", floor(h::double * 1000 + 0.5) / 1000 "V7" from a full join q on a.u = q.u)
select *, floor((select avg("V1") from f) * 1000 + 0.5) / 1000 "team_V1", floor((select avg("V2") from f) * 1000 + 0.5) / 1000 "team_V2", floor((select avg("V3") from f) * 1000 + 0.5) / 1000 "team_V3", floor((select avg("V4") from f) * 1000 + 0.5) / 1000 "team_V4", null::double "team_V5", floor((select avg("V6") from f) * 1000 + 0.5) / 1000 "team_V6", floor((select avg("V7") from f) * 1000 + 0.5) / 1000 "team_V7" from f"""


def contribution_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every customer's orders add up to."""
    commits, receipts, _, proven, resolved = _work(spark, sf_dir)
    return progress.contributions(commits, receipts, proven, resolved).withColumn("proven_ids", F.array_join("proven_ids", ","))


SQL_CONTRIBUTIONS = _SQL_WORK + """select u "user", count(*) commits, coalesce(string_agg('REQ-' || s, ',' order by 'REQ-' || s) filter (where st = 'F'), '') proven_ids, coalesce(sum(x.n), 0)::bigint resolved, coalesce(sum(v), 0)::bigint verified from c left join r using (s) left join x using (s) group by 1"""


def pilot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over all orders, lines and events as a pilot's evidence."""
    orders, lines, events = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "events")
    packs = lines.select(F.col("l_quantity").cast("long").alias("selected"), (F.col("l_quantity") * 3 + 1).cast("long").alias("baseline"))
    receipts = orders.select(F.col("o_orderkey").alias("receipt"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 7).alias("opened"), (F.col("o_orderkey") % 5).alias("resolved"), (F.col("o_orderkey") % 11).alias("open_total"))
    shipped = lines.groupBy(F.col("l_orderkey").alias("run")).agg(F.max("l_shipdate").alias("completed_at"))
    runs = orders.select(F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("started_at")).join(shipped, "run")
    usage = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "view").alias("measured_calls"), F.count_if(F.col("event_type") == "signup").alias("reports"))
    return progress.pilot(packs, receipts, runs, usage)


SQL_PILOT = """with p as (select count(*) packs, sum(l_quantity::bigint)::bigint selected, sum((l_quantity * 3 + 1)::bigint)::bigint baseline from lineitem),
r as (select count(*) receipts, sum(o_orderkey % 7)::bigint opened, sum(o_orderkey % 5)::bigint resolved, arg_max(o_orderkey % 11, (o_orderdate, o_orderkey)) latest_open, arg_min(o_orderkey % 11, (o_orderdate, o_orderkey)) first_open from orders),
s as (select o_orderkey k, o_orderdate d, epoch(max(l_shipdate) - any_value(o_orderdate)) * 1000.0::double ms from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_orderdate), u as (select count(*) runs, floor(avg(ms) + 0.5)::double average_ms, arg_min(ms, (d, k)) first_ms, arg_max(ms, (d, k)) latest_ms from s),
e as (select count(*) calls, count(*) filter (where event_type = 'view') measured_calls, count(distinct ts::date) served_days, count(*) filter (where event_type = 'signup') reports from events)
select packs, selected, baseline, floor((baseline - selected) / baseline * 100 * 10 + 0.5) / 10 reduction_percent, receipts, opened, resolved, latest_open, case when receipts >= 2 then latest_open - first_open end net_open_change, runs, average_ms, latest_ms,
case when runs >= 2 and first_ms > 0 then floor((latest_ms - first_ms) / first_ms * 100 * 10 + 0.5) / 10 end duration_change_percent, calls, measured_calls, served_days, reports,
case when packs >= 2 then 'ready' else 'insufficient-evidence' end context_state, case when measured_calls >= 20 then 'ready' else 'insufficient-evidence' end served_state, case when reports >= 5 then 'ready' else 'insufficient-evidence' end reported_state, case when receipts < 2 then 'insufficient-evidence' else 'ready' end state from p, r, u, e"""


def matched_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs with the line that is their receipt: a line of the order itself, else a loose one of the same customer."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    both = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    receipts = both.select(F.col("l_orderkey").alias("receipt"), F.when(F.col("p") % 2 == 0, F.col("l_orderkey")).alias("run"), F.col("o_custkey").alias("commit"), F.col("p").alias("created_at"))
    return progress.matched_receipts(orders.select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("commit")), receipts)


SQL_RECEIPTS = """with l as (select l_orderkey k, min(l_partkey) p from lineitem where l_linenumber = 1 group by 1), r as (select k, p, o_custkey c from l join orders on o_orderkey = k), b as (select c, arg_max(k, (p, k)) other from r where p % 2 = 1 group by 1)
select o_orderkey run, o_custkey "commit", coalesce(case when r.p % 2 = 0 then r.k end, other) receipt from orders left join r on r.k = o_orderkey left join b on b.c = o_custkey"""


def map_hud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requirements: how many are supplied and how many tested, in numbers and percent."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    needs = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 5, "active").otherwise("superseded").alias("status"))
    made = lines.where("l_quantity > 45").select((-F.col("l_suppkey") - 1).alias("source"), F.col("l_partkey").alias("target"), F.lit("implements").alias("relation"))
    held = lines.where("l_returnflag = 'R' and l_discount >= 0.1").select((-F.col("l_orderkey") - 1).alias("source"), F.col("l_partkey").alias("target"), F.lit("tests").alias("relation"))
    return progress.requirement_shares(needs, made.unionByName(held))


SQL_HUD = """with n as (select p_partkey k from part where p_size > 5), r as (select count(*) requirements, count(*) filter (where k in (select l_partkey from lineitem where l_quantity > 45)) implemented, count(*) filter (where k in (select l_partkey from lineitem where l_returnflag = 'R' and l_discount >= 0.1)) tested from n)
select *, floor(implemented / requirements * 100 + 0.5)::int implementation_percent, floor(tested / requirements * 100 + 0.5)::int tests_percent from r"""


def node_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents graded by their labels: toxic ones are broken, good ones verified."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    findings = labels.where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("open").alias("status"))
    evidence = labels.where("quality = 1").select(F.col("doc_id").alias("id"), F.lit("supports").alias("verdict"))
    return progress.node_grades(docs.select(F.col("doc_id").alias("id")), findings, evidence)


SQL_GRADES = "select doc_id id, case when doc_id in (select doc_id from labels where toxic = 1) then 'broken' when doc_id in (select doc_id from labels where quality = 1) then 'verified' else 'inferred' end grade from documents"


def instruction_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as instruction files: tokens that each agent loads always, below a directory, by glob or on demand."""
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("doc_id") % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(at(("AGENTS.md", "a/AGENTS.md", "x/SKILL.md", ".cursor/rules/r.mdc", "b/CLAUDE.md")).alias("path"), at(("agents", "agents", "skill", "cursor_rule", "claude")).alias("class"), tokens_utf16(F.col("text")).alias("tokens"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("*.ts"))).alias("globs"), (F.col("doc_id") % 3 == 0).alias("always"))
    return progress.instruction_costs(rows)


SQL_INSTRUCTIONS = """with d as (select doc_id % 5 m, doc_id, ceil(coalesce(length(text), 0) / 4)::bigint t from documents),
l as (select t, unnest(case m when 0 then ['codex always', 'cursor always'] when 1 then ['codex nested', 'cursor nested'] when 2 then ['claude on-demand'] when 4 then ['claude nested'] else ['cursor ' || case when doc_id % 3 = 0 then 'always' when doc_id % 2 = 0 then 'scoped' else 'on-demand' end] end) x from d)
select split_part(x, ' ', 1) loader, split_part(x, ' ', 2) as mode, count(*) files, sum(t)::bigint tokens from l group by 1, 2"""


def dominant_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of most of each order's lines."""
    return progress.dominant(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber")


SQL_DOMINANT = "select l_orderkey, l_suppkey, n from (select l_orderkey, l_suppkey, count(*) n, min(l_linenumber) f from lineitem group by all) qualify row_number() over (partition by l_orderkey order by n desc, f, l_suppkey desc) = 1"


def zero_filled_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by a fixed list of types, one of which none has."""
    return progress.zero_filled(table(spark, sf_dir, "events"), "event_type", ["click", "view", "refund"])


SQL_ZERO = "select key, (select count(*) from events where event_type = key) n from (values ('click'), ('view'), ('refund')) t(key)"


def edges_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of each ship flag by id, as many as the flag's limit."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").distinct()
    edges = rows.select(F.col("l_returnflag").alias("family"), F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 9, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey")]).alias("id"))
    return progress.per_family(edges, spark.createDataFrame([("A", 50), ("R", 200), ("X", 5)], "family string, most int"))


SQL_FAMILIES = """with r as (select distinct l_returnflag family, concat_ws('-', lpad(l_orderkey::varchar, 9, '0'), lpad(l_linenumber::varchar, 9, '0'), lpad(l_partkey::varchar, 9, '0')) id from lineitem)
select family, id from r qualify row_number() over (partition by family order by id) <= case family when 'A' then 50 when 'R' then 200 else 0 end"""


def pulse_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a node within 100 milliseconds as one."""
    events = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("node"), "ts")
    return progress.coalesced(events).withColumn("window", F.col("window").cast("timestamp_ntz"))


SQL_PULSE = "select json_extract_string(props, '$.k') node, make_timestamp((epoch_us(ts) // 100000 * 100000)::bigint) as \"window\", count(*) n, max(ts) last_at from events group by 1, 2"


def upsert_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stored before against those derived now: a third is new, some differ, some are gone."""
    c = table(spark, sf_dir, "customer")
    before = c.where("c_custkey % 3 <> 0").select("c_custkey", "c_mktsegment", "c_nationkey")
    now = c.where("c_custkey % 5 <> 0").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, -1).otherwise(F.col("c_nationkey")).alias("c_nationkey"))
    return sinks.upsert(before, now, ["c_custkey"], ["c_mktsegment", "c_nationkey"], keep_absent=False)


SQL_UPSERT = """select c_custkey, c_mktsegment, case when c_custkey % 5 <> 0 and c_custkey % 7 = 0 then -1 else c_nationkey end c_nationkey,
case when c_custkey % 5 = 0 then 'removed' when c_custkey % 3 = 0 then 'inserted' when c_custkey % 7 = 0 then 'updated' else 'unchanged' end outcome from customer where c_custkey % 3 <> 0 or c_custkey % 5 <> 0"""


def conditional_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries proposed for parts by their lines: applied only where the part still has the digest they were made from."""
    part = table(spark, sf_dir, "part").where("p_partkey % 10 <> 9").select("p_partkey", F.col("p_size").cast("long").alias("digest"), F.col("p_name").alias("summary"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_orderkey").agg(F.min("l_quantity").cast("long").alias("digest"))
    proposed = lines.select(F.col("l_partkey").alias("p_partkey"), "digest", F.when(F.col("l_orderkey") % 13 == 0, " ").otherwise(F.concat(F.lit("from "), F.col("l_orderkey").cast("string"))).alias("summary"), F.col("l_orderkey").alias("seq"))
    return sinks.conditional(part, proposed, "p_partkey", "digest", "summary")


SQL_CONDITIONAL = """with l as (select l_partkey k, l_orderkey o, min(l_quantity)::bigint q from lineitem group by all), p as (select k, max(o) o, arg_max(q, o) q from l group by k)
select k p_partkey, case when o % 13 <> 0 and p_size = q then 'from ' || o else p_name end summary, case when o % 13 = 0 then 'invalid' when p_partkey is null then 'missing' when p_size = q then 'applied' else 'superseded' end outcome from p left join part on p_partkey = k and p_partkey % 10 <> 9"""


def findings_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What new findings (toxic labels and every seventh document) do to known ones (labels of low quality)."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    status = F.when(F.col("doc_id") % 3 == 0, "open").when(F.col("doc_id") % 3 == 1, "resolved").otherwise("dismissed")
    before = labels.where("quality = 0").select(F.col("doc_id").alias("id"), status.alias("status"))
    now = labels.where("toxic = 1").select(F.col("doc_id").alias("id")).unionByName(docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("id")))
    return sinks.findings_delta(before, now)


SQL_DELTA = """with b as (select doc_id id, case doc_id % 3 when 0 then 'open' when 1 then 'resolved' else 'dismissed' end s from labels where quality = 0), n as (select doc_id id from labels where toxic = 1 union select doc_id from documents where doc_id % 7 = 0)
select coalesce(b.id, n.id) id, case when s = 'dismissed' then s when n.id is not null then 'open' else 'resolved' end status, case when s = 'dismissed' then 'none' when n.id is not null and coalesce(s, 'resolved') <> 'open' then 'opened' when n.id is null and s = 'open' then 'resolved' else 'none' end change from b full join n on b.id = n.id"""


def findings_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of that delta."""
    return sinks.delta_counts(findings_delta(spark, sf_dir))


SQL_DELTA_COUNTS = f"select count(*) filter (where change = 'opened') opened, count(*) filter (where change = 'resolved') resolved, count(*) filter (where status = 'open') open_total from ({SQL_DELTA})"


def concept_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one name as one concept: members united, the longest type as summary."""
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("slug"), F.col("p_partkey").alias("batch"), F.col("p_brand").alias("name"), F.col("p_type").alias("summary"), F.array("p_brand").alias("members"), F.array("p_type").alias("links"))
    return sinks.merged_concepts(rows).select("slug", "name", "summary", F.array_join("members", ",").alias("members"), F.array_join("links", ",").alias("links"))


SQL_CONCEPTS = "select p_name slug, arg_min(p_brand, p_partkey) as name, arg_max(p_type, (length(p_type), -p_partkey)) summary, string_agg(distinct p_brand, ',' order by p_brand) members, string_agg(distinct p_type, ',' order by p_type) links from part group by 1"


def superseded_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assertions of a user's type with a rounded value: superseded by the next with another."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.col("event_type").alias("relation"), F.floor(F.col("value") / 20).alias("object"), F.col("ts").alias("at"))
    return sinks.superseded_assertions(rows)


SQL_SUPERSEDED = "select event_id id, case when lead(floor(value / 20)) over w <> floor(value / 20) then lead(event_id) over w end superseded_by from events window w as (partition by user_id, event_type order by ts, event_id)"


def retention_by_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are older than their user's days of retention, of which every third user has own ones."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("tenant"), _utc("ts").alias("at"))
    tenants = events.select("tenant").distinct().where("tenant % 3 = 0").select("tenant", (F.col("tenant") % 20 + 1).cast("int").alias("days"))
    return sinks.due_entries(events, tenants, _last(spark, sf_dir, "events", "ts"), 10).select("event_id", "tenant")


SQL_DUE = "select event_id, user_id tenant from events where ts < (select max(ts) from events) - to_days(case when user_id % 3 = 0 then (user_id % 20 + 1)::int else 10 end)"


def grading_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: suppliers of discounted lines expected, those of taxed lines found."""
    lines = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("Supplier_"), F.col("l_suppkey").cast("string"))
    expected = lines.where("l_discount > 0.03").select(F.col("l_orderkey").alias("task"), name.alias("finding"))
    actual = lines.where("l_tax > 0.03").select(F.col("l_orderkey").alias("task"), F.regexp_replace(F.upper(name), "_", ":  ").alias("finding"))
    return trials.f1_grades(expected, actual)


SQL_F1 = """with e as (select distinct l_orderkey t, l_suppkey s from lineitem where l_discount > 0.03), a as (select distinct l_orderkey t, l_suppkey s from lineitem where l_tax > 0.03),
j as (select coalesce(e.t, a.t) task, count(*) filter (where e.s is not null and a.s is not null) matched, count(e.s) expected, count(*) filter (where e.s is null) unexpected from e full join a on e.t = a.t and e.s = a.s group by 1)
select task, matched, expected, unexpected, case when matched = 0 then 0.0::double else 2.0::double * matched / (expected + matched + unexpected) end score, matched = expected and unexpected = 0 passed from j where expected > 0"""


def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts ranked by size: how many of the first ones were ever returned at 10 % off."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_discount >= 0.1").select(F.col("l_partkey").alias("path"))
    ranked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_size")
    return trials.precision_at(ranked, lines, [F.desc("p_size"), F.col("path")], [10, 30, 100])


SQL_PRECISION = """with r as (select p_partkey p, row_number() over (order by p_size desc, p_partkey) k from part), h as (select distinct l_partkey p from lineitem where l_returnflag = 'R' and l_discount >= 0.1)
select c.k::int k, count(h.p) hits, count(h.p)::double / count(*) as precision from (values (10), (30), (100)) c(k) join r on r.k <= c.k left join h on h.p = r.p group by 1"""


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select((F.col("event_id") % 50).alias("task"), F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("model"), F.when(F.col("event_id") % 3 == 0, "checkout").when(F.col("event_id") % 3 == 1, "graph").otherwise("routed").alias("arm"), F.floor(F.col("event_id") / 150).alias("trial"), F.when(F.col("event_type") != "error", F.floor("value").cast("double")).alias("score"), (F.col("value") > 10).alias("passed"), (F.col("event_type") == "error").alias("failed"), (k + 1).cast("long").alias("tokens"), (k % 7).cast("long").alias("calls"))


_SQL_TRIALS = """t as (select event_id % 50 task, 'm' || (user_id % 2) model, case event_id % 3 when 0 then 'checkout' when 1 then 'graph' else 'routed' end arm, event_id // 150 trial, case when event_type <> 'error' then floor(value)::double end score, value > 10 passed, event_type = 'error' failed, (json_extract_string(props, '$.k')::bigint + 1) tokens, json_extract_string(props, '$.k')::bigint % 7 calls from events)"""


def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trials: each arm by model and over all."""
    return trials.arms(_trials(spark, sf_dir))


SQL_ARMS = f"with {_SQL_TRIALS} select model, arm, count(*) trials, count(*) filter (where failed) failed, count(*) filter (where passed) passed, floor(avg(coalesce(score, 0)) * 1000000 + 0.5) / 1000000 mean_score, floor(avg(passed::int) * 1000000 + 0.5) / 1000000 pass_rate, sum(tokens)::bigint tokens, sum(calls)::bigint calls from t group by grouping sets ((model, arm), (arm))"


def paired_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials that two arms have in common, by task and model."""
    one = _trials(spark, sf_dir).groupBy("task", "model", "arm").agg(F.sum("score").alias("score"), F.sum("tokens").alias("tokens")).withColumn("trial", F.lit(1))
    return trials.paired(one, "checkout", "graph")


SQL_PAIRED = f"""with {_SQL_TRIALS}, o as (select task, model, arm, sum(score) score, sum(tokens)::bigint tokens from t group by all)
select a.task, a.model, 1 trial, coalesce(a.score, 0) baseline_score, coalesce(b.score, 0) treatment_score, a.tokens baseline_tokens, b.tokens treatment_tokens from o a join o b on a.task = b.task and a.model = b.model and a.arm = 'checkout' and b.arm = 'graph'"""


def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the mean score of each arm, over tasks."""
    one = _trials(spark, sf_dir).groupBy("task", "arm").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    return trials.bootstrap(one, "arm", "score", ["task"])


def ops_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks on the orders' state, and the worst of them."""
    o = table(spark, sf_dir, "orders")
    snapshot = o.agg(F.count_if(F.col("o_orderstatus") == "P").alias("waiting"), F.max("o_totalprice").alias("largest"), (F.count_if(F.col("o_orderpriority").isNull()) / F.count("*")).alias("unknown_share"), F.max(F.when(F.col("o_orderkey") < 0, 1)).alias("negative"))
    return trials.levels(snapshot, {"waiting": (10, 1_000_000), "largest": (100, 1000), "unknown_share": (0.1, 0.5), "negative": (1, 2)})


SQL_LEVELS = """with s as (select count(*) filter (where o_orderstatus = 'P')::double waiting, max(o_totalprice) largest, 0.0::double unknown_share from orders),
r as (select 'waiting' "check", waiting "value", case when waiting >= 1000000 then 'critical' when waiting >= 10 then 'warning' else 'ok' end "level" from s union all select 'largest', largest, case when largest >= 1000 then 'critical' when largest >= 100 then 'warning' else 'ok' end from s union all select 'unknown_share', unknown_share, 'ok' from s union all select 'negative', null, 'unknown')
select * from r union all select 'overall', null, arg_max("level", case "level" when 'critical' then 3 when 'warning' then 2 when 'unknown' then 1 else 0 end) from r"""


def ci_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on parts' tests from reports that suppliers wrote: a returned line is a failure, one taxed 8 % is skipped, every tenth report is of another commit."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_returnflag", "l_tax", "l_linenumber", "l_quantity")
    case = F.concat(F.lit('<testcase classname="x" file="tests/p'), F.col("l_partkey").cast("string"), F.lit('.test.ts" name="REQ-O'), F.col("l_orderkey").cast("string"), F.lit(" &amp; more\">"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48), "<failure/>").when(F.col("l_tax") >= 0.08, "<skipped/>").otherwise(""), F.lit("</testcase>"))
    reports = lines.groupBy(F.col("l_suppkey").alias("report")).agg(F.array_join(F.array_sort(F.collect_list(case)), "\n").alias("c"))
    reports = reports.select("report", F.lit("junit").alias("format"), F.when(F.col("report") % 10 == 0, "other").otherwise("head").alias("head_sha"), F.concat(F.lit("<testsuite>\n"), "c", F.lit("\n</testsuite>")).alias("content"))
    checks = spark.createDataFrame([("head", "completed", "success")], "head_sha string, status string, conclusion string")
    found = readers.test_evidence(reports, readers.test_cases(reports), checks, "head")
    return found.select("test_file", "grade", "verdict", (F.col("reason") != "").alias("has_reason"), F.size("requirement_ids").alias("n_requirements"), "sources")


SQL_EVIDENCE = """with c as (select l_suppkey s, l_partkey p, l_orderkey o, case when l_returnflag = 'R' and l_quantity > 48 then 'failed' when l_tax >= 0.08 then 'skipped' else 'passed' end st from lineitem), r as (select s, s % 10 <> 0 and count(*) filter (where st = 'failed') = 0 ok from c group by s)
select 'tests/p' || p || '.test.ts' test_file, case when bool_and(st = 'passed' and ok) then 'verified' else 'inferred' end grade, case when bool_and(st = 'passed' and ok) then 'supports' else 'unknown' end verdict, true has_reason, count(distinct o)::int n_requirements, count(*) sources from c join r using (s) group by p"""


def coverage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that suppliers' coverage reports name, each with its first report."""
    lines = table(spark, sf_dir, "lineitem").where("l_tax < 0.02").select("l_suppkey", "l_partkey").distinct()
    body = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("SF:src/p"), F.col("l_partkey").cast("string"), F.lit(".ts\nDA:1,1\nend_of_record")))), "\n")
    reports = lines.groupBy(F.col("l_suppkey").alias("report")).agg(body.alias("content")).withColumn("format", F.lit("lcov"))
    return readers.covered_paths(reports)[0]


SQL_COVERED = "select 'src/p' || l_partkey || '.ts' path, min(l_suppkey) report, 'lcov' format from lineitem where l_tax < 0.02 group by 1"


def tree_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tree entries against those stored before: what is new, changed, the same, gone or skipped."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    tree = part.where("p_partkey % 6 <> 0").select(k.cast("string").alias("path"), F.when(k % 11 == 0, "160000").when(k % 11 == 1, "120000").otherwise("100644").alias("mode"), F.md5(F.when(k % 5 == 0, "new").otherwise(F.col("p_name"))).alias("sha"), (F.col("p_size") * 30_000).alias("size"), (k % 17 == 0).alias("binary"))
    before = part.where("p_partkey % 4 <> 0").select(k.cast("string").alias("path"), F.md5("p_name").alias("sha"))
    return readers.tree_entries(tree, before)


SQL_TREE = """select p_partkey::varchar path, case when p_partkey % 6 = 0 then 'removed' when p_partkey % 11 = 0 then 'skipped:submodule' when p_partkey % 11 = 1 then 'skipped:symlink' when p_size * 30000 > 1048576 then 'skipped:oversized' when p_partkey % 17 = 0 then 'skipped:binary'
when p_partkey % 4 = 0 then 'added' when p_partkey % 5 = 0 then 'changed' else 'unchanged' end state from part where p_partkey % 6 <> 0 or p_partkey % 4 <> 0"""

QUERIES = {
    f.__name__: f
    for f in (
        timeline_digest, attention_items, progress_metrics, todo_matches, team_scores, contribution_rows, pilot_summary, matched_receipts, map_hud, node_grades, instruction_costs, dominant_supplier, zero_filled_types, edges_per_family, pulse_windows,
        upsert_parties, conditional_summaries, findings_delta, findings_counts, concept_merge, superseded_assertions, retention_by_tenant, grading_f1, precision_at_k, arm_summary, paired_units, bootstrap_intervals, ops_levels, ci_evidence, coverage_paths, tree_states,
    )
}
ORACLES = {
    "timeline_digest": SQL_DIGEST, "attention_items": SQL_ATTENTION, "progress_metrics": SQL_METRICS, "todo_matches": SQL_MATCHES, "team_scores": SQL_TEAM, "contribution_rows": SQL_CONTRIBUTIONS, "pilot_summary": SQL_PILOT, "matched_receipts": SQL_RECEIPTS,
    "map_hud": SQL_HUD, "node_grades": SQL_GRADES, "instruction_costs": SQL_INSTRUCTIONS, "dominant_supplier": SQL_DOMINANT, "zero_filled_types": SQL_ZERO, "edges_per_family": SQL_FAMILIES, "pulse_windows": SQL_PULSE, "upsert_parties": SQL_UPSERT,
    "conditional_summaries": SQL_CONDITIONAL, "findings_delta": SQL_DELTA, "findings_counts": SQL_DELTA_COUNTS, "concept_merge": SQL_CONCEPTS, "superseded_assertions": SQL_SUPERSEDED, "retention_by_tenant": SQL_DUE, "grading_f1": SQL_F1, "precision_at_k": SQL_PRECISION,
    "arm_summary": SQL_ARMS, "paired_units": SQL_PAIRED, "ops_levels": SQL_LEVELS, "ci_evidence": SQL_EVIDENCE, "coverage_paths": SQL_COVERED, "tree_states": SQL_TREE,
}
