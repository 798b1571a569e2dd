"""Report queries over the star tables and events, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.functions.columns import ratio, rounded
from tessellar.operators import reports
from tessellar.plans.graphs import SQL_PAIRS, _touches
from tessellar.sources.tables import shared_dir, table, written
from tessellar.streaming import activity, co_change

MONEY = "decimal(18,2)"


def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and events by day and user, two fact tables in one."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("user_id"), F.lit(1).alias("o"), F.col("o_totalprice").cast(MONEY).alias("ov"), F.lit(0).alias("e"), F.lit(0).cast(MONEY).alias("ev"))
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id", F.lit(0).alias("o"), F.lit(0).cast(MONEY).alias("ov"), F.lit(1).alias("e"), F.col("value").cast(MONEY).alias("ev"))
    sums = orders.unionByName(events).groupBy("day", "user_id").agg(F.sum("o").alias("orders"), F.sum("ov").cast(MONEY).alias("order_value"), F.sum("e").alias("events"), F.sum("ev").cast(MONEY).alias("event_value"))
    return sums


SQL_USAGE = """select day, user_id, sum(o)::bigint orders, sum(ov)::decimal(18,2) order_value, sum(e)::bigint events, sum(ev)::decimal(18,2) event_value from (
select o_orderdate::date as day, o_custkey user_id, 1 o, o_totalprice::decimal(18,2) ov, 0 e, 0::decimal(18,2) ev from orders union all select ts::date, user_id, 0, 0, 1, value::decimal(18,2) from events) group by all"""


def co_change_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.co_change_pairs(_touches(spark, sf_dir))


SQL_CO_CHANGE = f'with {SQL_PAIRS} select a, b, times, last as "last" from pairs'


def co_change_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs from counters that take the orders in four batches, one of them twice, and orders of one batch again in the next."""
    path = f"{shared_dir(spark)}/tables/counters-{uuid.uuid4().hex}"
    touches = _touches(spark, sf_dir)
    part = F.pmod(F.xxhash64("commit"), F.lit(8))
    for batch, parts in enumerate(((0, 1), (2, 3, 0), (2, 3, 0), (4, 5), (6, 7, 4))):
        co_change.merge_commits(touches.where(part.isin(*parts)), min(batch, 1) if batch < 3 else batch - 1, path, buckets=8)
    return co_change.counters(spark, path, *(touches.schema[c].dataType.simpleString() for c in ("item", "at")))


def _co_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate")).first()[0]
    return reports.decayed(reports.co_change_pairs(_touches(spark, sf_dir)), F.lit(as_of))


def co_change_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the weight of what was ordered with them, halved every 90 days before the last day there is."""
    return _co_change(spark, sf_dir)


SQL_WEIGHTS = """weights as (select item, round(sum(w::decimal(20,12))::decimal(28,12), 3)::decimal(18,3) weight from (
select unnest([a, b]) item, least(1.0::double, times / 10) * pow(0.5::double, date_diff('day', last::date, (select max(l_shipdate)::date from lineitem)) / 90) w from pairs) group by item)"""
SQL_DECAY = f"with {SQL_PAIRS}, {SQL_WEIGHTS} select item, weight from weights"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings are lines returned at 10 % off, tests are open lines, fan-in is suppliers, advisories are lines of economy parts taxed 8 %."""
    items, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    flagged = items.select("l_partkey", "l_suppkey", ((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.1)).cast("int").alias("f"), (F.col("l_linestatus") == "O").alias("t"), (F.col("l_tax") >= 0.08).cast("int").alias("a"))
    by_supplier = flagged.repartition("l_partkey").groupBy("l_partkey", "l_suppkey").agg(F.sum("f").alias("f"), F.max("t").alias("t"), F.sum("a").alias("a"))
    by_part = by_supplier.groupBy("l_partkey").agg(F.sum("f").alias("findings"), F.max("t").alias("tested"), F.count("*").alias("fan_in"), F.sum("a").alias("a"))
    economy = part.select("p_partkey", (F.col("p_type") == "ECONOMY").alias("economy"))
    audited = by_part.join(economy, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("l_partkey").alias("item"), "findings", "tested", "fan_in", F.when(F.col("economy"), F.col("a")).alias("advisories"))
    return audited.join(_co_change(spark, sf_dir), "item", "full_outer")


def risk_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by risk, their importance the number of suppliers; parts without a factor are left out."""
    signals = written(_signals(spark, sf_dir).withColumn("importance", F.col("fan_in").cast("double")))
    top = signals.agg(F.max("fan_in")).first()[0]
    return reports.risk(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item")), signals, top)


SQL_RISK = f"""with {SQL_PAIRS}, {SQL_WEIGHTS},
flags as (select l_partkey item, count(*) filter (where l_returnflag = 'R' and l_discount >= 0.1) f, bool_or(l_linestatus = 'O') t, count(*) filter (where l_tax >= 0.08) a, count(distinct l_suppkey) i from lineitem group by 1),
r as (select p_partkey item, coalesce(f, 0) findings, case when t then 0 else 1 end::bigint untested, round((2 * coalesce(i, 0) / (select max(i) from flags))::decimal(28,12), 3)::decimal(18,3) fan_in,
  least(1, coalesce(weight, 0))::decimal(18,3) co_change, round((1.5::double * least(1, case when p_type = 'ECONOMY' then coalesce(a, 0) else 0 end / 5))::decimal(28,12), 3)::decimal(18,3) audit
  from part left join flags on flags.item = p_partkey left join weights on weights.item = p_partkey
  where coalesce(f, 0) > 0 or not coalesce(t, false) or coalesce(i, 0) > 0 or coalesce(weight, 0) > 0),
s as (select *, (findings + untested + fan_in + co_change + audit)::decimal(18,3) score from r)
select *, case when score >= 4 then 'high' when score >= 2.5 then 'elevated' when score >= 1 then 'moderate' else 'low' end as level from s"""


def risk_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three riskiest parts."""
    return reports.risk_top(risk_entries(spark, sf_dir)).select("item", "score", "level")


SQL_RISK_TOP = f"select item, score, level from ({SQL_RISK}) order by score desc, item limit 3"


def risk_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factors of every part's risk."""
    return reports.risk_factors(risk_entries(spark, sf_dir))


SQL_FACTORS = f"""with q as ({SQL_RISK}) select item, kind, weight::decimal(18,3) weight from (select item, 'open-finding' kind, findings weight from q union all select item, 'untested', untested from q union all select item, 'fan-in', fan_in from q union all select item, 'co-changed', co_change from q union all select item, 'dependency-audit', audit from q) where weight > 0"""


def edge_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each supplier's lines: at most 100 rows and 2,000 bytes."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    rows = rows.groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    size = F.octet_length(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey"))
    both = reports.page(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber"], size, 100, 2000)
    return both.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("row").cast("long").alias("row"), F.col("bytes_so_far").cast("long").alias("bytes_so_far"))


SQL_PAGE = """with r as (select l_suppkey, l_orderkey, l_linenumber, min(l_partkey) p from lineitem group by all),
s as (select *, row_number() over w as row, sum(octet_length(encode(concat_ws('|', l_orderkey, l_linenumber, p)))) over w bytes_so_far from r window w as (partition by l_suppkey order by l_orderkey, l_linenumber))
select l_suppkey, l_orderkey, l_linenumber, row as "row", bytes_so_far::bigint bytes_so_far from s where row <= 100 and bytes_so_far <= 2000"""


def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents in order of id, as far as a budget of 20,000 tokens goes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.ceil(F.coalesce("n_chars", F.lit(0)) / 4).cast("long").alias("tokens"))
    return reports.running_sum(docs, ["source"], "doc_id", F.col("tokens")).where("running <= 20000").select("source", "doc_id", "tokens", F.col("running").cast("long").alias("running"))


SQL_PREFIX = """select source, doc_id, tokens, running::bigint running from (select source, doc_id, ceil(coalesce(n_chars, 0) / 4)::bigint tokens, sum(ceil(coalesce(n_chars, 0) / 4)) over (partition by source order by doc_id) running from documents) where running <= 20000"""


def distinct_on_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's last event of each type."""
    return reports.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "ts", "value"])


SQL_LATEST = "select user_id, event_type, event_id, ts, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1"


def session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, parted by six hours without an event."""
    return reports.sessions(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", "6 hours").withColumn("start_at", F.col("start_at").cast("timestamp_ntz")).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


SQL_SESSIONS = """with s as (select *, coalesce(ts - lag(ts) over w >= interval 6 hours, true) fresh from events window w as (partition by user_id order by ts)), g as (select *, sum(fresh::int) over (partition by user_id order by ts) k from s)
select user_id, min(ts) start_at, max(ts) last_at, count(*) n from g group by user_id, k"""


def glow_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by their key in windows of an hour."""
    events = activity.unique_events(table(spark, sf_dir, "events"))
    out = activity.activity(events, F.get_json_object("props", "$.k"))
    return out.withColumn("start_at", F.col("start_at").cast("timestamp_ntz")).withColumn("last_at", F.col("last_at").cast("timestamp_ntz"))


SQL_WINDOWS = "select json_extract_string(props, '$.k') node, time_bucket(interval 1 hour, ts) start_at, count(*) n, max(ts) last_at from events group by 1, 2"


def phase_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phase that a node of the events enters; the same function makes them of a stream."""
    found = activity.phase_changes(table(spark, sf_dir, "events"), F.get_json_object("props", "$.k"))
    return found.withColumn("at", F.col("at").cast("timestamp_ntz"))


SQL_PHASES = """with e as (select json_extract_string(props, '$.k') node, ts, row_number() over w n, lead(ts) over w nxt from events window w as (partition by json_extract_string(props, '$.k') order by ts, event_id)),
b as (select node, n, nxt, unnest([{'phase': 'pulse', 'at': ts}, {'phase': 'decay', 'at': ts + interval 750 milliseconds}, {'phase': 'afterglow', 'at': ts + interval 2600 milliseconds}, {'phase': 'idle', 'at': ts + interval 12 seconds}]) p from e where node is not null and ts is not null)
select node, p.phase phase, p.at "at", n from b where p.phase = 'pulse' or nxt is null or p.at < nxt"""


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes' events, last times and phases as of two seconds after the last event."""
    events = table(spark, sf_dir, "events")
    as_of = events.agg(F.max("ts")).first()[0]
    nodes = events.groupBy(F.get_json_object("props", "$.k").alias("node")).agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))
    later = F.lit(as_of).cast("timestamp") + F.expr("interval 2 seconds")
    return nodes.select("node", "n", F.col("last_at").cast("timestamp_ntz").alias("last_at"), activity.phase(F.col("last_at"), later).alias("phase"))


SQL_PULSES = """with n as (select json_extract_string(props, '$.k') node, count(*) n, max(ts) last_at from events group by 1), a as (select *, epoch((select max(ts) from events) + interval 2 seconds - last_at) age from n)
select node, n, last_at, case when age < 0 or age >= 12 then 'idle' when age < 0.75 then 'pulse' when age < 2.6 then 'decay' else 'afterglow' end phase from a"""


def feed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 latest events."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "ts", "user_id", "event_type")


SQL_FEED = "select event_id, ts, user_id, event_type from events order by ts desc, event_id limit 20"


def retention_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events kept by type: seven days, errors for twenty, before the last event."""
    events = table(spark, sf_dir, "events")
    as_of = events.agg(F.max("ts")).first()[0]
    age = (F.lit(as_of).cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 86400
    return events.where(age <= F.when(F.col("event_type") == "error", 20).otherwise(7)).select("event_id", "event_type", "user_id")


SQL_RETENTION = "select event_id, event_type, user_id from events where epoch((select max(ts) from events) - ts) / 86400 <= case when event_type = 'error' then 20 else 7 end"


def bitemporal_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a fact of its user and type, in force until the next."""
    return reports.validity(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "ts", "valid_to")


SQL_VALIDITY = "select event_id, ts, lead(ts) over (partition by user_id, event_type order by ts, event_id) valid_to from events"


def ci_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days: verified if no event is an error, else the first error."""
    bad = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("cases"), (~F.max(bad)).alias("verified"), F.min_by(F.when(bad, F.col("event_id")), F.when(bad, F.struct("ts", "event_id"))).alias("first_error"))


SQL_VERDICT = """select user_id, ts::date as day, count(*) cases, not bool_or(event_type = 'error') verified, arg_min(event_id, (ts, event_id)) filter (where event_type = 'error') first_error from events group by 1, 2"""


def team_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' shares of purchases per view and of errors, null where there is nothing to divide by, beside the mean of all users' rounded shares."""
    events = table(spark, sf_dir, "events")
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    own = events.groupBy("user_id").agg(ratio(n("purchase"), n("view")).alias("conversion"), ratio(n("error"), F.count("*")).alias("errors"))
    team = own.agg(rounded(F.avg("conversion"), 4).alias("c"), rounded(F.avg("errors"), 4).alias("e")).first()
    return own.select("user_id", "conversion", "errors", F.lit(team["c"]).cast("decimal(18,4)").alias("team_conversion"), F.lit(team["e"]).cast("decimal(18,4)").alias("team_errors"))


SQL_TEAM = """with o as (select user_id, round((count(*) filter (where event_type = 'purchase') / nullif(count(*) filter (where event_type = 'view'), 0))::decimal(28,12), 4)::decimal(18,4) conversion,
round((count(*) filter (where event_type = 'error') / count(*))::decimal(28,12), 4)::decimal(18,4) errors from events group by 1)
select user_id, conversion, errors, round((select avg(conversion) from o)::decimal(28,12), 4)::decimal(18,4) team_conversion, round((select avg(errors) from o)::decimal(28,12), 4)::decimal(18,4) team_errors from o"""


def ledger_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' balances (purchases spend, all else earns) and spending by month."""
    v, spent = F.col("value").cast(MONEY), F.col("event_type") == "purchase"
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum(F.when(spent, -v).otherwise(v)).cast(MONEY).alias("balance"), F.coalesce(F.sum(F.when(spent, v)), F.lit(0)).cast(MONEY).alias("spent"))


SQL_LEDGER = """select user_id, strftime(ts, '%Y-%m') as month, sum(case when event_type = 'purchase' then -value::decimal(18,2) else value::decimal(18,2) end)::decimal(18,2) balance,
coalesce(sum(value::decimal(18,2)) filter (where event_type = 'purchase'), 0)::decimal(18,2) spent from events group by 1, 2"""


def commit_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines: status by precedence, days to the last shipment or null if it came before the order."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("jobs"), F.max(F.col("l_returnflag") == "R").alias("failed"), F.min(F.col("l_linestatus") == "O").alias("queued"), F.min(F.col("l_linestatus") == "F").alias("done"), F.max("l_shipdate").alias("shipped"))
    status = F.when(F.col("jobs").isNull(), F.concat(F.lit("run:"), "o_orderstatus")).when(F.col("failed"), "failed").when(F.col("queued"), "pending").when(F.col("done"), "completed").otherwise("analyzing")
    days = F.datediff("shipped", "o_orderdate")
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", F.coalesce("jobs", F.lit(0)).cast("long").alias("jobs"), status.alias("status"), F.when(days >= 0, days).cast("long").alias("days"))


SQL_CARDS = """with l as (select l_orderkey k, count(*) jobs, bool_or(l_returnflag = 'R') failed, bool_and(l_linestatus = 'O') queued, bool_and(l_linestatus = 'F') done, max(l_shipdate) shipped from lineitem group by 1)
select o_orderkey, coalesce(jobs, 0) jobs, case when jobs is null then 'run:' || o_orderstatus when failed then 'failed' when queued then 'pending' when done then 'completed' else 'analyzing' end status,
case when date_diff('day', o_orderdate::date, shipped::date) >= 0 then date_diff('day', o_orderdate::date, shipped::date) end as days from orders left join l on k = o_orderkey"""


def pilot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By priority: first and last order, change of value between them, and mean value; null where one order is all there is."""
    o = table(spark, sf_dir, "orders").withColumn("v", F.col("o_totalprice").cast(MONEY))
    at = F.struct("o_orderdate", "o_orderkey")
    agg = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min_by("v", at).alias("first_value"), F.max_by("v", at).alias("last_value"), rounded(F.avg("v"), 4).alias("mean_value"))
    return agg.withColumn("trend", F.when(F.col("n") > 1, F.col("last_value") - F.col("first_value")).cast(MONEY))


SQL_PILOT = """with a as (select o_orderpriority, count(*) n, arg_min(o_totalprice::decimal(18,2), (o_orderdate, o_orderkey)) first_value, arg_max(o_totalprice::decimal(18,2), (o_orderdate, o_orderkey)) last_value,
round((sum(o_totalprice::decimal(18,2)) / count(*))::decimal(28,12), 4)::decimal(18,4) mean_value from orders group by 1) select *, case when n > 1 then last_value - first_value end::decimal(18,2) trend from a"""


def progress_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last day and of the last seven by type, zero-filled, before the last event's day."""
    events = table(spark, sf_dir, "events")
    as_of = events.agg(F.max(F.to_date("ts"))).first()[0]
    age = F.datediff(F.lit(as_of), F.to_date("ts"))
    return events.groupBy("event_type").agg(F.count_if(age == 0).alias("today"), F.count_if(age < 7).alias("week"), F.count("*").alias("all_time"))


SQL_DIGEST = """select event_type, count(*) filter (where ts::date = d) today, count(*) filter (where date_diff('day', ts::date, d) < 7) as week, count(*) all_time from events, (select max(ts::date) d from events) group by 1"""


def percentile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of event values by type, from counts of distinct values."""
    counted = table(spark, sf_dir, "events").groupBy("event_type", F.col("value").cast(MONEY).alias("v")).agg(F.count("*").alias("c"))
    ranked = reports.running_sum(counted, ["event_type"], "v", F.col("c"))
    totals = ranked.groupBy(F.col("event_type").alias("t")).agg(F.max("running").alias("n"))
    ranked = ranked.join(F.broadcast(totals), F.col("event_type").eqNullSafe(F.col("t")))  # one row for each type
    at = lambda f: F.min(F.when(F.col("running") > F.floor(F.lit(f) * (F.col("n") - 1)), F.col("v")))
    return ranked.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


SQL_PERCENTILES = """with s as (select event_type, list_sort(list(value::decimal(18,2))) v from events group by 1)
select event_type, v[floor(0.5 * (len(v) - 1))::int + 1] p50, v[floor(0.95 * (len(v) - 1))::int + 1] p95, v[floor(0.99 * (len(v) - 1))::int + 1] p99 from s"""


def order_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each order's sorted distinct members."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws(":", "l_partkey", "l_suppkey").alias("m")).distinct()
    return lines.groupBy("l_orderkey").agg(F.count("*").alias("members"), F.md5(F.array_join(F.array_sort(F.collect_list("m")), "\n").cast("binary")).alias("digest"))


SQL_ORDER_DIGESTS = """select l_orderkey, count(*) members, md5(string_agg(m, chr(10) order by m)) digest from (select distinct l_orderkey, l_partkey || ':' || l_suppkey m from lineitem) group by 1"""

QUERIES = {f.__name__: f for f in (usage_daily, co_change_pairs, co_change_streamed, co_change_decay, risk_entries, risk_top, risk_factors, edge_page, budget_prefix, distinct_on_latest, session_activity, glow_windows, pulses, phase_changes, feed_topk, retention_prune, bitemporal_validity, ci_verdict, team_metrics, ledger_balance, commit_cards, pilot_stats, progress_digest, percentile_report, order_digests)}
ORACLES = {
    "usage_daily": SQL_USAGE, "co_change_pairs": SQL_CO_CHANGE, "co_change_streamed": SQL_CO_CHANGE, "co_change_decay": SQL_DECAY, "risk_entries": SQL_RISK, "risk_top": SQL_RISK_TOP, "risk_factors": SQL_FACTORS, "edge_page": SQL_PAGE, "budget_prefix": SQL_PREFIX, "distinct_on_latest": SQL_LATEST,
    "session_activity": SQL_SESSIONS, "glow_windows": SQL_WINDOWS, "pulses": SQL_PULSES, "phase_changes": SQL_PHASES, "feed_topk": SQL_FEED, "retention_prune": SQL_RETENTION, "bitemporal_validity": SQL_VALIDITY, "ci_verdict": SQL_VERDICT,
    "team_metrics": SQL_TEAM, "ledger_balance": SQL_LEDGER, "commit_cards": SQL_CARDS, "pilot_stats": SQL_PILOT, "progress_digest": SQL_DIGEST, "percentile_report": SQL_PERCENTILES, "order_digests": SQL_ORDER_DIGESTS,
}
