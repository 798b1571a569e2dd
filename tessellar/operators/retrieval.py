"""Search, questions' routes, packs under budgets, the repository map, structured node queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.functions import paths
from tessellar.functions.words import has_all, pack_tokens, query_tokens, search_text, task_tokens, tokens_utf16
from tessellar.operators.graph import both_ways, pagerank, simple
from tessellar.operators.reports import running_sum
from tessellar.sources.tables import cut, written

#: Points of the search tiers, and what the greatest connection adds.
TIERS = {"exact": 400, "title-heading": 300, "path-symbol": 200, "graph-neighbor": 100}
CONNECTION = 50
#: Signals of a question, in order, and what each looks for; any of them sends it to the graph.
ROUTES = {
    "path-trace": r"(?i)추적|\btrac(?:e|ing)\b|(?:사이|간)의?\s*경로|\bpath\s+(?:between|from)\b",
    "connection": r"(?i)연결|이어[지진]|연쇄|\bconnected\b|\blinked\b",
    "impact": r"(?i)영향|바뀌면|바꾸면|고치면|\bimpact\b|\baffect(?:s|ed)?\b",
    "dependency": r"(?i)의존|\bdepends?\b|\bdependenc",
    "neighborhood": r"(?i)이웃|인접|주변 노드|\bneighbors?\b",
    "relation": r"(?i)관계|\brelations?(?:ship)?\b",
    "span-endpoints": r"(?i)(?:에서|부터).{1,40}까지|\bfrom\b.{1,60}\bto\b",
    "relational-absence": r"(?i)(?:없는|않은|안 된)\s*(?:요구사항|문서|테스트|증거)|\bwithout\s+(?:tests?|evidence)\b",
}
#: Tools of either route.
GRAPH_TOOLS = ("search_index", "get_neighbors", "trace_path", "impact_of", "query_brain")
SEARCH_TOOLS = ("search_index", "get_artifact")
#: Points of the kinds of context documents, of graph and key word matches, and of the root's instructions.
KIND_POINTS = {"agents": 100, "claude": 90, "spec": 50, "todo_progress": 40, "skill": 30, "cursor_rule": 20, "adr": 10}
GRAPH_POINTS, WORD_POINTS, ROOT_POINTS = 100, 10, 10_000
#: Budget of the repository map, and symbols in one of its lines.
MAP_BUDGET = (100, 1200, 8000)
MAP_SYMBOLS = 12
#: Items of one key that are gathered in one row; keys with more are taken in rounds.
GATHERED = 4096


def direct_hits(entries: DataFrame, query: str, compose: bool = True) -> DataFrame:
    """(id, path, tier) of entries (id, path, title, search_key, headings, tags, symbols) that a query finds by their own texts.

    exact: a field is the query; title-heading: title, headings and tags hold all its words; path-symbol: path and symbols
    do. A query without words finds nothing.
    """
    tokens = query_tokens(query)
    whole = " ".join(query.split()).lower()
    text = lambda c: search_text(c, compose)
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    joined = text(F.concat_ws(" ", "title", listed("headings"), listed("tags")))
    exact = F.contains(fields_text(compose), F.lit(f"\x01{whole}\x01"))
    tier = F.when(exact, "exact").when(has_all(joined, tokens), "title-heading").when(has_all(text(F.concat_ws(" ", "path", listed("symbols"))), tokens), "path-symbol")
    return entries.select("id", "path", (tier if tokens else F.lit(None).cast("string")).alias("tier")).where("tier is not null")


def fields_text(compose: bool = True) -> Column:
    """Every field of an entry as the search compares it, between marks."""
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    fields = F.array_join(F.concat(F.array("title", "path", "search_key"), listed("headings"), listed("tags"), listed("symbols")), "\x00")
    shown = search_text(F.regexp_replace(fields, "\x00", " \x01 "), compose)
    return F.concat(F.lit("\x01"), F.regexp_replace(shown, " ?\x01 ?", "\x01"), F.lit("\x01"))


def answer(hits: DataFrame, nodes: DataFrame, edges: DataFrame, connected: bool = False) -> DataFrame:
    """(id, path, tier, points) of direct hits and, as graph-neighbor, of their neighbours among the nodes (id, path).

    With ``connected`` the seeded PageRank around the direct hits, over the undirected edges, adds up to 50 points.
    """
    hits = written(hits)
    around = both_ways(edges).join(hits.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("other").alias("id")).distinct()
    near = nodes.select("id", "path").join(around, "id", "left_semi").join(hits, "id", "left_anti").withColumn("tier", F.lit("graph-neighbor"))
    points = F.element_at(F.create_map(*[F.lit(x) for t, p in TIERS.items() for x in (t, p)]), F.col("tier")).cast("double")
    out = hits.unionByName(near).select("id", "path", "tier", points.alias("points"))
    if not connected or hits.isEmpty():
        return out
    pairs = simple(edges).select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("link").alias("relation"))
    rank = pagerank(nodes.select("id"), pairs, hits.select("id"))
    return out.join(rank, "id", "left").select("id", "path", "tier", (F.col("points") + F.coalesce("rank", F.lit(0.0)) * CONNECTION).alias("points"))


def search(entries: DataFrame, edges: DataFrame, query: str, compose: bool = True, connected: bool = False) -> DataFrame:
    """(id, path, tier, points): ``answer`` to the ``direct_hits`` of a query, by a pass over all entries."""
    return answer(direct_hits(entries, query, compose), entries, edges, connected)


def search_page(found: DataFrame, limit: int = 20) -> DataFrame:
    """The first hits by points, path and id, each with how many there are and how many the page leaves out."""
    found = cut(found)
    n = found.count()
    return found.orderBy(F.desc("points"), "path", "id").limit(limit).select("*", F.lit(n).cast("long").alias("eligible"), F.lit(max(0, n - limit)).cast("long").alias("omitted"))


def memory_hits(entries: DataFrame, query: str, compose: bool = True) -> DataFrame:
    """(id, path, tier, points) of memory entries (id, name, entry_key, text, anchor) that hold all words; they rank like paths and symbols."""
    held = entries.where(has_all(search_text(F.concat_ws(" ", "name", "entry_key", "text"), compose), query_tokens(query)) & F.lit(bool(query_tokens(query))))
    return held.select("id", F.coalesce("anchor", F.concat(F.lit("memory/"), "name", F.lit("/"), "entry_key")).alias("path"), F.lit("path-symbol").alias("tier"), F.lit(float(TIERS["path-symbol"])).alias("points"))


def section_hits(sections: DataFrame, query: str, most: int = 3, compose: bool = True) -> DataFrame:
    """(path, sections): of each document the first so many declared sections whose heading holds all words of the query."""
    held = sections.where(has_all(search_text(F.col("heading"), compose), query_tokens(query)))
    return held.groupBy("path").agg(F.slice(F.array_sort(F.collect_list(F.struct("line", "heading", "token"))), 1, most).alias("sections"))


def coverage(read: Mapping[str, tuple[int, int]], needed: Sequence[str]) -> tuple[str, list[str]]:
    """complete, or partial and why: tables (rows read, limit) that a search needs and that were read up to their limit."""
    short = [f"{t} was read up to {limit} rows" for t, (n, limit) in read.items() if t in needed and n >= limit]
    return ("partial" if short else "complete"), short


def lookup(artifacts: DataFrame, path: str, edges: DataFrame, most: int = 25) -> DataFrame:
    """(id, repository, path, ambiguous, neighbours) of the artifacts with this path, up to 25; several make it ambiguous, and then none has neighbours."""
    found = cut(artifacts.where(F.col("path") == path).orderBy("repository", "id").limit(most))
    alone = found.count() == 1
    near = both_ways(edges).join(found.select(F.col("id").alias("node")), "node", "left_semi").groupBy(F.col("node").alias("id")).agg(F.array_sort(F.collect_set("other")).alias("neighbours"))
    out = found.select("id", "repository", "path", F.lit(not alone).alias("ambiguous"))
    return out.join(near, "id", "left") if alone else out.withColumn("neighbours", F.lit(None).cast("array<string>"))


def route(text: Column) -> tuple[Column, Column]:
    """The signals of a question in their order, and its route."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in ROUTES.items()]))
    return found, F.when(F.size(found) > 0, "graph").otherwise("search")


def route_tools(route_: Column) -> tuple[Column, Column]:
    """The tools of a route, and the route to fall back on."""
    tools = F.when(route_ == "graph", F.array(*[F.lit(t) for t in GRAPH_TOOLS])).otherwise(F.array(*[F.lit(t) for t in SEARCH_TOOLS]))
    return tools, F.when(route_ == "graph", "search").otherwise("graph")


def context_ranking(documents: DataFrame, relations: DataFrame, task: str) -> DataFrame:
    """Documents (id, kind, path, title, content, related) with keywords, graph, score, cost and relevant.

    A relation (source, target, source_label, target_label) counts for its end where the other end's id or label shares a
    word with the task. Only key words, relations or being the root's instructions make a document relevant.
    """
    words = sorted({t for t in query_tokens(task.replace("_", " ").replace("-", " ")) if len(t) > 1})
    asked = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    shared = lambda c: F.size(F.array_intersect(asked, task_tokens(c)))
    ends = relations.select(F.col("source").alias("id"), F.concat_ws(" ", "target", "target_label").alias("far")).unionByName(relations.where("source <> target").select(F.col("target").alias("id"), F.concat_ws(" ", "source", "source_label").alias("far")))
    graph = ends.where(shared(F.col("far")) > 0).groupBy("id").agg(F.count("*").alias("graph"))
    own = documents.select("id", "kind", "path", shared(F.concat_ws(" ", "path", "title", "content", F.coalesce("related", F.array().cast("array<string>")))).alias("keywords"), pack_tokens(F.col("content")).alias("cost"))
    rows = own.join(graph, "id", "left").withColumn("graph", F.coalesce("graph", F.lit(0)))
    root = (F.col("kind") == "agents") & (F.col("path") == "AGENTS.md")
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, p in KIND_POINTS.items() for x in (k, p)]), F.col("kind")), F.lit(0))
    score = F.when(root, ROOT_POINTS).otherwise(0) + F.col("graph") * GRAPH_POINTS + F.col("keywords") * WORD_POINTS + kind
    return rows.select("id", "path", "kind", "keywords", "graph", score.cast("long").alias("score"), "cost", ((F.col("keywords") > 0) | (F.col("graph") > 0) | root).alias("relevant"))


def context_pack(ranked: DataFrame, budget: int) -> DataFrame:
    """(id, path, cost, rank, reason): documents in reading order with their rank, then those left out with a reason and no rank."""
    rows = cut(ranked.withColumn("_k", F.lit(0)))
    taken = first_fit(rows.where("relevant"), "_k", [-F.col("score"), F.col("path"), F.col("id")], "id", F.col("cost"), budget).select(F.col("item").alias("id"), F.lit(True).alias("taken"))
    out = rows.join(taken, "id", "left")
    place = F.row_number().over(W.partitionBy("taken").orderBy(F.desc("score"), "path", "id"))
    reason = F.when(F.col("taken"), "selected").when(~F.col("relevant"), "No task-term or evidence-graph match.").otherwise("Token budget reserved for higher-ranked documents.")
    chosen = out.where("taken").withColumn("rank", place)  # no more rows than the budget
    return chosen.unionByName(out.where("taken is null").withColumn("rank", F.lit(None).cast("int"))).select("id", "path", "cost", "rank", reason.alias("reason"))


def first_fit(rows: DataFrame, key: str, order: Sequence[Column], item: str, cost: Column, budget: int) -> DataFrame:
    """(key, item) of each key's items that are taken: in order, those that still fit the budget; one that doesn't is skipped.

    Keys of up to 4,096 items are folded in one row each. Of larger ones each round takes the longest run of the first items
    that fits, skips the one after it and drops what costs more than is left; a round looks at no more than the budget's
    items of a key, as most cost one at least.
    """
    by = [c.alias(f"o{i}") for i, c in enumerate(order)]
    names = [f"o{i}" for i in range(len(order))]
    rows = rows.select(F.col(key).alias("key"), *by, F.col(item).alias("item"), cost.cast("long").alias("cost"))
    large = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GATHERED).select("key"))
    some = not large.isEmpty()
    small = rows.join(large, rows["key"].eqNullSafe(large["key"]), "left_anti") if some else rows
    taken = F.array_sort(F.collect_list(F.struct(*names, "item", "cost")))
    kind = f"array<{rows.schema['item'].dataType.simpleString()}>"
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("items"))
    step = lambda a, x: F.when(a["used"] + x["cost"] <= budget, F.struct((a["used"] + x["cost"]).alias("used"), F.concat(a["items"], F.array(x["item"])).alias("items"))).otherwise(a)
    out = small.groupBy("key").agg(F.aggregate(taken, start, step).alias("a")).select("key", F.explode("a.items").alias("item"))
    if not some:
        return out
    left = cut(rows.join(large, rows["key"].eqNullSafe(large["key"]), "left_semi").withColumn("left", F.lit(budget).cast("long")).where("cost <= left"))
    at = W.partitionBy("key").orderBy(*names, "item")
    while not left.isEmpty():
        first = left.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= budget + 1)
        first = cut(first.withColumn("_run", F.sum("cost").over(at.rowsBetween(W.unboundedPreceding, 0))))
        fits = F.col("_run") <= F.col("left")
        out = out.unionByName(first.where(fits).select("key", "item"))
        mark = F.struct(*names, "item")
        state = first.groupBy("key").agg(F.coalesce(F.max(F.when(fits, F.col("_run"))), F.lit(0)).alias("_used"), F.coalesce(F.min(F.when(~fits, mark)), F.max(mark)).alias("_last"))
        left = cut(left.join(state, left["key"].eqNullSafe(state["key"])).drop(state["key"]).where(mark > F.col("_last")).withColumn("left", F.col("left") - F.col("_used")).where("cost <= left").drop("_used", "_last"))
    return out


def pack(rows: DataFrame, key: str, order: Sequence[Column], item: str, cost: Column, budget: int) -> DataFrame:
    """(key, used, items): what ``first_fit`` takes of each key, its cost and its items in order."""
    own = rows.select(F.col(key).alias("_key"), *[c.alias(f"_o{i}") for i, c in enumerate(order)], F.col(item).alias("_item"), cost.cast("long").alias("_cost"))
    taken = first_fit(own, "_key", [F.col(f"_o{i}") for i in range(len(order))], "_item", F.col("_cost"), budget)
    met = own.join(taken, own["_key"].eqNullSafe(taken["key"]) & own["_item"].eqNullSafe(taken["item"]), "left_semi")
    listed = met.groupBy("_key").agg(F.sum("_cost").alias("used"), F.array_sort(F.collect_list(F.struct(*[f"_o{i}" for i in range(len(order))], "_item"))).alias("xs"))
    shown = listed.select(F.col("_key").alias("_k"), "used", F.array_join(F.transform("xs", lambda x: x["_item"].cast("string")), ",").alias("items"))
    keys = own.select("_key").distinct()
    out = keys.join(shown, keys["_key"].eqNullSafe(shown["_k"]), "left")
    return out.select(F.col("_key").alias(key), F.coalesce("used", F.lit(0)).cast("long").alias("used"), F.coalesce("items", F.lit("")).alias("items"))


def batch_starts(rows: DataFrame, key: str, order: str, size: Column, most: int) -> DataFrame:
    """(key, order, size, upto, start): every item with the running size, and whether a next-fit batch begins with it.

    If a batch begins with an item, the next begins with the first item beyond the size that fits from there: found for all
    items at once, in the order of running sizes. The batches are the chain from the first item, by pointer jumping.
    """
    own = rows.select(F.col(key).alias("key"), F.col(order).alias("at"), size.cast("long").alias("size"))
    summed = cut(running_sum(own, ["key"], "at", F.col("size")).withColumnRenamed("running", "upto"))
    asks = summed.select("key", (F.col("upto") - F.col("size") + most).alias("v"), F.lit(1).alias("is_ask"), "at")
    ends = summed.select("key", F.col("upto").alias("v"), F.lit(0).alias("is_ask"), "at")
    # from the largest value down, the least item seen so far whose running size is beyond the ask, and past the asker
    later = W.partitionBy("key").orderBy(F.desc("v"), F.desc("is_ask"), F.desc("at")).rowsBetween(W.unboundedPreceding, 0)
    met = asks.unionByName(ends).withColumn("next", F.last(F.when(F.col("is_ask") == 0, F.col("at")), ignorenulls=True).over(later))
    jump = met.where("is_ask = 1").select("key", "at", F.when(F.col("next") > F.col("at"), F.col("next")).alias("jump"))
    after = F.lead("at").over(W.partitionBy("key").orderBy("at"))
    over = summed.withColumn("after", after).select("key", "at", F.when(F.col("size") > most, F.col("after")).alias("own_next"), (F.col("size") > most).alias("alone"))
    jump = jump.join(over, ["key", "at"]).select("key", "at", F.when(F.col("alone"), F.col("own_next")).otherwise(F.col("jump")).alias("jump"))
    first = summed.groupBy("key").agg(F.min("at").alias("at")).withColumn("reached", F.lit(True))
    now = cut(jump.join(first, ["key", "at"], "left").withColumn("reached", F.coalesce("reached", F.lit(False))))
    while not now.where("jump is not null").isEmpty():
        ahead = now.select("key", F.col("at").alias("jump"), F.col("jump").alias("next"))
        moved = now.join(ahead, ["key", "jump"], "left")
        marks = moved.where("reached and jump is not null").select("key", F.col("jump").alias("at"), F.lit(None).cast(now.schema["jump"].dataType).alias("jump"), F.lit(True).alias("reached"))
        own_ = moved.select("key", "at", F.col("next").alias("jump"), "reached")
        now = cut(own_.unionByName(marks).groupBy("key", "at").agg(F.max("jump").alias("jump"), F.max("reached").alias("reached")))
    return summed.join(now.select("key", "at", F.col("reached").alias("start")), ["key", "at"])


def batches(rows: DataFrame, key: str, order: str, size: Column, most: int) -> DataFrame:
    """(key, n_batches, largest): next-fit batches of each key's items in order; an item larger than a batch has its own.

    Keys of up to 4,096 items are folded in one row; of larger ones the batches are found by ``batch_starts``. A null key is
    folded in one row whatever its size.
    """
    rows = rows.withColumn("_size", size.cast("long"))
    large = cut(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > GATHERED).select(key))
    some = not large.isEmpty()
    small = rows.join(large, key, "left_anti") if some else rows
    taken = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_size").alias("size"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("held"), F.lit(0).cast("long").alias("largest"))

    def step(a: Column, x: Column) -> Column:
        fresh = (a["n"] == 0) | (a["held"] + x["size"] > most)
        held = F.when(fresh, x["size"]).otherwise(a["held"] + x["size"])
        return F.struct((a["n"] + fresh.cast("long")).alias("n"), held.alias("held"), F.greatest(a["largest"], held).alias("largest"))

    out = small.groupBy(key).agg(F.aggregate(taken, start, step).alias("a")).select(key, F.col("a.n").alias("n_batches"), "a.largest")
    if not some:
        return out
    marked = batch_starts(rows.join(large, key, "left_semi"), key, order, F.col("_size"), most)
    begun = marked.where("start").select("key", "at", (F.col("upto") - F.col("size")).alias("before"))
    ends = marked.groupBy("key").agg(F.max("upto").alias("total"))
    held = begun.join(ends, "key").withColumn("held", F.coalesce(F.lead("before").over(W.partitionBy("key").orderBy("at")), "total") - F.col("before"))
    return out.unionByName(held.groupBy(F.col("key").alias(key)).agg(F.count("*").alias("n_batches"), F.max("held").alias("largest")))


def repo_map(artifacts: DataFrame, edges: DataFrame, focus: Sequence[str] = (), budget: int = MAP_BUDGET[1]) -> DataFrame:
    """(path, line, score, used): the lines of a map of artifacts (id, path, kind, symbols), best ranks first, as far as the token budget goes.

    Ranks are PageRank around the artifacts whose path or symbols hold a focus term, around all without one.
    """
    budget = min(MAP_BUDGET[2], max(MAP_BUDGET[0], budget))
    terms = [t.strip().lower() for t in focus if t.strip()]
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(F.lower("path"), F.lit(t)) | F.exists("symbols", lambda s: F.contains(F.lower(s), F.lit(t)))  # noqa: B023
    rank = pagerank(artifacts.select("id"), edges, artifacts.where(hit).select("id"))
    n = F.size("symbols")
    shown = F.concat(F.array_join(F.slice("symbols", 1, MAP_SYMBOLS), ", "), F.when(n > MAP_SYMBOLS, F.concat(F.lit(" (+"), (n - MAP_SYMBOLS).cast("string"), F.lit(")"))).otherwise(""))
    line = F.concat("path", F.lit(" — "), F.when(n > 0, shown).otherwise(F.col("kind")))
    rows = artifacts.join(rank, "id", "left").select("path", line.alias("line"), F.coalesce("rank", F.lit(0.0)).alias("score"))
    # a line costs a token at least, so no more lines than the budget can be taken
    first = rows.orderBy(F.desc("score"), "path").limit(budget + 1)
    used = F.sum(tokens_utf16(F.concat("line", F.lit("\n")))).over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "path").rowsBetween(W.unboundedPreceding, 0))
    return first.withColumn("used", used).where(F.col("used") <= budget)


def term_ranking(entries: DataFrame, query: str) -> DataFrame:
    """(path, score) of corpus entries (path, content): twelve points for each query word in the path, three for each in the content, two for the root's instructions; those with points."""
    import regex

    words = list(dict.fromkeys(t for t in regex.split(r"[^\p{L}\p{N}_-]+", query.lower()) if len(t) > 2))
    asked = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    held = lambda c: F.size(F.array_intersect(asked, F.split(F.lower(c), r"[^\p{L}\p{N}_-]+")))
    score = 12 * held(F.col("path")) + 3 * held(F.col("content")) + F.when(F.col("path") == "AGENTS.md", 2).otherwise(0)
    return entries.select("path", score.cast("long").alias("score")).where("score > 0")


def query_nodes(nodes: DataFrame, types: Sequence[str] | None = None, statuses: Sequence[str] | None = None, domains: Sequence[str] | None = None, units: Sequence[str] | None = None, families: Sequence[str] | None = None, relations: Sequence[str] | None = None, without_relations: Sequence[str] | None = None, has_summary: bool | None = None, path: str | None = None, path_glob: str | None = None) -> DataFrame:
    """The nodes (id, type, status, path, domain, unit, families, relations, summary_state) that pass every filter given.

    One of the types, statuses, domains, units, families; all relations; none of the others. An unknown domain or unit
    belongs to none. Only a current summary counts as one. Path filters look at an empty path where there is none.
    """
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    none = F.array().cast("array<string>")
    keep = F.lit(True)
    for values, column in ((types, "type"), (statuses, "status"), (domains, "domain"), (units, "unit")):
        if values is not None:
            keep = keep & F.coalesce(F.col(column).isin(*values), F.lit(False))
    own = lambda c: F.coalesce(F.col(c), none)
    if families is not None:
        keep = keep & F.arrays_overlap(own("families"), listed(families))
    if relations:
        keep = keep & (F.size(F.array_intersect(own("relations"), listed(relations))) == len(set(relations)))
    if without_relations:
        keep = keep & ~F.arrays_overlap(own("relations"), listed(without_relations))
    if has_summary is not None:
        keep = keep & (F.coalesce(F.col("summary_state") == "current", F.lit(False)) == has_summary)
    where = F.coalesce("path", F.lit(""))
    if path:
        keep = keep & F.contains(search_text(where, False), F.lit(" ".join(path.split()).lower()))
    if path_glob:
        keep = keep & where.rlike(paths.glob_regex(path_glob))
    return nodes.where(keep)


def limited(rows: DataFrame, order: Sequence[Column | str], limit: int | None) -> DataFrame:
    """The first rows in order, each with how many the limit drops."""
    if limit is None:
        return rows.withColumn("dropped", F.lit(0).cast("long"))
    n = rows.count()
    return rows.orderBy(*order).limit(limit).withColumn("dropped", F.lit(max(0, n - limit)).cast("long"))
