"""Views of a workspace: bounded reads, cards, modules, pages of documentation, briefs, receipts, access to nodes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessellar.functions.paths import directory
from tessellar.functions.words import member_digest, pack_tokens
from tessellar.operators.assurance import severity_rank
from tessellar.operators.graph import both_ways, dependency_closure, modules
from tessellar.operators.reports import page
from tessellar.sources.tables import cut

#: Bounds of a page of edges, of an excerpt, of a brief, of code cards and of the symbol layer.
PAGE_ROWS, PAGE_BYTES = (1, 500, 2000), (1024, 256 << 10, 4 << 20)
EXCERPT = 280
BRIEF_CONSUMERS = 25
CODE_CARDS = 20
SYMBOL_LIMITS = {"files": 200, "symbols": 5000, "edges": 20_000}
CO_CHANGES = 3


def edge_page(edges: DataFrame, revision: int, expected: int | None, after: str | None = None, rows: int = PAGE_ROWS[1], size: int = PAGE_BYTES[1]) -> tuple[DataFrame, bool]:
    """A page of edges (id, source, target, relation) past an id, as far as both budgets go, and whether more follow.

    A reader that expects another revision than the table's is refused. Budgets are held within their bounds; past the end the page is empty.
    """
    if expected is not None and expected != revision:
        raise ValueError(f"the table is at revision {revision}, not {expected}")
    rows, size = min(PAGE_ROWS[2], max(PAGE_ROWS[0], rows)), min(PAGE_BYTES[2], max(PAGE_BYTES[0], size))
    rest = edges if after is None else edges.where(F.col("id") > after)
    first = rest.orderBy("id").limit(rows + 1).withColumn("_k", F.lit(0))
    bytes_ = F.octet_length(F.to_json(F.struct(*edges.columns)))
    kept = cut(page(first, ["_k"], ["id"], bytes_, rows, size).drop("_k"))
    return kept, first.count() > kept.count()


def bounded(table: DataFrame, order: Sequence[str], limit: int) -> tuple[DataFrame, bool]:
    """The first rows of a table and whether the limit cut it; one row more is read to know."""
    read = cut(table.orderBy(*order).limit(limit + 1))
    return read.orderBy(*order).limit(limit), read.count() > limit


def keyset(table: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next rows past a key."""
    return (table if after is None else table.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def positional(table: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """Rows by position in an order."""
    return table.orderBy(*order).offset(offset).limit(limit)


def finding_filter(findings: DataFrame, kind: str | None = None, severity: str | None = None, status: str = "open") -> DataFrame:
    """Findings of a kind and severity with a status (open unless said; all: any), with rank: the order by severity, title and id."""
    rows = findings if status == "all" else findings.where(F.col("status") == status)
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    rows = rows if severity is None else rows.where(F.col("severity") == severity)
    return rows.withColumn("severity_rank", severity_rank(F.col("severity")))


def saved_query(nodes: DataFrame, name: str, risk: DataFrame | None = None) -> DataFrame:
    """The nodes of a named query: untested-code, undocumented-code, unimplemented-requirements, and risk-top-10, which needs the nodes' risk (item, score) and leaves out code without one."""
    from tessellar.operators.retrieval import query_nodes

    if name == "risk-top-10":
        scored = query_nodes(nodes, units=["code"]).join(risk.select(F.col("item").alias("id"), "score"), "id")
        return scored.orderBy(F.desc("score"), "path", "id").limit(10)
    filters = {"untested-code": {"units": ["code"], "without_relations": ["tests"]}, "undocumented-code": {"has_summary": False, "units": ["code"], "without_relations": ["references"]}, "unimplemented-requirements": {"types": ["requirement"], "without_relations": ["implements"]}}
    return query_nodes(nodes, **filters[name])


def library_filter(items: DataFrame, query: str = "", tag: str | None = None) -> DataFrame:
    """Library items (name, type, content, repository, path, commit, tags) that have the tag and hold the query in one of seven fields."""
    q, t = query.strip().lower(), (tag or "").strip().lower()
    held = F.lower(F.concat_ws("\n", "name", "type", "content", "repository", "path", "commit", F.concat_ws("\n", "tags")))
    return items.where(F.array_contains("tags", t) if t else F.lit(True)).where(F.contains(held, F.lit(q)))


def to_summarise(files: DataFrame) -> DataFrame:
    """Files (path, blob, summary_blob) whose stored digest isn't theirs, or where either is missing."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return files.where(blank("blob") | blank("summary_blob") | (F.trim("blob") != F.trim("summary_blob")))


def neighbour_ids(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, neighbours) of every entry: the distinct other ends of its edges, sorted; none where it has no edge."""
    near = both_ways(edges).where("node <> other").groupBy(F.col("node").alias("id")).agg(F.array_sort(F.collect_set("other")).alias("neighbours"))
    return entries.select("id").join(near, "id", "left").select("id", F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"))


def omitted_edges(omissions: DataFrame) -> DataFrame:
    """(relation, omitted, reason) of several repositories' omissions (seq, relation, omitted, reason) as one; the last reason stays."""
    return omissions.groupBy("relation").agg(F.sum("omitted").alias("omitted"), F.max_by("reason", "seq").alias("reason"))


def co_changed_nodes(pairs: DataFrame, nodes: DataFrame, least: int = CO_CHANGES) -> DataFrame:
    """(source, target, times, confidence) of co-changed paths (a, b, times) as nodes (id, path): three times at least, ten are certain."""
    end = lambda c, name: nodes.select(F.col("path").alias(c), F.col("id").alias(name))
    return pairs.where(F.col("times") >= least).join(end("a", "source"), "a").join(end("b", "target"), "b").select("source", "target", "times", F.least(F.lit(1.0), F.col("times") / 10).alias("confidence"))


def excerpt(kind: Column, content: Column, statement: Column, verdict: Column, title: Column, fallback: Column) -> Column:
    """What a node shows of itself: an artifact its content's beginning, a requirement its statement's, evidence its kind and verdict, a finding its title."""
    cut_ = lambda c: F.substring(c, 1, EXCERPT)
    return F.when(kind == "artifact", cut_(F.coalesce(content, F.lit("")))).when(kind == "requirement", cut_(statement)).when(kind == "evidence", F.concat(fallback, F.lit(": "), verdict)).when(kind == "finding", title).otherwise(cut_(fallback))


def provenance(text: Column) -> Column:
    """path, start_line, end_line, tier and method of a provenance document; an unreadable one gives an empty path, line 0 and tier unknown."""
    j = F.from_json(text, "struct<span:struct<path:string,startLine:int,endLine:int>,tier:string,method:string>")
    whole = j["span"]["path"].isNotNull() & j["span"]["startLine"].isNotNull() & j["span"]["endLine"].isNotNull()
    tier = F.when(j["tier"].isin("agent_asserted", "inferred", "reference", "resolved"), j["tier"]).otherwise("unknown")
    return F.struct(F.when(whole, j["span"]["path"]).otherwise("").alias("path"), F.when(whole, j["span"]["startLine"]).otherwise(0).alias("start_line"), F.when(whole, j["span"]["endLine"]).otherwise(0).alias("end_line"), tier.alias("tier"), j["method"].alias("method"))


@F.pandas_udf(StringType())
def canonical_digest(statement: pd.Series) -> pd.Series:
    """SHA-256 of a JSON document with sorted keys and no blanks; null for what is no object."""
    def one(text):
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            return None
        return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest() if isinstance(value, dict) else None

    return statement.map(one)


def verified_receipts(receipts: DataFrame) -> DataFrame:
    """(id, state, actual) of receipts (id, statement, digest): verified, tampered where the digest is another, invalid without subject and predicate."""
    rows = receipts.withColumn("actual", canonical_digest("statement"))
    valid = F.col("actual").isNotNull() & F.get_json_object("statement", "$.subject").isNotNull() & F.get_json_object("statement", "$.predicate").isNotNull()
    return rows.select("id", F.when(~valid, "invalid").when(F.col("actual") == F.col("digest"), "verified").otherwise("tampered").alias("state"), F.when(valid, F.col("actual")).alias("actual"))


def module_states(clusters: DataFrame, artifacts: DataFrame, summaries: DataFrame) -> DataFrame:
    """(repo, key, name, members, digest, state, summary) of modules (repo, key, member, name): ready with a summary of the members' present digest, stale with an older one, pending without."""
    own = clusters.join(artifacts.select("repo", F.col("path").alias("member"), F.coalesce("blob", F.lit("")).alias("blob")), ["repo", "member"])
    digests = own.groupBy("repo", "key", "name").agg(F.count("*").alias("members"), member_digest(F.col("member"), F.col("blob")).alias("digest"))
    both = digests.join(summaries.select("repo", "key", F.col("digest").alias("of"), "summary"), ["repo", "key"], "left")
    state = F.when(F.col("of").isNull(), "pending").when(F.col("of") == F.col("digest"), "ready").otherwise("stale")
    return both.select("repo", "key", "name", "members", "digest", state.alias("state"), F.when(state == "ready", F.col("summary")).alias("summary"))


def page_slug(scope: Column, identity: Column, member_directories: Column) -> Column:
    """The address of a page: scope and identity, and of what has members their distinct directories in order."""
    spread = F.array_join(F.array_sort(F.array_distinct(member_directories)), "\n")
    return F.md5(F.concat(scope, F.lit("\n"), identity, F.when(scope.isin("module", "directory"), F.concat(F.lit("\n"), spread)).otherwise("")))


def page_skeletons(members: DataFrame, nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of pages (page, path): (page, members, relations, symbols), relations being the counts of edges that touch a member; and (page, cited) for each node outside that an edge leads to."""
    own = nodes.join(members, "path").select("page", F.col("id").alias("node"))
    ends = edges.select("source", "target", "relation")
    touched = ends.join(own.withColumnRenamed("node", "source"), "source").select("page", "source", "target", "relation", F.col("target").alias("other"), F.lit(0).alias("back"))
    back = ends.join(own.withColumnRenamed("node", "target"), "target").select("page", "source", "target", "relation", F.col("source").alias("other"), F.lit(1).alias("back"))
    each = cut(touched.unionByName(back))
    inner = each.join(own.withColumnRenamed("node", "other"), ["page", "other"], "left_semi")
    crossing = each.join(own.withColumnRenamed("node", "other"), ["page", "other"], "left_anti")
    counted = crossing.select("page", "relation").unionByName(inner.where("back = 0").select("page", "relation")).groupBy("page", "relation").agg(F.count("*").alias("n"))
    relations = counted.groupBy("page").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "n")))).alias("relations"))
    named = members.join(symbols.select("path", "name"), "path").groupBy("page").agg(F.array_sort(F.collect_set("name")).alias("symbols"))
    listed = members.groupBy("page").agg(F.array_sort(F.collect_set("path")).alias("members"))
    cited = crossing.select("page", F.col("other").alias("cited")).distinct().join(nodes.select(F.col("id").alias("cited")), "cited", "left_semi")
    return listed.join(relations, "page", "left").join(named, "page", "left"), cited.select("page", "cited")


def page_set(repository: str, clusters: DataFrame, files: DataFrame) -> DataFrame:
    """(page, path) of all pages of a repository: its own, one for each module, one for each directory with files."""
    whole = files.select(F.lit(f"repository:{repository}").alias("page"), "path")
    by_module = clusters.select(F.col("key").alias("page"), F.col("member").alias("path"))
    by_directory = files.select(F.concat(F.lit("directory:"), directory(F.col("path"))).alias("page"), "path").where("page <> 'directory:'")
    return whole.unionByName(by_module).unionByName(by_directory)


def symbol_layer(symbols: DataFrame, edges: DataFrame, artifacts: DataFrame, asked: DataFrame, limits: Mapping[str, int] = SYMBOL_LIMITS) -> tuple[DataFrame, DataFrame]:
    """The symbols (id, file) and edges around what is asked (id: files or symbols): all symbols of the files, one step of extends, and what declares what is reached; within limits in order of ids."""
    files = artifacts.select("id").join(asked.select("id").distinct(), "id", "left_semi").orderBy("id").limit(limits["files"])
    seeds = cut(symbols.join(files.withColumnRenamed("id", "file"), "file", "left_semi").select("id").unionByName(symbols.join(asked.select("id").distinct(), "id", "left_semi").select("id")).distinct())
    touching = edges.join(seeds.withColumnRenamed("id", "source"), "source", "left_semi").select(*edges.columns).unionByName(edges.join(seeds.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)).distinct()
    bases = touching.where("relation = 'extends'").select(F.explode(F.array("source", "target")).alias("id"))
    reached = cut(seeds.unionByName(bases).distinct())
    declared = edges.where("relation = 'declares'").join(reached.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)
    kept = symbols.join(reached, "id", "left_semi").orderBy("id").limit(limits["symbols"])
    ends = kept.select("id").unionByName(artifacts.select("id"))
    inside = touching.unionByName(declared).distinct().join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(kept.select(F.col("id").alias("target")), "target", "left_semi")
    return kept, inside.select(*edges.columns).orderBy("relation", "source", "target").limit(limits["edges"])


def merged_layers(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of two layers by id, the first one's where both have it."""
    return first.unionByName(second.join(first.select("id"), "id", "left_anti").select(*first.columns))


def artifact_cards(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, path, kind, incoming, outgoing): how often each relation leads to and from an artifact."""
    count = lambda end, name: edges.groupBy(F.col(end).alias("id"), "relation").agg(F.count("*").alias("n")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "n")))).alias(name))
    return artifacts.select("id", "path", "kind").join(count("target", "incoming"), "id", "left").join(count("source", "outgoing"), "id", "left")


def code_cards(cards: DataFrame, selected: DataFrame, left: int, most: int = CODE_CARDS) -> DataFrame:
    """(id, path, cost) of up to twenty cards of selected artifacts in the order of ids, until the first that the tokens left don't hold."""
    cost = pack_tokens(F.to_json(F.struct("id", "path", "kind", "incoming", "outgoing")))
    first = cards.join(selected.select("id").distinct(), "id", "left_semi").select("id", "path", cost.alias("cost")).orderBy("id").limit(most)
    used = F.sum("cost").over(W.partitionBy(F.lit(0)).orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    return first.withColumn("_used", used).where(F.col("_used") <= left).drop("_used")


def change_brief(artifacts: DataFrame, edges: DataFrame, node: str, most: int = BRIEF_CONSUMERS) -> DataFrame:
    """(consumer, path, distance, omitted, complete, cost) before a change: the nearest 25 consumers of a node, how many more there are, whether the walk was complete, and the tokens of the brief's paths."""
    found, stopped = dependency_closure(edges, node, budget=None)  # what is omitted is counted, so the walk is whole
    found = cut(found)
    n = found.count()
    rows = found.orderBy("distance", "node").limit(most).join(artifacts.select(F.col("id").alias("node"), "path"), "node", "left")
    cost = F.sum(pack_tokens(F.coalesce("path", "node"))).over(W.partitionBy(F.lit(0)))
    return rows.select(F.col("node").alias("consumer"), "path", "distance", F.lit(max(0, n - most)).cast("long").alias("omitted"), F.lit(stopped is None).alias("complete"), cost.alias("cost"))


def touched_nodes(events: DataFrame, workspace: str, revoked: Sequence[str] = ()) -> DataFrame:
    """(node, touches, last_at) of access events (id, workspace, token, nodes, at) of a workspace by tokens that aren't revoked; an event that comes twice counts once."""
    own = events.where((F.col("workspace") == workspace) & ~F.coalesce(F.col("token").isin(*revoked) if revoked else F.lit(False), F.lit(False))).dropDuplicates(["id"])
    return own.select(F.explode(F.array_distinct("nodes")).alias("node"), "at").groupBy("node").agg(F.count("*").alias("touches"), F.max("at").alias("last_at"))


def importance(ranks: DataFrame, n: int) -> DataFrame:
    """(id, importance) for the size of nodes: a rank against the mean, three at most."""
    return ranks.select("id", F.least(F.lit(3.0), F.col("rank") * n * 3 / F.greatest(F.sum(F.col("rank") * n).over(W.partitionBy(F.lit(0))), F.lit(1e-9))).alias("importance"))


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 20) -> DataFrame:
    """(repo, id, community) by modularity: each node moves to the neighbouring community that gains most, in the order of ids, until none moves; nodes (repo, id, path) without edges belong to their folder.

    Moves depend on each other, so a repository is one group; repositories are dealt to tasks.
    """
    rows = nodes.select("repo", F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), "path").unionByName(edges.where("source <> target").select("repo", "source", "target", F.lit(None).cast("string").alias("path")))
    return rows.groupBy("repo").applyInPandas(lambda df: _communities(df, rounds), "repo string, id string, community string")


def _communities(df: pd.DataFrame, rounds: int) -> pd.DataFrame:
    own = df[df.target.isna()].sort_values("source")
    known = {i: k for k, i in enumerate(own.source)}
    near: list[dict[int, int]] = [{} for _ in known]
    for a, b in zip(df.source, df.target, strict=True):
        if b is not None and a in known and b in known:
            for x, y in ((known[a], known[b]), (known[b], known[a])):
                near[x][y] = near[x].get(y, 0) + 1
    degree = np.array([sum(x.values()) for x in near], float)
    label, held, whole = list(range(len(near))), degree.copy(), max(degree.sum(), 1.0)
    for _ in range(rounds):
        moved = False
        for i, others in enumerate(near):
            if not others:
                continue
            held[label[i]] -= degree[i]
            links: dict[int, float] = {}
            for j, w in others.items():
                links[label[j]] = links.get(label[j], 0) + w
            gain = lambda c: links.get(c, 0) - held[c] * degree[i] / whole  # noqa: B023, E731
            best = max([label[i], *sorted(links)], key=lambda c: (round(gain(c), 12), -c))
            moved |= best != label[i]
            label[i] = best
            held[best] += degree[i]
        if not moved:
            break
    folder = lambda p: p.rsplit("/", 1)[0] if isinstance(p, str) and "/" in p else "."
    names = [f"community:{own.source.iloc[label[k]]}" if near[k] else f"folder:{folder(p)}" for k, p in enumerate(own.path)]
    return pd.DataFrame({"repo": own.repo.to_numpy(), "id": own.source.to_numpy(), "community": names})


def repository_modules(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, key, member, name): modules by the structure edges (imports and calls) between known files."""
    inner = edges.where(F.col("relation").isin("imports", "calls"))
    return modules(inner, files)


def repository_overview(states: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(repo, files, modules, summarised) of repositories with their modules' states."""
    files = artifacts.groupBy("repo").agg(F.count("*").alias("files"))
    own = states.groupBy("repo").agg(F.count("*").alias("modules"), F.count("summary").alias("summarised"))
    zero = F.lit(0).cast("long")
    return files.join(own, "repo", "left").select("repo", "files", F.coalesce("modules", zero).alias("modules"), F.coalesce("summarised", zero).alias("summarised"))


def page_prose_faults(prose: Column, allowed: Column) -> Column:
    """Ids that a page's prose cites in double brackets and its skeleton doesn't have."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(prose, F.lit(r"\[\[([^\]\s]+)\]\]"), F.lit(1))), allowed)


def node_content(ids: DataFrame, **kinds: DataFrame) -> DataFrame:
    """(id, kind, content) of the nodes asked for (id), from tables of several kinds (id, content); ids that none has keep a null kind."""
    every = None
    for kind, rows in kinds.items():
        own = rows.select("id", F.lit(kind).alias("kind"), "content")
        every = own if every is None else every.unionByName(own)
    return ids.select("id").distinct().join(every, "id", "left")


def module_card(states: DataFrame, clusters: DataFrame, path: str) -> DataFrame:
    """The state of the module that holds a path; no row if none does."""
    return states.join(clusters.where(F.col("member") == path).select("repo", "key"), ["repo", "key"], "left_semi")
