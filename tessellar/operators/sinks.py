"""What stored tables become when derived ones arrive: upserts, compare-and-set, reconciliation, with what happened to each row.

Each returns a new table, or outcomes, from a full outer join on the key; writing it in place of the old one is the caller's
last step. Nothing is deleted row by row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(before: DataFrame, now: DataFrame, keys: Sequence[str], columns: Sequence[str], keep_absent: bool = True) -> DataFrame:
    """(keys, columns, outcome): inserted, updated where a column differs, unchanged; absent rows are kept, or left out as removed ones."""
    a = before.select(*keys, F.struct(*columns).alias("_old"))
    b = now.select(*keys, F.struct(*columns).alias("_new"))
    both = a.join(b, list(keys), "full_outer")
    outcome = F.when(F.col("_new").isNull(), "kept" if keep_absent else "removed").when(F.col("_old").isNull(), "inserted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated")
    same = F.when(F.col("_old").isNotNull() & F.col("_new").isNotNull() & F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise(outcome)
    return both.select(*keys, F.coalesce("_new", "_old").alias("_row"), same.alias("outcome")).select(*keys, "_row.*", "outcome")


def tally(outcomes: DataFrame) -> DataFrame:
    """(outcome, n)."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def conditional(before: DataFrame, proposed: DataFrame, key: str, digest: str, text: str, valid: Column | None = None) -> DataFrame:
    """(key, text, outcome) of proposed texts made from a digest: applied where it is still the row's, superseded where it isn't, missing where there is no row, invalid where the text isn't valid.

    Of several proposals for a key the last one counts (column seq).
    """
    last = proposed.groupBy(key).agg(F.max_by(F.struct(F.col(digest).alias("_digest"), F.col(text).alias("_text")), "seq").alias("p")).select(key, "p.*")
    ok = (F.trim(F.coalesce("_text", F.lit(""))) != "") if valid is None else valid
    both = last.join(before.select(key, F.col(digest).alias("_now"), F.col(text).alias("_old"), F.lit(True).alias("_there")), key, "left")
    outcome = F.when(~ok, "invalid").when(F.col("_there").isNull(), "missing").when(F.col("_now").eqNullSafe(F.col("_digest")), "applied").otherwise("superseded")
    return both.select(key, F.when(outcome == "applied", F.col("_text")).otherwise(F.col("_old")).alias(text), outcome.alias("outcome"))


def last_write(rows: DataFrame, keys: Sequence[str], seq: str, columns: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(seq)).alias("r")).select(*keys, "r.*")


def findings_delta(before: DataFrame, now: DataFrame, key: str = "id") -> DataFrame:
    """(id, status, change) of known findings (id, status: open, resolved, dismissed) and those found now.

    New ones are opened, resolved ones that come back are opened again, open ones that are found no more are resolved;
    dismissed ones stay dismissed whether they are found or not.
    """
    both = before.select(key, "status").join(now.select(key, F.lit(True).alias("_found")).distinct(), key, "full_outer")
    found = F.col("_found").isNotNull()
    status = F.when(F.col("status") == "dismissed", "dismissed").when(found, "open").otherwise("resolved")
    change = F.when(F.coalesce("status", F.lit("resolved")) == F.lit("dismissed"), "none").when(found & F.coalesce(F.col("status") != "open", F.lit(True)), "opened").when(~found & (F.col("status") == "open"), "resolved").otherwise("none")
    return both.select(key, status.alias("status"), change.alias("change"))


def delta_counts(delta: DataFrame) -> DataFrame:
    """One row: opened, resolved, open_total."""
    return delta.agg(F.count_if(F.col("change") == "opened").alias("opened"), F.count_if(F.col("change") == "resolved").alias("resolved"), F.count_if(F.col("status") == "open").alias("open_total"))


def replaced_evidence(before: DataFrame, now: DataFrame, key: Sequence[str], source: str) -> DataFrame:
    """Stored evidence with all rows of one source replaced by those found now; rows of other sources stay."""
    return before.where(F.col("source") != source).unionByName(now.withColumn("source", F.lit(source)).select(*before.columns))


def merged_concepts(batches: DataFrame) -> DataFrame:
    """(slug, name, summary, members, links) of concepts of several batches (batch, slug, name, summary, members, links): members and links united in sorted order, the first name, the longest summary, the first of equally long ones."""
    none = F.array().cast("array<string>")
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, none)))))
    return batches.groupBy("slug").agg(F.min_by("name", "batch").alias("name"), F.max_by("summary", F.struct(F.length("summary"), -F.col("batch"))).alias("summary"), union("members").alias("members"), union("links").alias("links"))


def valid_concepts(concepts: DataFrame, known: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """(slug, members, links, valid) of concepts (slug, members, links: array of (relation, target)): members that are known paths, links with relations of the vocabulary to other concepts; valid with a member at least."""
    rows = concepts.select("slug", F.explode_outer("members").alias("path")).join(known.select("path").distinct(), "path", "left_semi")
    members = rows.groupBy("slug").agg(F.array_sort(F.collect_set("path")).alias("members"))
    each = concepts.select("slug", F.explode_outer("links").alias("l")).where(F.col("l.relation").isin(*vocabulary) & (F.col("l.target") != F.col("slug")))
    kept = each.join(concepts.select(F.col("slug").alias("target")).distinct(), F.col("l.target") == F.col("target"), "left_semi").groupBy("slug").agg(F.array_sort(F.collect_set("l")).alias("links"))
    out = concepts.select("slug").distinct().join(members, "slug", "left").join(kept, "slug", "left")
    return out.select("slug", F.coalesce("members", F.array().cast("array<string>")).alias("members"), "links", F.col("members").isNotNull().alias("valid"))


def page_slugs(before: DataFrame, now: DataFrame) -> DataFrame:
    """(scope, identity, slug, previous) of pages: the new slug where one is given, and the former slugs in order, each once."""
    both = before.select("scope", "identity", F.col("slug").alias("_old"), "previous").join(now.select("scope", "identity", F.col("slug").alias("_new")), ["scope", "identity"], "full_outer")
    none = F.array().cast("array<string>")
    past = F.when(F.col("_old").isNotNull() & F.col("_new").isNotNull() & (F.col("_old") != F.col("_new")), F.array_distinct(F.concat(F.coalesce("previous", none), F.array("_old")))).otherwise(F.coalesce("previous", none))
    return both.select("scope", "identity", F.coalesce("_new", "_old").alias("slug"), F.array_except(past, F.array(F.coalesce("_new", "_old"))).alias("previous"))


def memory_states(writes: DataFrame, most: int = 12) -> DataFrame:
    """(seq, outcome) of writes (seq, name, entry_key, anchor, text, remove) to a memory that keeps up to twelve active entries for each anchor and name.

    Each write of a key is judged against the key's last write: invalidated if it removes what is there, noop if nothing
    changes, else added or updated. Additions beyond the cap are rejected_cap. The cap counts in order of writes, so rows are
    sorted by anchor, name and seq and pass once, batch by batch, beside a state of twelve keys and their texts' digests: an
    anchor of any size takes no more memory than a small one. Null anchors and names are values of their own.
    """
    memory = F.to_json(F.struct("anchor", "name"), {"ignoreNullFields": "false"})
    rows = writes.select(memory.alias("memory"), "seq", "entry_key", F.md5("text").alias("text"), "remove")
    rows = rows.repartition("memory").sortWithinPartitions("memory", "seq", "entry_key", "remove", "text")
    return rows.mapInPandas(lambda batches: _memory(batches, most), "seq long, outcome string")


def _memory(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    memory, held = None, {}
    for df in batches:
        out = []
        for row in df.itertuples(index=False):
            if row.memory != memory:
                memory, held = row.memory, {}
            known = held.get(row.entry_key)
            if row.remove:
                out.append((row.seq, "invalidated" if known is not None else "noop"))
                held.pop(row.entry_key, None)
            elif known == row.text:
                out.append((row.seq, "noop"))
            elif known is None and len(held) >= most:
                out.append((row.seq, "rejected_cap"))
            else:
                out.append((row.seq, "updated" if known is not None else "added"))
                held[row.entry_key] = row.text
        yield pd.DataFrame(out, columns=["seq", "outcome"])


def superseded_assertions(assertions: DataFrame) -> DataFrame:
    """(id, superseded_by): of assertions (id, subject, relation, object, at) each is superseded by the next of its subject and relation with another object; null while it holds."""
    at = W.partitionBy("subject", "relation").orderBy("at", "id")
    rows = assertions.withColumn("_next", F.lead("id").over(at)).withColumn("_object", F.lead("object").over(at))
    return rows.select("id", F.when(F.col("_object") != F.col("object"), F.col("_next")).alias("superseded_by"))


def due_entries(entries: DataFrame, tenants: DataFrame, as_of: Column, default_days: int = 30) -> DataFrame:
    """The entries older than their tenant's days of retention (tenant, days), which pruning removes."""
    return entries.join(tenants, "tenant", "left").where(F.col("at") < as_of - F.make_interval(days=F.coalesce("days", F.lit(default_days)))).drop("days")
