"""Requirements of documents, and the seven rules that hold documents and code against each other.

Files are rows (path, classification, text). Findings are rows (type, path, line, start_byte, end_byte, severity,
confidence, target, detail). All are inferred, which caps severity at medium. Rules meet their counterparts by joins on
equality; of findings on one span the first rule's stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.functions.paths import ancestors, base_name, directory, is_test, joined_path
from tessellar.functions.words import convention, requirement_id, symbols_in
from tessellar.operators.resolve import symbol_owners
from tessellar.sources import markdown
from tessellar.sources.markdown import ACCEPTANCE, DECISION, requirement_ids
from tessellar.sources.tables import cut, written

#: Verbs of a claim; a source reference; files that need no test of their own; severities from worst on.
CLAIM = r"(?i)\b(?:supports?|provides?|implements?|guarantees?|ensures?)\b"
SOURCE_REFERENCE = r"^(.+\.(?:[cm]?[jt]sx?))(?:#([A-Za-z_$][\w$]*))?$"
NO_UNIT = (
    r"(?i)\.d\.[cm]?ts$",
    r"(?i)(?:^|/)(?:index\.[cm]?[jt]sx?|__init__\.py)$",
    r"(?i)(?:^|/)(?:[^/]*\.config\.[cm]?[jt]sx?|\.?[a-z]+rc\.[cm]?[jt]s|conftest\.py|setup\.py)$",
    r"(?i)(?:^|/)(?:__generated__|generated|dist|build|out|coverage|vendor|node_modules)(?:/|$)|\.(?:generated|gen|min)\.[cm]?[jt]sx?$|_pb2?\.py$|\.pb\.go$",
)
RULE_TEST = r"(?i)(^|/)(?:tests?|__tests__)(/|$)|\.(?:spec|test)\.[cm]?[jt]sx?$"
SEVERITIES = ("critical", "high", "medium", "low", "info")
INSTRUCTIONS = ("agents", "claude", "cursor_rule")
FINDING = ("type", "path", "line", "start_byte", "end_byte", "severity", "confidence", "target", "detail")


def capped(severity: Column, grade: Column) -> Column:
    """What is only inferred is medium at most."""
    return F.when((grade == "inferred") & severity.isin("critical", "high"), "medium").otherwise(severity)


def severity_rank(severity: Column) -> Column:
    """1 for the worst; unknown ones come last."""
    at = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    return F.when(at > 0, at).otherwise(len(SEVERITIES) + 1)


def fingerprint(kind: Column, path: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", kind, path, line.cast("string"), column.cast("string"))


def marked_lines(files: DataFrame) -> DataFrame:
    """The lines of documents (``markdown.marked``) with the class of each, made once for all readers; a table of lines stays."""
    if "end_of_block" in files.columns:
        return files
    # the class goes with the id through the reader, as no other columns do
    pair = F.struct(F.col("path"), F.col("classification"))
    rows = markdown.marked(files.select(pair.alias("doc_id"), "text"))
    return rows.select(F.col("doc_id.path").alias("doc_id"), *[c for c in rows.columns if c != "doc_id"], F.col("doc_id.classification").alias("classification"))


def requirements(files: DataFrame) -> DataFrame:
    """(path, origin, line, last_line, start_byte, end_byte, fulfilled, id, statement) of each document.

    Tasks, acceptance sections, decision sections of records, and statements with MUST or SHOULD that none of those
    contains; one for each span, in that order. Statements are contained by lines: an anti-join within the document.
    """
    docs = marked_lines(files)
    tasks = markdown.todos(docs).select("doc_id", F.lit("task").alias("origin"), "line", F.col("line").alias("last_line"), "start_byte", "end_byte", (F.col("status") == "done").alias("fulfilled"), "statement")
    shape = lambda df, origin: df.select("doc_id", F.lit(origin).alias("origin"), "line", "last_line", "start_byte", "end_byte", F.lit(None).cast("boolean").alias("fulfilled"), F.col("text").alias("statement"))
    accepted = shape(markdown.section_texts(docs, ACCEPTANCE), "acceptance")
    decided = shape(markdown.section_texts(docs.where("classification = 'adr'"), DECISION), "adr-decision")
    held = cut(tasks.unionByName(accepted).unionByName(decided))
    said = shape(markdown.statements(docs).withColumn("last_line", F.col("line")), "normative")
    inside = said.alias("s").join(held.select("doc_id", F.col("line").alias("from"), F.col("last_line").alias("to")).alias("h"), (F.col("s.doc_id") == F.col("h.doc_id")) & F.col("s.line").between(F.col("h.from"), F.col("h.to")), "left_anti")
    every = held.unionByName(inside)
    order = F.when(F.col("origin") == "task", 1).when(F.col("origin") == "acceptance", 2).when(F.col("origin") == "adr-decision", 3).otherwise(4)
    one = every.groupBy("doc_id", "start_byte", "end_byte", "statement").agg(F.min_by(F.struct("origin", "line", "last_line", "fulfilled"), order).alias("r"))
    return one.select(F.col("doc_id").alias("path"), "r.*", "start_byte", "end_byte", requirement_id(F.col("statement")).alias("id"), "statement")


def implementation_links(needs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, identity, line, symbol, target): the first symbol that a statement names and one file alone owns; one link for each document, identity and file."""
    named = needs.select("path", "line", "start_byte", "statement", F.coalesce("id", "statement").alias("identity"), F.posexplode(symbols_in(F.col("statement"))).alias("place", "name"))
    owned = named.join(symbol_owners(symbols).withColumnRenamed("path", "target"), "name")
    first = owned.groupBy("path", "line", "start_byte", "statement", "identity").agg(F.min_by(F.struct(F.col("name").alias("symbol"), "target"), "place").alias("r"))
    return first.groupBy("path", "identity", "r.target").agg(F.min(F.struct("line", "r.symbol")).alias("x")).select("path", "identity", "x.line", "x.symbol", "target")


def _targets(needs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds target: the file of the first symbol that a statement names and one file alone owns."""
    named = needs.select("path", "start_byte", "end_byte", F.posexplode(symbols_in(F.col("statement"))).alias("place", "name"))
    first = named.join(symbol_owners(symbols).withColumnRenamed("path", "target"), "name").groupBy("path", "start_byte", "end_byte").agg(F.min_by("target", "place").alias("target"))
    return needs.join(first, ["path", "start_byte", "end_byte"], "left")


def _finding(rows: DataFrame, kind: str, severity: str, confidence: Column, detail: Column, target: Column | None = None) -> DataFrame:
    given = {"type": F.lit(kind), "severity": capped(F.lit(severity), F.lit("inferred")), "confidence": confidence.cast("double"), "target": F.lit(None).cast("string") if target is None else target, "detail": detail}
    return rows.select(*[given[c].alias(c) if c in given else F.col(c) for c in FINDING])


def missing_implementation(needs: DataFrame, specs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Open tasks of specifications that name no symbol, or one that no file exports."""
    open_ = needs.join(specs, "path", "left_semi").where("origin = 'task' and not fulfilled")
    known = symbols.select("name").distinct()
    names = open_.select("path", "start_byte", "end_byte", F.explode(symbols_in(F.col("statement"))).alias("name"))
    lacking = names.join(known, "name", "left_anti").select("path", "start_byte", "end_byte").distinct()
    keys = ["path", "start_byte", "end_byte"]
    n = F.size(symbols_in(F.col("statement")))
    without = open_.where(n == 0).unionByName(open_.where(n > 0).join(lacking, keys, "left_semi"))
    rows = _targets(without, symbols)
    return _finding(rows, "missing-implementation", "high", F.when(n > 0, 0.95).otherwise(0.75), F.coalesce("id", F.lit("Requirement")), F.col("target"))


def tested_requirements(files: DataFrame) -> DataFrame:
    """(id): requirement ids that test files name."""
    return files.where(F.col("path").rlike(RULE_TEST)).select(F.explode(requirement_ids(F.col("text"))).alias("id")).distinct()


def missing_test(needs: DataFrame, specs: DataFrame, tested: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tasks of specifications that are done and have an id, which no test names."""
    done = needs.join(specs, "path", "left_semi").where("origin = 'task' and fulfilled and id is not null").join(tested, "id", "left_anti")
    return _finding(_targets(done, symbols), "missing-test", "medium", F.lit(0.9), F.col("id"), F.col("target"))


def source_references(docs: DataFrame, known: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, start_byte, end_byte, reference, symbol, live, file_known) of inline code, in documents or their lines, that names a source file: as written, else relative to the document."""
    refs = markdown.code_references(marked_lines(docs)).where(F.col("value").rlike(SOURCE_REFERENCE))
    refs = refs.select(F.col("doc_id").alias("path"), "line", "start_byte", "end_byte", F.regexp_extract("value", SOURCE_REFERENCE, 1).alias("written"), F.nullif(F.regexp_extract("value", SOURCE_REFERENCE, 2), F.lit("")).alias("symbol"))
    paths = known.select(F.col("path").alias("written"), F.lit(True).alias("as_written")).distinct()
    refs = refs.join(paths, "written", "left").withColumn("reference", F.when(F.col("as_written"), F.col("written")).otherwise(joined_path(directory(F.col("path")), F.col("written"))))
    there = known.select(F.col("path").alias("reference"), F.lit(True).alias("there")).distinct()
    has = symbols.select(F.col("path").alias("reference"), F.col("name").alias("symbol"), F.lit(True).alias("has")).distinct()
    refs = refs.join(there, "reference", "left").join(has, ["reference", "symbol"], "left")
    live = F.coalesce("there", F.lit(False)) & (F.col("symbol").isNull() | F.coalesce("has", F.lit(False)))
    return refs.select("path", "line", "start_byte", "end_byte", "reference", "written", "symbol", live.alias("live"), F.coalesce("there", F.lit(False)).alias("file_known"))


def stale_documents(references: DataFrame, classes: DataFrame) -> DataFrame:
    """Records and specifications that name a source file or symbol which isn't there."""
    rows = references.where("not live").join(classes.where("classification in ('adr', 'spec')").select("path"), "path", "left_semi")
    return _finding(rows, "stale-doc", "medium", F.lit(0.98), F.coalesce("symbol", "reference", "written"), F.when(F.col("file_known"), F.col("reference")))


def contradictions(docs: DataFrame) -> DataFrame:
    """Instructions that state another key convention than one whose scope overlaps; the finding is on the one with the shorter path.

    A scope overlaps those above and below it. Each statement is met with one partner for each scope and convention (the
    greatest by length of path, path and line), not with every one: statements are gathered by scope, and once more under
    every scope above theirs.
    """
    said = markdown.statements(marked_lines(docs.where(F.col("classification").isin(*INSTRUCTIONS)))).select(F.col("doc_id").alias("path"), "line", "start_byte", "end_byte", "n", convention(F.col("text")).alias("convention"), directory(F.col("doc_id")).alias("scope")).where("convention is not null")
    said = cut(said.withColumn("rank", F.struct(F.length("path").alias("size"), "path", "line", "n")))
    above = F.concat(F.array(F.lit("")), ancestors(F.col("path")))
    below = said.select(F.explode(above).alias("scope"), "convention", "rank").groupBy("scope", F.col("convention").alias("other")).agg(F.max("rank").alias("partner"))
    exact = said.groupBy("scope", F.col("convention").alias("other")).agg(F.max("rank").alias("partner"))
    met = said.join(below, "scope").unionByName(said.withColumn("scope", F.explode(above)).join(exact, "scope"))
    rows = met.where("convention <> other and partner > rank").groupBy("path", "line", "start_byte", "end_byte").agg(F.max("partner").alias("partner"))
    return _finding(rows, "contradicting-instructions", "medium", F.lit(0.96), F.concat_ws(":", "partner.path", F.col("partner.line").cast("string")))


def orphan_documents(docs: DataFrame, references: DataFrame) -> DataFrame:
    """Records with a decision and no live source reference; on the decision's first statement, else on the decision."""
    lines = marked_lines(docs.where("classification = 'adr'"))
    docs = lines.join(references.where("live").select(F.col("path").alias("doc_id")).distinct(), "doc_id", "left_anti")
    decided = markdown.section_texts(docs, DECISION).groupBy("doc_id").agg(F.min(F.struct("line", "last_line", "start_byte", "end_byte")).alias("d"))
    said = markdown.statements(docs).join(decided, "doc_id").where("line between d.line and d.last_line").groupBy("doc_id").agg(F.min(F.struct("line", "n", "start_byte", "end_byte")).alias("s"))
    rows = decided.join(said, "doc_id", "left").select(F.col("doc_id").alias("path"), F.coalesce("s.line", "d.line").alias("line"), F.coalesce("s.start_byte", "d.start_byte").alias("start_byte"), F.coalesce("s.end_byte", "d.end_byte").alias("end_byte"))
    return _finding(rows, "orphan-doc", "low", F.lit(0.85), F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", ""))


def unproven_claims(docs: DataFrame, needs: DataFrame, stale: DataFrame) -> DataFrame:
    """Paragraphs of specifications that claim a capability, are no part of a requirement and begin on no stale line."""
    docs = marked_lines(docs.where("classification = 'spec'"))
    said = markdown.paragraphs(docs).where(F.col("text").rlike(CLAIM)).select(F.col("doc_id").alias("path"), "line", "last_line")
    held = needs.select("path", F.col("line").alias("from"), F.col("last_line").alias("to"))
    free = said.alias("p").join(held.alias("r"), (F.col("p.path") == F.col("r.path")) & (F.col("r.from") <= F.col("p.line")) & (F.col("r.to") >= F.col("p.last_line")), "left_anti")
    free = free.join(stale.select("path", "line").distinct(), ["path", "line"], "left_anti")
    first = markdown.lines(docs).select(F.col("doc_id").alias("path"), "line", "start_byte", "end_byte")
    return _finding(free.join(first, ["path", "line"]), "unproven-claim", "medium", F.lit(0.8), F.lit("claim"))


def untested_code(files: DataFrame, symbols: DataFrame, tested: DataFrame) -> DataFrame:
    """Code that exports something, that no test imports (``tested``: path) and no test is named after; entry points, declarations, settings and generated files need none."""
    stem = lambda p: F.lower(F.substring_index(base_name(p), ".", 1))
    names = files.where(F.col("path").rlike(RULE_TEST)).select(F.regexp_replace(F.regexp_replace(stem(F.col("path")), "^test_", ""), "_test$", "").alias("stem")).where("stem <> ''").distinct()
    code = files.where((F.col("classification") == "code_metadata") & ~F.col("path").rlike(RULE_TEST)).select("path")
    for p in NO_UNIT:
        code = code.where(~F.col("path").rlike(p))
    first = symbols.groupBy("path").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    rows = code.join(first, "path").join(tested.select("path").distinct(), "path", "left_anti").withColumn("stem", stem(F.col("path"))).join(names, "stem", "left_anti")
    rows = rows.select("path", "line", F.lit(0).cast("long").alias("start_byte"), F.lit(0).cast("long").alias("end_byte"), "n")
    return _finding(rows, "untested-code", "low", F.lit(0.6), F.concat(F.col("n").cast("string"), F.lit(" exported")), F.col("path"))


def first_rule_wins(found: list[DataFrame]) -> DataFrame:
    """Findings of rules in their order, with rank: of those on one span the first rule's first stays."""
    every = reduce(DataFrame.unionByName, [f.withColumn("rule", F.lit(k)) for k, f in enumerate(found)])
    order = F.struct("rule", "line", F.coalesce("target", F.lit("")).alias("t"), "detail")
    best = every.groupBy("path", "start_byte", "end_byte").agg(F.min_by(F.struct(*[c for c in FINDING if c not in ("path", "start_byte", "end_byte")]), order).alias("r"))
    return best.select("r.type", "path", "r.line", "start_byte", "end_byte", *[f"r.{c}" for c in ("severity", "confidence", "target", "detail")])


def prose(files: DataFrame) -> DataFrame:
    """The lines of the documents that rules read, made once for all of them."""
    return written(marked_lines(files.where(F.col("classification").isin("adr", "agents", "claude", "cursor_rule", "skill", "spec", "todo_progress"))))


def analyze(files: DataFrame, symbols: DataFrame, tested: DataFrame, docs: DataFrame | None = None, needs: DataFrame | None = None) -> DataFrame:
    """All findings of (path, classification, text), (path, line, kind, name) and (path) of tested files; with their ``prose`` and requirements where these are made already."""
    docs = prose(files) if docs is None else docs
    needs = written(requirements(docs)) if needs is None else needs
    specs = files.where("classification = 'spec'").select("path")
    references = cut(source_references(docs.where("classification in ('adr', 'spec')"), files.select("path"), symbols))
    stale = stale_documents(references, files)
    return first_rule_wins([
        missing_implementation(needs, specs, symbols),
        missing_test(needs, specs, tested_requirements(files), symbols),
        stale,
        contradictions(docs),
        orphan_documents(docs, references),
        unproven_claims(docs, needs, stale),
        untested_code(files, symbols, tested),
    ])


def requirement_coverage(needs: DataFrame, links: DataFrame, tested: DataFrame) -> DataFrame:
    """(requirements, implemented, tested) over all requirements."""
    own = needs.select(F.coalesce("id", "statement").alias("identity"), "path", "id").distinct()
    has = own.join(links.select("path", "identity", F.lit(1).alias("i")).distinct(), ["path", "identity"], "left").join(tested.select("id", F.lit(1).alias("t")).distinct(), "id", "left")
    return has.agg(F.count("*").alias("requirements"), F.count("i").alias("implemented"), F.count("t").alias("tested"))


def reconcile_requirements(before: DataFrame, needs: DataFrame) -> DataFrame:
    """(path, identity, state): what known requirements (path, identity, status) become: kept, added, superseded where they are found no more, revived if they were superseded."""
    now = needs.select("path", F.coalesce("id", "statement").alias("identity"), F.lit(True).alias("found")).distinct()
    joined = before.join(now, ["path", "identity"], "full_outer")
    return joined.select("path", "identity", F.when(F.col("found").isNull(), "superseded").when(F.col("status").isNull(), "added").when(F.col("status") == "superseded", "revived").otherwise("kept").alias("state"))


def receipt_chain(receipts: DataFrame) -> DataFrame:
    """(repository, created_at, digest, previous, continuous): whether each receipt names the one before it; the first names none."""
    before = F.lag("digest").over(W.partitionBy("repository").orderBy("created_at", "digest"))
    return receipts.withColumn("continuous", F.col("previous").eqNullSafe(before))


def dismissed(findings: DataFrame, dismissals: DataFrame) -> DataFrame:
    """(id, status): findings after dismissals (id, at, reason): open ones become dismissed, resolved ones stay, all with a reason given."""
    last = dismissals.where("trim(coalesce(reason, '')) <> ''").groupBy("id").agg(F.max("at").alias("dismissed_at"))
    return findings.join(last, "id", "left").select("id", F.when((F.col("status") == "open") & F.col("dismissed_at").isNotNull(), "dismissed").otherwise(F.col("status")).alias("status"))
