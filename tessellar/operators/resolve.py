"""Links between files: what a text or an import names, resolved against the known paths.

Every resolution is an ordered list of candidate paths, one row each, joined with the known paths on equality; the first
candidate that exists counts (``min_by`` of its place). No join compares prefixes. Inputs are tables with a column
``path``; links have source, target, tier and method. A wrong link costs more than a missing one: what several files
could mean resolves to none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessellar.functions.paths import ancestors, base_name, directory, is_test, joined_path, normal_path
from tessellar.sources.tables import cut

#: Endings tried for a module, in order; endings of notes; most links of a document; most names of a link.
MODULE_ENDINGS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
NOTE_ENDINGS = (".md", ".mdx")
MOST_LINKS = 200
MOST_NAMES = 8
BARREL_DEPTH = 4
_FILE_NAME = r"\.[A-Za-z0-9]{1,10}$"
_ELSEWHERE = r"(?i)^[a-z][a-z0-9+.-]*:"


def first_known(rows: DataFrame, key: list[str], candidates: Column, known: DataFrame) -> DataFrame:
    """(key, target): of each key's candidate paths, in order, the first that is known; keys without one are left out."""
    tried = rows.select(*key, F.posexplode(candidates).alias("_place", "target")).hint("merge")  # Spark takes it for small, as it counts a row for each array
    return tried.join(known.select(F.col("path").alias("target")).distinct(), "target").groupBy(*key).agg(F.min_by("target", "_place").alias("target"))


def unique_owners(known: DataFrame) -> DataFrame:
    """(name, owner): file names that one path has alone."""
    return known.select("path").distinct().groupBy(base_name(F.col("path")).alias("name")).agg(F.min("path").alias("owner"), F.count("*").alias("n")).where("n = 1").drop("n")


def mentions(code: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, line, candidate, method) of inline code that looks like a path and of link targets that point into the repository; anchors and queries are cut off."""
    value = F.trim("value")
    bare = F.substring_index(value, "#", 1)
    inline = code.where((F.length(value) <= 400) & ~value.rlike(r"\s") & ~value.rlike(_ELSEWHERE) & bare.rlike(r"^[\w.@~-][\w./@~+-]*$") & base_name(bare).rlike(_FILE_NAME))
    target = F.trim("target")
    cleaned = F.regexp_replace(F.substring_index(F.substring_index(target, "#", 1), "?", 1), "/+$", "")
    linked = links.where((F.length(target) <= 400) & ~target.startswith("#") & ~target.startswith("//") & ~target.rlike(_ELSEWHERE) & (cleaned != ""))
    return inline.select("doc_id", "line", bare.alias("candidate"), F.lit("path-exists").alias("method")).unionByName(linked.select("doc_id", "line", cleaned.alias("candidate"), F.lit("doc-link").alias("method")))


def doc_links(found: DataFrame, known: DataFrame, most: int = MOST_LINKS) -> DataFrame:
    """(source, target, line, method, tier) of mentions: the path as written, else relative to the document, else the one file of that name.

    One link for each document and target, with the first mention; a document's first 200 targets (a stated limit of the
    operator). Names without an ending are notes. A document never links to itself.
    """
    rows = found.select("doc_id", "line", "candidate", "method").distinct()
    tries = F.when(base_name(F.col("candidate")).rlike(_FILE_NAME), F.array("candidate")).otherwise(F.array(*[F.concat("candidate", F.lit(e)) for e in NOTE_ENDINGS]))
    home = directory(F.col("doc_id"))
    exact = F.flatten(F.transform(tries, lambda c: F.array(normal_path(c), joined_path(home, c))))
    keys = ["doc_id", "candidate"]
    asked = rows.select(*keys).distinct()
    hits = first_known(asked, keys, F.filter(exact, lambda p: p.isNotNull()), known)
    names = asked.join(hits, keys, "left_anti").select(*keys, F.posexplode(F.transform(tries, base_name)).alias("place", "name"))
    owned = names.join(unique_owners(known), "name").groupBy(*keys).agg(F.min_by("owner", "place").alias("target"))
    resolved = hits.withColumn("tier", F.lit("resolved")).unionByName(owned.withColumn("tier", F.lit("reference")))
    links = rows.join(resolved, keys).where("target <> doc_id").withColumn("method", F.when(F.col("tier") == "reference", "basename-owner").otherwise(F.col("method")))
    order = F.struct("line", "candidate", "method")
    first = links.groupBy(F.col("doc_id").alias("source"), "target").agg(F.min(order).alias("o"), F.min_by(F.struct("method", "tier"), order).alias("r"))
    ranked = first.withColumn("_k", F.row_number().over(W.partitionBy("source").orderBy("o", "target")))
    return ranked.where(F.col("_k") <= most).select("source", "target", "o.line", "r.method", "r.tier")


def section_links(declared: DataFrame, cited: DataFrame, noted: DataFrame | None = None) -> DataFrame:
    """(source, token, home, line, via): citations of tokens with a home, of documents and of rationale comments; a home doesn't cite itself.

    The best home of a token has the least rank, then path, then line. Citations of tokens without a home keep a null home.
    """
    home = declared.groupBy("token").agg(F.min_by("doc_id", F.struct("home_rank", "doc_id", "line")).alias("home"))
    every = cited.select(F.col("doc_id").alias("source"), "token", "line", F.lit("document").alias("via"))
    if noted is not None:
        every = every.unionByName(noted.where("adr is not null").select(F.col("path").alias("source"), F.upper("adr").alias("token"), "line", F.lit("rationale").alias("via")))
    first = every.groupBy("source", "token", "via").agg(F.min("line").alias("line"))
    return first.join(home, "token", "left").where(F.coalesce(F.col("home") != F.col("source"), F.lit(True))).select("source", "token", "home", "line", "via")


def _probes(joined: Column) -> Column:
    """Paths that a module may have, in order: as it is, with each ending, with ``.js`` taken for another ending, as a folder's index."""
    bare = F.regexp_replace(joined, r"\.(?:[cm]?js|jsx)$", "")
    ends = [x for e in MODULE_ENDINGS for x in (F.concat(joined, F.lit(e)), F.when(bare != joined, F.concat(bare, F.lit(e))))]
    return F.array_compact(F.array(joined, *ends, *[F.concat(joined, F.lit(f"/index{e}")) for e in MODULE_ENDINGS]))


def script_places(imports: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(path, specifier, rank, tier, method, at): where a script's specifiers may lead, before endings are tried; the least rank comes first.

    Relative ones are joined with the importing directory. Others go by alias rules (priority, scope, prefix, suffix,
    wildcard, target, tier): a rule holds for files below its scope and specifiers between its prefix and suffix, what
    stands between takes the place of ``*`` in the target. Rules are joined on scope and prefix: every directory of the file,
    and every beginning of the specifier of a length that some rule's prefix has, is a row.
    """
    asked = imports.select("path", "specifier").distinct()
    near = asked.where(F.col("specifier").startswith(".")).select("path", "specifier", normal_path(F.concat(directory(F.col("path")), F.lit("/"), F.col("specifier"))).alias("at"))
    out = near.where("at is not null").select("path", "specifier", F.lit(0).alias("rank"), F.lit("resolved").alias("tier"), F.lit("module-resolution").alias("method"), "at")
    if aliases is None:
        return cut(out)
    lengths = sorted(r[0] for r in aliases.select(F.length("prefix")).distinct().collect())  # no more than a path has characters
    far = asked.where(~F.col("specifier").startswith("."))
    scoped = far.withColumn("scope", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths or [0]]), lambda n: n <= F.length("specifier"))
    scoped = scoped.withColumn("prefix", F.explode(F.transform(fitting, lambda n: F.substring(F.col("specifier"), F.lit(1), n))))
    met = scoped.join(aliases, ["scope", "prefix"])
    long = F.length("specifier") >= F.length("prefix") + F.length("suffix")
    fits = F.when(F.col("wildcard"), long & F.endswith("specifier", F.col("suffix"))).otherwise(F.col("prefix") == F.col("specifier"))
    caught = F.when(F.col("wildcard"), F.substring(F.col("specifier"), F.length("prefix") + 1, F.length("specifier") - F.length("prefix") - F.length("suffix"))).otherwise("")
    placed = F.when(F.col("target").contains("*"), F.replace("target", F.lit("*"), caught)).when(caught != "", F.concat("target", F.lit("/"), caught)).otherwise(F.col("target"))
    ruled = met.where(fits).select("path", "specifier", F.col("priority").alias("rank"), "tier", normal_path(placed).alias("at"))
    ruled = ruled.where("at is not null and at <> ''")
    return cut(out.unionByName(ruled.select("path", "specifier", "rank", "tier", F.lit("alias-resolution").alias("method"), "at")))  # else a path is worked out once for each candidate made of it


def script_candidates(imports: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(path, specifier, rank, tier, method, candidates): the paths that a script's specifiers may mean, in order; the least rank comes first."""
    return script_places(imports, aliases).withColumn("candidates", _probes(F.col("at"))).drop("at")


def script_targets(imports: DataFrame, known: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(path, specifier, target, tier, method) of the modules that imports name: of the candidates of the least rank with a known one, the first known.

    Endings are tried once for each place, however many imports lead there.
    """
    keys = ["path", "specifier"]
    places = script_places(imports, aliases)
    hits = places.join(first_known(places.select("at").distinct(), ["at"], _probes(F.col("at")), known), "at")
    best = hits.groupBy(*keys).agg(F.min_by(F.struct("target", "tier", "method"), F.struct("rank", "target")).alias("r"))
    return best.select(*keys, "r.target", "r.tier", "r.method")


def python_candidates(imports: DataFrame, roots: tuple[str, ...] = ("",)) -> DataFrame:
    """(path, specifier, place, candidates): dots go up from the file's directory (place ``dots``); else the file's own longest root (``own``), and every other (``at:`` and the root)."""
    asked = imports.select("path", "specifier").distinct()
    dots, rest = F.length(F.regexp_extract("specifier", r"^(\.*)", 1)), F.regexp_replace("specifier", r"^\.+", "")
    as_path = F.replace(rest, F.lit("."), F.lit("/"))
    above = F.concat(F.reverse(ancestors(F.col("path"))), F.array(F.lit("")))
    base = F.coalesce(F.try_element_at(above, dots), F.lit(""))
    probes = lambda at: F.filter(F.array(F.concat(at, F.lit(".py")), F.concat(at, F.lit("/__init__.py"))), lambda p: ~p.isin(".py", "/__init__.py"))
    own = F.lit(None).cast("string")
    for r in sorted(roots, key=len):
        own = F.when((F.lit(r) == "") | F.col("path").startswith(f"{r}/"), F.lit(r)).otherwise(own)
    near = asked.where(dots > 0).select("path", "specifier", F.lit("dots").alias("place"), probes(joined_path(base, as_path)).alias("candidates"))
    far = asked.where(dots == 0).withColumn("own", own).withColumn("root", F.explode(F.array(*[F.lit(r) for r in roots])))
    placed = F.when(F.col("root").eqNullSafe(F.col("own")), F.lit("own")).otherwise(F.concat(F.lit("at:"), "root"))
    return near.unionByName(far.select("path", "specifier", placed.alias("place"), probes(joined_path(F.col("root"), as_path)).alias("candidates")))


def python_targets(imports: DataFrame, known: DataFrame, roots: tuple[str, ...] = ("",)) -> DataFrame:
    """(path, specifier, target, tier, method): by dots; else in the file's own root, else in the one other root that has the module."""
    keys = ["path", "specifier"]
    hits = first_known(python_candidates(imports, roots), [*keys, "place"], F.col("candidates"), known)
    at_home, away = F.col("place").isin("dots", "own"), F.col("place").startswith("at:")
    sides = hits.groupBy(*keys).agg(F.min(F.when(at_home, F.col("target"))).alias("home"), F.min(F.when(away, F.col("target"))).alias("one"), F.max(F.when(away, F.col("target"))).alias("other"))
    target = F.coalesce("home", F.when(F.col("one") == F.col("other"), F.col("one")))
    return sides.select(*keys, target.alias("target"), F.lit("reference").alias("tier"), F.lit("module-resolution").alias("method")).where("target is not null")


def through_barrels(asked: DataFrame, imports: DataFrame, targets: DataFrame, exports: DataFrame, depth: int = BARREL_DEPTH) -> DataFrame:
    """(barrel, name, owner): the file that gives a name which a barrel gives on; of names that several starred modules give, none.

    Each round moves every open question one barrel further: by the barrel's own list of names, else by all its starred
    modules. A module that exports the name itself, or is reached by list and gives nothing on, is the answer.
    """
    given = imports.where("is_re_export").join(targets.select("path", "specifier", "target"), ["path", "specifier"])
    listed = given.select("path", "target", F.explode("bindings").alias("b")).where("b.symbol is not null").groupBy("path", F.col("b.local").alias("name")).agg(F.min_by(F.struct("target", F.col("b.symbol").alias("inner")), "target").alias("r")).select("path", "name", "r.target", "r.inner")
    starred = given.where(F.array_contains("names", "*")).select("path", "target").distinct()
    listed, starred = cut(listed), cut(starred)
    barrels = cut(listed.select("path").unionByName(starred.select("path")).distinct())
    own = exports.where("kind <> 'export'").select(F.col("path").alias("target"), "name").distinct()
    open_ = asked.select("barrel", "name").distinct().join(barrels.withColumnRenamed("path", "barrel"), "barrel", "left_semi")
    open_ = open_.select("barrel", "name", F.col("barrel").alias("at"), F.col("name").alias("inner"), F.array("barrel").alias("seen"))
    answers = None
    for _ in range(depth):
        by_list = open_.join(listed.select(F.col("path").alias("at"), F.col("name").alias("inner"), "target", F.col("inner").alias("next")), ["at", "inner"])
        by_star = open_.join(listed.select(F.col("path").alias("at"), F.col("name").alias("inner")), ["at", "inner"], "left_anti").join(starred.withColumnRenamed("path", "at"), "at")
        star_own = by_star.withColumnRenamed("inner", "asked").join(own.withColumnRenamed("name", "asked"), ["target", "asked"], "left_semi")
        star_on = by_star.withColumnRenamed("inner", "asked").join(own.withColumnRenamed("name", "asked"), ["target", "asked"], "left_anti")
        ends = by_list.join(barrels.withColumnRenamed("path", "target"), "target", "left_anti").select("barrel", "name", "target").unionByName(star_own.select("barrel", "name", "target"))
        ends = cut(ends.distinct())
        answers = ends if answers is None else answers.unionByName(ends)
        moved = by_list.select("barrel", "name", "target", F.col("next").alias("inner"), "seen").unionByName(star_on.select("barrel", "name", "target", F.col("asked").alias("inner"), "seen"))
        open_ = cut(moved.where(~F.array_contains("seen", F.col("target"))).join(barrels.withColumnRenamed("path", "target"), "target", "left_semi").select("barrel", "name", F.col("target").alias("at"), "inner", F.concat("seen", F.array("target")).alias("seen")).distinct())
        if open_.isEmpty():
            break
    return answers.groupBy("barrel", "name").agg(F.min("target").alias("owner"), F.max("target").alias("other")).where("owner = other").drop("other")


def name_matches(called: DataFrame, exports: DataFrame) -> DataFrame:
    """(source, target, name): bare calls of a name that exactly one other file exports.

    Exporters are summed by name before they meet a caller: the least, the greatest and how many. A caller of a name with one takes it unless that is itself; with two, it must be one of them and takes the other. So the
    work is callers plus exporters, however often a name is exported and called.
    """
    owners = exports.select("path", "name").distinct().groupBy("name").agg(F.min("path").alias("first"), F.max("path").alias("last"), F.count("*").alias("n")).where("n <= 2")
    rows = called.select("path", "name").distinct().join(owners, "name")
    one = F.col("first") == F.col("last")
    target = F.when(one & (F.col("path") != F.col("first")), F.col("first")).when(~one & (F.col("path") == F.col("first")), F.col("last")).when(~one & (F.col("path") == F.col("last")), F.col("first"))
    return rows.select(F.col("path").alias("source"), target.alias("target"), "name").where("target is not null")


def _seen(imports: DataFrame, targets: DataFrame) -> DataFrame:
    return imports.join(targets, ["path", "specifier"]).select("path", "target", "tier", "method", F.when(F.size("names") > 0, F.col("names")).otherwise(F.array(F.lit("*"))).alias("names"), "bindings")


def import_links(imports: DataFrame, targets: DataFrame, owners: DataFrame) -> DataFrame:
    """(kind, source, target, tier, method, name): imports and tests, a row for each name.

    Names that a barrel gives on belong to their owner (barrel, name, owner); the rest to the module itself. An import out
    of a test makes a tests link to what is no test.
    """
    each = _seen(imports, targets).select("path", "target", "tier", "method", F.explode("names").alias("name"))
    owned = each.join(owners.select(F.col("barrel").alias("target"), "name", "owner"), ["target", "name"], "left")
    barrel = owned.where("owner is not null and owner <> path").select(F.lit("imports").alias("kind"), F.col("path").alias("source"), F.col("owner").alias("target"), F.lit("resolved").alias("tier"), F.lit("barrel-resolution").alias("method"), "name")
    plain = owned.where("owner is null or owner = path").select(F.lit("imports").alias("kind"), F.col("path").alias("source"), "target", "tier", "method", "name")
    every = barrel.unionByName(plain).where("source <> target")
    tests = every.where(is_test(F.col("source")) & ~is_test(F.col("target"))).select(F.lit("tests").alias("kind"), "source", "target", F.lit("reference").alias("tier"), F.lit("test-import").alias("method"), "name")
    return every.unionByName(tests)


def call_links(imports: DataFrame, targets: DataFrame, owners: DataFrame, called: DataFrame, locals_: DataFrame, exports: DataFrame) -> DataFrame:
    """(kind, source, target, tier, method, name): calls. Those of imported names are resolved, bare calls of one exporter's name a reference."""
    bound = bound_names(_seen(imports, targets), owners)
    met = called.join(bound, ["path", "binding"]).select(F.lit("calls").alias("kind"), F.col("path").alias("source"), "target", F.lit("resolved").alias("tier"), F.lit("import-binding").alias("method"), F.coalesce("member", "symbol").alias("name"))
    bare = called.where("member is null").join(bound.select("path", "binding").distinct(), ["path", "binding"], "left_anti").select("path", F.col("binding").alias("name")).join(locals_, ["path", "name"], "left_anti")
    guessed = name_matches(bare, exports).select(F.lit("calls").alias("kind"), "source", "target", F.lit("reference").alias("tier"), F.lit("name-match").alias("method"), "name")
    return met.where("source <> target").unionByName(guessed)


def one_link(links: DataFrame) -> DataFrame:
    """(kind, source, target, tier, method, names): of several ways to one target the resolved one counts; up to eight names are kept, in order."""
    best = F.struct((F.col("tier") != "resolved").alias("weak"), "method")
    named = F.slice(F.array_sort(F.collect_set(F.when(F.col("name") != "*", F.col("name")))), 1, MOST_NAMES)
    return links.groupBy("kind", "source", "target").agg(F.min_by(F.struct("tier", "method"), best).alias("r"), named.alias("names")).select("kind", "source", "target", "r.tier", "r.method", "names")


def code_links(imports: DataFrame, targets: DataFrame, owners: DataFrame, called: DataFrame, locals_: DataFrame, exports: DataFrame) -> DataFrame:
    """(kind, source, target, tier, method, names): ``import_links`` and ``call_links``, one for each kind, source and target."""
    return one_link(import_links(imports, targets, owners).unionByName(call_links(imports, targets, owners, called, locals_, exports)))


def bound_names(seen: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, binding, symbol, target): what local names of imports stand for."""
    rows = seen.select("path", F.col("target").alias("module"), F.explode("bindings").alias("b")).select("path", "module", F.col("b.local").alias("binding"), F.col("b.symbol").alias("symbol"))
    met = rows.join(owners.select(F.col("barrel").alias("module"), F.col("name").alias("symbol"), "owner"), ["module", "symbol"], "left")
    return met.groupBy("path", "binding").agg(F.min_by(F.struct("symbol", F.coalesce("owner", "module").alias("target")), F.coalesce("owner", "module")).alias("r")).select("path", "binding", "r.symbol", "r.target")


def heritage_links(bases: DataFrame, bound: DataFrame, exports: DataFrame) -> DataFrame:
    """(path, name, kind, target, base): extends links of classes to the file and name of their base: an imported name, else one of the own file, else the one exporter's."""
    asked = bases.select("path", "name", "kind", "binding", F.coalesce("member", "binding").alias("base"), "member")
    imported = asked.join(bound, ["path", "binding"]).select("path", "name", "kind", "target", F.coalesce("member", F.when(F.col("symbol") != "default", F.col("symbol")), "base").alias("base"))
    rest = asked.join(bound.select("path", "binding").distinct(), ["path", "binding"], "left_anti").where("member is null")
    own = rest.join(exports.select("path", F.col("name").alias("base")).distinct(), ["path", "base"], "left_semi").select("path", "name", "kind", F.col("path").alias("target"), "base")
    other = name_matches(rest.join(own.select("path", "base"), ["path", "base"], "left_anti").select("path", F.col("base").alias("name")), exports)
    guessed = rest.join(other.select(F.col("source").alias("path"), "target", F.col("name").alias("base")), ["path", "base"]).select("path", "name", "kind", "target", "base")
    return imported.unionByName(own).unionByName(guessed).distinct()


def schema_links(objects: DataFrame, links: DataFrame, literals: DataFrame) -> DataFrame:
    """(path, line, kind, source, target): statements on objects that some file declares, and the first query of each file for each such object."""
    owned = objects.select(F.col("name").alias("target")).distinct()
    queries = literals.withColumnRenamed("name", "target").groupBy("path", "target").agg(F.min("line").alias("line")).select("path", "line", F.lit("queries").alias("kind"), F.lit(None).cast("string").alias("source"), "target")
    return links.select("path", "line", "kind", "source", "target").unionByName(queries).join(owned, "target", "left_semi").select("path", "line", "kind", "source", "target")


def declaring_files(objects: DataFrame) -> DataFrame:
    """(name, path, line, kind) of the newest file that declares each object: the greatest path, and there the first line."""
    order = F.struct("path", -F.col("line"))
    return objects.groupBy("name").agg(F.max_by(F.struct("path", "line", "kind"), order).alias("r")).select("name", "r.*")


def route_handlers(files: DataFrame, declared: DataFrame) -> DataFrame:
    """(url, method, path, entry): which file serves which url: by its place (pages and route files), and by decorators; a layout serves every page below it."""
    from tessellar.functions.paths import route_entry, route_url

    served = files.select("path", route_entry(F.col("path")).alias("entry"), route_url(F.col("path")).alias("url")).where("entry is not null")
    placed = served.where("entry <> 'layout'").select("url", F.lit("ANY").alias("method"), "path", "entry")
    layouts = served.where("entry = 'layout'").select(directory(F.col("path")).alias("dir"), F.col("path").alias("layout"))
    below = served.where("entry = 'page'").select("url", F.explode(ancestors(F.col("path"))).alias("dir")).join(layouts, "dir")
    covered = below.select("url", F.lit("ANY").alias("method"), F.col("layout").alias("path"), F.lit("layout").alias("entry"))
    return placed.unionByName(covered).unionByName(declared.select("url", "method", "path", F.lit("decorator").alias("entry"))).distinct()


def main_handlers(handlers: DataFrame) -> DataFrame:
    """(url, path): of the files that serve a url the one with the longest path, the least of equally long ones."""
    return handlers.groupBy("url").agg(F.min_by("path", F.struct(-F.length("path"), "path")).alias("path"))


def reported_paths(reported: DataFrame, known: DataFrame) -> DataFrame:
    """(reported, path): the longest end of a reported path that is known, null where none is."""
    parts = F.filter(F.split(F.replace("reported", F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", "."))
    ends = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))
    rows = reported.select("reported").distinct()
    return rows.join(first_known(rows, ["reported"], ends, known).withColumnRenamed("target", "path"), "reported", "left")


def symbol_owners(symbols: DataFrame) -> DataFrame:
    """(name, path): the one file that declares a name; of names that none declares, the one that gives it on. Several: none."""
    declared = F.col("kind") != "export"
    pick = lambda cond, f: f(F.when(cond, F.col("path")))
    sides = symbols.groupBy("name").agg(pick(declared, F.min).alias("d0"), pick(declared, F.max).alias("d1"), pick(~declared, F.min).alias("r0"), pick(~declared, F.max).alias("r1"))
    path = F.when(F.col("d0").isNotNull(), F.when(F.col("d0") == F.col("d1"), F.col("d0"))).when(F.col("r0") == F.col("r1"), F.col("r0"))
    return sides.select("name", path.alias("path")).where("path is not null")


def containment(files: DataFrame) -> DataFrame:
    """(source, target): every directory and what lies directly in it, files and directories; the root is no node."""
    dirs = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    every = files.select("path").distinct().unionByName(dirs)
    return every.select(directory(F.col("path")).alias("source"), F.col("path").alias("target")).where("source <> ''").distinct()


def package_directories(files: DataFrame, manifests: tuple[str, ...] = ("package.json", "pyproject.toml")) -> DataFrame:
    """(path, is_package): directories, and whether one holds a manifest."""
    dirs = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    with_one = files.where(base_name(F.col("path")).isin(*manifests)).select(directory(F.col("path")).alias("path"), F.lit(True).alias("is_package")).distinct()
    return dirs.join(with_one, "path", "left").select("path", F.coalesce("is_package", F.lit(False)).alias("is_package"))


def kept_edges(edges: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with known relations, and the others counted by relation."""
    known = vocabulary.select("relation").distinct()
    return edges.join(F.broadcast(known), "relation", "left_semi"), edges.join(F.broadcast(known), "relation", "left_anti").groupBy("relation").agg(F.count("*").alias("omitted"))


def symbol_edges(symbols: DataFrame, bases: DataFrame) -> DataFrame:
    """(source, target, relation): files declare their symbols (path, kind, name), classes extend the symbols of their bases (path, name, kind, target, base); symbols are known by their keys."""
    from tessellar.functions.words import symbol_key

    key = lambda p, k, n: symbol_key(F.col(p), F.lit(None).cast("string"), F.col(k), F.col(n))
    own = symbols.where("kind <> 'export'").select("path", "kind", "name", key("path", "kind", "name").alias("key")).distinct()
    declares = own.select(F.col("path").alias("source"), F.col("key").alias("target"), F.lit("declares").alias("relation"))
    met = bases.join(own.select("path", "kind", "name", F.col("key").alias("source")), ["path", "kind", "name"]).select("source", F.col("target").alias("path"), F.col("base").alias("name")).join(own.select("path", "name", F.col("key").alias("target")), ["path", "name"])
    return declares.unionByName(met.select("source", "target", F.lit("extends").alias("relation")).distinct())


def schema_edges(links: DataFrame, artifacts: DataFrame, objects: DataFrame) -> DataFrame:
    """(source, target, relation) of schema links (path, kind, source, target) as ids: from the object in hand where there is one, else from the file; both ends must be known (id, path) and (id, name)."""
    named = objects.select(F.col("name").alias("source"), F.col("id").alias("_object"))
    files = artifacts.select("path", F.col("id").alias("_file"))
    ends = objects.select(F.col("name").alias("target"), F.col("id").alias("_target"))
    rows = links.join(named, "source", "left").join(files, "path", "left").join(ends, "target")
    source = F.when(F.col("source").isNull(), F.col("_file")).otherwise(F.col("_object"))
    return rows.select(source.alias("source"), F.col("_target").alias("target"), F.col("kind").alias("relation")).where("source is not null").distinct()


def without_children(children: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows of files (path) that are still there: a semi-join names what goes with removed files, this is the rest."""
    return children.join(removed.select("path").distinct(), "path", "left_anti")


def evidence_links(evidence: DataFrame, known: DataFrame, needs: DataFrame) -> DataFrame:
    """(test_file, path, requirement): test evidence (test_file, requirement_ids) led to the known file that its reported path means, and to each requirement (id) that its names state; null where nothing is known."""
    files = reported_paths(evidence.select(F.col("test_file").alias("reported")), known).withColumnRenamed("reported", "test_file")
    stated = evidence.select("test_file", F.explode("requirement_ids").alias("id")).join(needs.where("id is not null").select("id").distinct(), "id", "left_semi")
    return evidence.select("test_file").distinct().join(files, "test_file", "left").join(stated.withColumnRenamed("id", "requirement"), "test_file", "left").select("test_file", "path", "requirement")
