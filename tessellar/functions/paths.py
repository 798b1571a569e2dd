"""Column functions on repository paths: normal form, classes, facets, routes, globs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories and files that no scan carries, and directories of fixtures.
IGNORED_DIRECTORIES = (".git", ".next", ".turbo", "__pycache__", ".venv", "build", "coverage", "dist", "node_modules", "out", "output", "playwright-report", "test-results", "venv", "vendor")
IGNORED_FILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "poetry.lock", "uv.lock", "cargo.lock", "composer.lock", "gemfile.lock")
IGNORED_PATHS = (".claude/worktrees",)
FIXTURE_DIRECTORIES = ("fixtures", "__fixtures__", "testdata")
#: Extensions by class, and names of configuration files.
CODE = (".cjs", ".cts", ".js", ".jsx", ".mjs", ".mts", ".ts", ".tsx", ".go", ".py")
DOCS = (".md", ".mdx", ".rst", ".txt")
SCHEMAS = (".sql", ".prisma", ".graphql", ".gql")
STYLES = (".css", ".scss", ".less", ".sass")
CONFIGS = (".toml", ".yaml", ".yml")
CONFIG_NAMES = (".env.example", ".nvmrc", "dockerfile", "package.json", "pyproject.toml", "requirements.txt")
#: Patterns of names.
TEST_PATH = r"(?:^|/)(?:__tests__|tests?)(?:/|$)|\.(?:spec|test)\.[cm]?[jt]sx?$|(?:^|/)test_[^/]+\.py$|_test\.(?:py|go)$"
CONFIG_PATTERN = r"^(?:tsconfig[\w.-]*\.json|jsconfig[\w.-]*\.json|[\w.-]*\.config\.[cm]?[jt]s|dockerfile(?:\.[\w-]+)?)$"
HANDOFF_PATTERN = r"^(?:\d[\w.-]*[._-])?(session[-_](state|notes?)|current[-_]task|handoff([._-].*)?)\.(md|mdx)$"
TODO_PATTERN = r"^(todo|todos|tasks?|plan|plans|backlog|progress|status|roadmap)([._-].*)?\.(md|mdx)$"
SPEC_PATTERN = r"^(spec|prd|requirements?)([._-].*)?\.(md|mdx)$"
ISSUE_PATTERN = r"(?:^|/)\.beads/[^/]+\.jsonl$"
APP_ROUTE = r"(?:^|/)app/(.*?)(?:^|/)?(page|layout|route)\.[cm]?[jt]sx?$"
PAGES_ROUTE = r"(?:^|/)pages/(.+)\.[cm]?[jt]sx?$"
ACTION_FILE = r"(?:^|/)actions?/|(?:^|/)[\w.-]*actions?\.[cm]?[jt]sx?$"
#: Leading directories of each domain, in the order in which domains are tried.
DOMAINS = {
    "database": ("db/", "database/", "drizzle/", "migrations/", "prisma/", "supabase/"),
    "frontend": ("apps/web/", "client/", "frontend/", "src/app/", "src/pages/", "ui/", "web/", "www/"),
    "backend": ("api/", "apps/", "backend/", "cmd/", "packages/", "server/", "services/", "srv/", "worker/"),
    "shared": ("docs/", "internal/", "lib/", "spec/", "specs/", "src/", "test/", "tests/"),
}
#: Classes of prose, and the kind that each class is stored as where that differs.
PROSE = ("adr", "agents", "claude", "cursor_rule", "skill", "spec", "todo_progress")
DOC_CLASSES = (*PROSE, "doc")
KINDS = {"todo_progress": "todo", "agents": "instruction", "claude": "instruction", "cursor_rule": "instruction", "skill": "instruction"}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """What stands before the last slash; empty for a name without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """The directories that hold the path, outermost first; none for a name without a slash."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: i > 0), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def normal_path(path: Column) -> Column:
    """Without empty and dot segments, each ``..`` taking one back; null where that leads out of the repository."""
    start = F.struct(F.array().cast("array<string>").alias("held"), F.lit(False).alias("out"))

    def step(a: Column, s: Column) -> Column:
        up = s == ".."
        held = F.when(up, F.slice(a["held"], F.lit(1), F.greatest(F.size(a["held"]) - 1, F.lit(0)))).otherwise(F.concat(a["held"], F.array(s)))
        return F.struct(held.alias("held"), (a["out"] | (up & (F.size(a["held"]) == 0))).alias("out"))

    parts = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    return F.aggregate(parts, start, step, lambda a: F.when(~a["out"], F.array_join(a["held"], "/")))


def joined_path(*parts: Column) -> Column:
    """The parts one under the other, in normal form; empty parts add nothing."""
    return normal_path(F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "/"))


def extension(path: Column) -> Column:
    """From the last dot of the name on, in lower case; empty without one."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_ignored(path: Column) -> Column:
    """Whether default rules leave the path out: a directory or file name that builds and package managers make."""
    lower = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.split(lower, "/")
    inside = F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(d) for d in IGNORED_DIRECTORIES]))
    under = [(lower == p) | lower.startswith(f"{p}/") for p in IGNORED_PATHS]
    out = inside | base_name(lower).isin(*IGNORED_FILES)
    for u in under:
        out = out | u
    return out


def glob_regex(glob: str) -> str:
    """A pattern for a glob: ``*`` stays within a segment, ``**`` crosses them, all else stands for itself."""
    parts = ["(?:.*)" if p == "**" else re.sub(r"([.+^${}()|\[\]\\?])", r"\\\1", p).replace("*", "[^/]*") for p in glob.split("/")]
    return "^" + "/".join(parts).replace("(?:.*)/", "(?:.*/)?") + "$"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    """Whether one of the globs fits; a glob that ends in a slash, or names a directory, fits all below it too."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g.rstrip("/"))) | path.rlike(glob_regex(g.rstrip("/") + "/**"))
    return out


def classify(path: Column, todo_globs: Sequence[str] = (), own_config: str | None = None) -> Column:
    """The class of an artifact by its path, null for what is not carried. Rules are tried in order; the first that fits counts."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    lower = F.lower(p)
    name, ext = base_name(lower), extension(lower)
    parts = F.split(lower, "/")
    fixture = F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(d) for d in FIXTURE_DIRECTORIES]))
    within = lambda d: lower.contains(f"/{d}/") | lower.startswith(f"{d}/")
    note = ext.isin(".md", ".mdx")
    names = (*CONFIG_NAMES, own_config) if own_config else CONFIG_NAMES
    return (
        F.when(fixture | is_ignored(lower), None)
        .when(name == "agents.md", "agents")
        .when((name == "claude.md") | within(".claude/rules"), "claude")
        .when(name == "skill.md", "skill")
        .when(within(".cursor/rules"), "cursor_rule")
        .when(matches_any(p, todo_globs), "todo_progress")
        .when(note & (name.startswith("adr-") | lower.contains("/adr/") | lower.contains("/adrs/")), "adr")
        .when(lower.rlike(ISSUE_PATTERN), "todo_progress")
        .when(note & (name.rlike(TODO_PATTERN) | name.rlike(HANDOFF_PATTERN)), "todo_progress")
        .when(note & (name.rlike(SPEC_PATTERN) | within("spec") | within("specs")), "spec")
        .when(ext.isin(*CODE), "code_metadata")
        .when(name.isin(*names) | name.rlike(CONFIG_PATTERN), "config")
        .when(ext.isin(*DOCS), "doc")
        .when(ext.isin(*SCHEMAS), "schema")
        .when(ext.isin(*STYLES), "style")
        .when(ext.isin(*CONFIGS), "config")
    )


def kind(classification: Column) -> Column:
    """The kind under which a class is stored."""
    out = F.when(F.lit(False), "")
    for c, k in KINDS.items():
        out = out.when(classification == c, k)
    return out.otherwise(classification)


def _within(path: Column, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | (path == p.rstrip("/")) | path.startswith(p)
    return out


def domain(path: Column, classification: Column, layout: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The domain that a repository's own layout states, else by leading directories; files at the root are shared."""
    out = F.when(F.lit(False), "")
    for name in DOMAINS:
        if layout and layout.get(name):
            out = out.when(_within(path, layout[name]), name)
    out = out.when(classification == "schema", "database")
    for name, prefixes in DOMAINS.items():
        out = out.when(_within(path, prefixes), name)
    return out.when(path.contains("/"), "unclassified").otherwise("shared")


def route_entry(path: Column) -> Column:
    """page, layout or route of a file that serves a url by its place, null for others."""
    inner = F.regexp_replace(F.regexp_extract(path, PAGES_ROUTE, 1), "/?index$", "")
    return F.when(path.rlike(APP_ROUTE), F.regexp_extract(path, APP_ROUTE, 2)).when(path.rlike(PAGES_ROUTE) & ~F.concat(F.lit("/"), inner).rlike(r"(?:^|/)_(?:app|document|middleware|error)$"), "page")


def route_url(path: Column) -> Column:
    """The url that such a file serves; segments in parentheses are groups and left out."""
    inner = F.when(path.rlike(APP_ROUTE), F.regexp_extract(path, APP_ROUTE, 1)).otherwise(F.regexp_replace(F.regexp_extract(path, PAGES_ROUTE, 1), "/?index$", ""))
    parts = F.filter(F.split(inner, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))
    return F.when(route_entry(path).isNotNull(), F.concat(F.lit("/"), F.array_join(parts, "/")))


def unit(path: Column, classification: Column) -> Column:
    """test, doc, code or file."""
    return F.when(is_test(path), "test").when(classification.isin(*DOC_CLASSES), "doc").when(classification == "code_metadata", "code").otherwise("file")


def fine_unit(path: Column, classification: Column, symbols: Column) -> Column:
    """The unit in finer steps; a component is a file of the kind that exports a name in Pascal case. ``symbols``: array of names, may be null."""
    pascal = F.coalesce(F.exists(symbols, lambda s: s.rlike("^[A-Z][A-Za-z0-9]*$")), F.lit(False))
    return (
        F.when(is_test(path), "test")
        .when(classification.isin(*DOC_CLASSES), "doc")
        .when(classification == "schema", "schema")
        .when(route_entry(path).isNotNull(), "route")
        .when(path.rlike(ACTION_FILE), "action")
        .when(path.rlike(r"\.[cm]?[jt]sx$") & pascal, "component")
        .otherwise("lib")
    )


def area(path: Column, classification: Column, layout: Mapping[str, Sequence[str]] | None = None) -> Column:
    """One of six areas: tests, docs, database, frontend, backend, other."""
    d, u = domain(path, classification, layout), unit(path, classification)
    return F.when(u == "test", "tests").when(u == "doc", "docs").when(d.isin("database", "frontend"), d).when(d == "unclassified", "other").otherwise("backend")


def edge_family(relation: Column, source_kind: Column) -> Column:
    """The family of an edge by its relation, and for references by what refers."""
    semantic = ("part_of", "uses", "depends_on", "produces", "configures", "validates")
    refers = F.when(source_kind == "concept", "semantic").when(source_kind == "rationale", "structure").otherwise("doc")
    return (
        F.when(source_kind == "db_object", "database")
        .when(relation.isin("defines", "modifies", "queries"), "database")
        .when(relation.isin("imports", "calls"), "structure")
        .when(relation == "contains", "hierarchy")
        .when(relation == "handles", "route")
        .when(relation == "references", refers)
        .when(relation.isin(*semantic), "semantic")
        .when((relation == "implements") & (source_kind == "concept"), "semantic")
        .when(relation.isin("implements", "tests", "supports", "contradicts", "requires", "supersedes"), "evidence")
        .otherwise("structure")
    )


def tier_confidence(tier: Column) -> Column:
    """1.0 for what is resolved, 0.6 for what a name only suggests."""
    return F.when(tier == "resolved", 1.0).otherwise(0.6)
