"""Readers, link resolution and rules over the repository made of the star tables, each with SQL that goes by keys instead of texts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellar.functions import paths, words
from tessellar.operators import assurance, resolve, scan
from tessellar.repository import star
from tessellar.sources import code, markdown
from tessellar.sources.lexer import lexed
from tessellar.sources.tables import cut, table, written

DOC_CLASSES = ("adr", "agents", "claude", "cursor_rule", "doc", "skill", "spec", "todo_progress")

SQL_REPO = """with n as (select count(*)::bigint n from part),
p as (select p_partkey p, 'src/b' || (p_partkey % 25) || '/p' || p_partkey || '.ts' path from part),
pairs as (select distinct a.l_partkey p, b.l_partkey q from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 and a.l_partkey <> b.l_partkey join part on p_partkey = a.l_partkey),
m as (select p.p, path, count(q) n_q from p left join pairs on pairs.p = p.p group by all),
t as (select p_partkey p, 'tests/p' || p_partkey || '.test.ts' path from part where p_partkey % 4 = 0),
c as (select c_custkey c, c_nationkey nk, 'specs/n' || c_nationkey || '/c' || c_custkey || '.md' path, c_custkey * 7 % (n + 50) y, c_custkey + n // 2 z, (select count(*) from orders where o_custkey = c_custkey) n_o from customer, n),
o as (select o_orderkey o, o_custkey, o_orderstatus s, o_orderpriority like '5%' inner_, 10 + row_number() over (partition by o_custkey order by o_orderkey) line, path, o_orderkey % (n + 100) x,
  'REQ-O' || o_orderkey || case o_orderkey % 3 when 0 then ' calls loadPart' || (o_orderkey % (n + 100)) when 1 then ' is written down' else '' end statement from orders join c on c.c = o_custkey, n),
k as (select n_nationkey k, n_regionkey r, 'docs/adr/nation' || n_nationkey || '.md' path from nation),
g as (select r_regionkey r, 'db/r' || r_regionkey || '/AGENTS.md' path from region),
f as (select path, 'code_metadata' class from p union all select path, 'code_metadata' from t union all select path, 'spec' from c union all select path, 'adr' from k union all select 'api/n' || k || '.py', 'code_metadata' from k
  union all select 'db/r' || r || '/t' || k || '.sql', 'schema' from k union all select path, 'agents' from g union all values ('api/base.py', 'code_metadata'), ('AGENTS.md', 'agents'))
"""


class Repository:
    """What one query derives from the tables: files and what is read from them, each written once for the steps of that query alone."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def files(self) -> DataFrame:
        return written(star.files(self.spark, self.sf_dir))

    @cached_property
    def ruled(self) -> DataFrame:
        """Files as rules read them, without the texts of scripts."""
        return written(star.files_by_rule(self.spark, self.sf_dir))

    @cached_property
    def code(self) -> DataFrame:
        """The code of source files, told from comments and strings once for all readers."""
        return written(lexed(star.source_files(self.spark, self.sf_dir)))

    @cached_property
    def docs(self) -> DataFrame:
        """Lines of all documents, with their class."""
        docs = self.files.where(F.col("classification").isin(*DOC_CLASSES))
        return written(assurance.marked_lines(docs))

    @cached_property
    def needs(self) -> DataFrame:
        return written(assurance.requirements(self.docs))

    @cached_property
    def symbols(self) -> DataFrame:
        return written(code.exported_symbols(self.code, self.given))

    @cached_property
    def given(self) -> DataFrame:
        """Imports of barrels that give names on."""
        return written(_imports(self.code).where("is_re_export"))

    @cached_property
    def specs(self) -> DataFrame:
        return self.files.where("classification = 'spec'").select("path")

    @cached_property
    def imports(self) -> DataFrame:
        return written(_imports(self.code))

    @cached_property
    def targets(self) -> DataFrame:
        return written(self._targets(self.imports))

    @cached_property
    def owners(self) -> DataFrame:
        return self._owners(self.imports, self.targets)

    def _targets(self, imports: DataFrame) -> DataFrame:
        known, python = self.code.select("path"), F.lower("path").endswith(".py")
        scripts = resolve.script_targets(imports.where(~python), known, star.aliases(self.spark))
        return scripts.unionByName(resolve.python_targets(imports.where(python), known, ("", "api")))

    def _owners(self, imports: DataFrame, targets: DataFrame) -> DataFrame:
        asked = imports.join(targets, ["path", "specifier"]).select(F.col("target").alias("barrel"), F.explode("names").alias("name"))
        return cut(resolve.through_barrels(asked, imports, targets, self.symbols))

    def meant(self, own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """imports, targets and owners for what these files (of the code) import: of all others only what barrels give on is resolved too."""
        imports = written(_imports(own).where("not is_re_export").unionByName(self.given))
        targets = written(self._targets(imports))
        return imports, targets, self._owners(imports, targets)

    @cached_property
    def links(self) -> DataFrame:
        return resolve.code_links(self.imports, self.targets, self.owners, code.calls(self.code), code.local_names(self.code), self.symbols)

    @cached_property
    def tested(self) -> DataFrame:
        """What a test imports."""
        return resolve.import_links(*self.meant(self.code.where(paths.is_test(F.col("path"))))).where("kind = 'tests'").select(F.col("target").alias("path")).distinct()


def _imports(files: DataFrame) -> DataFrame:
    script, python = code.script_imports(files), code.python_imports(files)
    none = F.array().cast("array<struct<local:string,symbol:string>>").alias("bindings")
    return script.unionByName(python.select("path", F.col("n").cast("int").alias("n"), "specifier", F.lit(False).alias("is_re_export"), "names", none))


_NAMES = ["AGENTS.md", "CLAUDE.md", "SKILL.md", "TODO.md", "spec-a.md", "adr-1.md", "notes.txt", "page.tsx", "layout.tsx", "route.ts", "index.ts", "use.test.ts", "actions.ts", "Card.tsx", "a.go", "conftest.py", "x.sql", "x.css", "x.yaml", "package.json", "tsconfig.base.json", "yarn.lock", "handoff.md", "picture.png", "_app.tsx", "Dockerfile.web"]
_DIRS = ["", "src/app/(shop)/items", "apps/web/app", "packages/core/src", "src/pages/users", "docs/adr", "specs", "db/migrations", "node_modules/x", "a/fixtures/b", ".cursor/rules", ".claude/rules", "tests", "lib", "other/x", ".beads"]


def classify_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, kind, facets, area and route of a path made for every part: each name in each directory."""
    at = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))
    d, name = at(_DIRS, F.col("p_partkey")), at(_NAMES, F.floor(F.col("p_partkey") / len(_DIRS)))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(d == "", name).otherwise(F.concat(d, F.lit("/"), name)).alias("path"))
    rows = rows.withColumn("class", paths.classify(F.col("path")))
    p, c = F.col("path"), F.col("class")
    return rows.select("p_partkey", "path", "class", paths.kind(c).alias("kind"), paths.domain(p, F.coalesce(c, F.lit("code_metadata"))).alias("domain"), paths.unit(p, c).alias("unit"), paths.fine_unit(p, c, F.array(F.lit("Card"))).alias("fine_unit"), paths.area(p, F.coalesce(c, F.lit("code_metadata"))).alias("area"), paths.route_entry(p).alias("entry"), paths.route_url(p).alias("url"))


def _sql_within(prefixes: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"path = '{p.rstrip('/')}' or starts_with(path, '{p}')" for p in prefixes) + ")"


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_DOMAIN_SQL = " ".join(f"when {_sql_within(v)} then '{k}'" for k, v in paths.DOMAINS.items())
SQL_CLASSIFY = f"""with a as (select p_partkey, ([{_sql_list(_DIRS)}])[(p_partkey % {len(_DIRS)} + 1)::int] d, ([{_sql_list(_NAMES)}])[(p_partkey // {len(_DIRS)} % {len(_NAMES)} + 1)::int] name from part),
b as (select p_partkey, case when d = '' then name else d || '/' || name end path, lower(name) lname, lower(d) ld, lower(coalesce(nullif(regexp_extract(name, '(\\.[^.]*)$', 1), ''), '')) ext from a),
e as (select *, lower(path) l, string_split(ld, '/') dirs, case when regexp_matches(path, '(?:^|/)app/') and regexp_matches(path, '(?:page|layout|route)\\.[cm]?[jt]sx?$') then regexp_extract(path, '(page|layout|route)\\.[cm]?[jt]sx?$', 1)
  when regexp_matches(path, '(?:^|/)pages/.+\\.[cm]?[jt]sx?$') and not regexp_matches(path, '/_app\\.') then 'page' end entry from b),
k as (select *, case when list_has_any(dirs, [{_sql_list(paths.FIXTURE_DIRECTORIES)}]) or list_has_any(dirs, [{_sql_list(paths.IGNORED_DIRECTORIES)}]) or lname in ({_sql_list(paths.IGNORED_FILES)}) then null
  when lname = 'agents.md' then 'agents' when lname = 'claude.md' or contains('/' || l, '/.claude/rules/') then 'claude' when lname = 'skill.md' then 'skill' when contains('/' || l, '/.cursor/rules/') then 'cursor_rule'
  when ext in ('.md', '.mdx') and (starts_with(lname, 'adr-') or contains(l, '/adr/') or contains(l, '/adrs/')) then 'adr'
  when ext in ('.md', '.mdx') and (regexp_matches(lname, '{paths.TODO_PATTERN}') or regexp_matches(lname, '{paths.HANDOFF_PATTERN}')) then 'todo_progress'
  when ext in ('.md', '.mdx') and (regexp_matches(lname, '{paths.SPEC_PATTERN}') or contains('/' || l, '/spec/') or contains('/' || l, '/specs/')) then 'spec'
  when ext in ({_sql_list(paths.CODE)}) then 'code_metadata' when lname in ({_sql_list(paths.CONFIG_NAMES)}) or regexp_matches(lname, '{paths.CONFIG_PATTERN}') then 'config'
  when ext in ({_sql_list(paths.DOCS)}) then 'doc' when ext in ({_sql_list(paths.SCHEMAS)}) then 'schema' when ext in ({_sql_list(paths.STYLES)}) then 'style' when ext in ({_sql_list(paths.CONFIGS)}) then 'config' end class from e),
u as (select *, regexp_matches(path, '{paths.TEST_PATH}') is_test, class in ({_sql_list(paths.DOC_CLASSES)}) is_doc, case when class = 'schema' then 'database' {_DOMAIN_SQL} when contains(path, '/') then 'unclassified' else 'shared' end domain from k)
select p_partkey, path, class, case class when 'todo_progress' then 'todo' when 'agents' then 'instruction' when 'claude' then 'instruction' when 'cursor_rule' then 'instruction' when 'skill' then 'instruction' else class end kind, domain,
 case when is_test then 'test' when is_doc then 'doc' when class = 'code_metadata' then 'code' else 'file' end unit,
 case when is_test then 'test' when is_doc then 'doc' when class = 'schema' then 'schema' when entry is not null then 'route' when regexp_matches(path, '{paths.ACTION_FILE}') then 'action' when regexp_matches(path, '\\.[cm]?[jt]sx$') then 'component' else 'lib' end fine_unit,
 case when is_test then 'tests' when is_doc then 'docs' when domain in ('database', 'frontend') then domain when domain = 'unclassified' then 'other' else 'backend' end area, entry,
 case when entry is not null then '/' || array_to_string(list_filter(string_split(case when contains('/' || path, '/app/') then regexp_replace(regexp_extract('/' || path, '/app/(.*)$', 1), '/?(page|layout|route)\\.[cm]?[jt]sx?$', '') else regexp_replace(regexp_extract(path, 'pages/(.+)\\.[cm]?[jt]sx?$', 1), '/?index$', '') end, '/'), lambda s: s <> '' and not regexp_matches(s, '^\\(.*\\)$')), '/') end url from u"""


def repo_todos(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Task items of all specifications with their keys and parents."""
    repo = repo or Repository(spark, sf_dir)
    return markdown.todos(repo.docs).select(F.col("doc_id").alias("path"), "line", "status", "title", "occurrence", "source_key", "parent_key")


SQL_TODOS = SQL_REPO + """, w as (select *, 'document:' || path || ':' || substr(sha256(lower(statement)), 1, 16) key from o)
select path, line::int line, case s when 'F' then 'done' when 'P' then 'in-progress' else 'open' end status, statement title, 1 occurrence, key source_key,
  case when inner_ then last_value(case when not inner_ then key end ignore nulls) over (partition by path order by line rows between unbounded preceding and 1 preceding) end parent_key from w"""


def sections(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Headings of all documents with the lines of their sections."""
    repo = repo or Repository(spark, sf_dir)
    return markdown.sections(repo.docs).select(F.col("doc_id").alias("path"), "line", "depth", "title", "last_line")


SQL_SECTIONS = SQL_REPO + """select path, 1 line, 1 depth, 'Customer ' || c title, (12 + n_o)::int last_line from c union all select path, 5, 2, 'Acceptance criteria', 8 from c union all select path, 9, 2, 'Tasks', (12 + n_o)::int from c
union all select path, 1, 1, 'ADR-' || k || ' — nation', 7 from k union all select path, 3, 2, 'Decision', 7 from k"""


def requirement_list(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Requirements of all documents."""
    repo = repo or Repository(spark, sf_dir)
    return repo.needs.select("path", "origin", "line", "last_line", "fulfilled", "id", "statement")


_NEEDS_SQL = """, needs as (select path, 'task' origin, line, line last_line, s = 'F' fulfilled, 'REQ-O' || o id, statement from o
 union all select path, 'acceptance', 5, 7, null, 'REQ-C' || c, 'REQ-C' || c || ' MUST hold.' from c
 union all select path, 'adr-decision', 3, 7, null, null, 'Region ' || r || ' MUST hold nation ' || k || '.' || chr(10) || case when k % 2 = 0 then 'See `src/b' || k || '/p' || k || '.ts`.' else 'See nothing.' end from k
 union all select path, 'normative', 3, 3, null, null, 'API responses MUST use ' || case when r % 2 = 0 then 'snake_case' else 'camelCase' end || ' JSON keys.' from g
 union all values ('AGENTS.md', 'normative', 1, 1, null, null, 'API responses MUST use camelCase JSON keys.'))
"""
SQL_NEEDS = SQL_REPO + _NEEDS_SQL + "select path, origin, line::int line, last_line::int last_line, fulfilled, id, statement from needs"


def exported_symbols(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """What every source file exports."""
    repo = repo or Repository(spark, sf_dir)
    return repo.symbols


SQL_SYMBOLS = SQL_REPO + "select path, (n_q + 3)::int line, 'function' kind, 'loadPart' || p name from m union all select 'api/n' || k || '.py', 5, 'function', 'load' from k union all select 'api/n' || k || '.py', 8, 'class', 'N' || k from k union all values ('api/base.py', 1, 'class', 'Base')"


SHOWN = ("type", "path", "line", "severity", "confidence", "target", "detail")


def missing_implementation(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Rule 1 over all specifications."""
    repo = repo or Repository(spark, sf_dir)
    return assurance.missing_implementation(repo.needs, repo.specs, repo.symbols).select(*SHOWN)


_R1 = "select 'missing-implementation' type, path, line::int line, 'medium' severity, case when o % 3 = 0 then 0.95 else 0.75 end::double confidence, null::varchar target, 'REQ-O' || o detail from o, n where s <> 'F' and not (o % 3 = 0 and x < n)"
SQL_R1 = SQL_REPO + _R1


def missing_test(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Rule 2 over all specifications and tests."""
    repo = repo or Repository(spark, sf_dir)
    return assurance.missing_test(repo.needs, repo.specs, assurance.tested_requirements(repo.files), repo.symbols).select(*SHOWN)


_R2 = "select 'missing-test' type, o.path, line::int line, 'medium' severity, 0.9::double confidence, p.path target, 'REQ-O' || o detail from o cross join n left join p on o % 3 = 0 and p.p = x where s = 'F' and (o % n) % 4 <> 0"
SQL_R2 = SQL_REPO + _R2


def stale_refs(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Rule 3 over all records and specifications."""
    repo = repo or Repository(spark, sf_dir)
    files = repo.files
    return assurance.stale_documents(assurance.source_references(repo.docs.where("classification in ('adr', 'spec')"), files.select("path"), repo.symbols), files).select(*SHOWN)


_R3 = "select 'stale-doc' type, path, (12 + n_o)::int line, 'medium' severity, 0.98::double confidence, null::varchar target, 'loadPart' || y detail from c, n where y >= n"
SQL_R3 = SQL_REPO + _R3


def instruction_conflicts(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Rule 4 over all instructions."""
    repo = repo or Repository(spark, sf_dir)
    return assurance.contradictions(repo.docs).select(*SHOWN)


_R4 = "select 'contradicting-instructions' type, 'AGENTS.md' path, 1 line, 'medium' severity, 0.96::double confidence, null::varchar target, max(path) || ':3' detail from g where r % 2 = 0 having count(*) > 0"
SQL_R4 = SQL_REPO + _R4


def orphan_docs(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Rule 5 over all records."""
    repo = repo or Repository(spark, sf_dir)
    files = repo.files
    return assurance.orphan_documents(repo.docs, assurance.source_references(repo.docs.where("classification = 'adr'"), files.select("path"), repo.symbols)).select(*SHOWN)


_R5 = "select 'orphan-doc' type, path, 5 line, 'low' severity, 0.85::double confidence, null::varchar target, 'nation' || k detail from k where k % 2 = 1"
SQL_R5 = SQL_REPO + _R5


def unproven_claims(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Rule 6 over all specifications."""
    repo = repo or Repository(spark, sf_dir)
    files = repo.files
    stale = assurance.stale_documents(assurance.source_references(repo.docs.where("classification = 'spec'"), files.select("path"), repo.symbols), files)
    return assurance.unproven_claims(repo.docs, repo.needs, stale).select(*SHOWN)


_R6 = "select 'unproven-claim' type, path, 3 line, 'medium' severity, 0.8::double confidence, null::varchar target, 'claim' detail from c"
SQL_R6 = SQL_REPO + _R6


def untested_code(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Rule 7 over all code."""
    repo = repo or Repository(spark, sf_dir)
    files = repo.files
    return assurance.untested_code(files, repo.symbols, repo.tested).select(*SHOWN)


_R7 = """select 'untested-code' type, path, (n_q + 3)::int line, 'low' severity, 0.6::double confidence, path target, '1 exported' detail from m where p % 4 <> 0
 union all select 'untested-code', 'api/n' || k || '.py', 5, 'low', 0.6, 'api/n' || k || '.py', '2 exported' from k union all values ('untested-code', 'api/base.py', 1, 'low', 0.6, 'api/base.py', '1 exported')"""
SQL_R7 = SQL_REPO + _R7


def findings(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """All rules, the first one on each span."""
    repo = repo or Repository(spark, sf_dir)
    return assurance.analyze(repo.ruled, repo.symbols, repo.tested).select(*SHOWN)


SQL_FINDINGS = SQL_REPO + " union all ".join(f"(select * from ({r}))" for r in (_R1, _R2, _R3, _R4, _R5, _R6, _R7))


def implements_links(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Requirements and the files that own the symbols they name."""
    repo = repo or Repository(spark, sf_dir)
    return assurance.implementation_links(repo.needs, repo.symbols)


SQL_IMPLEMENTS = SQL_REPO + "select o.path, 'REQ-O' || o identity, line::int line, 'loadPart' || x symbol, p.path target from o join p on o % 3 = 0 and p.p = x"


def assurance_coverage(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """How many requirements are implemented and tested."""
    repo = repo or Repository(spark, sf_dir)
    needs = repo.needs
    return assurance.requirement_coverage(needs, assurance.implementation_links(needs, repo.symbols), assurance.tested_requirements(repo.files))


SQL_COVERAGE = SQL_REPO + _NEEDS_SQL + "select count(*) requirements, (select count(*) from o join p on o % 3 = 0 and p.p = x) implemented, (select count(*) from o, n where (o % n) % 4 = 0) tested from needs"


def doc_links(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Links of all documents to files."""
    repo = repo or Repository(spark, sf_dir)
    docs = repo.docs
    return resolve.doc_links(resolve.mentions(markdown.code_references(docs), markdown.links(docs)), repo.files.select("path"))


SQL_DOC_LINKS = SQL_REPO + """, l as (select c.path source, p.path target, (12 + n_o)::int line, 'path-exists' method from c join p on p.p = y union all select c.path, p.path, (12 + n_o)::int, 'doc-link' from c join p on p.p = z)
select source, target, line, min(method) method, 'resolved' tier from l group by source, target, line union all select k.path, p.path, 7, 'path-exists', 'resolved' from k join p on p.p = k where k % 2 = 0"""


def section_links(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Citations of decision records by documents and by comments in code."""
    repo = repo or Repository(spark, sf_dir)
    docs, files = repo.docs, repo.files
    return resolve.section_links(markdown.declared_sections(docs), markdown.cited_tokens(docs), code.rationales(files.where("classification = 'code_metadata'")))


SQL_SECTION_LINKS = SQL_REPO + """select c.path source, 'ADR-' || nk token, 'docs/adr/nation' || nk || '.md' home, (12 + n_o)::int line, 'document' via from c
union all select m.path, 'ADR-' || (p % 30), k.path, (n_q + 2)::int, 'rationale' from m left join k on k.k = p % 30"""


def rationale_notes(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Reasons that comments give."""
    repo = repo or Repository(spark, sf_dir)
    return code.rationales(repo.files.where("classification = 'code_metadata'"))


SQL_RATIONALES = SQL_REPO + "select path, (n_q + 2)::int line, 'why' kind, 'part ' || p || ' follows ADR-' || (p % 30) \"text\", 'ADR-' || (p % 30) adr from m"


def code_links(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Imports, calls and tests between all source files."""
    repo = repo or Repository(spark, sf_dir)
    return repo.links.withColumn("names", F.array_join("names", ","))


SQL_CODE_LINKS = SQL_REPO + """, i as (select m.path source, p.path target, q % 3 = 0 alias, 'loadPart' || q name from pairs join m on m.p = pairs.p join p on p.p = q)
select 'imports' kind, source, target, case when alias then 'reference' else 'resolved' end tier, case when alias then 'alias-resolution' else 'module-resolution' end method, name as names from i
union all select 'calls', source, target, 'resolved', 'import-binding', name from i
union all select 'imports', t.path, p.path, 'reference', 'alias-resolution', 'loadPart' || p from t join p using (p)
union all select 'tests', t.path, p.path, 'reference', 'test-import', 'loadPart' || p from t join p using (p)
union all select 'calls', t.path, p.path, 'resolved', 'import-binding', 'loadPart' || p from t join p using (p) where exists (select 1 from orders, n where o_orderkey % n = p)
union all select 'imports', 'api/n' || k || '.py', 'api/n' || ((k + 1) % 25) || '.py', 'reference', 'module-resolution', 'load' from k
union all select 'imports', 'api/n' || k || '.py', 'api/base.py', 'reference', 'module-resolution', 'Base' from k"""


def incremental_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links after a scan that is brought up to date: before it, every fiftieth part had no file, another fiftieth no text, and some files were there that are gone."""
    files = written(star.files(spark, sf_dir).where("classification = 'code_metadata'").select("path", "text"))
    part = F.regexp_extract("path", "^src/b[0-9]+/p([0-9]+)[.]ts$", 1).try_cast("long") % 50
    gone = table(spark, sf_dir, "part").where("p_partkey % 50 = 11").select(F.expr("concat('src/old/p', p_partkey, '.ts')").alias("path"), F.expr("concat('import { loadPart', p_partkey, ' } from \"@/b', p_partkey % 25, '/p', p_partkey, '\";')").alias("text"))
    earlier = written(files.where(~F.coalesce(part == 7, F.lit(False))).withColumn("text", F.when(part == 9, "").otherwise(F.col("text"))).unionByName(gone))
    before = scan.full_scan(earlier, star.aliases(spark), ("", "api"))
    before["links"] = written(before["links"])
    return scan.incremental_scan(before, files, star.aliases(spark), ("", "api"))["links"].withColumn("names", F.array_join("names", ","))


def heritage(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Bases of all classes."""
    repo = repo or Repository(spark, sf_dir)
    files = repo.code
    bases = written(code.heritage(files))
    imports, targets, owners = repo.meant(files.join(bases.select("path").distinct(), "path", "left_semi"))
    return resolve.heritage_links(bases, resolve.bound_names(imports.join(targets, ["path", "specifier"]), owners), repo.symbols)


SQL_HERITAGE = SQL_REPO + "select 'api/n' || k || '.py' path, 'N' || k as name, 'class' kind, 'api/base.py' target, 'Base' base from k"


def schema_links(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Statements and queries on schema objects."""
    repo = repo or Repository(spark, sf_dir)
    files = repo.files
    objects, links = code.schema_statements(files)
    return resolve.schema_links(objects, links, code.table_literals(files.where("classification = 'code_metadata'")))


SQL_SCHEMA = SQL_REPO + """select 'db/r' || r || '/t' || k || '.sql' path, 1 line, 'defines' kind, null::varchar source, 't' || k target from k union all select 'db/r' || r || '/t' || k || '.sql', 3, 'references', 't' || k, 't' || ((k + 1) % 25) from k
union all select 'db/r' || r || '/t' || k || '.sql', 5, 'modifies', null, 't' || ((k + 2) % 25) from k union all select path, (n_q + 4)::int, 'queries', null, 't' || (p % 30) from m where p % 30 < 25"""


def db_objects(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """The file that declares each schema object."""
    repo = repo or Repository(spark, sf_dir)
    return resolve.declaring_files(code.schema_statements(repo.files)[0])


SQL_OBJECTS = SQL_REPO + "select 't' || k as name, 'db/r' || r || '/t' || k || '.sql' path, 1 line, 'table' kind from k"


def routes(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Which file serves which url."""
    repo = repo or Repository(spark, sf_dir)
    files = repo.files
    return resolve.route_handlers(files, code.python_routes(files))


SQL_ROUTES = SQL_REPO + "select '/nations/' || k url, 'GET' as method, 'api/n' || k || '.py' path, 'decorator' entry from k"


def containment_edges(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Every directory and what lies in it."""
    repo = repo or Repository(spark, sf_dir)
    return resolve.containment(repo.files)


SQL_CONTAINMENT = SQL_REPO + """, s as (select string_split(path, '/') a from f), e as (select distinct array_to_string(a[1:i], '/') source, array_to_string(a[1:i + 1], '/') target from s, lateral (select unnest(range(1, len(a))) i)) select source, target from e"""


def reported_paths(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Paths of a coverage report, with a prefix of the machine that made it, and the files they stand for."""
    repo = repo or Repository(spark, sf_dir)
    reported = table(spark, sf_dir, "part").select(F.expr("concat('/ci/run', p_partkey % 7, '/./src/b', p_partkey % 26, '/p', p_partkey, '.ts')").alias("reported"))
    return resolve.reported_paths(reported, star.file_paths(spark, sf_dir))


SQL_REPORTED = SQL_REPO + "select '/ci/run' || (p % 7) || '/./src/b' || (p % 26) || '/p' || p || '.ts' reported, case when p % 26 = p % 25 then path end path from p"


def symbol_keys(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Stable keys of all exported symbols, and ids made of them."""
    repo = repo or Repository(spark, sf_dir)
    s = repo.symbols
    key = words.symbol_key(F.col("path"), F.lit(None).cast("string"), F.col("kind"), F.col("name"))
    return s.select("path", "kind", "name", key.alias("key"), words.ulid_of(key).alias("node_id"))


_ULID = " || ".join(f"'0123456789ABCDEFGHJKMNPQRSTVWXYZ'[(('0b' || substr(b, {4 + 5 * k}, 5))::int + 1)]" for k in range(25))
SQL_KEYS = f"""with s as ({SQL_SYMBOLS}), d as (select path, kind, name, md5(path || '||' || kind || '|' || name) key from s),
h as (select *, sha256(key) d from d), x as (select *, array_to_string(list_transform(range(1, 33), lambda i: lpad(bin(('0x' || d[i])::int), 4, '0')), '') b from h)
select path, kind, name, key, '0' || {_ULID} node_id from x"""

def symbol_edges(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Declarations and bases of all symbols."""
    repo = repo or Repository(spark, sf_dir)
    return resolve.symbol_edges(repo.symbols, heritage(spark, sf_dir, repo))


SQL_SYMBOL_EDGES = f"""with s as ({SQL_SYMBOLS}), y as (select path, kind, name, md5(path || '||' || kind || '|' || name) key from s)
select path source, key target, 'declares' relation from y union all select a.key, b.key, 'extends' from y a, y b where a.path like 'api/n%' and a.kind = 'class' and b.path = 'api/base.py'"""


def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open findings at either end of each file."""
    from tessellar.operators import reports

    return reports.finding_counts(findings(spark, sf_dir).withColumn("status", F.lit("open")))


SQL_FINDING_COUNTS = f"with q as ({SQL_FINDINGS}) select item, count(*) n from (select path item from q union all select target from q where target is not null) group by 1"


def package_directories(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Directories of the repository, those with instructions taken as packages."""
    repo = repo or Repository(spark, sf_dir)
    return resolve.package_directories(repo.files, ("AGENTS.md",))


SQL_PACKAGES = SQL_REPO + """, d as (select distinct array_to_string(a[1:i], '/') path from (select string_split(path, '/') a from f), lateral (select unnest(range(1, len(a))) i)) select path, path || '/AGENTS.md' in (select path from g) is_package from d"""


def evidence_links(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """Test files, as a report with other prefixes names them, and the requirements that their cases state."""
    repo = repo or Repository(spark, sf_dir)
    tests = repo.files.where("path like 'tests/%'")
    evidence = tests.select(F.concat(F.lit("/ci/work/"), "path").alias("test_file"), markdown.requirement_ids(F.col("text")).alias("requirement_ids"))
    return resolve.evidence_links(evidence, repo.files.select("path"), repo.needs)


SQL_EVIDENCE_LINKS = SQL_REPO + "select '/ci/work/' || t.path test_file, t.path path, 'REQ-O' || o requirement from n, t left join o on o.o % (select n from n) = t.p"


def analysis_receipt(spark: SparkSession, sf_dir: str, repo: Repository | None = None) -> DataFrame:
    """The receipt of an analysis of the whole repository, with two findings and a requirement known before."""
    repo = repo or Repository(spark, sf_dir)
    from tessellar.operators.analysis import analyse

    known = spark.createDataFrame([("gone:a:1:0", "open"), ("orphan-doc:docs/adr/nation1.md:5:33", "dismissed")], "id string, status string")
    needs = spark.createDataFrame([("old.md", "REQ-OLD", "active")], "path string, identity string, status string")
    return analyse(repo.ruled, repo.symbols, repo.tested, known, needs)["receipt"]


SQL_RECEIPT = SQL_REPO + _NEEDS_SQL + ", q as (" + " union all ".join(f"(select * from ({r}))" for r in (_R1, _R2, _R3, _R4, _R5, _R6, _R7)) + """)
select (select count(*) from q) - 1 opened, 1 resolved, (select count(*) from q) - 1 open_total, (select count(*) from needs) requirements, (select count(*) from o join p on o % 3 = 0 and p.p = x) implemented, (select count(*) from o, n where (o % n) % 4 = 0) tested, 1 superseded"""

QUERIES = {
    f.__name__: f
    for f in (
        classify_path, repo_todos, sections, requirement_list, exported_symbols, missing_implementation, missing_test, stale_refs, instruction_conflicts, orphan_docs, unproven_claims, untested_code, findings,
        implements_links, assurance_coverage, doc_links, section_links, rationale_notes, code_links, incremental_links, heritage, schema_links, db_objects, routes, containment_edges, reported_paths, symbol_keys, symbol_edges, finding_counts, package_directories, evidence_links, analysis_receipt,
    )
}
ORACLES = {
    "classify_path": SQL_CLASSIFY, "repo_todos": SQL_TODOS, "sections": SQL_SECTIONS, "requirement_list": SQL_NEEDS, "exported_symbols": SQL_SYMBOLS, "missing_implementation": SQL_R1, "missing_test": SQL_R2, "stale_refs": SQL_R3,
    "instruction_conflicts": SQL_R4, "orphan_docs": SQL_R5, "unproven_claims": SQL_R6, "untested_code": SQL_R7, "findings": SQL_FINDINGS, "implements_links": SQL_IMPLEMENTS, "assurance_coverage": SQL_COVERAGE,
    "doc_links": SQL_DOC_LINKS, "section_links": SQL_SECTION_LINKS, "rationale_notes": SQL_RATIONALES, "code_links": SQL_CODE_LINKS, "incremental_links": SQL_CODE_LINKS, "heritage": SQL_HERITAGE, "schema_links": SQL_SCHEMA, "db_objects": SQL_OBJECTS,
    "routes": SQL_ROUTES, "containment_edges": SQL_CONTAINMENT, "reported_paths": SQL_REPORTED, "symbol_keys": SQL_KEYS, "symbol_edges": SQL_SYMBOL_EDGES, "finding_counts": SQL_FINDING_COUNTS, "package_directories": SQL_PACKAGES, "evidence_links": SQL_EVIDENCE_LINKS, "analysis_receipt": SQL_RECEIPT,
}
