"""Link resolution on small trees."""

from pyspark.sql import functions as F

from tessellar.functions import paths, words
from tessellar.operators import resolve
from tessellar.sources import code


def files(spark, **texts):
    return spark.createDataFrame(list(texts.pop("rows").items()), "path string, text string")


def test_paths_in_normal_form(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a//b/",), ("a/../../b",), ("",)], "p string")
    assert [r[0] for r in df.select(paths.normal_path(F.col("p"))).collect()] == ["a/c", None, "a/b", None, ""]
    df = spark.createDataFrame([("src/a/b.ts", "src/**/*.ts"), ("src/b.ts", "src/**/*.ts"), ("src/b.tsx", "src/*.ts"), ("a+b/c", "a+b/*"), ("x/a/b", "a/*")], "p string, g string")
    assert [r["p"] for r in df.collect() if df.where(F.col("p") == r["p"]).select(F.col("p").rlike(paths.glob_regex(r["g"]))).first()[0]] == ["src/a/b.ts", "src/b.ts", "a+b/c"]


def test_modules_aliases_and_barrels(spark):
    rows = {
        "a/main.ts": 'import def, { one, two as zwei } from "./lib";\nimport * as all from "@x/core";\nimport "./side.js";\nconst lazy = import("./lib/deep");\none(); zwei(); all.go(); helper(); own();\nfunction own() {}',
        "a/lib/index.ts": 'export { one } from "./one";\nexport * from "./deep";\nexport { three as two } from "./three";',
        "a/lib/one.ts": "export const one = 1;",
        "a/lib/deep.ts": 'export * from "./three";\nexport function go() {}',
        "a/lib/three.ts": "export async function three() {}\nexport type T = {};",
        "a/side.ts": "export class Side extends Base {}",
        "core/src/x.ts": "export function helper() {}",
        "core/src/index.ts": "export const go = 1;",
        "a/base.ts": "export abstract class Base {}",
        "a/main.test.ts": 'import { one } from "./lib";',
    }
    df = files(spark, rows=rows)
    known, imports, symbols = df.select("path"), code.script_imports(df), code.exported_symbols(df)
    aliases = spark.createDataFrame([(1, "a", "@x/", "", True, "core/src/*", "reference"), (0, "", "@x/core", "", False, "core/src", "resolved")], "priority int, scope string, prefix string, suffix string, wildcard boolean, target string, tier string")
    targets = resolve.script_targets(imports, known, aliases).cache()
    got = {(r.path, r.specifier): (r.target, r.method) for r in targets.collect()}
    assert got["a/main.ts", "./lib"] == ("a/lib/index.ts", "module-resolution") and got["a/main.ts", "@x/core"] == ("core/src/index.ts", "alias-resolution")
    assert got["a/main.ts", "./side.js"][0] == "a/side.ts" and got["a/main.ts", "./lib/deep"][0] == "a/lib/deep.ts"
    asked = imports.join(targets, ["path", "specifier"]).select(F.col("target").alias("barrel"), F.explode("names").alias("name"))
    owners = resolve.through_barrels(asked, imports, targets, symbols)
    assert {(r.barrel, r.name, r.owner) for r in owners.collect()} == {("a/lib/index.ts", "one", "a/lib/one.ts"), ("a/lib/index.ts", "two", "a/lib/three.ts")}
    links = {(r.kind, r.source, r.target): (r.tier, r.method, tuple(r.names)) for r in resolve.code_links(imports, targets, owners, code.calls(df), code.local_names(df), symbols).collect()}
    assert links["imports", "a/main.ts", "a/lib/one.ts"] == ("resolved", "barrel-resolution", ("one",))
    assert links["calls", "a/main.ts", "a/lib/three.ts"] == ("resolved", "import-binding", ("two",))
    assert links["calls", "a/main.ts", "core/src/index.ts"] == ("resolved", "import-binding", ("go",))
    assert links["calls", "a/main.ts", "core/src/x.ts"] == ("reference", "name-match", ("helper",))
    assert links["tests", "a/main.test.ts", "a/lib/one.ts"][1] == "test-import" and ("imports", "a/main.ts", "a/side.ts") in links
    assert not [k for k in links if k[1] == k[2]]
    bases = resolve.heritage_links(code.heritage(df), resolve.bound_names(imports.join(targets, ["path", "specifier"]), owners), symbols)
    assert [(r.path, r.name, r.target, r.base) for r in bases.collect()] == [("a/side.ts", "Side", "a/base.ts", "Base")]


def test_python_modules(spark):
    df = files(spark, rows={"svc/app/main.py": "from .models import User, Other as O\nfrom ..lib import x\nimport shared.util, os\nfrom core import y\nclass A(User, metaclass=M):\n    pass\nclass _P(User):\n    pass", "svc/app/models.py": "class User: pass", "svc/lib/__init__.py": "", "svc/shared/util.py": "", "one/core.py": "", "two/core.py": ""})
    imports = code.python_imports(df)
    assert {(r.specifier, tuple(r.names)) for r in imports.collect()} == {(".models", ("User", "Other")), ("..lib", ("x",)), ("shared.util", ("*",)), ("os", ("*",)), ("core", ("y",))}
    got = {(r.specifier, r.target) for r in resolve.python_targets(imports, df.select("path"), ("svc", "one", "two")).collect()}
    assert got == {(".models", "svc/app/models.py"), ("..lib", "svc/lib/__init__.py"), ("shared.util", "svc/shared/util.py")}
    assert [(r.name, r.binding) for r in code.heritage(df).collect()] == [("A", "User")]


def test_document_links(spark):
    known = spark.createDataFrame([(p,) for p in ("docs/a.md", "docs/b.md", "x/index.ts", "y/index.ts", "x/only.ts", "GUIDE.md")], "path string")
    rows = [("docs/a.md", 3, "b.md", "doc-link"), ("docs/a.md", 1, "only.ts", "path-exists"), ("docs/a.md", 2, "index.ts", "path-exists"), ("docs/a.md", 4, "GUIDE", "doc-link"), ("docs/a.md", 5, "docs/b.md", "path-exists"), ("docs/a.md", 6, "../docs/a.md", "doc-link"), ("docs/a.md", 7, "../../up.md", "doc-link")]
    got = {(r.target, r.line, r.method, r.tier) for r in resolve.doc_links(spark.createDataFrame(rows, "doc_id string, line int, candidate string, method string"), known).collect()}
    assert got == {("docs/b.md", 3, "doc-link", "resolved"), ("x/only.ts", 1, "basename-owner", "reference"), ("GUIDE.md", 4, "doc-link", "resolved")}


def test_schema_statements_and_routes(spark):
    df = files(spark, rows={"db/a.sql": 'create table if not exists public."Users" (\n  team int references teams(id)\n);\ncreate or replace view v as select 1;\nalter table users add x int references v(id);', "db/b.sql": "CREATE TABLE teams (id int);", "api/r.py": '@app.route("/x", methods=["GET", "nope", "post"])\n@app.get(path="/y")\n@bp.route("/z")\n@app.get("no")', "src/app/(g)/items/page.tsx": "", "src/app/layout.tsx": "", "m.ts": 'db.from("users").x(); prisma.teams.find(); db.from("gone")'})
    objects, links = code.schema_statements(df)
    assert sorted((r.path, r.line, r.kind, r.name) for r in objects.collect()) == [("db/a.sql", 1, "table", "users"), ("db/a.sql", 4, "view", "v"), ("db/b.sql", 1, "table", "teams")]
    got = sorted((r.path, r.line, r.kind, r.source or "", r.target) for r in resolve.schema_links(objects, links, code.table_literals(df)).collect())
    assert got == [("db/a.sql", 1, "defines", "", "users"), ("db/a.sql", 2, "references", "users", "teams"), ("db/a.sql", 4, "defines", "", "v"), ("db/a.sql", 5, "modifies", "", "users"), ("db/a.sql", 5, "references", "users", "v"), ("db/b.sql", 1, "defines", "", "teams"), ("m.ts", 1, "queries", "", "teams"), ("m.ts", 1, "queries", "", "users")]
    handlers = {(r.url, r.method, r.path, r.entry) for r in resolve.route_handlers(df, code.python_routes(df)).collect()}
    assert handlers == {("/x", "GET", "api/r.py", "decorator"), ("/x", "POST", "api/r.py", "decorator"), ("/y", "GET", "api/r.py", "decorator"), ("/z", "ANY", "api/r.py", "decorator"), ("/items", "ANY", "src/app/(g)/items/page.tsx", "page"), ("/items", "ANY", "src/app/layout.tsx", "layout")}


def test_words(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(words.search_text(F.lit("  Ｆｕｌｌ \n Width "))) == "full width" and words.query_tokens("Où, C++ x_y-z!") == ["où", "c", "x_y-z"]
    assert one(words.slug(F.lit("  Hello, Wörld! "))) == "hello-wörld" and one(words.todo_title(F.lit("- [x] 1. Do  it!?"))) == "do it"
    assert one(words.git_blob_sha(F.lit(b"hello\n"))) == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert one(words.is_binary(F.lit(b"a\x00b"))) and one(words.is_binary(F.lit(b"\xff\xfe"))) and not one(words.is_binary(F.lit("é\n".encode())))
    assert one(words.tokens_utf16(F.lit("😀" * 3))) == 2 and one(words.half_up(F.lit(-0.0005), 3)) == 0 and one(words.half_up(F.lit(-0.0015), 3)) == -0.001
    assert one(words.retry_seconds(F.lit(3), F.lit(5000))) == 3600 and one(words.prose_faults(F.lit("short"), F.lit(""))) == ["too-short"]
    assert one(words.symbols_in(F.lit("Theme uses loadPart, SessionReceipt and MAX_SIZE, loadPart"))) == ["loadPart", "SessionReceipt", "MAX_SIZE"]
    assert one(words.convention(F.lit("API response JSON keys use camelCase"))) == "camelCase" and one(words.bare_name(F.lit('public."Users"'))) == "users"
    assert [one(words.summary_state(F.lit(s), F.lit(a), F.lit(b))) for s, a, b in ((" ", "x", "x"), ("s", "", "x"), ("s", "x", "x"), ("s", "x", "y"))] == ["missing", "unknown", "current", "stale"]


def test_endings_are_tried_once_for_a_place(spark, monkeypatch):
    asked = []
    plain = resolve.first_known
    monkeypatch.setattr(resolve, "first_known", lambda rows, *a: asked.append(rows.count()) or plain(rows, *a))
    imports = spark.createDataFrame([(f"src/f{i}.ts", "./lib") for i in range(40)], "path string, specifier string")
    got = resolve.script_targets(imports, spark.createDataFrame([("src/lib.ts",), ("src/lib/index.ts",)], "path string")).collect()
    assert asked == [1] and {r.target for r in got} == {"src/lib.ts"} and len(got) == 40


def test_candidates_are_not_broadcast(spark):
    rows = spark.range(100).select(F.concat(F.lit("/ci/a/b/"), F.col("id").cast("string"), F.lit(".ts")).alias("reported"))
    found = resolve.reported_paths(rows, rows.select(F.substring("reported", 7, 50).alias("path")))
    assert found.where("path is not null").count() == 100
    assert "SortMergeJoin [target" in found._jdf.queryExecution().executedPlan().toString()
