import pytest

from arcweft.operators import parse, resolve
from arcweft.sources import aliases, ignore
from arcweft.sources.aliases import AliasPattern, ConfigError, parse_alias, parse_config, strip_comments
from arcweft.sources.project import local_files, modules_of, stored_files

IGNORED = [
    # lines of the top ignore file, path, is_dir, whether it is ignored
    ("*.log", "a/b.log", False, True), ("*.log\n!important.log", "a/important.log", False, False), ("/x", "x", False, True), ("/x", "a/x", False, False),
    ("src/**/tmp/", "src/a/b/tmp/c.ts", False, True), ("src/**/tmp/", "src/tmp", False, False), ("src/**/tmp/", "src/tmp", True, True), ("a/**", "a", True, False), ("a/**", "a/b", False, True),
    ("[!a].ts", "b.ts", False, True), ("[!a].ts", "a.ts", False, False), ("[[:digit:]].ts", "7.ts", False, True), ("[a-c]x", "bx", False, True), ("[a-", "[a-", False, True), ("[]]x", "]x", False, True),
    ("a\\ ", "a ", False, True), ("a ", "a", False, True), ("# c\n\n\\#x", "#x", False, True), ("?.ts", "ab.ts", False, False), ("build", "x/build/y.ts", False, True), ("", "node_modules/x.ts", False, True),
    ("!node_modules", "node_modules/x.ts", False, True), ("foo/", "foo", False, False), ("foo/", "foo/bar", False, True), ("a\\", "a\\", False, True), ("**/z", "z", False, True), ("**/z", "p/q/z", False, True),
    ("[[:upper:][:digit:]]?", "Aé", False, True), ("[^[:alpha:]]", "-", False, True), ("[^[:alpha:]]", "é", False, False), ("a*c", "a/c", False, False), ("x.y", "xzy", False, False),
]


def test_ignore_rules(spark):
    for lines in dict.fromkeys(x[0] for x in IGNORED):
        cases = [x for x in IGNORED if x[0] == lines]
        paths = spark.createDataFrame([(p, d) for _, p, d, _ in cases], "path string, is_dir boolean")
        got = {r.path for r in ignore.ignored(paths, ignore.rules_from(spark, {"": lines})).collect()}
        for _, p, d, expected in cases:
            if len([x for x in cases if x[1] == p]) == 1:
                assert (p in got) == expected, (lines, p, d)


def test_deeper_ignore_files_come_last(spark):
    rules = ignore.rules_from(spark, {"": "*.gen.ts\n", "a/b": "!keep.gen.ts\n"})
    paths = spark.createDataFrame([("a/b/keep.gen.ts", False), ("a/keep.gen.ts", False), ("a/b/c/keep.gen.ts", False), ("x.ts", False)], "path string, is_dir boolean")
    assert sorted(r.path for r in ignore.ignored(paths, rules).collect()) == ["a/keep.gen.ts"]


def test_project_scan(spark, tmp_path):
    for path, text in {"src/a/inner.ts": "a", "src/a.ts": "b", "src/z/late.tsx": "c", "src/x.js": "", "src/d.d.ts": "", "node_modules/m.ts": "", "gen/g.ts": "", ".gitignore": "gen/\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "src/bad.ts").write_bytes(b"\xff\xfe")
    for files in (local_files(spark, str(tmp_path)), stored_files(spark, str(tmp_path))):
        found = {r.path: r.content for r in modules_of(files, tmp_path.name).collect()}
        assert found == {"src/a/inner.ts": "a", "src/a.ts": "b", "src/z/late.tsx": "c", "src/d.d.ts": "", "src/bad.ts": None}
        order = sorted(found, key=lambda p: p.split("/"))
        assert order[:2] == ["src/a/inner.ts", "src/a.ts"]
        assert modules_of(files, "build").count() == 0


def test_alias_patterns():
    assert AliasPattern.parse("") is None and AliasPattern.parse("a/*/*") is None
    assert AliasPattern.parse("@/data/*-dto") == AliasPattern("@/data/", "-dto")
    assert AliasPattern("@/", "-x").capture("@/a-x") == "a" and AliasPattern("ab", "b").capture("ab") is None
    assert parse_alias("@/*", ["./././src/*", "x/*/*"]).values == (AliasPattern("src/", ""),)
    assert parse_alias("exact", ["src/*"]) is None
    assert parse_alias("exact", ["src/*", "./src/one"]).values == (AliasPattern("src/one"),)


def test_config():
    text = '{ // c\n "compilerOptions": {"baseUrl": "web", "paths": {"@/*": ["src/*"], "@/lib/*": ["lib/*"], "@lib": ["lib/index"]}, "x": "// kept" /* gone */ } }'
    config = parse_config(text, "/p")
    assert config.base_url == "/p/web" and [a.key.before for a in config.aliases] == ["@lib", "@/lib/", "@/"]
    assert parse_config("{}", "/p").base_url == "/p/." and parse_config('{"compilerOptions": {"baseUrl": "/abs"}}', "/p").base_url == "/abs"
    assert strip_comments('{"a": "/* no */ // no"}/* yes */') == '{"a": "/* no */ // no"}'
    for bad in ('{"a": "', "{} /* x", "{,}", "[]x", '{"a": 1,}'):
        with pytest.raises(ConfigError):
            parse_config(bad, "/p")


CONFIG = parse_config('{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@ui": ["src/ui/index"], "#gen/*": ["gen/*", "src/gen/*"]}}}', "/home/repo")


def test_module_ids(spark):
    cases = {
        "/home/repo/src/lib/util.tsx": "@/lib/util", "/home/repo/src/lib/index.ts": "@/lib/index", "/home/repo/src/types.d.ts": "@/types", "/home/repo/src/ui/index.ts": "@ui", "/home/repo/other/a.ts": "/home/repo/other/a",
        "/home/x/a.ts": "/home/x/a", "/home/repo/gen/a.ts": "#gen/a", "/home/repo/src/a.test.ts": "@/a.test", "/home/repo/src/noext": "@/noext",
    }
    rows = resolve.module_ids(spark.createDataFrame([(p,) for p in cases], "path string"), CONFIG).collect()
    assert {r.path: r.module_id for r in rows} == cases


def test_canonical_targets(spark):
    files = ["/home/repo/src/a/one.ts", "/home/repo/src/lib/index.ts", "/home/repo/src/b.tsx", "/home/repo/src/gen/g.ts", "/home/repo/out/z.ts"]
    cases = {
        ("/home/repo/src/a/one.ts", "../b"): "@/b", ("/home/repo/src/a/one.ts", "../lib"): "@/lib/index", ("/home/repo/src/a/one.ts", "@/lib"): "@/lib", ("/home/repo/src/a/one.ts", "react"): "react",
        ("/home/repo/src/a/one.ts", "./missing"): "@/a/missing", ("/home/repo/src/a/one.ts", "../../out/z"): "../../out/z", ("/home/repo/src/b.tsx", "./a/one"): "@/a/one", ("/home/repo/src/b.tsx", "#gen/g"): "#gen/g",
        ("/home/repo/src/b.tsx", "."): ".", ("/home/repo/src/a/one.ts", ".."): "..",
    }
    imports = spark.createDataFrame([(p, t) for p, t in cases], "path string, target string")
    got = {(r.path, r.target): r.canonical for r in resolve.canonical(imports, spark.createDataFrame([(f,) for f in files], "path string"), CONFIG).collect()}
    assert {k: v for k, v in got.items() if k[1] not in (".", "..")} == {k: v for k, v in cases.items() if k[1] not in (".", "..")}
    assert len(got) == len(cases)


LEXED = {
    "import { foo } from 'bar';": ["bar"], "ximport y from 'z'": ["z"], "export { a } from 'b'": [], "require('x')": [], "import('x')": ["x"], "import.meta.url === 'foo'": ["foo"], "import(`x`)": [],
    "import a,\n{b} from 'c'": [], "import a from 'a' // c\nimport b from 'b'\n": ["a"], "import a from 'a'; // c\nimport b from 'b'\n": ["a", "b"], "import {\n a,\n b\n} from \"c\";": ["c"], "// import x from 'y'\n": [],
    "/* import x from 'y' */ import z from 'q'": ["q"], "/* import x from 'y'": ["y"], "import ''": [], "import 'a": ["a"], "import }x from 'y'": [], "import a from 'it\\'s'": ["it\\"], "const s = \"import k from 'm'\"": ["m"],
}


@pytest.mark.parametrize("text", LEXED)
def test_lexer(text):
    assert [n.target for n in parse.parse(text) if n.target is not None] == LEXED[text]
    assert "".join(t.raw for t in parse.lex(text)) == text


def test_nodes_render_losslessly(spark):
    texts = [*LEXED, "", "plain", "import a from 'x';\r\n\timport b from 'y';é"]
    files = spark.createDataFrame([(f"/f{i}.ts", t) for i, t in enumerate(texts)] + [("/null.ts", None)], "path string, content string")
    got = {r.path: r.content for r in parse.rendered(parse.nodes(files)).collect()}
    assert got == {f"/f{i}.ts": t for i, t in enumerate(texts)}
    assert parse.nodes(files.limit(0)).count() == 0


def test_line_parser_edges():
    assert ignore.parse_line("") is None and ignore.parse_line("!") is None and ignore.parse_line("/") is None
    assert ignore.parse_line("a/").dir_only and ignore.parse_line("a/b").anchored and not ignore.parse_line("a/").anchored
    assert aliases.AliasPattern("a").put("zz") == "a"
