import pytest

from arcweft.operators import problems
from arcweft.operators.enforce import enforce
from arcweft.operators.graph import edges_of, vertices_of
from arcweft.plans.rulebooks import RuleConfigError, RulebookError, load_rulebooks, read_rulebooks

IMPORTS = [
    ("@/app/login", 0, "react", "import r from 'react'"), ("@/app/login", 1, "@/ui/button", " import b from '@/ui/button'; "),
    ("@/ui/button", 0, "react", "import r from 'react'"), ("@/ui/button", 1, "@/domain/user", "import u from '@/domain/user'"), ("@/domain/user", 0, "react", "  import r from 'react'\n"),
]


def run(spark, rules, imports=IMPORTS, modules=None):
    df = spark.createDataFrame([(m, f"/{m}.ts", o, t, raw) for m, o, t, raw in imports], "module_id string, path string, ord int, target string, raw_statement string")
    ids = modules or sorted({m for m, *_ in imports})
    mods = spark.createDataFrame([(m, f"/{m}.ts") for m in ids], "module_id string, path string")
    edges = edges_of(df)
    books = read_rulebooks([("b.yaml", "id: book\nname: Book\nrules:\n" + rules)])
    return enforce(mods, df, edges, vertices_of(edges, mods), books)


def test_direct_forbids_and_allows(spark):
    got = run(spark, "  - {id: pure, target: '@/domain/**', description: 'd {{TARGET_DIR}}', forbids: [{import: '**'}], allows: [{import: '@/domain/**'}], fix: f}").collect()
    assert [(r.problem_id, r.imported, r.import_statement, r.prose) for r in got] == [("book#pure#@/domain/user", "react", "import r from 'react'", "d @/domain")]


def test_transitive_forbids_name_the_shortest_chain(spark):
    got = run(spark, "  - {id: t, target: '@/app/**', forbids: [{import: '@/domain/**', transitive: true}]}").collect()
    assert [(r.chain, r.first_import) for r in got] == [(["@/app/login", "@/ui/button", "@/domain/user"], "import b from '@/ui/button';")]


def test_a_module_reaches_itself(spark):
    got = run(spark, "  - {id: t, target: '@/app/**', forbids: [{import: '@/app/**', transitive: true}]}").collect()
    assert [(r.chain, r.first_import) for r in got] == [(["@/app/login"], None)]
    text = problems.formatted(run(spark, "  - {id: t, target: '@/app/**', forbids: [{import: '@/app/**', transitive: true}]}")).first().text
    assert "(0 hops) via: @/app/login." in text


def test_uses_and_exists(spark):
    got = run(spark, "  - {id: u, target: '@/{{layer-name}}/*', uses: [{import: '@/domain/*'}, {import: 'react', transitive: true}], exists: [{module: '@/{{layer-name}}/index'}, {module: 'react'}]}")
    rows = sorted((r.bad_module, r.kind_ord, r.required_import, r.required_module) for r in got.collect())
    assert rows == [
        ("@/app/login", 2, "@/domain/*", None), ("@/app/login", 3, None, "@/app/index"), ("@/domain/user", 2, "@/domain/*", None), ("@/domain/user", 3, None, "@/domain/index"), ("@/ui/button", 3, None, "@/ui/index"),
    ]


def test_exclude_and_unrelated_allows(spark):
    assert run(spark, "  - {id: e, target: '@/**', exclude: ['@/ui/*', '@/domain/*'], forbids: [{import: react}]}").count() == 1
    assert run(spark, "  - {id: e, target: '@/**', allows: [{import: react}]}").count() == 0


def test_widened_and_narrow_spellings(spark):
    imports = [("@/f/AWSS3Client", 0, "@/t/aws-s3-client", "a"), ("@/f/AWSS3Client", 1, "@/t/awss3-client", "b")]
    both = run(spark, "  - {id: w, target: '@/f/{{FileName}}', forbids: [{import: '@/t/{{file-name}}'}]}", imports)
    assert both.count() == 2
    one = run(spark, "  - {id: w, target: '@/f/{{FileName}}', forbids: [{import: '@/t/*'}], allows: [{import: '@/t/{{file-name}}'}]}", imports)
    assert [r.imported for r in one.collect()] == ["@/t/aws-s3-client"]


def test_wildcards_in_exists_only_matter_on_a_match(spark):
    assert run(spark, "  - {id: x, target: '@/none/*', exists: [{module: '@/a/*'}]}").count() == 0
    with pytest.raises(RuleConfigError, match="Rule 'x' in rulebook 'book': 'exists' patterns must not contain wildcards"):
        run(spark, "  - {id: x, target: '@/app/*', exists: [{module: '@/a/*'}]}")


def test_rulebook_errors_come_together(tmp_path):
    assert load_rulebooks(str(tmp_path / "none")) == []
    (tmp_path / "a.yaml").write_text("id: a\nname: A\nrules:\n - id: r\n   target: '@/{{provider}}'\n   exclude: ['../x']\n   forbids: [{import: '@/{{no-thing}}'}]\n - id: s\n   target: x\n   uses: [{import: '@/{{some-nam}}'}]\n")
    (tmp_path / "b.yaml").write_text("name: no id")
    (tmp_path / "c.txt").write_text("id: c\nname: C\nrules: [{id: ok, target: '**', unknown: 1}]\n")
    (tmp_path / "d").mkdir()
    with pytest.raises(RulebookError) as e:
        load_rulebooks(str(tmp_path))
    text = str(e.value)
    assert text.startswith("Could not load 3 rulebooks.\n\n") and "rule 'r'\n    target: \"@/{{provider}}\"" in text and 'exclude: "../x"' in text and "no-thing" not in text
    assert "uses.import: \"@/{{some-nam}}\"" in text and "Variables bound by this rule's target: (none)" in text and "missing field `id`" in text


def test_compaction(spark):
    base = {"type_ord": 1, "rulebook_id": "b", "rule_id": "r", "bad_module": "m", "prose": "p", "kind_ord": 1, "rule_fix": "f", "first_import": "i"}
    chains = [["m", "x", "z"], ["m", "y"], ["m", "x"], ["m", "y"]]
    rows = [{**base, "chain": c, "also_reached": [], "seq": [0, i]} for i, c in enumerate(chains)]
    found = problems.shaped(spark.createDataFrame([dict(r) for r in rows], "type_ord int, rulebook_id string, rule_id string, bad_module string, prose string, kind_ord int, rule_fix string, first_import string, chain array<string>, also_reached array<array<string>>, seq array<int>"))
    once = problems.compacted(found)
    row = once.first()
    assert once.count() == 1 and row.chain == ["m", "x"] and row.also_reached == [["m", "y"], ["m", "y"], ["m", "x", "z"]]
    again = problems.compacted(once).first()
    assert (again.chain, again.also_reached) == (row.chain, row.also_reached)
    text = problems.formatted(once).first().text
    assert text == "# b#r#m\np\n\nModule 'm' transitively imports 'x' (1 hop) via: m → x.\n```ts\ni\n```\nAlso reaches 3 more forbidden modules, through the import of 'y'.\nFIX: f"


def test_order_counts_and_baseline(spark):
    found = run(spark, "  - {id: e, target: '@/**', forbids: [{import: react}]}")
    assert [r.bad_module for r in problems.ordered(found).collect()] == ["@/app/login", "@/domain/user", "@/ui/button"]
    accepted = spark.createDataFrame([("book#e#@/ui/button",), ("book#e#@/ui/button",)], "problem_id string")
    left = problems.suppressed(found, accepted)
    assert problems.counts(left).first() == (2, 0)
    assert [r[0] for r in problems.baseline_ids(found.union(found)).collect()] == ["book#e#@/app/login", "book#e#@/domain/user", "book#e#@/ui/button"]
    assert problems.compacted(problems.none(spark)).count() == 0


def test_plain_rules_need_no_matcher(spark, monkeypatch):
    from arcweft.operators import enforce as module
    from arcweft.plans.rulebooks import read_rulebooks

    text = """
id: b
name: B
rules:
  - {id: kebab, target: "@/{{some-name}}/*", description: "{{TARGET_DIR}} of {{some-name}}, {{no-name}}", fix: "{{ {{some-name}}", forbids: [{import: "@/x/**"}], exists: [{module: "@/y"}]}
  - {id: none, target: "**", exclude: ["@/b/**"], description: d, fix: f, uses: [{import: "@/*", transitive: "true"}]}
"""
    rules = module.Ruleset.of(read_rulebooks([("b.yaml", text)]))
    modules = spark.createDataFrame([(m, m + ".ts") for m in ("@/a-b/c", "@/b/c", "top", "@/a-b/c/d", "@/A/c")], "module_id string, path string")
    columns = ["module_id", "path", "rule_no", "prose", "fix", "clauses"]
    expected = sorted(module.matches(modules, rules).select(*columns).collect(), key=str)
    assert len(expected) > 4

    def fail(*_):
        raise AssertionError("left the JVM")

    monkeypatch.setattr(module, "matches", fail)
    assert sorted(module.targeted(modules, rules).collect(), key=str) == expected
