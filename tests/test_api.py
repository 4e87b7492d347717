import pytest

from arcweft import __main__ as cli
from arcweft import api
from arcweft.plans import report
from arcweft.sources.aliases import ConfigError
from arcweft.streaming.parse import changed_files, keep_latest, latest, stream_imports

FILES = {
    "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["./src/*"]}}} // end',
    "src/a/One.ts": "import { B } from '../b/Two';\nimport r from 'react';\n", "src/b/Two.tsx": "import { A } from '@/a/One';\nimport { C } from '../c';\n", "src/c/index.ts": "export const c = 1;\n",
    "src/build/x.ts": "import q from '../a/One';\n",
    "arcweft/rules/x.yaml": "id: arch\nname: A\nrules:\n  - {id: pure, target: '@/a/{{ModuleName}}', description: '{{ModuleName}}', fix: x, forbids: [{import: '@/c/**', transitive: true}], exists: [{module: '@/tests/{{module-name}}'}]}\n",
}


@pytest.fixture
def project(tmp_path):
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def ids(rows):
    return [r.problem_id for r in rows.collect()]


EXPECTED = ["no-import-cycles#src/a/One.ts", "no-relative-imports#src/a/One.ts", "no-relative-imports#src/b/Two.tsx", "arch#pure#@/a/One", "arch#pure#@/a/One"]


def test_check_fix_and_baseline(spark, project):
    found, run = api.check(spark, str(project))
    assert ids(found) == EXPECTED
    assert (run.modules, run.rules, run.total, run.auto_fixable, run.clean) == (3, 3, 5, 2, False)
    _, run = api.baseline(spark, str(project))
    assert run.total == 5 and (project / "arcweft/baseline.yaml").read_text().count("\n") == 4
    found, run = api.check(spark, str(project))
    assert ids(found) == [] and run.clean
    assert api.fix(spark, str(project))[0] == []  # what the baseline accepts is not rewritten
    (project / "arcweft/baseline.yaml").unlink()
    changed, run = api.fix(spark, str(project))
    assert [c.rsplit("/", 1)[1] for c in changed] == ["One.ts", "Two.tsx"] and run.auto_fixable == 2
    assert (project / "src/a/One.ts").read_text() == "import { B } from '@/b/Two';\nimport r from 'react';\n"
    assert (project / "src/b/Two.tsx").read_text() == "import { A } from '@/a/One';\nimport { C } from '@/c/index';\n"
    assert (project / "src/build/x.ts").read_text() == FILES["src/build/x.ts"]
    assert api.fix(spark, str(project))[0] == []


def test_baselined_relative_imports_stay_out_of_the_graph(spark, project):
    (project / "arcweft/baseline.yaml").write_text("- 'no-relative-imports#src/a/One.ts'\n")
    found, _ = api.check(spark, str(project))
    assert ids(found) == ["no-relative-imports#src/b/Two.tsx", "arch#pure#@/a/One"]


def test_malformed_baselines_count_as_empty(spark, project):
    for text in ("{a: 1}", "- [1]", "\t- x: :", ""):
        (project / "arcweft/baseline.yaml").write_text(text)
        assert api.load_baseline(spark, api.baseline_path(str(project))).count() == 0


def test_baseline_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b#r#@/a b",), ("a: 'x'#1",), ("a: 'x'#1",), ("- q",)], "problem_id string")
    path = str(tmp_path / "h/baseline.yaml")
    assert api.save_baseline(rows, path) == 3
    assert sorted(r.problem_id for r in api.load_baseline(spark, path).collect()) == sorted({"b#r#@/a b", "a: 'x'#1", "- q"})
    assert api.save_baseline(rows.limit(0), path) == 0 and api.load_baseline(spark, path).count() == 0


def test_unreadable_files_are_named_and_are_no_modules(spark, project):
    (project / "src/bad.ts").write_bytes(b"\xff\xfe import x from 'y'")
    _, run = api.check(spark, str(project))
    assert run.modules == 3 and [p.rsplit("/", 1)[1] for p in run.unreadable] == ["bad.ts"]


def test_missing_configuration(spark, tmp_path):
    with pytest.raises(ConfigError, match="tsconfig.json not found"):
        api.check(spark, str(tmp_path))


def test_command_line(spark, project, monkeypatch, capsys):
    monkeypatch.setenv("ARCWEFT_TRANSCRIPT", "1")
    assert cli.main(["check", str(project)]) == 1
    out = capsys.readouterr().out
    assert "[Title] 🚀 Checking project" in out and "Loaded 1 rulebook, 1 rule" in out and "Found 5 problems, 2 of them auto-fixable." in out
    assert cli.main(["fix", str(project)]) == 0
    assert "[Success] ✨ Fixed 2 problems!" in capsys.readouterr().out
    assert cli.main(["baseline", str(project)]) == 0
    assert cli.main(["check", str(project)]) == 0
    assert cli.main(["check", str(project / "src")]) == 1
    assert "tsconfig.json not found" in capsys.readouterr().out


def test_report_texts():
    assert report.summary(report.Run("check", 412, 38), 0.87) == "⏱  Checked 412 modules enforcing 38 rules in 870ms"
    assert report.summary(report.Run("fix", 1, 3), 1.5) == "⏱  Scanned 1 module in 1.50s"
    assert report.found(report.Run("check", 1, 1, 1, 0), "arcweft") == "Found 1 problem, none auto-fixable.\n   Run `arcweft baseline` to silence all 1 problem."
    assert report.fixed(0) == "✨ The project is already clean!"
    assert report.banner([], "arcweft")[0][0] == "Warning"


def test_streamed_changes(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    spark.sql("select '/a.ts' path, \"import x from 'one'\" content, timestamp'2024-01-01' changed union all select '/a.ts', \"import x from 'two'\", timestamp'2024-01-02'").write.parquet(source)
    stream = changed_files(spark, source)
    assert stream_imports(stream).isStreaming
    keep_latest(stream, table, str(tmp_path / "check")).awaitTermination()
    spark.sql("select '/b.ts' path, '' content, timestamp'2024-01-03' changed").write.mode("append").parquet(source)
    keep_latest(changed_files(spark, source), table, str(tmp_path / "check")).awaitTermination()
    assert {r.path: r.content for r in latest(spark, table).collect()} == {"/a.ts": "import x from 'two'", "/b.ts": ""}
