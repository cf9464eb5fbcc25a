"""Whole runs over files, and the resident engine."""

import json

from pyspark.sql import functions as F

from refrain import __main__ as cli
from refrain import engine
from refrain.operators import baseline, detect, stats
from refrain.reports import writers
from refrain.sources.options import Options
from refrain.sources.stores import get_store

BODY = "function add(a, b) {\n  // sums\n  const c = a + b;\n  return c * 2;\n}\nlet x = add(1, 2);\n"


def tree(tmp_path):
    for name, text in (("one/a.js", BODY), ("one/b.js", BODY + "done();\n"), ("two/c.ts", BODY.replace("(a, b)", "(a: number, b: number)")), ("two/d.vue", f"<template><p>\n</p></template>\n<script>\n{BODY}</script>\n"), ("two/e.py", "x = 1\ny = 2\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def pairs(result):
    return {(r.a_id, r.b_id) for r in result.clones.collect()}


def test_runs(spark, tmp_path):
    root = tree(tmp_path)
    base = {"min_tokens": 15, "min_lines": 2}
    assert pairs(engine.run(spark, Options(paths=[root], **base))) == {("one/a.js", "one/b.js"), ("one/a.js", "two/d.vue:javascript")}
    crossed = engine.run(spark, Options(paths=[root], cross_formats=[["javascript", "typescript"]], **base))
    assert ("one/a.js", "two/c.ts") in pairs(crossed)
    assert pairs(engine.run(spark, Options(paths=[f"{root}/one", f"{root}/two"], skip_local=True, **base))) == {("a.js", "d.vue:javascript")}
    assert pairs(engine.run(spark, Options(paths=[root], skip_isolated=[["one", "two"]], **base))) == {("one/a.js", "one/b.js")}
    assert pairs(engine.run(spark, Options(paths=[root], **base), extensions=engine.Extensions(validators=[lambda: F.col("b_id") != "one/b.js"]))) == {("one/a.js", "two/d.vue:javascript")}
    assert pairs(engine.run(spark, Options(paths=[root], min_tokens=10, min_lines=2), extensions=engine.Extensions(mode=lambda: F.col("kind") == "identifier")))


def test_secondary_clones_are_in_runs(spark):
    """c repeats S T; its run starts with S, which ends a, and is dropped; the secondary run of b and c has T."""
    part = lambda x: "\n".join(f"{x}{i} = {x}{i + 1}" for i in range(12)) + "\n"
    texts = {"a.py": part("p") + part("s"), "b.py": part("q") + part("s") + part("t"), "c.py": part("s") + part("t")}
    sources = spark.createDataFrame([(k, "r", "python", v, len(v)) for k, v in texts.items()], "source_id string, root string, format string, content string, bytes long")
    options = Options(min_tokens=15, min_lines=2)
    got = engine.run(spark, options, sources)
    assert pairs(got) == {("a.py", "b.py"), ("b.py", "c.py")}
    assert got.statistics.where("pool = '*'").first().clones == 2
    assert pairs(engine.run(spark, Options(min_tokens=15, min_lines=2, skip_local=True), sources)) == set()


def test_extensions(spark, tmp_path):
    told = []
    got = engine.run(spark, Options(paths=[tree(tmp_path)], min_tokens=15, min_lines=2), extensions=engine.Extensions(subscribers=[lambda name, x: told.append(name)]))
    assert got.clones.count() == 2 and got.observed()["clones"] == 2 and told == ["planned"]
    judged = detect.validated(got.clones, {"not long": F.col("tokens") > 1000, "named": F.col("pool").isNotNull()})
    assert {tuple(r.messages) for r in judged.collect()} == {("not long",)}
    levels = {(r.level, r.source_id): r for r in stats.statistics_levels(stats.source_sizes(got.arrays), got.clones).collect()}
    assert levels["total", None].clones == 2 and levels["source", "one/a.js"].clones == 2 and levels["source", "one/b.js"].clones == 1
    blame = spark.createDataFrame([("one/a.js", 1, "ann"), ("one/b.js", 1, "bob")], "source_id string, line int, author string")
    assert ("ann", "bob") in {(r.a_author, r.b_author) for r in detect.with_blame(got.clones, blame).collect()}
    assert get_store("nonesuch")(got.clones, None) is got.clones
    (tmp_path / ".gitignore").write_text("two/\n")
    assert pairs(engine.run(spark, Options(paths=[str(tmp_path)], min_tokens=15, min_lines=2))) == {("one/a.js", "one/b.js")}


def test_gates(spark, tmp_path):
    options = Options(paths=[tree(tmp_path)], min_tokens=15, min_lines=2, threshold=1.0, exit_code=3)
    got = engine.run(spark, options)
    assert got.exit_code(options) == 1
    options.threshold = None
    assert got.exit_code(options) == 3
    accepted = baseline.build(baseline.fingerprints(got.clones, got.arrays))
    again = engine.run(spark, options, accepted=accepted)
    options.exit_code = 0
    assert again.exit_code(options, 0) == 0 and engine.run(spark, options, accepted=accepted.limit(0)).exit_code(options, 0) == 1


def test_resident(spark, tmp_path):
    e = engine.Engine(spark, Options(paths=[tree(tmp_path)], min_tokens=15, min_lines=2))
    found = e.check_duplication("\n\n" + BODY, "js")
    assert found[0]["source_id"] == "one/a.js" and found[0]["start"] == 3
    assert e.check_duplication("nothing alike", "js") == [] and e.health() == {"status": "ready"}
    assert {r["b_id"] for r in e.get_file_clones("two/d.vue")} == {"two/d.vue:javascript"} and e.get_statistics()
    assert e.check_directory(str(tmp_path / "two"))[0]["sources"] >= 1
    assert engine.overlay(e.index.limit(1), e.index).count() == e.index.count()
    e.close()


def test_command(spark, tmp_path, capsys):
    root = tree(tmp_path)
    assert cli.main(["--min-tokens", "15", "--min-lines", "2", "--reporters", "silent,json", "--output", str(tmp_path / "out"), root], spark) == 0
    assert capsys.readouterr().out.startswith("2 clones") and (tmp_path / "out/duplication-json.json").exists()
    args = ["--min-tokens", "15", "--min-lines", "2", "--silent", "--baseline", str(tmp_path / "base.json")]
    assert cli.main([*args, "--update-baseline", f"{root}/one"], spark) == 0 and "1 added, 0 removed, 1 in all" in capsys.readouterr().out
    assert cli.main([*args, "--fail-on-new-clones", "--", f"{root}/one"], spark) == 0
    assert cli.main([*args, "--fail-on-new-clones", "--summary", "--reporters", "console-full", root], spark) == 1
    assert "Summary by tokens" in capsys.readouterr().out
    assert cli.main(["--min-tokens", "15", "--min-lines", "2", "--silent", "--baseline-from", root, "--fail-on-new-clones", "0", root], spark) == 0
    assert cli.main(["--list"]) == 0 and "rust" in capsys.readouterr().out
    assert cli.main(["--debug", "x"]) == 0 and "paths=['x']" in capsys.readouterr().out


def test_reports_hold_every_clone(spark, tmp_path):
    lined = spark.range(10_050).selectExpr("'python' AS pool", "concat('a', id) AS a_id", "concat('b', id) AS b_id", "1 AS a_start", "5 AS a_end", "2 AS b_start", "6 AS b_end", "50L AS tokens")
    sizes = spark.createDataFrame([("*", 2, 9, 90, 10_050, 5, 50, 55.5, 55.5)], "pool string, sources long, lines long, tokens long, clones long, duplicated_lines long, duplicated_tokens long, percentage double, percentage_tokens double")
    paths = {p.rpartition("-")[2].partition(".")[0]: open(p).read() for p in writers.write(["json", "xml", "sarif", "html"], lined, sizes, str(tmp_path))}
    assert len(json.loads(paths["json"])["duplicates"]) == len(json.loads(paths["sarif"])["runs"][0]["results"]) == 10_050
    assert paths["xml"].count("<duplication ") == 10_050 == paths["html"].count("<li>")
    assert "7 of 10050 clones shown" in writers.report("console", lined, sizes, limit=7)
    assert json.loads("".join(writers.pieces("json", lined.limit(0), sizes)))["duplicates"] == []
