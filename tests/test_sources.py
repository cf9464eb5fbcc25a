"""Files, formats, options, code tokens, reports and streams."""

import json

import pytest
from pyspark.sql import functions as F

from refrain.functions import scalars
from refrain.operators import code, detect, stats
from refrain.operators.tokens import token_arrays
from refrain.reports import rows, writers
from refrain.sources import files, formats, options, paths, tables
from refrain.streaming import probes


def test_formats():
    assert formats.resolve_format("golang") == "go" and len(formats.EXTENSIONS) > 200 and formats.FORMATS[0] == "actionscript"
    assert len(formats.list_formats()) == 224
    assert formats.resolve_format("JS") == "javascript" and formats.resolve_format("tf") == "hcl" and formats.resolve_format("nonesuch") is None


def test_walk(spark, tmp_path):
    for name, text in (("a/x.py", "a\nb\nc\n"), ("a/y.txt", "a\n"), ("a/run", "#!/usr/bin/env python3\na\nb\n"), ("b/z.js", "a\nb\nc\n"), ("b/skip.js", "a\nb\nc\n"), ("b/big.js", "a\n" * 600)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "b/bad.js").write_bytes(b"\xff\xfe\n\n\n\n")
    got = files.scan(spark, options.Options(paths=[str(tmp_path)], min_lines=2, max_size="1kb", ignore=["skip.*"]))
    assert {(r.source_id, r.format) for r in got.collect()} == {("a/x.py", "python"), ("a/run", "python"), ("b/z.js", "javascript")}
    got = files.scan(spark, options.Options(paths=[str(tmp_path)], min_lines=2), paths.gitignore_rules("b/*\n!b/z.js\n*.txt"))
    assert {r.source_id for r in got.collect()} == {"a/x.py", "a/run", "b/z.js"}
    got = files.scan(spark, options.Options(paths=[str(tmp_path)], min_lines=2), paths.gitignore_rules("b/\n!b/z.js"))
    assert {r.source_id for r in got.collect()} == {"a/x.py", "a/run"}  # nothing in an ignored folder comes back


def test_globs():
    import re

    test = lambda g, p: bool(re.match(paths.glob_regex(g), p))
    assert test("*.js", "a/b.js") and test("**/x/*.{js,ts}", "q/x/a.ts") and not test("/x.js", "a/x.js") and test("a?[!b].c", "aac.c")


def test_options(tmp_path):
    assert options.parse_size("1.5kb") == 1536 and options.parse_size("2M") == 2 * 1024**2
    with pytest.raises(ValueError):
        options.parse_size("many")
    assert options.parse_mappings("a:x,y;b:z") == {"x": "a", "y": "a", "z": "b"}
    assert options.parse_groups("a,b;b,c;d,e") == [["a", "b", "c"], ["d", "e"]]
    assert options.parse_isolation("a|b,c,d|e|f") == [["a", "b"], ["d", "e", "f"]]
    (tmp_path / "c.json").write_text(json.dumps({"minTokens": 7, "paths": "src", "ignore": "a,b", "noSkipLocal": False, "odd": 1}))
    got, warned = options.load({"min_lines": 2}, str(tmp_path / "c.json"))
    assert (got.min_tokens, got.min_lines, got.paths, got.ignore, got.skip_local) == (7, 2, [str(tmp_path / "src")], ["a", "b"], True) and warned == ["unknown option 'odd'"]
    (tmp_path / "d.json").write_text(json.dumps({"minTokens": "x"}))
    with pytest.raises(TypeError):
        options.load(None, str(tmp_path / "d.json"))
    with pytest.raises(FileNotFoundError):
        options.load(None, str(tmp_path / "none.json"))


def lexed(text, fmt, **kw):
    return [(k, v) for k, v, _ in code.lex(text, fmt) if k != "whitespace"]


def test_lexer():
    assert lexed("x = 'a\\'b' # c\n", "python") == [("identifier", "x"), ("punctuation", "="), ("literal", "'a\\'b'"), ("comment", "# c")]
    assert lexed("/*a\nb */c", "c") == [("comment", x) for x in ("/*", "a", "b", " ", "*/")] + [("identifier", "c")]
    assert lexed("/* a */ c", "javascript")[0] == ("comment", "/* a */") and ("punctuation", "&&") in lexed("a && b", "javascript")
    assert lexed("x = 'open\ny", "java")[2:] == [("literal", "'open"), ("identifier", "y")] and lexed("-- x", "sql") == [("comment", "-- x")]
    assert ("literal", "/a[/]b/g") in lexed("x = /a[/]b/g.test(y) / 2", "javascript") and ("punctuation", "/") in lexed("a / b", "javascript")
    assert lexed("`a ${b}`", "javascript") == [("literal", "`a ${b}`")]
    for text in ("", "\0", "/*", "'", "`", "é'\n\"", "---\n"):
        for fmt in ("javascript", "python", "markdown", "vue", "razor", "txt", "nonesuch"):
            for f, part, _ in code.sections(text, fmt):
                assert "".join(v for _, v, _ in code.lex(part, f)) == part


def test_sections():
    md = "---\nk: v\n---\ntext\n```js\nlet a\n```\nmore\n~~~\nraw\n~~~\n"
    assert [(f, t.strip()) for f, t, _ in code.sections(md, "markdown")][:3] == [("yaml", "k: v"), ("javascript", "let a"), ("text", "raw")]
    vue = '<template><p/></template>\n<script lang="ts">let a: number</script><style>a{}</style>'
    assert [f for f, _, _ in code.sections(vue, "vue")] == ["markup", "typescript", "css", "markup"]
    assert all(vue[at : at + len(t)] == t for f, t, at in code.sections(vue, "vue")[:3])
    assert ("csharp", " int x = 1; ") in [(f, t) for f, t, _ in code.sections("<p>@{ int x = 1; }</p>", "razor")]


def test_types_are_erased():
    assert code.erase_types("const a: number = b as string;").split() == ["const", "a", "=", "b", ";"]
    assert code.erase_types("interface A { b: c }\nlet x!").split()[0] == "let"


def test_code_tokens(spark):
    text = "a\n// refrain:ignore-start\nb\n// refrain:ignore-end\nc é d import x"
    df = spark.createDataFrame([(1, "javascript", text), (2, "python", None)], "source_id long, format string, content string")
    got = code.tokens(df, ignore_pattern=["import.*", "("]).collect()
    assert [(r.value, r.line, r.col) for r in got] == [("a", 1, 0), ("c", 5, 0), ("é", 5, 2), ("d", 5, 5)]
    assert code.section_arrays(df).count() == 1


def test_blame(spark):
    text = "a" * 40 + " 1 1 1\nauthor Ann B\nauthor-mail <a@x>\nauthor-time 5\nfilename f\n\tx\n" + "b" * 40 + " 2 2\nauthor Bob\nauthor-time 9\n\ty\n"
    got = files.parse_blame(spark.createDataFrame([("f", text)], "source_id string, porcelain string")).collect()
    assert [(r.line, r.author, r.ts) for r in got] == [(1, "Ann B", 5), (2, "Bob", 9)]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert [get(scalars.human_size(F.lit(n))) for n in (5, 2048, 3 * 1024**2)] == ["5 B", "2.0 KB", "3.0 MB"]
    assert get(scalars.xml_escape(F.lit("<a&'"))) == "&lt;a&amp;&apos;" and get(scalars.cdata(F.lit("a]]>b"))) == "<![CDATA[a]]]]><![CDATA[>b]]>"
    assert get(scalars.parent_dir(F.lit("a/b/c"))) == "a/b" and get(scalars.parent_dir(F.lit("c"))) == "."
    assert get(scalars.clean_id(F.lit("a/b.vue:css"))) == "a/b.vue" and get(scalars.clean_id(F.lit("C:x"))) == "C:x"
    assert get(scalars.relative_to(F.lit("/r/a/b"), "/r/a")) == "b" and get(scalars.fingerprint_text(F.lit(-1).cast("long"))) == "f" * 16
    assert get(scalars.label_escape(F.lit('a"\n'))) == 'a\\"\\n' and get(scalars.badge_color(F.lit(10.5))) == "amber"


def test_reports(spark, tmp_path):
    text = "one two three\nfour five six\nseven eight nine"
    own = token_arrays(spark.createDataFrame([(1, "p", text), (2, "p", text)], "source_id long, pool string, content string"))
    lined = detect.with_lines(detect.clones(own, 5), own)
    stat = stats.statistics(stats.source_sizes(own), lined)
    kinds = ["json", "xml", "csv", "markdown", "html", "sarif", "openmetrics", "badge", "ai", "xcode", "console", "silent"]
    texts = {k: open(p).read() for k, p in zip(kinds, [p for p in writers.write(kinds, lined, stat, str(tmp_path)) if "clones" not in p], strict=True)}
    made = json.loads(texts["json"])["duplicates"][0]
    assert (made["lines"], made["tokens"], made["firstFile"]["name"]) == (3, 9, "1")
    assert json.loads(texts["sarif"])["runs"][0]["results"][0]["level"] == "warning"
    assert json.loads(writers.report("sarif", lined, stat, cutoff=9))["runs"][0]["results"][0]["level"] == "error"
    assert '<duplication lines="2" tokens="9">' in texts["xml"] and texts["csv"].splitlines()[1].startswith("Total:,2,6,18,1,2,9")
    assert texts["openmetrics"].endswith("# EOF\n") and 'duplication_clones{format="p"} 1.0' in texts["openmetrics"] and "# TYPE duplication_clones gauge" in texts["openmetrics"]
    found = rows.with_fragments(lined, spark.createDataFrame([(1, text), (2, text)], "source_id long, content string"))
    assert json.loads(writers.report("json", found, stat))["duplicates"][0]["fragment"] == text and "<codefragment><![CDATA[one" in writers.report("xml", found, stat)
    assert "one two three" in writers.report("console-full", found, stat) and len(writers.badges(stat)) == 2
    first, folders = stats.summary(spark.createDataFrame([("1", "x", 3, 9, 40, 1), ("2", "y", 3, 9, 40, 2)], "path string, folder string, lines long, tokens long, bytes long, complexity long"), lined, "complexity", 1)
    assert first.first().path == "2" and first.first().duplicated_lines == 2 and folders.first().folder == "y" and "40" in writers.summary_block(first, folders, "complexity")
    assert writers.compressed("src/a/x.js", "src/a/y.js") == "src/a/{x.js ~ y.js}" and texts["silent"].startswith("1 clones")
    assert writers.exceeds(stat, 30) and not writers.exceeds(stat, 40)


def test_streams(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(30))
    corpus = token_arrays(spark.createDataFrame([(1, "all", text)], "source_id long, pool string, content string"))
    spark.createDataFrame([(5, " ".join(f"w{i}" for i in range(4, 20))), (6, "nothing here")], "item_id long, text string").write.parquet(str(tmp_path / "in" / "items.parquet"))
    got = probes.run_once(spark, str(tmp_path / "in" / "items.parquet" / "part-*"), corpus, 8).collect()
    assert [tuple(r) for r in got] == [(5, 0, 1, 4, 16)]
    items = spark.readStream.schema("item_id long, text string").parquet(str(tmp_path / "in" / "items.parquet")).select(F.col("item_id").alias("source_id"), F.lit("all").alias("pool"), F.col("text").alias("content"))
    probes.append_index(items, 4, str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
    assert probes.read_index(spark, str(tmp_path / "index")).count() == 13
    timed = items.withColumn("ts", F.current_timestamp())
    q = probes.new_windows(timed, 4).writeStream.format("memory").queryName("fresh").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fresh").count() == 13


def test_ignore_files_of_a_tree(spark, tmp_path):
    for name, text in ((".gitignore", "*.log\n/out/\n"), ("sub/.gitignore", "!keep.log\nlocal.py\n"), (".git/info/exclude", "secret.py\n"), ("mine", "own.py\n"), ("a.py", "x"), ("b.log", "x"), ("out/c.py", "x"), ("sub/keep.log", "x"), ("sub/local.py", "x"), ("local.py", "x"), ("sub/secret.py", "x"), ("own.py", "x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    seen = lambda **o: {r.source_id for r in files.scan(spark, options.Options(paths=[str(tmp_path)], min_lines=0, formats_exts={"log": "txt"}, **o)).collect()}
    assert seen(excludes_file=str(tmp_path / "mine")) == {"a.py", "sub/keep.log", "local.py"}
    assert seen(follow_links=True) == {"a.py", "sub/keep.log", "local.py", "own.py", "link.py"}
    assert "b.log" in seen(gitignore=False)
    assert seen(absolute=True) == {f"{tmp_path}/{x}" for x in ("a.py", "sub/keep.log", "local.py", "own.py")}


def test_arrays_are_tokens_in_order(spark):
    texts = [("a", "markdown", "# é title\n```python\nx = 'é'  # note\n```\nmore é\n```python\ny = 2\n```\n"), ("b", "python", "a = 1\nq:ignore-start\nb = 2\nq:ignore-end\nimport os\nc = '😀'; d = 3\n"), ("c", "python", ""), ("d", "python", None)]
    own = spark.createDataFrame(texts, "source_id string, format string, content string")
    for chosen in ({}, {"mode": "strict"}, {"mode": "weak", "ignore_case": True, "ignore_pattern": ["import.*", "("]}):
        want: dict = {}
        for r in sorted(code.tokens(own, **chosen).collect(), key=lambda r: (r.offset, r.pos)):
            want.setdefault((r.source_id, r.format), []).append((r.value, r.line))
        got = {(r.source_id, r.format): list(zip(r["values"], r.lines, strict=True)) for r in code.arrays(own, **chosen).collect()}
        assert got == want and got
    places = {r.value: (r.line, r.col, r.offset) for r in code.tokens(own).where("source_id = 'b'").collect()}
    assert places["d"] == (6, 12, len("a = 1\nq:ignore-start\nb = 2\nq:ignore-end\nimport os\nc = '😀'; ".encode()))


def test_kinds_are_counted_in_small_parts(spark, tmp_path, monkeypatch):
    texts = [("a", "vue", "<script>\nlet a = /x/ // é\n</script>\n<p title='x'>hi /* b\n*/</p>\n<style>p { margin: 0 }</style>"), ("b", "python", "x = 'é'  # note\nq:ignore-start\ny\nq:ignore-end\n"), ("c", "vue", None), ("d", "vue", "")]
    own = spark.createDataFrame(texts, "source_id string, format string, content string")
    for mode in ("strict", "mild", "weak"):
        want = code.tokens(own, mode).groupBy("format", "kind").count().collect()
        assert want and sorted(map(tuple, want)) == sorted(map(tuple, code.kind_counts(own, mode).collect()))
    spark.range(1000).selectExpr("repeat(md5(string(id)), 40) AS content").coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(tables, "SPREAD", 4000)
    assert tables.dealt(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() > 4


def test_scripts_that_cannot_be_lexed():
    assert [x[:2] for x in code.lexed("a = `b c", "javascript") if x[0] != "whitespace"] == [("other", "a"), ("other", "="), ("other", "`"), ("other", "b"), ("other", "c")]
    assert ("other", "x1") in [x[:2] for x in code.lexed("/* x1", "typescript")] and code.lexed("a /* b */ 'c'", "javascript")[-1][:2] == ("literal", "'c'")


def test_display_tokens(spark):
    texts = [("m", "markdown", "one\n```python\nx = 1\n```\ntwo\n"), ("v", "vue", "<template>\n<p>hi</p>\n</template>\n<script>\nlet a\n</script>\n")]
    got = code.display_tokens(spark.createDataFrame(texts, "source_id string, format string, content string")).collect()
    of = lambda s: [(r.value, r.line) for r in sorted(got, key=lambda r: r.pos) if r.source_id == s]
    assert of("m") == [("one", 1), ("x", 3), ("=", 3), ("1", 3), ("two", 5)] and {("hi", 2), ("let", 5), ("a", 5)} <= set(of("v"))
