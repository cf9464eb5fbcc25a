"""Registered queries of scalar functions, formats, paths and ignore rules, next to the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from refrain.functions import scalars
from refrain.plans.registry import query
from refrain.sources import formats
from refrain.sources.paths import gitignore_rules, ignored
from refrain.sources.tables import table

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;"))


def _nested(text: str, pairs) -> str:
    for sign, name in pairs:
        text = f"replace({text}, '{sign}', '{name}')"
    return text


@query(f"SELECT page_id, md5({_nested('html', ESCAPES)}) AS escaped FROM pages")
def xml_escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(scalars.xml_escape(F.col("html"))).alias("escaped"))


@query("SELECT page_id, md5('<![CDATA[' || replace(html || ']]>', ']]>', ']]]]><![CDATA[>') || ']]>') AS section FROM pages")
def cdata_sections(spark, sf_dir):
    """Pages, with an end mark inside, as character data."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(scalars.cdata(F.concat("html", F.lit("]]>")))).alias("section"))


@query("SELECT doc_id, md5(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')) AS label FROM documents")
def metric_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(scalars.label_escape(F.col("text"))).alias("label"))


@query("""SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1f MB', floor(n / 1048576.0 * 10 + 0.5) / 10) WHEN n >= 1024 THEN printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) ELSE n || ' B' END AS size FROM (SELECT doc_id, strlen(text) AS n FROM documents)""")
def human_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.human_size(F.octet_length("text")).alias("size"))


@query("SELECT doc_id, least(100.0::DOUBLE, n_chars / 8.0::DOUBLE) AS share, (doc_id % 97) || ':' || (n_chars + 1) AS place FROM documents")
def clamped_and_placed(spark, sf_dir):
    """Shares of at most 100, and places whose columns count from 1."""
    return table(spark, sf_dir, "documents").select("doc_id", scalars.clamped(F.col("n_chars").cast("double") / 8).alias("share"), scalars.location(F.col("doc_id") % 97, F.col("n_chars")).alias("place"))


@query("""SELECT page_id, CASE WHEN regexp_matches(p, '^.+/[^/]*$') THEN regexp_extract(p, '^(.*)/[^/]*$', 1) ELSE '.' END AS folder, regexp_replace(p || ':vue', ':[a-z0-9+-]+$', '') AS path,
    p AS below FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)""")
def page_paths(spark, sf_dir):
    """Folder, path without a section's format, and path below a root of each page."""
    own = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("p"))
    return own.select("page_id", scalars.parent_dir(F.col("p")).alias("folder"), scalars.clean_id(F.concat("p", F.lit(":vue"))).alias("path"), scalars.relative_to(F.concat(F.lit("/site/"), "p"), "/site").alias("below"))


@query("SELECT CASE WHEN l_shipdate < o_orderdate THEN '=>' WHEN o_orderdate < l_shipdate THEN '<=' ELSE '==' END AS side, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def older_sides(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    return both.groupBy(scalars.older_side(F.col("l_shipdate"), F.col("o_orderdate")).alias("side")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, printf('%016x', doc_id * 1000003) AS fingerprint FROM documents")
def fingerprint_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.fingerprint_text(F.col("doc_id") * 1000003).alias("fingerprint"))


@query("SELECT ext, format FROM (VALUES " + ", ".join(f"('{e}', '{f}')" for e, f in sorted(formats.EXTENSIONS.items())) + ") AS v(ext, format)")
def format_registry(spark, sf_dir):
    """Every known extension and its format."""
    return formats.dimension(spark)


LINES = ["#!/usr/bin/env python3", "#!/bin/sh", "#!/usr/bin/env node", "#!/usr/bin/ruby2.7", "#!/bin/bash -e", "#!/usr/local/bin/gawk", "plain text", "#!/usr/bin/perl5"]
_listed = "[" + ", ".join(f"'{x}'" for x in LINES) + "]"
_read = " ".join(f"WHEN starts_with(line, '#!') AND contains(line, '{s}') THEN '{f}'" for s, f in formats.SHEBANGS)
_named = " ".join(f"WHEN name = '{s}' THEN '{f}'" for s, f in formats.INTERPRETERS.items())
_interpreter = r"lower(regexp_extract(line, '^#!\s*(?:(?:\S*/)?env\s+)?(?:\S*/)?([^\s/0-9][^\s/]*?)(?:[0-9]+(?:\.[0-9]+)*)?(?:\s|$)', 1))"


@query(f"SELECT doc_id, CASE {_read} END AS format, CASE {_named} END AS strict FROM (SELECT doc_id, line, {_interpreter} AS name FROM (SELECT doc_id, {_listed}[doc_id % {len(LINES)} + 1] AS line FROM documents))")
def first_line_formats(spark, sf_dir):
    """Formats by a first line that each document gets by rule, read loosely and strictly."""
    line = F.get(F.lit(LINES), (F.col("doc_id") % len(LINES)).cast("int"))
    own = table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))
    return own.select("doc_id", formats.by_shebang(F.col("line")).alias("format"), formats.by_interpreter(F.col("line")).alias("strict"))


NAMES = ["a.py", "Makefile.txt", "b.TSX", "own.zzz", "special", "c.unknown"]


@query(f"SELECT doc_id, CASE name WHEN 'a.py' THEN 'python' WHEN 'Makefile.txt' THEN 'txt' WHEN 'b.TSX' THEN 'tsx' WHEN 'own.zzz' THEN 'rust' WHEN 'special' THEN 'json' END AS format FROM (SELECT doc_id, [{', '.join(f"'{n}'" for n in NAMES)}][doc_id % {len(NAMES)} + 1] AS name FROM documents)")
def path_formats(spark, sf_dir):
    """Own names, own extensions, then known extensions, whatever their case."""
    path = F.concat_ws("/", "source", F.get(F.lit(NAMES), (F.col("doc_id") % len(NAMES)).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", formats.detect(path, F.col("text"), {"zzz": "rust"}, {"special": "json"}).alias("format"))


RULES = "# rules\n*7\n!*17\n/src1/\nsrc2/en\n"


@query("SELECT doc_id, source || '/' || lang || '/' || doc_id AS path FROM documents WHERE NOT ((doc_id::VARCHAR LIKE '%7' AND NOT doc_id::VARCHAR LIKE '%17') OR (source LIKE '%7' AND NOT source LIKE '%17') OR source = 'src1' OR (source = 'src2' AND lang = 'en'))")
def ignore_rules(spark, sf_dir):
    """Documents as files that an ignore file's rules leave: wildcards, exceptions, anchored folders."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", "doc_id").alias("path"))
    return own.where(~ignored(F.col("path"), gitignore_rules(RULES)))
