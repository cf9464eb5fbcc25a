"""Secret scans with corpus-wide ownership frequency, by DataFrame functions only.

Candidates are found in every text by their forms. Each candidate's value is hashed, and
over the whole corpus it is counted how many distinct repositories (source and language)
and owners (sources) hold it. A value that few owners hold is live-looking; one that many
hold is a copied example. Counts are of distinct (value, owner, repository) first, so that
an example in a third of all documents is summed before it is shuffled.

Besides the base forms, which are always spans, the method adds vendor tokens, signed web
tokens and private keys (kind ``vendor``), of which only live-looking ones are spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import let, materialise

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so that a least length in the pattern drops what a check afterwards would.
ACCESS, HEX = r"()(AKIA[A-Z0-9]{12,})", r"()([0-9a-f]{32,})"
VENDOR = r"()((?:gh[pousr]|glpat|xox[abprs]|sk|rk)[_-][A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)"
KINDS = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("vendor", VENDOR)]


#: Items whose sums are taken at once in running sums.
BLOCK = 64


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x)


def _before(steps: Column) -> Column:
    """For each item of an array (not empty, computed once) the sum of all before it: by sums of blocks, so that the work of n items is n * BLOCK + (n / BLOCK)^2."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
    bases = lambda sums: F.transform(sums, lambda x, i: _sum(F.slice(sums, F.lit(1), i)))
    each = lambda base: F.transform(steps, lambda x, i: F.get(base, F.floor(i / BLOCK).cast("int")) + _sum(F.slice(steps, i - i % BLOCK + 1, i % BLOCK)))
    return let(blocks, lambda sums: let(bases(sums), each))


def _found(number: int, pattern: str) -> Column:
    """Spans of one kind: start, number, end, and a hash of the value. Between and before matches lie the parts of the split text."""
    text, rx = F.col("text"), F.lit(pattern)
    read = F.struct(F.regexp_extract_all(text, rx, F.lit(0)).alias("whole"), F.regexp_extract_all(text, rx, F.lit(2)).alias("value"), F.split(text, pattern, -1).alias("gap"))

    def spans(r: Column) -> Column:
        steps = F.zip_with(r["whole"], F.slice(r["gap"], F.lit(1), F.size(r["whole"])), lambda m, g: F.length(m) + F.length(g))

        def place(before: Column) -> Column:
            start = lambda i: F.get(before, i) + F.length(F.get(r["gap"], i))
            return F.transform(r["whole"], lambda m, i: F.struct(start(i).alias("start"), F.lit(number).alias("kind"), (start(i) + F.length(m)).alias("end"), F.xxhash64(F.get(r["value"], i)).alias("value"), F.length(F.get(r["value"], i)).alias("long")))

        return let(steps, lambda s: let(_before(s), place))

    kept = F.filter(let(read, spans), lambda s: s["long"] >= 8) if number == 0 else let(read, spans)
    return F.when(text.rlike(pattern), F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind", "end", "value")])))


def _told(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k, _ in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, max_owners: int = 2) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) of every row of ``docs`` (doc_id, text, source, lang; others are ignored).

    A null text counts as empty. Null sources are one owner. Repeated rows count once among
    owners and keep a row each; a null doc_id stays null. n_live and n_example count spans
    whose values at most, and more than, ``max_owners`` owners hold. An empty table gives no rows.
    """
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:bigint>>)")
    found = docs.select("doc_id", "source", "lang", F.xxhash64("text").alias("th"), *[F.coalesce(_found(i, p), none).alias(k) for i, (k, p) in enumerate(KINDS)])
    found = materialise(found.withColumn("base", F.concat("assign", "access", "hex")), "secrets")
    each = found.where(F.size("base") + F.size("vendor") > 0).select("doc_id", "th", "source", "lang", F.explode(F.concat("base", "vendor")).alias("s"))
    held = each.select("s.value", F.coalesce("source", F.lit("")).alias("owner"), F.coalesce("lang", F.lit("")).alias("lang")).distinct()
    owned = materialise(held.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count("*").alias("repositories")), "owners")
    live = each.select("doc_id", "th", "s", F.col("s.value").alias("value")).distinct().join(owned, "value").withColumn("live", F.col("owners") <= max_owners)
    judged = live.groupBy("doc_id", "th").agg(F.count_if("live").alias("live"), F.count_if(~F.col("live") & (F.col("s.kind") < 3)).alias("example"), F.collect_list(F.when(F.col("live") & (F.col("s.kind") == 3), F.col("s"))).alias("added"))
    judged = materialise(judged.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "live", "example", "added"), "judged")
    whole = found.join(judged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    return whole.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_told(F.col("base")), 256).alias("base_sha256"),
        _told(F.concat("base", F.coalesce("added", none))).alias("spans"),
        F.coalesce("live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("example", F.lit(0)).cast("long").alias("n_example"),
    )


def _sql(max_owners: int = 2) -> str:
    one = """SELECT doc_id, source, lang, {i} AS kind, unnest(regexp_extract_all(t, {p}, 0)) AS whole, unnest(regexp_extract_all(t, {p}, 2)) AS value,
        unnest(string_split_regex(t, {p})[:len(regexp_extract_all(t, {p}, 0))]) AS gap, generate_subscripts(regexp_extract_all(t, {p}, 0), 1) AS i FROM d"""
    quoted = [(i, "'" + p.replace("'", "''").replace(r"\x20", " ") + "'") for i, (_, p) in enumerate(KINDS)]
    return f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(one.format(i=i, p=p) for i, p in quoted)}),
s AS (SELECT doc_id, source, lang, kind, value, (sum(length(gap) + length(whole)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(whole))::INT AS start, length(whole) AS long FROM m),
k AS (SELECT *, start + long AS stop FROM s WHERE kind > 0 OR length(value) >= 8),
o AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners FROM k GROUP BY value),
j AS (SELECT k.*, owners <= {max_owners} AS live, ['assign', 'access', 'hex', 'vendor'][kind + 1] || ':' || start || ':' || stop AS told FROM k JOIN o USING (value)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    coalesce(string_agg(told, ',' ORDER BY start, kind) FILTER (kind < 3), '') AS base, coalesce(string_agg(told, ',' ORDER BY start, kind) FILTER (kind < 3 OR live), '') AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live AND kind < 3) AS n_example FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
