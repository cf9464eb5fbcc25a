"""Clone detection against a sequential model, and the cases that its definition names."""

import random

from pyspark.sql import functions as F

from refrain.operators import baseline, detect, snippets, stats
from refrain.operators.tokens import token_arrays


def model(sources, k):
    """The definition, one window at a time: sources is [(pool, id, [values])]."""
    found = []
    for pool in sorted({p for p, _, _ in sources}):
        first = {}
        for _, i, values in sorted((s for s in sources if s[0] == pool), key=lambda s: s[1]):
            run = None
            for p in range(len(values) - k + 1):
                w = tuple(values[p : p + k])
                if w in first:
                    run = [*run[:3], run[3] + 1] if run else [first[w], i, p, 1]
                else:
                    first[w] = (i, p, len(values))
                    if run:
                        found.append((pool, run))
                    run = None
            if run:
                found.append((pool, run))
    out = []
    for pool, ((a, ap, n), b, bp, count) in found:
        if ap + count + k - 1 <= n:
            out.append((pool, a, ap, b, bp, count + k - 1))
    return sorted(out)


def frame(spark, sources):
    return spark.createDataFrame([(p, i, v, list(range(1, len(v) + 1))) for p, i, v in sources], "pool string, source_id long, values array<string>, lines array<int>")


def rows(df):
    return sorted(map(tuple, df.select("pool", "a_id", "a_pos", "b_id", "b_pos", "tokens").collect()))


def test_random_corpora_match_the_model(spark):
    rng = random.Random(5)
    for alphabet, k in ((2, 3), (3, 4), (8, 3)):
        sources = [(rng.choice("xy"), i, [chr(97 + rng.randrange(alphabet)) for _ in range(rng.randrange(0, 40))]) for i in range(25)]
        want = model(sources, k)
        assert rows(detect.clones(frame(spark, sources), k)) == want
        assert rows(detect.clones(frame(spark, sources), k, hot_keys=True)) == want
        assert want


def test_runs_of_windows_match_the_model(spark, monkeypatch):
    """Long enough for windows to share keys; batches, pieces and runs so small that keys go on from one to the next."""
    rng, k = random.Random(7), 12
    base = [[chr(97 + rng.randrange(n)) for _ in range(60)] for n in (2, 26, 26)]
    sources = []
    for i in range(60):
        v = list(rng.choice(base)) + (["z"] * 90 if i % 7 == 0 else [])
        for _ in range(rng.randrange(3)):
            v[rng.randrange(len(v))] = "!"
        sources.append((rng.choice("xy"), i, v[rng.randrange(5) : len(v) - rng.randrange(5)]))
    own, want = frame(spark, sources).repartition(3).cache(), model(sources, k)
    assert want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    monkeypatch.setattr(detect, "PIECE", 100)
    monkeypatch.setattr(detect, "HOT", 5)
    try:
        found = detect.windows(own, k)
        runs, each = found.agg(F.count("*"), F.max(F.size("w"))).first(), detect.each_window(found).cache()
        assert runs[0] < each.count() / 2 and runs[1] == detect.RUN
        assert rows(detect.clones(own, k)) == want == rows(detect.clones(own, k, hot_keys=True))
        counts: dict = {}
        for pool, i, v in sorted(sources, key=lambda s: s[1]):
            for p in range(len(v) - k + 1):
                counts.setdefault((pool, tuple(v[p : p + k])), []).append((i, p))
        assert sorted(map(tuple, detect.repeated(found).collect())) == sorted((w[0], *x[0], len(x)) for w, x in counts.items() if len(x) > 1)
        assert {r.pool: (r.windows, r.distinct_windows) for r in detect.window_counts(found).collect()} == {x: (sum(len(n) for w, n in counts.items() if w[0] == x), sum(w[0] == x for w in counts)) for x in "xy"}
        assert sorted((r.pool, r.first.source_id, r.first.pos) for r in snippets.index_of(own, k).collect()) == sorted((w[0], *x[0]) for w, x in counts.items())
        pairs: dict = {}
        for (pool, _), ((a, p), (b, q), *_) in ((w, x) for w, x in counts.items() if len(x) > 1):
            pairs.setdefault((pool, a, b, q - p), set()).add(p)
        want = sorted((w[0], w[1], p, w[2], p + w[3], next(n for n in range(1, 999) if p + n not in x)) for w, x in pairs.items() for p in x if p - 1 not in x)
        assert sorted(tuple(r) for r in detect.secondary_candidates(found, k).select("pool", "a_id", "a_pos", "b_id", "b_pos", "windows").collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_maximal_clone(spark):
    v = list("abcdefghi")
    assert rows(detect.clones(frame(spark, [("p", 1, v), ("p", 2, v)]), 5)) == [("p", 1, 0, 2, 0, 9)]


def test_copies_match_the_first_only(spark):
    v = list("abcdefghi")
    assert [r[1] for r in rows(detect.clones(frame(spark, [("p", i, v) for i in range(4)]), 5))] == [0, 0, 0]


def test_pools_are_apart(spark):
    v = list("abcdefghi")
    assert rows(detect.clones(frame(spark, [("p", 1, v), ("q", 2, v)]), 5)) == []


def test_short_and_empty_sources(spark):
    assert rows(detect.clones(frame(spark, [("p", 1, []), ("p", 2, ["a"])]), 5)) == []
    assert rows(detect.clones(frame(spark, [("p", 1, ["a"])]).limit(0), 5)) == []


def test_exact_runs_follow_one_another(spark):
    a, b = list("abcde"), list("vwxyz")
    sources = [("p", 1, a), ("p", 2, b), ("p", 3, a + b)]
    assert rows(detect.clones(frame(spark, sources), 3, exact=True)) == [("p", 1, 0, 3, 0, 5), ("p", 2, 0, 3, 5, 5)]


def test_lines_and_dedup(spark):
    text = "one two three\nfour five six\nseven eight nine"
    own = token_arrays(spark.createDataFrame([(1, "p", text), (2, "p", text), (3, "p", None)], "source_id long, pool string, content string"))
    found = detect.with_lines(detect.clones(own, 5), own)
    r = found.first()
    assert (r.a_start, r.a_end, r.b_start, r.b_end, r.tokens) == (1, 3, 1, 3, 9)
    assert found.where(detect.min_lines(3)).count() == 0 and found.where(detect.min_lines(2)).count() == 1
    assert detect.dedup(found.union(found)).count() == 1


def test_modes_and_case(spark):
    df = spark.createDataFrame([(1, "p", "Ab 1.5 # note\n\tx//y\né")], "source_id long, pool string, content string")
    values = lambda **m: token_arrays(df, **m).first()["values"]
    assert values() == ["Ab", "1.5", "#", "note", "x", "/", "/", "y", "é"]
    assert values(mode="weak") == ["Ab", "1.5", "x", "é"]
    assert values(mode="strict")[1] == " " and values(ignore_case=True)[0] == "ab"


def test_secondary_adds_uncovered_lines_only(spark):
    a, b = list("abcdefgh"), list("stuvwxyz")
    own = frame(spark, [("p", 1, a), ("p", 2, b), ("p", 3, a + b)])
    found = detect.windows(own, 4)
    primary = detect.with_lines(detect.islands(detect.hits(found), 4), own)
    more = detect.secondary(detect.secondary_candidates(found, 4), primary, own, 4)
    known = set(rows(primary))
    assert not known & set(rows(more))


def test_secondary_matches_a_walk_of_all(spark):
    """Every candidate walked in order after all primary clones, whose coverage the engine takes off first."""
    rng, k, gone = random.Random(3), 6, 0
    blocks = [[chr(97 + rng.randrange(26)) for _ in range(9)] for _ in range(6)]
    sources = [(rng.choice("xy"), i, [v for b in rng.choices(blocks, k=3) for v in [*b, chr(65 + rng.randrange(26))] * rng.choice((1, 1, 2))]) for i in range(30)]
    own = frame(spark, sources).withColumn("lines", F.transform("lines", lambda x: F.ceil(x / 4).cast("int"))).cache()
    found = detect.windows(own, k)
    primary = detect.with_lines(detect.islands(detect.hits(found), k), own).cache()
    runs = detect.with_lines(detect.secondary_candidates(found, k).withColumn("tokens", F.col("windows") + k - 1), own)
    key, want = ("pool", "a_id", "a_pos", "b_id", "b_pos", "tokens"), []
    primaries = primary.where("b_id % 3 > 0").cache()  # so that some candidates are not covered
    covered: dict = {}
    for r in primaries.collect():
        covered.setdefault(r.a_id, set()).update(range(r.a_start, r.a_end + 1))
        covered.setdefault(r.b_id, set()).update(range(r.b_start, r.b_end + 1))
    for r in sorted(runs.collect(), key=lambda r: (r.pool, r.a_id, r.a_pos, r.b_id, r.b_pos)):
        a, b = set(range(r.a_start, r.a_end + 1)), set(range(r.b_start, r.b_end + 1))
        if a - covered.setdefault(r.a_id, set()) and b - covered.setdefault(r.b_id, set()):
            want.append(tuple(r[c] for c in key))
            covered[r.a_id] |= a
            covered[r.b_id] |= b
        else:
            gone += 1
    got = detect.secondary(detect.secondary_candidates(found, k), primaries, own, k)
    assert rows(got) == sorted(want) and want and gone


def test_clones_of_a_query_tokenise_once(spark, monkeypatch):
    """Texts are tokenised for one table, which is read as often as a plan likes."""
    from refrain.plans import queries

    made = []
    monkeypatch.setattr(queries, "token_arrays", lambda *a, f=queries.token_arrays, **k: made.append(1) or f(*a, **k))
    monkeypatch.setattr(queries, "table", lambda s, d, n: s.createDataFrame([(i, "en", "src0", "one two " * 40) for i in range(3)], "doc_id long, lang string, source string, text string"))
    for name in ("csv_report", "new_clone_gate", "secondary_clones"):
        plan = queries.registry.queries()[name](spark, "")._jdf.queryExecution().optimizedPlan().toString()
        assert len(made) == 1 and "regexp_extract_all" not in plan, name
        made.clear()


def test_folders(spark):
    v = list("abcdefghi")
    own = frame(spark, [("p", 1, v), ("p", 2, v), ("p", 3, v)])
    sources = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "source_id long, folder string")
    found = detect.with_attribute(detect.clones(own, 5), sources, "folder")
    assert [r.b_id for r in found.where(detect.skip_local()).collect()] == [3]
    assert [r.b_id for r in found.where(detect.skip_isolated([["x", "y"]])).collect()] == [2]


def test_baseline_is_a_multiset(spark):
    v = list("abcdefghi")
    own = frame(spark, [("p", i, v) for i in range(4)])
    found = baseline.fingerprints(detect.clones(own, 5), own)
    old = baseline.build(found.limit(2))
    assert old.first().n == 2
    assert found.count() == 3 and baseline.mark_new(found, old).where("is_new").count() == 1
    assert tuple(baseline.diff(old, baseline.build(found)).first()) == (1, 0, 3)


def test_snippets(spark):
    corpus = frame(spark, [("p", 1, list("abcdefghij"))])
    own = frame(spark, [("p", 7, list("xxcdefgyy")), ("p", 8, list("zzzzz"))])
    runs = snippets.check(own, snippets.index_of(corpus, 4), 4)
    assert [tuple(r) for r in runs.collect()] == [(7, 2, 1, 2, 5)]
    assert sorted(map(tuple, snippets.coverage(runs, own).collect())) == [(7, 9, 5, 5 * 100.0 / 9), (8, 5, 0, 0.0)]


def test_statistics(spark):
    v = list("abcdefghi")
    own = frame(spark, [("p", 1, v), ("p", 2, v), ("q", 3, v)])
    found = detect.with_lines(detect.clones(own, 5), own)
    got = {r.pool: r for r in stats.statistics(stats.source_sizes(own), found).collect()}
    assert (got["p"].clones, got["p"].duplicated_lines, got["p"].lines, got["p"].sources) == (1, 8, 18, 2)
    assert (got["*"].clones, got["*"].sources, got["q"].percentage) == (1, 3, 0.0)


def test_interval_union(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 4, 5), (1, 9, 9), (1, 2, 2), (2, 1, 1)], "source_id int, start int, end int")
    assert sorted(map(tuple, stats.interval_union(df, "source_id").collect())) == [(1, 1, 5), (1, 9, 9), (2, 1, 1)]
