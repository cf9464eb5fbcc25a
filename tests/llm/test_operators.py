"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.llm import common, fingerprints, licenses, lines, mixing, packing, repeats, secrets, simhash, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "straße", "ñandú"]


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 14)))
    pool = [line() for _ in range(40)]
    out = []
    for i in range(n):
        text = "\n".join(rng.choice(pool) if rng.random() < 0.6 else line() for _ in range(rng.randrange(1, 8)))
        if rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + "xy" + text[at:]
        out.append((i, text, "en", f"s{i % 4}", len(text)))
    out += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, out[0][1], "en", "s0", 1), (n + 3, "long " * 20_000, "fr", "s2", 1), (n + 4, " \t\n", "en", "s1", 3), (n + 5, "one two", "en", None, 7)]
    return out


def docs_of(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)


ODD = [(None, "a\nb password=abcdefgh1", "en", "s", 3), (None, None, None, None, None), (7, "same text here " * 40, "en", "s", 1), (7, "same text here " * 40, "en", "s", 1), (8, "", "en", "s", 0)]
EVERY = {
    "mixing": lambda d: mixing.sizes(d),
    "mix": lambda d: mixing.mix(d),
    "licenses": lambda d: licenses.scan(licenses.as_files(d)),
    "secrets": lambda d: secrets.scan(d),
    "packing": lambda d: packing.pack(d),
    "simhash": lambda d: simhash.near_duplicates(d),
    "one_per_group": lambda d: simhash.one_per_group(d),
    "lines": lambda d: lines.dedup(d),
    "fingerprints": lambda d: fingerprints.fingerprints(d),
    "repeats": lambda d: repeats.strip(d),
    "toxicity": lambda d: toxicity.score(d, d.sparkSession.createDataFrame([(7, 1, 1), (8, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")),
}
FEWER = {"mix", "packing", "one_per_group"}


@pytest.mark.parametrize("name", EVERY)
def test_odd_rows(spark, name):
    """Nulls, repeated rows and ids, extra columns of any name: a row for each row; an empty table: none."""
    odd = docs_of(spark, ODD)
    for c in ("fp", "h", "k", "n", "row", "th", "size", "copies", "_gone", "_id", "_h", "n_lines", "component_id", "license", "count", "base", "s"):
        odd = odd.withColumn(c, F.lit(1))
    got = EVERY[name](odd).collect()
    if name in FEWER:
        assert got
    else:
        assert len(got) == len(ODD)
    assert EVERY[name](odd.limit(0)).collect() == []


def test_mixing(spark):
    rows = corpus()
    got = {r.doc_id: r for r in mixing.sizes(docs_of(spark)).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    per, source = {}, {i: s for i, _, _, s, _ in rows}
    for i, s in source.items():
        per[s] = per.get(s, 0) + size[i]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, stopped = {}, set()
    while True:
        rest = sum(per.values()) - sum(3 * per[s] for s in stopped)
        share = {s: weight[s] * rest / sum(weight[x] for x in per if x not in stopped) for s in per if s not in stopped}
        more = {s for s in share if share[s] > 3 * per[s]}
        if not more:
            break
        stopped |= more
    target = {s: 3 * per[s] if s in stopped else share[s] for s in per}
    for i, r in got.items():
        assert r.size == size[i] and r.source_size == per[source[i]] and r.target == pytest.approx(target[source[i]]) and r.taken in [k * r.size for k in range(4)]
        rate = target[source[i]] / max(1, per[source[i]])
        assert int(rate) <= r.copies <= int(rate) + 1 or not r.size
    mixed = mixing.mix(docs_of(spark)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r[1] for r in mixed} == {i: r.copies for i, r in got.items() if r.copies}


def test_mixing_draws_are_fair(spark):
    rows = [(i, "w", "en", "a" if i < 15_000 else "b", 1) for i in range(20_000)]
    got = mixing.sizes(docs_of(spark, rows)).groupBy("source_size").agg(F.sum("taken"), F.first("target")).collect()
    assert len(got) == 2 and all(abs(taken - target) < 0.03 * target for _, taken, target in got)


def test_documents_without_ids_draw_apart(spark):
    rows = [(None if i % 2 else 5, f"w{i}", "en", "a" if i < 3000 else "b", 1) for i in range(4000)]
    got = mixing.sizes(docs_of(spark, rows)).groupBy("source_size").agg(F.sum("taken"), F.first("target")).collect()
    assert len(got) == 2 and all(abs(taken - target) < 0.06 * target for _, taken, target in got)


def test_mixing_by_id(spark):
    """An id of one row settles its draw, whatever its text; rows without ids, or that share one, still draw apart."""
    drawn = {i: int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:13], 16) / 16**13 for i in range(200)}
    rows = [(i, f"w{i}", "en", "a" if i < 150 else "b", 1) for i in drawn]  # 200 words by weights 1, 2
    got = {r.doc_id: r[1] for r in mixing.mix(docs_of(spark, rows), by_id=True).groupBy("doc_id").count().collect()}
    assert got == {i: n for i, draw in drawn.items() if (n := (draw < 66.66666666666667 / 150) if i < 150 else 2 + (draw < 133.33333333333334 / 50 - 2))}
    rows = [(None if i % 2 else 5, f"w{i}", "en", "a" if i < 3000 else "b", 1) for i in range(4000)]
    got = mixing.sizes(docs_of(spark, rows), by_id=True).groupBy("source_size").agg(F.sum("taken"), F.first("target")).collect()
    assert len(got) == 2 and all(abs(taken - target) < 0.06 * target for _, taken, target in got)


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    rows = corpus()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        for k, at in enumerate(range(0, len(ids), 8192)):
            part = ids[at : at + 8192]
            want[i, k] = at // 4, len(part) // 4, zlib.crc32(part)
    got = packing.pack(docs_of(spark)).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert got.sequence_id.nunique() == -(-got.length.sum() // 2048)


def test_sequences_hold_their_ids(spark):
    """The ids themselves come out, at the places that pack() gives."""
    from tokenizers import Tokenizer

    import public_tokenizers

    rows = corpus()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows}
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(docs_of(spark, rows)).collect()}
    placed = packing.pack(docs_of(spark, rows)).collect()
    assert sum(map(len, whole.values())) == sum(map(len, want.values())) and max(map(len, whole.values())) <= 2048
    for r in placed:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == want[r.doc_id][r.start : r.start + r.length]


def test_ids_of_any_text(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 20)
    words, rng = packing.Words("word_bpe_49k.json"), random.Random(1)
    signs = [chr(i) for i in range(0x250)] + list("—“”…€–‘’世😀İ​ ") + ["é", "<|"] + list("  \n\t''stredvml  ab12") * 6
    assert words.plain
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        for t in (text, "".join(c for c in text if packing.PLAIN.match(c))):
            assert np.frombuffer(words.ids(t), "<u4").tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


def test_plan_uses_every_piece():
    rng = random.Random(1)
    for _ in range(20):
        counts = {rng.randrange(1, 65): rng.randrange(1, 9) for _ in range(12)}
        length, rank, first, offset, n = packing.plan(counts, 64)
        places = {}
        for size, many in counts.items():
            for r in range(many):
                at = np.searchsorted(length << 48 | rank, size << 48 | r, "right") - 1
                places.setdefault(int(first[at] + r - rank[at]), []).append((int(offset[at]), size))
        assert len(places) == n
        for members in places.values():
            end = 0
            for at, size in sorted(members):
                assert at == end
                end += size
            assert end <= 64
        assert n <= 1.34 * -(-sum(s * c for s, c in counts.items()) // 64) + 1
    assert packing.exact(np.array([0, 0, 2, 0, 1, 0, 0, 0, 0]), 8) == [4, 2, 2]


def slow_fingerprint(text, shingle=3):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < shingle else [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rows = corpus(150)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    fp = {i: slow_fingerprint(t) for i, t, *_ in rows}
    parent = {i: i for i in fp}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in fp:
        for j in fp:
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{fp[i]:016x}", root(i)) for i in fp}


@pytest.mark.parametrize("block", [256, 8])
def test_fingerprint_links_lose_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:80]:
        for _ in range(4):
            w = v
            for _ in range(rng.randrange(1, 6)):
                w ^= 1 << rng.randrange(64)
            values.add(w)
    hub = rng.getrandbits(64)
    values |= {hub ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)) for _ in range(120)}
    v = np.array(sorted(values), np.uint64)
    i, j = np.nonzero(np.bitwise_count(v[:, None] ^ v[None]) <= 3)
    label = common.forest(len(v), i, j)
    links = simhash.fingerprint_links(spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long").repartition(4))
    got = {r.node: r.component for r in common.connected_components(links).collect()}
    groups = {}
    for x, c in zip(v.view(np.int64).tolist(), label.tolist(), strict=True):
        groups.setdefault(c, set()).add(x)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(n for n in got if got[n] == c) for c in set(got.values())}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    label = common.forest(len(nodes), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    assert all(got.get(x, x) == nodes[label[i]] for i, x in enumerate(nodes))
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_per_group(spark):
    kept = {r.doc_id for r in simhash.one_per_group(docs_of(spark)).collect()}
    parts = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(spark), 5, similarity=0.8).collect()}
    assert kept == set(parts.values())


@pytest.mark.parametrize("block", [2048, 8])
def test_similar_sets_are_linked(spark, monkeypatch, block):
    """Near copies of 300 words, found at 0.85 and more, never below 0.75; a text's copies of a chain are one group."""
    monkeypatch.setattr(simhash, "SKETCH_ROWS", block)
    rng = random.Random(12)
    rows, base_of = [], {}
    for b in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randrange(0, 12)):
                copy[rng.randrange(300)] = f"x{rng.randrange(5000)}"
            base_of[len(rows)] = b
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(spark, rows), 5, similarity=0.8).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(296)} for _, t, *_ in rows]
    for i in range(len(rows)):
        for j in range(i):
            like = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            assert like < 0.86 or got[i] == got[j]
            assert base_of[i] == base_of[j] or got[i] != got[j]
    alone = [i for i in range(len(rows)) if all(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.74 for j in range(len(rows)) if j != i)]
    assert alone and all(got[i] == i and list(got.values()).count(i) == 1 for i in alone)


@pytest.mark.parametrize("block", [2048, 4])
def test_similarity_is_verified(spark, monkeypatch, block):
    """Pairs of 2,000 words: at 0.822 all are linked, at 0.781 none is, though sketches are off by 0.025."""
    monkeypatch.setattr(simhash, "SKETCH_ROWS", block)
    rng = random.Random(5)
    rows = []
    for b in range(80):
        words = [f"w{b}x{rng.randrange(10**6)}" for _ in range(2000)]
        copy = list(words)
        for m in range(39 if b % 2 else 49):  # 40 words apart: each takes five shingles
            copy[20 + 40 * m] = "other" + words[20 + 40 * m]
        rows += [(2 * b, " ".join(words), "en", "s", 1), (2 * b + 1, " ".join(copy), "en", "s", 1)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(spark, rows), 5, 0, 0.8).collect()}
    assert [got[2 * b + 1] for b in range(80)] == [2 * b + (b + 1) % 2 for b in range(80)]


def test_sets_are_compared_exactly():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (12, 100), np.uint64)
    sets = [np.unique(np.concatenate([base[i % 12][rng.random(100) < 0.93], rng.integers(0, 2**63, 5, np.uint64)])) for i in range(150)]
    like = np.array([[len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for y in sets] for x in sets])
    a, b = simhash.exact_in(sets, 0.8)
    assert all(like[i, j] >= 0.8 for i, j in zip(a, b, strict=True))
    assert (common.forest(150, np.array(a), np.array(b)) == common.forest(150, *np.nonzero(like >= 0.8))).all()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_lines(spark, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(18, 40))) for _ in range(12)]

    def vary(s):
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(s))
            s = rng.choice([s[:at] + s[at + 1 :], s[:at] + "z" + s[at:], s[:at] + "y" + s[at + 1 :]])
        return s

    rows = [(i, "\n".join([vary(rng.choice(base)) for _ in range(rng.randrange(0, 5))] + ["short"]), "en", "s", 1) for i in range(50)]
    got = {r.doc_id: r for r in lines.dedup(docs_of(spark, rows), max_edits=edits).collect()}
    seen = []
    for i, text, *_ in rows:
        kept, exact, near = [], 0, 0
        for line in text.split("\n"):
            if len(line) >= 20 and line in seen:
                exact += 1
            elif len(line) >= 20 and any(abs(len(o) - len(line)) <= edits and distance(o, line) <= edits for o in seen):
                near += 1
                seen.append(line)
            else:
                kept.append(line)
                if len(line) >= 20:
                    seen.append(line)
        near_again = got[i].n_near + got[i].n_exact
        assert (got[i].text, near_again) == ("\n".join(kept), exact + near)


def brute_repeats(texts, length):
    count, out = {}, []
    data = [(t or "").encode() for t in texts]
    for d in data:
        for p in range(len(d) - length + 1):
            count[d[p : p + length]] = count.get(d[p : p + length], 0) + 1
    for d in data:
        runs = repeats.merged([(p, p + length) for p in range(len(d) - length + 1) if count[d[p : p + length]] > 1])
        kept = b"".join(d[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(d)], strict=True))
        out.append((len(d), sum(e - s for s, e in runs), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("step", [16, 1])
def test_repeats(spark, monkeypatch, step):
    monkeypatch.setattr(repeats, "STEP", step)
    rows = corpus(80, seed=step)
    rng = random.Random(step)
    rows += [(500 + i, "".join(rng.choice(["ab", "b", "aab", "é"]) for _ in range(rng.randrange(60))), "en", "s", 1) for i in range(40)]
    rows = [r for r in rows if r[1] is None or len(r[1]) < 5000]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.strip(docs_of(spark, rows), 24, 9).collect()}
    assert got == dict(zip([r[0] for r in rows], brute_repeats([r[1] for r in rows], 24), strict=True))
    assert sum(v[1] > 0 for v in got.values()) > 20


def test_repeats_give_spans_and_bytes(spark):
    """What is left and the runs that go, not only their digests; a run may end within a character."""
    again = "b" + "xé" * 12
    rows = [(1, f"start {again}é end", "en", "s", 1), (2, again + "è", "en", "s", 1), (3, "nothing of it", "en", "s", 1), (4, None, None, None, None)]
    got = {r.doc_id: r for r in repeats.removed(docs_of(spark, rows), 24, 9).collect()}
    assert {i: ([tuple(x) for x in r.spans], bytes(r.kept), r.n_bytes) for i, r in got.items()} == {
        1: ([(6, 44)], b"start \xa9 end", 49),
        2: ([(0, 38)], b"\xa8", 39),
        3: ([], b"nothing of it", 13),
        4: ([], b"", 0),
    }
    whole = [(i, "".join(rows[i - 1][1] or "").encode()) for i in got]
    assert all(b"".join(d[a:b] for a, b in zip([0, *(x.end for x in got[i].spans)], [*(x.start for x in got[i].spans), len(d)], strict=True)) == bytes(got[i].kept) for i, d in whole)


def test_chunks_of_long_texts(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    data = bytes(random.Random(1).randrange(97, 100) for _ in range(2000))
    found = sorted(x for h, a, lo, hi in repeats.anchors_of(data, repeats.Rolling(400), 40, 12) for x in zip(lo.tolist(), hi.tolist(), a.tolist(), strict=True))
    assert [p for lo, hi, _ in found for p in range(lo, hi + 1)] == list(range(2000 - 40 + 1)) and all(lo <= hi <= a <= lo + 28 for lo, hi, a in found)


def test_secrets(spark):
    hexes = "0123456789abcdef" * 2
    rows = [(1, f"é password = \"abcdefgh\" x SECRET:{hexes} token=a token=secret:abcdefgh12 AKIA{'Z' * 12} AKIAZZ", "en", "s1", 1), (2, f"api_key='{hexes}0'", "en", "s2", 1), (3, "ghp_" + "a1" * 10, "en", "s3", 1)]
    rows += [(10 + i, "passwd: sharedvalue", "en", f"t{i}", 1) for i in range(5)] + [(30 + i, "ghp_" + "b2" * 10, "en", f"t{i}", 1) for i in range(5)]
    got = {r.doc_id: r for r in secrets.scan(docs_of(spark, rows)).collect()}
    spans = []
    for kind, rx, test in (("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32)):
        spans += [(m.start(), ("assign", "access", "hex").index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(rx, rows[0][1]) if test(m)]
    base = ",".join(s for *_, s in sorted(spans))
    assert got[1].spans == base and got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (got[1].n_assign, got[1].n_access, got[1].n_hex) == (2, 1, 1)
    assert (got[10].n_live, got[10].n_example, got[2].n_live) == (0, 1, 2)
    assert got[3].spans == "vendor:0:24" and got[30].spans == ""


def test_secrets_of_a_text_of_many(spark):
    rng = random.Random(5)
    text = " é ".join(f"{rng.getrandbits(128):032x}" for _ in range(30_000))
    got = secrets.scan(docs_of(spark, [(1, text, "en", "s", 1)])).first()
    assert got.n_hex == 30_000 and got.spans == ",".join(f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{32,}", text))


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "code"), ("a/d/LICENSE", "x. Licensed under the Apache License, Version 2.0."), ("a/d/e/y.py", "code"), ("a/d/e/z.py", "text\nThis work is licensed under the GNU General Public License, version 3."), ("q/x.py", "licence to kill"), (None, "code"), ("a/f.py", None)]
    got = {r.path: (r.own_license, r.license, r.inherited_from) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a/LICENSE": ("MIT", "MIT", None), "a/b/c/x.py": (None, "MIT", "a"), "a/d/LICENSE": ("Apache-2.0", "Apache-2.0", None), "a/d/e/y.py": (None, "Apache-2.0", "a/d"), "a/d/e/z.py": ("GPL-3.0", "GPL-3.0", None), "q/x.py": (None, None, None), None: (None, None, None), "a/f.py": (None, "MIT", "a")}


def test_fingerprints(spark):
    rows = corpus()
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs_of(spark, rows)).collect()}
    texts = [t or "" for _, t, *_ in sorted(rows)]
    for k, (i, *_) in enumerate(sorted(rows)):
        own, follows = texts[k], texts[(k + 1) % len(texts)]
        edited = own[: len(own) - len(own) // 2] + follows[: len(own) // 2]
        f = [fingerprints.fingerprint(x.encode()) for x in (own, edited, follows)]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(own), hashlib.sha256(edited.encode()).hexdigest(), f[0], f[1])
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(f[0], f[1]), fingerprints.likeness(f[0], f[2]))
    many = fingerprints.with_next(docs_of(spark, rows), rows=5)
    assert many.where("only_next").count() == many.select("part").distinct().count() > 5
    cut = fingerprints.fingerprints(docs_of(spark, rows)).select("doc_id", "edited_sha256").collect()
    assert {r.doc_id: r.edited_sha256 for r in cut} == {i: r.edited_sha256 for i, r in got.items()}


def test_edited_texts(spark):
    """The edited texts themselves come out, not only their digests."""
    rows = [(3, "öne two", "en", "s", 1), (5, None, "en", "s", 1), (8, "three four", "en", "s", 1), (9, "xé", "en", "s", 1)]
    got = {r.doc_id: bytes(r.edited).decode() for r in fingerprints.edits(docs_of(spark, rows)).collect()}
    assert got == {3: "öne ", 5: "", 8: "three" + "xé", 9: "x" + "ö"}


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        assert fingerprints.edit_distance(a, b) == distance(a, b)


def test_likeness_follows_content():
    rng = random.Random(7)
    text = " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(2000)).encode()
    other = " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(2000)).encode()
    f = fingerprints.fingerprint
    assert fingerprints.likeness(f(text), f(text)) == 1 and fingerprints.likeness(f(text), f(text[:7000] + b"inserted" + text[7000:])) > 0.8 and fingerprints.likeness(f(text), f(other)) < 0.2


@pytest.mark.parametrize("block", [256, 16])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "OTHER_ROWS", 2 * block)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 16))
    near = base[:60].repeat(3, axis=0) + rng.normal(size=(180, 16)) * rng.choice([0.05, 0.3], (180, 1))
    x = np.concatenate([base, near, base[:20], base[5:6].repeat(60, axis=0) + rng.normal(size=(60, 16)) * 0.05])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 16, 0), (9003, [None, *[1.0] * 15], 0), (9004, [float("nan")] * 16, 0), (9005, [float("inf")] * 16, 0), (None, x[0].tolist(), 1), (9006, [1.0, 2.0], 0), (9007, [1.0, 2.0], 0)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, label int").repartition(3), per_cell=40).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    count = linked.sum(axis=1)
    count += (linked[:, 0] | (np.arange(len(x)) == 0)).astype(int) + ((x == x[0]).all(axis=1) & (np.arange(len(x)) != 0) & ~linked[:, 0])
    found = np.array([got[i].n_links for i in range(len(x))])
    assert found.sum() >= 0.9 * count.sum() and (found <= count).all()
    label = common.forest(len(x), *np.nonzero(linked))
    same = np.mean([got[i].component_id == label[i] for i in range(len(x))])
    assert same > 0.9
    for i in (9000, 9001, 9002, 9003, 9004, 9005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[9007].n_links, got[9007].component_id, got[9007].kept) == (1, 9006, False)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("rank", [3, 4, 6, 64])
def test_vectors_of_few_dimensions(spark, rank):
    """Vectors that vary in some of 64 dimensions: links at just over the bound across cells are found, and on both sides."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, rank)) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T
    if rank > 4:
        x[750:] = x[:750] + rng.normal(size=(750, rank)) @ np.linalg.qr(rng.normal(size=(64, rank)))[0].T * 0.3
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), per_cell=40).collect()
    assert 0.999 * linked.sum() <= sum(r.n_links for r in got) <= linked.sum() and linked.sum() > 100 and sum(r.n_links for r in got) % 2 == 0


def test_vectors_exactly(spark):
    """With ``exact`` no link is lost and none made up, also at a spread that would lose some, and for vectors whose squares overflow or vanish."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3))
    x[:2] = [1, 2, 3], [2, 1, 3.1]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    x[0], x[1] = x[0] * 1e-200, x[1] * 1e200
    given = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: r for r in vectors.near_duplicates(given, spread=0.1, per_cell=20, exact=True).collect()}
    assert [got[i].n_links for i in range(len(x))] == linked.sum(axis=1).tolist() and linked[0].sum() > 5 < linked[1].sum()
    assert [got[i].component_id for i in range(len(x))] == common.forest(len(x), *np.nonzero(linked)).tolist()
    assert sum(r.n_links for r in vectors.near_duplicates(given, spread=0.1, per_cell=20).collect()) < linked.sum()


def test_toxicity(spark):
    rng = random.Random(9)
    toxic = ["moron", "scumbag", "lowlife"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(30)]
        if bad:
            words.insert(rng.randrange(30), rng.choice(toxic))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(bad)))
    hidden = {9000: "well m0r0n then", 9001: "you s.c.u.m.b.a.g", 9002: "such a m o r o n here", 9003: "scümbag? no: SCUUUMBAG!", 9004: "a kind alpha beta"}
    rows += [(i, t, "en", "s", 1) for i, t in hidden.items()] + [(9100, None, None, None, None), (9101, "", "en", "s", 0)]
    got = {r.doc_id: r for r in toxicity.score(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} >= set(held) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert sum(got[i].predicted == labels[i][1] for i in held) / len(held) > 0.98
    assert [got[i].predicted for i in hidden] == [1, 1, 1, 1, 0] and got[9100].predicted == 0 == got[9101].predicted
    kept = toxicity.keep_clean(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted} and kept.columns == docs_of(spark).columns


def test_words_hidden_by_marks_doubled_letters_and_digits():
    counts = np.zeros(27**3, np.int64)
    for word in ("kill", "idiot", "ass", "hello", "letter", "call"):
        toxicity._trigrams(f" {word} " * 50, counts)
    tri = counts.reshape(27, 27, 27) + 0.1
    lm = np.log(tri / tri.sum(axis=2, keepdims=True))
    known = {w: i for i, w in enumerate(("kill", "idiot", "ass"))}
    reader = toxicity.Reader(lm, known)
    hidden = {"ki!!": 0, "ki!!,": 0, "kil!": 0, "\"ki!!": 0, "idiiot": 1, "iddiott.": 1, "455": 2, "455!": 2, "ass": 2}
    assert {w: reader.read(w) for w in hidden} == {w: {i} for w, i in hidden.items()}
    assert reader.read("so i  d\ni\to  t now") == {1} and reader.read(("b d f g " * 10_000) + "i d i o t " + ("g f d b " * 10_000)) == {1}
    assert not any(reader.read(w) for w in ("hello!", "letter", "call(", "2019", "!", "(", "١٢٣", "½½"))


def every_reading(noisy, lm, state=(26, 26, ""), score=0.0, out=""):
    """All ways to read a noisy word, one by one: (score, letters)."""
    p, q, last = state
    if not noisy:
        yield score + lm[p, q, 26], out
        return
    c, rest = noisy[0], noisy[1:]
    letter = "a" <= c <= "z"
    for x in [c] if letter else toxicity.LEET.get(c, ""):
        k = ord(x) - 97
        yield from every_reading(rest, lm, (q, k, c), score + (0.0 if letter else toxicity.SWAP) + lm[p, q, k], out + x)
    if last == c:
        yield from every_reading(rest, lm, (p, q, c), score + toxicity.MERGE, out)
    if c in toxicity.APART or c.isspace():
        yield from every_reading(rest, lm, (p, q, last), score + toxicity.DROP, out)
    elif not letter and c not in toxicity.LEET:
        yield from every_reading(rest, lm, (q, 26, c), score + lm[p, q, 26], out + " ")


def test_decoding_finds_the_best_of_all_readings():
    rng, counts = random.Random(8), np.zeros(27**3, np.int64)
    for _ in range(300):
        toxicity._trigrams(" " + "".join(rng.choice("aeioustlgbz") for _ in range(rng.randrange(2, 8))) + " ", counts)
    tri = counts.reshape(27, 27, 27) + 0.1
    lm = np.log(tri / tri.sum(axis=2, keepdims=True))
    for _ in range(400):
        noisy = "".join(rng.choice("aeioustlgb116480$!|*..- %") for _ in range(rng.randrange(1, 9)))
        readings = dict((out, score) for score, out in sorted(every_reading(noisy, lm)))
        best = max(readings.values())
        assert readings[toxicity.decode(noisy, lm.tolist())] == pytest.approx(best)


def test_trigrams_of_long_texts(monkeypatch):
    text = "".join(random.Random(3).choice("abcé 1") for _ in range(1000))
    whole, parts = np.zeros(27**3, np.int64), np.zeros(27**3, np.int64)
    toxicity._trigrams(text, whole)
    monkeypatch.setattr(toxicity, "CHUNK", 37)
    toxicity._trigrams(text, parts)
    assert whole.sum() == 998 and (whole == parts).all()
