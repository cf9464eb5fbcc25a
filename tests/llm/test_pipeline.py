"""The pipeline stage by stage against a brute-force version."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from refrain.llm import toxicity

from .test_operators import WORDS, corpus, distance, docs_of, slow_fingerprint


def brute_lines(rows):
    seen, out = [], []
    for i, text, *rest in rows:
        kept = []
        for line in (text or "").split("\n"):
            if len(line) >= 20:
                again = any(line == o or abs(len(o) - len(line)) <= 2 and distance(o, line) <= 2 for o in seen)
                seen.append(line)
                if again:
                    continue
            kept.append(line)
        out.append((i, None if text is None else "\n".join(kept), *rest[:2], None if text is None else len("\n".join(kept))))
    return out


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_groups(rows):
    """One row of each group that differs by 3 bits of five-word SimHash at most, or by a similarity of five-word shingles of 0.8 or more."""
    fp, sets, keep, seen = [slow_fingerprint(t, 5) for _, t, *_ in rows], [shingles(t) for _, t, *_ in rows], [], set()
    for k in range(len(rows)):
        if k in seen:
            continue
        keep.append(rows[k])
        todo = [k]
        while todo:
            x = todo.pop()
            for y in range(len(rows)):
                if y not in seen and ((fp[x] ^ fp[y]).bit_count() <= 3 or 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]) > 0):
                    seen.add(y)
                    todo.append(y)
    return keep


def test_pipeline(spark, tmp_path):
    rows = [r for r in corpus(70, seed=11) if r[0] != 73] + [(200 + i, f"{WORDS[i % 9]} moron {WORDS[i % 7]} {i}", "en", "s0", 1) for i in range(40)]
    labels = [(i, 0, int("moron" in (t or ""))) for i, t, *_ in rows]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    scored = toxicity.score(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    clean = {r.doc_id for r in scored if not r.predicted}
    assert not clean & {i for i, _, y in labels if y} and clean >= {i for i, _, y in labels if not y}
    left = brute_groups(brute_lines(sorted(r for r in rows if r[0] in clean)))
    size = {i: len((t or "").split()) for i, t, *_ in left}
    per = Counter()
    for i, _, _, s, _ in left:
        per[s] += size[i]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    stopped = set()
    while True:
        rest = sum(per.values()) - sum(3 * per[s] for s in stopped)
        share = {s: weight[s] * (rest / sum(weight[x] for x in per if x not in stopped)) for s in per if s not in stopped}
        more = {s for s in share if share[s] > 3 * per[s]}
        if not more:
            break
        stopped |= more
    copies = {}
    for i, _, _, s, _ in left:
        rate = (3.0 * per[s] if s in stopped else share[s]) / per[s] if per[s] else 0.0
        draw = int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:13], 16) / 16**13
        copies[i] = int(rate) + (draw < rate - int(rate))
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, t, *_ in left:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        for k, at in enumerate(range(0, len(ids), 8192)):
            if copies[i]:
                want[i, k, len(ids[at : at + 8192]) // 4, zlib.crc32(ids[at : at + 8192])] += copies[i]
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got.itertuples()) == want
    assert got.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns(spark, tmp_path, stage):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = docs_of(spark)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), str(tmp_path)).count() == 0
