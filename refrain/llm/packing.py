"""Best-fit packing by exact-complement hashing.

Documents are tokenised where they lie and cut into pieces; from then on only piece
lengths matter, of which there are at most ``capacity``. The driver gets how many pieces
have each length (so many rows, whatever the corpus) and plans patterns: the longest
length left, then whatever single, pair or triple of lengths fills the gap exactly under
the counts still available, and where there is none the longest that fits, and again. A
pattern is used as many times as its counts allow, so that each step exhausts a length.

Pieces take their places by rank within their length. Ranks come from counts by length
and a salt, so that a length which a third of all pieces share is ranked by many tasks.
"""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refrain.llm.common import materialise

#: Distinct words whose ids a Python worker remembers, and the longest of them in bytes.
CACHE, LONGEST = 250_000, 64
#: How byte-level BPE writes bytes that aren't printable.
SPELT = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
#: Pieces of one length and salt, about.
SALTED = 500
#: Texts whose classes of characters Python and the tokenizer read alike: Latin letters and common marks, already in NFC.
PLAIN = re.compile("[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*\\Z")
#: The pre-tokens of such texts: contractions, runs of letters, single digits, runs of marks.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Characters of a text that are split at a time.
CHUNK, GAP = 1 << 20, re.compile(r"\s")


class Words:
    """ids of whole texts by way of their words.

    The tokenizer drops white space and never joins what it separates, so that a text's ids
    are its words' ids in order, and each distinct one is tokenised once. Plain texts are
    split into pre-tokens, which the BPE model spells; others at ASCII white space, where a
    full stop or comma behind an ASCII letter is its own pre-token. A tokenizer of another
    make, told by a few probes, only gets the latter.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer, self.cache = Tokenizer.from_file(path), {}
        self.plain = False  # whether this tokenizer spells words as byte-level BPE does
        spelt = lambda w: [i for t in PRETOKEN.findall(w.lower()) for i in self._spell(t)]
        self.plain = all(spelt(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in ("Straße dünn", "çà the,ñandú", "don't 'tis '90s we'LL", "a_b--c!! 12.5%", "«no» — “x”…y€\u00a0z", "ÀB\u0301"[:2]))

    def _spell(self, token: str) -> list[int]:
        """ids of one pre-token in lower case."""
        return [t.id for t in self.tokenizer.model.tokenize(token if token.isascii() and token.isalpha() else token.encode().decode("latin-1").translate(SPELT))]

    def _plain_ids(self, text: str) -> bytes:
        tokens, cache = PRETOKEN.findall(text), self.cache
        found = list(map(cache.get, tokens))
        if None not in found:
            return b"".join(found)
        new = {t: array("I", self._spell(t)).tobytes() for t in {t for t, x in zip(tokens, found, strict=True) if x is None}}
        out = b"".join([x if x is not None else new[t] for t, x in zip(tokens, found, strict=True)])
        cache.update({t: x for t, x in new.items() if len(t) <= LONGEST})
        return out

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """ids of words that were not met before."""
        out, rest, model = {}, [], self.tokenizer.model
        for w in words:
            text = w.decode("utf-8", "replace")
            if self.plain and text.isalpha() and max(text) < "\u0250" and "İ" not in text and unicodedata.is_normalized("NFC", text):
                # letters alone are one pre-token, which only is lower-cased and spelt in bytes
                out[w] = np.array([t.id for t in model.tokenize(text.lower().encode().decode("latin-1").translate(SPELT))], "<u4").tobytes()
            else:
                rest.append(w)
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        out.update({w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, found, strict=True)})
        return out

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if self.plain and "<|" not in text and PLAIN.match(text):
            text, out, at = text.lower(), [], 0
            while at < len(text):
                end = len(text) if at + CHUNK >= len(text) or not (gap := GAP.search(text, at + CHUNK)) else gap.start()
                if len(self.cache) > CACHE:
                    self.cache.clear()
                out.append(self._plain_ids(text[at:end]))
                at = end
            return b"".join(out)
        data = text.encode("utf-8", "replace")
        if b"<|" not in data:  # the names of special tokens are case-sensitive
            data = data.lower()
        words = data.split()
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        if missing := set(words).difference(cache):
            ends = {w for w in missing if len(w) > 1 and w[-1] in b".," and 97 <= w[-2] <= 122}
            plain = [w for w in (missing - ends) | {w[:-1] for w in ends} | {w[-1:] for w in ends} if w not in cache]
            new = self.learn(plain)
            long = {w: i for w, i in new.items() if len(w) > LONGEST}
            cache.update(new)
            cache.update({w: cache[w[:-1]] + cache[w[-1:]] for w in ends})
            out = b"".join([cache[w] for w in words])
            for w in [*long, *(w for w in ends if len(w) > LONGEST)]:
                del cache[w]
            return out
        return b"".join([cache[w] for w in words])


def worker_words(path: str) -> Words:
    """The Words of this Python worker: what it has learnt serves all its tasks."""
    state = sys.modules.setdefault("_refrain_worker", types.ModuleType("_refrain_worker")).__dict__
    if path not in state:
        state[path] = Words(path)
    return state[path]


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and then ``end``, cut after every ``capacity`` ids; little-endian unsigned 32-bit ids as binary."""
    columns = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches):
        words = worker_words(tokenizer)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[] for _ in columns]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.ids(text.as_py() or "") + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, x in zip(rows, (doc_id, k, at // 4, len(part) // 4, part), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def exact(left: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that fill the gap exactly, the longest first."""
    if left[gap]:
        return [gap]
    most = int(np.flatnonzero(left[: gap + 1]).max(initial=0))

    def pair(rest: int, high: int) -> int:
        a = np.arange((rest + 1) // 2, min(high, rest - 1) + 1)
        ok = (left[a] > 0) & (left[rest - a] > (a == rest - a))
        return int(a[ok][-1]) if ok.any() else 0

    if 2 * most >= gap and (a := pair(gap, most)):
        return [a, gap - a]
    if 3 * most >= gap:
        for a in np.flatnonzero(left[: gap - 1])[::-1].tolist():
            if 3 * a < gap:
                break
            left[a] -= 1
            b = pair(gap - a, a)
            left[a] += 1
            if b:
                return [a, b, gap - a - b]
    return None


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(length, first rank, first sequence, offset) of runs of places, by length and rank; how many sequences there are."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used, runs, sequences = np.zeros(capacity + 1, np.int64), [], 0
    for longest in range(capacity, 0, -1):
        while left[longest]:
            pattern, gap = [longest], capacity - longest
            left[longest] -= 1
            while gap:
                fill = exact(left, gap)
                if fill is None:
                    fits = np.flatnonzero(left[: gap + 1])
                    if not len(fits):
                        break
                    fill = [int(fits[-1])]
                for x in fill:
                    left[x] -= 1
                pattern += fill
                gap -= sum(fill)
            for x in pattern:
                left[x] += 1
            times = min(int(left[x]) // n for x, n in Counter(pattern).items())
            at = 0
            for x in pattern:
                runs.append((x, used[x], sequences, at))
                used[x] += times
                left[x] -= times
                at += x
            sequences += times
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3], sequences


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs`` (columns doc_id, text; others are ignored); with ``ids`` also its ids.

    A null or empty text is one piece, the id 0. Repeated rows and ids are packed as they
    come; a null doc_id stays null. An empty table gives no rows.
    """
    told, more = ["doc_id", "piece", "start", "length", "ids_crc32"], ["ids"] if ids else []
    cut = materialise(pieces(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids")).select(*told, *more), "pieces")
    found = dict(cut.groupBy("length").agg(F.count("*")).collect())  # capacity rows at most
    lengths, ranks, firsts, offsets, _ = plan(found, capacity)
    salts = F.lit([-(-found.get(n, 1) // SALTED) for n in range(capacity + 1)])  # only lengths of many pieces are ranked by several tasks
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(salts, F.col("length").cast("int"))).cast("int"))
    counts = materialise(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(own)).join(bases, ["length", "salt"])
    key = lengths << 48 | ranks

    def place(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, length << 48 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at]), *batch.columns[6:]], names=[*told, "sequence_id", "offset", *more])

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * ids
    return ranked.select(*told, (F.col("base") + F.col("k") - 1).cast("long").alias("rank"), *more).mapInArrow(place, kinds)


def sequences(docs: DataFrame, **options) -> DataFrame:
    """(sequence_id, length, ids) of every sequence: the ids of its pieces, one after the other, as binary of little-endian unsigned 32-bit ids."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    whole = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))
    return pack(docs, ids=True, **options).groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
