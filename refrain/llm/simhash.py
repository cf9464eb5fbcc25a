"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most
``max_bits`` <= 3 bits share at least 8 - max_bits of them, the guaranteed minimum.
Postings of single bytes would hold 1/256 of the corpus each, so the index is keyed by
four positional bytes at once: the 14 blocks of the Steiner system S(3,4,8). Whichever
three bytes differ, one block avoids them all, so every link shares a key. Within a key
the shared positional bytes of each pair are tallied, pairs that reach the guaranteed
minimum are retained, and those are verified by their differing bits.

Equal fingerprints are one class before anything is compared. A key with many classes is
dealt out in blocks, so that no task holds a whole group, and each block sends on a
spanning forest of its links, never the links themselves. Blocks are only compared with
one another for fingerprints that their own blocks and a few pivots have left apart.

Three bits of 64 only reach texts that are nearly equal: shingle sets of similarity 0.8
differ in about ten. Groups may therefore also be linked by ``similarity``: ten keys of four
least hashes each find the candidates (one of 0.8 is found with 99.5 %). A sketch of 256
bins of least hashes, off by 0.025 for long texts, only parts them loosely, at ``LOOSE``
below what is asked; within a part every link is verified on the whole shingle sets. Keys
that the same texts share are one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import EDGE, connected_components, edge_batch, forest, materialise, stars

#: Byte positions of the 14 blocks of S(3,4,8): the complements of the blocks cover every three positions.
BLOCKS = [(0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 4, 5), (2, 3, 6, 7), (0, 1, 6, 7), (2, 3, 4, 5), (0, 2, 4, 6), (1, 3, 5, 7), (0, 2, 5, 7), (1, 3, 4, 6), (0, 3, 4, 7), (1, 2, 5, 6), (0, 3, 5, 6), (1, 2, 4, 7)]
#: Shingles hashed at a time: the memory a very long text takes doesn't grow with it.
CHUNK = 65_536
#: Classes of one key that are compared in one block.
BLOCK_ROWS = 256
#: Groups of at most so many rows are compared all at once, by shifts.
SMALL = 12
#: Fingerprints of a key, about, that are compared with all others in it; rows that a task holds at a time.
PIVOTS, ROWS = 16, 50_000
#: Keys of a text's shingle set, and least hashes in each; bins of its sketch; texts of one key that are compared in one block, and their bytes.
KEYS, EACH, BINS, SKETCH_ROWS, SKETCH_BYTES = 10, 4, 256, 2048, 1 << 24
#: How far below the asked similarity sketches may be for a pair to be verified.
LOOSE = 0.1
ODD = np.random.default_rng(20250107).integers(0, 2**63, KEYS * EACH, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int):
    """XXH64 (seed 42) of the lower-cased words' shingles, repeats included, a chunk at a time. No words: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    for at in range(0, len(starts), CHUNK):
        yield np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], np.uint64)


class Sums:
    """What a text's shingle hashes come to: its SimHash, and the keys and sketch of its shingle set."""

    def __init__(self, sketch: bool = False):
        self.total, self.n = np.zeros(64, np.int64), 0
        self.least = np.full(KEYS * EACH, 2**64 - 1, np.uint64) if sketch else None
        self.bins = np.full(BINS, 2**64 - 1, np.uint64) if sketch else None

    def add(self, h: np.ndarray) -> None:
        self.total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        self.n += len(h)
        if self.bins is None:
            return
        h = np.unique(h)
        for at in range(0, len(h), 4096):
            self.least = np.minimum(self.least, (h[at : at + 4096, None] * ODD).min(axis=0))
        own = h >> np.uint64(56)  # sorted, so the first of each bin is its least
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        at = own[first].astype(np.int64)
        self.bins[at] = np.minimum(self.bins[at], h[first])

    def fingerprint(self) -> int:
        """A bit is 1 if it is in over half the hashes. No words: 0."""
        return int.from_bytes(np.packbits(self.total * 2 > self.n).tobytes(), "big")

    def keys(self) -> list[int]:
        if not self.n:
            return []
        parts = self.least.reshape(KEYS, EACH)
        return [xxhash.xxh64_intdigest(part.tobytes(), i) >> 1 for i, part in enumerate(parts)]

    def sketch(self) -> bytes:
        """A byte for each bin: 0 if it is empty, else 1 to 255 by its least hash."""
        return np.where(self.bins == np.uint64(2**64 - 1), 0, self.bins % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()


def sums(text: str | None, shingle: int, sketch: bool = False) -> Sums:
    out = Sums(sketch)
    for h in shingle_hashes(text, shingle):
        out.add(h)
    return out


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned SimHash of the text's shingles."""
    return sums(text, shingle).fingerprint()


def fingerprints(docs: DataFrame, shingle: int = 3, sketch: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long; with ``sketch`` also (keys, sketch) of the shingle set, and the text's hash and bytes (h, size)."""

    def run(batches):
        for batch in batches:
            each = [sums(t.as_py(), shingle, sketch) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(np.array([x.fingerprint() for x in each], np.uint64).view(np.int64))]
            if sketch:
                columns += [pa.array([x.keys() for x in each], pa.list_(pa.int64())), pa.array([x.sketch() for x in each], pa.binary()), batch.column(2), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "keys", "sketch", "h", "size"][: len(columns)])

    more = [F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")] if sketch else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(run, "doc_id long, fp long" + ", keys array<long>, sketch binary, h long, size long" * sketch)


def _key(block: tuple[int, ...], index: int) -> Column:
    """The block's number and its four bytes in one long."""
    parts = [F.shiftleft(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)), 8 * i) for i, p in enumerate(block)]
    out = F.lit(index << 32).cast("long")
    for part in parts:
        out = out.bitwiseOR(part.cast("long"))
    return out


def near_in(fp: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """A spanning forest of one key's links: each row is tallied once against the rows that no group has taken yet, so that no list of pairs is held."""
    least, left = 8 - max_bits, np.arange(len(fp))
    a: list[int] = []
    b: list[int] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            differ = fp[left] ^ fp[x]
            near = 8 - np.count_nonzero(differ.view(np.uint8).reshape(-1, 8), axis=1) >= least
            near[near] = np.bitwise_count(differ[near]) <= max_bits
            found = left[near].tolist()
            a += [x] * len(found)
            b += found
            queue += found
            left = left[~near]
    return a, b


def links_in(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows that share a key, enough of them to join all that links join; rows are sorted by key."""
    least = 8 - max_bits
    a, b = [np.array([], fp.dtype)], [np.array([], fp.dtype)]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], int)
    sizes = np.diff(np.append(starts, len(key)))
    small = np.repeat(sizes <= SMALL, sizes)
    for shift in range(1, min(SMALL, sizes.max(initial=1))):
        i = np.flatnonzero((key[shift:] == key[:-shift]) & small[shift:])
        differ = fp[i] ^ fp[i + shift]
        kept = 8 - np.count_nonzero(differ.view(np.uint8).reshape(-1, 8), axis=1) >= least
        kept[kept] = np.bitwise_count(differ[kept]) <= max_bits
        a.append(fp[i[kept]])
        b.append(fp[i[kept] + shift])
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        own = fp[start : start + size]
        i, j = near_in(own, max_bits)
        a.append(own[i])
        b.append(own[j])
    return np.concatenate(a), np.concatenate(b)


def links_in_blocks(keyed: DataFrame, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A spanning forest (a, b) of the links that ``compare`` finds among rows (k, fp, n, blocks) of one key; it takes (group, fp).

    A key of n rows is dealt to its blocks, each row once, with up to PIVOTS of them in
    every block. In most keys that joins whatever is linked; of the rest only pairs of rows
    that are still apart are compared, all of them, in pairs of blocks: those of the key's
    largest part against the others, and the others among themselves.
    """
    spot = lambda blocks: F.pmod(F.xxhash64("fp"), blocks).cast("int")
    numbers = lambda n: F.sequence(F.lit(0), n - 1)
    pivot = F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("n")) < F.least(F.lit(PIVOTS), F.floor(F.col("n") / (4 * F.col("blocks"))))
    everywhere = F.when(pivot, numbers(F.col("blocks"))).otherwise(F.array(spot(F.col("blocks"))))
    links = materialise(compare(keyed.select("k", "fp", F.explode(everywhere).alias("block")).select(F.xxhash64("k", "block").alias("group"), "fp")), "links")
    many = keyed.where("blocks > 1")
    if not many.limit(1).count():
        return links
    parts = materialise(connected_components(links), "parts")
    many = many.join(parts, many["fp"] == parts["node"], "left").select("k", "fp", (F.col("blocks") / F.col("n")).alias("share"), F.coalesce("component", "fp").alias("part"))
    many = materialise(many, "many")
    sizes = many.groupBy("k", "part").agg(F.count("*").alias("c"), F.max("share").alias("share"))
    apart = sizes.groupBy("k").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.max("c").alias("c"), F.sum("c").alias("total"), F.max("share").alias("share")).where("c < total")
    apart = materialise(apart.select("k", "main", F.ceil(F.col("c") * F.col("share")).cast("int").alias("m"), F.ceil((F.col("total") - F.col("c")) * F.col("share")).cast("int").alias("o")), "apart")
    rest = many.drop("share").join(apart, "k")
    main, other = rest.where("part = main"), rest.where("part != main")
    across = main.select("k", "fp", spot(F.col("m")).alias("i"), F.explode(numbers(F.col("o"))).alias("j")).union(other.select("k", "fp", F.explode(numbers(F.col("m"))).alias("i"), spot(F.col("o")).alias("j")))
    among = other.select("k", "fp", spot(F.col("o")).alias("own"), F.explode(numbers(F.col("o"))).alias("j")).select("k", "fp", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"))
    second = across.select(F.xxhash64("k", F.lit(0), "i", "j").alias("group"), "fp").union(among.select(F.xxhash64("k", F.lit(1), "i", "j").alias("group"), "fp"))
    return links.union(compare(second))


def fingerprint_links(classes: DataFrame, max_bits: int = 3) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct fingerprints (column fp, no nulls)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees links of at most 3 differing bits")
    index = classes.select("fp", F.explode(F.array(*[_key(b, i) for i, b in enumerate(BLOCKS)])).alias("k"))
    live = index.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    live = materialise(live.select("k", "n", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")), "live")

    def compare(table: pa.Table):
        group, fp = table.column(0).to_numpy(), table.column(1).to_numpy().view(np.uint64)
        x, y = links_in(group, fp, max_bits)
        if len(x):
            yield edge_batch(*stars(x.view(np.int64), y.view(np.int64)))

    return links_in_blocks(materialise(index.join(live, "k"), "keyed"), lambda dealt: _by_group(dealt, compare, ROWS))


def _by_group(dealt: DataFrame, compare, rows_at_once: int) -> DataFrame:
    """(a, b) of ``compare`` over tables of whole groups (column group), about so many rows or SKETCH_BYTES at a time."""

    def run(batches):
        tail: list[pa.RecordBatch] = []
        rows = held = 0
        for batch in batches:
            tail.append(batch)
            rows += batch.num_rows
            held += batch.nbytes
            if rows >= rows_at_once or held >= SKETCH_BYTES:  # whole groups go; the last may go on in the next batch
                table = pa.Table.from_batches(tail).combine_chunks()
                group = table.column(0).to_numpy()
                cut = int(np.searchsorted(group, group[-1]))
                yield from compare(table.slice(0, cut))
                rest = table.slice(cut).combine_chunks()
                tail, rows, held = rest.to_batches(), rest.num_rows, rest.nbytes
        if rows:
            yield from compare(pa.Table.from_batches(tail).combine_chunks())

    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")


def similar_in(sketches: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of rows whose sketches' similarity is at least ``least``: each row looks once among those that no group has taken."""
    left, filled = np.arange(len(sketches)), sketches > 0
    a: list[int] = []
    b: list[int] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            same = ((sketches[left] == sketches[x]) & filled[x]).sum(axis=1)
            near = same >= (least - 1e-9) * np.maximum(1, (filled[left] | filled[x]).sum(axis=1))
            found = left[near].tolist()
            a += [x] * len(found)
            b += found
            queue += found
            left = left[~near]
    return a, b


def exact_in(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of sets (of distinct hashes, none empty) whose similarity is at least ``least``."""
    size = np.array([len(x) for x in sets])
    hashes, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(size)[:-1])
    left = held = np.arange(len(sets))
    starts, has = np.cumsum(size) - size, np.zeros(len(hashes), bool)
    a: list[int] = []
    b: list[int] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            if 2 * len(left) < len(held):
                held, flat = left, np.concatenate([own[i] for i in left.tolist()])
                starts = np.cumsum(size[held]) - size[held]
            x = queue.pop()
            has[own[x]] = True
            same = np.add.reduceat(has[flat], starts, dtype=np.int64)[np.searchsorted(held, left)]
            has[own[x]] = False
            near = same >= (least - 1e-9) * (size[left] + size[x] - same)
            found = left[near].tolist()
            a += [x] * len(found)
            b += found
            queue += found
            left = left[~near]
    return a, b


def verified_in(sketches: np.ndarray, texts: pa.ChunkedArray, shingle: int, least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of texts whose shingle sets' similarity is at least ``least``, of those that loose links of sketches join."""
    i, j = similar_in(sketches, least - LOOSE)
    a: list[int] = []
    b: list[int] = []
    if i:
        label = forest(len(sketches), np.array(i), np.array(j))
        order = np.argsort(label, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            if len(part) > 1:
                sets = [np.unique(np.concatenate(list(shingle_hashes(texts[k].as_py(), shingle)))) for k in part.tolist()]
                x, y = exact_in(sets, least)
                a += part[x].tolist()
                b += part[y].tolist()
    return a, b


def similarity_links(classes: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """A spanning forest (a, b) of the links between fingerprints (columns fp, keys, sketch, h, size) whose texts, rows of ``docs``, have shingle sets so similar."""
    index = classes.select("fp", "h", "size", F.explode(F.array_distinct("keys")).alias("k"))
    shared = index.groupBy("k").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "fp")).alias("y")).where("n > 1")
    live = shared.groupBy("n", "size", "x", "y").agg(F.min("k").alias("k")).select("k", "n", F.greatest(F.ceil(F.col("n") / SKETCH_ROWS), F.ceil(F.col("size") / SKETCH_BYTES)).cast("int").alias("blocks"))
    keyed = materialise(index.join(materialise(live, "live"), "k").select("k", "fp", "h", "n", "blocks"), "keyed")
    texts = docs.select(F.xxhash64("text").alias("h"), "text").join(keyed.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.min("text").alias("text"))
    held = materialise(classes.select("h", "fp", "sketch").join(texts, "h").select("fp", "sketch", "text"), "texts")

    def compare(table: pa.Table):
        group, fp = table.column(0).to_numpy(), table.column(1).to_numpy()
        ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)).tolist()
        x, y, at = [], [], 0
        for end in ends if len(group) else ():
            if end - at > 1:
                own = b"".join(table.column(2).slice(at, end - at).to_pylist())
                i, j = verified_in(np.frombuffer(own, np.uint8).reshape(-1, BINS), table.column(3).slice(at, end - at), shingle, similarity)
                x.append(fp[at:end][i])
                y.append(fp[at:end][j])
            at = end
        if sum(map(len, x)):
            yield edge_batch(*stars(np.concatenate(x), np.concatenate(y)))

    return links_in_blocks(keyed.drop("h"), lambda dealt: _by_group(dealt.join(held, "fp").select("group", "fp", "sketch", "text"), compare, 2_000))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3, similarity: float | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (columns doc_id, text; others are ignored).

    A null, empty or blank text has fingerprint zero, which links like any other. A null
    doc_id keeps its row; component_id is the smallest doc_id of the component that is not
    null (null where there is none). Repeated rows and repeated ids keep a row each. An
    empty table gives no rows.
    """
    own = materialise(fingerprints(docs, shingle, similarity is not None), "simhash")
    classes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    links = fingerprint_links(classes, max_bits)
    if similarity is not None:  # texts of one fingerprint are linked; one of them stands for all
        links = links.union(similarity_links(materialise(own.groupBy("fp").agg(F.min(F.struct("h", "size", "keys", "sketch")).alias("x")).select("fp", "x.*"), "sets"), docs, shingle, similarity))
    parts = materialise(connected_components(links), "parts")
    named = materialise(classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("part")), "named")
    lows = materialise(named.groupBy("part").agg(F.min("low").alias("component_id")), "lows")
    whole = materialise(named.join(lows, "part").select("fp", "component_id"), "whole")
    return own.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, shingle: int = 5, max_bits: int = 3, similarity: float | None = 0.8) -> DataFrame:
    """The rows of ``docs`` of which none comes before them in their near-duplicate group: smallest doc_id, one row of equal ids.

    Rows without a doc_id are kept: nothing can name their representative.
    """
    parts = near_duplicates(docs, shingle, max_bits, similarity)
    kept = parts.where("doc_id = component_id").select("doc_id").distinct()
    columns = docs.columns
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    if named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        named = named.dropDuplicates(["doc_id"])
    return named.select(*columns).unionByName(docs.where("doc_id is null").select(*columns))
