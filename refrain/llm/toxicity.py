"""Toxicity by noisy-channel deobfuscation and a linear model of words.

A writer hides a word by a noisy channel: look-alike digits and symbols, separators
between letters, repeated letters. Each token (or run of single characters) that shows
such noise becomes a character lattice; Viterbi decoding finds the most likely hidden
letters under a character trigram model of the whole corpus and the channel's costs.
The text's words, as written and as restored, are then scored by a logistic model that
is fitted on labelled rows.

The trigram counts are of every character of every document (27^3 sums, combined before
they are shuffled). Only the classifier is fitted on a bounded sample: ``max_labelled``
rows, the smallest by a hash of doc_id.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import materialise

A = 27  # a-z, and 26 for everything else
FOLD = np.full(256, 26, np.uint8)
for _b in range(256):
    _c = unicodedata.normalize("NFD", bytes([_b]).decode("latin-1").lower())[0]
    if "a" <= _c <= "z":
        FOLD[_b] = ord(_c) - 97
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "aeiou"}
APART = set(".-_*~'`^/\\, ​‌‍­")
#: Natural-log costs of the channel.
SWAP, DROP, MERGE = -1.0, -0.3, -0.5
EDGE_MARKS = ".,;:!?\"'()[]{}<>…«»¿¡“”‘’"
SPACED = re.compile(r"(?<!\S)\S(?:\s{1,3}\S){2,}(?!\S)")
#: Marks at the edges that stand for no letter.
MERE_MARKS = "".join(c for c in EDGE_MARKS if c not in LEET)
SPEAKING = frozenset(c for c in EDGE_MARKS if c in LEET)
REPEATED = re.compile(r"(.)\1\1")
DOUBLED = re.compile(r"([^\W\d_])\1")
CHUNK = 1 << 20
PREFIXES = (4, 5, 6)
#: Words of at most so many letters are tried with each choice of their doubled letters written once; longer ones are decoded.
SINGLED = 24
#: Distinct tokens whose features a task remembers, and the longest of them.
CACHE, KEPT = 65_536, 48
#: Least chi-squared of a feature with the label, and the ridge penalty.
CHI, RIDGE = 14.0, 1e-4


def _trigrams(text: str, total: np.ndarray) -> None:
    for at in range(0, len(text), CHUNK):  # two characters overlap, so that no trigram is lost
        x = FOLD[np.frombuffer(text[max(0, at - 2) : at + CHUNK].encode("latin-1", "replace"), np.uint8)].astype(np.int32)
        if len(x) > 2:
            total += np.bincount((x[:-2] * A + x[1:-1]) * A + x[2:], minlength=A**3)


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) as an array (A, A, A), from the trigrams of every text."""

    def run(batches):
        total = np.zeros(A**3, np.int64)
        for batch in batches:
            for t in batch.column(0):
                _trigrams(t.as_py() or "", total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["g", "n"])

    counts = np.zeros(A**3)
    for g, n in docs.select("text").mapInArrow(run, "g int, n long").groupBy("g").agg(F.sum("n")).collect():  # 19,683 rows at most
        counts[g] = n
    tri = counts.reshape(A, A, A) + 0.1
    bi = tri.sum(axis=0) + 0.1
    back = bi / bi.sum(axis=1, keepdims=True)
    return np.log(0.8 * tri / tri.sum(axis=2, keepdims=True) + 0.2 * back[None])


#: What a written character may stand for: (letter's number, as it is written down, cost), and whether it is a letter itself.
_WAYS: dict[str, tuple[list[tuple[int, str, float]], bool]] = {}


def ways_of(c: str) -> tuple[list[tuple[int, str, float]], bool]:
    found = _WAYS.get(c)
    if found is None:
        plain = unicodedata.normalize("NFD", c)[0]
        letter = "a" <= plain <= "z"
        found = [(ord(plain) - 97, c, 0.0)] if letter else [(ord(x) - 97, x, SWAP) for x in LEET.get(c, "")], letter
        if len(_WAYS) < 4096:
            _WAYS[c] = found
    return found


def decode(noisy: str, lm: list) -> str:
    """The likeliest letters behind ``noisy``: Viterbi over (previous letter, last letter), the last two states of the trigram model (its logarithms as nested lists).

    Paths are linked lists of letters, so that a run of any length takes time and memory in proportion.
    """
    best: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(26, 26, ""): (0.0, None)}
    for c in noisy:
        ways, letter = ways_of(c)
        apart = c in APART or c.isspace()
        nxt: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}
        for (p, q, last), (score, out) in best.items():
            row = lm[p][q]
            for x, kept, cost in ways:
                s, key = score + cost + row[x], (q, x, c)
                if key not in nxt or s > nxt[key][0]:
                    nxt[key] = s, (out, kept)
            if last == c:  # one letter typed again
                s, key = score + MERGE, (p, q, c)
                if key not in nxt or s > nxt[key][0]:
                    nxt[key] = s, out
            if apart:
                s, key = score + DROP, (p, q, last)
                if key not in nxt or s > nxt[key][0]:
                    nxt[key] = s, out
            elif not letter and not ways:
                s, key = score + row[26], (q, 26, c)
                if key not in nxt or s > nxt[key][0]:
                    nxt[key] = s, (out, " ")
        best = nxt or best
    out = max(((s + lm[p][q][26], o) for (p, q, _), (s, o) in best.items()), key=lambda x: x[0])[1]
    letters = []
    while out is not None:
        out, kept = out
        letters.append(kept)
    return "".join(reversed(letters))


def noisy(token: str) -> bool:
    """Whether a token (marks at its edges aside) shows the channel's traces: letters together with symbols or digits, or a letter three times."""
    return not token.isalpha() and any(map(str.isalpha, token)) or bool(REPEATED.search(token)) or "$" in token or "@" in token


def single(token: str) -> list[str]:
    """All ways to write some of a token's doubled letters once."""
    at = [m.start() for m in DOUBLED.finditer(token)]
    out = [token]
    for i in reversed(at):
        out += [x[:i] + x[i + 1 :] for x in out]
    return out[1:]


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def features(word: str) -> list[str]:
    """The word and its beginnings (told by a space, which no word holds)."""
    return [word, *(word[:n] + " " for n in PREFIXES if len(word) >= n)]


class Reader:
    """Turns texts into sets of features, with the work of each distinct token done once.

    Without ``known`` features are strings. With it they are the numbers of those known; what
    is written is then decoded only where that may reach one.
    """

    def __init__(self, lm: np.ndarray, known: dict[str, int] | None = None):
        self.lm, self.known, self.cache = lm.tolist(), known, {}
        self.starts = None if known is None else {f[:3] for f in known}
        self.longest = max(map(len, known), default=0) if known else 0

    def keep(self, words: list[str]) -> tuple:
        if self.known is None:
            return tuple(dict.fromkeys(f for w in words if w for f in features(w)))
        out, get = [], self.known.get
        for w in words:
            if w[:3] in self.starts:
                out += [i for i in (get(w), *[get(w[:n] + " ") for n in PREFIXES if len(w) >= n]) if i is not None]
        return tuple(dict.fromkeys(out)) if out else ()

    def token(self, raw: str) -> tuple:
        out = self.keep(self.readings(raw))
        if len(raw) <= KEPT:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[raw] = out
        return out

    def readings(self, raw: str) -> list[str]:
        """The token without the marks at its edges, and what it may hide."""
        word = raw if raw.isascii() else unicodedata.normalize("NFKC", raw)
        inner = word.strip(EDGE_MARKS)
        words = [inner]
        if inner.isalpha() and not DOUBLED.search(inner) and not (len(inner) < len(word) and SPEAKING.intersection(word)):
            return words
        if noisy(inner) or self.hidden(inner):
            words += decode(inner, self.lm).split()
        if inner and len(inner) < len(word):  # marks may stand for the first letter, the last ones, or both
            lead, tail, whole = (word.lstrip(m).rstrip(n) for m, n in ((MERE_MARKS, EDGE_MARKS), (EDGE_MARKS, MERE_MARKS), (MERE_MARKS, MERE_MARKS)))
            for form in dict.fromkeys((lead, tail, whole)):
                if form != inner and noisy(form):
                    words += decode(form, self.lm).split()
        return words

    def hidden(self, word: str) -> bool:
        """Whether a word of digits only, or with a letter twice, may hide one, as its written form is no known feature; a plain word only if a way to write it is known."""
        if word.isdigit():
            return self.known is None or word not in self.known
        if not DOUBLED.search(word):
            return False
        if self.known is None:
            return True
        return word not in self.known and (not word.isascii() or len(word) > SINGLED or bool(self.keep(single(word))))

    def read(self, text: str) -> set:
        text = text.lower()
        out: set = set()
        get, token = self.cache.get, self.token
        for w in set(text.split()):
            found = get(w)
            if found is None:
                found = token(w)
            if found:
                out.update(found)
        for m in SPACED.finditer(text):
            for word in decode(m.group(), self.lm).split():  # several words may be spelt in one run
                parts = [word[i:j] for i in range(len(word)) for j in range(i + 3, min(len(word), i + self.longest) + 1)] if self.known else []
                out.update(self.keep([word, *(x for x in parts if x in self.known)]))
        return out


def fit(row: np.ndarray, col: np.ndarray, y: np.ndarray, n: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """(weights, bias) of a ridge logistic model; row and col are the places of ones among len(y) rows and n features."""
    toxic = y.sum()
    if toxic in (0, len(y)):
        return np.zeros(n), 700.0 if toxic else -700.0
    w, b, m, v = np.zeros(n), math.log(toxic / (len(y) - toxic)), np.zeros(n + 1), np.zeros(n + 1)
    for k in range(1, rounds + 1):  # Adam
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], len(y)), -30, 30)))
        g = np.append(np.bincount(col, (p - y)[row], n) / len(y) + RIDGE * w, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def held_out() -> Column:
    """Rows whose labels are never learnt from: crc32 of doc_id as text leaves 2 by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


class Model:
    """A fitted classifier: the language model, the features' numbers, their weights and the bias."""

    def __init__(self, lm: np.ndarray, number: dict[str, int], w: np.ndarray, b: float, threshold: float):
        self.lm, self.number, self.w, self.b, self.threshold = lm, number, w, b, threshold

    def scorer(self):
        """A function of a batch's texts that gives their scores."""
        reader = Reader(self.lm, self.number)

        def scores(texts: pa.Array) -> np.ndarray:
            found = [list(reader.read(t.as_py() or "")) for t in texts]
            logit = np.array([self.b + self.w[x].sum() if x else self.b for x in found], float)
            return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))

        return scores


def train(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labelled: int = 10_000) -> Model:
    """The model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    lm = language_model(docs)
    judged = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max("toxic").alias("toxic"))
    chosen = judged.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(max_labelled)  # so many rows of 12 bytes, whatever the corpus
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id")).dropDuplicates(["doc_id"])

    def read(batches):
        reader = Reader(lm)
        for batch in batches:
            found = [sorted(reader.read(t.as_py() or "")) for t in batch.column(0)]
            h = [hash_of(t.as_py() or "") for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["h", "y", "found"])

    rows = texts.select("text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).mapInArrow(read, "h long, y int, found array<string>")
    rows = materialise(rows.dropDuplicates(["h", "y"]), "labelled")
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    n0, c1, c0 = n - n1, F.col("c1").cast("double"), F.col("c").cast("double") - F.col("c1")
    chi = n * F.pow(c1 * (n0 - c0) - c0 * (n1 - c1), F.lit(2)) / (F.lit(float(max(1, n1 * n0))) * (c0 + c1) * F.greatest(F.lit(1.0), n - c0 - c1))
    telling = rows.select("y", F.explode("found").alias("f")).groupBy("f").agg(F.sum("y").alias("c1"), F.count("*").alias("c")).where((F.col("c1") >= 3) & (c1 * n0 > c0 * n1) & (chi >= CHI))
    number = {f: i for i, (f, _) in enumerate(telling.select("f", chi.alias("chi")).orderBy(F.desc("chi"), "f").collect())}  # words of max_labelled rows at most

    def mark(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sorted(number[f] for f in x.as_py() if f in number) for x in batch.column(2)], pa.list_(pa.int32()))], names=["h", "y", "found"])

    marked = sorted(map(tuple, rows.mapInArrow(mark, "h long, y int, found array<int>").collect()))  # max_labelled rows at most, of features that were chosen
    row, col = np.repeat(np.arange(len(marked)), [len(x[2]) for x in marked]), np.array([f for x in marked for f in x[2]], int)
    w, b = fit(row, col, np.array([x[1] for x in marked], float), len(number))
    return Model(lm, number, w, b, threshold)


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (columns doc_id, text; others never touch a score).

    Null and empty texts have no features and get the model's base rate. Labels that are null
    are skipped; of several labels of an id the largest counts; rows with equal texts are
    learnt once. Without labels of both kinds every score is the one label's value (0 with none).
    Repeated rows keep a row each, an empty table gives none.
    """
    model = train(docs, labels, **options)

    def run(batches):
        scores = model.scorer()
        for batch in batches:
            s = scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= model.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns."""
    model = train(docs, labels, **options)
    at = docs.columns.index("text")

    def run(batches):
        scores = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) < model.threshold))

    return docs.mapInArrow(run, docs.schema)
