"""Toxicity: noisy-channel restoration of disguised words, then a score."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finweave.llm.shared import bounded, free, trim, working
from finweave.llm.tokens import steps

# Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c", "#": "h",
}
#: Cost (nats) of a letter for a sign, of dropping a sign, of dropping a
#: repeated letter and of a word border within a spaced-out run.
SWAP, DROP, REPEAT, BORDER = 1.0, 5.0, 0.5, 3.0
#: Symbols of the language model: 0 is a word border, 1..26 a..z, 27..62 the
#: accented letters of Latin-1, 63 any other letter.
SYMBOLS = 64
#: Spaced-out words: three or more single letters or signs with one or two marks between.
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+])(?:[ .\-_*]{1,2}(?:[^\W_]|[@$!|+])){2,}(?![^\W_])")
#: The same for Arrow's kernels, a little wider.
SPACED_HINT = r"(?:^|[^\pL\pN])[\pL\pN@$!|+][ .\-_*]{1,2}[\pL\pN@$!|+][ .\-_*]{1,2}[\pL\pN@$!|+](?:[^\pL\pN]|$)"
#: Marks around a word; at its end those that may stand for letters as well.
MARKS = "\"'`.,;:?)[]{}>*%&-_~^/\\="
#: Signs that are letters, not punctuation, at the end of a word as well.
ENDS = frozenset("$@|+")
DOUBLE = re.compile(r"([^\W\d_])\1")
#: Numbers with at most a sign on each side.
AMOUNT = re.compile(r"[$€£¢#+<(|]?\d[\d.,:/%-]*[$€£¢+!(]?")
WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6, 7)


def symbol(c: str) -> int:
    o = ord(c)
    if 97 <= o <= 122:
        return o - 96
    if 0xDF <= o <= 0xFF and o != 0xF7:
        return 27 + o - 0xDF
    return 63 if c.isalpha() else 0


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(codes), np.uint8)
    low = (codes >= 97) & (codes <= 122)
    out[low] = codes[low] - 96
    accents = (codes >= 0xDF) & (codes <= 0xFF) & (codes != 0xF7)
    out[accents] = codes[accents] - 0xDF + 27
    out[(codes >= 0x100) & ~((codes >= 0x2000) & (codes <= 0x2BFF))] = 63
    return out


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all character trigrams of all documents, borders taken
    together: SYMBOLS ** 3 numbers, added up before they come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("toxicity")
        sums = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in steps(batch, "text", 2_000_000):
                s = symbols(" " + " ".join(pc.fill_null(pc.utf8_lower(part["text"]), "").to_pylist()) + " ")
                s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))].astype(np.int32)
                sums += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at], pa.int64())], names=["gram", "n"])

    out = np.zeros(SYMBOLS**3)
    for gram, n in bounded(docs).select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
        out[gram] = n
    return out


@dataclass
class Model:
    """lm: cost of a symbol after two others; weights: of words and of their
    beginnings (``xyz*``); bias. ``restore`` keeps its results."""

    lm: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    kept: dict[str, str] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {"lm": self.lm, "weights": self.weights, "bias": self.bias, "kept": {}}

    def restore(self, token: str) -> str:
        """The likeliest words behind a disguised token, by Viterbi search of
        its lattice: states are the last two letters, steps keep, swap or drop
        a character or break the word, costs are the channel's plus the
        language model's."""
        if len(token) > 64:
            return self._decode(token)
        if token not in self.kept:
            if len(self.kept) > 50_000:
                self.kept.clear()
            self.kept[token] = self._decode(token)
        return self.kept[token]

    def _decode(self, token: str) -> str:
        lm = self.lm
        states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        last = ""
        for c in token:
            after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}

            def reach(key: tuple[int, int, str], cost: float, back: tuple | None, after: dict = after) -> None:
                if key not in after or cost < after[key][0]:
                    after[key] = (cost, back)

            for (a, b, x), (cost, back) in states.items():
                if c.isalpha():
                    s = symbol(c)
                    reach((b, s, c), cost + lm[a, b, s], (c, back))
                    if x == c:
                        reach((a, b, x), cost + REPEAT, back)
                else:
                    for z in LEET.get(c, ""):
                        s = symbol(z)
                        reach((b, s, z), cost + lm[a, b, s] + SWAP, (z, back))
                        if x == z and c == last:
                            reach((a, b, x), cost + REPEAT, back)
                    reach((a, b, x), cost + (DROP if c in LEET else 0.0), back)
                    if c not in LEET and b:
                        reach((b, 0, ""), cost + lm[a, b, 0] + BORDER, (" ", back))
            last = c
            states = after
        end = min(states.items(), key=lambda kv: kv[1][0] + lm[kv[0][0], kv[0][1], 0])
        out, back = [], end[1][1]
        while back is not None:
            out.append(back[0])
            back = back[1]
        return "".join(reversed(out))

    def words(self, token: str) -> list[str]:
        """The words of a token (lower case, no white space) after restoration.
        Tokens of any length are decoded if they hold a sign or a doubled
        letter; their plain reading is kept beside. Plain numbers and amounts
        are no words, and ``!``, ``(`` and ``<`` at a word's end are marks."""
        full = token.strip(MARKS)
        if not any(x.isalpha() for x in token):
            signs = {x for x in full if x in LEET}
            if len(full) < 3 or len(signs) < 2 or AMOUNT.fullmatch(full) or all(x.isdigit() or x not in LEET for x in full):
                return []
            return self.restore(full).split()
        core = token.rstrip(MARKS + "$@!|+(<").lstrip(MARKS)
        end = full[len(core) :]
        more = any(x in ENDS for x in end)
        if core.isalpha() and not more and not DOUBLE.search(core):
            return [core]
        found = WORDS.findall(core)
        decoded = DOUBLE.search(core) or any(x in LEET for x in core)
        if not decoded and not more:
            return found if len(found) != len(core) else []
        # a disguise may go with what the plain words say
        out = self.restore(core).split() if decoded else []
        if more:
            out += self.restore(full.rstrip("!(<")).split()
        return list(dict.fromkeys(out + ([core] if core.isalpha() else [w for w in found if len(w) > 2])))

    def features(self, token: str) -> list[str]:
        out = []
        for w in self.words(token):
            out.append(w)
            out += [w[:n] + "*" for n in PREFIXES if len(w) >= n]
        return out

    def weight(self, token: str) -> float:
        w = self.weights
        return sum(w[f] for f in self.features(token) if f in w)

    def spaced(self, text: str) -> list[str]:
        """Restored words of the spaced-out runs of a lower-case text."""
        out = []
        for m in SPACED.finditer(text):
            out += [w for w in self.restore(m[0]).split() if len(w) > 2]
        return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Trigram costs, interpolated with bigrams and single symbols."""
    c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    c2 = c3.sum(0)
    c1 = c2.sum(0) + 1.0
    p1 = c1 / c1.sum()
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
    return -np.log(p3)


def _tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens, their numbers in order of the texts, and borders."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    borders = split.offsets.to_numpy().astype(np.int64)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), borders - borders[0]


def doc_features(model: Model, text: str) -> Counter:
    low = text.lower()
    out: Counter = Counter()
    for token in low.split():
        out.update(model.features(token))
    for w in model.spaced(low):
        out.update([w, *(w[:n] + "*" for n in PREFIXES if len(w) >= n)])
    return out


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text and toxic of labelled documents that are not held out: all, or the
    ``most`` of least hash, which bounds what is sent to executors. Of rows
    that share a doc_id one counts, that with the least text hash."""
    ids = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").alias("toxic"))
    ids = ids.filter(~held_out(F.col("__id"))).orderBy(F.xxhash64("__id"), "__id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__id"))
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = 12_000, top: int = 3_000, gain: float = 10.0, fewest: int = 3, ridge: float = 0.05) -> Model:
    """Language model from all documents; classifier from up to ``most``
    labelled rows. Its features are restored words and their beginnings, by how
    often they occur, in training as in scores. Selection, by presence in
    documents: those in ``fewest`` or more toxic ones whose signed likelihood
    ratio towards toxic is above ``gain``, the ``top`` of them; so only words
    that speak for toxicity weigh. A ridge logistic regression weights them.
    Without labels of both kinds nothing is toxic."""
    model = Model(language_model(character_counts(docs)))
    rows = labelled(docs, labels, most).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("toxicity")
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                counts[y == 1].update(doc_features(model, text or "").keys())
                counts[y == 1][""] += 1
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({"f": pa.array(names, pa.string()), "n0": pa.array([counts[0][x] for x in names], pa.int64()), "n1": pa.array([counts[1][x] for x in names], pa.int64())})

    sums = rows.mapInArrow(tally, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sums = sums.filter((F.col("f") == "") | (F.col("n1") >= fewest)).toArrow()
    a, b, words = sums["n0"].to_numpy().astype(float), sums["n1"].to_numpy().astype(float), sums["f"].to_numpy()
    whole = words == ""
    n0, n1 = float(a[whole].sum()), float(b[whole].sum())
    if not n0 or not n1:
        model.bias = -6.0
        return model
    # signed likelihood ratio of presence in b of n1 and a of n0
    p = (a + b) / (n0 + n1)
    part = lambda k, n: sum(np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(n * q, 1e-300)), 0.0) for x, q in ((k, p), (n - k, 1 - p)))
    ratio = np.where(b / n1 > a / n0, 2.0, -2.0) * (part(a, n0) + part(b, n1))
    ratio[whole] = -1
    names = [str(words[i]) for i in np.lexsort((words.astype(str), -ratio))[:top] if ratio[i] > gain]
    index = {f: i for i, f in enumerate(names)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for text in batch["text"].to_pylist():
                c = doc_features(model, text or "")
                hits.append([(index[f], n) for f, n in c.items() if f in index])
            yield pa.RecordBatch.from_arrays([batch["toxic"].cast(pa.int32()), pa.array([[i for i, _ in h] for h in hits], pa.list_(pa.int32())), pa.array([[n for _, n in h] for h in hits], pa.list_(pa.int32()))], names=["y", "f", "n"])

    got = rows.mapInArrow(sparse, "y int, f array<int>, n array<int>").toArrow().combine_chunks()
    y = got["y"].to_numpy().astype(float)
    row = np.repeat(np.arange(len(y)), pc.list_value_length(got["f"]).to_numpy())
    col, val = (pc.list_flatten(got[x]).to_numpy().astype(kind) for x, kind in (("f", int), ("n", float)))
    theta, bias = logistic(row, col, val, y, len(names), ridge)
    model.weights = {f: float(w) for f, w in zip(names, theta, strict=True) if abs(w) > 1e-4}
    model.bias = float(bias)
    trim()
    return model


def logistic(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, width: int, ridge: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on sparse counts by accelerated gradients;
    order of rows is made immaterial up to rounding by sorting."""
    n = len(y)
    theta, bias, m, v = np.zeros(width), 0.0, np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, rounds + 1):
        z = np.bincount(row, val * theta[col], n) + bias
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(col, val * e[row], width) + ridge * theta, e.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        theta, bias = theta - step[:-1], bias - step[-1]
    return theta, bias


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Adds the score (0 to 1) of every whole text; null texts score as empty
    ones, all other columns pass through."""
    kind = T.StructType([f for f in docs.schema.fields if f.name != name] + [T.StructField(name, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("toxicity")
        m = sent.value
        for batch in batches:
            for part in steps(batch, "text"):
                tokens, codes, borders = _tokens(part["text"])
                each = np.fromiter(map(m.weight, tokens), float, len(tokens))
                z = np.append(0.0, np.cumsum(each[codes] if len(codes) else np.zeros(0)))
                z = np.where(np.diff(borders) > 0, z[borders[1:]] - z[borders[:-1]], 0.0) + m.bias
                for i in pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(pc.utf8_lower(part["text"]), SPACED_HINT), False)).to_pylist():
                    for w in m.spaced(part["text"][i].as_py().lower()):
                        z[i] += m.weight(w)
                cols = [c for c, n in zip(part.columns, part.schema.names, strict=True) if n != name]
                names = [n for n in part.schema.names if n != name]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(1 / (1 + np.exp(-np.clip(np.round(z, 9), -40, 40))))], names=[*names, name])

    return bounded(docs).mapInArrow(run, kind)


def scored(docs: DataFrame, labels: DataFrame, least: float = 0.7, most: int = 12_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    out = score(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs, labels, most))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.7, most: int = 12_000) -> DataFrame:
    """The documents that are not toxic, with the columns of ``docs``."""
    name = free(docs, "__toxicity")
    return score(docs, fit(docs, labels, most), name).filter(F.col(name) < least).drop(name)
