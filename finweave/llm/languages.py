"""Language identification: a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from finweave.llm.shared import bounded, materialise, trim, working
from finweave.llm.tokens import steps

UNKNOWN = "und"
#: Words of a training window and of a training sequence; a sequence runs over
#: windows of several documents, so switches of language are learned from.
WINDOW, SEQUENCE = 32, 64
#: Words between two places where the chain is cut for work in parallel.
STRIDE = 64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (lower case; runs of letters and their marks), their
    numbers in order of the texts, and borders."""
    low = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pM]+", " ")
    split = pc.ascii_split_whitespace(low)
    flat = split.flatten()
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    borders = split.offsets.to_numpy().astype(np.int64)
    borders = borders - borders[0]
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    return coded.dictionary.to_pylist(), codes[real], np.append(0, np.cumsum(real))[borders]


#: Odd multipliers that mix a feature's kind and letters into its key.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _keys(kind: int, letters: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of features of a kind: of rows of letters."""
    out = np.full(len(letters[0]), kind + 1, np.uint64) * _MIX[0]
    for x, m in zip(letters, _MIX[1:], strict=False):
        out = (out ^ x) * m
        out ^= out >> np.uint64(29)
    return out


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words and keys of their features: affixes of one to four
    letters, and pairs and triples of letters with the word's borders."""
    joined = "".join(f"^{w}$" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 2) - size - 2
    owners, keys = [], []
    for n in range(1, 5):
        has = np.flatnonzero(size >= n)
        for kind, first in ((0, start[has] + 1), (1, start[has] + 1 + size[has] - n)):
            owners.append(has)
            keys.append(_keys(8 * kind + n, [codes[first + i] for i in range(n)]))
    owner = np.repeat(np.arange(len(words)), size + 2)
    left = np.repeat(start + size + 2, size + 2) - np.arange(len(codes))
    for n in (2, 3):
        at = np.flatnonzero(left >= n)
        owners.append(owner[at])
        keys.append(_keys(16 + n, [codes[at + i] for i in range(n)]))
    return np.concatenate(owners), np.concatenate(keys)


@dataclass
class Model:
    """languages in order; lexicon: bins by language of common words; keys: of
    features, in order; weights: a row each; transitions and start are scores as well."""

    languages: list[str]
    lexicon: dict[str, tuple[int, ...]]
    keys: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words and keys: what they are made of, and for a word of
        the lexicon how much of its use is in each language."""
        owner, key = word_features(words)
        known = [(i, self.lexicon[w]) for i, w in enumerate(words) if w in self.lexicon]
        bins = np.array([b for _, b in known], np.int64).reshape(len(known), len(self.languages))
        return np.append(owner, np.repeat(np.array([i for i, _ in known], np.int64), bins.shape[1])), np.append(key, lexicon_keys(bins).reshape(-1))

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words and rows of ``weights``."""
        owner, key = self.features(words)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        has = np.flatnonzero(self.keys[at] == key) if len(self.keys) else np.zeros(0, np.int64)
        return owner[has], at[has]

    def scores(self, words: list[str]) -> np.ndarray:
        """Sum of weights of each word."""
        owner, row = self.rows(words)
        return np.stack([np.bincount(owner, self.weights[row, j], len(words)) for j in range(len(self.languages))], 1)


def lexicon_keys(bins: np.ndarray) -> np.ndarray:
    return (np.arange(bins.shape[1]) * 5 + bins).astype(np.uint64)


def forward_backward(scores: np.ndarray, transitions: np.ndarray, start: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (sequence, word, language), expected transitions and the sum
    of log partition functions. ``real``: words that a sequence has."""
    n, length, wide = scores.shape
    top = scores.max(2, keepdims=True)
    e, a = np.exp(scores - top), np.exp(transitions)
    alpha, scale = np.zeros_like(e), np.ones((n, length))
    for t in range(length):
        x = (np.exp(start)[None] if t == 0 else alpha[:, t - 1] @ a) * e[:, t]
        scale[:, t] = np.where(real[:, t], x.sum(1), 1.0)
        alpha[:, t] = np.where(real[:, t, None], x / scale[:, t, None], alpha[:, t - 1])
    beta, pairs = np.ones((n, wide)), np.zeros((wide, wide))
    out = np.zeros_like(e)
    for t in range(length - 1, -1, -1):
        joint = alpha[:, t] * beta
        out[:, t] = joint / joint.sum(1, keepdims=True) * real[:, t, None]
        if t:
            right = e[:, t] * beta / scale[:, t, None]
            pairs += a * ((alpha[:, t - 1] * real[:, t, None]).T @ right)
            beta = np.where(real[:, t, None], right @ a.T, beta)
    return out, pairs, float((np.log(scale) + top[:, :, 0] * real).sum())


def chain(model: Model, scores: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Marginals of all words of texts of any length. Each text is a chain; it
    is cut every ``STRIDE`` words, the pieces' matrices are made for all pieces
    at once, and what they multiply to is handed from piece to piece."""
    n, wide = scores.shape
    if not n:
        return np.zeros((0, wide))
    a, begin = np.exp(model.transitions), np.exp(model.start)
    sizes = np.diff(borders)
    pieces = -(-sizes // STRIDE)
    text = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.minimum(sizes[text] - nth * STRIDE, STRIDE)
    first, last = nth == 0, nth == pieces[text] - 1
    # pieces by length, longest first: at each step those that go on are the first ones
    order = np.argsort(-size, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    piece = np.repeat(np.arange(len(text)), size)
    step, where = np.arange(n) - np.repeat(np.cumsum(size) - size, size), place[piece]
    e = np.zeros((int(size.max()), len(text), wide))
    e[step, where] = np.exp(scores - scores.max(1, keepdims=True))
    going = [int((size > t).sum()) for t in range(len(e))]
    opens = first[order]
    left, right = np.ones((len(text), wide)), np.ones((len(text), wide))
    if (pieces > 1).any():
        p = np.where(opens[:, None, None], begin, a) * e[0][:, None]
        for t in range(1, len(e)):
            m = going[t]
            p[:m] = (p[:m].reshape(-1, wide) @ a).reshape(m, wide, wide) * e[t, :m, None]
            if t % 8 == 7:
                p[:m] /= p[:m].max((1, 2), keepdims=True)
        p /= p.max((1, 2), keepdims=True)
        for i in np.flatnonzero(~first):
            j = place[i - 1]
            v = left[j] @ p[j]
            left[place[i]] = v / v.sum()
        for i in np.flatnonzero(~last)[::-1]:
            j = place[i + 1]
            v = p[j] @ right[j]
            right[place[i]] = v / v.max()
    out = np.empty_like(e)
    x = np.where(opens[:, None], begin, left @ a) * e[0]
    out[0] = x / x.sum(1, keepdims=True)
    for t in range(1, len(e)):
        m = going[t]
        x = (out[t - 1, :m] @ a) * e[t, :m]
        out[t, :m] = x / x.sum(1, keepdims=True)
    back = a.T.copy()
    for t in range(len(e) - 1, -1, -1):
        m = going[t]
        if t + 1 < len(e) and (k := going[t + 1]):
            x = (e[t + 1, :k] * right[:k]) @ back
            right[:k] = x / x.max(1, keepdims=True)
        out[t, :m] *= right[:m]
    got = out[step, where]
    return got / got.sum(1, keepdims=True)


def training(docs: DataFrame) -> DataFrame:
    """lang, text and a hash (31 bits) of the documents to learn from."""
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id"), 33).alias("h")
    return docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text", hashed)


def lexicon(rows: DataFrame, languages: list[str], size: int) -> dict[str, tuple[int, ...]]:
    """The ``size`` commonest words of each language by counts over all
    documents to learn from, each with a bin for each language: 0 to 4 by the
    share of its use, languages taken as equally common."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("languages")
        for batch in batches:
            for part in steps(batch, "text"):
                names, codes, borders = words_of(part["text"])
                each = np.repeat(pc.index_in(part["lang"], pa.array(languages)).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(borders))
                keys, n = np.unique(each * max(1, len(names)) + codes, return_counts=True)
                yield pa.RecordBatch.from_pydict({"k": pa.array(keys // max(1, len(names)), pa.int32()), "word": pa.array(names, pa.string()).take(pa.array(keys % max(1, len(names)))), "n": pa.array(n, pa.int64())})

    counts = materialise(bounded(rows).select("lang", "text").mapInArrow(count, "k int, word string, n long").groupBy("k", "word").agg(F.sum("n").alias("n")), "word-counts")
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "word"))
    common = counts.withColumn("rank", rank).filter(F.col("rank") <= size).select("word").distinct()
    totals = np.ones(len(languages))
    for k, n in counts.groupBy("k").agg(F.sum("n")).collect():
        totals[k] = n
    uses: dict[str, np.ndarray] = {}
    for word, k, n in counts.join(F.broadcast(common), "word").select("word", "k", "n").toLocalIterator():
        uses.setdefault(word, np.zeros(len(languages)))[k] = n / totals[k]
    return {w: tuple(int(x) for x in np.searchsorted((0.001, 0.1, 0.5, 0.9), u / u.sum())) for w, u in uses.items()}


def windows(rows: DataFrame, counts: dict[str, int], most: int) -> list[tuple[str, list[str]]]:
    """Up to ``most`` windows of words in order of a hash of the document, the
    languages with equal shares: one window of a document, at a place that
    follows from its hash."""
    each = max(1, most // max(1, len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, each / n) * 2**31))])
    few = rows.filter(F.col("h") < share[F.col("lang")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("languages")
        for batch in batches:
            for part in steps(batch, "text"):
                names, codes, borders = words_of(part["text"])
                out = []
                for i, h in enumerate(part["h"].to_pylist()):
                    n = int(borders[i + 1] - borders[i])
                    at = int(borders[i]) + h % max(1, n - WINDOW + 1)
                    out.append([names[c] for c in codes[at : min(at + WINDOW, int(borders[i + 1]))]])
                yield pa.RecordBatch.from_arrays([part["lang"], part["h"], pa.array(out, pa.list_(pa.string()))], names=["lang", "h", "words"])

    got = bounded(few).mapInArrow(cut, "lang string, h long, words array<string>").filter(F.size("words") > 0)
    return [(r[0], r[2]) for r in got.orderBy("h", "lang", "words").limit(most).collect()]


def fit(docs: DataFrame, most: int = 6_000, common: int = 1_000, fewest: int = 3, ridge: float = 0.5, rounds: int = 60) -> Model:
    """A model learned from texts with a language that are not held out.

    The lexicon comes from counts over all of them. Weights, transitions and
    starts are fitted on ``most`` windows of 32 words at most (the bound of
    what comes to the driver), put one after another in order of a hash, so
    that languages change within sequences: maximum likelihood with a ridge by
    accelerated gradients, the gradient from forward-backward. Features that
    fewer than ``fewest`` distinct words have are left out.
    """
    rows = training(docs)
    counts = dict(sorted((k, n) for k, n in rows.groupBy("lang").count().collect()))
    model = Model(list(counts), {}, np.zeros(0, np.uint64), np.zeros((0, len(counts))), np.zeros((len(counts),) * 2), np.zeros(len(counts)))
    if len(counts) < 2:
        return model
    model.lexicon = lexicon(rows, model.languages, common)
    return learned(model, windows(rows, counts, most), fewest, ridge, rounds)


def learned(model: Model, sample: list[tuple[str, list[str]]], fewest: int, ridge: float, rounds: int) -> Model:
    """``model`` with features, weights, transitions and starts of a sample of windows."""
    place = {x: i for i, x in enumerate(model.languages)}
    wide = len(place)
    words = [w for _, ws in sample for w in ws]
    y = np.array([place[k] for k, ws in sample for _ in ws], np.int64)
    names = list(dict.fromkeys(words))
    number = {w: i for i, w in enumerate(names)}
    code = np.array([number[w] for w in words], np.int64)
    owner, key = model.features(names)
    pairs = np.unique(np.stack([key, owner.astype(np.uint64)]), axis=1)[0] if len(key) else key
    found, often = np.unique(pairs, return_counts=True)
    model.keys = found[(often >= fewest) | (found < 5 * wide)]
    owner, flat = model.rows(names)
    n = -(-len(words) // SEQUENCE)
    real = (np.arange(n * SEQUENCE) < len(words)).reshape(n, SEQUENCE)
    shown = np.zeros((n * SEQUENCE, wide))
    shown[np.arange(len(words)), y] = 1
    inside = np.flatnonzero(np.arange(1, len(words)) % SEQUENCE)
    seen = np.zeros((wide, wide))
    np.add.at(seen, (y[inside], y[inside + 1]), 1)
    params = [np.zeros((len(model.keys), wide)), np.zeros((wide, wide)), np.zeros(wide)]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, rounds + 1):
        w, a, b = params
        each = np.stack([np.bincount(owner, w[flat, j], len(names)) for j in range(wide)], 1)
        scores = np.zeros((n * SEQUENCE, wide))
        scores[: len(words)] = each[code]
        got, pairs, _ = forward_backward(scores.reshape(n, SEQUENCE, wide), a, b, real)
        off = got.reshape(-1, wide) - shown
        by_word = np.stack([np.bincount(code, off[: len(words), j], len(names)) for j in range(wide)], 1)
        grads = [np.stack([np.bincount(flat, by_word[owner, j], len(w)) for j in range(wide)], 1) + ridge * w, pairs - seen + ridge * a, off.reshape(n, SEQUENCE, wide)[:, 0].sum(0) + ridge * b]
        for p, g, m, v in zip(params, grads, means, squares, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model.weights, model.transitions, model.start = params
    return model


FIELDS = "lang_pred string, score double, runs array<struct<lang:string,first:long,words:long>>"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and runs of every whole text: the language with
    most expected words (ties: the first by code points), their mean marginal,
    and the runs of words that have one likeliest language (first: word number
    from 0).

    Null texts, texts without a letter, and all texts if nothing could be
    learned from are ``und``, score 0, without runs; where there is one
    language to learn, it is that with score 1. Repeated rows give equal rows,
    other columns are left out, empty tables give none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("languages")
        m = sent.value
        wide = max(1, len(m.languages))
        for batch in batches:
            for part in steps(batch, "text"):
                names, codes, borders = words_of(part["text"])
                each = m.scores(names) if m.languages else np.zeros((len(names), 1))
                odds = chain(m, each[codes], borders) if m.languages else np.zeros((len(codes), 1))
                sums = np.zeros((len(codes) + 1, wide))
                np.cumsum(odds, axis=0, out=sums[1:])
                sums = np.round(sums[borders[1:]] - sums[borders[:-1]], 9)
                best, n = sums.argmax(1), np.diff(borders)
                told = pc.and_(pc.fill_null(pc.match_substring_regex(part["text"], r"\pL"), False), bool(m.languages)).to_numpy(zero_copy_only=False)
                score = np.where(told, np.clip(sums[np.arange(len(best)), best] / np.maximum(n, 1), 0, 1), 0.0)
                top = odds.argmax(1)
                opens = np.append(True, top[1:] != top[:-1]) if len(top) else np.zeros(0, bool)
                opens[borders[:-1][n > 0]] = True
                places = np.flatnonzero(opens)
                ends = np.append(places[1:], len(top)) if len(places) else places
                cut = np.searchsorted(places, borders)
                runs = [[{"lang": m.languages[top[a]], "first": int(a - borders[i]), "words": int(b - a)} for a, b in zip(places[cut[i] : cut[i + 1]], ends[cut[i] : cut[i + 1]], strict=True)] if told[i] else [] for i in range(len(n))]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array([m.languages[b] if t else UNKNOWN for b, t in zip(best, told, strict=True)], pa.string()), pa.array(score), pa.array(runs, kind)],
                    names=["doc_id", "lang_pred", "score", "runs"],
                )
        trim()

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {FIELDS}")


def identified(docs: DataFrame, most: int = 6_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score and runs by a model of these documents."""
    found = identify(docs, fit(docs.select(F.col("doc_id").cast("long"), "text", "lang"), most))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "runs")
