"""Chunks cut by tokens of a tokenizer file and shown as text."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from finweave.operators.batches import bounded, slices

#: Characters that are encoded at once; longer texts are cut before a blank that stands alone.
PART = 500_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """One tokenizer a Python worker and file."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def parts(text: str, most: int = PART) -> Iterator[tuple[int, str]]:
    """(start, text) of parts of a text. Tokens begin with a blank or leave it
    out, so none goes over a blank that stands alone; text without any is one part."""
    at = 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if cut is None:
            break
        yield at, text[at : cut.start()]
        at = cut.start()
    yield at, text[at:]


def offsets(text: str, path: str, most: int = PART) -> np.ndarray:
    """Where each token of a text begins, in code points of the text."""
    out = [np.zeros(0, np.int64)]
    for at, part in parts(text, most):
        out.append(np.fromiter((a for a, _ in tokenizer(path).encode(part, add_special_tokens=False).offsets), np.int64) + at)
    return np.concatenate(out)


#: Distinct words that a worker keeps the tokens of; beyond them it starts anew.
WORDS = 400_000
_kept: dict[str, dict[str, bytes]] = {}
_by_word: dict[str, bool] = {}


def by_word(path: str) -> bool:
    """Whether no token of a file goes over white space, and each begins in
    its word, so that a text's tokens are those of its words in a row."""
    if path not in _by_word:
        spec = json.loads(tokenizer(path).to_str())
        steps = (spec.get("normalizer") or {}).get("normalizers") or [{}]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = [p.get("type") for p in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("pattern") == {"Regex": r"\s+"} and steps[1].get("content") == " "
        split = [p.get("type") for p in pre] == ["Split", "ByteLevel"] and pre[0].get("invert") and pre[0].get("behavior") == "Removed" and pre[0].get("pattern") == {"Regex": _CLIP} and pre[1].get("add_prefix_space") is False and pre[1].get("use_regex") is False
        added = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens") or [])
        _by_word[path] = bool(known and split and added and not spec.get("truncation") and not spec["model"].get("dropout"))
    return _by_word[path]


_CLIP = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def pieces(text: str) -> tuple[np.ndarray, list[str]]:
    """Where words begin, in code points, and the words. A word also ends where
    an ASCII letter is before another ASCII character: so does a token."""
    code = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = (code != 32) & ((code < 9) | (code > 13))
    letter = ((code | 32) >= 97) & ((code | 32) <= 122)
    before = np.append(False, inside[:-1])
    cut = np.append(False, letter[:-1]) & ~letter & (code < 128) & inside
    starts = np.flatnonzero(inside & ~before | cut)
    stops = np.flatnonzero(np.append(before & ~inside | cut, len(code) > 0 and inside[-1]))
    return starts, [text[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def _learn(path: str, words: list[str], kept: dict[str, bytes]) -> None:
    """Keeps where the tokens of each word begin: many words are encoded in one string and parted where words begin."""
    for i in range(0, len(words), 1000):
        some = words[i : i + 1000]
        joined = " ".join(some)
        begins = np.fromiter((a for a, _ in tokenizer(path).encode(joined, add_special_tokens=False).offsets), np.int32)
        starts = np.cumsum([0, *(len(w) + 1 for w in some)])
        if np.any(np.diff(begins) < 0):  # marks out of order
            kept.update((w, offsets(w, path).astype(np.int32).tobytes()) for w in some)
            continue
        cuts = np.searchsorted(begins, starts)
        raw = (begins - np.repeat(starts[:-1], np.diff(cuts))).astype(np.int32).tobytes()
        kept.update((w, raw[4 * a : 4 * b]) for w, (a, b) in zip(some, pairwise(cuts.tolist()), strict=True))


def word_offsets(text: str, path: str) -> np.ndarray:
    """What ``offsets`` gives, from the tokens of words, of which each distinct one is encoded once."""
    kept = _kept.setdefault(path, {})
    if len(kept) > WORDS:
        kept.clear()
    starts, words = pieces(text.lower() if text.isascii() else text)
    if new := [w for w in dict.fromkeys(words) if w not in kept]:
        _learn(path, new, kept)
    got = [kept[w] for w in words]
    n = np.fromiter(map(len, got), np.int64, len(got)) // 4
    return np.repeat(starts, n) + np.frombuffer(b"".join(got), np.int32)


def begins_of(text: str, path: str) -> np.ndarray:
    """Where each token of a text begins."""
    return word_offsets(text, path) if by_word(path) and "<|" not in text else offsets(text, path)


def windows(docs: DataFrame, path: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """document_id, chunk_index, tokens, prev_overlap and next_overlap (tokens
    shared with neighbours), start, stop (code points) and text of windows of
    ``size`` tokens, each ``size - overlap`` after the last.

    A window's text goes from where its first token begins to where the token
    after it begins (the first from 0, the last to the end), so what windows
    add to each other is the whole text. The last window is the first that
    reaches the end. Null and empty texts, and texts without tokens, have none.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    kind = docs.select("document_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[list] = []
            for i, text in enumerate(batch["text"].to_pylist()):
                begins = begins_of(text, path) if text else np.zeros(0, np.int64)
                n = len(begins)
                if not n:
                    continue
                first = np.arange(0, max(1, n - overlap), size - overlap)
                last = np.minimum(first + size, n)
                a, b = begins[first], np.append(begins, len(text))[last]
                a[0] = 0
                shared = np.append(0, last[:-1] - first[1:])
                rows.append([np.full(len(first), i), np.arange(len(first)), last - first, shared, np.append(shared[1:], 0), a, b, [text[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]])
            if rows:
                *numbers, texts = zip(*rows, strict=True)
                at, index, tokens, before, after, start, stop = map(np.concatenate, numbers)
                yield pa.RecordBatch.from_arrays(
                    [batch["document_id"].take(pa.array(at)), *(pa.array(x, pa.int32()) for x in (index, tokens, before, after)), pa.array(start), pa.array(stop), pa.array([t for x in texts for t in x], pa.string())],
                    names=["document_id", "chunk_index", "tokens", "prev_overlap", "next_overlap", "start", "stop", "text"],
                )

    return bounded(docs).select("document_id", "text").mapInArrow(run, f"document_id {kind}, chunk_index int, tokens int, prev_overlap int, next_overlap int, start long, stop long, text string")


def sizes(docs: DataFrame, path: str) -> DataFrame:
    """document_id, characters and tokens of each text; null texts have none."""
    kind = docs.select("document_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["document_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([len(begins_of(t, path)) for t in texts], pa.int64())], names=["document_id", "characters", "tokens"])

    return bounded(docs).select("document_id", "text").mapInArrow(run, f"document_id {kind}, characters long, tokens long")
