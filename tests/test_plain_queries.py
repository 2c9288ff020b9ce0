"""Whole results of queries without SQL against plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import regex

from finweave import plans
from finweave.plans import texts as plan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["document_id"]: r["text"] or "" for r in plan.documents(spark, SF).collect()}


def sentences_of(text):
    return [s for s in (p.strip() for p in regex.split(r"(?<=[.!?])\s+", text)) if s]


def packed(parts, size=1000, overlap=200):
    """Chunks by explicit bookkeeping of first and last sentence."""
    out, first = [], 0
    for i, s in enumerate(parts):
        if i > first and len(" ".join(parts[first:i])) + 1 + len(s) > size:
            out.append(parts[first:i])
            start = i
            while start > first and len("".join(parts[start - 1 : i])) <= overlap:
                start -= 1
            first = start if len("".join(parts[start:i])) + len(s) <= size else i
    return [" ".join(c) for c in out] + ([" ".join(parts[first:])] if first < len(parts) else [])


def by_paragraph(text, size=1000, overlap=200):
    out, group = [], []
    for part in [p.strip() for p in text.split("\n\n") if p.strip()]:
        if group and sum(map(len, group)) + len(part) > size:
            out.append("\n\n".join(group))
            group = []
        if len(part) > size:
            out += packed(sentences_of(part), size, overlap)
        else:
            group.append(part)
    return out + (["\n\n".join(group)] if group else [])


def expected(docs, cut):
    out = set()
    for d, t in docs.items():
        for i, c in enumerate(cut(t)):
            out.add((d, i, "chunk_" + hashlib.md5(f"{d}_{i}_{c[:100]}".encode()).hexdigest()[:12], len(c)))
    return out


def told(spark, name):
    return {tuple(r) for r in plans.queries()[name](spark, SF).select("document_id", "chunk_index", "chunk_id", "char_count").collect()}


def test_sentence_chunks(spark, docs):
    clean = lambda t: regex.sub(r"Page [0-9]+ of [0-9]+", "", regex.sub(r"\s+", " ", t)).strip(" ")
    assert told(spark, "sentence_chunks") == expected(docs, lambda t: packed(sentences_of(clean(t))))


def test_paragraph_chunks(spark, docs):
    assert told(spark, "paragraph_chunks") == expected(docs, by_paragraph)


def test_key_entities(spark, docs):
    names = Counter(m for t in docs.values() for m in regex.findall(r"\b\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+", t))
    top = sorted(names.items(), key=lambda x: (-x[1], x[0].encode()))[:10]
    got = sorted((tuple(r) for r in plans.queries()["key_entities"](spark, SF).collect()), key=lambda r: (-r[1], r[0].encode()))
    assert [r[:2] for r in got] == top and all(abs(r[2] - r[1] / sum(names.values())) < 1e-12 for r in got)
