"""Fill-in-the-middle transformation by bit-parallel work on big integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finweave.llm.shared import bounded, working
from finweave.llm.tokens import steps

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
#: Class masks, one sign a byte: line ends, and bytes that begin a code point.
_NEWLINE = bytes(49 if b == 10 else 48 for b in range(256))
_POINT = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))


def mask(raw: bytes, signs: bytes) -> int:
    """An integer whose bit i tells the class of byte i."""
    return int(raw[::-1].translate(signs), 2) if raw else 0


def line_starts(raw: bytes) -> int:
    """Bits at the bytes where a line begins: the first one, and those after a
    line end; what a final line end would begin is cut off."""
    return ((mask(raw, _NEWLINE) << 1) | 1) & ((1 << len(raw)) - 1)


def select(bits: int, rank: int, width: int) -> int:
    """Place of the set bit of a rank (from 0): halves are counted, and the
    search goes on in one of them. The work is that of two passes."""
    at = 0
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - n, at + half, width - half
    return at


def cuts(raw: bytes, h1: int, h2: int) -> tuple[int, int, int]:
    """Lines of a text, and the bytes where its middle and suffix begin."""
    starts = line_starts(raw)
    n = starts.bit_count()
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, *(select(starts, k, len(raw)) if k < n else len(raw) for k in (a, b))


def form_of(raw: bytes, h3: int, h4: int, rate: int, spm: int) -> str:
    if not raw or any(m in raw for m in _MARKS) or h3 % 100 >= rate:
        return "plain"
    return "spm" if h4 % 100 < spm else "psm"


def joined(raw: bytes, form: str, a: int, b: int) -> bytes:
    p, s, m = _MARKS
    if form == "psm":
        return b"".join((p, raw[:a], s, raw[b:], m, raw[a:b]))
    return b"".join((s, raw[b:], p, raw[:a], m, raw[a:b])) if form == "spm" else raw


def restored(out: bytes, form: str) -> bytes:
    """The text behind an output. Neither the text holds a marker nor can one
    arise where a part meets a marker, so the first of each kind is the cut."""
    if form == "plain":
        return out
    first, second = (_MARKS[1], _MARKS[0]) if form == "spm" else (_MARKS[0], _MARKS[1])
    head, _, rest = out[len(first) :].partition(second)
    other, _, middle = rest.partition(_MARKS[2])
    return other + middle + head if form == "spm" else head + middle + other


def code_points(raw: bytes, a: int, b: int) -> int:
    return mask(raw[a:b], _POINT).bit_count()


FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, restored string"


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars and
    middle_chars (code points; null if plain), output, and the text restored
    from output and form, of every whole text.

    The cuts come from the first four groups of eight digits of the hex sha256
    of ``seed:doc_id``: below the lesser of two of them, by lines, is the
    prefix, below the greater the middle. ``rate`` percent of the texts are
    transformed, ``spm`` percent of these have the suffix first. Lines are
    bits of an integer: translated bytes are read as its digits, a shift marks
    where lines begin, counts of bits give lines and code points, and halves
    are counted to find the line of a rank.

    Null texts are empty; empty texts and those with a marker are plain. A null
    doc_id counts as the empty string in the hash. Repeated rows give equal
    rows, empty tables none; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("middle")
        for batch in batches:
            for part in steps(batch, "text"):
                cols: dict[str, list] = {x: [] for x in ("n", "form", "prefix_chars", "middle_chars", "output", "restored")}
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist(), strict=True):
                    raw = text or b""
                    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
                    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in range(0, 32, 8))
                    n, a, b = cuts(raw, h1, h2)
                    form = form_of(raw, h3, h4, rate, spm)
                    out = joined(raw, form, a, b)
                    plain = form == "plain"
                    row = (n, form, None if plain else code_points(raw, 0, a), None if plain else code_points(raw, a, b), out, restored(out, form))
                    for name, value in zip(cols, row, strict=True):
                        cols[name].append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                made = [pa.array(v, k) for v, k in zip(cols.values(), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *made[:4], *(x.cast(pa.string()) for x in made[4:])], names=["doc_id", *cols])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {FIELDS}")


def digest(made: DataFrame) -> DataFrame:
    """Hashes in place of the output and the restored text."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""
WITH docs AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), cut AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS d FROM docs
), bounds AS (
  SELECT *, CAST(len(lines) AS BIGINT) AS n,
         least(d[1] % (len(lines) + 1), d[2] % (len(lines) + 1)) AS a, greatest(d[1] % (len(lines) + 1), d[2] % (len(lines) + 1)) AS b
  FROM cut
), parts AS (
  SELECT doc_id, text, n, array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m, array_to_string(lines[b + 1:], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain'
              WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM bounds
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
