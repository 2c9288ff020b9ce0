"""Media columns: MPEG transport streams that carry one private data stream."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from finweave.llm.shared import bounded, working
from finweave.llm.tokens import steps

# Fixed values of the format (ISO/IEC 13818-1).
PACKET, SYNC, PAT_PID = 188, 0x47, 0
PMT_PID, ES_PID, PROGRAM, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 1, 0x06, 0xBD
CLOCK = 90_000
#: Payload bytes of one elementary packet, and samples a second for its timestamp.
UNIT, RATE = 9_216, 8_000


@lru_cache(maxsize=4096)
def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
            crc &= 0xFFFFFFFF
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8)


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    pat = _section(0, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(2, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000))
    return np.stack([_table_packet(PAT_PID, pat), _table_packet(PMT_PID, pmt)])


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, 0x01 | (pts >> 14 & 0xFE), pts >> 7 & 0xFF, 0x01 | (pts << 1 & 0xFE)])


def mux(payload: bytes) -> bytes:
    """A stream with program tables, then elementary packets of UNIT payload
    bytes, each opened by a random-access point with clock reference and
    timestamp. Deterministic; an empty payload gives the tables alone."""
    parts, counter = [_tables()], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        pts = (at * CLOCK // RATE) & 0x1FFFFFFFF
        pes = np.frombuffer(struct.pack(">IHBBB", 0x100 | STREAM_ID, len(data) + 8, 0x84, 0x80, 5) + _stamp(pts) + data, np.uint8)
        n = 1 + -(-max(0, len(pes) - 176) // 184)
        out = np.full((n, PACKET), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        out[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
        counter += n
        out[0, 1] |= 0x40
        out[0, 3] |= 0x20
        room = 176 if n > 1 else len(pes)
        out[0, 4] = 183 - room
        out[0, 5] = 0x50
        out[0, 6:12] = np.frombuffer(struct.pack(">Q", (pts << 15) | 0x7E00)[2:], np.uint8)
        out[0, PACKET - room :] = pes[:room]
        rest = pes[room:]
        whole = len(rest) // 184
        out[1 : 1 + whole, 4:] = rest[: whole * 184].reshape(whole, 184)
        if tail := len(rest) - whole * 184:
            out[-1, 3] |= 0x20
            out[-1, 4] = 183 - tail
            if tail < 183:
                out[-1, 5] = 0
            out[-1, PACKET - tail :] = rest[whole * 184 :]
        parts.append(out)
    return np.concatenate(parts).tobytes()


def _start(packets: np.ndarray) -> np.ndarray:
    """Where the payload of each packet starts; past its end if it has none."""
    control = packets[:, 3] >> 4 & 3
    after = np.where(control & 2 > 0, 5 + packets[:, 4].astype(np.int32), 4)
    return np.where(control & 1 > 0, np.minimum(after, PACKET), PACKET)


def _pids(packets: np.ndarray) -> np.ndarray:
    return (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]


def _read_section(packets: np.ndarray, pid: int, table_id: int) -> bytes | None:
    """The first whole section of a table with a right checksum. A section may
    go on over packets; a packet may end one and start others."""
    mine = packets[_pids(packets) == pid]
    waiting: bytes | None = None
    last = -1
    for row, start in zip(mine, _start(mine), strict=True):
        if start >= PACKET:
            continue
        counter = int(row[3]) & 15
        if counter == last:  # a packet sent twice
            continue
        if last >= 0 and counter != (last + 1) % 16:
            waiting = None
        last = counter
        raw = row[start:].tobytes()
        if row[1] & 0x40:
            parts = [(waiting + raw[1 : 1 + raw[0]]) if waiting is not None else b"", raw[1 + raw[0] :]]
        else:
            parts = [waiting + raw] if waiting is not None else []
        for k, part in enumerate(parts):
            while len(part) >= 3 and part[0] != 0xFF:
                length = 3 + (struct.unpack(">H", part[1:3])[0] & 0xFFF)
                if len(part) < length:
                    break
                section, part = part[:length], part[length:]
                if section[0] == table_id and length >= 12 and crc32_mpeg(section[:-4]) == struct.unpack(">I", section[-4:])[0]:
                    return section
            if k == len(parts) - 1:
                waiting = part if part and part[0] != 0xFF else None
    return None


def demux(stream: bytes | None) -> dict | None:
    """What a stream holds: the payload put together again, its PIDs and type,
    counted packets, continuity errors, and (packet, byte, pts) of every
    random-access point. Null is null; damaged parts are counted, not fatal:
    packets without sync byte or with the mark of a transport error and
    elementary packets cut short or without a start code are left out. Program
    tables may go on over packets; packets sent twice count once; those without
    payload and announced jumps are no continuity errors. Of several programs
    or elementary streams the first is read."""
    if stream is None:
        return None
    found = {"payload": b"", "pmt_pid": -1, "es_pid": -1, "stream_type": -1, "packets": len(stream) // PACKET, "elementary": 0, "continuity_errors": 0, "broken": 0, "access": []}
    packets = np.frombuffer(stream, np.uint8, found["packets"] * PACKET).reshape(-1, PACKET)
    fine = (packets[:, 0] == SYNC) & (packets[:, 1] & 0x80 == 0)
    found["broken"] = int((~fine).sum())
    where = np.flatnonzero(fine)
    packets = packets[fine]
    pat = _read_section(packets, PAT_PID, 0)
    if pat is None:
        return found
    found["pmt_pid"] = next((pid & 0x1FFF for n, pid in struct.iter_unpack(">HH", pat[8 : 8 + (len(pat) - 12) // 4 * 4]) if n), -1)
    pmt = _read_section(packets, found["pmt_pid"], 2)
    if pmt is None:
        return found
    at = 12 + (struct.unpack(">H", pmt[10:12])[0] & 0xFFF) if len(pmt) >= 16 else len(pmt)
    if at + 5 > len(pmt) - 4:  # no stream, or lengths beyond the section
        return found
    found["stream_type"], pid = struct.unpack(">BH", pmt[at : at + 3])
    found["es_pid"] = pid & 0x1FFF
    mine = _pids(packets) == found["es_pid"]
    rows, where = packets[mine], where[mine]
    if not len(rows):
        return found
    # the counter counts packets with payload; one of them may be sent twice, and a mark may announce a jump
    counter = (rows[:, 3] & 15).astype(np.int16)
    carries = rows[:, 3] & 0x10 > 0
    adapted = (rows[:, 3] & 0x20 > 0) & (rows[:, 4] > 0)
    step = np.append(0, (counter[1:] - counter[:-1]) % 16)
    twice = np.append(False, (step[1:] == 0) & carries[1:] & (rows[1:, 6:] == rows[:-1, 6:]).all(1))
    wrong = (step != carries) & ~twice & ~(adapted & (rows[:, 5] & 0x80 > 0))
    found["continuity_errors"] = int(wrong[1:].sum())
    rows, where, adapted = rows[~twice], where[~twice], adapted[~twice]
    start = _start(rows)
    data = rows[np.arange(PACKET) >= start[:, None]]
    ends = np.cumsum(PACKET - start)
    opens = np.flatnonzero(rows[:, 1] & 0x40 > 0)
    if not len(opens):
        return found
    access = adapted & (rows[:, 5] & 0x40 > 0)
    out, size = [], 0
    for a, b in zip(opens, [*opens[1:], len(rows)], strict=True):
        pes = data[(ends[a] - (PACKET - start[a])) : ends[b - 1]].tobytes()
        if len(pes) < 9 or pes[:3] != b"\0\0\1":
            found["broken"] += 1
            continue
        length, head = struct.unpack(">H", pes[4:6])[0], pes[8]
        body = pes[9 + head : 6 + length] if length else pes[9 + head :]
        if length and len(pes) < 6 + length:
            found["broken"] += 1
            continue
        if access[a]:
            p = pes[9:14]
            pts = (p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1 if pes[7] & 0x80 and len(p) == 5 else -1
            found["access"].append((int(where[a]), size, int(pts)))
        found["elementary"] += 1
        out.append(body)
        size += len(body)
    found["payload"] = b"".join(out)
    return found


STREAM = "struct<payload:binary,pmt_pid:int,es_pid:int,stream_type:int,packets:long,elementary:long,continuity_errors:long,broken:long,access:array<struct<packet:long,byte:long,pts:long>>>"


def _added(df: DataFrame, source: str, name: str, kind: str, of) -> DataFrame:
    """``df`` with a column made from a binary one, value by value, in steps of
    bounded size; all other columns pass through."""
    field = T.StructField(name, T._parse_datatype_string(kind))
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [field])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(field.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("media")
        for batch in batches:
            for part in steps(batch, source):
                cols = {n: c for n, c in zip(part.schema.names, part.columns, strict=True) if n != name}
                yield pa.RecordBatch.from_arrays([*cols.values(), pa.array([of(x) for x in part[source].to_pylist()], arrow)], names=[*cols, name])

    return bounded(df).mapInArrow(run, schema)


def encode(df: DataFrame, source: str = "payload", name: str = "media") -> DataFrame:
    """Adds the transport stream of a binary column; null stays null."""
    return _added(df, source, name, "binary", lambda x: None if x is None else mux(x))


def decode(df: DataFrame, source: str = "media", name: str = "stream") -> DataFrame:
    """Adds what ``demux`` finds as a struct column."""
    return _added(df, source, name, STREAM, demux)


def padded(text: Column, unit: int = 576) -> Column:
    """UTF-8 bytes of a text (null: empty), bytes 255 appended up to a positive
    multiple of ``unit``."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / F.lit(unit))) * unit
    return F.rpad(raw, n.cast("int"), F.unhex(F.lit("FF")))


def digest(df: DataFrame) -> DataFrame:
    """Features of decoded rows with doc_id, n_bytes, media and stream."""
    s = F.col("stream")
    points = F.transform(s["access"], lambda p: F.concat_ws("/", p["packet"], p["byte"], p["pts"]))
    feature = F.concat_ws(";", F.concat(F.lit("pmt="), s["pmt_pid"]), F.concat(F.lit("pid="), s["es_pid"]), F.concat(F.lit("type="), s["stream_type"]), F.concat(F.lit("packets="), s["packets"]), F.concat(F.lit("pes="), s["elementary"]), F.concat(F.lit("cc_errors="), s["continuity_errors"]), F.concat(F.lit("rap="), F.array_join(points, ",")))
    size = F.octet_length(s["payload"])
    return df.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2(s["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(s["payload"], -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
