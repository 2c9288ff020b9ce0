"""The demultiplexer over damaged streams: counts, never an exception."""

from __future__ import annotations

import random
import struct

import pytest

from finweave.llm import media


def section(table_id, body):
    head = bytes([table_id]) + struct.pack(">H", 0xB000 | (len(body) + 9)) + b"\0\1\xc1\0\0" + body
    return head + struct.pack(">I", media.crc32_mpeg(head))


def packet(pid, counter, data, start=True, access=False):
    adapt = b"\x01\x40" if access else b""
    return (bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x30 if access else 0x10) | counter]) + adapt + data).ljust(188, b"\xff")[:188]


def tables(pmt_body):
    pat = packet(0, 0, b"\0" + section(0, struct.pack(">HH", 1, 0xE000 | 256)))
    return pat + packet(256, 0, b"\0" + section(2, pmt_body))


STREAM = struct.pack(">HH", 0xE101, 0xF000) + b"\x1b" + struct.pack(">HH", 0xE000 | 257, 0xF000)


@pytest.mark.parametrize("pmt", [b"", b"\xe1", struct.pack(">HH", 0xE101, 0xF000), struct.pack(">HH", 0xE101, 0xFFFF), struct.pack(">HH", 0xE101, 0xF004) + b"\x1b", STREAM])
def test_program_tables(pmt):
    found = media.demux(tables(pmt))
    assert found["pmt_pid"] == 256 and found["es_pid"] == (257 if pmt == STREAM else -1) and found["payload"] == b""


@pytest.mark.parametrize("pes", [b"\0\0\1\xe0\0\0\x80\x80\0", b"\0\0\1\xe0\0\x05\x80\x80\x05ab", b"\0\0\1", b"\0\0\1\xe0\xff\xff\x80\x80\xff"])
def test_short_elementary_packets(pes):
    short = b"\x47\x41\x01" + bytes([0x30, 183 - len(pes), 0x40]).ljust(185 - len(pes), b"\xff") + pes
    found = media.demux(tables(STREAM) + short)
    assert len(short) == 188 and found["elementary"] + found["broken"] == 1


def test_no_packet_with_a_unit_start():
    assert media.demux(tables(STREAM) + packet(257, 0, b"abc", start=False))["elementary"] == 0


def test_fuzzed_streams():
    g = random.Random(7)
    whole = [media.mux(bytes(g.randrange(256) for _ in range(n))) for n in (0, 576, 1152)] + [tables(STREAM) + packet(257, 0, b"\0\0\1\xe0\0\0\x80\x80\x05" + bytes(30), access=True)]
    for _ in range(20_000):
        x = bytearray(g.choice(whole))
        kind = g.randrange(4)
        for _ in range(g.choice((1, 2, 5, 40))):
            x[g.randrange(len(x))] = g.randrange(256)
        if kind == 1:
            x = x[g.randrange(len(x)) :]
        elif kind == 2:
            k = g.randrange(len(x) // 188) * 188
            del x[k : k + 188]
        elif kind == 3:
            x += bytes(g.randrange(256) for _ in range(g.randrange(400)))
        found = media.demux(bytes(x))
        assert found["packets"] == len(x) // 188 and all(0 <= b <= len(found["payload"]) for _, b, _ in found["access"])
