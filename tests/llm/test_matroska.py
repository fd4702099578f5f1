from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from quarry.llm import matroska as m
from quarry.llm.queries import op7_matroska


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 1025, 8192, 8193, 40_000, 100_001])
def test_round_trip(n):
    payload = m.padded(random.Random(n).randbytes(n))
    data = m.mux(payload)
    media = m.parse(data)
    assert len(payload) % 64 == 0 and len(payload) > 0 and payload[:n].ljust(len(payload), b"\0") == payload
    assert m.demux(data, media) == payload
    assert [c[2] for c in media.cues] == media.clusters
    assert [p[1] for p in media.packets] == [k * 128.0 for k in range(len(media.packets))]


def test_all_lacings_are_written():
    assert {p[6] for p in m.parse(m.mux(bytes(200_000))).packets} >= {m.XIPH, m.FIXED, m.EBML_LACE}


def block(kind, frames, group=False):
    body = b"\x81\x00\x05" + bytes([0x80 | kind << 1]) + m._lace(frames, kind)
    return m._element(m.BLOCK_GROUP, m._element(m.BLOCK, body)) if group else m._element(m.SIMPLE_BLOCK, body)


@pytest.mark.parametrize("kind", [m.XIPH, m.EBML_LACE])
def test_uneven_laces_groups_and_open_sizes(kind):
    frames = [b"a" * 600, b"b" * 3, b"", b"c" * 255, b"d" * 9000]
    cluster = m._uint(m.CLUSTER_TIME, 7) + block(kind, frames) + b"\xec\x82\x00\x00" + block(m.NO_LACE, [b"xyz"], group=True)
    head = m._element(m.EBML, m._element(m.DOC_TYPE, b"matroska"))
    open_ = head + m._id(m.SEGMENT) + b"\x01" + b"\xff" * 7 + 2 * (m._id(m.CLUSTER) + b"\xff" + cluster)
    media = m.parse(open_)
    assert [open_[p[2] : p[2] + p[3]] for p in media.packets] == 2 * [*frames, b"xyz"]
    assert {p[1] for p in media.packets} == {12.0} and [p[4] for p in media.packets] == [0] * 6 + [1] * 6


@pytest.mark.parametrize("data", [b"", b"\x00" * 9, b"RIFF....", m.mux(bytes(64))[:100], m._element(m.SEGMENT)])
def test_malformed(data):
    with pytest.raises((m.MediaError, IndexError)):
        m.parse(data)


def test_query(spark, data):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = op7_matroska(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]]
        whole = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))


def test_odd_rows_and_packets(spark, odd, none):
    stored = m.store(odd)
    rows = m.digests(stored).collect()
    assert len(rows) == odd.count() and {r["payload_bytes"] for r in rows if not r["n_bytes"]} == {64}
    same = {(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (1, 5)}
    assert len(same) == 1
    packets = m.packet_table(stored)
    assert packets.where("error is not null").count() == 0 and packets.where("cued").count() == packets.count()
    broken = spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")
    assert [r["error"] is not None for r in m.packet_table(broken).collect()] == [True, True]
    assert m.digests(m.store(none)).count() == 0


def test_digests_of_null_and_malformed_media(spark):
    good = bytes(m.mux(m.padded(b"abc")))
    media = spark.createDataFrame([(1, 3, bytearray(good)), (2, 3, None), (3, 3, bytearray(b"")), (4, 3, bytearray(b"no media at all")), (5, 3, bytearray(good[: len(good) // 2])), (None, 3, bytearray(good))], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in m.digests(media).collect()}
    assert len(got) == 6 and got[1]["payload_bytes"] == got[None]["payload_bytes"] == 64
    assert got[2]["media_bytes"] is None and got[2]["feature"] is None and got[4]["media_bytes"] == 15
