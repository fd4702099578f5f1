"""Media columns in Matroska: texts stored as 8-bit mono samples, and containers parsed into packet tables.

The parser reads variable-length EBML elements (unknown sizes included), clusters, simple blocks and block groups,
all four kinds of lacing, and cues. What it returns are byte ranges into the container, so payloads are cut from the
stored bytes and never kept twice.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska specification (fixed values).
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING, CODEC, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_MASTERS = {SEGMENT, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS, INFO, EBML}
#: What ends a cluster of unknown size: elements that only a segment holds.
_TOP = {CLUSTER, CUES, TRACKS, INFO, SEGMENT, EBML, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}

NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3
RATE, FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER, PAD = 8000, 1024, 8, 4, 64


class MediaError(ValueError):
    """The bytes are no Matroska file that this parser can read."""


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    width = next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(n: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return _id(n) + _size(len(body)) + body


def _uint(n: int, value: int) -> bytes:
    return _element(n, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], kind: int) -> bytes:
    if kind == NO_LACE:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    elif kind == EBML_LACE:
        head += b"".join([_size(sizes[0])] + [_signed(b - a) for a, b in zip(sizes, sizes[1:], strict=False)]) if sizes else b""
    return head + b"".join(frames)


def _signed(n: int) -> bytes:
    width = next(k for k in range(1, 9) if abs(n) < 1 << 7 * k - 1)
    return ((n + (1 << 7 * width - 1) - 1) | 1 << 7 * width).to_bytes(width, "big")


def padded(raw: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % PAD or (0 if raw else PAD))


def mux(payload: bytes) -> bytes:
    """A Matroska file whose only track has ``payload`` as 8-bit samples.

    Blocks take turns in their lacing; a block of frames of unequal sizes never has fixed lacing.
    """
    track = _element(
        TRACK, _uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _uint(LACING, 1), _element(CODEC, b"A_PCM/INT/LIT"),
        _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE),
        _element(AUDIO, _element(FREQUENCY, struct.pack(">d", RATE)), _uint(CHANNELS, 1), _uint(BIT_DEPTH, 8)),
    )
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000), _element(MUXER, b"quarry"), _element(WRITER, b"quarry"))
    parts, at, cues, block = [info, _element(TRACKS, track)], 0, [], 0
    offset = sum(map(len, parts))
    step = FRAME * FRAMES_A_BLOCK
    for start in range(0, len(payload), step * BLOCKS_A_CLUSTER):
        begin = start * 1000 // RATE
        blocks = [_uint(CLUSTER_TIME, begin)]
        for at in range(start, min(start + step * BLOCKS_A_CLUSTER, len(payload)), step):
            frames = [payload[k : k + FRAME] for k in range(at, min(at + step, len(payload)), FRAME)]
            kind = block % 4
            if len(frames) == 1:
                kind = NO_LACE
            elif kind == NO_LACE or kind == FIXED and len(frames[-1]) != FRAME:
                kind = EBML_LACE
            head = b"\x81" + struct.pack(">hB", at * 1000 // RATE - begin, 0x80 | kind << 1)
            blocks.append(_element(SIMPLE_BLOCK, head, _lace(frames, kind)))
            block += 1
        cluster = _element(CLUSTER, *blocks)
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, begin), _element(CUE_POSITIONS, _uint(CUE_TRACK, 1), _uint(CUE_CLUSTER, offset))))
        parts.append(cluster)
        offset += len(cluster)
    parts.append(_element(CUES, *cues))
    head = _element(
        EBML, _uint(EBML_VERSION, 1), _uint(EBML_READ_VERSION, 1), _uint(EBML_MAX_ID, 4), _uint(EBML_MAX_SIZE, 8), _element(DOC_TYPE, b"matroska"),
        _uint(DOC_VERSION, 4), _uint(DOC_READ_VERSION, 2),
    )
    return head + _element(SEGMENT, *parts)


@dataclass
class Media:
    """Packets: (track, timestamp in ms, first byte, length, cluster, keyframe, lacing). Cues: (ms, track, cluster's first byte)."""

    packets: list[tuple[int, float, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[float, int, int]] = field(default_factory=list)
    tracks: dict[int, dict[int, bytes]] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """Value, width and next place of the variable-length integer at ``at``; with ``keep`` its marker stays, as in ids."""
    if at >= len(data) or not data[at]:
        raise MediaError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise MediaError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    return value if keep else value & (1 << 7 * width) - 1, width, at + width


def _elements(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """Id, its first byte, the body's first byte and its end."""
    while at < end:
        n, _, body = _vint(data, at, keep=True)
        if inside == CLUSTER and n in _TOP:
            return
        size, width, body = _vint(data, body)
        stop = body + size
        if size == (1 << 7 * width) - 1:
            stop = end if n == SEGMENT else _open_end(data, body, end, n)
        elif stop > end:
            raise MediaError(f"element {n:#x} at {at} ends beyond its parent")
        yield n, at, body, stop
        at = stop


def _open_end(data: bytes, body: int, end: int, inside: int) -> int:
    if inside != CLUSTER:
        raise MediaError(f"unknown size of element {inside:#x}")
    stop = body
    for _, _, _, stop in _elements(data, body, end, CLUSTER):
        pass
    return stop


def parse(data: bytes) -> Media:
    """The packet table of a Matroska file; raises MediaError on bytes that are none."""
    media = Media()
    first = next(_elements(data, 0, len(data)), None)
    if first is None or first[0] != EBML:
        raise MediaError("no EBML header")
    for n, _, body, end in _elements(data, 0, len(data)):
        if n == SEGMENT:
            _segment(data, body, end, media)
    return media


def _segment(data: bytes, begin: int, end: int, media: Media) -> None:
    for n, at, body, stop in _elements(data, begin, end):
        if n == INFO:
            media.scale = next((int.from_bytes(data[b:e], "big") for k, _, b, e in _elements(data, body, stop) if k == TIMESTAMP_SCALE), media.scale)
        elif n == TRACKS:
            for k, _, b, e in _elements(data, body, stop):
                if k == TRACK:
                    fields = {x: data[y:z] for x, _, y, z in _elements(data, b, e)}
                    media.tracks[int.from_bytes(fields.get(TRACK_NUMBER, b""), "big")] = fields
        elif n == CLUSTER:
            media.clusters.append(at)
            _cluster(data, body, stop, media)
        elif n == CUES:
            for k, _, b, e in _elements(data, body, stop):
                if k == CUE_POINT:
                    _cue(data, b, e, begin, media)


def _cue(data: bytes, begin: int, end: int, segment: int, media: Media) -> None:
    time, places = 0, []
    for n, _, body, stop in _elements(data, begin, end):
        if n == CUE_TIME:
            time = int.from_bytes(data[body:stop], "big")
        elif n == CUE_POSITIONS:
            fields = {x: int.from_bytes(data[y:z], "big") for x, _, y, z in _elements(data, body, stop)}
            places.append((fields.get(CUE_TRACK, 0), segment + fields.get(CUE_CLUSTER, 0)))
    media.cues += [(time * media.scale / 1e6, track, place) for track, place in places]


def _cluster(data: bytes, begin: int, end: int, media: Media) -> None:
    base = 0
    for n, _, body, stop in _elements(data, begin, end):
        if n == CLUSTER_TIME:
            base = int.from_bytes(data[body:stop], "big")
        elif n == SIMPLE_BLOCK:
            _block(data, body, stop, base, media, None)
        elif n == BLOCK_GROUP:
            inner = list(_elements(data, body, stop))
            for k, _, b, e in inner:
                if k == BLOCK:
                    _block(data, b, e, base, media, all(x[0] != 0xFB for x in inner))


def _block(data: bytes, at: int, end: int, base: int, media: Media, key: bool | None) -> None:
    track, _, at = _vint(data, at)
    if at + 3 > end:
        raise MediaError(f"block cut off at {at}")
    shift, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    key = bool(flags & 0x80) if key is None else key
    sizes: list[int] = []
    if kind != NO_LACE:
        count = data[at] + 1
        at += 1
        if kind == XIPH:
            for _ in range(count - 1):
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                sizes.append(n + data[at])
                at += 1
        elif kind == EBML_LACE:
            for k in range(count - 1):
                n, width, at = _vint(data, at)
                sizes.append(n if k == 0 else sizes[-1] + n - ((1 << 7 * width - 1) - 1))
        else:
            if (end - at) % count:
                raise MediaError(f"fixed lacing doesn't divide the block at {at}")
            sizes = [(end - at) // count] * (count - 1)
    last = end - at - sum(sizes)
    if last < 0 or any(n < 0 for n in sizes):
        raise MediaError(f"lacing exceeds the block at {at}")
    duration = int.from_bytes(media.tracks.get(track, {}).get(DEFAULT_DURATION, b""), "big") / 1e6
    start = (base + shift) * media.scale / 1e6
    for k, n in enumerate([*sizes, last]):
        media.packets.append((track, start + k * duration, at, n, len(media.clusters) - 1, key, kind))
        at += n


def demux(data: bytes, media: Media, track: int = 1) -> bytes:
    """The payload of a track, cut from the stored bytes by the packet table."""
    return b"".join([data[at : at + n] for t, _, at, n, *_ in media.packets if t == track])


def feature(payload: bytes, media: Media) -> str:
    """Counts of the packet table and exact sums over the samples."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    above = samples >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    last = max((p[1] for p in media.packets), default=0.0)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};last_ms={last:.3f};sum={int(samples.sum(dtype=np.int64))};crossings={crossings}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every whole text (null: empty) as a Matroska file.

    One row per row, repeated ones too, in no order; null ids stay null; other columns aren't read; an empty table
    gives no rows.
    """

    def run(batches):
        for batch in batches:
            raw = [x.as_py() or b"" for x in batch.column(1).cast(pa.binary())]
            media = [mux(padded(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: ``doc_id, track, timestamp_ms, first_byte, length, cluster, keyframe, lacing, cued``.

    Null or malformed media give one row whose ``error`` says why, and nothing else.
    """
    names = ["doc_id", "track", "timestamp_ms", "first_byte", "length", "cluster", "keyframe", "lacing", "cued", "error"]

    def run(batches):
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = parse(data.as_py() or b"")
                    cued = {place for _, _, place in found.cues}
                    rows = [[n, *p, found.clusters[p[4]] in cued, None] for p in found.packets]
                except (MediaError, IndexError) as error:
                    rows = [[n, *[None] * 8, str(error)]]
                columns = list(zip(*rows, strict=True)) or [()] * 10
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, track long, timestamp_ms double, first_byte long, length long, cluster long, keyframe boolean, lacing long, cued boolean, error string"
    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, schema)


def digests(media: DataFrame) -> DataFrame:
    """What ``store`` wrote, read back: sizes, hashes and features of every stored file, one row per row.

    Of null media all columns but ``doc_id`` and ``n_bytes`` are null; of malformed ones those of the payload are. Media
    without packets have an empty payload. Repeated rows stay; other columns aren't read; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(2):
                data = data.as_py()
                stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                try:
                    found = parse(data or b"")
                    payload = None if data is None else demux(data, found)
                except (MediaError, IndexError):
                    payload = None
                if payload is None:
                    rows.append((None, None, None, *stored, None))
                else:
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), *stored, feature(payload, found)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
