"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

`mux` stores bytes losslessly as one track of 8-bit PCM; `walk` reads any Matroska
bytes, block by block: variable-length ids and sizes, unknown sizes, SimpleBlock and BlockGroup,
the three lacings, cues, each of which must point to a cluster. Null text is an empty text; broken media
give an `error` and the packets before it, also those of elements that are cut off, never an exception in a job.
Rows with equal ids stay apart.
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
from pyspark.sql import types as T

from .common import bounded_batches, make_room, map_batches, utf8

#: Fixed values of the format: element ids.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
ATTACHMENTS, CHAPTERS, TAGS = 0x1941A469, 0x1043A770, 0x1254C367
DOC_TYPE, TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x4282, 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83
CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset({SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS})
TOP_LEVEL = frozenset({SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, ATTACHMENTS, CHAPTERS, TAGS, SEGMENT, EBML})
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Samples in a frame, frames in a block and in a cluster; 8,000 samples a second make a frame 24 ms.
FRAME, BLOCK_FRAMES, CLUSTER_FRAMES, RATE, FRAME_MS = 192, 8, 1024, 8000, 24


# --- writing ---------------------------------------------------------------------------------


def size_bytes(n: int, width: int = 0) -> bytes:
    """n as a variable-length size, at least `width` bytes long; all ones is kept for unknown."""
    width = max(width, 1)
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: str) -> bytes:
    """The body of a block after its four header bytes."""
    if lacing == "none":
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == "ebml":
        sizes = [len(f) for f in frames]
        head += size_bytes(sizes[0])
        for last, now in zip(sizes[:-2], sizes[1:-1]):
            width = 1
            while abs(now - last) > (1 << 7 * width - 1) - 2:
                width += 1
            head += (now - last + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    elif len({len(f) for f in frames}) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


def simple_block(track: int, relative: int, frames: list[bytes], lacing: str) -> bytes:
    flags = 0x80 | LACINGS.index(lacing) << 1
    return element(SIMPLE_BLOCK, size_bytes(track) + struct.pack(">hB", relative, flags) + laced(frames, lacing))


HEADER = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
INFO_AND_TRACKS = element(INFO, number(TIMESTAMP_SCALE, 1_000_000)) + element(
    TRACKS,
    element(
        TRACK_ENTRY,
        number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME_MS * 1_000_000)
        + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">f", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)),
    ),
)


def padded(data: bytes) -> bytes:
    """data and spaces, up to a positive multiple of FRAME bytes."""
    return data + b" " * (-len(data) % FRAME if data else FRAME)


def mux(payload: bytes) -> bytes:
    """The payload (a multiple of FRAME bytes) as the samples of one PCM track; the lacing goes round block by block."""
    parts, at, cues, n = [INFO_AND_TRACKS], len(INFO_AND_TRACKS), [], len(payload) // FRAME
    for first in range(0, n, CLUSTER_FRAMES):
        blocks = [number(CLUSTER_TIMESTAMP, first * FRAME_MS)]
        for k in range(first, min(first + CLUSTER_FRAMES, n), BLOCK_FRAMES):
            group = [payload[i * FRAME : (i + 1) * FRAME] for i in range(k, min(k + BLOCK_FRAMES, first + CLUSTER_FRAMES, n))]
            lacing = LACINGS[1 + k // BLOCK_FRAMES % 3] if len(group) > 1 else "none"
            blocks.append(simple_block(1, (k - first) * FRAME_MS, group, lacing))
        cues.append(element(CUE_POINT, number(CUE_TIME, first * FRAME_MS) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return HEADER + element(SEGMENT, b"".join(parts))


# --- reading ---------------------------------------------------------------------------------


class Broken(ValueError):
    """The bytes are no Matroska, or end too early."""


def read_size(buf: bytes, at: int, end: int) -> tuple[int, int]:
    """A variable-length number and where it ends; -1 for the unknown size."""
    if at >= end or not buf[at]:
        raise Broken(f"no size at {at}")
    width = 9 - buf[at].bit_length()
    if at + width > end:
        raise Broken(f"size cut off at {at}")
    n = int.from_bytes(buf[at : at + width], "big") & (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def elements(buf: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, start, end of body) of the children. An unknown size ends at the next element that can't be a child.

    A master element that is cut off is given as far as it goes, before the error.
    """
    while at < end:
        width = 9 - buf[at].bit_length() if buf[at] else 9
        if width > 4 or at + width > end:
            raise Broken(f"no element id at {at}")
        ident = int.from_bytes(buf[at : at + width], "big")
        if inside == CLUSTER and ident in TOP_LEVEL:
            return
        n, body = read_size(buf, at + width, end)
        if n < 0:
            stop = end
            if ident == CLUSTER:
                try:
                    stop = body
                    for _, _, stop in elements(buf, body, end, CLUSTER):
                        pass
                except Broken:
                    stop = end
        else:
            stop = body + n
            if stop > end and ident not in MASTERS:
                raise Broken(f"element {ident:x} cut off at {at}")
        yield ident, body, min(stop, end)
        if stop > end:
            raise Broken(f"element {ident:x} cut off at {at}")
        at = stop


def uint(buf: bytes, span: tuple[int, int]) -> int:
    return int.from_bytes(buf[span[0] : span[1]], "big")


def lace_sizes(buf: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """The frames' sizes and where the first frame begins."""
    if not lacing:
        return [end - at], at
    if at >= end:
        raise Broken(f"no lace count at {at}")
    count, at = buf[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % count:
            raise Broken(f"fixed lacing at {at}")
        return [(end - at) // count] * count, at
    if lacing == 1:
        for _ in range(count - 1):
            n = 0
            while at < end and buf[at] == 255:
                n, at = n + 255, at + 1
            if at >= end:
                raise Broken(f"xiph lacing at {at}")
            sizes.append(n + buf[at])
            at += 1
    elif count > 1:
        n, at = read_size(buf, at, end)
        sizes.append(n)
        for _ in range(count - 2):
            start = at
            step, at = read_size(buf, at, end)
            if step < 0:
                step = (1 << 7 * (at - start)) - 1
            n += step - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Broken(f"lace sizes at {at}")
    return sizes, at


@dataclass
class Media:
    """What isn't packets. clusters: where each begins in the segment. cues: (timestamp in ns, track, place of the cluster)."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0
    error: str = ""


def walk(buf: bytes, media: Media) -> Iterator[list[tuple]]:
    """Block by block its packets, while `media` gets the rest; at a fault, it ends, and media.error tells which.

    A packet: (track, cluster, block, lace, timestamp in ns, duration in ns or -1, keyframe, start, length, lacing).
    """
    try:
        first = True
        for ident, start, end in elements(buf, 0, len(buf)):
            if first and ident != EBML:
                raise Broken("no EBML header")
            first = False
            if ident == SEGMENT:
                yield from read_segment(buf, start, end, media)
        if first:
            raise Broken("no EBML header")
        if lost := [place for _, _, place in media.cues if place not in set(media.clusters)]:
            raise Broken(f"{len(lost)} cues point to no cluster")
    except (Broken, IndexError, struct.error) as e:
        media.error = str(e) or type(e).__name__


def parse(buf: bytes) -> Media:
    """The whole media with its packets."""
    media = Media()
    for packets in walk(buf, media):
        media.packets += packets
    return media


def read_segment(buf: bytes, start: int, end: int, media: Media) -> Iterator[list[tuple]]:
    scale, begin = 1_000_000, start
    for ident, at, stop in elements(buf, start, end):
        if ident == INFO:
            for child, *span in elements(buf, at, stop):
                if child == TIMESTAMP_SCALE:
                    scale = uint(buf, span)
        elif ident == TRACKS:
            for child, a, b in elements(buf, at, stop):
                if child == TRACK_ENTRY:
                    track = read_track(buf, a, b)
                    media.tracks[track["number"]] = track
        elif ident == CLUSTER:
            media.clusters.append(begin - start)
            yield from read_cluster(buf, at, stop, media, scale)
        elif ident == CUES:
            for child, a, b in elements(buf, at, stop):
                if child == CUE_POINT:
                    read_cue(buf, a, b, media, scale)
        begin = stop


def read_track(buf: bytes, at: int, stop: int) -> dict:
    track = {"number": 0, "type": 0, "codec": "", "default_ns": -1, "rate": 8000.0, "channels": 1, "bits": 0}
    names = {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "default_ns", CHANNELS: "channels", BIT_DEPTH: "bits"}
    for ident, a, b in elements(buf, at, stop):
        if ident in names:
            track[names[ident]] = uint(buf, (a, b))
        elif ident == CODEC_ID:
            track["codec"] = buf[a:b].decode("ascii", "replace")
        elif ident == AUDIO:
            for inner, c, d in elements(buf, a, b):
                if inner in names:
                    track[names[inner]] = uint(buf, (c, d))
                elif inner == SAMPLING_FREQUENCY:
                    track["rate"] = struct.unpack(">f" if d - c == 4 else ">d", buf[c:d])[0]
    return track


def read_cluster(buf: bytes, at: int, stop: int, media: Media, scale: int) -> Iterator[list[tuple]]:
    base = 0
    for ident, a, b in elements(buf, at, stop, CLUSTER):
        if ident == CLUSTER_TIMESTAMP:
            base = uint(buf, (a, b))
        elif ident == SIMPLE_BLOCK:
            yield read_block(buf, a, b, media, base, scale, None, bool(buf[read_size(buf, a, b)[1] + 2] & 0x80))
        elif ident == BLOCK_GROUP:
            inner = {i: (c, d) for i, c, d in elements(buf, a, b)}
            if BLOCK in inner:
                lasts = uint(buf, inner[BLOCK_DURATION]) * scale if BLOCK_DURATION in inner else None
                yield read_block(buf, *inner[BLOCK], media, base, scale, lasts, REFERENCE_BLOCK not in inner)


def read_block(buf: bytes, a: int, b: int, media: Media, base: int, scale: int, lasts: int | None, key: bool) -> list[tuple]:
    track, at = read_size(buf, a, b)
    relative, flags = struct.unpack_from(">hB", buf, at)
    lacing = flags >> 1 & 3
    sizes, at = lace_sizes(buf, at + 3, b, lacing)
    each = media.tracks.get(track, {}).get("default_ns", -1) if lasts is None else lasts // len(sizes)
    stamp, cluster, out = (base + relative) * scale, len(media.clusters) - 1, []
    for k, n in enumerate(sizes):
        out.append((track, cluster, media.blocks, k, stamp + k * max(each, 0), each, key, at, n, LACINGS[lacing]))
        at += n
    media.blocks += 1
    return out


def read_cue(buf: bytes, a: int, b: int, media: Media, scale: int) -> None:
    stamp, found = 0, []
    for ident, c, d in elements(buf, a, b):
        if ident == CUE_TIME:
            stamp = uint(buf, (c, d)) * scale
        elif ident == CUE_TRACK_POSITIONS:
            inner = {i: (x, y) for i, x, y in elements(buf, c, d)}
            if CUE_TRACK in inner and CUE_CLUSTER_POSITION in inner:
                found.append((uint(buf, inner[CUE_TRACK]), uint(buf, inner[CUE_CLUSTER_POSITION])))
    media.cues += [(stamp, track, place) for track, place in found]


# --- DataFrames ------------------------------------------------------------------------------


def mux_texts(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """df and `media_col`: the text's UTF-8 bytes, padded, as Matroska. Null text is empty."""
    place = df.columns.index(text_col)
    return map_batches(df, f"`{media_col}` binary", lambda batch: [pa.array([mux(padded(x)) for x in utf8(batch.column(place))], pa.binary())])


PACKET = "track long, cluster long, block long, lace long, timestamp_ns long, duration_ns long, keyframe boolean, byte_offset long, byte_length long, lacing string"


def packet_table(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """One row for each packet: id, track, cluster, block, lace, timestamp, duration, keyframe, byte range, lacing.

    Null or broken media give the packets before the fault (none for null).
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    bounded_batches(df.sparkSession)
    added = T.StructType.fromDDL(PACKET)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *added.fields])

    kinds = [pa.bool_() if f.dataType == T.BooleanType() else pa.string() if f.dataType == T.StringType() else pa.int64() for f in added.fields]

    def run(batches):
        make_room()
        for batch in batches:
            for k in range(batch.num_rows):
                for packets in chunks(walk(batch.column(1)[k].as_py() or b"", Media())):
                    ids = batch.column(0).take(pa.array([k] * len(packets)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, kind) for c, kind in zip(zip(*packets), kinds))], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def chunks(blocks: Iterator[list[tuple]], most: int = 1 << 14) -> Iterator[list[tuple]]:
    some: list[tuple] = []
    for b in blocks:
        some += b
        if len(some) >= most:
            yield some
            some = []
    if some:
        yield some


class Digest:
    """Of the samples, block by block: digest, last bytes, histogram, crossings of the middle; and the packets' number and time."""

    def __init__(self):
        self.sha, self.n, self.tail, self.counts, self.crossings, self.packets, self.ns, self.above = hashlib.sha256(), 0, b"", np.zeros(256, np.int64), 0, 0, 0, None

    def add(self, buf: bytes, packets: list[tuple]) -> None:
        """Frames of a block stand side by side."""
        samples = memoryview(buf)[packets[0][7] : packets[-1][7] + packets[-1][8]]
        self.packets += len(packets)
        self.ns += sum(p[5] for p in packets if p[5] > 0)
        if not len(samples):
            return
        self.sha.update(samples)
        self.n += len(samples)
        self.tail = (self.tail + bytes(samples[-16:]))[-16:]
        x = np.frombuffer(samples, np.uint8)
        self.counts += np.bincount(x, minlength=256)
        above = x >= 96
        self.crossings += int(np.count_nonzero(above[1:] != above[:-1])) + int(self.above is not None and self.above != bool(above[0]))
        self.above = bool(above[-1])

    def feature(self, media: Media) -> str:
        """Level, spread, crossings of the middle, entropy and the shape of the container; fixed decimals."""
        if not self.n:
            return ""
        share = self.counts / self.n
        mean = float(share @ np.arange(256))
        std = float(np.sqrt(share @ (np.arange(256) - mean) ** 2))
        some = share[share > 0]
        return (
            f"mean={mean:.6f};std={std:.6f};crossings={self.crossings};entropy={-(some * np.log2(some)).sum():.6f}"
            f";tracks={len(media.tracks)};clusters={len(media.clusters)};blocks={media.blocks};packets={self.packets};cues={len(media.cues)};ms={self.ns // 1_000_000}"
        )


def media_digest(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df without the media, plus payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and error, all from the parsed packets.

    Null or broken media: what could be read, and `error` says why (else null).
    """
    place = df.columns.index(media_col)

    def run(batch):
        rows = []
        for buf in batch.column(place).to_pylist():
            buf, media, digest = buf or b"", Media(), Digest()
            for packets in walk(buf, media):
                digest.add(buf, packets)
            rows.append((digest.n, digest.sha.hexdigest(), zlib.crc32(digest.tail), len(buf), hashlib.sha256(buf).hexdigest(), digest.feature(media), media.error or None))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        return [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]

    columns = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return map_batches(df, columns, run).drop(media_col)
