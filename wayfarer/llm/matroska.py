"""Matroska as a media column: a small muxer, an EBML parser, and packet tables.

The parser walks variable-length EBML elements (also of unknown size), reads tracks, clusters, SimpleBlocks and
BlockGroups, undoes Xiph, fixed-size and EBML lacing, reads the cues, and yields one packet per frame with track,
timestamp and the byte range of the frame in the file.  Frames stay where they are: a packet is a range, not a copy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices, pick

# Element ids of the Matroska specification (RFC 9559) and of EBML (RFC 8794).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION, CUE_RELATIVE_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
#: Elements that may end a cluster or segment of unknown size: those one level up.
TOP_LEVEL = {0x114D9B74, INFO, TRACKS, CLUSTER, CUES, 0x1043A770, 0x1254C367, 0x1941A469}

LACE_NONE, LACE_XIPH, LACE_FIXED, LACE_EBML = 0, 1, 2, 3
UNKNOWN = -1


class MatroskaError(ValueError):
    """The bytes are not well-formed Matroska."""


# --- writing ------------------------------------------------------------------------------------------------


def vint(value: int, width: int = 0) -> bytes:
    """An EBML size: leading zeros count the extra bytes; all-ones values are reserved for unknown sizes."""
    need = 1
    while value >= (1 << (7 * need)) - 1:
        need += 1
    width = max(need, width)
    return ((1 << (7 * width)) | value).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def signed_vint(value: int) -> bytes:
    """The difference of two lace sizes: an offset value of as many bytes as needed."""
    width = 1
    while not -(1 << (7 * width - 1)) < value < (1 << (7 * width - 1)):
        width += 1
    return vint(value + (1 << (7 * width - 1)) - 1, width)


def block_body(track: int, ticks: int, frames: list[bytes], lacing: int, key: bool = True) -> bytes:
    head = vint(track) + ticks.to_bytes(2, "big", signed=True) + bytes([(0x80 if key else 0) | lacing << 1])
    if lacing == LACE_NONE:
        return head + frames[0]
    sizes = [len(f) for f in frames]
    lace = bytes([len(frames) - 1])
    if lacing == LACE_XIPH:
        lace += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == LACE_EBML:
        lace += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    return head + lace + b"".join(frames)


def mux_pcm(payload: bytes, frame_bytes: int = 192, lace_frames: int = 64, cluster_frames: int = 4096, rate: int = 8000) -> bytes:
    """One track of unsigned 8-bit PCM: frames of frame_bytes, laced lace_frames to a block, cluster_frames to a
    cluster, and a cue for each cluster."""
    step = frame_bytes
    tick_ns = 1_000_000
    ticks = lambda sample: sample * 1000 // rate
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, tick_ns) + element(MUXING_APP, b"wayfarer") + element(WRITING_APP, b"wayfarer"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    parts, at, cues = [info, element(TRACKS, track)], 0, []
    at = sum(map(len, parts))
    span = min(step * cluster_frames, rate * 30 // step * step or step)  # a block's offset must fit 16 bits of ticks
    for start in range(0, len(payload), span):
        body = [uint(TIMESTAMP, ticks(start))]
        for b in range(start, min(start + span, len(payload)), step * lace_frames):
            stop = min(b + step * lace_frames, start + span, len(payload))
            frames = [payload[i : min(i + step, stop)] for i in range(b, stop, step)]
            same = len({len(f) for f in frames}) == 1
            lacing = LACE_NONE if len(frames) == 1 else LACE_FIXED if same else LACE_EBML
            body.append(element(SIMPLE_BLOCK, block_body(1, ticks(b) - ticks(start), frames, lacing)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, ticks(start)) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


# --- reading ------------------------------------------------------------------------------------------------


def read_vint(data, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """Value and the position behind it; UNKNOWN for a size of all ones."""
    if at >= len(data):
        raise MatroskaError(f"end of data at {at}")
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise MatroskaError(f"bad variable-length number at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << (7 * width)) - 1
    return (UNKNOWN if value == (1 << (7 * width)) - 1 else value), at + width


def children(data, at: int, end: int, stop: frozenset | set = frozenset()):
    """(id, body start, body end) of the elements in a range.  A child of unknown size reaches to the range's end
    (its own walk ends it); an id in stop ends this range."""
    while at < end:
        ident, body = read_vint(data, at, keep_marker=True)
        if ident in stop:
            return
        size, body = read_vint(data, body)
        close = end if size == UNKNOWN else body + size
        if close > end:
            raise MatroskaError(f"element {ident:#x} at {at} is cut short")
        yield ident, body, close
        if size == UNKNOWN:
            close = unknown_end(data, body, end, ident)
        at = close


def unknown_end(data, at: int, end: int, ident: int) -> int:
    """Where an element of unknown size ends: at the first element that cannot be its child."""
    outer = TOP_LEVEL if ident == CLUSTER else {EBML, SEGMENT}
    while at < end:
        child, body = read_vint(data, at, keep_marker=True)
        if child in outer:
            return at
        size, body = read_vint(data, body)
        at = unknown_end(data, body, end, child) if size == UNKNOWN else body + size
    return end


def number(data, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


@dataclass(frozen=True)
class Packet:
    track: int
    cluster: int
    block_offset: int
    frame: int
    timestamp_ns: int
    keyframe: bool
    lacing: int
    offset: int
    length: int


@dataclass
class Parsed:
    tracks: list[dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # (time in ns, track, absolute offset of the cluster)
    clusters: list[int]
    scale: int


def lace_sizes(data, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first frame begins."""
    if lacing == LACE_NONE:
        return [end - at], at
    if at >= end:
        raise MatroskaError(f"lace head missing at {at}")
    count, at = data[at] + 1, at + 1
    if lacing == LACE_FIXED:
        if (end - at) % count:
            raise MatroskaError(f"{end - at} bytes are not {count} equal frames")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for i in range(count - 1):
        if lacing == LACE_XIPH:
            size = 0
            while True:
                byte, at = data[at], at + 1
                size += byte
                if byte != 255:
                    break
        elif i == 0:
            size, at = read_vint(data, at)
        else:
            begun = at
            raw, at = read_vint(data, at)
            width = at - begun
            raw = (1 << (7 * width)) - 1 if raw == UNKNOWN else raw
            size = sizes[-1] + raw - ((1 << (7 * width - 1)) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise MatroskaError("lace sizes exceed the block")
    return [*sizes, last], at


def parse(data: bytes) -> Parsed:
    out, rates = Parsed([], [], [], [], 1_000_000), {}
    view = memoryview(data)
    for ident, a, b in children(view, 0, len(view)):
        if ident == SEGMENT:
            _segment(view, a, b, out, rates)
    out.cues = [(t * out.scale, track, at) for t, track, at in out.cues]
    return out


def _segment(data, start: int, end: int, out: Parsed, rates: dict) -> None:
    for ident, a, b in children(data, start, end, {EBML, SEGMENT}):
        if ident == INFO:
            for i, x, y in children(data, a, b):
                if i == TIMESTAMP_SCALE:
                    out.scale = number(data, x, y)
        elif ident == TRACKS:
            for i, x, y in children(data, a, b):
                if i == TRACK_ENTRY:
                    out.tracks.append(_track(data, x, y, rates))
        elif ident == CLUSTER:
            _cluster(data, a, b, out, rates)
        elif ident == CUES:
            for i, x, y in children(data, a, b):
                if i == CUE_POINT:
                    _cue(data, x, y, start, out)


def _track(data, a: int, b: int, rates: dict) -> dict:
    track = {"number": 0, "type": 0, "codec": "", "rate": 0.0, "channels": 1, "bits": 0, "frame_ns": 0}
    for i, x, y in children(data, a, b):
        if i == TRACK_NUMBER:
            track["number"] = number(data, x, y)
        elif i == TRACK_TYPE:
            track["type"] = number(data, x, y)
        elif i == CODEC_ID:
            track["codec"] = bytes(data[x:y]).rstrip(b"\0").decode("ascii", "replace")
        elif i == DEFAULT_DURATION:
            track["frame_ns"] = number(data, x, y)
        elif i == AUDIO:
            for j, p, q in children(data, x, y):
                if j == SAMPLING_FREQUENCY and q - p in (4, 8):
                    track["rate"] = struct.unpack(">f" if q - p == 4 else ">d", data[p:q])[0]
                elif j == CHANNELS:
                    track["channels"] = number(data, p, q)
                elif j == BIT_DEPTH:
                    track["bits"] = number(data, p, q)
    rates[track["number"]] = track
    return track


def _cue(data, a: int, b: int, segment: int, out: Parsed) -> None:
    time = 0
    for i, x, y in children(data, a, b):
        if i == CUE_TIME:
            time = number(data, x, y)
        elif i == CUE_TRACK_POSITIONS:
            track = at = 0
            for j, p, q in children(data, x, y):
                if j == CUE_TRACK:
                    track = number(data, p, q)
                elif j == CUE_CLUSTER_POSITION:
                    at = number(data, p, q)
            out.cues.append((time, track, segment + at))


def _cluster(data, a: int, b: int, out: Parsed, rates: dict) -> None:
    index, time = len(out.clusters), 0
    out.clusters.append(a)
    for ident, x, y in children(data, a, b, TOP_LEVEL):
        if ident == TIMESTAMP:
            time = number(data, x, y)
        elif ident == SIMPLE_BLOCK:
            _block(data, x, y, index, time, None, out, rates)
        elif ident == BLOCK_GROUP:
            parts = {i: (p, q) for i, p, q in children(data, x, y)}
            if BLOCK in parts:
                _block(data, *parts[BLOCK], index, time, REFERENCE_BLOCK not in parts, out, rates)


def _block(data, a: int, b: int, cluster: int, time: int, key: bool | None, out: Parsed, rates: dict) -> None:
    track, at = read_vint(data, a)
    if at + 3 > b:
        raise MatroskaError(f"block at {a} is cut short")
    ticks, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    lacing = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, b, lacing)
    stamp = (time + ticks) * out.scale
    entry = rates.get(track, {})
    width = max(1, entry.get("channels", 1) * entry.get("bits", 0) // 8) if entry.get("bits") and entry.get("rate") else 0
    for k, size in enumerate(sizes):
        out.packets.append(Packet(track, cluster, a, k, stamp, flags >= 128 if key is None else key, lacing, at, size))
        at += size
        # Later frames of a lace follow by the track's frame duration, or for PCM by the samples before them.
        stamp += entry.get("frame_ns") or (int(size // width * 1e9 / entry["rate"]) if width else 0)


def payload_of(data: bytes, parsed: Parsed, track: int = 1) -> bytes:
    return b"".join(data[p.offset : p.offset + p.length] for p in parsed.packets if p.track == track)


def seek(data: bytes, parsed: Parsed, time_ns: int) -> list[Packet]:
    """Packets of the cluster that the last cue at or before the time points to; the cluster alone is read."""
    at = max(((t, at) for t, _, at in parsed.cues if t <= time_ns), default=None)
    if at is None:
        return []
    view = memoryview(data)
    ident, body = read_vint(view, at[1], keep_marker=True)
    if ident != CLUSTER:
        raise MatroskaError(f"the cue of {at[0]} ns points to no cluster")
    size, body = read_vint(view, body)
    end = unknown_end(view, body, len(view), ident) if size == UNKNOWN else body + size
    out = Parsed([], [], [], [], parsed.scale)
    _cluster(view, body, end, out, {t["number"]: t for t in parsed.tracks})
    return out.packets


# --- tables -------------------------------------------------------------------------------------------------

PACKETS = "media_id bigint, track int, cluster int, block_offset bigint, frame int, timestamp_ns bigint, keyframe boolean, lacing int, offset bigint, length bigint, cue boolean, error string"
_PACKETS = pa.schema([("media_id", pa.int64()), ("track", pa.int32()), ("cluster", pa.int32()), ("block_offset", pa.int64()), ("frame", pa.int32()), ("timestamp_ns", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("cue", pa.bool_()), ("error", pa.string())])


def packet_table(media: DataFrame, id_col: str = "media_id", data_col: str = "data") -> DataFrame:
    """One row per packet.  ``cue`` marks packets of clusters that a cue points to.

    Null, empty or broken media give one row with ``error`` and no packet; well-formed media without packets give
    none.  Repeated rows repeat their packets.  The walk is local to a row: no shuffle.
    """

    def rows(part):
        out = {f.name: [] for f in _PACKETS}
        for key, data in zip(part["media_id"], part["data"], strict=True):
            try:
                if not data:
                    raise MatroskaError("no data")
                parsed = parse(data)
                heads = {at for _, _, at in parsed.cues}
                sizes = {i: _head(data, a) in heads for i, a in enumerate(parsed.clusters)}
                found = [(key, p.track, p.cluster, p.block_offset, p.frame, p.timestamp_ns, p.keyframe, p.lacing, p.offset, p.length, sizes[p.cluster], None) for p in parsed.packets]
            except (MatroskaError, IndexError) as e:
                found = [(key, *[None] * 10, str(e))]
            for row in found:
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
        return out

    return map_slices(pick(media, media_id=id_col, data=data_col), rows, PACKETS, _PACKETS)


def _head(data: bytes, body: int) -> int:
    """The offset of the head of the cluster whose body begins at body."""
    for width in range(1, 9):
        at = body - width - 4
        if at >= 0 and data[at : at + 4] == b"\x1f\x43\xb6\x75" and read_vint(data, at + 4)[1] == body:
            return at
    return -1


FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def stored(text: str | None, unit: int = 192) -> tuple[int, bytes]:
    """Bytes of the text, and the file that stores them padded with spaces to a positive multiple of unit."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), mux_pcm(raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw)), unit)


def features(data: bytes) -> tuple[bytes, str]:
    """The payload read back from the stored bytes, and a summary of its samples and packets.

    Samples are unsigned 8-bit around 128: their sum, energy and turning points, a histogram of eight levels, the loudest
    packet by energy with its time, and by way of the cues the checksum of the samples of the cluster at half time.
    """
    parsed = parse(data)
    payload = payload_of(data, parsed)
    raw = np.frombuffer(payload, np.uint8)
    samples = raw.astype(np.int16) - 128
    lengths = np.array([p.length for p in parsed.packets])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[lengths > 0]
    full = [p for p in parsed.packets if p.length]
    energy = np.add.reduceat(samples.astype(np.int32) ** 2, starts, dtype=np.int64)
    loud = int(np.argmax(energy))
    slopes = np.sign(np.diff(samples))
    slopes = slopes[slopes != 0]
    levels = np.bincount(raw >> 5, minlength=8)
    half = b"".join(data[p.offset : p.offset + p.length] for p in seek(data, parsed, full[-1].timestamp_ns // 2))
    said = {
        "clusters": len(parsed.clusters),
        "packets": len(parsed.packets),
        "lacings": "".join(map(str, sorted({p.lacing for p in parsed.packets}))),
        "last_ns": parsed.packets[-1].timestamp_ns,
        "sum": int(samples.sum(dtype=np.int64)),
        "energy": int(energy.sum()),
        "turns": int(np.count_nonzero(slopes[1:] != slopes[:-1])),
        "levels": ",".join(map(str, levels)),
        "loud_ns": full[loud].timestamp_ns,
        "loud_energy": int(energy[loud]),
        "half_crc32": zlib.crc32(half),
    }
    return payload, ";".join(f"{k}={v}" for k, v in said.items())


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text through the muxer and back: the columns of FEATURES, one row per input row.

    A null text is the empty one; equal texts give equal values; repeated rows repeat; other columns are ignored.
    """

    def rows(part):
        out = {f.name: [] for f in _FEATURES}
        for key, text in zip(part["doc_id"], part["text"], strict=True):
            n, data = stored(text)
            payload, said = features(data)
            values = (key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), said)
            for name, value in zip(out, values, strict=True):
                out[name].append(value)
        return out

    return map_slices(pick(docs, doc_id=id_col, text=text_col), rows, FEATURES, _FEATURES)
