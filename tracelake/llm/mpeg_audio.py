"""MPEG audio columns: resynchronised frames, tags, variable-bitrate tables, checksums, durations and seek offsets.

`parse` walks a stream of bytes: a leading ID3v2 tag (unsynchronised or with a footer, too), then frames of MPEG 1, 2 and 2.5,
layers I to III, of free format, too. Where no frame header stands, it searches on byte by byte. A frame counts if a like
one or the end follows, or, before a damaged stretch, if its own checksum holds; the bytes passed over are counted. A
first frame may hold a Xing, Info or VBRI table, and an encoder's delay and padding. Protected frames' CRC-16 is verified in
every layer. A trailing ID3v1 tag is read, unless `build` wrote the stream and its table's bytes reach the end. Durations
are exact: samples over the sampling rate, as coded and, where delay and padding are stated, as heard.

`build` writes any bytes losslessly as a Layer III stream: the side information says that frames hold no audio, so the
rest of each frame is ancillary data, where the bytes lie. An ID3v2.3 tag with a CRC-32 keeps their number and CRC-32;
a Xing table has the number of frames and bytes and 100 seek points. `payload` gives the bytes back and checks both.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field, replace
from fractions import Fraction
from functools import lru_cache

import numpy as np

# Fixed values of the format.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
POLYNOMIAL = 0x8005


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2 or 25
    layer: int
    protected: bool
    bitrate: int  # kbit/s
    rate: int
    padding: int
    mono: bool
    joint: int  # the first subband that both channels share, 32 if none
    size: int  # bytes of the frame, 0 if only the next frame shows them
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    def like(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(maxsize=4096)
def header(word: int) -> Header | None:
    """The header in four bytes, or None where they aren't one."""
    if word >> 21 != 0x7FF:
        return None
    version, layer = {0: 25, 2: 2, 3: 1}.get(word >> 19 & 3), 4 - (word >> 17 & 3)
    bitrate, rate, padding = word >> 12 & 15, word >> 10 & 3, word >> 9 & 1
    if version is None or layer == 4 or bitrate == 15 or rate == 3 or word & 3 == 2:
        return None
    kbits = BITRATES[1 if version == 1 else 2, layer][bitrate]
    hertz = RATES[rate] // {1: 1, 2: 2, 25: 4}[version]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    size = (12000 * kbits // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + padding
    joint = 4 * ((word >> 4 & 3) + 1) if word >> 6 & 3 == 1 else 32
    return Header(version, layer, not word >> 16 & 1, kbits, hertz, padding, word >> 6 & 3 == 3, joint, size if kbits else 0, samples)


def free_size(data: bytes, at: int, end: int, h: Header) -> int:
    """Bytes of a free-format frame: up to the next header that is like it, of free format and followed by another at that distance."""
    slot, least = 4 if h.layer == 1 else 1, 6 + h.side
    to = data.find(b"\xff", at + least, end)
    while 0 <= to < min(end, at + 8192):
        follow = header(int.from_bytes(data[to : to + 4], "big")) if to + 4 <= end else None
        if follow is not None and follow.like(h) and not follow.bitrate:
            bare = to - at - slot * h.padding
            after = to + bare + slot * follow.padding
            third = header(int.from_bytes(data[after : after + 4], "big")) if after + 4 <= end else None
            if after == end or third is not None and third.like(h) and not third.bitrate:
                return bare
        to = data.find(b"\xff", to + 1, end)
    return 0


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        x = byte << 8
        for _ in range(8):
            x = (x << 1 ^ POLYNOMIAL if x & 0x8000 else x << 1) & 0xFFFF
        out.append(x)
    return out


_TABLE = _crc_table()


# Fixed values of Layer II: (subbands of the table, (subbands, bits of their allocation), ...).
ALLOCATION = {
    "a": (27, (11, 4), (12, 3), (4, 2)), "b": (30, (11, 4), (12, 3), (7, 2)), "c": (8, (2, 4), (6, 3)), "d": (12, (2, 4), (10, 3)),
    "low": (30, (4, 4), (7, 3), (19, 2)),
}


def _table_of(h: Header) -> str:
    """The allocation table of a Layer II frame."""
    if h.version != 1:
        return "low"
    each = h.bitrate if h.mono else h.bitrate // 2
    if 0 < each < 56:
        return "d" if h.rate == 32000 else "c"
    return "a" if h.rate == 48000 or 0 < each <= 80 else "b"


def covered_bits(data: bytes, at: int, h: Header) -> int:
    """How many bits behind the checksum of the frame at `at` the checksum covers."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 4 * sum(channels if band < h.joint else 1 for band in range(32))
    bits = int.from_bytes(data[at + 6 : at + 6 + 64].ljust(64, b"\0"), "big")
    used = used_bands = 0
    _, *parts = ALLOCATION[_table_of(h)]
    band = 0
    for n, width in parts:
        for _ in range(n):
            stored = channels if band < h.joint else 1
            for _ in range(stored):
                used_bands += channels // stored if bits >> 512 - used - width & (1 << width) - 1 else 0
                used += width
            band += 1
    return used + 2 * used_bands


@lru_cache(maxsize=4096)
def crc16(data: bytes, start: int = 0xFFFF) -> int:
    for byte in data:
        start = (start << 8 & 0xFFFF) ^ _TABLE[start >> 8 ^ byte]
    return start


def crc16_bits(data: bytes, bits: int, start: int) -> int:
    """CRC-16 of the first `bits` bits."""
    out = crc16(data[: bits // 8], start)
    for k in range(bits // 8 * 8, bits):
        one = (data[k // 8] >> 7 - k % 8 & 1) ^ out >> 15
        out = (out << 1 & 0xFFFF) ^ (POLYNOMIAL if one else 0)
    return out


@dataclass
class Audio:
    frames: int = 0
    samples: int = 0
    rate: int = 0
    duration: Fraction = Fraction(0)
    delay: int = 0
    padding: int = 0
    bitrates: dict[int, int] = field(default_factory=dict)
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    skipped: int = 0
    resyncs: int = 0
    truncated: int = 0
    crc_checked: int = 0
    crc_bad: int = 0
    table: dict = field(default_factory=dict)
    tags: dict[str, bytes] = field(default_factory=dict)
    tag_crc_ok: bool | None = None
    version: int = 0
    layer: int = 0

    @property
    def heard(self) -> Fraction:
        """The duration less the encoder's delay and padding."""
        return Fraction(max(0, self.samples - self.delay - self.padding), self.rate) if self.rate else Fraction(0)

    def feature(self) -> str:
        rates = ",".join(f"{k}:{n}" for k, n in sorted(self.bitrates.items()))
        return f"v={self.version};layer={self.layer};rate={self.rate};frames={self.frames};samples={self.samples};seconds={self.duration.numerator}/{self.duration.denominator};kbit={rates};crc={self.crc_checked - self.crc_bad}/{self.crc_checked};skipped={self.skipped};last={int(self.offsets[-1]) if len(self.offsets) else -1}"


def _synchsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def read_id3v2(data: bytes) -> tuple[int, dict[str, bytes], bool | None]:
    """(bytes of the tag, its frames, whether its CRC-32 holds or None without one)."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0, {}, None
    major, flags, size = data[3], data[5], _synchsafe(data[6:10])
    whole = 10 + size + (10 if major == 4 and flags & 0x10 else 0)
    data = data[: 10 + size]
    if flags & 0x80 and major < 4:  # the whole tag keeps clear of false syncs
        data = data[:10] + data[10:].replace(b"\xff\x00", b"\xff")
    end, at, good = len(data), 10, None
    if flags & 0x40 and major == 3 and at + 10 <= end:
        extended, marks, padding = struct.unpack_from(">IHI", data, at)
        if marks & 0x8000 and at + 14 <= end:
            good = zlib.crc32(data[at + 4 + extended : end - padding]) == struct.unpack_from(">I", data, at + 10)[0]
        at += 4 + extended
    elif flags & 0x40 and major == 4 and at + 4 <= end:
        at += _synchsafe(data[at : at + 4])
    tags = {}
    while at + 10 <= end and data[at : at + 4].isalnum():
        name = data[at : at + 4].decode("ascii")
        length = _synchsafe(data[at + 4 : at + 8]) if major == 4 else struct.unpack_from(">I", data, at + 4)[0]
        body, marks = data[at + 10 : min(end, at + 10 + length)], data[at + 9]
        if major == 4 and marks & 0x01:  # a length of its own comes first
            body = body[4:]
        if major == 4 and (marks & 0x02 or flags & 0x80):
            body = body.replace(b"\xff\x00", b"\xff")
        if name in ("PRIV", "TXXX") and b"\0" in body[1:]:
            owner, _, body = body.partition(b"\0") if name == "PRIV" else body[1:].partition(b"\0")
            name += ":" + owner.decode("latin-1")
        tags[name] = body
        at += 10 + length
    return whole, tags, good


def read_table(frame: bytes, h: Header) -> dict:
    """A Xing, Info or VBRI table in a frame, or nothing."""
    at = 4 + 2 * h.protected + h.side
    mark = frame[at : at + 4]
    if mark in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags = struct.unpack_from(">I", frame, at + 4)[0]
        out, at = {"kind": mark.decode()}, at + 8
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit and len(frame) >= at + size:
                out[name] = struct.unpack_from(">I", frame, at)[0] if size == 4 else list(frame[at : at + 100])
                at += size
        if frame[at : at + 4] in (b"LAME", b"Lavc", b"Lavf") and len(frame) >= at + 24:
            out["encoder"] = frame[at : at + 9].rstrip(b"\0").decode("latin-1")
            both = int.from_bytes(frame[at + 21 : at + 24], "big")
            out["delay"], out["padding"] = both >> 12, both & 0xFFF
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = struct.unpack_from(">IIHHH", frame, 46)
        raw = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": raw}
    return {}


def _crc_holds(data: bytes, at: int, h: Header) -> bool:
    bits = covered_bits(data, at, h)
    body = data[at + 6 : at + 6 + -(-bits // 8)]
    if h.layer == 3:
        return crc16(data[at + 2 : at + 4] + body) == int.from_bytes(data[at + 4 : at + 6], "big")
    return 8 * len(body) >= bits and crc16_bits(body, bits, crc16(data[at + 2 : at + 4])) == int.from_bytes(data[at + 4 : at + 6], "big")


def _frames_to_the_end(data: bytes, at: int, tags: dict[str, bytes], good: bool | None) -> bool:
    """Whether a stream that `build` wrote has, by its table's bytes, frames up to its end: then nothing in them is a trailing tag."""
    h = header(int.from_bytes(data[at : at + 4], "big")) if good and "PRIV:payload_bytes" in tags else None
    return h is not None and at + read_table(data[at : at + h.size], h).get("bytes", -1) == len(data)


def parse(data: bytes) -> Audio:
    out = Audio()
    at, out.tags, out.tag_crc_ok = read_id3v2(data)
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG" and not _frames_to_the_end(data, at, out.tags, out.tag_crc_ok):
        end -= 128
        out.tags["ID3v1"] = data[end + 3 :]
    offsets, first, lost, free = [], None, False, 0
    while at + 4 <= end:
        h = header(int.from_bytes(data[at : at + 4], "big"))
        if h is not None and not h.bitrate:
            free = free if first is not None and not first.bitrate and free else free_size(data, at, end, h)
            h = replace(h, size=free + (4 if h.layer == 1 else 1) * h.padding) if free else None
        fits = h is not None and at + h.size <= end
        if fits and at + h.size + 4 <= end:
            follow = header(int.from_bytes(data[at + h.size : at + h.size + 4], "big"))
            # before a damaged stretch only a frame's own checksum vouches for it
            fits = follow is not None and follow.like(h) or not lost and first is not None and first.like(h) and h.protected and _crc_holds(data, at, h)
        if not fits:
            if h is not None and first is not None and not lost and first.like(h):
                out.truncated += 1
            out.resyncs += not lost
            lost = True
            next_sync = data.find(b"\xff", at + 1, end)
            next_sync = end if next_sync < 0 else next_sync
            out.skipped += next_sync - at
            at = next_sync
            continue
        lost = False
        if h.protected:
            out.crc_checked += 1
            out.crc_bad += not _crc_holds(data, at, h)
        if first is None:
            first = h
            out.version, out.layer, out.rate = h.version, h.layer, h.rate
            if h.layer == 3 and (table := read_table(data[at : at + h.size], h)):
                out.table, out.delay, out.padding = table, table.get("delay", 0), table.get("padding", 0)
                at += h.size
                continue
        offsets.append(at)
        out.samples += h.samples
        out.bitrates[h.bitrate] = out.bitrates.get(h.bitrate, 0) + 1
        at += h.size
    out.skipped += max(0, end - at)
    out.frames, out.offsets = len(offsets), np.array(offsets, dtype=np.int64)
    if out.rate:
        out.duration = Fraction(out.samples, out.rate)
    return out


def seek(audio: Audio, seconds: Fraction | float) -> int:
    """Byte offset of the frame that plays at a time."""
    if not audio.frames:
        raise ValueError("no frames")
    per_frame = audio.samples // audio.frames
    return int(audio.offsets[min(audio.frames - 1, max(0, int(Fraction(seconds) * audio.rate // per_frame)))])


# --- writing -------------------------------------------------------------------------------------------------
_RATE, _LARGE = 2, 14  # 32 kHz, so that every frame of a bitrate has one size; 320 kbit/s


def _frame_start(bitrate: int) -> bytes:
    """Header, checksum and empty side information of a mono MPEG-1 Layer III frame."""
    head = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | bitrate << 12 | _RATE << 10 | 3 << 6)
    side = bytes(17)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


_STARTS = {b: _frame_start(b) for b in range(1, 15)}
_ROOM = {b: header(int.from_bytes(s[:4], "big")).size - len(s) for b, s in _STARTS.items()}


def _tag(content: bytes) -> bytes:
    def frame(owner: bytes, body: bytes) -> bytes:
        body = owner + b"\0" + body
        return b"PRIV" + struct.pack(">IH", len(body), 0) + body

    frames = frame(b"payload_bytes", struct.pack(">Q", len(content))) + frame(b"payload_crc32", struct.pack(">I", zlib.crc32(content)))
    extended = struct.pack(">IHII", 10, 0x8000, 0, zlib.crc32(frames))
    size = len(extended) + len(frames)
    return b"ID3\x03\x00\x40" + bytes((size >> s & 127) for s in (21, 14, 7, 0)) + extended + frames


def build(content: bytes) -> bytes:
    """The bytes as a stream: frames of 320 kbit/s, the last of the least bitrate that holds what is left."""
    room = _ROOM[_LARGE]
    whole, left = divmod(len(content), room)
    last = min((b for b in _ROOM if _ROOM[b] >= left), default=_LARGE) if left else 0
    start = _STARTS[_LARGE]
    body = b"".join([start + content[k * room : (k + 1) * room] for k in range(whole)])
    sizes = [len(start) + room] * whole
    if left:
        body += _STARTS[last] + content[whole * room :] + bytes(_ROOM[last] - left)
        sizes.append(len(_STARTS[last]) + _ROOM[last])
    info_start = _STARTS[5]  # 64 kbit/s: room for the table
    info_size = len(info_start) + _ROOM[5]
    total = info_size + len(body)
    ends = [info_size + (len(start) + room) * min(k, whole) for k in range(len(sizes))]
    toc = bytes(min(255, 256 * ends[k * len(sizes) // 100] // total) if sizes else 0 for k in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(sizes), total) + toc
    return _tag(content) + info_start + table + bytes(_ROOM[5] - len(table)) + body


def payload(data: bytes, audio: Audio | None = None) -> bytes:
    """The bytes in a stream that `build` wrote; ValueError where a length or checksum does not hold."""
    audio = audio or parse(data)
    if audio.tag_crc_ok is not True or audio.crc_bad or "PRIV:payload_bytes" not in audio.tags:
        raise ValueError("a checksum of the stream does not hold")
    parts = []
    for at in audio.offsets.tolist():
        h = header(int.from_bytes(data[at : at + 4], "big"))
        parts.append(data[at + 6 + h.side : at + h.size])
    content = b"".join(parts)[: struct.unpack(">Q", audio.tags["PRIV:payload_bytes"])[0]]
    if zlib.crc32(content) != struct.unpack(">I", audio.tags["PRIV:payload_crc32"])[0] or audio.table.get("frames") != audio.frames:
        raise ValueError("the stream does not hold the bytes that were written")
    return content
