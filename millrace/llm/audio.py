"""MPEG audio in a binary column: frames, tags, exact durations and seek offsets.

A stream is walked from header to header. A header counts if the next one of the same kind stands
where its frame ends, or the stream ends there; otherwise the search goes on at the next byte, which
is how the walk gets back into step after junk, cut frames and false sync words.
"""

from __future__ import annotations

import hashlib
import itertools
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_KBPS[2, 3] = _KBPS[2, 2]
_VERSION = {3: "1", 2: "2", 0: "2.5"}


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        c = n << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for b in data:
        crc = ((crc << 8) & 0xFF00) ^ _CRC[(crc >> 8) ^ b]
    return crc


def crc16_bits(data: bytes, bits: int, crc: int = 0xFFFF) -> int:
    """The checksum of the first bits of data."""
    crc = crc16(data[: bits // 8], crc)
    for i in range(bits % 8):
        bit = data[bits // 8] >> (7 - i) & 1
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if crc >> 15 ^ bit else 0)
    return crc


class _Header:
    """What the second to fourth byte of a header say."""

    __slots__ = ("kind", "size", "samples", "rate", "kbps", "channels", "protected", "side", "covered", "version", "layer", "pad", "bound", "widths")

    def __init__(self, a: int, b: int, c: int) -> None:
        v, l, r, k = (a >> 3) & 3, 4 - ((a >> 1) & 3), (b >> 2) & 3, b >> 4
        self.version, self.layer = _VERSION[v], l
        low = v != 3
        #: 0 kbps is a free format: all frames have one size, which the distance of two headers tells.
        self.rate, self.kbps = _RATES[v][r], _KBPS[1 + low, l][k - 1] if k else 0
        pad, mode = (b >> 1) & 1, c >> 6
        self.pad = pad * 4 if l == 1 else pad
        self.channels = 1 if mode == 3 else 2
        self.samples = 384 if l == 1 else 576 if l == 3 and low else 1152
        self.size = (12000 * self.kbps // self.rate + pad) * 4 if l == 1 else self.samples * 125 * self.kbps // self.rate + pad
        self.protected = not a & 1
        self.side = ((17, 9)[low] if mode == 3 else (32, 17)[low]) if l == 3 else 0
        #: Bytes behind the checksum that it covers; None where that depends on the bits themselves.
        self.covered = self.side
        if l == 1:
            bound = 32 if mode != 1 else 4 * (((c >> 4) & 3) + 1)
            self.covered = 16 if mode == 3 else (bound * 8 + (32 - bound) * 4) // 8
        elif l == 2:
            self.covered = None
            self.widths = _allocation(low, self.rate, self.kbps // self.channels)
            self.bound = len(self.widths) if mode != 1 else min(len(self.widths), 4 * (((c >> 4) & 3) + 1))
        #: Frames of one stream are alike in these bits.
        self.kind = (v, l, r)


def _allocation(low: bool, rate: int, kbps: int) -> list[int]:
    """Bits of the allocation of each subband of layer 2, by the rate of one channel; none in a free format."""
    if low:
        return [4] * 4 + [3] * 7 + [2] * 19
    if kbps >= 56:
        return [4] * 11 + [3] * 12 + [2] * (7 if kbps >= 96 and rate != 48000 else 4)
    return [4] * 2 + [3] * (10 if rate == 32000 else 6) if kbps else []


def layer2_bits(body: bytes, h: _Header) -> int | None:
    """Bits behind the checksum of a frame of layer 2 that it covers: the allocation, and two for each
    channel of a subband with any. None where the frame is too short to tell."""
    word, have = int.from_bytes(body[:48], "big"), 8 * len(body[:48])
    at = used = 0
    for sb, width in enumerate(h.widths):
        for _ in range(h.channels if sb < h.bound else 1):
            at += width
            if at > have:
                return None
            if word >> (have - at) & ((1 << width) - 1):
                used += 1 if sb < h.bound else h.channels
    return at + 2 * used if 8 * len(body) >= at + 2 * used else None


def _checked(data: bytes, at: int, h: _Header, size: int) -> bool | None:
    """Whether the checksum of a frame fits; None if it has none or nothing says what it covers."""
    if not h.protected:
        return None
    body = data[at + 6 : at + size]
    if h.layer == 2:
        bits = layer2_bits(body, h) if h.widths else None
    else:
        bits = 8 * h.covered
    return None if bits is None else crc16_bits(data[at + 2 : at + 4] + body[: -(-bits // 8)], 16 + bits) == data[at + 4] << 8 | data[at + 5]


#: Bytes of a frame, beyond which no free-format stream goes.
_MOST = 1 << 14


def _free_size(data: bytes, at: int, h: _Header, end: int) -> int | None:
    """The size of the frames of a free-format stream without padding: the distance to the next header of
    the kind behind which another one follows at that distance, or the end of the stream."""
    p = data.find(b"\xff", at + 24, min(end, at + _MOST))
    while p >= 0:
        o = header(data, p)
        if o is not None and o.kind == h.kind and not o.kbps:
            size = p - at - h.pad
            after = p + size + o.pad
            third = header(data, after)
            if after == end or (third is not None and third.kind == h.kind and not third.kbps):
                return size
        p = data.find(b"\xff", p + 1, min(end, at + _MOST))
    return None


_KNOWN: dict[tuple[int, int, int], _Header | None] = {}


def header(data: bytes, at: int) -> _Header | None:
    """The frame header at a place, if there is one."""
    if at + 4 > len(data) or data[at] != 0xFF:
        return None
    key = (data[at + 1], data[at + 2], data[at + 3] & 0xF0)
    if key not in _KNOWN:
        a, b, _ = key
        fine = a >= 0xE0 and (a >> 3) & 3 != 1 and (a >> 1) & 3 != 0 and b >> 4 != 15 and (b >> 2) & 3 != 3
        _KNOWN[key] = _Header(*key) if fine else None
    return _KNOWN[key]


def _syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def _decoded(body: bytes) -> str:
    kind, raw = body[:1], body[1:]
    name = {b"\0": "latin-1", b"\1": "utf-16", b"\2": "utf-16-be", b"\3": "utf-8"}.get(kind, "latin-1")
    return raw.decode(name, "replace").split("\0")[0].strip()


def id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Length of the tag at a place, 0 if there is none; its text frames go into tags."""
    if data[at : at + 3] != b"ID3" or at + 10 > len(data) or data[at + 3] not in (2, 3, 4):
        return 0
    version, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    body = data[at + 10 : at + 10 + size]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    p = 0
    if flags & 0x40 and version > 2 and len(body) >= 4:
        p = _syncsafe(body[:4]) if version == 4 else struct.unpack(">I", body[:4])[0] + 4
    names, head = ({b"TT2": "title", b"TP1": "artist"}, 6) if version == 2 else ({b"TIT2": "title", b"TPE1": "artist"}, 10)
    wide = 3 if version == 2 else 4
    while p + head <= len(body) and body[p]:
        raw = body[p + wide : p + 2 * wide]
        n = _syncsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        name = names.get(body[p : p + wide])
        if name and n:
            tags.setdefault(name, _decoded(body[p + head : p + head + n]))
        p += head + n
    return 10 + size + (10 if flags & 0x10 and version == 4 else 0)


def _vbr_table(frame: bytes, h: _Header) -> dict | None:
    """The Xing, Info or VBRI table in a first frame."""
    for at in {4 + h.side, 6 + h.side} if h.layer == 3 else ():
        if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, p = struct.unpack(">I", frame[at + 4 : at + 8])[0], at + 8
            out = {"kind": frame[at : at + 4].decode(), "frames": None, "bytes": None, "seek": None, "trim": 0}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    if len(frame) >= p + 4:
                        out[name] = struct.unpack(">I", frame[p : p + 4])[0]
                    p += 4
            if flags & 4:
                if len(frame) >= p + 100 and out["bytes"] is not None:
                    out["seek"] = [x * out["bytes"] // 256 for x in frame[p : p + 100]]
                p += 100
            p += 4 * (flags >> 3 & 1)
            if frame[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and len(frame) >= p + 24:
                gap = int.from_bytes(frame[p + 21 : p + 24], "big")
                out["trim"] = (gap >> 12) + (gap & 0xFFF)
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        out = {"kind": "VBRI", "frames": struct.unpack(">I", frame[50:54])[0], "bytes": struct.unpack(">I", frame[46:50])[0], "seek": None, "trim": 0}
        if len(frame) >= 62:
            n, scale, wide, _ = struct.unpack(">HHHH", frame[54:62])
            if 1 <= wide <= 4 and len(frame) >= 62 + n * wide:
                steps = [int.from_bytes(frame[62 + i * wide : 62 + (i + 1) * wide], "big") * scale for i in range(n)]
                out["seek"] = list(itertools.accumulate(steps))
        return out
    return None


FIELDS = (
    "version string, layer int, sample_rate int, channels int, n_frames long, samples long, seconds decimal(20,9), mean_kbps double, vbr boolean, vbr_table string, "
    "declared_frames long, declared_bytes long, seek_table array<long>, crc_ok long, crc_bad long, skipped_bytes long, resyncs long, title string, artist string, offsets array<long>"
)
NAMES = [f.split()[0] for f in FIELDS.split(", ") if f]


def parse(data: bytes | None) -> dict | None:
    """Everything about a stream; None for a null, and no frames where there are none."""
    if data is None:
        return None
    tags: dict[str, str] = {}
    at = 0
    while n := id3v2(data, at, tags):
        at += n
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, s in (("title", slice(3, 33)), ("artist", slice(33, 63))):
            text = data[end:][s].split(b"\0")[0].decode("latin-1").strip()
            if text:
                tags.setdefault(name, text)
    kind, table, offsets, kbps = None, None, [], []
    samples = ok = bad = skipped = resyncs = 0
    first, lost, free = None, False, None
    while at + 4 <= end:
        h = header(data, at)
        good = h is not None and (kind is None or h.kind == kind)
        size = h.size if good else 0
        if good and not h.kbps:
            free = free or _free_size(data, at, h, end)
            good, size = free is not None, (free or 0) + h.pad
        good = good and at + size <= end
        if good:
            follow = header(data, at + size)
            at_end = at + size == end or (offsets and at + size + 4 > end)
            good = at_end or (follow is not None and follow.kind == h.kind) or (bool(offsets) and not lost)
        if not good:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped += nxt - at
            lost = True
            at = nxt
            continue
        resyncs += lost and bool(offsets)
        lost = False
        fits = _checked(data, at, h, size)
        if fits is not None:
            ok, bad = ok + fits, bad + (not fits)
        if kind is None:
            kind, first = h.kind, h
            table = _vbr_table(data[at : at + size], h)
            if table:
                at += size
                continue
        offsets.append(at)
        kbps.append(h.kbps or (free * h.rate / (12000 * 4) if h.layer == 1 else free * h.rate / (h.samples * 125)))
        samples += h.samples
        at += size
    skipped += max(0, end - at)
    trim = table["trim"] if table else 0
    out = dict.fromkeys(NAMES)
    out |= {"n_frames": len(offsets), "samples": max(0, samples - trim), "crc_ok": ok, "crc_bad": bad, "skipped_bytes": skipped, "resyncs": resyncs, "offsets": offsets, "title": tags.get("title"), "artist": tags.get("artist")}
    if first is not None:
        out |= {"version": first.version, "layer": first.layer, "sample_rate": first.rate, "channels": first.channels, "vbr": len(set(kbps)) > 1, "mean_kbps": sum(kbps) / len(kbps) if kbps else None, "vbr_table": table and table["kind"], "declared_frames": table and table["frames"], "declared_bytes": table and table["bytes"], "seek_table": table and table["seek"]}
    return out


def audio_index(media: DataFrame, key: str = "page_id", audio: str = "audio") -> DataFrame:
    """The key of each row and what parse() finds in its audio (see FIELDS), one row for each.

    `samples` over `sample_rate` is the exact duration, without the table frame and the encoder's
    padding; `seconds` is it to nine places. seek_table: the places that the table names, in bytes from its
    frame on (Xing, for each percent of the time) or from behind it (VBRI, for each of its steps). Frames
    of another version, layer or rate than the first count as junk. Checksums are verified for all layers,
    but for layer 2 in free format, whose allocation the header doesn't tell. Free-format frames of up to
    16 KiB are found. A null stream has nulls throughout, an empty one or one without a frame has 0 frames. Repeated rows and null keys give rows of their own; other
    columns are not looked at. Empty tables: no rows.
    """
    narrow = [n for n in NAMES if n != "seconds"]
    schema = ", ".join(f"{f}" for f in FIELDS.replace("seconds decimal(20,9), ", "").split(", "))
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    types = {f.split()[0]: kinds[f.split()[1]] for f in schema.split(", ")}

    def index(batches):
        for batch in batches:
            found = [parse(x) or dict.fromkeys(NAMES) for x in batch.column("audio").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array([f[n] for f in found], types[n]) for n in narrow)], ["key", *narrow])

    out = media.select(F.col(key).cast("long").alias("key"), F.col(audio).alias("audio")).mapInArrow(index, f"key long, {schema}")
    seconds = (F.col("samples").cast("decimal(20,0)") / F.col("sample_rate").cast("decimal(10,0)")).cast("decimal(20,9)")
    return out.withColumn("seconds", seconds).select(F.col("key").alias(key), *NAMES)


def encode(body: bytes, seed: int, title: str = "") -> tuple[bytes, dict]:
    """A stream that carries body in its frames, and what parse() must find. The seed decides on
    version, layer 3 mode, rates, checksums, tags, tables, junk and damage."""
    rnd = int.from_bytes(hashlib.blake2b(seed.to_bytes(8, "big", signed=True), digest_size=16).digest(), "big")

    def draw(n: int) -> int:
        nonlocal rnd
        rnd, x = divmod(rnd, n)
        return x

    v, r, mono, protect, vbr = (3, 2, 0)[draw(3)], draw(3), draw(2), draw(2), draw(2)
    base, tagged, table, old, junk, damage, gap = 5 + draw(5), draw(2), draw(3), draw(2), draw(4), draw(4), draw(2)
    out, offsets, kbps, truth = bytearray(), [], [], {"crc_ok": 0, "crc_bad": 0, "skipped_bytes": 0, "resyncs": 0}
    if tagged:
        text = b"\x03" + title.encode("utf-8", "replace")
        frame = b"TIT2" + bytes([len(text) >> 21 & 127, len(text) >> 14 & 127, len(text) >> 7 & 127, len(text) & 127]) + b"\0\0" + text
        n = len(frame) + 16
        out += b"ID3\x04\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + frame + bytes(16)

    def frame(rate: int, payload: bytes, pad: int = 0) -> tuple[bytes, _Header, int]:
        head = bytes([0xFF, 0xE0 | v << 3 | 1 << 1 | (not protect), rate << 4 | r << 2 | pad << 1, mono * 0xC0])
        h = header(head, 0)
        lead = 4 + 2 * protect
        room = h.size - lead - h.side
        side = hashlib.shake_128(payload[:64]).digest(h.side).replace(b"\xff", b"\0")
        check = crc16(head[2:] + side).to_bytes(2, "big") if protect else b""
        return head + check + side + payload[:room].ljust(room, b"\0"), h, room

    trim = 0
    if table:
        raw, h, _ = frame(9, b"")
        n_at = 4 + 2 * protect + h.side
        trim = 576 + 700 if gap and table == 1 else 0
    table_at = len(out)
    if table:
        out += raw
        truth["crc_ok"] += protect
    at = n = 0
    first = None
    while at < len(body) or not offsets:
        raw, h, room = frame(1 + (base + n * 7) % 12 if vbr else base, body[at : at + room_of(body, at)], n % 3 == 1)
        first = first or h
        if junk == 1 and n and n % 5 == 0:
            waste = b"junk\xff\xfbno frame\xff\xff" * (1 + n % 3)
            out += waste
            truth["skipped_bytes"] += len(waste)
            truth["resyncs"] += 1
        if damage == 1 and protect and n % 4 == 2:
            raw = raw[:4] + bytes([raw[4] ^ 0x55]) + raw[5:]
            truth["crc_bad"] += 1
        else:
            truth["crc_ok"] += protect
        offsets.append(len(out))
        kbps.append(h.kbps)
        out += raw
        at += room
        n += 1
    declared = len(out) - table_at if table == 1 else len(out)
    if table:
        kind = {1: b"Xing" if vbr else b"Info", 2: b"VBRI"}[table]
        if table == 1:
            seek = [n_at * 3 % 256 if i else 0 for i in range(100)] if gap else None
            fill = kind + struct.pack(">II", 7 if seek else 1, n) + (struct.pack(">I", len(out) - table_at) + bytes(seek) if seek else b"") + (b"LAME3.100" + bytes(12) + (576 << 12 | 700).to_bytes(3, "big") if trim else b"")
            spot = table_at + n_at
        else:
            seek = [len(r) for r in (body[:3], body[:7])] if gap else []
            fill, spot = kind + struct.pack(">HHHIIHHHH", 1, 0, 50, len(out), n, len(seek), 4, 2, 1) + b"".join(x.to_bytes(2, "big") for x in seek), table_at + 36
        whole = bytearray(out[table_at : table_at + raw_size(out, table_at)])
        whole[spot - table_at : spot - table_at + len(fill)] = fill
        if protect:  # the table may lie in what the checksum covers
            h = header(bytes(whole), 0)
            whole[4:6] = crc16(bytes(whole[2:4] + whole[6 : 6 + h.side])).to_bytes(2, "big")
        out[table_at : table_at + len(whole)] = whole
    if old:
        out += b"TAG" + title.encode("latin-1", "replace")[:30].ljust(30, b"\0") + bytes(95)
    truth |= {"offsets": offsets, "n_frames": n, "samples": max(0, n * first.samples - trim), "sample_rate": first.rate, "channels": first.channels, "version": first.version, "layer": 3, "vbr": len(set(kbps)) > 1, "vbr_table": {0: None, 1: "Xing" if vbr else "Info", 2: "VBRI"}[table], "declared_frames": n if table else None}
    truth["declared_bytes"] = None if not table else declared if table == 2 or seek else None
    truth["seek_table"] = None if not table or (table == 1 and not seek) else [x * declared // 256 for x in seek] if table == 1 else list(itertools.accumulate(x * 4 for x in seek))
    return bytes(out), truth


def room_of(body: bytes, at: int) -> int:
    """More bytes than any frame holds."""
    return min(len(body) - at, 4096)


def raw_size(out: bytes, at: int) -> int:
    return header(bytes(out[at : at + 4]), 0).size


def with_audio(pages: DataFrame, key: Column, body: Column, title: Column) -> DataFrame:
    """pages and an audio column that is made of their own bytes."""

    def make(batches):
        for batch in batches:
            got = [encode((b or "").encode("utf-8", "replace"), i or 0, t or "")[0] for i, b, t in zip(*(batch.column(c).to_pylist() for c in ("page_id", "body", "title")))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(got, pa.binary())], ["page_id", "audio"])

    return pages.select(key.cast("long").alias("page_id"), body.alias("body"), title.alias("title")).mapInArrow(make, "page_id long, audio binary")
