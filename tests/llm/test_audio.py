import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.llm import audio, queries

MPEG1 = bytes([0xFF, 0xFB, 0x90, 0x00])  # layer 3, 128 kbit/s, 44.1 kHz, stereo, no checksum: 417 bytes


def frames(n, head=MPEG1):
    size = audio.header(head, 0).size
    return b"".join(head + bytes(size - 4) for _ in range(n))


def test_encoded_streams_are_read_back():
    rnd = random.Random(7)
    kinds = set()
    for seed in range(400):
        data, truth = audio.encode(bytes(rnd.randrange(255) for _ in range(rnd.choice([0, 1, 700, 6000]))), seed, f"title {seed}")
        got = audio.parse(data)
        assert {k: got[k] for k in truth} == truth
        kinds.add((truth["version"], truth["vbr_table"], truth["crc_bad"] > 0, truth["resyncs"] > 0))
    assert len(kinds) > 20


def test_known_headers():
    h = audio.header(MPEG1, 0)
    assert (h.size, h.samples, h.rate, h.kbps, h.channels, h.side) == (417, 1152, 44100, 128, 2, 32)
    assert audio.header(bytes([0xFF, 0xFB, 0x92, 0xC0]), 0).size == 418
    low = audio.header(bytes([0xFF, 0xF3, 0x80, 0xC0]), 0)
    assert (low.version, low.samples, low.rate, low.kbps, low.size, low.side) == ("2", 576, 22050, 64, 208, 9)
    first = audio.header(bytes([0xFF, 0xFF, 0x80, 0x00]), 0)
    assert (first.layer, first.samples, first.kbps, first.size) == (1, 384, 256, 276)
    for bad in (b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xff\xeb\x90\x00", b"\xff\xf9\x90\x00"[:3], b"\xfe\xfb\x90\x00"):
        assert audio.header(bad, 0) is None


def test_checksum_is_the_standard_one():
    assert audio.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS


def test_resync_after_junk_cut_frames_and_false_sync_words():
    data = b"\xff\xfb\x90junk" + frames(3) + b"\xff\xfb\x90\x00 no frame" + frames(2) + frames(1)[:100] + frames(2)
    got = audio.parse(data)
    assert got["n_frames"] == 7 and got["samples"] == 7 * 1152 and got["offsets"][0] == 7
    assert all(data[o : o + 4] == MPEG1 for o in got["offsets"])
    assert got["skipped_bytes"] + 7 * 417 == len(data)


def test_tags_of_all_versions():
    def v2(version, frame_id, text, size):
        body = b"\x00" + text
        head = frame_id + (len(body).to_bytes(3, "big") if version == 2 else len(body).to_bytes(4, "big") + b"\0\0") + body
        return b"ID3" + bytes([version, 0, 0, 0, 0, 0, len(head)]) + head

    for version, name in ((2, b"TT2"), (3, b"TIT2"), (4, b"TIT2")):
        got = audio.parse(v2(version, name, b"Song", 0) + frames(2))
        assert got["title"] == "Song" and got["n_frames"] == 2 and got["skipped_bytes"] == 0
    utf16 = b"\x01" + "Tïtle".encode("utf-16")
    tag = b"TIT2" + len(utf16).to_bytes(4, "big") + b"\0\0" + utf16
    assert audio.parse(b"ID3\x03\0\0\0\0\0" + bytes([len(tag)]) + tag + frames(1))["title"] == "Tïtle"
    old = b"TAG" + b"Old".ljust(30, b"\0") + b"Who".ljust(30, b"\0") + bytes(65)
    got = audio.parse(frames(2) + old)
    assert (got["title"], got["artist"], got["n_frames"], got["skipped_bytes"]) == ("Old", "Who", 2, 0)


def test_gapless_duration_is_exact(spark):
    table = bytearray(frames(1))
    table[36:44] = b"Info" + (1).to_bytes(4, "big")
    table[44:48] = (4).to_bytes(4, "big")
    table[48:57] = b"LAME3.100"
    table[69:72] = (576 << 12 | 1000).to_bytes(3, "big")
    df = spark.createDataFrame([(1, bytes(table) + frames(4))], "page_id long, audio binary")
    r = audio.audio_index(df).first()
    assert (r.vbr_table, r.declared_frames, r.n_frames, r.samples) == ("Info", 4, 4, 4 * 1152 - 1576)
    assert r.seconds == (Decimal(3032) / Decimal(44100)).quantize(Decimal("1e-9"))


def test_odd_rows(spark):
    rows = [(1, None), (2, b""), (3, b"\xff" * 5000), (None, frames(1)), (4, frames(1)), (4, frames(1)), (5, b"ID3\x04\0\0\x7f\x7f\x7f\x7fTIT2"), (6, b"text " * 100_000), (7, frames(1)[:-1])]
    df = spark.createDataFrame(rows, "page_id long, audio binary").withColumn("key", F.lit("clash")).withColumn("samples", F.lit(-1))
    got = audio.audio_index(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].n_frames is None and by[1].offsets is None
    assert [by[i].n_frames for i in (2, 3, 4, 5, 6, 7)] == [0, 0, 1, 0, 0, 0] and by[6].skipped_bytes == 500_000
    assert audio.audio_index(spark.createDataFrame([], "page_id long, audio binary")).count() == 0


@pytest.mark.parametrize("size", ["sf0.001"])
def test_query_agrees_with_the_encoder(spark, size):
    pages = spark.read.parquet(f"/root/testdata/{size}/pages.parquet")
    got = {r.page_id: r for r in audio.audio_index(audio.with_audio(pages, F.col("page_id"), F.col("html"), F.col("url"))).collect()}
    for p in pages.collect():
        _, truth = audio.encode(p.html.encode(), p.page_id, p.url)
        assert {k: got[p.page_id][k] for k in truth} == truth


def crc_of(bits: str) -> int:
    """The checksum by long division, bit by bit."""
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1) ^ (0x18005 if (crc >> 15 & 1) != int(b) else 0)
        crc &= 0xFFFF
    return crc


def layer2(rnd, index, rate, mode, extension, widths, low=False):
    """A frame of layer 2 with a random allocation, and how many bits its checksum covers."""
    head = bytes([0xFF, 0xF4 if low else 0xFC, index << 4 | rate << 2, mode << 6 | extension << 4])
    bound = len(widths) if mode != 1 else min(len(widths), 4 * (extension + 1))
    channels = 1 if mode == 3 else 2
    allocation, chosen = "", 0
    for sb, w in enumerate(widths):
        for _ in range(channels if sb < bound else 1):
            x = rnd.randrange(1 << w) if rnd.random() < 0.6 else 0
            allocation += format(x, f"0{w}b")
            chosen += (channels if sb >= bound else 1) * (x > 0)
    covered = allocation + "".join(rnd.choice("01") for _ in range(2 * chosen))
    crc = crc_of("".join(format(b, "08b") for b in head[2:]) + covered)
    size = audio.header(head, 0).size
    body = covered + "".join(rnd.choice("01") for _ in range(8 * (size - 6) - len(covered)))
    return head + crc.to_bytes(2, "big") + int(body, 2).to_bytes(size - 6, "big"), len(covered)


WIDE, NARROW, LOW = [4] * 11 + [3] * 12, [4] * 2, [4] * 4 + [3] * 7 + [2] * 19


@pytest.mark.parametrize("index, rate, mode, widths, low", [
    (10, 0, 0, WIDE + [2] * 7, False),  # 192 kbit/s stereo at 44.1 kHz
    (10, 1, 1, WIDE + [2] * 4, False),  # the same at 48 kHz, joint
    (8, 0, 2, WIDE + [2] * 4, False),  # 128 kbit/s, two channels
    (3, 0, 3, WIDE + [2] * 4, False),  # 56 kbit/s, one channel
    (2, 1, 3, NARROW + [3] * 6, False),  # 48 kbit/s, one channel at 48 kHz
    (4, 2, 1, NARROW + [3] * 10, False),  # 64 kbit/s joint at 32 kHz
    (12, 0, 1, LOW, True),  # 128 kbit/s at 22.05 kHz
])
def test_checksums_of_layer_2(index, rate, mode, widths, low):
    rnd = random.Random(index)
    for extension in range(4 if mode == 1 else 1):
        made = [layer2(rnd, index, rate, mode, extension, widths, low) for _ in range(6)]
        got = audio.parse(b"".join(f for f, _ in made))
        assert (got["layer"], got["n_frames"], got["crc_ok"], got["crc_bad"]) == (2, 6, 6, 0)
        frame, bits = made[2]
        for at, bad in ((48 + bits - 1, 1), (48 + bits, 0)):  # the last bit that counts, and the one after
            hurt = bytearray(frame)
            hurt[at // 8] ^= 0x80 >> at % 8
            got = audio.parse(made[0][0] + bytes(hurt) + made[1][0])
            assert (got["n_frames"], got["crc_bad"]) == (3, bad)


@pytest.mark.parametrize("head, size, pad", [(bytes([0xFF, 0xFB, 0x00, 0x00]), 500, 1), (bytes([0xFF, 0xFF, 0x04, 0xC0]), 400, 4)])
def test_free_format(head, size, pad):
    rnd = random.Random(1)
    data, offsets = bytearray(b"\xff\xfbxx"), []
    for i in range(9):
        offsets.append(len(data))
        padded = i % 3 == 1
        data += head[:2] + bytes([head[2] | 2 * padded]) + head[3:] + bytes(rnd.randrange(0x80) for _ in range(size + pad * padded - 4))
    got = audio.parse(bytes(data))
    rate = {0: 44100, 1: 48000}[head[2] >> 2 & 3]
    assert (got["offsets"], got["skipped_bytes"], got["samples"]) == (offsets, 4, 9 * (384 if pad == 4 else 1152))
    assert abs(got["mean_kbps"] - (size * rate / 48000 if pad == 4 else size * rate / 144000)) < 1e-9
    assert audio.parse(bytes([0xFF, 0xFB, 0x00, 0x00]) * 5000)["n_frames"] >= 0


def walk(data: bytes) -> dict:
    """Frames of a stream of layer 3 as bit strings, by another road: all headers first, then the chain."""
    kbps = {1: "32 40 48 56 64 80 96 112 128 160 192 224 256 320", 2: "8 16 24 32 40 48 56 64 80 96 112 128 144 160"}
    start = 0
    while data[start : start + 3] == b"ID3":
        size = int("".join(format(b, "08b")[1:] for b in data[start + 6 : start + 10]), 2)
        start += 10 + size
    end = len(data) - 128 if data[-128:-125] == b"TAG" and len(data) - start >= 128 else len(data)
    heads = {}
    for i in range(start, end - 3):
        b = format(int.from_bytes(data[i : i + 4], "big"), "032b")
        version, layer, index, rate = b[11:13], b[13:15], int(b[16:20], 2), int(b[20:22], 2)
        if b[:11] == "1" * 11 and version != "01" and layer == "01" and 0 < index < 15 and rate < 3:
            hertz = (44100, 48000, 32000)[rate] // {"11": 1, "10": 2, "00": 4}[version]
            k = int(kbps[1 if version == "11" else 2].split()[index - 1])
            heads[i] = ((version, hertz), (144 if version == "11" else 72) * 1000 * k // hertz + int(b[22]), b[15] == "0", b[24:26] == "11", k)
    found, at, kind, lost = [], start, None, False
    while at < end - 3:
        h = heads.get(at)
        fine = h and kind in (None, h[0]) and at + h[1] <= end
        if fine:
            nxt = heads.get(at + h[1])
            fine = at + h[1] == end or (found and at + h[1] + 4 > end) or (nxt and nxt[0] == h[0]) or (len(found) > bool(found and tabled(data, found[0])) and not lost)
        if fine:
            kind, lost = h[0], False
            found.append((at, *h))
            at += h[1]
        else:
            lost, at = True, at + 1
    checks = []
    for i, (version, _), size, protected, mono, _ in found:
        if protected:
            side = {("11", False): 32, ("11", True): 17}.get((version, mono), 9 if mono else 17)
            bits = "".join(format(b, "08b") for b in data[i + 2 : i + 4] + data[i + 6 : i + 6 + side])
            checks.append(crc_of(bits) == int.from_bytes(data[i + 4 : i + 6], "big"))
    if found and tabled(data, found[0]):
        found = found[1:]
    return {"offsets": [f[0] for f in found], "sample_rate": kind and kind[1], "crc_ok": sum(checks), "crc_bad": len(checks) - sum(checks), "vbr": len({f[5] for f in found}) > 1}


def tabled(data, frame):
    return any(mark in data[frame[0] : frame[0] + frame[2]][:48] for mark in (b"Xing", b"Info", b"VBRI"))


def test_query_equals_a_walk_by_hand(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    streams = {r.page_id: bytes(r.audio) for r in audio.with_audio(pages, F.col("page_id"), F.col("html"), F.col("url")).collect()}
    got = queries.op5_mpeg_audio(spark, small).collect()
    assert len(got) == len(streams)
    for r in got:
        want = walk(streams[r.page_id])
        assert {k: r[k] for k in want} == want, r.page_id
