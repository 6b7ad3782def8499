"""Frame places of MPEG audio against a plain scan of the bytes."""

import random

from chronotext.sources import mpeg

KBPS = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]


def frame(kbps=128, pad=0, rate=0, body=b""):
    hz = (44100, 48000, 32000)[rate]
    n = 144000 * kbps // hz + pad
    head = bytes([0xFF, 0xFB, KBPS.index(kbps) << 4 | rate << 2 | pad << 1, 0])
    return (head + body).ljust(n, b"\0")


def tag(n):
    return b"ID3\x04\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + b"\xff\xfb\x90\0" * (n // 4) + b"\0" * (n % 4)


def plain_header(b, i):
    if i + 4 > len(b) or b[i] != 0xFF or b[i + 1] < 0xE0:
        return None
    version, layer, k, r = b[i + 1] >> 3 & 3, b[i + 1] >> 1 & 3, b[i + 2] >> 4, b[i + 2] >> 2 & 3
    if version == 1 or layer == 0 or k in (0, 15) or r == 3:
        return None
    kind = 1 if version == 3 else 2
    row = 4 - layer
    kbps = mpeg.fixed.MPEG_KBPS[kind, row if kind == 1 or row == 1 else 2][k]
    hz, pad = mpeg.fixed.MPEG_RATES[version][r], b[i + 2] >> 1 & 1
    if row == 1:
        return (12000 * kbps // hz + pad) * 4, 384, hz
    if row == 2 or kind == 1:
        return 144000 * kbps // hz + pad, 1152, hz
    return 72000 * kbps // hz + pad, 576, hz


def plain_scan(b):
    i = start = min(mpeg.audio_start(b), len(b))
    out, covered, kind, synced, info = [], 0, None, False, False
    while i < len(b) - 4:
        f = plain_header(b, i)
        if f and f[0] > 4 and (synced or i + f[0] >= len(b) - 4 or plain_header(b, i + f[0])):
            synced = True
            if kind is None:
                kind, info = f[1:], any(m in b[i : i + min(f[0], 64)] for m in (b"Xing", b"Info", b"VBRI"))
            if f[1:] == kind:
                out.append(i)
                covered += f[0]
            i += f[0]
        else:
            synced, i = False, i + 1
            if not out and i - start > 1 << 20:
                return []
    return out[info:] if len(out) >= 50 and covered >= 0.8 * (len(b) - start) else []


def cases():
    draw = random.Random(3)
    plain = b"".join(frame(draw.choice([64, 128, 320]), draw.randint(0, 1)) for _ in range(120))
    junk = b"".join(frame(draw.choice([64, 128])) + (bytes(draw.choices([0, 255, 251, 144], k=draw.randint(1, 9))) if draw.random() < 0.1 else b"") for _ in range(200))
    other = b"".join(frame(128, 0, draw.choice([0, 0, 0, 0, 0, 1])) for _ in range(150))
    return {
        "plain": plain, "tagged": tag(5001) + plain, "junk": junk, "kinds": other, "info": frame(128, 0, 0, b"\0" * 32 + b"Xing") + plain,
        "few": frame() * 20, "noise": bytes(draw.choices(range(256), k=40000)), "gap": plain[:20000] + b"\0" * 30000 + plain[:3000], "empty": b"", "short": b"\xff\xfb", "cut": plain[:-5],
        "late": b"\0" * ((1 << 20) + 5) + plain,
    }


def test_frames_are_those_of_a_plain_scan(spark):
    files = cases()
    windows = mpeg.cut_windows(spark.createDataFrame(list(files.items()), "path string, content binary"))
    got = {}
    for r in mpeg.frame_index(windows).orderBy("path", "frame").collect():
        assert r["frame"] == len(got.setdefault(r["path"], []))
        got[r["path"]].append(r["place"])
    assert got == {k: v for k, b in files.items() if (v := plain_scan(b))}
    assert {"plain", "tagged", "junk", "kinds", "info", "cut"} <= set(got)


def test_a_file_over_several_windows_is_read_piece_by_piece(spark, tmp_path):
    draw = random.Random(4)
    data = tag(700) + b"".join(frame(draw.choice([128, 320]), draw.randint(0, 1)) for _ in range(13000))
    assert len(data) > 2 * mpeg.WINDOW
    (tmp_path / "long.mp3").write_bytes(data)
    (tmp_path / "none.mp3").write_bytes(b"")
    windows = mpeg.read_windows(spark, str(tmp_path))
    places = [r["place"] for r in mpeg.frame_index(windows).orderBy("frame").collect()]
    assert places == plain_scan(data)
