"""Files of several frames, colour, inverted grey, odd bits and lossless JPEG, pixel by pixel."""

import struct

import numpy as np
import pytest

from tubula.sources import jpeg, volumes

RNG = np.random.default_rng(5)


def element(group, number, kind, value):
    value += b"\0" * (len(value) % 2)
    return struct.pack("<HH", group, number) + kind + (struct.pack("<HI", 0, len(value)) if kind in (b"OW", b"OB", b"SQ") else struct.pack("<H", len(value))) + value


def item(*parts):
    body = b"".join(parts)
    return struct.pack("<HHI", 0xFFFE, 0xE000, len(body)) + body


def dicom(h, w, pixels, *, bits=16, stored=None, signed=0, per=1, kind="MONOCHROME2", n=1, planes=0, syntax="1.2.840.10008.1.2.1", more=(), fragments=None):
    us = lambda v: struct.pack("<H", v)
    parts = [(2, 0x10, b"UI", syntax.encode()), (0x18, 0x88, b"DS", b"2"), *more, (0x28, 2, b"US", us(per)), (0x28, 4, b"CS", kind.encode()), (0x28, 6, b"US", us(planes)), (0x28, 8, b"IS", str(n).encode()), (0x28, 0x10, b"US", us(h)), (0x28, 0x11, b"US", us(w)),
             (0x28, 0x100, b"US", us(bits)), (0x28, 0x101, b"US", us(stored or bits)), (0x28, 0x103, b"US", us(signed))]
    out = b"\0" * 128 + b"DICM" + b"".join(element(*p) for p in parts)
    if fragments is None:
        return out + element(0x7FE0, 0x10, b"OW", pixels)
    even = [f + b"\0" * (len(f) % 2) for f in fragments]
    return out + struct.pack("<HH", 0x7FE0, 0x10) + b"OB" + struct.pack("<HI", 0, 0xFFFFFFFF) + item() + b"".join(map(item, even)) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)


def lossless(image, predictor, bits=16, restart=0):
    """A plain encoder: each difference by a code of five bits for its size, then its bits."""
    h, w, n = image.shape
    out, held, have = bytearray(), 0, 0

    def put(value, size):
        nonlocal held, have
        held, have = held << size | value, have + size
        while have >= 8:
            byte = held >> (have - 8) & 255
            out.extend((byte, 0) if byte == 255 else (byte,))
            have -= 8
            held &= (1 << have) - 1

    def flush():
        if have:
            put((1 << (8 - have)) - 1, 8 - have)

    x = image.astype(int)
    for i in range(h):
        if restart and i and i % restart == 0:
            flush()
            out.extend((0xFF, 0xD0 + (i // restart - 1) % 8))
        first = i % restart == 0 if restart else i == 0
        for j in range(w):
            for k in range(n):
                a, b, c = (x[i, j - 1, k] if j else 0), (x[i - 1, j, k] if i else 0), (x[i - 1, j - 1, k] if i and j else 0)
                p = (1 << (bits - 1) if not j else a) if first else b if not j else (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[predictor - 1]
                d = int(x[i, j, k] - p + 32768) % 65536 - 32768
                d = 32768 if d == -32768 else d
                size = abs(d).bit_length()
                put(size, 5)
                if 0 < size < 16:
                    put(d if d > 0 else d + (1 << size) - 1, size)
    flush()
    segment = lambda mark, body: bytes((0xFF, mark)) + struct.pack(">H", len(body) + 2) + body
    table = bytes([0, *[0] * 4, 17, *[0] * 11, *range(17)])
    frame = struct.pack(">BHHB", bits, h, w, n) + b"".join(bytes((k + 1, 0x11, 0)) for k in range(n))
    scan = bytes([n, *(v for k in range(n) for v in (k + 1, 0)), predictor, 0, 0])
    again = segment(0xDD, struct.pack(">H", restart * w)) if restart else b""
    return b"\xff\xd8" + segment(0xC3, frame) + segment(0xC4, table) + again + segment(0xDA, scan) + bytes(out) + b"\xff\xd9"


@pytest.mark.parametrize("predictor", range(1, 8))
def test_lossless_jpeg(predictor):
    for bits, n, restart in ((16, 1, 0), (12, 1, 3), (8, 3, 0), (16, 1, 4)):
        image = RNG.integers(0, 1 << bits, (9, 7, n))
        image[2:5] = image[2:5] // 50 + 7  # smooth parts too
        assert (jpeg.lossless(lossless(image, predictor, bits, restart)) == image).all()


def test_jpeg_frames_of_a_file(spark, tmp_path):
    cube = RNG.integers(0, 4096, (3, 6, 5, 1))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.dcm").write_bytes(dicom(6, 5, None, stored=12, n=3, syntax="1.2.840.10008.1.2.4.70", fragments=[lossless(f, 1, 12) for f in cube]))
    got = {(r.z, r.y, r.x): r.v for r in volumes.voxels(volumes.slices(spark, str(tmp_path / "s")), "s").collect()}
    assert got == {(z, y, x): float(cube[z, y, x, 0]) for z, y, x in np.ndindex(cube.shape[:3])}


def test_one_frame_of_several_fragments():
    image = RNG.integers(0, 65536, (8, 8, 1))
    whole = lossless(image, 4)
    (got,) = volumes.dicom(dicom(8, 8, None, syntax="1.2.840.10008.1.2.4.57", fragments=[whole[:50], whole[50:120], whole[120:]]))
    assert (got["pix"] == image.reshape(-1)).all()


def test_frames_are_slices_by_their_place(spark, tmp_path):
    cube = RNG.integers(0, 60000, (4, 3, 5)).astype("<u2")
    group = lambda z: item(element(0x20, 0x9113, b"SQ", item(element(0x20, 0x32, b"DS", f"0\\0\\{z}".encode()))), element(0x28, 0x9110, b"SQ", item(element(0x28, 0x30, b"DS", b"0.5\\0.25"))))
    more = [(0x5200, 0x9230, b"SQ", b"".join(map(group, (3, 1, 2, 0))))]
    data = dicom(3, 5, cube.tobytes(), n=4)
    assert [r["at"] for r in volumes.dicom(data)] == [0, 2, 4, 6] and all((r["pix"] == c.reshape(-1)).all() for r, c in zip(volumes.dicom(data), cube, strict=True))
    rows = volumes.dicom(dicom(3, 5, cube.tobytes(), n=4, more=more))
    assert [r["at"] for r in rows] == [3, 1, 2, 0] and {(r["sx"], r["sy"], r["sz"], r["plane"]) for r in rows} == {(0.25, 0.5, 2.0, "AXIAL")}


def test_colour_and_inverted_grey():
    rgb = RNG.integers(0, 256, (4, 5, 3)).astype(np.uint8)
    for planes, raw in ((0, rgb), (1, rgb.transpose(2, 0, 1))):
        (got,) = volumes.dicom(dicom(4, 5, raw.tobytes(), bits=8, per=3, kind="RGB", planes=planes))
        assert np.allclose(got["pix"], rgb.reshape(-1, 3).mean(axis=1))
    grey = RNG.integers(0, 4096, (4, 5)).astype("<u2")
    (got,) = volumes.dicom(dicom(4, 5, grey.tobytes(), stored=12, kind="MONOCHROME1"))
    assert (got["pix"] == 4095 - grey.reshape(-1).astype(int)).all()
    signed = RNG.integers(-2048, 2048, (4, 5))
    (got,) = volumes.dicom(dicom(4, 5, (signed & 0x0FFF | 0x3000).astype("<u2").tobytes(), stored=12, signed=1))  # bits above are no part of it
    assert (got["pix"] == signed.reshape(-1)).all()


@pytest.mark.parametrize("bad", [{"kind": "PALETTE COLOR"}, {"kind": "YBR_FULL", "per": 3}, {"n": 3}, {"per": 3}])
def test_what_cannot_be_read_is_refused(bad):
    with pytest.raises(ValueError):
        volumes.dicom(dicom(4, 5, b"\0" * 40, **bad))


def tiff(w, h, raw, bits, more=(), strips=1):
    told = dict([(256, w), (257, h), (258, bits), (259, 1), (262, 1), (277, 1), *more])
    text = told.pop(270, None)
    head = 8 + len(raw)
    entries = [(k, 3, 1, struct.pack("<HH", v, 0)) for k, v in told.items()] + [(273, 4, 1, struct.pack("<I", 8)), (279, 4, 1, struct.pack("<I", len(raw) // strips))]
    if text:
        entries.append((270, 2, len(text), struct.pack("<I", head)))
        raw += text
        head += len(text)
    body = b"".join(struct.pack("<HHI", k, kind, n) + v for k, kind, n, v in sorted(entries))
    return b"II" + struct.pack("<HI", 42, head) + raw + struct.pack("<H", len(entries)) + body + struct.pack("<I", 0)


def test_tiff_bits_colour_and_images_that_follow():
    v = RNG.integers(0, 4096, 15)
    bits = "".join(f"{n:012b}" for n in v) + "0000"
    raw = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    (got,) = volumes.tiff(tiff(5, 3, raw, 12))
    assert (got["pix"] == v).all()
    rgb = RNG.integers(0, 256, (3, 5, 3)).astype(np.uint8)
    (got,) = volumes.tiff(tiff(5, 3, rgb.tobytes(), 8, [(262, 2), (277, 3)]))
    assert np.allclose(got["pix"], rgb.reshape(-1, 3).mean(axis=1))
    grey = RNG.integers(0, 256, (3, 5)).astype(np.uint8)
    (got,) = volumes.tiff(tiff(5, 3, grey.tobytes(), 8, [(262, 0)]))
    assert (got["pix"] == 255 - grey.reshape(-1).astype(int)).all()
    cube = RNG.integers(0, 60000, (4, 3, 5)).astype("<u2")
    got = volumes.tiff(tiff(5, 3, cube.tobytes(), 16, [(270, b"Some=1\nimages=4\nslices=4\n")], strips=4))
    assert [r["at"] for r in got] == [0, 1, 2, 3] and all((r["pix"] == c.reshape(-1)).all() for r, c in zip(got, cube, strict=True))
    with pytest.raises(ValueError):
        volumes.tiff(tiff(5, 3, grey.tobytes(), 8, [(262, 3)]))
