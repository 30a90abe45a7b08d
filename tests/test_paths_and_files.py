import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tubula.functions import display
from tubula.operators import reform
from tubula.sources import volumes
from tubula.streaming import studies


def plain_frames(points):
    p = np.array(points, float)
    t = np.array([p[min(i + 1, len(p) - 1)] - p[max(i - 1, 0)] for i in range(len(p))])
    t /= np.linalg.norm(t, axis=1, keepdims=True)
    n = np.cross(t[0], (1, 0, 0) if abs(t[0][2]) > 0.9 else (0, 0, 1))
    out = [n / np.linalg.norm(n)]
    for a, b in zip(t, t[1:], strict=False):
        axis, n = np.cross(a, b), out[-1]
        if axis @ axis > 1e-8:
            axis, angle = axis / np.linalg.norm(axis), math.acos(max(-1, min(1, a @ b)))
            k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
            n = (np.eye(3) + math.sin(angle) * k + (1 - math.cos(angle)) * k @ k) @ n
        out.append(n / np.linalg.norm(n))
    return t, np.array(out)


def test_frames_are_carried_without_twist(spark):
    curves = {1: [(math.cos(i / 5), math.sin(i / 5), i / 9) for i in range(60)], 2: [(0, 0, i) for i in range(5)], 3: [(i, i * i / 7, 0) for i in range(12)]}
    rows = [(b, i, *map(float, p)) for b, c in curves.items() for i, p in enumerate(c)] + [(4, 0, 1.0, 1.0, 1.0)]
    got = reform.frames(spark.createDataFrame(rows, "branch_id int, i int, x double, y double, z double")).collect()
    assert len(got) == sum(map(len, curves.values()))
    want = {b: plain_frames(c) for b, c in curves.items()}
    for r in got:
        t, n = (w[r.i] for w in want[r.branch_id])
        assert np.allclose(r.tangent, t) and np.allclose(r.normal, n) and np.allclose(r.binormal, np.cross(t, n) / np.linalg.norm(np.cross(t, n)))


def test_resting_points_keep_the_frame(spark):
    rows = [(1, i, x, 0.0, 0.0) for i, x in enumerate((0.0, 1.0, 1.0, 1.0, 2.0))]
    got = sorted((r.i, r.tangent, r.normal) for r in reform.frames(spark.createDataFrame(rows, "branch_id int, i int, x double, y double, z double")).collect())
    assert [g[1] for g in got][2] is None and all(g[2] == got[0][2] for g in got)


def page(array, end):
    kind = {"u": 1, "i": 2, "f": 3}[array.dtype.kind]
    raw = array.astype(array.dtype.newbyteorder(end)).tobytes()
    tags = [(256, 4, array.shape[1]), (257, 4, array.shape[0]), (258, 3, array.dtype.itemsize * 8), (259, 3, 1), (273, 4, 8), (277, 3, 1), (279, 4, len(raw)), (339, 3, kind)]
    head = (b"II" if end == "<" else b"MM") + struct.pack(end + "HI", 42, 8 + len(raw))
    body = b"".join(struct.pack(end + "HHI", t, k, 1) + (struct.pack(end + "HH", v, 0) if k == 3 else struct.pack(end + "I", v)) for t, k, v in tags)
    return head + raw + struct.pack(end + "H", len(tags)) + body + struct.pack(end + "I", 0)


def element(group, number, kind, value, plain=False):
    value += (b"\0" if kind == b"UI" else b" ") if len(value) % 2 else b""
    head = struct.pack("<HH", group, number)
    if plain and group != 2:
        return head + struct.pack("<I", len(value)) + value
    return head + kind + (struct.pack("<HI", 0, len(value)) if kind in (b"OW", b"OB") else struct.pack("<H", len(value))) + value


def image(array, z, plain=False, syntax=None):
    us = lambda v: struct.pack("<H", v)
    syntax = syntax or ("1.2.840.10008.1.2" if plain else "1.2.840.10008.1.2.1")
    parts = [(2, 0x10, b"UI", syntax.encode()), (8, 0x60, b"CS", b"MR"), (0x18, 0x50, b"DS", b"1.5"), (0x20, 0x32, b"DS", f"0\\0\\{z}".encode()), (0x28, 0x10, b"US", us(array.shape[0])), (0x28, 0x11, b"US", us(array.shape[1])),
             (0x28, 0x30, b"DS", b"0.5\\0.4"), (0x28, 0x100, b"US", us(16)), (0x28, 0x103, b"US", us(1)), (0x28, 0x1052, b"DS", b"-10"), (0x28, 0x1053, b"DS", b"2"), (0x7FE0, 0x10, b"OW", array.astype("<i2").tobytes())]
    return b"\0" * 128 + b"DICM" + b"".join(element(*p, plain=plain) for p in parts)


def read(spark, where, **kw):
    rows = volumes.voxels(volumes.slices(spark, str(where)), **kw).collect()
    return {(r.z, r.y, r.x): r.v for r in rows}


def test_dicom_slices_lie_by_their_place(spark, tmp_path):
    a = np.arange(12, dtype=np.int16).reshape(3, 4) - 5
    (tmp_path / "a.dcm").write_bytes(image(a, 7.5))
    (tmp_path / "b.dcm").write_bytes(image(a + 100, -1.0, plain=True))
    got = read(spark, tmp_path)
    assert got == {(z, y, x): float((a[y, x] + (100 if z == 0 else 0)) * 2 - 10) for z in (0, 1) for y in range(3) for x in range(4)}
    head = volumes.slices(spark, str(tmp_path)).first()
    assert (head.sx, head.sy, head.sz, head.modality) == (0.4, 0.5, 1.5, "MR")


def packed(raw):
    """Run-length encoded: a run for equal neighbours, else bytes as they are."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = 1
        while n < 128 and at + n < len(raw) and raw[at + n] == raw[at]:
            n += 1
        out += bytes([257 - n, raw[at]]) if n > 1 else bytes([0, raw[at]])
        at += n
    return bytes(out)


def test_dicom_runs_sequences_and_deflation(spark, tmp_path):
    a = np.repeat(np.arange(6, dtype=np.int16), 4).reshape(4, 6) * 300 - 700
    plain = image(a, 2.0)
    # A sequence of unknown length, with an item of unknown length in it, before the rows
    item = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + element(8, 0x60, b"CS", b"XX") + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    nested = struct.pack("<HH", 8, 0x1140) + b"SQ\0\0" + struct.pack("<I", 0xFFFFFFFF) + item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    at = plain.index(struct.pack("<HH", 0x18, 0x50))
    for name, file in (("a", plain[:at] + nested + plain[at:]), ("b", None), ("c", None)):
        if name == "b":
            head = image(a, 2.0, syntax="1.2.840.10008.1.2.5")
            head = head[: head.index(struct.pack("<HH", 0x7FE0, 0x10))]
            raw = a.astype("<i2").tobytes()
            planes = [packed(raw[1::2]), packed(raw[0::2])]
            frame = struct.pack("<16I", 2, 64, 64 + len(planes[0]), *[0] * 13) + b"".join(planes)
            items = struct.pack("<HHI", 0xFFFE, 0xE000, 0) + struct.pack("<HHI", 0xFFFE, 0xE000, len(frame)) + frame + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
            file = head + struct.pack("<HH", 0x7FE0, 0x10) + b"OB\0\0" + struct.pack("<I", 0xFFFFFFFF) + items
        if name == "c":
            whole = image(a, 2.0, syntax="1.2.840.10008.1.2.1.99")
            at = whole.index(struct.pack("<HH", 8, 0x60))
            squeeze = zlib.compressobj(wbits=-15)
            file = whole[:at] + squeeze.compress(whole[at:]) + squeeze.flush()
        (got,) = volumes.dicom(file)
        assert np.array_equal(got["pix"].reshape(4, 6), a * 2.0 - 10) and got["modality"] == "MR" and got["plane"] == "AXIAL"


def test_planes_and_metadata(spark, tmp_path):
    assert volumes.orientation([1, 0, 0, 0, 0, -1], [5, 7, 9]) == ("CORONAL", 7) and volumes.orientation([0, 1, 0, 0, 0, -1], [5, 7, 9])[0] == "SAGITTAL"
    for z in range(3):
        (tmp_path / f"{z}.dcm").write_bytes(image(np.zeros((2, 4), np.int16), z * 1.5))
    (meta,) = volumes.studies(volumes.slices(spark, str(tmp_path)), "one").collect()
    assert (meta.study, meta.w, meta.h, meta.d, meta.sz, meta.plane, meta.kind) == ("one", 4, 2, 3, 1.5, "AXIAL", "raw")
    vox = spark.createDataFrame([(1, 0, 0, 0, 5.0, 0, 1), (1, 0, 0, 0, 6.0, 1, 0)], "study int, z int, y int, x int, v double, c int, t int")
    assert [r.v for r in volumes.chosen(vox, 1).collect()] == [6.0]
    volumes.save(volumes.from_table(vox), str(tmp_path / "saved"))
    assert spark.read.parquet(str(tmp_path / "saved")).count() == 2


@pytest.mark.parametrize("kind, end", [("u1", "<"), ("u2", ">"), ("f4", "<"), ("f8", ">")])
def test_tiff_slices(spark, tmp_path, kind, end):
    a = (np.arange(15).reshape(3, 5) * 3).astype(kind)
    (tmp_path / "s1.tif").write_bytes(page(a, end))
    assert read(spark, tmp_path / "s1.tif", study="one") == {(0, y, x): float(a[y, x]) for y in range(3) for x in range(5)}


def test_unreadable_files_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        volumes.tiff(b"no image at all")
    with pytest.raises(ValueError):
        volumes.dicom(image(np.zeros((2, 2), np.int16), 0, syntax="1.2.840.10008.1.2.4.50"))
    with pytest.raises(ValueError):
        volumes.slices(spark, str(tmp_path))
    with pytest.raises(ValueError):
        volumes.from_table(spark.range(1))


def test_colour_tables(spark, tmp_path):
    (tmp_path / "plain.lut").write_bytes(b"  1 2 3\r\n 4 5 6\r\nend of table")
    (tmp_path / "named.lut").write_bytes(b"Index\tRed\tGreen\tBlue\n7\t1\t2\t3\n8\t4\t5\t6\n")
    got = sorted(tuple(r) for r in volumes.lut(spark, str(tmp_path / "*.lut")).collect())
    assert got == [("named", 7, 1, 2, 3), ("named", 8, 4, 5, 6), ("plain", 0, 1, 2, 3), ("plain", 1, 4, 5, 6)]
    lut = spark.range(256).select(F.col("id").cast("int").alias("idx"), *(F.col("id").alias(c) for c in "rgb"))
    assert [r.r for r in display.coloured(spark.createDataFrame([(0.5,), (1.25,), (9.0,)], "br double"), lut).orderBy("br").collect()] == [0, 127, 255]


def test_batches_of_studies_and_decisions(spark, tmp_path):
    spark.createDataFrame([(1, 1, "NORMAL", 5), (1, 1, "SACCULAR", 9), (2, 4, "NORMAL", 1)], "branch_id int, first int, type string, at long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("branch_id int, first int, type string, at long").parquet(str(tmp_path / "in"))
    studies.each_batch(stream, lambda b: b.groupBy("branch_id").count(), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert sorted((r.branch_id, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 2), (2, 1)]
    q = studies.latest_decisions(stream).writeStream.format("memory").queryName("decisions").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("decisions").collect()) == [(1, 1, "SACCULAR"), (2, 4, "NORMAL")]


def test_ring_medians_take_the_upper_middle(spark):
    rays = spark.createDataFrame([(0, 0, 0, a, float(v)) for a, v in enumerate((4, 1, 3, 2))], "study int, branch_id int, i int, angle int, mm double")
    assert reform.ring_medians(rays, 4).first().median == 3.0
