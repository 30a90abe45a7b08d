"""Volumes from files: slices (DICOM and TIFF, plain, deflated or run-length encoded, DICOM as lossless JPEG too), colour tables, and
tables of voxels.

Every frame of a file is a slice. Colour pixels become the mean of their three samples; images whose least value is white are turned
over; of samples in more bits than they fill, the others are left out. What can't be read this way is refused."""

from __future__ import annotations

import re
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .jpeg import lossless

SLICE = "path string, at double, w int, h int, sx double, sy double, sz double, tilt double, modality string, plane string, turn array<double>, pix array<double>"
_LONG = (b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN", b"OD", b"OL", b"UC", b"UR")


def unpacked_bits(data: bytes) -> bytes:
    """Run-length encoded bytes: n from 0 to 127, then n + 1 bytes as they are; n from 129 to 255, then a byte 257 - n times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def samples(raw: bytes, count: int, bits: int, end: str = "<", form: str = "u"):
    """The first `count` samples of `bits` bits each; those of 12 bits are packed, highest bits first."""
    import numpy as np

    if bits == 12 and form == "u":
        b = np.frombuffer(raw, np.uint8, (count * 3 + 1) // 2).astype(np.int64)
        b = np.append(b, np.zeros(-len(b) % 3, np.int64)).reshape(-1, 3)
        return np.stack([b[:, 0] << 4 | b[:, 1] >> 4, (b[:, 1] & 15) << 8 | b[:, 2]], axis=1).reshape(-1)[:count]
    if bits not in (8, 16, 32) and not (form == "f" and bits == 64):
        raise ValueError(f"samples of {bits} bits cannot be read")
    return np.frombuffer(raw, np.dtype(f"{end}{form}{bits // 8}"), count)


def grey(values, pixels: int, n: int, planes: bool):
    """One value per pixel of n samples each, which come pixel by pixel or plane by plane."""
    if n == 1:
        return values.astype(float)
    if n != 3:
        raise ValueError(f"{n} samples per pixel cannot be read")
    return values.astype(float).reshape((3, pixels) if planes else (pixels, 3)).mean(axis=0 if planes else 1)


def tiff(data: bytes) -> list[dict]:
    """The slices of a TIFF file, plain, deflated or run-length encoded: its pages, or all images that one page says follow it."""
    import numpy as np

    end = {b"II": "<", b"MM": ">"}.get(data[:2])
    if end is None:
        raise ValueError("not a TIFF file")
    kinds = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d"}
    out, at = [], struct.unpack_from(end + "I", data, 4)[0]
    while at:
        tags, n = {}, struct.unpack_from(end + "H", data, at)[0]
        for k in range(n):
            tag, kind, count = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
            code = kinds.get(kind)
            if code is None:
                continue
            size = struct.calcsize("=" + code) * count
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(end + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(end + code * count, data, where)
        plain = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpacked_bits}.get(tags.get(259, (1,))[0])
        if plain is None or tags.get(317, (1,))[0] != 1 or 273 not in tags:
            raise ValueError("only plain, deflated or run-length encoded pages in strips can be read")
        w, h, bits, form, per, kind = tags[256][0], tags[257][0], tags.get(258, (1,))[0], tags.get(339, (1,))[0], tags.get(277, (1,))[0], tags.get(262, (1,))[0]
        if kind not in (0, 1, 2) or (kind == 2) != (per == 3) or form not in (1, 2, 3):
            raise ValueError("only grey and RGB pixels can be read")
        strips = [plain(data[o : o + c]) for o, c in zip(tags[273], tags.get(279, (len(data) - tags[273][0],)), strict=True)]
        if bits == 12 and len(strips) > 1 and w * per % 2:
            raise ValueError("lines of packed samples that end inside a byte cannot be read")
        after = struct.unpack_from(end + "I", data, at + 2 + 12 * n)[0]
        size = w * h * per * bits // 8
        told = re.search(rb"images=(\d+)", b"".join(tags.get(270, ())))
        many = int(told[1]) if told and not after and not out else 1
        raw = data[tags[273][0] : tags[273][0] + many * size] if many > 1 and plain is bytes else b"".join(strips)
        if len(raw) < many * size:
            raise ValueError("pixels are missing")
        for k in range(many):
            v = samples(raw[k * size :], w * h * per, bits, end, {1: "u", 2: "i", 3: "f"}[form])
            if kind == 0:
                v = (v.max(initial=0) if form == 3 else (1 << bits) - 1 if form == 1 else -1) - v.astype(float if form == 3 else np.int64)
            out.append({"at": float(len(out)), "w": w, "h": h, "pix": grey(v, w * h, per, tags.get(284, (1,))[0] == 2)})
        at = after
    return out


def orientation(rows: list[float], place: list[float]) -> tuple[str, float]:
    """The plane that the directions of a slice's rows and columns span, and how far along its normal the slice lies."""
    (a, b, c), (d, e, f) = rows[:3], rows[3:6]
    normal = (b * f - c * e, c * d - a * f, a * e - b * d)
    most = max(range(3), key=lambda k: abs(normal[k]))
    return ("SAGITTAL", "CORONAL", "AXIAL")[most], sum(n * p for n, p in zip(normal, place, strict=True)) * (1 if normal[most] >= 0 else -1)


#: Transfer syntaxes: whether elements come without their kind, how the rest of the file is read, and pixels.
SYNTAXES = {"1.2.840.10008.1.2": (True, None, None), "1.2.840.10008.1.2.1": (False, None, None), "1.2.840.10008.1.2.1.99": (False, "deflated", None), "1.2.840.10008.1.2.5": (False, None, "runs"),
            "1.2.840.10008.1.2.4.57": (False, None, "jpeg"), "1.2.840.10008.1.2.4.70": (False, None, "jpeg")}
_ITEM, _ITEM_END, _END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
_OPEN = 0xFFFFFFFF


def _head(data: bytes, at: int, plain: bool) -> tuple[tuple[int, int], int, int]:
    """Tag, length and first byte of the value of the element at `at`."""
    tag = struct.unpack_from("<HH", data, at)
    if tag[0] == 0xFFFE or plain and tag[0] != 2:
        return tag, struct.unpack_from("<I", data, at + 4)[0], at + 8
    if data[at + 4 : at + 6] in _LONG:
        return tag, struct.unpack_from("<I", data, at + 8)[0], at + 12
    return tag, struct.unpack_from("<H", data, at + 6)[0], at + 8


def _after(data: bytes, at: int, plain: bool) -> int:
    """The end of a sequence of unknown length whose first item is at `at`."""
    while True:
        tag, size, body = _head(data, at, plain)
        if tag == _END:
            return body
        if size != _OPEN:
            at = body + size
            continue
        at = body
        while (step := _head(data, at, plain))[0] != _ITEM_END:
            at = _after(data, step[2], plain) if step[1] == _OPEN else step[2] + step[1]
        at = step[2]


def _fragments(data: bytes, at: int) -> tuple[list[int], list[bytes]]:
    """The table of frames' places and the fragments of encapsulated pixels whose first item is at `at`."""
    parts = []
    while (step := _head(data, at, False))[0] == _ITEM:
        parts.append(data[step[2] : step[2] + step[1]])
        at = step[2] + step[1]
    return list(struct.unpack(f"<{len(parts[0]) // 4}I", parts[0])), parts[1:]


def _frames(table: list[int], parts: list[bytes], n: int) -> list[bytes]:
    """The bytes of n frames: by the table of places, or a fragment each, or all of one."""
    if len(parts) == n:
        return parts
    if n == 1:
        return [b"".join(parts)]
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + 8
    if len(table) != n:
        raise ValueError("fragments can't be told apart by frame")
    ends = [*table[1:], at]
    return [b"".join(p for p, s in zip(parts, starts, strict=True) if a <= s < b) for a, b in zip(table, ends, strict=True)]


def _runs(frame: bytes, pixels: int) -> bytes:
    """The bytes of a frame whose byte planes, the highest first, are run-length encoded."""
    import numpy as np

    n, *starts = struct.unpack_from("<16I", frame)
    starts = [*starts[:n], len(frame)]
    planes = [np.frombuffer(unpacked_bits(frame[a:b])[:pixels], np.uint8) for a, b in zip(starts, starts[1:], strict=False)]
    return np.stack(planes[::-1], axis=1).tobytes()


def _sequence(data: bytes, body: int, size: int, plain: bool) -> list[dict]:
    """The items of a sequence as {tag: bytes or list of items}."""
    out, end = [], len(data) if size == _OPEN else body + size
    at = body
    while at + 8 <= end:
        tag, length, first = _head(data, at, plain)
        if tag != _ITEM:
            break
        item, at, stop = {}, first, len(data) if length == _OPEN else first + length
        while at + 8 <= stop:
            key, n, value = _head(data, at, plain)
            if key == _ITEM_END:
                at = value
                break
            nested = n == _OPEN or data[at + 4 : at + 6] == b"SQ" or plain and data[value : value + 4] == b"\xfe\xff\x00\xe0"
            item[key] = _sequence(data, value, n, plain) if nested else data[value : value + n]
            at = _after(data, value, plain) if n == _OPEN else value + n
        out.append(item)
    return out


def dicom(data: bytes) -> list[dict]:
    """The frames of a little-endian DICOM file, plain, deflated, run-length encoded or as lossless JPEG."""
    import numpy as np

    if data[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    at, plain, packed, pixels, found, parts, groups = 132, False, None, None, {}, None, []
    while at + 8 <= len(data):
        if packed and struct.unpack_from("<H", data, at)[0] != 2:
            data, at, packed = zlib.decompress(data[at:], -15), 0, None
        tag, size, body = _head(data, at, plain)
        if tag == (0x5200, 0x9230):  # what is said frame by frame
            groups = _sequence(data, body, size, plain)
        if size == _OPEN:
            if tag == (0x7FE0, 0x10):
                if pixels is None:
                    raise ValueError("encapsulated pixels in a plain file")
                parts = _fragments(data, body)
                break
            at = _after(data, body, plain)
            continue
        value = data[body : body + size]
        if tag == (2, 0x10):
            syntax = value.rstrip(b"\0 ").decode()
            if syntax not in SYNTAXES:
                raise ValueError(f"transfer syntax {syntax} cannot be read")
            plain, packed, pixels = SYNTAXES[syntax]
        found[tag] = value
        at = body + size
    number = lambda key, default=0: struct.unpack("<H", found[key][:2])[0] if key in found else default
    text = lambda key, default="": found.get(key, default.encode()).decode("ascii", "replace").strip("\0 ")
    several = lambda value, n: [float(v) for v in (value.split("\\") if value else ["0"] * n)]
    h, w, bits, signed = number((0x28, 0x10)), number((0x28, 0x11)), number((0x28, 0x100)), number((0x28, 0x103))
    per, planes, stored, kind = number((0x28, 2), 1), number((0x28, 6)), number((0x28, 0x101), bits), text((0x28, 4), "MONOCHROME2")
    n = int(text((0x28, 8)) or 1)
    if kind not in ("MONOCHROME1", "MONOCHROME2", "RGB") or (kind == "RGB") != (per == 3):
        raise ValueError(f"pixels of kind {kind} with {per} samples cannot be read")
    if parts is None:
        raw = found[0x7FE0, 0x10]
        size = w * h * per * bits // 8
        if len(raw) < n * size or size * 8 != w * h * per * bits:
            raise ValueError("pixels are missing")
        frames = [samples(raw[k * size :], w * h * per, bits) for k in range(n)]
    else:
        each = _frames(*parts, n)
        if pixels == "jpeg":
            frames = [lossless(f).reshape(-1) for f in each]
        elif per == 1:
            frames = [samples(_runs(f, w * h), w * h, bits) for f in each]
        else:
            raise ValueError("run-length encoded colour cannot be read")
    slope, shift = float(text((0x28, 0x1053)) or 1), float(text((0x28, 0x1052)) or 0)
    sy, sx = several(text((0x28, 0x30)), 2)
    gap = float(text((0x18, 0x88)) or text((0x18, 0x50)) or 0)
    whole = {"place": text((0x20, 0x32)), "turn": text((0x20, 0x37))}
    out = []
    for k, v in enumerate(frames):
        v = v.astype(np.int64) & ((1 << stored) - 1)
        if signed:
            v -= (v >> (stored - 1)) << stored
        if kind == "MONOCHROME1":
            v = (-1 if signed else (1 << stored) - 1) - v
        own = groups[k] if k < len(groups) else {}
        said = lambda outer, inner, own=own: (own.get(outer) or [{}])[0].get(inner, b"").decode("ascii", "replace").strip("\0 ")
        place, turn = said((0x20, 0x9113), (0x20, 0x32)) or whole["place"], said((0x20, 0x9116), (0x20, 0x37)) or whole["turn"]
        plane, at_, axes = None, float(text((0x20, 0x13)) or 0), several(turn, 6) if turn else None
        if place:
            plane, at_ = orientation(axes or [1, 0, 0, 0, 1, 0], several(place, 3))
        if not said((0x20, 0x9113), (0x20, 0x32)):
            at_ += k * (gap or 1.0)  # frames without a place of their own follow each other
        measures = said((0x28, 0x9110), (0x28, 0x30))
        fy, fx = several(measures, 2) if measures else (sy, sx)
        thick = said((0x28, 0x9110), (0x18, 0x88)) or said((0x28, 0x9110), (0x18, 0x50))
        pix = grey(v, w * h, per, planes == 1 and parts is None) * slope + shift
        out.append({"at": at_, "w": w, "h": h, "pix": pix, "sx": fx, "sy": fy, "sz": float(thick) if thick else gap, "tilt": float(text((0x18, 0x1120)) or 0), "modality": text((8, 0x60)) or None, "plane": plane, "turn": axes})
    return out


def slices(spark: SparkSession, path: str) -> DataFrame:
    """A row per slice of the DICOM and TIFF files at path (a file, a folder or a pattern); files are decoded in the tasks that read
    them. Raises where there is none."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if files.select("path").isEmpty():
        raise ValueError("no image files")

    def decode(batches):
        import pandas as pd

        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                pages = dicom(data) if data[128:132] == b"DICM" else tiff(data)
                rows = [{"path": name, "sx": 0.0, "sy": 0.0, "sz": 0.0, "tilt": 0.0, "modality": None, "plane": None, "turn": None} | p for p in pages]
                yield pd.DataFrame(rows)[["path", "at", "w", "h", "sx", "sy", "sz", "tilt", "modality", "plane", "turn", "pix"]]

    return files.mapInPandas(decode, SLICE)


def _numbered(rows: DataFrame, study: str | None) -> DataFrame:
    """rows with study and z. Slices are numbered by place and path alone, so that no pixels are sorted."""
    rows = rows.withColumn("study", F.lit(study) if study is not None else F.regexp_extract("path", "^(.*)/", 1))
    z = F.row_number().over(W.partitionBy("study").orderBy("at", "path")) - 1
    numbers = rows.select("study", "path", "at").withColumn("z", z)
    return rows.join(numbers, ["study", "path", "at"])


def voxels(rows: DataFrame, study: str | None = None) -> DataFrame:
    """slices -> (study, z, y, x, v). A study is a folder, unless named; its slices are numbered by their place, then their path."""
    rows = _numbered(rows, study).select("study", "z", "w", F.posexplode("pix").alias("p", "v"))
    return rows.select("study", "z", F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).alias("x"), "v")


def studies(rows: DataFrame, study: str | None = None) -> DataFrame:
    """slices -> a row of metadata per study: w, h, d, sx, sy, sz, tilt, modality, plane, kind, and turn, the directions of a slice's
    columns and rows. Where slices differ, the greatest value counts; a gap that the files don't give is taken from the slices' places."""
    rows = rows.drop("pix").withColumn("study", F.lit(study) if study is not None else F.regexp_extract("path", "^(.*)/", 1))
    most = [F.max(c).alias(c) for c in ("w", "h", "sx", "sy", "sz", "tilt", "modality", "plane", "turn")]
    out = rows.groupBy("study").agg(*most, F.count("*").alias("d"), ((F.max("at") - F.min("at")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("apart"))
    gap = F.when(F.col("sz") > 0, F.col("sz")).otherwise(F.col("apart"))
    return out.select("study", "w", "h", "d", "sx", "sy", gap.alias("sz"), "tilt", "modality", "plane", F.lit("raw").alias("kind"), "turn")


def chosen(items: DataFrame, channel: int = 0, time: int = 0) -> DataFrame:
    """The voxels of a table with columns c and t at one channel and time."""
    return from_table(items.where((F.col("c") == channel) & (F.col("t") == time)))


def save(vox: DataFrame, path: str) -> None:
    """Writes voxels as Parquet, a folder per study, so that a study is read without the others."""
    vox.write.mode("overwrite").partitionBy("study").parquet(path)


def lut(spark: SparkSession, path: str) -> DataFrame:
    """(name, idx, r, g, b) of text colour tables: lines of r g b or idx r g b; lines that do not start with a digit are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)\\.[^./]*$", 1).alias("name"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    lines = lines.where(F.col("text").rlike("^\\s*\\d")).withColumn("n", F.regexp_extract_all("text", F.lit("(\\d+)"), 1)).where(F.size("n") >= 3)
    own = F.row_number().over(W.partitionBy("name").orderBy("line")) - 1
    last = lambda k: F.element_at("n", k).cast("int")
    idx = F.when(F.size("n") > 3, F.element_at("n", 1).cast("int")).otherwise(own)
    return lines.select("name", idx.alias("idx"), last(-3).alias("r"), last(-2).alias("g"), last(-1).alias("b"))


def from_table(df: DataFrame) -> DataFrame:
    """df as voxels; raises where a column is missing."""
    missing = {"study", "z", "y", "x", "v"} - set(df.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are missing")
    return df.select("study", "z", "y", "x", "v")
