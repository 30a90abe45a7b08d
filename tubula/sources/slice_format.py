"""Folders of image files as a Spark data source: spark.read.format("slices").load(path), and the same to write.

    slice_format.register(spark)
    spark.read.format("slices").load("/scans").where("study = 'a'")      # opens the files of study a alone
    rows.write.format("slices").mode("append").save("/scans")            # study, z, w, h, pix

A study is a folder below the path; files in the path itself belong to the study "". Paths are local or shared folders, or
addresses that pyarrow's file systems know."""

from __future__ import annotations

import dataclasses
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from . import volumes

SCHEMA = "study string, " + volumes.SLICE
#: What one task reads: files of this many bytes together, or a single larger one.
TASK_BYTES = 64 << 20
HEADER = ("modality", "plane")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _folder(options):
    """The file system and the folder of a path."""
    from pyarrow import fs

    path = options.get("path")
    if not path:
        raise ValueError("a path is needed")
    system, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system, at.rstrip("/")


def _files(system, root: str, studies: set | None) -> Iterator[tuple[str, str, int]]:
    """(study, file, bytes) of the folder, sorted; names that start with a dot or a low line are left out, with all below them. Where
    studies are given, only their folders are listed."""
    from pyarrow import fs

    def of(study: str, deep: bool):
        folder = f"{root}/{study}" if study else root
        for info in sorted(system.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path):
            if info.base_name[0] in "._":
                continue
            if info.type == fs.FileType.File:
                yield study, info.path, info.size
            elif deep:
                yield from of(info.path[len(root) + 1 :], deep)

    if studies is None:
        yield from of("", True)
        return
    for study in sorted(studies):
        if not study or all(p and p[0] not in "._" for p in study.split("/")):
            yield from of(study, False)


@dataclasses.dataclass
class Files(InputPartition):
    files: list


class SliceReader(DataSourceReader):
    """A partition is a list of files; a task opens its own ones, one after the other."""

    def __init__(self, options):
        self.options, self.studies, self.header = dict(options), None, []

    def partitions(self) -> list[Files]:
        system, root = _folder(self.options)
        most = int(self.options.get("taskbytes", TASK_BYTES))
        out, held = [], 0
        for study, path, size in _files(system, root, self.studies):
            if not out or held + size > most:
                out.append(Files([]))
                held = 0
            out[-1].files.append((study, path))
            held += size
        if not out and self.studies is None:
            raise ValueError("no image files")
        return out or [Files([])]

    def read(self, partition: Files):
        import pyarrow as pa

        system, _ = _folder(self.options)
        kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}
        schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])
        plain = {"sx": 0.0, "sy": 0.0, "sz": 0.0, "tilt": 0.0, "modality": None, "plane": None, "turn": None}
        for study, path in partition.files:
            with system.open_input_stream(path) as f:
                data = f.read()
            for page in volumes.dicom(data) if data[128:132] == b"DICM" else volumes.tiff(data):
                row = plain | page | {"study": study, "path": path}
                if all(row[name] in wanted for name, wanted in self.header):
                    yield pa.RecordBatch.from_pylist([row], schema)


class PushingReader(SliceReader):
    """Studies that are asked for by name are the only ones listed; slices of another modality or plane never leave their task."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, EqualNullSafe, In)) and len(f.attribute) == 1 else None
            wanted = set(f.value) if isinstance(f, In) else {getattr(f, "value", None)}
            if name == "study":
                self.studies = wanted - {None} if self.studies is None else self.studies & wanted
            elif name in HEADER and None not in wanted:
                self.header.append((name, wanted))
            else:
                yield f


def page(values, w: int, h: int) -> bytes:
    """A TIFF file of one page of 64-bit floating numbers."""
    import numpy as np

    raw = np.asarray(values, "<f8")
    if raw.size != w * h or w <= 0 or h <= 0:
        raise ValueError(f"{raw.size} values for {w} x {h} pixels")
    tags = [(256, 4, w), (257, 4, h), (258, 3, 64), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, raw.nbytes), (339, 3, 3)]
    listed = b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in tags)
    return b"II*\0" + struct.pack("<I", 8 + raw.nbytes) + raw.tobytes() + struct.pack("<H", len(tags)) + listed + bytes(4)


@dataclasses.dataclass
class Written(WriterCommitMessage):
    files: list


class SliceWriter(DataSourceArrowWriter):
    """A file per slice, <study>/<z, ten digits>.tif. Tasks write into a folder that readers pass over; the job's end moves what the
    tasks that counted have written, so a task that was run twice or failed leaves nothing."""

    def __init__(self, options, overwrite: bool):
        self.options, self.overwrite = dict(options), overwrite
        self.hidden = f"_writing-{uuid.uuid4().hex}"

    def write(self, batches) -> Written:
        system, root = _folder(self.options)
        folder, out = f"{root}/{self.hidden}/{uuid.uuid4().hex}", {}
        system.create_dir(folder)
        for b in batches:
            for r in b.select(["study", "z", "w", "h", "pix"]).to_pylist():
                if r["z"] is None or r["z"] < 0 or r["study"] is None or any(p in ("", ".", "..") or p[0] in "._" for p in r["study"].split("/") if r["study"]):
                    raise ValueError(f"slice {r['z']} of study {r['study']!r} cannot be a file")
                final = f"{r['study']}/{r['z']:010d}.tif".lstrip("/")
                if final in out:
                    raise ValueError(f"slice {final} is there twice")
                out[final] = f"{folder}/{len(out)}"
                with system.open_output_stream(out[final]) as f:
                    f.write(page(r["pix"], r["w"], r["h"]))
        return Written(list(out.items()))

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, root = _folder(self.options)
        moves = [m for message in messages if message is not None for m in message.files]
        if len({final for final, _ in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("a slice is there twice")
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if info.base_name != self.hidden:
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        made = set()
        for final, now in moves:
            folder = f"{root}/{final}".rpartition("/")[0]
            if folder not in made:
                system.create_dir(folder)
                made.add(folder)
            system.move(now, f"{root}/{final}")
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        system, root = _folder(self.options)
        if system.get_file_info(f"{root}/{self.hidden}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.hidden}")


class Slices(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SliceReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return SliceWriter(self.options, overwrite)


class PushingSlices(Slices):
    def reader(self, schema) -> DataSourceReader:
        return PushingReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session. Filters go down to the files where the session lets Python sources have them
    (spark.sql.python.filterPushdown.enabled); elsewhere they are applied after reading."""
    pushing = spark.conf.get(PUSHDOWN, "false") == "true"
    spark.dataSource.register(PushingSlices if pushing else Slices)
