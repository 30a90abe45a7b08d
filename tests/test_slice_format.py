"""Folders of image files as a data source: studies pushed down to files, slices written once."""

from pathlib import Path

import numpy as np
import pytest

from tubula.sources import slice_format, volumes

KINDS = "study string, z int, w int, h int, pix array<double>"


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    before = spark.conf.get(slice_format.PUSHDOWN)
    spark.conf.set(slice_format.PUSHDOWN, "true")
    slice_format.register(spark)
    yield
    spark.conf.set(slice_format.PUSHDOWN, before)


def rows(studies=("a", "b/c"), n=12):
    rng = np.random.default_rng(2)
    return [(s, z, 3, 2, rng.normal(size=6).tolist()) for s in studies for z in range(n)]


def test_written_slices_are_read_again_and_numbered(spark, tmp_path):
    want = rows()
    spark.createDataFrame(want, KINDS).repartition(5).write.format("slices").mode("append").save(str(tmp_path))
    got = spark.read.format("slices").option("taskBytes", 500).load(str(tmp_path))
    assert got.rdd.getNumPartitions() > 2
    # By path, which is by z.
    seen = sorted((r.study, r.path, r.w, r.h, r.pix) for r in got.collect())
    assert [(s, w, h, p) for s, _, w, h, p in seen] == [(s, w, h, p) for s, _, w, h, p in sorted(want)]
    assert not [p for p in Path(tmp_path).iterdir() if p.name.startswith("_")]
    vox = volumes.voxels(got.where("study = 'b/c'"), "b/c")
    assert {(r.z, r.y, r.x): r.v for r in vox.collect()} == {(z, p // 3, p % 3): v for s, z, _, _, pix in want if s == "b/c" for p, v in enumerate(pix)}


def test_a_filter_opens_only_its_study(spark, tmp_path):
    spark.createDataFrame(rows(), KINDS).write.format("slices").mode("append").save(str(tmp_path))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "0.tif").write_bytes(b"no image")
    every = spark.read.format("slices").load(str(tmp_path))
    assert every.where("study = 'a'").count() == 12
    assert every.where("study IN ('a', 'b/c', 'none') AND modality IS NULL").count() == 24
    assert every.where("study = 'a' AND modality = 'CT'").count() == 0
    assert every.where("study = 'b'").count() == 0 and every.where("study = 'a' AND study = 'b/c'").count() == 0
    with pytest.raises(Exception, match="not a TIFF file"):
        every.where("study = 'broken'").collect()
    # Only files of the study are listed for tasks, too.
    reader = slice_format.PushingReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([slice_format.EqualTo(("study",), "a")])) == []
    assert {s for p in reader.partitions() for s, _ in p.files} == {"a"}


def test_overwriting_and_failing(spark, tmp_path):
    frame = spark.createDataFrame(rows(("a",), 3), KINDS)
    frame.write.format("slices").mode("append").save(str(tmp_path))
    spark.createDataFrame(rows(("x",), 2), KINDS).write.format("slices").mode("overwrite").save(str(tmp_path))
    names = lambda: sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file())
    want = ["x/0000000000.tif", "x/0000000001.tif"]
    assert names() == want
    # A slice of a wrong size, a slice that is there twice, a name outside the folder: nothing of the job stays.
    for bad in ([("y", 0, 3, 2, [1.0] * 6), ("y", 1, 3, 2, [1.0])], [("y", 0, 1, 1, [1.0])] * 2, [("../y", 0, 1, 1, [1.0])], [(None, 0, 1, 1, [1.0])]):
        with pytest.raises(Exception):
            spark.createDataFrame(bad, KINDS).repartition(2).write.format("slices").mode("append").save(str(tmp_path))
        assert names() == want and not [p for p in tmp_path.iterdir() if p.name.startswith("_")]
    with pytest.raises(Exception, match="no image files"):
        spark.read.format("slices").load(str(tmp_path / "none")).collect()
