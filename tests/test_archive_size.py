"""Archives of case files: small on disk, and read by any tar."""

from __future__ import annotations

import io
import tarfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casebook.sources import readers, sinks


def test_archives_take_less_than_their_members_and_any_tar_reads_them(spark, tmp_path):
    names = F.when(F.col("id") % 3 == 0, F.concat(F.lit("é" * 60), F.col("id"))).when(F.col("id") % 3 == 1, F.col("id").cast("string"))
    good = spark.range(3_000).select(F.struct(names.alias("case_id"), F.lit("ü" * 5).alias("d")).alias("record"), F.col("id").alias("report_index"), F.repeat(F.lit("x"), (F.col("id") % 600).cast("int")).alias("prompt"))
    sinks.case_archives(good, f"file://{tmp_path}")
    files = sorted(tmp_path.glob("archives/part-*"))
    assert sum(f.stat().st_size for f in files) < 3_000 * 400  # headers and filled blocks alone are 2,048 bytes a case
    read = {r["name"]: r["content"] for r in readers.archives(spark, f"file://{tmp_path}").collect()}
    plain = {}
    for f in files:
        with tarfile.open(f) as archive:
            plain |= {m.name: archive.extractfile(m).read().decode() for m in archive if m.isfile()}
    assert len(read) == 6_000 and read == plain


@pytest.mark.parametrize("name", ["a", "case_1.json", "x" * 99, "x" * 100, "x" * 130, "é", "./a"])
def test_headers_are_those_of_tarfile(name):
    for size in (0, 1, 511, 512, 10_000_000, 8**11):
        info = tarfile.TarInfo(name)
        info.size = size
        assert sinks._header(name, size) == info.tobuf(tarfile.PAX_FORMAT)


def test_plain_archives_without_other_headers():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as archive:
        info = tarfile.TarInfo("a.txt")
        info.size = 3
        archive.addfile(info, io.BytesIO(b"abc"))
    assert readers._plain_members(out.getvalue()) is None  # its end is blocks of zeros: tarfile reads it
