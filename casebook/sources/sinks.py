"""Outputs (K1-K9)."""

from __future__ import annotations

import json
import tarfile
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.functions.text import cell
from casebook.sources import sheets


def reset(spark, folder: str) -> None:
    """K1: an empty output folder, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path, True)
    fs.mkdirs(path)


def records(good: DataFrame, folder: str, mode: str = "append", with_prompts: bool = False) -> None:
    """K2, K3: good records as JSON lines, and the prompts beside them."""
    good.select("record.*").write.mode(mode).option("ignoreNullFields", False).json(f"{folder}/predictions")
    if with_prompts:
        good.select("report_index", "prompt").write.mode(mode).parquet(f"{folder}/prompts")


def _case(case: str) -> Column:
    return F.coalesce(F.col("record")[case].cast("string"), F.concat(F.lit("report_"), F.col("report_index").cast("string")))


def _pretty() -> Column:
    return F.to_json("record", {"pretty": "true", "ignoreNullFields": "false"})


@lru_cache(10_000)
def _unnamed(size: int) -> tuple[bytes, bytes, int]:
    """A header of a file of ``size`` bytes, without a name: what comes before its checksum and what comes after, and the sum of both."""
    info = tarfile.TarInfo("")
    info.size = size
    raw = info.tobuf(tarfile.PAX_FORMAT)
    return raw[100:148], raw[156:], sum(raw[:148]) + sum(raw[156:]) + 8 * ord(" ")


def _header(name: str, size: int) -> bytes:
    """``TarInfo.tobuf`` of a file; most headers differ by their name only."""
    if not name.isascii() or not 0 < len(name) < 100 or size >= 8**11:
        info = tarfile.TarInfo(name)
        info.size = size
        return info.tobuf(tarfile.PAX_FORMAT)
    raw = name.encode()
    before, after, total = _unnamed(size)
    return b"%s%s%06o\0 %s" % (raw.ljust(100, b"\0"), before, total + sum(raw), after)


def _members(batches: Iterator) -> Iterator:
    """Rows (name, content) as members of a tar archive, without the last byte, which the line separator gives."""
    import pyarrow as pa

    filler = tarfile.TarInfo("./")
    filler.type = tarfile.DIRTYPE
    filler = filler.tobuf(tarfile.PAX_FORMAT)
    for batch in batches:
        out = []
        for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
            raw = content.encode()
            member = _header(name, len(raw)) + raw
            # a member whose content fills its last block is followed by an entry for the folder, so that each row ends in a zero byte
            member += bytes(-len(member) % 512) if raw and len(raw) % 512 else filler
            out.append(member[:-1].decode())
        yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})


def case_archives(good: DataFrame, folder: str, case: str = "case_id", mode: str = "overwrite", each: int = 20_000) -> None:
    """K2, K3: ``case_<id>.json`` and ``case_<id>.txt`` of every case, record and prompt, as members of gzipped tar archives of up to ``each`` files.

    A task writes its cases one after another into few files, so as many cases as there are make no more commits than tasks.  A member takes 512 bytes
    and its content filled up to 512 more, mostly zeros, so archives are gzipped.  Any tar reads them; ``readers.archives`` does.  Rows without a case go by ``case_report_<index>``.
    """
    files = [F.struct(F.lit("json").alias("kind"), _pretty().alias("content"))]
    if "prompt" in good.columns:
        files.append(F.struct(F.lit("txt").alias("kind"), F.col("prompt").alias("content")))
    rows = good.select(_case(case).alias("id"), F.explode(F.array(*files)).alias("f")).where("f.content is not null")
    named = rows.select(F.concat(F.lit("case_"), "id", F.lit("."), "f.kind").alias("name"), F.col("f.content").alias("content"))
    made = named.mapInArrow(_members, "value string")
    made.write.mode(mode).option("lineSep", "\0").option("maxRecordsPerFile", each).option("compression", "gzip").text(f"{folder}/archives")


def case_files(good: DataFrame, folder: str, case: str = "case_id", mode: str = "overwrite") -> None:
    """K2, K3: of each case one text file with its record as indented JSON, nulls kept, and one with its prompt, where there is one.

    They lie in ``cases/<case>=<id>`` and ``prompts/<case>=<id>``; rows without a case are under their report's index.
    Each case is a folder that its task commits, so this is for some thousand cases; ``case_archives`` has no such limit.
    """
    key, pretty = _case(case), _pretty()
    good.select(key.alias(case), pretty.alias("value")).repartition(case).write.mode(mode).partitionBy(case).text(f"{folder}/cases")
    if "prompt" in good.columns:
        good.select(key.alias(case), F.col("prompt").alias("value")).repartition(case).write.mode(mode).partitionBy(case).option("lineSep", "\n").text(f"{folder}/prompts")


def summary_json(df: DataFrame, folder: str) -> None:
    """K6 in whatever store the folder is: a one-row frame as a JSON object, nulls kept."""
    df.limit(1).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def broken(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """K4: broken records."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(f"{folder}/broken")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    return df.select(*(cell(F.col(f"`{f.name}`"), f.dataType.simpleString()).alias(f.name) for f in df.schema.fields))


def csvs(frames: dict[str, DataFrame], folder: str, wanted: set[str] | None = None, one_file: bool = False) -> None:
    """K5: frames by name as CSV with a header; with ``wanted``, only those.  ``one_file`` is for small results."""
    for name, df in frames.items():
        if wanted is None or name in wanted:
            (df.coalesce(1) if one_file else df).transform(flat).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def one_row_json(df: DataFrame, path: str) -> dict:
    """K6: a one-row frame as a JSON object, indented, nulls kept."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("one row is wanted")
    out = rows[0].asDict(recursive=True)
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)  # in whatever store the path is
    file = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    file.write(bytearray(json.dumps(out, indent=2, ensure_ascii=False).encode()))
    file.close()
    return out


def workbook(df: DataFrame, path: str, title: str = "Sheet1", most: int = sheets.MOST_ROWS) -> None:
    """K7: a workbook, streamed by one task, of a sheet for each ``most`` rows."""
    df.sparkSession.dataSource.register(sheets.SheetSource)
    df.transform(flat).coalesce(1).write.format(sheets.FORMAT).mode("append").option("sheet", title).option("most", most).save(path)


def vectors(df: DataFrame, path: str, vector: str, width: int) -> None:
    """K9: a vector table; vectors of another width are an error."""
    right = F.size(vector) == width
    checked = F.when(right | F.col(vector).isNull(), F.col(vector).cast("array<float>")).otherwise(F.raise_error(F.lit(f"a vector is not {width} wide")).cast("array<float>"))
    df.withColumn(vector, checked).write.mode("overwrite").parquet(path)
