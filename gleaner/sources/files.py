"""File sources: terminal logs, image folders, settings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T


def parse_log(lines: DataFrame, whole_command: bool = True) -> DataFrame:
    """session, ts, event, cwd, data of ``epoch|event|cwd|data`` lines with four parts or more. A command keeps its own bars unless whole_command is off."""
    parts = F.split("value", r"\|")
    data = F.regexp_extract("value", r"(?s)^[^|]*\|[^|]*\|[^|]*\|(.*)$", 1) if whole_command else F.get(parts, 3)
    session = F.col("session") if "session" in lines.columns else F.lit("")
    rows = lines.where(F.size(parts) >= 4)
    epoch = F.coalesce(F.expr("try_cast(split(value, '[|]')[0] AS BIGINT)"), F.lit(0))
    return rows.select(session.alias("session"), F.timestamp_seconds(epoch).alias("ts"), F.get(parts, 1).alias("event"), F.get(parts, 2).alias("cwd"), data.alias("data"))


def exit_code(data: Column) -> Column:
    return F.coalesce(data.try_cast("int"), F.lit(-1))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files; each file is a session."""
    return spark.read.text(path).withColumn("session", F.input_file_name())


def stream_log(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    """The same as a stream of appended files; offsets are kept in the query's checkpoint."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(path).withColumn("session", F.input_file_name())


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, hash, size and managed name of image files."""
    return _named(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))


def stream_images(spark: SparkSession, path: str, files_per_batch: int = 10) -> DataFrame:
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_batch).load(path)
    return _named(rows)


def _named(files: DataFrame) -> DataFrame:
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    hashed = F.sha2("content", 256)
    return files.where(T.image_file(F.col("path"))).select("path", "modificationTime", "length", "content", hashed.alias("content_hash"), F.concat(hashed, F.lit("."), extension).alias("managed_name"))


def rescan(files: DataFrame, snippets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New files (whose hash and name no snippet has) and one row of counters: total, processed, skipped."""
    known = snippets.select("content_hash").where(F.col("content_hash").isNotNull()).distinct()
    names = snippets.select(F.element_at(F.split("file_path", "/"), -1).alias("managed_name")).where(F.col("managed_name").isNotNull()).distinct()
    first = files.groupBy("content_hash").agg(F.min("path").alias("path"))
    new = files.join(first, ["content_hash", "path"], "left_semi").join(known, "content_hash", "left_anti").join(names, "managed_name", "left_anti")
    counters = files.agg(F.count("*").alias("total")).crossJoin(new.agg(F.count("*").alias("processed"))).withColumn("skipped", F.col("total") - F.col("processed"))
    return new, counters


def managed_path(folder: str, content_hash: Column, extension: Column) -> Column:
    return F.concat_ws("/", F.lit(folder), F.concat(content_hash, F.lit("."), extension))


@dataclass(frozen=True)
class Settings:
    """One row of settings with their defaults."""

    # Names and defaults of a settings file.
    theme: str = "light"
    enable_semantic_search: bool = True
    enable_search_analytics: bool = True
    shortcut_save: str = "Alt+Shift+C"
    shortcut_search: str = "Alt+Shift+F"
    run_in_background: bool = True
    terminal_monitoring_enabled: bool = False
    terminal_blocklist: str = "ls,cd,pwd,clear,exit,history,echo,cat,which,type"
    terminal_allowlist: str = "docker,git,kubectl,npm,cargo,python,ffmpeg,curl,aws,gcloud,az,terraform,ansible,ssh,scp,rsync"
    terminal_min_length: int = 60
    shell_type: str = "zsh"
    command_picker_enabled: bool = True
    command_picker_shortcut: str = "Ctrl+R"
    spotlight_enabled: bool = True
    spotlight_shortcut: str = "Alt+Space"
    screenshot_monitoring_enabled: bool = True
    screenshot_directory: str = "~/Desktop"
    screenshot_ocr_enabled: bool = True
    screenshot_caption_enabled: bool = True
    visual_search_enabled: bool = False
    ocr_engine: str = "auto"
    ocr_recognition_level: str = "accurate"
    ocr_cleaning_level: str = "balanced"
    tesseract_psm_mode: int = 3
    # this library's own
    search_limit: int = 10
    semantic_floor: float = 0.3
    classify_floor: float = 0.75
    analytics_days: int = 30
    job_days: int = 7


def load_settings(rows: DataFrame) -> Settings:
    """The first row's values; missing columns, null values and a missing row leave defaults."""
    first = rows.limit(1).collect()
    given = first[0].asDict() if first else {}
    return replace(Settings(), **{f.name: given[f.name] for f in fields(Settings) if given.get(f.name) is not None})


def save_settings(spark: SparkSession, settings: Settings, path: str) -> None:
    spark.createDataFrame([settings.__dict__]).coalesce(1).write.mode("overwrite").json(path)


def _size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the first bytes of a PNG, JPEG or lossy WebP file."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8 " and len(data) >= 30:
        return int.from_bytes(data[26:28], "little") & 0x3FFF, int.from_bytes(data[28:30], "little") & 0x3FFF
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def image_size(content: Column) -> Column:
    """width and height of image bytes; nulls where the format isn't known."""

    @F.pandas_udf("width int, height int")
    def run(files: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_size(f) or (None, None) for f in files], columns=["width", "height"]).astype("Int32")

    return run(content)


def store_images(files: DataFrame, folder: str) -> DataFrame:
    """content_hash, file_path of images (images, stream_images) in a store that names files by their content.

    A task writes a file under a name of its own and then moves it to that of its hash,
    so a task that runs again, or twice at once, leaves the same files; a file that is
    there already isn't written again. folder is a path or address that Arrow's file
    systems open from every machine. Equal images are written once.
    """
    import uuid

    import pyarrow as pa
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("managed_name"), batch.column("content"), strict=True):
                target = f"{root}/{name.as_py()}"
                if system.get_file_info(target).type == fs.FileType.NotFound:
                    own = f"{target}.{uuid.uuid4().hex}.part"
                    with system.open_output_stream(own) as out:
                        out.write(content.as_py())
                    system.move(own, target)
            paths = pa.array([f"{root}/{n}" for n in batch.column("managed_name").to_pylist()], pa.string())
            yield pa.record_batch([batch.column("content_hash"), paths], names=["content_hash", "file_path"])

    return files.dropDuplicates(["managed_name"]).select("content_hash", "managed_name", "content").mapInArrow(run, "content_hash string, file_path string")
