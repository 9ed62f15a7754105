"""Log files by byte ranges: a data source that streams what is appended to files, and reads heads or ranges in batch.

``LogBytes`` is a Spark data source. As a stream its offset holds, for every file, the end of its last complete line and a
checksum of its first line; a batch reads the bytes between two offsets, in ranges that executors read alone. Spark logs
offsets before it reads them, so after a restart each appended line comes once. A line without a line feed waits for it.
A file that shrank, or whose first line changed, is a new file and is read from its start; one that is gone is forgotten.
In batch it reads whole files by ranges, or the first ``headBytes`` of each, whatever its size.

Files are opened by Arrow's file systems (local, HDFS, S3, GCS), on the driver for their sizes, first lines and ends, and
on executors for their lines.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ledgerline.sources.logs import decode_entries

FORMAT = "ledger_log_bytes"
SCHEMA = "path string, offset long, value string"
#: Bytes of a file that one task reads, bytes of its first line that tell it from another, and what a read asks for.
RANGE_BYTES = 8 << 20
FIRST_BYTES = 1024
_CHUNK = 1 << 20
#: What is read of a file for its session's metadata.
HEAD_BYTES = 256 << 10


def file_system(path: str):
    """(file system, path in it, what comes before it in names of files)."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path[len("file:") :]
    if path.startswith("/"):
        return fs.LocalFileSystem(), path, "file://"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path.split("://")[0] + "://"


def listed(path: str, glob: str) -> dict[str, tuple[int, int]]:
    """Size and time in nanoseconds of each file below ``path`` whose name fits."""
    from pyarrow import fs

    system, inner, scheme = file_system(path)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return {scheme + f.path: (f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, glob)}


def first_line_sum(file) -> int:
    """Checksum of a file's first line, or of its first bytes where it is longer."""
    file.seek(0)
    return zlib.crc32(file.read(FIRST_BYTES).split(b"\n", 1)[0])


def complete_end(file, size: int) -> int:
    """Where the last line that is closed by a line feed ends."""
    end = size
    while end > 0:
        start = max(0, end - _CHUNK)
        file.seek(start)
        at = file.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return 0


@dataclass
class ByteRange(InputPartition):
    """Lines of a file that start in [start, end); ``begin`` starts a line and ``stop`` ends one, or is null for the end
    of the file. ``head``: no line goes on beyond ``end``."""

    path: str
    start: int
    end: int
    begin: int
    stop: int | None
    head: bool = False


def ranges(path: str, begin: int, end: int, most: int, to_end: bool = False) -> list[ByteRange]:
    return [ByteRange(path, a, min(a + most, end), begin, None if to_end else end) for a in range(begin, end, most)]


def lines_of(file, part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of a range, in pieces of bounded size."""
    at = part.start if part.start == part.begin else part.start - 1
    file.seek(at)
    held, skip = b"", part.start != part.begin  # what stands before the first line feed belongs to the range before
    while True:
        want = _CHUNK if part.stop is None else min(_CHUNK, part.stop - at - len(held))
        if part.head:
            want = min(want, part.end - at - len(held))
        more = file.read(want) if want > 0 else b""
        held += more
        *full, rest = held.split(b"\n")
        for line in full:
            if skip:
                skip = False
            elif at < part.end:
                yield at, line
            at += len(line) + 1
            if at >= part.end:
                return
        held = rest
        if not more:
            if held and not skip and part.stop is None and not part.head and at < part.end:
                yield at, held  # the last line of a file that is read whole
            return


def _batches(parts: list[ByteRange]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("value", pa.string())])
    for part in parts:
        system, inner, _ = file_system(part.path)
        try:
            file = system.open_input_file(inner)
        except FileNotFoundError:
            continue  # removed since it was listed
        with file:
            rows, size = [], 0
            for at, line in lines_of(file, part):
                rows.append((part.path, at, line.decode("utf-8", "replace").removesuffix("\r")))
                size += len(line)
                if size > 4 * _CHUNK or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


@dataclass
class Ranges(InputPartition):
    parts: list[ByteRange]


def dealt(parts: list[ByteRange], most: int) -> list[Ranges]:
    """Small ranges together, so that many small files are few tasks."""
    out, size = [], 0
    for p in parts:
        if not out or size + p.end - p.start > most:
            out.append(Ranges([]))
            size = 0
        out[-1].parts.append(p)
        size += p.end - p.start
    return out


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.most, self.head = int(options.get("rangeBytes", RANGE_BYTES)), int(options.get("headBytes", 0))

    def partitions(self):
        files = sorted((p, size) for p, (size, _) in listed(self.path, self.glob).items() if size)
        if self.head:
            parts = [ByteRange(p, 0, min(size, self.head), 0, None, size > self.head) for p, size in files]
        else:
            parts = [r for p, size in files for r in ranges(p, 0, size, self.most, True)]
        return dealt(parts, self.most)

    def read(self, partition):
        return _batches(partition.parts)


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.most = int(options.get("rangeBytes", RANGE_BYTES))
        self.seen: dict[str, tuple[tuple[int, int], list[int]]] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        out = {}
        for path, mark in sorted(listed(self.path, self.glob).items()):
            known = self.seen.get(path)
            if known is None or known[0] != mark:  # only files that changed are opened
                system, inner, _ = file_system(path)
                try:
                    with system.open_input_file(inner) as file:
                        known = mark, [complete_end(file, mark[0]), first_line_sum(file)]
                except FileNotFoundError:
                    continue
            out[path] = known
        self.seen = out
        return {p: entry for p, (_, entry) in out.items() if entry[0]}

    def partitions(self, start, end):
        parts = []
        for path, (stop, first) in end.items():
            begin, was = start.get(path, (0, first))
            parts += ranges(path, begin if was == first and begin <= stop else 0, stop, self.most)
        return dealt(parts, self.most)

    def read(self, partition):
        return _batches(partition.parts)


class LogBytes(DataSource):
    """Options: path, glob, rangeBytes, and in batch headBytes."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def tailed(spark: SparkSession, path: str, glob: str = "*.jsonl", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of (path, offset, value) of all lines below ``path``, those appended later too, each once."""
    spark.dataSource.register(LogBytes)
    return spark.readStream.format(FORMAT).option("glob", glob).option("rangeBytes", range_bytes).load(path)


def read_heads(spark: SparkSession, path: str, glob: str = "*.jsonl", head_bytes: int = HEAD_BYTES) -> DataFrame:
    """The complete lines in the first ``head_bytes`` of each file: no more is read of it."""
    spark.dataSource.register(LogBytes)
    return spark.read.format(FORMAT).option("glob", glob).option("headBytes", head_bytes).load(path)


def read_ranges(spark: SparkSession, path: str, glob: str = "*.jsonl", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All lines with their byte offsets, from ranges that need no shuffle to be put in place."""
    spark.dataSource.register(LogBytes)
    return spark.read.format(FORMAT).option("glob", glob).option("rangeBytes", range_bytes).load(path)


def head_metadata(heads: DataFrame) -> DataFrame:
    """Per file, from its head: the session of its first entry, the first slug, the last title given by the user, and the
    first prompt off sidechains with its time."""
    from ledgerline.operators.conversation import step_kind

    entries = decode_entries(heads).withColumn("kind", step_kind())
    good = F.col("outcome") == "entry"
    prompt = good & ~F.col("is_sidechain") & ~F.col("injected") & (F.col("kind") == "prompt")
    first = lambda c, when: F.min_by(c, F.when(when & F.col(c).isNotNull(), F.col("offset")))
    return entries.groupBy("path").agg(
        first("session_id", good).alias("session_id"), first("slug", F.lit(True)).alias("slug"), F.max_by("custom_title", F.when(F.col("custom_title").isNotNull(), F.col("offset"))).alias("custom_title"),
        F.min_by("text", F.when(prompt, F.col("offset"))).alias("first_prompt"), F.min_by("ts", F.when(prompt, F.col("offset"))).alias("prompted"),
    )


def owning_sessions(spark: SparkSession, heads: DataFrame, path: str, glob: str = "*.jsonl") -> DataFrame:
    """path, session_id of each file of ``heads`` (as by head_metadata): the session its name gives, unless its first entry
    names another and no line of the whole file names that of its name. Only such files are read beyond their heads."""
    named = heads.withColumn("file_session", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    odd = named.where("session_id <> file_session").select("path", "file_session")
    lines = read_ranges(spark, path, glob).join(odd, "path")
    own = lines.where(F.try_variant_get(F.try_parse_json("value"), "$.sessionId", "string") == F.col("file_session")).select("path").distinct().withColumn("_own", F.lit(True))
    both = named.join(own, "path", "left")
    return both.select("path", F.when(F.col("session_id").isNull() | F.col("_own"), F.col("file_session")).otherwise(F.col("session_id")).alias("session_id"))


SAMPLE = "struct<ts: timestamp, account: string, used: double, resets_at: timestamp>"


def parsed_samples(lines: DataFrame) -> DataFrame:
    """Samples of a log's lines: ts, account, used, resets_at; malformed lines are none."""
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    v = lines.withColumn("_v", F.try_parse_json("value"))
    out = v.select(F.try_to_timestamp(get("$.ts")).alias("ts"), get("$.account").alias("account"), get("$.used", "double").alias("used"), F.try_to_timestamp(get("$.resets_at")).alias("resets_at"))
    return out.where("ts is not null and used is not null")


def append_samples(spark: SparkSession, log: str, table: str, checkpoint: str, glob: str = "*.jsonl") -> None:
    """Reads what the sample log has gained since the last call and adds it to ``table``; the checkpoint is the store of
    offsets. Samples that the table holds are not added again, so a log that was rewritten, or a batch that was written
    but not logged, repeats nothing."""
    keys = ["account", "ts", "used", "resets_at"]

    def add(df: DataFrame, _: int) -> None:
        from ledgerline.streaming.refresh import table_exists

        new = parsed_samples(df).distinct().withColumn("day", F.to_date("ts"))
        if table_exists(df.sparkSession, table):
            held = df.sparkSession.read.parquet(table).join(new.select("day").distinct(), "day", "left_semi")  # days are folders, others are not read
            same = F.lit(True)
            for k in keys:
                same = same & new[k].eqNullSafe(held[k])
            new = new.join(held, same & (new["day"] == held["day"]), "left_anti")
        new.write.mode("append").partitionBy("day").parquet(table)

    tailed(spark, log, glob).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _rewritten(cutoff_micros: int):
    """Rewrites one file after another without the samples before the cutoff, by a new file that takes the old one's
    place. Lines that are no samples stay."""
    import json
    from datetime import datetime, timezone

    def is_old(line: bytes) -> bool:
        try:
            ts = datetime.fromisoformat(json.loads(line)["ts"].replace("Z", "+00:00"))
        except (ValueError, KeyError, TypeError, AttributeError):
            return False
        ts = ts if ts.tzinfo else ts.replace(tzinfo=timezone.utc)
        return ts.timestamp() * 1_000_000 < cutoff_micros

    def run(batches):
        for b in batches:
            out = []
            for path, size in zip(b.column("path").to_pylist(), b.column("size").to_pylist(), strict=True):
                system, inner, _ = file_system(path)
                kept = dropped = 0
                with system.open_input_file(inner) as file, system.open_output_stream(f"{inner}.tmp") as to:
                    for _, line in lines_of(file, ByteRange(path, 0, size, 0, None)):
                        if is_old(line):
                            dropped += 1
                        else:
                            to.write(line + b"\n")
                            kept += 1
                if dropped:
                    system.move(f"{inner}.tmp", inner)
                else:
                    system.delete_file(f"{inner}.tmp")
                out.append({"path": path, "kept": kept, "dropped": dropped})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("kept", pa.int64()), ("dropped", pa.int64())]))

    return run


def rewrite_retained(spark: SparkSession, log: str, cutoff, glob: str = "*.jsonl") -> list[tuple[str, int, int]]:
    """Drops the samples before ``cutoff`` from each file of a log; (path, kept, dropped) of each. A task streams a file."""
    files = [(p, size) for p, (size, _) in sorted(listed(log, glob).items())]
    if not files:
        return []
    df = spark.createDataFrame(files, "path string, size long").repartition(min(len(files), 1000), "path")
    done = df.mapInArrow(_rewritten(int(cutoff.timestamp() * 1_000_000)), "path string, kept long, dropped long")
    return [tuple(r) for r in done.collect()]
