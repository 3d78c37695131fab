"""Sources of mail: files, mailbox snapshots, and a data source with pushed filters."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, InputPartition, LessThan

from mailgrain.errors import SourceError
from mailgrain.functions.mime import read_mails
from mailgrain.operators.instants import wall_clock

# Fixed values.
UNSELECTABLE = ("\\noselect", "\\nonexistent")
TRASH_NAMES = ("trash", "deleted", "deleted messages", "deleted items", "papierkorb", "bin")


class MailSource(Protocol):
    """Where mail comes from: rows of an id and the raw message; all that follows reads nothing else."""

    def mails(self, spark: SparkSession) -> DataFrame:
        """source_id, raw."""
        ...


class EmlFolder:
    """The .eml files of a folder as a source."""

    def __init__(self, directory: str):
        self.directory = directory

    def mails(self, spark: SparkSession) -> DataFrame:
        """source_id (path) and raw message, by path."""
        return eml_files(spark, self.directory).select(F.col("path").alias("source_id"), F.col("content").alias("raw"))


def parsed_mails(source: MailSource, spark: SparkSession) -> DataFrame:
    """source_id and m (see ``functions.mime``) of every mail of a source; what can't be read is a row with its error."""
    return read_mails(source.mails(spark), "raw", ["source_id"])


def eml_files(spark: SparkSession, directory: str) -> DataFrame:
    """path, stem, modified, length, content of the .eml files directly in a directory (case-sensitive suffix), by path.

    Names begin with the date, so paths are in order of time.  Columns that aren't used are pruned, so listings don't read content.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise SourceError(f"not a directory: {directory}")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(directory)
    stem = F.regexp_extract("path", r"([^/]*)\.eml$", 1)
    return raw.select("path", stem.alias("stem"), F.col("modificationTime").alias("modified"), "length", "content").orderBy("path")


def collect_files(spark: SparkSession, arguments: list[str]) -> DataFrame:
    """position, path of the .eml files that files and folders name, each once, in order of first mention.

    A folder gives the files directly in it by name.  SourceError for what isn't
    there and for a file of another kind.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    seen: dict[str, None] = {}
    for argument in arguments:
        path = hadoop.Path(argument)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            raise SourceError(f"not found: {argument}")
        status = fs.getFileStatus(path)
        if status.isDirectory():
            inside = [s for s in fs.listStatus(path) if s.isFile() and s.getPath().getName().endswith(".eml")]
            seen |= dict.fromkeys(sorted(s.getPath().toString() for s in inside))
        elif status.getPath().getName().endswith(".eml"):
            seen[status.getPath().toString()] = None
        else:
            raise SourceError(f"not an .eml file: {argument}")
    return spark.createDataFrame(list(enumerate(seen)), "position int, path string")


def collect_paths(arguments: DataFrame) -> DataFrame:
    """Distinct paths of (position, path), first mention kept, in that order."""
    return arguments.groupBy("path").agg(F.min("position").alias("position")).orderBy("position")


def selectable(folders: DataFrame) -> DataFrame:
    """Folders that can be opened (flags array<string>)."""
    lowered = F.transform("flags", F.lower)
    return folders.where(~F.coalesce(F.arrays_overlap(lowered, F.array(*[F.lit(u) for u in UNSELECTABLE])), F.lit(False)))


def delimiters(folders: DataFrame) -> DataFrame:
    """account, delimiter: the last one a server names that isn't empty (folders: account, position, delimiter), else a slash."""
    last = F.max_by("delimiter", F.when(F.length("delimiter") > 0, F.col("position")))
    named = F.max(F.length("delimiter")) > 0
    return folders.groupBy("account").agg(F.when(named, last).otherwise(F.lit("/")).alias("delimiter"))


def received_time(files: DataFrame, wall: str, prefer_header: bool = False) -> DataFrame:
    """``files`` with ``received``: the time of the file, or the date of its header where that is preferred and there."""
    modified = F.col("modified").cast("timestamp_ntz")
    return files.withColumn("received", F.coalesce(wall, modified) if prefer_header else modified)


def trash_folders(folders: DataFrame) -> DataFrame:
    """account, folder of the trash: by flag where an account has one, else by leaf name."""
    leaf = F.lower(F.regexp_extract("folder", r"([^/.]*)$", 1))
    flagged = F.coalesce(F.array_contains(F.transform("flags", F.lower), "\\trash"), F.lit(False))
    marked = folders.select("account", "folder", flagged.alias("by_flag"), leaf.isin(*TRASH_NAMES).alias("by_name"))
    has = marked.groupBy("account").agg(F.bool_or("by_flag").alias("has_flag"))
    return marked.join(has, "account").where(F.when(F.col("has_flag"), F.col("by_flag")).otherwise(F.col("by_name"))).select("account", "folder")


def mailbox(scanned: DataFrame, headers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Scanned messages with their headers, times as the wall clock they are written in (see ``instants.wall_clock``).

    Header texts are never null here; ids and sizes may be.  ``accounts``: name, day_first.
    """
    order = F.broadcast(accounts.select(F.col("name").alias("account"), F.col("day_first").alias("__first")))  # one row per account
    wall = lambda c: wall_clock(F.col(c), F.col("__first"))
    h = headers.join(order, "account", "left").select(
        "hdr_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("from_", "to_", "cc", "bcc", "subject")],
        F.nullif(F.trim("message_id"), F.lit("")).alias("message_id"), wall("date_").alias("date_wall"),
    )
    s = scanned.join(order, "account", "left").select("account", "folder", "uidvalidity", "uid", "hdr_id", F.col("rfc822_size").alias("size"), wall("received").alias("received_wall"))
    return s.join(h, "hdr_id")


class _RowGroup(InputPartition):
    """One row group of one file."""

    def __init__(self, path: str, group: int):
        super().__init__((path, group))
        self.path, self.group = path, group


class _SnapshotReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            kind = {EqualTo: "==", GreaterThan: ">", LessThan: "<"}.get(type(f))
            if kind and len(f.attribute) == 1 and f.attribute[0] in ("account", "folder", "uid", "size"):
                self.tests.append((f.attribute[0], kind, f.value))
            else:
                yield f

    def _files(self):
        """(file system, paths): a path is a URI of any system the workers can open, or a local one."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)
        if system.get_file_info(root).type == fs.FileType.File:
            return system, [root]
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return system, sorted(i.path for i in found if i.type == fs.FileType.File and i.base_name.endswith(".parquet") and i.base_name[0] not in "._")

    def partitions(self):
        import pyarrow.parquet as pq

        system, paths = self._files()
        out = []
        for path in paths:
            with system.open_input_file(path) as f:
                out += [_RowGroup(path, k) for k in range(pq.ParquetFile(f).metadata.num_row_groups)]
        return out

    def read(self, partition):
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        names = {"size": "rfc822_size"}
        test = None
        for column, kind, value in self.tests:
            f = pc.field(names.get(column, column))
            one = f == value if kind == "==" else f > value if kind == ">" else f < value
            test = one if test is None else test & one
        columns = ["account", "folder", "uidvalidity", "uid", "hdr_id", "rfc822_size"]
        system, _ = self._files()
        with system.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(row_groups=[partition.group], columns=columns):
                kept = batch if test is None else batch.filter(test)
                yield kept.select(columns).rename_columns([*columns[:-1], "size"])


class SnapshotSource(DataSource):
    """Mailbox snapshot that takes equality and size filters into its scan (format ``mail_snapshot``)."""

    @classmethod
    def name(cls) -> str:
        return "mail_snapshot"

    def schema(self) -> str:
        return "account string, folder string, uidvalidity long, uid long, hdr_id long, size long"

    def reader(self, schema) -> DataSourceReader:
        return _SnapshotReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("mail_snapshot")`` available."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SnapshotSource)
