"""Event documents as files, one per event and kind, written in two phases and read in few tasks."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "event_files"
SCHEMA = "domain string, event_id string, kind string, part int, body string"
KINDS = ("full", "summary")
PACK_FILES, PACK_BYTES = 1000, 64 << 20   # files and bytes of one reading task, about


def _fs(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int
    size: int


class EventWriter(DataSourceWriter):
    """Every task writes files into a folder of its own that nobody reads; the commit file, written when all tasks are done, is what
    makes them visible, all kinds at once. Each commit is a file of its own, so runs may share a folder."""

    def __init__(self, path: str):
        self.path, self.run = path, f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = _fs(self.path)
        task = TaskContext.get()
        folder, files, size, made = f"data/{self.run}/{task.partitionId():06d}-{task.taskAttemptId()}", 0, 0, set()
        for r in rows:
            if r["kind"] not in KINDS or r["event_id"] is None:
                raise ValueError(f"an event file needs an event_id and one of the kinds {KINDS}, not {r['event_id']!r}, {r['kind']!r}")
            at = f"{root}/{folder}/{r['kind']}/{'=' + quote(r['domain'], safe='') if r['domain'] is not None else ''}"
            if at not in made:
                fs.create_dir(at, recursive=True)
                made.add(at)
            body = (r["body"] or "").encode()
            with fs.open_output_stream(f"{at}/{quote(r['event_id'], safe='')}-{r['part'] or 0:06d}.json") as out:
                out.write(body)
            files, size = files + 1, size + len(body)
        return Written(folder, files, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(f"{root}/commits", recursive=True)
        found = [{"folder": m.folder, "files": m.files, "size": m.size} for m in messages if m is not None and m.files]
        aside = f"{root}/commits/.{self.run}.tmp"
        with fs.open_output_stream(aside) as out:
            out.write(json.dumps(found).encode())
        fs.move(aside, f"{root}/commits/{self.run}.json")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        fs, root = _fs(self.path)
        if fs.get_file_info(f"{root}/data/{self.run}").type == FileType.Directory:
            fs.delete_dir(f"{root}/data/{self.run}")


class Pack(InputPartition):
    """Slices of task folders: (commit, folder, first file, last file)."""

    def __init__(self, slices: list[tuple[str, str, int, int]]):
        super().__init__(None)
        self.slices = slices


class EventReader(DataSourceReader):
    def __init__(self, path: str, files: int, size: int):
        self.path, self.files, self.size = path, files, size

    def partitions(self) -> list[Pack]:
        from pyarrow.fs import FileSelector

        fs, root = _fs(self.path)
        packs, now, files, size = [], [], 0, 0
        for info in sorted(fs.get_file_info(FileSelector(f"{root}/commits", allow_not_found=True)), key=lambda i: i.base_name):
            if not info.base_name.endswith(".json") or info.base_name.startswith("."):
                continue
            with fs.open_input_stream(info.path) as f:
                folders = json.loads(f.read())
            for m in folders:
                each = max(1, min(self.files, m["files"] * self.size // max(m["size"], 1)))
                for start in range(0, m["files"], each):
                    n = min(each, m["files"] - start)
                    if now and (files + n > self.files or size + m["size"] * n // m["files"] > self.size):
                        packs, now, files, size = [*packs, Pack(now)], [], 0, 0
                    now.append((info.base_name[:-5], m["folder"], start, start + n))
                    files, size = files + n, size + m["size"] * n // m["files"]
        return [*packs, Pack(now)] if now or not packs else packs

    def read(self, pack: Pack) -> Iterator[tuple]:
        from pyarrow.fs import FileSelector

        fs, root = _fs(self.path)
        for commit, folder, start, end in pack.slices:
            listed = sorted(i.path for i in fs.get_file_info(FileSelector(f"{root}/{folder}", recursive=True)) if i.is_file)
            for path in listed[start:end]:
                kind, domain, name = path.rsplit("/", 3)[1:] if path.rsplit("/", 3)[1] in KINDS else (path.rsplit("/", 2)[1], "", path.rsplit("/", 1)[1])
                event, part = name[:-5].rsplit("-", 1)
                with fs.open_input_stream(path) as f:
                    yield commit, unquote(domain[1:]) if domain else None, unquote(event), kind, int(part), f.read().decode()


class EventFiles(DataSource):
    """Spark format "event_files" with the option path: (run, domain, event_id, kind, part, body). Reading tasks take many small files;
    options packFiles and packBytes bound them."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"run string, {SCHEMA}"

    def reader(self, schema) -> EventReader:
        return EventReader(self.options["path"], int(self.options.get("packfiles", PACK_FILES)), int(self.options.get("packbytes", PACK_BYTES)))

    def writer(self, schema, overwrite: bool) -> EventWriter:
        return EventWriter(self.options["path"])


def write_documents(full: DataFrame, summary: DataFrame, path: str) -> None:
    """Writes full and summary documents (domain, event_id, maybe part, body) as files of path: all of them become visible together,
    or none if any task fails for good. Events written before stay until a later run writes them again. A document that is too
    large for one row comes in parts. The folder must be one that all executors share."""
    full.sparkSession.dataSource.register(EventFiles)
    shaped = lambda df, kind: df.select("domain", F.col("event_id").cast("string").alias("event_id"), F.lit(kind).alias("kind"),
                                        (F.col("part") if "part" in df.columns else F.lit(0)).cast("int").alias("part"), "body")
    shaped(full, "full").unionByName(shaped(summary, "summary")).write.format(FORMAT).mode("append").option("path", path).save()


def read_documents(spark: SparkSession, path: str, pack_files: int = PACK_FILES) -> DataFrame:
    """(domain, event_id, kind, part, body) of the newest run that wrote each event; a null domain is none. No committed run: no rows."""
    spark.dataSource.register(EventFiles)
    rows = spark.read.format(FORMAT).option("path", path).option("packFiles", str(pack_files)).load()
    newest = rows.groupBy(F.col("domain").alias("_d"), F.col("event_id").alias("_e")).agg(F.max("run").alias("_r"))
    on = F.col("domain").eqNullSafe(F.col("_d")) & (F.col("event_id") == F.col("_e")) & (F.col("run") == F.col("_r"))
    return rows.join(newest, on, "left_semi").drop("run")


def complete_events(spark: SparkSession, path: str) -> DataFrame:
    """(domain, event_id) of the events that have both documents: a run that resumes leaves these out."""
    kinds = read_documents(spark, path).select("domain", "event_id", "kind").distinct().groupBy("domain", "event_id").agg(F.count("*").alias("n"))
    return kinds.filter(F.col("n") == len(KINDS)).drop("n")
