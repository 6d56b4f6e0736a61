"""A queue of messages in the shared folder as a Python data source: a stream writer that appends, and a stream reader
that takes at most ``most`` messages a batch and hears when they are done with.

A batch of the writer is one entry of the queue's log, named by the writer's batch number, so a batch that is repeated
appends nothing. Offsets count messages. A reader's batch is a range of offsets, taken by one task; a micro-batch may hold
several batches that are taken side by side (``ahead``). Until the stream commits it the messages stay, so a batch that fails is read again, and what is committed is taken away. Files are opened where they are
read, in whatever store the path names; the driver sees the log alone, one small entry a batch that isn't taken yet.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from itertools import batched

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

SCHEMA = "id string, text string, labels array<string>"
#: Messages of a batch, and of a file: a file is read whole for every batch that takes some of it.
MOST, FILE = 100, 2000


class Store:
    """A folder: messages in data/, the log in log/, how far the reader is in done."""

    def __init__(self, path: str):
        self.files, self.root = fs.FileSystem.from_uri(path)

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written aside, then moved."""
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        self.files.create_dir(f"{self.root}/aside")
        with self.files.open_output_stream(aside) as f:
            f.write(text.encode())
        self.files.create_dir(f"{self.root}/{name}".rpartition("/")[0])
        self.files.move(aside, f"{self.root}/{name}")

    def read(self, name: str) -> str | None:
        try:
            with self.files.open_input_stream(f"{self.root}/{name}") as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def remove(self, name: str) -> None:
        if self.files.get_file_info(f"{self.root}/{name}").type != fs.FileType.NotFound:
            self.files.delete_file(f"{self.root}/{name}")

    def log(self) -> list[tuple[str, int, list[tuple[str, int]]]]:
        """(entry, first offset, files with their numbers of messages) of entries that aren't taken away, in order."""
        found = self.files.get_file_info(fs.FileSelector(f"{self.root}/log", allow_not_found=True))
        entries = sorted(f.base_name for f in found if f.type == fs.FileType.File)
        return [(name, x["first"], [tuple(p) for p in x["files"]]) for name in entries if (x := json.loads(self.read(f"log/{name}") or "null"))]

    def end(self) -> int:
        """The offset after the last message."""
        log = self.log()
        return log[-1][1] + sum(n for _, n in log[-1][2]) if log else int(self.read("done") or 0)


class Written(WriterCommitMessage):
    """The files of a task with their numbers of messages."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class Writer(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        store, files = Store(self.path), []
        lines = (json.dumps({"id": r["id"], "text": r["text"], "labels": r["labels"]}) for r in iterator)
        for some in batched(lines, FILE):
            files.append((f"data/{uuid.uuid4().hex}", len(some)))
            store.write(files[-1][0], "\n".join(some))
        return Written(files)

    def commit(self, messages, batchId: int) -> None:  # noqa: N803
        store, entry = Store(self.path), f"{batchId:020}"
        files = [f for m in messages if m is not None for f in m.files]
        if store.read(f"log/{entry}") is not None or store.read("last") == entry:
            for name, _ in files:  # a batch that was repeated
                store.remove(name)
        elif files:
            store.write(f"log/{entry}", json.dumps({"first": store.end(), "files": files}))
            store.write("last", entry)

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        for m in messages:
            for name, _ in m.files if m is not None else []:
                Store(self.path).remove(name)


class Range(InputPartition):
    """A batch: some messages of some files, (name, first, last)."""

    def __init__(self, pieces: list[tuple[str, int, int]]):
        super().__init__(None)
        self.pieces = pieces


class Reader(DataSourceStreamReader):
    def __init__(self, path: str, most: int, ahead: int = 1):
        self.path, self.most, self.ahead, self.at = path, most, ahead, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"offset": int(Store(self.path).read("done") or 0)}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.at is None:
            self.at = self.initialOffset()["offset"]
        self.at = min(self.at + self.most * self.ahead, Store(self.path).end())
        return {"offset": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = end["offset"]
        batches: dict[int, list] = {}
        for _, at, files in Store(self.path).log():
            for name, n in files:
                lo, last = max(at, start["offset"]), min(at + n, end["offset"])
                while lo < last:
                    number = (lo - start["offset"]) // self.most
                    hi = min(last, start["offset"] + (number + 1) * self.most)
                    batches.setdefault(number, []).append((name, lo - at, hi - at))
                    lo = hi
                at += n
        return [Range(pieces) for pieces in batches.values()]

    def read(self, partition: Range) -> Iterator[tuple]:
        for name, first, last in partition.pieces:
            for line in (Store(self.path).read(name) or "").split("\n")[first:last]:
                m = json.loads(line)
                yield m["id"], m["text"], m["labels"]

    def commit(self, end: dict) -> None:
        """Messages before ``end`` are done with; files and entries go once all of theirs are."""
        store = Store(self.path)
        store.write("done", str(end["offset"]))
        for entry, at, files in store.log():
            if at + sum(n for _, n in files) <= end["offset"]:
                for name, _ in files:
                    store.remove(name)
                store.remove(f"log/{entry}")


class Queue(DataSource):
    """Options: path, most, ahead."""

    @classmethod
    def name(cls) -> str:
        return "message_queue"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> Reader:  # noqa: N802
        return Reader(self.options["path"], int(self.options.get("most", MOST)), int(self.options.get("ahead", 1)))

    def streamWriter(self, schema: StructType, overwrite: bool) -> Writer:  # noqa: N802
        return Writer(self.options["path"])


def push(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of messages (SCHEMA) to the end of the queue: what is there now."""
    messages.sparkSession.dataSource.register(Queue)
    return messages.writeStream.format("message_queue").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def take(spark: SparkSession, path: str, most: int = MOST, ahead: int = 1) -> DataFrame:
    """The queue as a stream of messages, ``most`` a batch. A micro-batch takes up to ``ahead`` batches, each a task that
    writes a file of its own, and acknowledges them together: what a micro-batch costs is shared by them."""
    spark.dataSource.register(Queue)
    return spark.readStream.format("message_queue").option("path", path).option("most", most).option("ahead", ahead).load()


def drain(messages: DataFrame, path: str, checkpoint: str, each: Callable[[int], None] | None = None) -> None:
    """All that a stream of messages has now, to a folder a batch, so a batch that is repeated overwrites its own.
    ``each`` is told a batch's number before it is written."""

    def write(batch: DataFrame, number: int) -> None:
        if each:
            each(number)
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
