"""Command logs as arrays of bulk strings (`*2\\r\\n$3\\r\\nGET\\r\\n...`): a Spark data source, read and write.

`spark.dataSource.register(CommandLog)`, then `format("command_log")` with a folder URI
that pyarrow.fs opens. A file is a partition; `pos` is the order of the whole log, if it
was written in order: the number of the file, times 2**40, and the place in it. Rows are
streamed, so memory is one command. A cut last command is an error unless the option
`tail` is `ignore`.

Each write is a commit with a number and a list of its files, put in place last: readers
see all of a write or nothing, an append follows what is there, and an overwrite hides
it. One writer at a time. A folder without commits, as other tools leave it, is read by
the names of its files.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def encode(argv: list[str]) -> bytes:
    parts = [a.encode() for a in argv]
    return b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%b\r\n" % (len(p), p) for p in parts)


def decode(stream, tail: str = "error") -> Iterator[list[str]]:
    """Commands of a binary file object, one by one."""

    def line(mark: bytes) -> int:
        got = stream.readline()
        if not got.endswith(b"\r\n"):
            raise EOFError
        if got[:1] != mark:
            raise ValueError(f"{mark!r} wanted, got {got[:20]!r}")
        return int(got[1:])

    while head := stream.readline():
        try:
            if not head.endswith(b"\r\n"):
                raise EOFError
            if head[:1] != b"*":
                raise ValueError(f"b'*' wanted, got {head[:20]!r}")
            argv = []
            for _ in range(int(head[1:])):
                n = line(b"$")
                data = stream.read(n + 2)
                if len(data) < n + 2:
                    raise EOFError
                argv.append(data[:n].decode("utf-8", "replace"))
        except EOFError:
            if tail == "ignore":
                return
            raise ValueError("the last command is cut short") from None
        yield argv


def commits(fs: pafs.FileSystem, root: str) -> list[tuple[int, dict]]:
    """(number, {files, overwrite}) in order."""
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/_commits", allow_not_found=True)) if f.base_name.endswith(".json")]
    out = []
    for path in sorted(found):
        with fs.open_input_stream(path) as f:
            out.append((int(path.rsplit("/", 1)[1].removesuffix(".json")), json.loads(f.read())))
    return out


def listed(fs: pafs.FileSystem, root: str) -> list[str]:
    """Names of the log's files in order."""
    known = commits(fs, root)
    if not known:
        files = fs.get_file_info(pafs.FileSelector(root))
        return sorted(f.base_name for f in files if f.is_file and not f.base_name.startswith(("_", ".")))
    first = max((i for i, (_, c) in enumerate(known) if c["overwrite"]), default=0)
    return [name for _, c in known[first:] for name in c["files"]]


class _File(InputPartition):
    def __init__(self, path: str, name: str, number: int) -> None:
        super().__init__(path)
        self.name, self.number = name, number


class _Reader(DataSourceReader):
    def __init__(self, path: str, tail: str) -> None:
        self.path, self.tail = path, tail

    def partitions(self) -> list[_File]:
        fs, path = pafs.FileSystem.from_uri(self.path)
        return [_File(f"{path}/{name}", name, i) for i, name in enumerate(listed(fs, path))]

    def read(self, partition: _File) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.value) as f:
            for pos, argv in enumerate(decode(io.BufferedReader(f, 1 << 20), self.tail)):
                yield partition.name, (partition.number << 40) + pos, argv


class _Written(WriterCommitMessage):
    def __init__(self, part: int, name: str) -> None:
        self.part, self.name = part, name


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(f"{root}/_commits", recursive=True)

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(self.path)
        part = TaskContext.get().partitionId()
        name = f"log-{uuid.uuid4().hex}-{part:06d}"
        with fs.open_output_stream(f"{root}/{name}") as f:
            for r in rows:
                f.write(encode(list(r["argv"])))
        return _Written(part, name)

    def commit(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        known = commits(fs, root)
        files = [m.name for m in sorted((m for m in messages if m is not None), key=lambda m: m.part)]
        if not known and not self.overwrite:  # files of other tools that lay here before stay part of the log
            files = [n for n in listed(fs, root) if n not in files and not n.startswith("log-")] + files
        number = known[-1][0] + 1 if known else 0
        temporary = f"{root}/_commits/{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(temporary) as out:
            out.write(json.dumps({"overwrite": self.overwrite, "files": files}).encode())
        fs.move(temporary, f"{root}/_commits/{number:012d}.json")

    def abort(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.name}")


class CommandLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "command_log"

    def schema(self) -> str:
        return "file string, pos long, argv array<string>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("tail", "error"))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)
