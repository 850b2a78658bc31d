"""A folder of files as a data source: read in ranges, written one file for each row.

For folders that all machines mount under one path. Stores that only Spark reaches are read by
``files.read_files`` through Spark's own binary reader.
"""

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
    StringEndsWith, StringStartsWith, WriterCommitMessage,
)

#: Bytes that tell a type, and how many more are looked at where the type is an old office file's.
HEAD, LONG_HEAD = 4096, 1 << 20
#: First bytes of files whose content is read, though it is no text. Fixed values.
READ_STARTS = (b"PK\x03\x04", b"\x89PNG", b"\xff\xd8\xff", b"GIF8", b"RIFF")
#: First bytes of files that nothing here reads. Fixed values.
REFUSED_STARTS = (b"%PDF", b"\xd0\xcf\x11\xe0")
#: Bytes of files that one task reads, unless a single file is longer.
TASK_BYTES = 32 << 20
FILES = "name string, length long, head binary, content binary, n_read long"
_COMPARE = {EqualTo: "__eq__", LessThan: "__lt__", LessThanOrEqual: "__le__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", StringStartsWith: "startswith", StringEndsWith: "endswith"}


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(None)


def plain_path(path: str) -> str | None:
    """The path as the machine's own, or null for another store's."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return path if "://" not in path and path.startswith("/") else None


class FolderReader(DataSourceReader):
    """One row per file below a folder, as FILES.

    Partitions are planned from the listing, by bytes. Of every file the first bytes are read; the rest only where the length
    is within ``most_bytes`` and those first bytes are a text's or a readable format's. ``n_read`` says how much it was.
    Conditions on name and length are answered from the listing.
    """

    def __init__(self, options: dict):
        self.top, self.most, self.filters = plain_path(options["path"]), int(options.get("most_bytes", 25 << 20)), []
        self.every_type = str(options.get("every_type", "false")).lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _COMPARE and f.attribute in (("name",), ("length",)):
                self.filters.append((f.attribute[0], _COMPARE[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        bins, size = [], TASK_BYTES
        for folder, _, names in sorted(os.walk(self.top)):
            for name in sorted(names):
                path = os.path.join(folder, name)
                if not os.path.isfile(path):
                    continue
                length = os.path.getsize(path)
                facts = {"name": path, "length": length}
                if not all(getattr(facts[c], op)(v) for c, op, v in self.filters):
                    continue
                if size + min(length, self.most) > TASK_BYTES:
                    bins.append(Files())
                    size = 0
                bins[-1].files.append((path, length))
                size += min(length, self.most)
        return bins or [Files()]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, length in partition.files:
            with open(path, "rb", buffering=0) as f:
                head = f.read(HEAD)
                if length <= self.most and (self.every_type or not refused(head)):
                    content = head + f.read() if length > len(head) else head
                    yield path, length, head, content, len(content)
                else:
                    if head.startswith(REFUSED_STARTS):
                        head += f.read(LONG_HEAD - len(head))
                    yield path, length, head, None, len(head)


def refused(head: bytes) -> bool:
    """Whether the first bytes are of a format that is not read, or of none that is known."""
    if head.startswith(READ_STARTS):
        return False
    if head.startswith(REFUSED_STARTS) or b"\0" in head:
        return True
    controls = sum(b < 9 or 14 <= b < 32 or b == 11 for b in head)
    return controls > 0.05 * len(head)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FolderWriter(DataSourceWriter):
    """Rows (name, content) as files of a folder, all or none of which appear.

    A task writes under names of its own in a hidden folder; when all tasks are done, each file is renamed to its
    place, and an aborted job leaves nothing behind. A name stays below the folder and is written by one row.
    """

    def __init__(self, options: dict, columns: list[str]):
        self.top, self.columns = plain_path(options["path"]), columns
        self.held = os.path.join(self.top, f".writing-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.held, exist_ok=True)
        done = []
        for row in iterator:
            name, content = row["name"], row["content"]
            target = os.path.normpath(os.path.join(self.top, name))
            if os.path.isabs(name) or not target.startswith(self.top.rstrip("/") + "/"):
                raise ValueError(f"{name} leaves the folder")
            own = os.path.join(self.held, uuid.uuid4().hex)
            with open(own, "wb") as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            done.append((own, target))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        moves = [m for message in messages if message for m in message.files]
        if len({target for _, target in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        for own, target in moves:
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.replace(own, target)
        self._tidy()

    def abort(self, messages: list[Written | None]) -> None:
        self._tidy()

    def _tidy(self) -> None:
        if os.path.isdir(self.held):
            for name in os.listdir(self.held):
                os.unlink(os.path.join(self.held, name))
            os.rmdir(self.held)


class Folder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidentia_folder"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options, schema.fieldNames())
