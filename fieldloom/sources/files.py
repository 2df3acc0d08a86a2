"""Folders of document files as a Spark data source: ``spark.read.format("document_files")``, and the writer to match.

Reading lists the folder (one folder after another, local ones entry by entry), deals the files out to tasks by bytes, and gives
a row for each: doc_id (hash of the path below
the folder), path (below the folder), name, format (by the ending, in any case), size (bytes), content and error. Bytes become text
by their byte order mark, else by the encoding that an XML declaration names, else by where the first four bytes are
zero, else as UTF-8; what can't be decoded is a row with an error. A file of another ending fails the read, or is a row
with an error if ``unknown`` is ``reject``. Files whose name begins with a dot or underscore are not read.

Writing (columns path and content, text or bytes) makes a file of each row. A file gets its name only when it is whole,
so readers never see a part of it and a task that is run again replaces its files by equal ones; ``_SUCCESS`` is written
when all tasks are done. Two rows of one path fail the write.

Neither way holds the paths of all files in the driver: what it deals out are packed names (some 4 bytes a file), and tasks leave the
hashes and names of what they wrote in a hidden folder, where they are compared range by range.

Paths may be local or any that pyarrow's file systems open (s3, gs, hdfs); all tasks must see them. Options: ``path``,
``unknown`` (error or reject), ``splitBytes`` (of files dealt to one task), ``endings`` (JSON: ending to format), ``formats``
(by commas: files of other formats aren't opened).
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..plans.storage import dealt, shuffles_dropped
from .documents import FORMATS

SCHEMA = "doc_id long, path string, name string, format string, size long, content string, error string"
SPLIT_BYTES = 64 << 20
#: Paths that are packed, and hashes of paths that are compared, at once.
PACKED, COMPARED = 4096, 1 << 20
#: Longer marks first: that of UTF-32 begins like that of UTF-16.
_MARKS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
#: Which of the first four bytes of a text that begins with ASCII are not zero.
_ZEROS = {(False, False, False, True): "utf-32-be", (True, False, False, False): "utf-32-le", (False, True, False, True): "utf-16-be", (True, False, True, False): "utf-16-le"}
_DECLARED = re.compile(rb"""^\s*<\?xml[^>]*?\bencoding\s*=\s*["']([A-Za-z][A-Za-z0-9._-]*)["']""")


def encoding_of(data: bytes, kind: str | None) -> str:
    for mark, name in _MARKS:
        if data.startswith(mark):
            return name
    if len(data) >= 4 and (name := _ZEROS.get(tuple(b != 0 for b in data[:4]))):
        return name
    declared = _DECLARED.match(data[:1000]) if kind == "xml" else None
    return declared[1].decode() if declared else "utf-8"


def decoded(data: bytes, kind: str | None) -> tuple[str | None, str | None]:
    """(text, error) of the bytes of a file."""
    name = encoding_of(data, kind)
    try:
        return data.decode(name), None
    except (UnicodeDecodeError, LookupError) as e:
        return None, f"not readable as {name}: {e}"[:500]


def opened(path: str):
    """The pyarrow file system of a path and the path there."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def listed(store, top: str) -> Iterator[tuple[str, int]]:
    """Path below top and bytes of each file, but for hidden ones. Of a local folder no more than an entry is held, else one folder's."""
    from pyarrow.fs import FileSelector, FileType, LocalFileSystem

    def entries(folder: str) -> Iterator[tuple[str, bool, int]]:
        if isinstance(store, LocalFileSystem):
            with os.scandir(folder) as found:
                for e in found:
                    with suppress(FileNotFoundError):  # it may go meanwhile
                        if e.is_dir() or e.is_file():
                            yield e.name, e.is_dir(), e.stat().st_size
        else:
            for f in store.get_file_info(FileSelector(folder)):
                if f.type in (FileType.Directory, FileType.File):
                    yield f.base_name, f.type == FileType.Directory, f.size or 0

    top = top.rstrip("/")
    pending = [""]
    while pending:
        below = pending.pop()
        deeper = []
        for name, is_folder, n in entries(f"{top}/{below}"):
            if name.startswith((".", "_")):
                continue
            if is_folder:
                deeper.append(f"{below}{name}/")
            else:
                yield below + name, n
        pending += sorted(deeper, reverse=True)


@dataclass
class Files(InputPartition):
    """Files of one task: paths below the folder, packed."""

    packs: list[bytes] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(None)

    def pack(self, paths: list[str]) -> None:
        if paths:
            self.packs.append(zlib.compress("\0".join(sorted(paths)).encode()))

    @property
    def paths(self) -> Iterator[str]:
        for pack in self.packs:
            yield from zlib.decompress(pack).decode().split("\0")


class FileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.unknown = options.get("unknown", "error")
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.endings = json.loads(options["endings"]) if "endings" in options else FORMATS
        self.formats = set(options["formats"].split(",")) if "formats" in options else None
        if self.unknown not in ("error", "reject"):
            raise ValueError("unknown must be error or reject")

    def format_of(self, path: str) -> str | None:
        name, dot, ending = path.rpartition("/")[2].rpartition(".")
        return self.endings.get(ending.casefold()) if dot and name else None

    def partitions(self) -> list[Files]:
        strange, first = 0, None
        out, held, paths = [Files()], 0, []
        for p, n in listed(*opened(self.path)):
            kind = self.format_of(p)
            if kind is None:
                strange, first = strange + 1, p if first is None else min(first, p)
            if self.formats is not None and kind not in self.formats:
                continue
            over = held and held + n > self.split
            if over or len(paths) == PACKED:
                out[-1].pack(paths)
                paths = []
            if over:
                out.append(Files())
                held = 0
            paths.append(p)
            held += n
        out[-1].pack(paths)
        if strange and self.unknown == "error":
            raise ValueError(f"{strange} files have an ending that isn't read, the first is {first}")
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        import xxhash

        store, top = opened(self.path)
        for p in partition.paths:
            kind = self.format_of(p)
            with store.open_input_stream(f"{top.rstrip('/')}/{p}") as f:
                data = f.read()
            content, error = (None, "the ending isn't read") if kind is None else decoded(data, kind)
            yield xxhash.xxh64_intdigest(p.encode(), 42) - (1 << 63), p, p.rpartition("/")[2], kind, len(data), content, error


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: how many files, and where their names and the sorted hashes of their paths are."""

    files: int
    noted: str


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        if not {"path", "content"} <= set(columns):
            raise ValueError("path and content are written")
        self.path = options["path"]
        _, top = opened(self.path)
        self.top = top.rstrip("/")
        self.notes = f"{self.top}/_written-{uuid.uuid4().hex}"  # of all tasks and attempts of this write

    def write(self, iterator: Iterator) -> Written:
        store, _ = opened(self.path)
        noted = f"{self.notes}/{uuid.uuid4().hex}"
        names, hashes = None, bytearray()
        try:
            for row in iterator:
                if not row.path or any(x in ("", ".", "..") for x in row.path.split("/")):
                    raise ValueError(f"{row.path!r} is no path below a folder")
                folder, _, name = f"{self.top}/{row.path}".rpartition("/")
                store.create_dir(folder, recursive=True)
                content = row.content or b""
                whole(store, f"{folder}/{name}", [content.encode() if isinstance(content, str) else bytes(content)])
                if names is None:
                    store.create_dir(self.notes, recursive=True)
                    names = store.open_output_stream(f"{noted}.names")
                names.write(row.path.encode() + b"\0")
                hashes += hashlib.blake2b(row.path.encode(), digest_size=16).digest()
        finally:
            if names:
                names.close()
        if hashes:
            with store.open_output_stream(f"{noted}.hashes") as f:
                f.write(_in_order(np.frombuffer(hashes, "<u8").reshape(-1, 2)).tobytes())
        return Written(len(hashes) // 16, noted)

    def _repeated(self, store, messages: list[Written]) -> bool:
        """Whether two files have one path: the sorted hashes of all tasks are compared range by range."""
        ranges = sum(m.files for m in messages) // COMPARED + 1
        at = [0] * len(messages)
        for i in range(1, ranges + 1):
            parts = []
            for k, m in enumerate(messages):
                with store.open_input_file(f"{m.noted}.hashes") as f:
                    f.seek(at[k])
                    while data := f.read(16 * (m.files // ranges + 256)):
                        part = np.frombuffer(data, "<u8").reshape(-1, 2)
                        part = part if i == ranges else part[: np.searchsorted(part[:, 0], np.uint64((i << 64) // ranges))]
                        parts.append(part)
                        at[k] += part.nbytes
                        if part.nbytes < len(data):
                            break
            here = _in_order(np.concatenate(parts)) if parts else np.empty((0, 2), "<u8")
            if (here[1:] == here[:-1]).all(axis=1).any():
                return True
        return False

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        there = [m for m in messages if m and m.files]
        store.create_dir(self.top, recursive=True)
        if self._repeated(store, there):
            raise ValueError("two rows have one path")
        whole(store, f"{self.top}/_SUCCESS", [str(sum(m.files for m in there)).encode()])
        self._forget(store)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = opened(self.path)
        for m in messages:
            if m and m.files:
                with store.open_input_stream(f"{m.noted}.names") as f:
                    rest = b""
                    while data := f.read(1 << 20):
                        *names, rest = (rest + data).split(b"\0")
                        for p in names:
                            with suppress(FileNotFoundError):  # another row's of the same path
                                store.delete_file(f"{self.top}/{p.decode()}")
        self._forget(store)

    def _forget(self, store) -> None:
        from pyarrow.fs import FileType

        if store.get_file_info(self.notes).type == FileType.Directory:
            store.delete_dir(self.notes)


def _in_order(hashes: np.ndarray) -> np.ndarray:
    return hashes[np.lexsort((hashes[:, 1], hashes[:, 0]))]


def whole(store, path: str, parts) -> None:
    """Write a file under another name, then give it its own."""
    folder, _, name = path.rpartition("/")
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as f:
        for p in parts:
            f.write(p)
    store.move(hidden, path)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(self.options)

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, schema.fieldNames())


@dataclass
class Parts(WriterCommitMessage):
    task: int
    sections: list[int]
    folder: str


class DocumentWriter(DataSourceWriter):
    """Rows of section, item and text, in order from task to task, to one document: for each section its opening text,
    its items with a separator between them, and its closing text. A row begins an item (``item``) or goes on with the one before, so
    an item may be of any number of rows and tasks. Each task writes a part of each section that it holds; when all are
    done the parts are copied behind each other, piece by piece, under a hidden name, and the document gets its name
    last. A part is deleted once it is copied, so that the disk never holds the document twice. Only parts of tasks that were committed are used, so a task may be run again."""

    SEPARATOR, PIECE = b",\n", 1 << 20

    def __init__(self, options: dict):
        self.path = options["path"]
        self.frame = json.loads(options["frame"])
        _, target = opened(self.path)
        folder, _, name = target.rpartition("/")
        self.parts = f"{folder}/.{name}.parts-{uuid.uuid4().hex}"  # of all tasks and attempts of this write

    def write(self, iterator: Iterator) -> Parts:
        from pyspark import TaskContext

        store, _ = opened(self.path)
        folder = f"{self.parts}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        sections: list[int] = []
        out = None
        try:
            for row in iterator:
                if not sections or row.section != sections[-1]:
                    if row.section in sections or not 0 <= row.section < len(self.frame):
                        raise ValueError(f"section {row.section} is out of order")
                    if out:
                        out.close()
                    sections.append(row.section)
                    out = store.open_output_stream(f"{folder}/{row.section}")
                out.write((self.SEPARATOR if row.item else b"") + row.text.encode())
        finally:
            if out:
                out.close()
        return Parts(TaskContext.get().partitionId(), sections, folder)

    def _pieces(self, store, messages: list[Parts]) -> Iterator[bytes]:
        for section, (opens, closes) in enumerate(self.frame):
            yield opens.encode()
            skip = len(self.SEPARATOR)  # none before the first item
            for m in sorted(messages, key=lambda m: m.task):
                if section in m.sections:
                    with store.open_input_stream(f"{m.folder}/{section}") as f:
                        f.read(skip)
                        while piece := f.read(self.PIECE):
                            yield piece
                    store.delete_file(f"{m.folder}/{section}")
                    skip = 0
            yield closes.encode()

    def commit(self, messages: list[Parts | None]) -> None:
        store, target = opened(self.path)
        there = [m for m in messages if m]
        store.create_dir(target.rpartition("/")[0], recursive=True)
        whole(store, target, self._pieces(store, there))
        self.abort(messages)

    def abort(self, messages: list[Parts | None]) -> None:
        from pyarrow.fs import FileType

        store, _ = opened(self.path)
        if store.get_file_info(self.parts).type == FileType.Directory:
            store.delete_dir(self.parts)


class OrderedDocument(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def register(spark: SparkSession) -> SparkSession:
    for kind in (DocumentFiles, OrderedDocument):
        spark.dataSource.register(kind)
    return spark


def read_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return register(spark).read.format("document_files").options(**options).load(path)


def write_files(files: DataFrame, path: str) -> None:
    """files: path (below the folder), content. Rows of one small table are millions of files, so they are dealt to all cores."""
    register(files.sparkSession)
    dealt(files.select("path", "content")).write.format("document_files").mode("append").save(path)


def write_document(rows: DataFrame, path: str, frame: list[tuple[str, str]], *order: str) -> None:
    """rows (section, item, text, and the columns of order) as one document; frame: what opens and closes each section."""
    register(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "section", *order).sortWithinPartitions("section", *order).select("section", "item", "text")
    with shuffles_dropped(rows.sparkSession):
        ordered.write.format("ordered_document").option("frame", json.dumps(frame)).mode("append").save(path)
