"""A directory tree as a streaming source that goes on where it stopped.

    spark.dataSource.register(Listing)
    spark.readStream.format("listing").option("path", root).option("cursor", file).load()

The tree is walked folder by folder in the order of the names, so that a place in the
walk is one path: the last one taken. A pass takes at most ``entries`` entries (files
and folders both count) and ``bytes`` bytes; a file that would go beyond waits for the
next pass, unless it is the first of its pass. A pass that ends before the walk does is
PARTIAL, and its rows say so; the pass behind the last entry is COMPLETE, and the next
one begins at the top. Offsets hold the number of the walk, that of the pass, the place
and the status.

A trigger plans one pass. Its files are dealt over tasks, which read them; the driver
holds one pass and one folder for each level, never the tree. Python sources aren't told
where a query's checkpoint is when it starts again, so the end of the last pass that was
planned is kept in the small file ``cursor`` beside it. What a batch is, the checkpoint's
offsets decide: a batch that has to be done again has the same places, whatever the file says.

Files over ``largest`` bytes are listed without content, with an error, and so are those
that can't be read or are no longer what was listed when they have been read. Links, what
is neither file nor folder, and hidden names are passed over. A folder that can't be listed is a row with an
error. Paths are those of a file system that pyarrow knows and executors see.

With ``mark`` a pass has one row more, of the root, with its status and neither length nor
error, so that a pass without files is told of, too.

Cases: an empty tree gives no rows, and COMPLETE; a place whose file is gone is still a
place; files that come behind the place are in the same walk, those before it in the next;
names sort by their parts, so a folder's files stay together.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .extract import MAX_BYTES

#: What a pass takes, and how deep folders go.
MAX_ENTRIES, PASS_BYTES, MAX_DEPTH = 2000, 128 * 1024 * 1024, 64
SCHEMA = "path string, length long, modified timestamp, content binary, error string, walk long, number long, status string"
ARROW = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary()), ("error", pa.string()), ("walk", pa.int64()), ("number", pa.int64()), ("status", pa.string())])
#: Names that begin so are passed over, as by Spark's own file sources.
HIDDEN = (".", "_")
FLUSH_BYTES = 16 * 1024 * 1024


@dataclass(frozen=True)
class Entry:
    """A file, a folder (no length), or a folder that can't be listed (an error)."""

    path: str
    length: int | None = None
    modified: datetime | None = None
    error: str | None = None


@dataclass
class Slice(InputPartition):
    entries: list[Entry]
    offset: dict


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def walk(files: fs.FileSystem, folder: str, after: str | None, depth: int = MAX_DEPTH) -> Iterator[Entry]:
    """What is below ``folder`` and behind the path ``after``, in order; folders that end before it aren't listed."""
    place = after.split("/") if after is not None else None
    try:
        found = files.get_file_info(fs.FileSelector(folder, recursive=False))
    except OSError as e:
        yield Entry(folder, error=f"DIRECTORY_UNREADABLE: {type(e).__name__}")
        return
    for info in sorted(found, key=lambda i: i.base_name):
        if info.base_name.startswith(HIDDEN) or (isinstance(files, fs.LocalFileSystem) and os.path.islink(info.path)):
            continue
        parts = info.path.split("/")
        behind = place is None or parts > place
        if info.type == fs.FileType.File and behind:
            yield Entry(info.path, info.size, info.mtime)
        elif info.type == fs.FileType.Directory and depth and (behind or place[: len(parts)] == parts):
            if behind:
                yield Entry(info.path)
            yield from walk(files, info.path, None if behind else after, depth - 1)


class ListingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.cursor = options["path"], options.get("cursor")
        self.entries, self.bytes = int(options.get("entries", MAX_ENTRIES)), int(options.get("bytes", PASS_BYTES))
        self.largest, self.slices = int(options.get("largest", MAX_BYTES)), int(options.get("slices", 8))
        self.mark = options.get("mark", "false") == "true"
        self.at, self.planned = None, None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"walk": 1, "number": 0, "place": "", "status": "PARTIAL"}

    def _known(self) -> dict:
        if self.cursor:
            files, path = opened(self.cursor)
            if files.get_file_info(path).type == fs.FileType.File:
                with files.open_input_stream(path) as f:
                    return json.loads(f.read())
        return self.initialOffset()

    def _keep(self, offset: dict) -> None:
        if self.cursor:
            files, path = opened(self.cursor)
            with files.open_output_stream(f"{path}.new") as f:
                f.write(json.dumps(offset).encode())
            files.move(f"{path}.new", path)

    def _pass(self, start: dict) -> tuple[dict, list[Entry]]:
        """The pass behind ``start``: its end, and the rows that it has."""
        files, root = opened(self.root)
        again = start["status"] == "COMPLETE"
        at = {"walk": start["walk"] + again, "number": start["number"] + 1, "place": "" if again else start["place"], "status": "COMPLETE"}
        rows, visited, size = [], 0, 0
        for e in walk(files, root, at["place"] or None):
            more = e.length if e.length is not None and e.length <= self.largest else 0
            if visited >= self.entries or (rows and size + more > self.bytes):
                at["status"] = "PARTIAL"
                break
            visited, size = visited + 1, size + more
            if e.error is None:
                at["place"] = e.path
            if e.length is not None or e.error:
                rows.append(e)
        return at, rows

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = self.at or self._known()
        if self.planned is None or self.planned[0] != self.at:
            self.planned = (self.at, *self._pass(self.at))
        return self.planned[1]

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        if self.planned is not None and self.planned[:2] == (start, end):
            rows = self.planned[2]
        else:  # a batch that is done again
            files, root = opened(self.root)
            last, after = end["place"].split("/"), start["place"] if start["walk"] == end["walk"] and start["status"] == "PARTIAL" else ""
            rows = []
            for e in walk(files, root, after or None):
                if end["status"] == "PARTIAL" and e.path.split("/") > last:
                    break
                if e.length is not None or e.error:
                    rows.append(e)
        if self.mark:
            rows = [*rows, Entry(opened(self.root)[1])]
        self.at = end
        self._keep(end)
        return [Slice(rows[k :: self.slices], end) for k in range(min(self.slices, len(rows)))]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.root)
        offset, rows, size = partition.offset, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

        for e in partition.entries:
            content, error = None, e.error
            if error is None and e.length is not None and e.length > self.largest:
                error = "INPUT_SIZE_LIMIT"
            elif error is None and e.length is not None:
                try:
                    with files.open_input_stream(e.path) as f:
                        content = f.read()
                    now = files.get_file_info(e.path)
                    if (now.size, now.mtime) != (e.length, e.modified) or len(content) != e.length:
                        content, error = None, "CHANGED_WHILE_READ"
                except OSError:
                    error = "SCAN_UNAVAILABLE"
            rows.append((e.path, e.length, e.modified, content, error, offset["walk"], offset["number"], offset["status"]))
            size += len(content or b"")
            if size > FLUSH_BYTES:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ListingReader:  # noqa: N802
        return ListingReader(dict(self.options))
