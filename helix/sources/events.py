"""Worker events as a stream with offsets of its own: spark.readStream.format("event_lines").

An offset is, for each file of a folder, the byte after the last complete line that was seen, so files may grow between batches: a line that isn't ended
yet waits, and none is lost or read twice. A line is held up to its bound only; what it has beyond is counted, not kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from helix.sources.storage import files, opened

#: Bytes of a line at most, and of a read.
LONGEST, BLOCK = 64 << 10, 1 << 16


def after_last_line(path: str, start: int, size: int) -> int:
    """The place after the last line end from start on; start if there is none."""
    with opened(path) as f:
        at = size
        while at > start:
            first = max(start, at - BLOCK)
            f.seek(first)
            found = f.read(at - first).rfind(b"\n")
            if found >= 0:
                return first + found + 1
            at = first
    return start


def lines(path: str, start: int, end: int, longest: int = LONGEST) -> Iterator[tuple[int, bytes, int]]:
    """The lines between two places, which begin and end lines: where each begins, its bytes (longest + 1 at most), and how many it has."""
    with opened(path) as f:
        f.seek(start)
        at, held, size, begin = start, b"", 0, start
        while at < end and (block := f.read(min(BLOCK, end - at))):
            at += len(block)
            *ended, rest = block.split(b"\n")
            for part in ended:
                held += part[: longest + 1 - len(held)]
                size += len(part)
                yield begin, held, size
                begin += size + 1
                held, size = b"", 0
            held += rest[: longest + 1 - len(held)]
            size += len(rest)
        if size:  # the last line of a file that is complete as it is
            yield begin, held, size


class Stretch(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class EventReader(DataSourceStreamReader):
    """Options: path; complete: whether files don't grow any more, so that a last line without an end is one."""

    def __init__(self, options: dict):
        self.path, self.complete = options["path"], options.get("complete") == "true"
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        for path, size in files(self.path):
            start = self.known.get(path, 0)
            self.known[path] = size if self.complete else after_last_line(path, start, size)
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.known = {**before, **after, **self.known}
        return [Stretch(p, before.get(p, 0), to) for p, to in after.items() if to > before.get(p, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        for at, line, size in lines(partition.path, partition.start, partition.end):
            yield partition.path, at, size, line.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class EventSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return "file string, place long, bytes long, value string"

    def streamReader(self, schema) -> EventReader:
        return EventReader(self.options)
