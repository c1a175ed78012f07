"""A Spark data source that walks payload files and yields their records one by one.

For files too large for a row: neither a file nor its record list is ever held as a whole, only the record
that is being read. A file is walked once to see whether it can be read to its end and once more to
hand on its records, so a broken file gives one error and no records, as it does when read as a whole.
"""
from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, pos long, value string, error string"
INVALID, NO_LIST = "invalid JSON", "no readable record list"
READ_CHARS = 1 << 20
BATCH_CHARS = 4 << 20
#: An error so close to the end of what was read may be due to the cut.
CUT_CHARS = 16


class NoRecords(Exception):
    """Valid so far, but without the record list."""


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


class Walker:
    """JSON values of a text stream, one after the other, with what was read of them kept no longer than needed."""

    def __init__(self, stream: io.TextIOBase) -> None:
        self.stream, self.text, self.at, self.ended = stream, "", 0, False
        self.decode = json.JSONDecoder(parse_constant=_no_constant).raw_decode

    def more(self) -> bool:
        # at least as much again as is held, so that a long value is tried a logarithmic number of times
        new = self.stream.read(max(READ_CHARS, len(self.text) - self.at))
        self.text, self.at, self.ended = self.text[self.at :] + new, 0, not new
        return not self.ended

    def peek(self) -> str:
        """The next character that isn't blank; empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def take(self, wanted: str) -> str:
        found = self.peek()
        if not found or found not in wanted:
            raise ValueError(f"expected one of {wanted}")
        self.at += 1
        return found

    def value(self) -> str:
        self.peek()
        while True:
            try:
                _, end = self.decode(self.text, self.at)
                if self.ended or self.text[end : end + 1].strip(" \t\r\n,:]}") == "" < self.text[end : end + 1]:
                    break
                if len(self.text) - end > CUT_CHARS:
                    raise ValueError("text behind a value")
            except json.JSONDecodeError as error:
                cut = error.msg.startswith("Unterminated string") or len(self.text) - error.pos <= CUT_CHARS
                if self.ended or not cut:
                    raise
            self.more()  # a value, or a number that may go on, is cut off where reading has stopped
        out, self.at = self.text[self.at : end], end
        return out


def _listed(walk: Walker) -> Iterator[str]:
    walk.take("[")
    if walk.peek() == "]":
        walk.take("]")
        return
    while True:
        yield walk.value()
        if walk.take(",]") == "]":
            return


def records(stream: io.TextIOBase, key: str | None) -> Iterator[str]:
    """The texts of the records under ``key`` of an object, or of the list that is the whole text."""
    walk, found = Walker(stream), False
    start = walk.peek()
    if start == "[" and key is None:
        found = True
        yield from _listed(walk)
    elif start == "{" and key is not None:
        walk.take("{")
        more = walk.peek() != "}" or walk.take("}") == ""
        while more:
            name = json.loads(walk.value())
            walk.take(":")
            if name == key and walk.peek() == "[":
                found = True
                yield from _listed(walk)
            else:
                walk.value()
            more = walk.take(",}") == ","
    else:
        walk.value()
    if walk.peek():
        raise ValueError("text behind the value")
    if not found:
        raise NoRecords


class PayloadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.key = options["path"], options.get("key") or None
        self.scheme = self.path.split(":", 1)[0] if ":" in self.path.split("/", 1)[0] else "file"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path if ":" in self.path.split("/", 1)[0] else f"file://{self.path}")

    def partitions(self) -> list[InputPartition]:
        """A file each; names that begin with a dot or an underscore aren't data."""
        store, root = self._store()
        if store.get_file_info(root).is_file:
            return [InputPartition(root)]
        found = [f.path for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]
        return [InputPartition(p) for p in sorted(found) if not any(x[:1] in "._" for x in p[len(root) :].strip("/").split("/"))]

    def _open(self, path: str) -> io.TextIOBase:
        return io.TextIOWrapper(self._store()[0].open_input_stream(path), encoding="utf-8", errors="replace")

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path = partition.value
        file = f"{self.scheme}://{path}"
        try:
            with self._open(path) as stream:
                for _ in records(stream, self.key):
                    pass
        except (ValueError, RecursionError):
            yield self._batch(file, [None], [None], INVALID)
            return
        except NoRecords:
            yield self._batch(file, [None], [None], NO_LIST)
            return
        places: list[int] = []
        texts: list[str] = []
        size = 0
        with self._open(path) as stream:
            for pos, text in enumerate(records(stream, self.key)):
                places.append(pos)
                texts.append(text)
                size += len(text)
                if size >= BATCH_CHARS:
                    yield self._batch(file, places, texts)
                    places, texts, size = [], [], 0
        yield self._batch(file, places, texts)

    @staticmethod
    def _batch(file: str, places: list, texts: list, error: str | None = None) -> pa.RecordBatch:
        n = len(places)
        columns = [[file] * n, places, texts, [error] * n]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "pos", "value", "error"])


class PayloadSource(DataSource):
    """``spark.read.format("payload_records").option("key", "jobs").load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "payload_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PayloadReader(dict(self.options))
