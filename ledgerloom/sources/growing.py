"""Logs that grow, as a stream of their whole lines, each once: a streaming data source that remembers how far it has read.

What a batch reads is planned on the driver: files are listed, links and other names of one file (the same device and inode) count
once under the name that came first, and a file that has grown is read from its old end to its last line end, so a line that a
tool is still writing waits for the next batch. A file that shrank, begins otherwise than before, or was read by an older version
of the parser is read anew, as its next generation. The plan, a row a file that changed, is written below `state` before its number
becomes the offset of the stream: a batch that is run again reads the same bytes, and a restart goes on with the last plan.
`state` belongs beside the stream's checkpoint, where a new driver finds it.

A file gives at most `max_bytes` a batch (cut at a line end), and a long range is read by many tasks, a piece each; short ones are put together for a task. Files have to lie
where the executors can open them: paths, or addresses that pyarrow knows (of stores without links, where a name is a file).
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: file: the first name; generation: how often it was begun anew; since: where the batch began to read it; place: where a line starts.
LINES = "identity string, file string, generation int, since long, place long, line string"
#: Bytes of a task, of a block in the search for line ends, and of a file's beginning that is remembered; plans between snapshots.
PIECE, BLOCK, HEAD, SNAPSHOT = 32 << 20, 1 << 16, 256, 50
#: How small pieces are put together for a task (see `packed`), and threads that plan.
SHARE, LEAST, SMALL, THREADS = 64, 1 << 20, 1 << 14, 16


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _found(path: str, glob: str) -> list[tuple[str, str, int, int]]:
    """(identity, path, size, mtime) of the files below a path in the order of their names, each file once."""
    store, root = _store(path)
    if not isinstance(store, fs.LocalFileSystem):
        some = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return sorted((f.path, f"{path.split('://')[0]}://{f.path}", f.size, f.mtime_ns or 0) for f in some if f.is_file and fnmatch(f.base_name, glob))
    names, seen = [root] if os.path.isfile(root) else [], set()
    for folder, folders, files in os.walk(root, followlinks=True):
        about = os.stat(folder)
        if (about.st_dev, about.st_ino) in seen:  # a link back up
            folders.clear()
            continue
        seen.add((about.st_dev, about.st_ino))
        folders.sort()
        names += [os.path.join(folder, f) for f in files if fnmatch(f, glob)]
    out: dict[str, tuple] = {}
    for name in sorted(names):
        try:
            s = os.stat(name)
        except OSError:  # gone, or a link to nothing
            continue
        out.setdefault(f"{s.st_dev}:{s.st_ino}", (f"{s.st_dev}:{s.st_ino}", name, s.st_size, s.st_mtime_ns))
    return list(out.values())


def _bytes(f, start: int, end: int) -> bytes:
    f.seek(start)
    return f.read(end - start)


def line_end(f, start: int, end: int, size: int) -> int:
    """Behind the last line end in [start, end) of an open file, or behind the first one from there on; start if there is none up to size."""
    at = end
    while at > start:
        block = _bytes(f, max(start, at - BLOCK), at)
        if (found := block.rfind(b"\n")) >= 0:
            return max(start, at - BLOCK) + found + 1
        at = max(start, at - BLOCK)
    at = end
    while at < size:
        block = _bytes(f, at, min(size, at + BLOCK))
        if (found := block.find(b"\n")) >= 0:
            return at + found + 1
        at += BLOCK
    return start


class _Piece(InputPartition):
    """Lines that start in [first, last) of a range that begins at `since`, behind a line end."""

    def __init__(self, identity: str, name: str, path: str, generation: int, since: int, first: int, last: int, end: int):
        self.identity, self.name, self.path, self.generation = identity, name, path, generation
        self.since, self.first, self.last, self.end = since, first, last, end


class _Pack(InputPartition):
    """What one task reads."""

    def __init__(self, pieces: list[_Piece]):
        self.pieces = pieces


def packed(pieces: list[_Piece]) -> list[_Pack]:
    """Pieces in their order, dealt to tasks: a SHARE of all bytes each, but LEAST at least and PIECE at most, so that a small log is no
    task of its own. A file counts for SMALL bytes at least, as it has to be opened."""
    sizes = [max(SMALL, p.last - p.first) for p in pieces]
    room, packs, held = min(PIECE, max(LEAST, sum(sizes) // SHARE)), [], PIECE
    for piece, size in zip(pieces, sizes, strict=True):
        if held + size > room:
            packs.append(_Pack([]))
            held = 0
        packs[-1].pieces.append(piece)
        held += size
    return packs


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.roots, self.glob = options["path"].split(","), options.get("glob", "*.jsonl")
        self.version, self.most = options.get("version", "1"), int(options.get("max_bytes", 1 << 30))
        if "state" not in options:
            raise ValueError("growing_lines needs the option state: a folder beside the stream's checkpoint")
        self.state, self.folder = _store(options["state"])
        self.files: dict[str, dict] | None = None
        self.n = 0

    # --- plans on disk
    def _name(self, kind: str, n: int) -> str:
        return f"{self.folder}/{kind}-{n:012d}.json"

    def _write(self, name: str, rows: list[dict]) -> None:
        self.state.create_dir(self.folder, recursive=True)
        with self.state.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps({"version": self.version, "files": rows}).encode())
        self.state.move(f"{name}.part", name)

    def _read(self, name: str) -> dict:
        with self.state.open_input_file(name) as f:
            return json.loads(f.readall())

    def _numbers(self, kind: str) -> list[int]:
        found = self.state.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted(int(f.base_name[len(kind) + 1 : -5]) for f in found if f.base_name.startswith(f"{kind}-") and f.base_name.endswith(".json"))

    def _load(self) -> None:
        if self.files is not None:
            return
        self.files, snaps, plans = {}, self._numbers("snapshot"), self._numbers("plan")
        since = snaps[-1] if snaps else 0
        told = [self._read(self._name("snapshot", since))] if snaps else []
        for some in [*told, *(self._read(self._name("plan", n)) for n in plans if n > since)]:
            old = some["version"] != self.version
            for f in some["files"]:
                self.files[f["identity"]] = f | {"stale": old}
        self.n = max([since, *plans])

    # --- offsets
    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        self._load()
        changed, asked = [], []
        for identity, path, size, mtime in (x for root in self.roots for x in _found(root, self.glob)):
            f = self.files.get(identity)
            if not (f and not f["stale"] and (f["size"], f["mtime"]) == (size, mtime) and f["end"] == f["whole"]):
                asked.append((f, identity, path, size, mtime))
        with ThreadPoolExecutor(THREADS) as some:
            for new in some.map(lambda x: self._planned(*x), asked):
                if new:
                    self.files[new["identity"]] = new
                    if new["end"] > new["since"] or new["since"] == 0:
                        changed.append(new)
        if changed:
            self.n += 1
            self._write(self._name("plan", self.n), changed)
            if self.n % SNAPSHOT == 0:
                self._write(self._name("snapshot", self.n), list(self.files.values()))
        return {"n": self.n}

    def _planned(self, f: dict | None, identity: str, path: str, size: int, mtime: int) -> dict | None:
        try:
            store, name = _store(path)
            with store.open_input_file(name) as opened:
                return self._next(opened, f, identity, path, size, mtime)
        except OSError:  # gone since it was listed
            return None

    def _next(self, opened, f: dict | None, identity: str, path: str, size: int, mtime: int) -> dict | None:
        again = f is not None and (f["stale"] or size < f["end"] or zlib.crc32(_bytes(opened, 0, f["head"][0])) != f["head"][1])
        since = 0 if f is None or again else f["end"]
        generation = 0 if f is None else f["generation"] + again
        whole = line_end(opened, since, size, size)
        end = whole if whole - since <= self.most else line_end(opened, since, since + self.most, size)
        if end == since and f is not None and not again:
            return f | {"size": size, "mtime": mtime, "whole": whole, "path": path, "since": since}
        if end == 0 and f is None:
            return None  # nothing whole yet
        head = _bytes(opened, 0, min(HEAD, end))
        return {"identity": identity, "file": f["file"] if f else path, "path": path, "generation": generation, "since": since, "end": end, "whole": whole, "size": size, "mtime": mtime, "head": [len(head), zlib.crc32(head)], "stale": False}

    def partitions(self, start: dict, end: dict) -> list[_Pack]:
        pieces = []
        for n in range(start["n"] + 1, end["n"] + 1):
            for f in self._read(self._name("plan", n))["files"]:
                for a in range(f["since"], f["end"], PIECE):
                    pieces.append(_Piece(f["identity"], f["file"], f["path"], f["generation"], f["since"], a, min(a + PIECE, f["end"]), f["end"]))
        return packed(pieces)

    def commit(self, end: dict) -> None:
        """Plans that a snapshot holds and whose batches are done are not needed again."""
        snaps = [n for n in self._numbers("snapshot") if n <= end["n"]]
        for n in self._numbers("plan"):
            if snaps and n <= snaps[-1]:
                self.state.delete_file(self._name("plan", n))

    def read(self, pack: _Pack) -> Iterator[pa.RecordBatch]:
        for piece in pack.pieces:
            yield from self._lines(piece)

    def _lines(self, piece: _Piece) -> Iterator[pa.RecordBatch]:
        store, name = _store(piece.path)
        try:
            f = store.open_input_file(name)
        except OSError:  # gone since it was planned
            return
        with f:
            at = piece.first
            if at > piece.since:  # the line that reaches into the piece belongs to the one before
                at = line_start(f, at, piece.end)
            while at < piece.last:
                f.seek(at)
                block = f.read(min(4 << 20, piece.end - at))
                cut = block.rfind(b"\n") + 1
                while not cut and at + len(block) < piece.end:  # a line longer than the block
                    more = f.read(min(4 << 20, piece.end - at - len(block)))
                    if not more:
                        return  # shrunk since it was planned
                    block += more
                    cut = block.rfind(b"\n") + 1
                if not cut:
                    return
                places, lines = [], []
                for line in block[:cut].split(b"\n")[:-1]:
                    if at < piece.last and line.strip():
                        places.append(at)
                        lines.append(line.decode("utf-8", "replace"))
                    at += len(line) + 1
                n = len(lines)
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([piece.identity] * n), pa.array([piece.name] * n), pa.array([piece.generation] * n, pa.int32()), pa.array([piece.since] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(lines, pa.string())],
                        names=["identity", "file", "generation", "since", "place", "line"],
                    )


def line_start(f, at: int, end: int) -> int:
    """The first place from `at` on that stands behind a line end."""
    at -= 1
    while at < end:
        f.seek(at)
        block = f.read(min(BLOCK, end - at))
        if not block:
            return end
        if (found := block.find(b"\n")) >= 0:
            return at + found + 1
        at += len(block)
    return end


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def growing_lines(spark: SparkSession, paths: str | list[str], state: str, glob: str = "*.jsonl", version: str = "1", max_bytes: int = 1 << 30) -> DataFrame:
    """A stream of LINES of all files below the paths."""
    spark.dataSource.register(GrowingLines)
    paths = paths if isinstance(paths, str) else ",".join(paths)
    return spark.readStream.format("growing_lines").option("state", state).option("glob", glob).option("version", version).option("max_bytes", str(max_bytes)).load(paths)
