"""Point clouds in PLY files: a data source whose schema comes from the header and whose tasks read ranges of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: The names of the format's numbers, old and new.
NUMBERS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
ENDS = {"binary_little_endian": "<", "binary_big_endian": ">"}
_SPARK = {"i1": T.ByteType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(), "u4": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
_ARROW = {"i1": pa.int8(), "u1": pa.int16(), "i2": pa.int16(), "u2": pa.int32(), "i4": pa.int32(), "u4": pa.int64(), "f4": pa.float32(), "f8": pa.float64()}
LONGEST = 1 << 20


@dataclass(frozen=True)
class Header:
    """What a file's header says of its vertices: where they begin, how many, their properties, and what follows them."""

    form: str
    start: int
    count: int
    properties: tuple[tuple[str, str], ...]
    last: bool

    @property
    def record(self) -> np.dtype:
        return np.dtype([(n, ENDS.get(self.form, "<") + k) for n, k in self.properties])


def parse(data: bytes, name: str = "header") -> Header:
    """The header at the start of a file; a malformed one raises ValueError. Elements before the vertices must be of fixed size."""
    lines, at = [], 0
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"{name}: no end_header in the first {len(data)} bytes")
        lines.append(data[at:end].decode("ascii", "replace").strip())
        at = end + 1
        if lines[-1] == "end_header":
            break
    if lines[0] != "ply":
        raise ValueError(f"{name}: not a PLY file")
    form, elements = "", []
    for line in lines[1:-1]:
        words = line.split()
        match words:
            case [] | ["comment", *_] | ["obj_info", *_]:
                continue
            case ["format", kind, "1.0"] if kind in ("ascii", *ENDS) and not form:
                form = kind
            case ["element", what, n] if n.isdigit():
                elements.append((what, int(n), []))
            case ["property", "list", a, b, p] if a in NUMBERS and b in NUMBERS and elements:
                elements[-1][2].append((p, None))
            case ["property", kind, p] if kind in NUMBERS and elements:
                elements[-1][2].append((p, NUMBERS[kind]))
            case _:
                raise ValueError(f"{name}: bad header line {line!r}")
    if not form:
        raise ValueError(f"{name}: no format")
    place = next((i for i, e in enumerate(elements) if e[0] == "vertex"), None)
    if place is None:
        raise ValueError(f"{name}: no vertices")
    start = at
    for what, n, properties in elements[:place]:
        if form == "ascii" or any(k is None for _, k in properties):
            raise ValueError(f"{name}: {what} stands before the vertices")
        start += n * np.dtype([(p, k) for p, k in properties]).itemsize
    what, n, properties = elements[place]
    if not properties or any(k is None for _, k in properties):
        raise ValueError(f"{name}: vertices must have properties of fixed size")
    if len({p for p, _ in properties}) < len(properties):
        raise ValueError(f"{name}: a property stands twice")
    return Header(form, start, n, tuple(properties), place == len(elements) - 1)


def _files(path: str) -> list[tuple[str, int]]:
    store, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".ply"))


def _store(path: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")[0]


@dataclass
class Range(InputPartition):
    file: str
    header: Header
    begin: int
    end: int
    size: int

    def __post_init__(self) -> None:
        super().__init__(None)


class PlyReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Range]:
        """Ranges of ``split`` bytes: of whole records in a binary file, cut at line ends later in an ASCII one.

        An ASCII file with elements after its vertices is one range, as only a count of its lines tells the vertices.
        """
        out, store, first = [], _store(self.path), None
        for file, size in _files(self.path):
            with store.open_input_file(file) as f:
                header = parse(f.read(min(size, LONGEST)), file)
            if first is None:
                first = header.properties
            if header.properties != first:
                raise ValueError(f"{file}: its properties are not those of the other files")
            if header.form == "ascii":
                step = self.split if header.last else max(1, size)
                stop = size
            else:
                width = header.record.itemsize
                stop = header.start + header.count * width
                if stop > size:
                    raise ValueError(f"{file}: shorter than its {header.count} vertices")
                step = max(1, self.split // width) * width
            out += [Range(file, header, a, min(stop, a + step), stop) for a in range(header.start, stop, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        header = partition.header
        with _store(self.path).open_input_file(partition.file) as f:
            if header.form == "ascii":
                rows = self._lines(f, partition)
                while True:
                    part = [r for _, r in zip(range(10_000), rows)]
                    if not part:
                        return
                    table = np.array(part, dtype=object)
                    yield self._batch(header, {n: table[:, i].astype(k) for i, (n, k) in enumerate(header.properties)})
            width = header.record.itemsize
            at = partition.begin
            while at < partition.end:
                n = min(1 << 22, partition.end - at) // width * width or width
                f.seek(at)
                got = np.frombuffer(f.read(n), header.record)
                yield self._batch(header, {p: got[p] for p, _ in header.properties})
                at += n

    @staticmethod
    def _lines(f, partition: Range) -> Iterator[list[str]]:
        """The lines that begin in the range; the line around its start belongs to the range before."""
        header, at = partition.header, partition.begin
        f.seek(at - 1 if at > header.start else at)
        rest, left = b"", 0
        if at > header.start:  # skip what began before
            while True:
                part = f.read(1 << 16)
                cut = part.find(b"\n")
                if cut >= 0:
                    rest = part[cut + 1 :]
                    at += left + cut
                    break
                if not part:
                    return
                left += len(part)
        told = 0
        while at < partition.end and (header.last or told < header.count):
            cut = rest.find(b"\n")
            while cut < 0:
                part = f.read(1 << 16)
                if not part:
                    rest += b"\n"
                    cut = len(rest) - 1
                    break
                rest += part
                cut = rest.find(b"\n")
            line, rest = rest[:cut], rest[cut + 1 :]
            at += cut + 1
            words = line.split()
            if words:
                if len(words) != len(header.properties):
                    raise ValueError(f"{partition.file}: bad vertex {line[:80]!r}")
                told += 1
                yield [w.decode() for w in words]

    @staticmethod
    def _batch(header: Header, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
        native = {n: np.ascontiguousarray(columns[n]).astype(columns[n].dtype.newbyteorder("="), copy=False) for n, _ in header.properties}
        return pa.RecordBatch.from_arrays([pa.array(native[n]).cast(_ARROW[k]) for n, k in header.properties], [n for n, _ in header.properties])


class PlyWriter(DataSourceArrowWriter):
    """One file a task, named by task, under a folder; a task that is tried again replaces its own file."""

    def __init__(self, path: str, form: str, schema: T.StructType) -> None:
        self.path, self.form = path, form
        kinds = {T.FloatType(): "f4", T.DoubleType(): "f8", T.IntegerType(): "i4", T.ShortType(): "i2", T.ByteType(): "i1"}
        bad = [f.name for f in schema.fields if f.dataType not in kinds]
        if bad or form not in ("ascii", *ENDS):
            raise ValueError(f"PLY files can't hold {bad or form}")
        self.properties = [(f.name, kinds[f.dataType]) for f in schema.fields]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        names = {"f4": "float", "f8": "double", "i4": "int", "i2": "short", "i1": "char"}
        record = np.dtype([(n, ENDS.get(self.form, "<") + k) for n, k in self.properties])
        body, count = [], 0
        for b in batches:
            rows = np.empty(len(b), record)
            for i, (n, _) in enumerate(self.properties):
                if b.column(i).null_count:
                    raise ValueError(f"PLY files can't hold null ({n})")
                rows[n] = b.column(i).to_numpy(zero_copy_only=False)
            body.append("".join(" ".join(map(repr, r)) + "\n" for r in rows.tolist()).encode() if self.form == "ascii" else rows.tobytes())
            count += len(rows)
        head = ["ply", f"format {self.form} 1.0", f"element vertex {count}", *(f"property {names[k]} {n}" for n, k in self.properties), "end_header"]
        store, root = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/part-{TaskContext.get().partitionId():05d}.ply") as f:
            f.write(("\n".join(head) + "\n").encode())
            for part in body:
                f.write(part)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        pass


class Ply(DataSource):
    """``spark.read.format("ply").option("split", bytes).load(path)``; a path is a file or a folder of files of one header.

    The schema is that of the header: the columns of a user's own schema must be the properties, in order. Writing takes
    ``format``: ascii, binary_little_endian (as default) or binary_big_endian.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> T.StructType:
        path = self.options["path"]
        files = _files(path)
        if not files:
            raise FileNotFoundError(f"no .ply file under {path}")
        with _store(path).open_input_file(files[0][0]) as f:
            header = parse(f.read(min(files[0][1], LONGEST)), files[0][0])
        return T.StructType([T.StructField(n, _SPARK[k]) for n, k in header.properties])

    def reader(self, schema: T.StructType) -> PlyReader:
        return PlyReader(self.options["path"], int(self.options.get("split", 64 << 20)))

    def writer(self, schema: T.StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], self.options.get("format", "binary_little_endian"), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Ply)
