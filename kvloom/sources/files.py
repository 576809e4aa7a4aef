"""Binary key files and key/value tables as Python data sources.

`keyfile`: a little-endian count of 8 bytes, then 8-byte unsigned keys. `kvtable`: a header of 16 bytes (count of 8, key
size and value size of 4 each), then rows of key bytes and value bytes. Each is read in parts of whole rows; a table is
written as one file for each partition in a folder. Paths go through pyarrow's file systems, so a store works as a
local folder does.
"""

from __future__ import annotations

import struct
import tempfile
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, DecimalType, LongType, StructField, StructType

PART_BYTES = 64 << 20
#: Fixed by the formats.
KEYFILE_HEADER, TABLE_HEADER = struct.Struct("<Q"), struct.Struct("<Qii")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(at))
    prefix = path.rstrip("/")
    return sorted(f"{prefix}/{f.base_name}" for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


@dataclass
class Part(InputPartition):
    path: str
    start: int
    rows: int
    key_size: int
    value_size: int


def _type(kind: str, size: int):
    if kind == "binary" or size != 8:
        return BinaryType()
    return DecimalType(20, 0) if kind == "uint64" else LongType()


def _column(raw, kind: str, size: int):
    """An Arrow array of rows of raw (a numpy array of bytes, size wide)."""
    import numpy as np
    import pyarrow as pa

    if kind == "binary" or size != 8:
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())
    numbers = np.ascontiguousarray(raw).view("<u8").reshape(-1)
    if kind == "uint64":
        return pa.array(numbers, pa.uint64()).cast(pa.decimal128(20, 0))
    if (numbers >> np.uint64(63)).any():
        raise ValueError("a key is 2**63 or more: read with option('keyType', 'uint64')")
    return pa.array(numbers.view("<i8"))


class _Reader(DataSourceReader):
    def __init__(self, files, kind, with_value, part_bytes):
        self.files, self.kind, self.with_value, self.part_bytes = files, kind, with_value, part_bytes

    def partitions(self):
        out = []
        for path, start, rows, key_size, value_size in self.files:
            width = key_size + value_size
            step = max(1, self.part_bytes // width)
            out += [Part(path, start + at * width, min(step, rows - at), key_size, value_size) for at in range(0, rows, step)]
        return out or [Part("", 0, 0, 8, 0)]

    def read(self, part):
        import numpy as np
        import pyarrow as pa

        if not part.rows:
            return
        store, at = _store(part.path)
        width, step = part.key_size + part.value_size, 1 << 16
        with store.open_input_file(at) as f:
            for row in range(0, part.rows, step):
                n = min(step, part.rows - row)
                data = f.read_at(n * width, part.start + row * width)
                if len(data) != n * width:
                    raise ValueError(f"{part.path} ends before its row count")
                raw = np.frombuffer(data, np.uint8).reshape(n, width)
                columns = [_column(raw[:, : part.key_size], self.kind, part.key_size)]
                if self.with_value:
                    columns.append(_column(raw[:, part.key_size :], self.kind, part.value_size))
                yield pa.RecordBatch.from_arrays(columns, ["key", "value"][: len(columns)])


class KeyFile(DataSource):
    """format("keyfile"); options path, keyType (long or uint64), partBytes."""

    @classmethod
    def name(cls):
        return "keyfile"

    def schema(self):
        return StructType([StructField("key", _type(self.options.get("keyType", "long"), 8))])

    def reader(self, schema):
        files = []
        for path in _files(self.options["path"]):
            store, at = _store(path)
            with store.open_input_file(at) as f:
                files.append((path, KEYFILE_HEADER.size, KEYFILE_HEADER.unpack(f.read_at(KEYFILE_HEADER.size, 0))[0], 8, 0))
        return _Reader(files, self.options.get("keyType", "long"), False, int(self.options.get("partBytes", PART_BYTES)))

    def writer(self, schema, overwrite):
        _emptied(self.options["path"], overwrite)
        return _Writer(self.options["path"], 8, 0, True)


def _emptied(path: str, overwrite: bool) -> None:
    """Delete what a folder holds before it is written anew."""
    if overwrite:
        from pyarrow import fs

        store, at = _store(path)
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir_contents(at)


@dataclass
class Done(WriterCommitMessage):
    path: str
    rows: int


def _rows(column, size: int, what: str):
    """A column as a matrix of bytes, `size` wide: binary values as they are, numbers as unsigned little-endian."""
    import numpy as np
    import pyarrow as pa

    if column.null_count:
        raise ValueError("a table of fixed widths can't hold nulls")
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
        widths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.empty(0, int)
        if (widths != size).any():
            raise ValueError(f"a {what} has {int(widths[widths != size][0])} bytes, not {size}")
        first = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset]) if len(column) else 0
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[first : first + len(column) * size]
        return data.reshape(len(column), size)
    if pa.types.is_decimal(column.type):
        numbers = column.cast(pa.decimal128(20, 0)).cast(pa.uint64()).to_numpy(zero_copy_only=False)
    else:
        numbers = column.cast(pa.int64()).to_numpy(zero_copy_only=False)
        if (numbers < 0).any():
            raise ValueError(f"a {what} is negative")
    raw = np.ascontiguousarray(numbers).astype("<u8").view(np.uint8).reshape(len(numbers), 8)
    if size < 8 and raw[:, size:].any():
        raise ValueError(f"a {what} needs more than {size} bytes")
    return np.concatenate((raw, np.zeros((len(raw), size - 8), np.uint8)), axis=1) if size > 8 else raw[:, :size]


class _Writer(DataSourceArrowWriter):
    """Writes runs of rows as they come, a batch at a time; one file a task."""

    def __init__(self, path, key_size, value_size, key_only):
        self.path, self.key_size, self.value_size, self.key_only = path.rstrip("/"), key_size, value_size, key_only

    def write(self, batches):
        import numpy as np
        from pyspark import TaskContext

        task = TaskContext.get()
        n, name = 0, f"{self.path}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        store, at = _store(name)
        store.create_dir(_store(self.path)[1], recursive=True)
        # the header holds the count: rows wait in a scratch file of this task until it is known
        with tempfile.TemporaryFile() as scratch:
            for b in batches:
                parts = [_rows(b.column(b.schema.get_field_index("key")), self.key_size, "key")]
                if not self.key_only:
                    parts.append(_rows(b.column(b.schema.get_field_index("value")), self.value_size, "value"))
                scratch.write(np.concatenate(parts, axis=1).tobytes())
                n += b.num_rows
            scratch.seek(0)
            with store.open_output_stream(at) as out:
                out.write(KEYFILE_HEADER.pack(n) if self.key_only else TABLE_HEADER.pack(n, self.key_size, self.value_size))
                while data := scratch.read(1 << 20):
                    out.write(data)
        return Done(name, n)

    def commit(self, messages):
        store, at = _store(f"{self.path}/_SUCCESS")
        kept = {m.path for m in messages if m}
        for path in _files(self.path):  # of tasks that ran twice
            if path not in kept:
                store.delete_file(_store(path)[1])
        with store.open_output_stream(at) as out:
            out.write(b"")

    def abort(self, messages):
        for m in messages:
            if m:
                store, at = _store(m.path)
                store.delete_file(at)


class KvTable(DataSource):
    """format("kvtable"); options path, keyType (long, uint64 or binary), keySize and valueSize when writing, partBytes."""

    @classmethod
    def name(cls):
        return "kvtable"

    def _headers(self):
        out = []
        for path in _files(self.options["path"]):
            store, at = _store(path)
            with store.open_input_file(at) as f:
                rows, key_size, value_size = TABLE_HEADER.unpack(f.read_at(TABLE_HEADER.size, 0))
                out.append((path, TABLE_HEADER.size, rows, key_size, value_size))
        if len({x[3:] for x in out}) > 1:
            raise ValueError("the files of a table differ in their widths")
        return out

    def schema(self):
        head = self._headers()
        key, value = head[0][3:] if head else (8, 8)
        kind = self.options.get("keyType", "long")
        return StructType([StructField("key", _type(kind, key)), StructField("value", _type(kind, value))])

    def reader(self, schema):
        return _Reader(self._headers(), self.options.get("keyType", "long"), True, int(self.options.get("partBytes", PART_BYTES)))

    def writer(self, schema, overwrite):
        _emptied(self.options["path"], overwrite)
        return _Writer(self.options["path"], int(self.options.get("keySize", 8)), int(self.options.get("valueSize", 8)), False)




def to_single_file(path: str) -> None:
    """Put the only part of a written folder in the folder's place."""
    parts = [p for p in _files(path)]
    if len(parts) != 1:
        raise ValueError(f"{path} has {len(parts)} parts, not one")
    store, at = _store(path)
    aside = at.rstrip("/") + ".single"
    store.move(_store(parts[0])[1], aside)
    store.delete_dir(at)
    store.move(aside, at)


def register(spark) -> None:
    """Make both formats known to the session."""
    spark.dataSource.register(KeyFile)
    spark.dataSource.register(KvTable)
