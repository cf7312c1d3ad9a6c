"""Numpy archives: read by ranges of rows, written by tasks.

The arrays of an archive are columns; they have one length.  An array of one dimension is a column of numbers or texts, one
of two a column of vectors.  Each range of rows of each archive is a partition; a task seeks to its rows (in a compressed
archive it has to unpack what lies before them) and holds ``STEP`` bytes at a time.

A sink's task writes archives of ``FILE`` bytes at most under hidden names; the driver gives those their names that the
tasks which counted have returned, so that a task that ran twice or was lost leaves nothing to be read.
Archives have no nulls: rows with a null, and vectors of several lengths, are refused.
"""

from __future__ import annotations

import io
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.memory import frugal
from .places import listed, opened, qualified, system

#: Bytes of the rows of a partition, of a batch, and of a written archive.
RANGE, STEP, FILE = 64 << 20, 4 << 20, 32 << 20
_SQL = {"i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "f2": "float", "f4": "float", "f8": "double", "b1": "boolean"}


def _header(stream) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, where the numbers begin) of an array in an archive."""
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(stream)
    if dtype.hasobject or len(shape) not in (1, 2) or (fortran and len(shape) == 2):
        raise ValueError("only arrays of numbers and texts, of one or two dimensions, row by row")
    return shape, dtype, stream.tell()


def _kind(shape: tuple[int, ...], dtype: np.dtype) -> str:
    one = "string" if dtype.kind == "U" else _SQL[dtype.str[1:]]
    return one if len(shape) == 1 else f"array<{one}>"


def described(uri: str) -> dict[str, tuple[tuple[int, ...], np.dtype]]:
    """The shapes and types of an archive's arrays, from their headers alone."""
    with opened(uri) as f, zipfile.ZipFile(f) as archive:
        out = {}
        for name in archive.namelist():
            with archive.open(name) as stream:
                out[name.removesuffix(".npy")] = _header(stream)[:2]
    return out


def _column(values: np.ndarray) -> pa.Array:
    flat = values.reshape(-1)
    if flat.dtype.kind == "U":
        cells = pa.array(flat.tolist(), pa.string())
    else:
        wide = {"f2": np.float32, "u1": np.int16, "u2": np.int32, "u4": np.int64}.get(flat.dtype.str[1:])
        cells = pa.array(flat.astype(wide or flat.dtype.newbyteorder("=")))
    if values.ndim == 1:
        return cells
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), cells)


def read_npz(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The archives at ``path`` (a file or a folder) as rows, one column for each array; the first archive has the schema."""
    files = [f for f, _ in listed(spark, path, ".npz")]
    if not files:
        raise FileNotFoundError(path)
    first = described(files[0])
    names = list(first)
    schema = ", ".join(f"`{n}` {_kind(*first[n])}" for n in names)
    kinds = {n: _kind(*first[n]) for n in names}

    def sizes(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                found = described(files[i])
                lengths = {shape[0] for shape, _ in found.values()}
                if list(found) != names or {n: _kind(*found[n]) for n in names} != kinds or len(lengths) != 1:
                    raise ValueError(f"{files[i]}: other arrays than {files[0]}, or arrays of several lengths")
                width = sum(int(np.prod(shape[1:])) * dtype.itemsize for shape, dtype in found.values())
                yield pa.RecordBatch.from_pydict({"id": [i], "rows": [lengths.pop()], "width": [width]})

    headers = spark.range(0, len(files), 1, min(len(files), 1000)).mapInArrow(sizes, "id bigint, rows bigint, width bigint").collect()  # two numbers an archive
    ranges = []
    for r in sorted(headers):
        step = max(1, range_bytes // max(1, r.width))
        ranges += [(files[r.id], at, min(r.rows, at + step), max(1, STEP // max(1, r.width))) for at in range(0, r.rows, step)]
    if not ranges:
        return spark.createDataFrame([], schema)

    def rows(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                file, at, end, step = ranges[i]
                with opened(file) as f, zipfile.ZipFile(f) as archive:
                    streams = [archive.open(f"{n}.npy") for n in names]
                    places = []
                    for stream in streams:
                        shape, dtype, start = _header(stream)
                        width = int(np.prod(shape[1:])) * dtype.itemsize
                        stream.seek(start + at * width)
                        places.append((shape, dtype, width))
                    for low in range(at, end, step):
                        n = min(step, end - low)
                        columns = [_column(np.frombuffer(s.read(n * width), dtype).reshape(n, *shape[1:])) for s, (shape, dtype, width) in zip(streams, places)]
                        yield pa.RecordBatch.from_arrays(columns, names)

    return spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(frugal(rows), schema)


def _packed(columns: dict[str, list[pa.Array]]) -> bytes:
    arrays = {}
    for name, parts in columns.items():
        whole = pa.chunked_array(parts).combine_chunks()
        if whole.null_count or (pa.types.is_list(whole.type) and whole.flatten().null_count):
            raise ValueError(f"{name}: an archive has no nulls")
        if pa.types.is_list(whole.type):
            lengths = np.unique(np.diff(whole.offsets.to_numpy()))
            if len(lengths) > 1:
                raise ValueError(f"{name}: vectors of several lengths")
            arrays[name] = whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), int(lengths[0]) if len(lengths) else 0)
        else:
            values = whole.to_numpy(zero_copy_only=False)
            arrays[name] = values.astype(str) if values.dtype == object else values
    body = io.BytesIO()
    np.savez(body, **arrays)
    return body.getvalue()


def write_npz(df: DataFrame, path: str, file_bytes: int = FILE) -> int:
    """Write rows as archives in a new folder; returns their number."""
    spark, names = df.sparkSession, df.columns
    folder = qualified(spark, path)
    fs, inside = system(folder)
    fs.create_dir(inside, recursive=True)
    if listed(spark, path, ".npz"):
        raise FileExistsError(path)

    def archives(batches):
        held, size = {n: [] for n in names}, 0

        def put():
            name = f"part-{uuid.uuid4().hex}.npz"
            fs, inside = system(f"{folder}/.{name}")
            with fs.open_output_stream(inside) as out:
                out.write(_packed(held))
            return pa.RecordBatch.from_pydict({"name": [name]})

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                for n, column in zip(names, piece.columns):
                    held[n].append(column)
                size += piece.nbytes
                if size >= file_bytes:
                    yield put()
                    held, size = {n: [] for n in names}, 0
        if size:
            yield put()

    done = [r.name for r in df.mapInArrow(frugal(archives), "name string").collect()]  # a name an archive
    if not done:  # no rows: one archive that has the columns
        empty = {f.name: [pa.array([], f.type)] for f in to_arrow_schema(df.schema)}
        done = ["part-0.npz"]
        with fs.open_output_stream(f"{inside}/.{done[0]}") as out:
            out.write(_packed(empty))
    for name in done:
        fs.move(f"{inside}/.{name}", f"{inside}/{name}")
    return len(done)
