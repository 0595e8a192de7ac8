"""Archives of zipped CSV files, read as rows."""

import io
import zipfile

import numpy as np
import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a member that are parsed at once.
CHUNK = 1 << 20
#: Rows that are passed on together.
ROWS = 10_000
#: What reading a member may raise.
FAULTS = (pa.ArrowInvalid, zipfile.BadZipFile, OSError, EOFError, ValueError, RuntimeError, NotImplementedError)


def zip_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all zip files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path).select("path", "content")


def archive_rows(files: DataFrame, columns: dict[str, str], time: str) -> DataFrame:
    """Rows of the CSV members of zip files: path, member, ``time`` as a timestamp, the new name of
    each of ``columns`` (CSV name: new name) as a double, and error.

    Text that is no number and columns that a member lacks become null. A file that is no zip and
    a member that cannot be read give one row with ``error``; what a member held before its fault
    is kept. Members are unpacked and parsed a chunk at a time, so a task holds one zip file and one
    chunk, whatever a member unpacks to. Small members of a file that begin with the same line are
    parsed together, up to a chunk, and one by one if that fails.
    """
    wanted = [time, *columns]
    names = ["path", "member", *wanted, "error"]
    nothing = pa.nulls(1, pa.string())

    def fault(path, member, error):
        text = f"{type(error).__name__}: {error}"
        return pa.Table.from_arrays([pa.array([path]), pa.array([member], pa.string()), *[nothing] * len(wanted), pa.array([text])], names=names)

    def named(table, path, members, sizes):
        member = pa.array(members).take(pa.array(np.repeat(np.arange(len(members)), sizes)))
        return pa.Table.from_arrays([pa.repeat(path, len(table)), member, *table.columns, pa.nulls(len(table), pa.string())], names=names)

    def parsed(batches):
        options = csv.ConvertOptions(column_types={c: pa.string() for c in wanted}, include_columns=wanted, include_missing_columns=True, strings_can_be_null=True)

        def whole(data):
            return csv.read_csv(pa.BufferReader(data), csv.ReadOptions(use_threads=False, block_size=len(data) + 1), convert_options=options)

        def alone(path, member, data):
            try:
                table = whole(data)
                return named(table, path, [member], [len(table)])
            except FAULTS as error:
                return fault(path, member, error)

        def together(path, header, members):
            sizes = [len(body.split(b"\n")) - body.split(b"\n").count(b"") for _, body in members]
            try:
                table = whole(header + b"\n" + b"\n".join(body for _, body in members))
                if len(table) == sum(sizes):
                    return [named(table, path, [name for name, _ in members], sizes)]
            except FAULTS:
                pass
            return [alone(path, name, header + b"\n" + body) for name, body in members]

        def member_rows(archive, path, member, alike):
            if member.file_size > CHUNK:
                with archive.open(member) as raw, csv.open_csv(raw, csv.ReadOptions(block_size=CHUNK), convert_options=options) as reader:
                    for batch in reader:
                        yield named(pa.Table.from_batches([batch]), path, [member.filename], [len(batch)])
                return
            data = archive.read(member)
            header, _, body = data.partition(b"\n")
            if not header or b'"' in data or b"\r" in data:  # lines may not be rows
                yield alone(path, member.filename, data)
                return
            alike.setdefault(header, []).append((member.filename, body))
            if sum(len(body) for _, body in alike[header]) > CHUNK:
                yield from together(path, header, alike.pop(header))

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as archive:
                        alike = {}
                        for member in archive.infolist():
                            if not member.filename.endswith("/"):
                                try:
                                    yield from member_rows(archive, path, member, alike)
                                except FAULTS as error:
                                    yield fault(path, member.filename, error)
                        for header, members in alike.items():
                            yield from together(path, header, members)
                except (zipfile.BadZipFile, OSError, ValueError) as error:
                    yield fault(path, None, error)

    def run(batches):
        held, rows, size = [], 0, 0
        for table in parsed(batches):
            held.append(table)
            rows, size = rows + len(table), size + table.nbytes
            if rows >= ROWS or size >= CHUNK:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held, rows, size = [], 0, 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    raw = files.select("path", "content").mapInArrow(run, ", ".join(f"`{n}` string" for n in names))
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    values = [F.when(~F.isnan(number(c)), number(c)).alias(new) for c, new in columns.items()]
    return raw.select("path", "member", F.expr(f"try_cast(`{time}` AS TIMESTAMP)").alias(time), *values, "error")
