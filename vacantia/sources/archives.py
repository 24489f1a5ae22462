"""Delimited tables within zip archives.

Archives are rows of ``spark.read.format("binaryFile")`` (path, content); a member is unpacked line by line, so memory holds one archive's
compressed bytes and one batch of rows.  The header is found by its first cell, whatever stands before it.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows handed on at once.
BATCH = 4096
ROWS = "archive string, member string, row bigint, cells map<string,string>"
_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("row", pa.int64()), ("cells", pa.map_(pa.string(), pa.string()))])


def read_members(archives: DataFrame, *, member: str, first: str, delimiter: str = ";", encoding: str = "utf-8-sig") -> DataFrame:
    """``ROWS``: the rows below the header of every member whose name ends in ``member``, numbered from 0, by column name.

    The header is the first row whose first cell is ``first``; members without one, and files that are no archives, give no rows.  Empty lines are left out; cells
    beyond the header are dropped, missing ones are absent; of columns that share a name the first counts; bytes that are not of the encoding become replacement characters.
    """

    def tables(path: str, content: bytes) -> Iterator[tuple]:
        if content is None or not zipfile.is_zipfile(io.BytesIO(content)):
            return
        with zipfile.ZipFile(io.BytesIO(content)) as bundle:
            for name in sorted(n for n in bundle.namelist() if n.endswith(member)):
                with bundle.open(name) as raw:
                    header, n = None, 0
                    for cells in csv.reader(io.TextIOWrapper(raw, encoding=encoding, errors="replace", newline=""), delimiter=delimiter):
                        if header is None:
                            header = [c.strip() for c in cells] if cells and cells[0].strip() == first else None
                        elif any(cells):
                            yield path, name, n, list(dict(reversed(list(zip(header, cells)))).items())
                            n += 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out: list[tuple] = []
                for row in tables(batch.column(0)[k].as_py(), batch.column(1)[k].as_py()):
                    out.append(row)
                    if len(out) == BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in out], _ARROW)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in out], _ARROW)

    return archives.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(read, ROWS)
