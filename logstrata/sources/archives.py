"""Archive sources: tar and zip bundles, and rotated service logs. One archive is one row of `binaryFile`."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import tarfile
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNREADABLE = (tarfile.TarError, zipfile.BadZipFile, zlib.error, EOFError, OSError, lzma.LZMAError, RuntimeError, NotImplementedError)
TARS = (".tar", ".tar.gz", ".tgz")
MORE_TARS = (".tar.bz2", ".tbz2", ".tar.xz", ".txz")


def stem(name: str) -> str:
    """Archive name without its suffixes."""
    base = name.rsplit("/", 1)[-1]
    for suffix in (*MORE_TARS, ".tar.gz", ".tgz", ".tar", ".zip"):
        if base.lower().endswith(suffix):
            return base[: -len(suffix)]
    return base


def is_archive(name: str, wide: bool) -> bool:
    return name.lower().endswith((*TARS, ".zip", *(MORE_TARS if wide else ())))


def members(name: str, data: bytes, wide: bool = False):
    """(path, bytes, None) of every file of an archive; nested archives, however deep, are opened under a directory named by their
    stem. (path, None, error) of a nested archive stands for what could not be read of it.

    `._*` members are skipped. The wide form reads bz2 and xz tars too, and skips dot-files and members whose
    path is absolute or climbs out.
    """

    def opened():
        if name.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        yield info.filename, z.read(info)
        else:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
                for info in t:
                    if info.isfile():
                        yield info.name, t.extractfile(info).read()

    for path, body in opened():
        base = path.rsplit("/", 1)[-1]
        unsafe = path.startswith("/") or ".." in path.split("/")
        if base.startswith("._") or (wide and (base.startswith(".") or unsafe)):
            continue
        if unsafe:  # keep the file, inside the session
            path = "/".join(p for p in path.split("/") if p not in ("", ".."))
        path = path.removeprefix("./")
        if is_archive(path, wide):
            folder = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
            try:
                for inner, content, error in members(path, body, wide):
                    yield f"{folder}{stem(path)}/{inner}", content, error
            except UNREADABLE as error:
                yield path, None, repr(error)
        else:
            yield path, body, None


def read_binary(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        .select("path", "content")
    )


FILE_SCHEMA = "session_id string, path string, size bigint, content binary, error string"
LINE_SCHEMA = "session_id string, path string, line_no bigint, content string"


def read_bundles(binaries: DataFrame, wide: bool = False) -> DataFrame:
    """Files of bundles (path, content): one bundle per row, bundles in parallel. A bundle or nested archive that cannot be read, or
    not to its end, gives the files before the damage and a row with its path, no content and the error."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for uri, data in zip(pdf["path"], pdf["content"]):
                if not is_archive(uri, wide):
                    continue
                try:
                    for path, body, error in members(uri, data, wide):
                        yield pd.DataFrame({"session_id": [stem(uri)], "path": [path], "size": [len(body or b"")], "content": [body], "error": [error]})
                except UNREADABLE as error:
                    yield pd.DataFrame({"session_id": [stem(uri)], "path": [uri], "size": [0], "content": [None], "error": [repr(error)]})

    return binaries.mapInPandas(run, FILE_SCHEMA)


def explode_archives(binaries: DataFrame, wide: bool = False) -> DataFrame:
    """Files of bundles: session_id, path, size, content."""
    return read_bundles(binaries, wide).where("error IS NULL").drop("error")


def unreadable(binaries: DataFrame, wide: bool = False) -> DataFrame:
    """What could not be read: session_id, path and error of bundles, of archives inside them, and of singly compressed files."""
    found = read_bundles(binaries, wide)

    def run(batches):
        for pdf in batches:
            errors = [error_of(path, data) for path, data in zip(pdf["path"], pdf["content"])]
            yield pdf[["session_id", "path"]].assign(error=errors)[[e is not None for e in errors]]

    single = found.where(F.col("error").isNull() & F.col("path").rlike(r"\.(?:gz|bz2|xz)$")).select("session_id", "path", "content")
    return found.where("error IS NOT NULL").select("session_id", "path", "error").union(single.mapInPandas(run, "session_id string, path string, error string"))


def error_of(path: str, data: bytes) -> str | None:
    try:
        unpack_single(path, data)
    except UNREADABLE as error:
        return repr(error)
    return None


def archive_lines(files: DataFrame, batch: int = 10_000, returns: bool = False, empty: bool = False) -> DataFrame:
    """Lines of extracted files, in batches so that a long file never becomes one huge batch of rows.

    Carriage returns before a newline are part of the line's end, or, with `returns`, of the line. With `empty`, a file without
    lines has a row with line number 0 and no content.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for session, path, data in zip(pdf["session_id"], pdf["path"], pdf["content"]):
                try:
                    data = unpack_single(path, data)
                except UNREADABLE:  # listed by unreadable()
                    continue
                lines = data.decode("utf-8", "replace").split("\n")
                if lines and lines[-1] == "":
                    lines.pop()
                if empty and not lines:
                    yield pd.DataFrame({"session_id": [session], "path": [path], "line_no": [0], "content": [None]})
                for start in range(0, len(lines), batch):
                    part = [line if returns else line.rstrip("\r") for line in lines[start : start + batch]]
                    yield pd.DataFrame({"session_id": session, "path": path, "line_no": range(start + 1, start + len(part) + 1), "content": part})

    return files.select("session_id", "path", "content").mapInPandas(run, LINE_SCHEMA)


#: Bytes of packed files that a task unpacks before it hands them on.
PIECE_BYTES = 4_000_000


def pieces_of(batches, column: str, most: int = PIECE_BYTES):
    """Arrow batches cut into slices with `most` bytes of a string or binary column, or one row: only a slice is held as Python objects."""
    import pyarrow.compute as pc

    for batch in batches:
        start = held = 0
        for k, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if k > start and held + (size or 0) > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def with_content(rows, content: list):
    """An Arrow batch with the column `content`."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(content, pa.binary())], names=[*rows.schema.names, "content"])


def unpack_rotated(data: bytes) -> bytes:
    """Gzip, then zlib, then the bytes as they are."""
    for decode in (gzip.decompress, zlib.decompress):
        try:
            return decode(data)
        except (OSError, EOFError, zlib.error):
            continue
    return data


def read_rotated(files: DataFrame) -> DataFrame:
    """Rotated logs `@*.s` and `@*.u` of (session_id, path, content), numbered in name order per directory: current.NNN.log beside a
    file named current, else named after the directory."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", r"[^/]*$", "")
    rows = files.where(name.rlike(r"^@.*\.(?:s|u)$"))
    # numbers come from the names alone; the content is not shuffled
    order = Window.partitionBy("session_id", folder).orderBy("path")
    with_current = files.where(name == "current").select("session_id", folder.alias("folder"), F.lit("current").alias("stem")).distinct()
    numbers = rows.select("session_id", "path", folder.alias("folder"), F.row_number().over(order).alias("n"))
    service = F.coalesce(F.nullif(F.element_at(F.split(F.rtrim(F.col("folder"), F.lit("/")), "/"), -1), F.lit("")), F.lit("current"))
    numbers = numbers.join(with_current, ["session_id", "folder"], "left").select("session_id", "path", "n", F.coalesce("stem", service).alias("stem"))

    def run(batches):
        for part in pieces_of(batches, "content"):
            yield with_content(part.select(["session_id", "path"]), [unpack_rotated(b) for b in part["content"].to_pylist()])

    plain = rows.select("session_id", "path", "content").mapInArrow(run, "session_id string, path string, content binary")
    number = F.expr("lpad(CAST(n AS STRING), greatest(3, length(CAST(n AS STRING))), '0')")  # never cut
    renamed = F.concat(folder, F.col("stem"), F.lit("."), number, F.lit(".log"))
    return plain.join(numbers, ["session_id", "path"]).select("session_id", renamed.alias("path"), F.col("path").alias("original"), "content")


def unpack_single(name: str, data: bytes) -> bytes:
    """Content of a singly compressed file, by suffix."""
    for suffix, decode in ((".gz", gzip.decompress), (".bz2", bz2.decompress), (".xz", lzma.decompress)):
        if name.endswith(suffix):
            return decode(data)
    return data
