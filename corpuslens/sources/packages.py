"""Portable packages: a zip of a project's tables, on any store that Spark reads and writes.

Spark's writers have compressed the tables already, so members are stored as they are.  Executors read them once, for sizes, checksums
and hashes; what is left for the driver is to copy bytes from stream to stream, which its JVM does piece by piece, and to write the
directory.  Reading goes the other way round: members are copied out by stream, then hashed by executors and compared."""

from __future__ import annotations

import io
import struct
import tomllib
import zipfile
import zlib
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.store import changed_files

# Files and folders that never go into a package.
_SECRET_NAMES, _SECRET_FOLDERS = (".env", "secrets.toml"), (".streamlit",)
# Members of a package beside its data.
_MANIFEST, _CHECKSUMS, _README = "manifest.toml", "checksums.sha256", "README_IMPORT.md"
# Signatures and versions of the zip format, its mark for UTF-8 names, its first day, and its limits for 32 and 16 bits.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_VERSION, _UTF8, _FIRST_DAY, _MOST, _MOST_MEMBERS = 45, 0x800, 33, 0xFFFFFFFF, 0xFFFF
_COPY_BYTES = 1 << 20


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


class StoreFile(io.RawIOBase):
    """A file of any of Spark's stores, to be read by position."""

    def __init__(self, spark: SparkSession, path: str):
        store, place = _place(spark, path)
        self.size, self.at, self.stream = store.getFileStatus(place).getLen(), 0, store.open(place)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def readinto(self, buffer) -> int:
        n = min(len(buffer), self.size - self.at)
        if n <= 0:
            return 0
        self.stream.seek(self.at)
        raw = bytes(self.stream.readNBytes(n))
        buffer[: len(raw)] = raw
        self.at += len(raw)
        return len(raw)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


class StoredZip:
    """Writes a zip of members that are stored as they are, of known size and CRC-32, to a stream of a store."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, (store, place) = spark, _place(spark, target)
        self.out, self.at, self.directory, self.members = store.create(place, True), 0, [], 0

    def _write(self, raw: bytes) -> None:
        self.out.write(bytearray(raw))
        self.at += len(raw)

    def _begin(self, name: str, size: int, crc: int) -> None:
        raw, large = name.encode(), size >= _MOST
        extra = struct.pack("<HHQQ", 1, 16, size, size) if large else b""
        start, shown = self.at, _MOST if large else size
        self._write(struct.pack("<IHHHHHIIIHH", _LOCAL, _VERSION, _UTF8, 0, 0, _FIRST_DAY, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        far = start >= _MOST
        extra = b"".join(struct.pack("<Q", x) for x in ((size, size) if large else ()) + ((start,) if far else ()))
        extra = struct.pack("<HH", 1, len(extra)) + extra if extra else b""
        self.directory.append(
            struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, _VERSION, _VERSION, _UTF8, 0, 0, _FIRST_DAY, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, _MOST if far else start) + raw + extra
        )
        self.members += 1

    def add_text(self, name: str, text: str) -> None:
        raw = text.encode()
        self._begin(name, len(raw), zlib.crc32(raw))
        self._write(raw)

    def add_file(self, name: str, path: str, size: int, crc: int) -> None:
        self._begin(name, size, crc)
        store, place = _place(self.spark, path)
        stream = store.open(place)
        try:
            self.spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, self.out, _COPY_BYTES, False)
        finally:
            stream.close()
        self.at += size

    def close(self) -> None:
        start = self.at
        for entry in self.directory:
            self._write(entry)
        size, end = self.at - start, self.at
        if start >= _MOST or size >= _MOST or self.members >= _MOST_MEMBERS:
            self._write(struct.pack("<IQHHIIQQQQ", _END64, 44, _VERSION, _VERSION, 0, 0, self.members, self.members, size, start) + struct.pack("<IIQI", _LOCATOR, 0, end, 1))
        n = min(self.members, _MOST_MEMBERS)
        self._write(struct.pack("<IHHHHIIH", _END, 0, 0, n, n, min(size, _MOST), min(start, _MOST), 0))
        self.out.close()


def file_facts(spark: SparkSession, folder: str) -> DataFrame:
    """(path below the folder, place, size, crc, sha256) of all files below ``folder``, by executors; nothing where there is none."""
    store, place = _place(spark, folder)
    if not store.exists(place):
        return spark.createDataFrame([], "path string, place string, size long, crc long, sha256 string")
    top = store.makeQualified(place).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inner = F.substring(F.col("path"), F.lit(len(top) + 2), F.length("path"))
    return files.select(inner.alias("path"), F.col("path").alias("place"), F.col("length").alias("size"), F.crc32("content").alias("crc"), F.sha2("content", 256).alias("sha256"))


def _quoted(value: str) -> str:
    out = "".join({'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, c) if c.isprintable() or c in '\n\r\t' else f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}" for c in value)
    return f'"{out}"'


def secret(path: str) -> bool:
    parts = PurePosixPath(path).parts
    return parts[-1] in _SECRET_NAMES or bool(set(parts) & set(_SECRET_FOLDERS))


def write_package(tables: dict[str, DataFrame], project: dict[str, str], target: str, work: str, raw_folder: str | None = None) -> None:
    """A zip of Parquet tables, a manifest, checksums and, if asked for, raw files without secrets, at ``target``.

    ``work`` is a folder to which the cluster writes the tables first.  The driver gets a row for each file and streams their bytes."""
    spark = next(iter(tables.values())).sparkSession
    members = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        members += [(f"data/{name}/{r['path']}", r) for r in file_facts(spark, f"{work}/{name}").collect() if r["path"].endswith(".parquet")]
    if raw_folder:
        members += [(f"data/raw/{r['path']}", r) for r in file_facts(spark, raw_folder).collect() if not secret(r["path"])]
    out = StoredZip(spark, target)
    for name, r in sorted(members, key=lambda x: x[0]):
        out.add_file(name, r["place"], r["size"], r["crc"])
    out.add_text(_MANIFEST, "[project]\n" + "".join(f"{k} = {_quoted(v)}\n" for k, v in project.items()))
    out.add_text(_CHECKSUMS, "".join(f"{r['sha256']}  {name}\n" for name, r in sorted(members, key=lambda x: x[0])))
    out.add_text(_README, "Unpack with read_package; checksums.sha256 lists every data file.\n")
    out.close()


def _safe(name: str) -> bool:
    parts = PurePosixPath(name.replace("\\", "/")).parts
    return not name.startswith(("/", "\\")) and ".." not in parts and ":" not in name


def read_package(spark: SparkSession, source: str, folder: str, project_id: str | None = None) -> tuple[dict[str, DataFrame], dict, list[str]]:
    """(tables, manifest, warnings).  Members that would leave ``folder`` are refused; missing files and wrong checksums are warnings."""
    with zipfile.ZipFile(io.BufferedReader(StoreFile(spark, source), 1 << 16)) as package:
        names = package.namelist()
        if _MANIFEST not in names or not any(n.startswith("data/") and n.endswith(".parquet") for n in names):
            raise ValueError("not a package: manifest or data are missing")
        for name in names:
            if not _safe(name):
                raise ValueError(f"unsafe member {name}")
        manifest = tomllib.loads(package.read(_MANIFEST).decode())
        listed = package.read(_CHECKSUMS).decode().splitlines() if _CHECKSUMS in names else []
    store, place = _place(spark, source)
    members = spark._jvm.java.util.zip.ZipInputStream(store.open(place))
    copy = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    try:
        while (entry := members.getNextEntry()) is not None:
            if not entry.isDirectory():
                to, path = _place(spark, f"{folder}/{entry.getName()}")
                out = to.create(path, True)
                try:
                    copy(members, out, _COPY_BYTES, False)
                finally:
                    out.close()
    finally:
        members.close()
    # Of members with one name the last one was kept, which the hashes tell.
    expected = [tuple(line.split("  ", 1)[::-1]) for line in listed if "  " in line]
    expected = spark.createDataFrame(expected, "path string, sha256 string")
    facts = file_facts(spark, f"{folder}/data").select(F.concat(F.lit("data/"), "path").alias("path"), "sha256")
    warnings = [f"{r['problem']}: {r['path']}" for r in changed_files(expected, facts).orderBy("path").collect()]
    found = sorted({n.split("/")[1] for n in names if n.startswith("data/") and n.count("/") > 1 and n.endswith(".parquet")} - {"raw"})
    tables = {name: spark.read.parquet(f"{folder}/data/{name}") for name in found}
    if project_id:
        tables = {n: df.withColumn("project_id", F.lit(project_id)) if "project_id" in df.columns else df for n, df in tables.items()}
    return tables, manifest, warnings
