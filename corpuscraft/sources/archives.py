"""ZIP archives as a Python data source: read by members, written by partitions.

The directory at the end of an archive tells where its members lie, so a partition is a run of members and a task reads their bytes
alone; no archive is ever one value. Writing, each task fills an archive of its own, and the archives appear together on commit.
Files are opened with Arrow's file systems (local, HDFS, S3, GCS and the like).
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes, as they lie in the archive, that a partition reads (a single larger member makes one of its own).
PARTITION = 32 << 20
MANIFEST = "MANIFEST.json"


def system_of(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def spelled(uri: str) -> str:
    """file:/x as file:///x, the way Arrow reads it."""
    return f"file:///{uri[6:].lstrip('/')}" if uri.startswith("file:/") else uri


@dataclass
class Members(InputPartition):
    archive: str
    names: list[str]


class ZipReader(DataSourceReader):
    def __init__(self, archives: list[str], most: int):
        self.archives, self.most = archives, most

    def partitions(self) -> list[Members]:
        out = []
        for archive in self.archives:
            system, path = system_of(archive)
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                held, size = [], 0
                for m in z.infolist():
                    if m.filename.startswith("/") or ".." in m.filename.split("/"):
                        raise ValueError(f"member outside the archive: {m.filename}")
                    if m.is_dir():
                        continue
                    if held and size + m.compress_size > self.most:
                        out.append(Members(archive, held))
                        held, size = [], 0
                    held.append(m.filename)
                    size += m.compress_size
                if held:
                    out.append(Members(archive, held))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[tuple]:
        if not partition.names:
            return
        system, path = system_of(partition.archive)
        with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            for name in partition.names:
                yield partition.archive, name, z.read(name)  # a wrong checksum is an error


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class ZipWriter(DataSourceWriter):
    """Rows of (path, content); every archive lists its members (path, bytes, sha256) in ``MANIFEST.json``."""

    def __init__(self, folder: str):
        self.folder, self.run = spelled(folder).rstrip("/"), uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        name, lines, out = f"{uuid.uuid4().hex}.zip", [], None
        try:
            for r in rows:
                if out is None:
                    system, path = system_of(f"{self.folder}/_writing-{self.run}")
                    system.create_dir(path)
                    stream = system.open_output_stream(f"{path}/{name}")
                    out = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                content = bytes(r["content"])
                out.writestr(r["path"], content)
                lines.append({"path": r["path"], "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()})
            if out is not None:
                out.writestr(MANIFEST, json.dumps(lines, sort_keys=True))
        finally:
            if out is not None:
                out.close()
                stream.close()
        return Written(name if lines else None)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = system_of(f"{self.folder}/_writing-{self.run}")
        names = sorted(m.name for m in messages if m is not None and m.name)
        for k, name in enumerate(names):  # a name for each task; what failed attempts have left goes with the folder
            system.move(f"{path}/{name}", f"{path.rpartition('/')[0]}/part-{self.run[:8]}-{k:05d}.zip")
        if names:
            system.delete_dir(path)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, path = system_of(f"{self.folder}/_writing-{self.run}")
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_dir(path)


class ZipMembers(DataSource):
    """Format ``zip_members``. Reading: option ``archives``, a JSON list of URIs, and ``partition``, bytes
    that a task reads. Writing: the path is a folder of archives."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, content binary"

    def reader(self, schema) -> ZipReader:
        return ZipReader([spelled(a) for a in json.loads(self.options["archives"])], int(self.options.get("partition", PARTITION)))

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options["path"])


def zip_members(spark: SparkSession, path: str, partition: int = PARTITION) -> DataFrame:
    """archive, member, content of the ZIP files that ``path`` names (a file, a folder or a pattern); members that would leave their
    folder and wrong checksums are errors."""
    spark.dataSource.register(ZipMembers)
    names = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # file names, which Spark has listed
    return spark.read.format("zip_members").option("archives", json.dumps(sorted(names))).option("partition", partition).load()


def package(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Packs a tree of files into ZIP archives in ``folder``, one for each task, with their manifests inside; reads every member back,
    its checksum included, and returns the manifest (path, bytes, sha256). A member that came out otherwise is an error.
    Files of no bytes are passed over, as Spark's reader does."""
    spark.dataSource.register(ZipMembers)
    base = path.rstrip("/").rsplit("/", 1)[-1]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.substring_index("path", f"/{base}/", -1).alias("path"), "content")
    files.write.format("zip_members").mode("append").save(folder)
    described = lambda df, name: df.select(F.col(name).alias("path"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    packed = described(zip_members(spark, folder.rstrip("/") + "/*.zip").filter(F.col("member") != MANIFEST), "member")
    wrong = described(files, "path").join(packed.select("path", F.col("sha256").alias("packed")), "path", "full").filter(~F.col("sha256").eqNullSafe(F.col("packed"))).select("path").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['path']} is not as it was")
    return packed
