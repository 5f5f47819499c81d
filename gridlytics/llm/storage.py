"""Files and tables in the folder that the driver and all executors share, so that work survives a lost executor."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`; where that is unset, one beside the session's warehouse, unless that is a folder of the
    driver's machine and the executors run on others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
        if not re.match(r"local(\[|$)", spark.sparkContext.master) and re.match("(file:)?/", folder):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: What Spark hands a Python task at once, whole texts and all; an executor runs several tasks, and each side keeps a copy or two.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold `BATCH_BYTES` at most; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(name).lower()).groups()
    if int(number) << 10 * " kmgt".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: cuts lineage, keeps column pruning."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def place(path: str) -> tuple[str | None, str]:
    """Arrow's URI of a path in a store, or None and the path on this machine's file system: `s3a` is Arrow's `s3`, `dbfs` the folder where
    it is mounted."""
    scheme, _, rest = path.partition(":")
    if not re.fullmatch("[A-Za-z][A-Za-z0-9+.-]+", scheme) or not rest:
        return None, path
    if scheme in ("file", "dbfs"):
        return None, ("/" if scheme == "file" else "/dbfs/") + rest.lstrip("/")
    return f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}", path


def filesystem(path: str):
    """The Arrow file system of a path or URI, and the path on it."""
    from pyarrow import fs

    uri, at = place(path)
    return (fs.LocalFileSystem(), at) if uri is None else fs.FileSystem.from_uri(uri)


def make_folder(path: str) -> None:
    files, at = filesystem(path)
    files.create_dir(at, recursive=True)


class Committed:
    """A file written under a temporary name of its own and renamed when whole. Attempts at one file don't meet, and as
    its content is a function of its rows, whichever attempt comes last leaves the same bytes."""

    def __init__(self, path: str):
        self.files, self.path = filesystem(path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.stream, self.size = self.files.open_output_stream(self.temporary, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.stream.close()
        self.files.move(self.temporary, self.path)

    def abort(self) -> None:
        self.stream.close()
        self.files.delete_file(self.temporary)


def open_input(path: str):
    files, at = filesystem(path)
    return files.open_input_file(at)


def write_manifest(folder: str, rows: list[dict]) -> str:
    """One line per committed file; only files in a manifest count as written."""
    out = Committed(f"{folder}/manifest.json")
    out.write("".join(json.dumps(row, sort_keys=True) + "\n" for row in rows).encode())
    out.commit()
    return f"{folder}/manifest.json"


def read_manifest(folder: str) -> list[dict]:
    with open_input(f"{folder}/manifest.json") as file:
        return [json.loads(line) for line in file.read().decode().splitlines()]
