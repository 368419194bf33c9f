"""What the operators of this subpackage share: tables, a shared folder, words, packed columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The characters that part words (fixed by the operators' contracts).
SPACES = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local session gets a temporary
    folder of its own; on a cluster that is an error, as executors do not share local disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def store(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet under the shared folder and read it back: lineage ends there, and
    a lost executor costs a read, not the work behind it. Shuffle files of the write are freed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodestrata/{label}-{uuid.uuid4().hex}"
    free = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(free, "false")
    spark.conf.set(free, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(free, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name near base that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def buckets_of(spark: SparkSession, times: int = 1) -> int:
    return times * int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8: bytes.split() parts at exactly the six characters of SPACES."""
    return text.encode().split() if text else []


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 with A-Z lowered; bytes.lower() leaves all other bytes as they are."""
    return (text or "").encode().lower()


def id_crc(column: Column | str) -> Column:
    """crc32 of the id written as text; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column, F.lit("")))


def crc_of_id(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


#: DuckDB's text for crc32: the byte table by its rule (the reflected polynomial 0xEDB88320, eight steps a byte), a CTE of one row.
CRC_TABLE_SQL = "crc_step(k, i, v) as (select range, 0, range::bigint from range(256) union all select k, i + 1, xor(v >> 1, (v & 1) * 3988292384) from crc_step where i < 8), crc_table as (select list(v order by k) as crc_of from crc_step where i = 8)"


def crc_sql(text: str) -> str:
    """DuckDB's text for the unsigned crc32 of a string's UTF-8, beside crc_table."""
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda k: ('0x' || substr(hex({text}), k::int, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295::bigint)"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstandard frame; unpack() gives them back with their types."""
    head = [len(arrays)]
    for a in arrays:
        head += [np.dtype(a.dtype).num, a.size]
    return zstandard.ZstdCompressor(3).compress(b"".join([np.array(head, np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    out, at = [], 8 + 16 * n
    for num, size in head.reshape(n, 2):
        kind = _TYPES[int(num)]
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += int(size) * kind.itemsize
    return out


_TYPES = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.int8, np.uint16, np.int16, np.uint32, np.int32, np.uint64, np.int64, np.float32, np.float64)}


def pack_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as (lengths, bytes)."""
    return np.fromiter(map(len, words), np.int32, len(words)), np.frombuffer(b"".join(words), np.uint8)


def unpack_words(lengths: np.ndarray, raw: np.ndarray) -> list[bytes]:
    data, ends = raw.tobytes(), np.cumsum(lengths, dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def fields(text: str) -> T.StructType:
    """A schema from "name type, ..." of simple types; needs no session, so UDFs can be module-level."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in map(str.split, text.split(", "))])


def map_rows(df: DataFrame, fn, schema: T.StructType, rows: int = 512) -> DataFrame:
    """fn over df in slices of up to `rows` rows: it gets each column as a list and returns the
    columns of schema as lists (of any common length)."""
    arrow = to_arrow_schema(schema)

    def over(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(*(c.to_pylist() for c in batch.slice(at, rows).columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow.types)], schema=arrow)

    return df.mapInArrow(over, schema)
