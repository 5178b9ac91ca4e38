"""What the operators of this package share: tables, cut lineage, splits, byte-level words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows sent to Python at once while tables are written: rows of thousands of numbers must not come by the ten thousand.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session names none (local tests) a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Tables in the shared folder that cut lineage, so that lost executors cost one table at most.

    `cut` writes a DataFrame as Parquet and reads it back. `drop` deletes a table that
    no later plan reads; what is left goes when the Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(BATCH)
        self.spark.conf.set(BATCH, str(min(BATCH_ROWS, int(before))))
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(BATCH, before)
        del df
        self.release()
        return self.spark.read.parquet(path)

    def release(self) -> None:
        """Shuffle files live until the JVM has collected the plans that own them. What the driver has freed goes back to the system."""
        trim()
        self.spark.sparkContext._jvm.System.gc()
        trim_jvm(self.spark)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the folder's owner clears it
            return


_held: dict = {}


#: Seconds after which a Python worker without work lets go of what it keeps.
IDLE = 3.0
_used = [0.0]


def hold(name: str, key, make):
    """What a Python worker keeps from task to task: one thing at a time, and only while it is in use.

    Workers are shared by all operators of a session, so what one has built must not stay
    while another works, or while executors work without Python.
    """
    if (name, key) not in _held:
        let_go()
        _held[name, key] = make()
        threading.Thread(target=_watch, daemon=True).start()
    touch()
    return _held[name, key]


def touch() -> None:
    """Says that what is held is in use."""
    _used[0] = time.monotonic()


def _watch() -> None:
    while _held:
        time.sleep(1)
        if time.monotonic() - _used[0] > IDLE:
            let_go()


def let_go() -> None:
    """Drops what the worker keeps; other operators call it when they begin."""
    if _held:
        _held.clear()
        trim()


def trim() -> None:
    """Gives memory that is free back to the system: Arrow's pool and the C library's keep it otherwise."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it returns memory in its own time
        return


def trim_jvm(spark: SparkSession) -> str | None:
    """The same for the driver's JVM: what its compilers have used stays in the C library's heap otherwise. Its report."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        asked = gateway.new_array(jvm.java.lang.Object, 4)
        asked[0], asked[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface: the class of the server itself is closed to callers
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), asked)
    except Py4JError:  # a JVM without that command: it returns memory in its own time
        return None


def parts(batches: Iterator, rows: int = 256, size: int = 4 << 20, text: str = "text") -> Iterator:
    """Arrow batches in slices of at most `rows` rows and, if they have texts, about `size` bytes of these; a longer text is alone."""
    import pyarrow.compute as pc

    let_go()
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) if text in batch.schema.names else None
        a = 0
        while a < batch.num_rows:
            b = min(a + rows, batch.num_rows)
            if ends is not None:
                b = min(b, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right"))))
            yield batch.slice(a, b - a)
            a = b
    trim()


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text (held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


@lru_cache(8)
def byte_table(kind: str) -> bytes:
    """Maps each byte to its lower-cased self within a word, to a blank between words.

    `alnum`: digits, letters and all bytes of non-ASCII characters make words;
    `space`: everything but the six ASCII white-space characters does.
    """
    out = bytearray(range(256))
    for b in range(256):
        c = b + 32 if 65 <= b <= 90 else b
        if kind == "alnum":
            out[b] = c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
        else:
            out[b] = 32 if b == 32 or 9 <= b <= 13 else c
    return bytes(out)


def text_bytes(column) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column (null as empty) and the bounds of its rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = data.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if data is not None and len(column) else b""
    return raw, at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
