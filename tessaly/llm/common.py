"""What the training-data operators share: word rules, hashing, bounded caches, shared folders."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of anything but these six ASCII characters.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of the bitmap that sieves texts before they are joined: 8 MB at any size of the input.
SIEVE_BITS = 1 << 26
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`, read by Spark whatever the store is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one where none is set and all tasks run in this machine's one process, as in tests."""
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessaly-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of what ``stored`` returned, once nothing reads them any more."""
    spark = df.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/stored-"
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if root.split(":", 1)[-1].lstrip("/") in path.toString():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, with its lineage cut, so that a lost executor costs a reread."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words_column(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SEPARATORS, " " * len(SEPARATORS))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def n_words_column(text: Column) -> Column:
    """How many words a text has (long); null has 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


_TO_SPACE = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def words_of(text: str | None) -> list[str]:
    """The words of a text, in plain Python, by the same rule as ``words_column``."""
    return [w for w in text.translate(_TO_SPACE).split(" ") if w] if text else []


class Memo(dict):
    """A dict that computes what it lacks and starts anew beyond `limit` entries, so that it stays bounded."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Recent(dict):
    """A dict that computes what it lacks and forgets what was asked for longest ago, so that it holds `limit` entries at most.

    Two halves: a full one becomes the old one, from which what is asked for
    again returns. Keys longer than `longest` are computed each time. No value is None.
    """

    def __init__(self, make: Callable, limit: int, longest: int):
        super().__init__()
        self.make, self.half, self.longest, self.old = make, max(1, limit // 2), longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def lean(run: Callable, keeps: bool = True) -> Callable:
    """A function of Arrow batches that gives its worker's free memory back at the end of a task, as workers wait for others beside the executor.

    One that `keeps` nothing for its next tasks gives back first what another operator kept.
    """

    def wrapped(batches):
        if not keeps:
            forget()
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def small_batches(df: DataFrame, rows: int = 1_000) -> DataFrame:
    """`df`, whose session now hands rows to Python workers some at a time: whole texts by ten thousands are tens of MB, several times over on both sides.

    A setting of the session, so it holds for what it runs later, too; a smaller one stays. Results don't depend on it.
    """
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def trim() -> None:
    """Returns what Arrow's pool and the C library keep of freed memory; where there is no such call, nothing."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


_TRIMMED = {"at": -1e9}


def trim_driver(spark: SparkSession, least_s: float = 2.0) -> bool:
    """Returns what the C library keeps of freed memory in the driver's JVM and its Python; whether the JVM did so.

    Each query compiles code and uses buffers outside the heap on many threads, whose
    shares of the C library's memory stay with the process. Not sooner than
    `least_s` seconds after the last time; a JVM without such a command goes on as it is.
    """
    if time.monotonic() - _TRIMMED["at"] < least_s:
        return False
    _TRIMMED["at"] = time.monotonic()
    trim()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        # the server's class is not public to others, its interface is
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        invoke.invoke(server, args)
    except Py4JError:
        return False
    return True


def parts_of(batch: pa.RecordBatch, rows: int = 400, characters: int = 400_000):
    """Slices of a batch with a column `text`, of some rows and characters at most; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and (total + n > characters or i - begin >= rows):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def gathered(flat: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of these sizes that make up `flat`, the wanted ones in a row, and their sizes."""
    own = sizes[wanted]
    stop = np.cumsum(own)
    shift = (np.cumsum(sizes) - sizes)[wanted] - stop + own
    return flat[np.repeat(shift, own) + np.arange(own.sum())], own


def strings(values: pa.Array) -> list:
    """An array's strings or byte strings, many times sooner than ``to_pylist``, which makes a scalar of each."""
    return values.to_numpy(zero_copy_only=False).tolist()


_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable):
    """What `make` gives, kept in a Python worker for its next tasks; only the last one asked for, so that a worker that serves one operator after another holds the caches of one."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Gives back what the worker keeps for its next tasks."""
    if _KEPT:
        _KEPT.clear()
        trim()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over an array of uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet below the shared checkpoint folder and read back.

    It cuts lineage as a checkpoint does, keeps columns apart, and gives Spark
    a size to choose joins by. As operators write many tables one after another, the
    driver gives back freed memory here.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def in_sieve(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Adds whether the row's `id` may be in `ids`, without moving a row.

    A bitmap of SIEVE_BITS bits, whatever the size of the input, holds a hash
    of each wanted id; rows that aren't in it surely aren't wanted. It travels
    as a row that is joined to all, Spark's own bitmaps of 4 KB each.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE_BITS)) + 1  # noqa: E731 - Spark's first bitmap begins with value 1
    marks = ids.select(place("id").alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    marks = stored(marks)
    number, position = F.bitmap_bucket_number(place("id")), F.bitmap_bit_position(place("id"))
    own = rows.select("*", number.alias("_bucket"), position.alias("_bit"))
    met = own.join(F.broadcast(marks.withColumnRenamed("bucket", "_of")), F.col("_bucket") == F.col("_of"), "left")
    byte = F.conv(F.hex(F.substring("bits", (F.col("_bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
    return met.select(*rows.columns, held.alias(name))
