"""Helpers that the operators share: shipping the package, shared storage, range bins, caches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomkv import shipping

#: ASCII white space of the word rule `[^\x20\x09-\x0D]+`.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of text in an Arrow batch for Python, where the session has Spark's own limit, 64 MB.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_held: dict[str, object] = {}


def ship(spark: SparkSession) -> None:
    """Ready the session for Python tasks: the package on every executor, and batches that are small however long texts are."""
    shipping.ship(spark)
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def keep_heap(free: int = 64 << 20) -> None:
    """Arrays of a few megabytes come from the heap and stay there, not from fresh pages each time; give_back returns them."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # the size from which memory is mapped, at its highest
        libc.mallopt(-1, free)  # free memory at the heap's end that stays
    except (AttributeError, OSError):  # only glibc has it
        pass


def hold(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps for its next batches and tasks; it holds one such thing at a time."""
    if name not in _held:
        let_go()
        keep_heap()
        _held[name] = make()
    return _held[name]


def let_go() -> None:
    """Drop what is held, and give free memory back to the system: workers outlive their tasks."""
    _held.clear()
    give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    sc: SparkContext = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomkv-")
        atexit.register(shutil.rmtree, folder[7:], ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write the rows once to the shared folder and read them back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote, once what was made from them is itself written."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        files = df.inputFiles()
        folder = sc._jvm.org.apache.hadoop.fs.Path(files[0]).getParent() if files else None
        if folder is not None and folder.getName().startswith(sc.applicationId):
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash; a null text becomes empty."""
    return docs.select(*[F.coalesce(F.col("text"), F.lit("")).alias("text") if n == "text" else F.col(n) for n in names])


#: The least and the most bytes of files behind a range bin. Between them, from 320 GB to 20 TB of files, there are BINS
#: of them: a shuffle has map tasks times bins blocks. Tasks stream through their bins, so memory doesn't grow with them.
BIN_BYTES, BINS = (16 << 20, 1 << 30), 20_000
#: Cut points found in one pass; more are found within the ranges between these.
COARSE = 1000
_LOW = -(1 << 63)


def bin_count(df: DataFrame) -> int:
    """Range bins for the files that a table is read from, by their size: a bin never stands for more than 1 GB of files."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size > 1 << 60:  # not from files, and not cached
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_bin = min(BIN_BYTES[1], max(BIN_BYTES[0], size // BINS))
    return max(1, -(-size // per_bin))


class RangeBins:
    """Ranges of a long column with near equal numbers of rows, nulls lowest. A value that fills several bins is spread over them by a tie.

    Of the table only the cut points come to the driver, 8 bytes for each bin, and go into the plan as one array.
    """

    def __init__(self, docs: DataFrame, key: str, bins: int | None = None):
        self.key = key
        n = bin_count(docs) if bins is None else bins
        keys = docs.select(self._value().alias("k"))
        self.cuts = self._coarse(keys, min(n, COARSE))
        if n > COARSE:
            self.cuts = self._finer(keys, self.cuts, -(-n // COARSE))

    def _value(self) -> Column:
        return F.coalesce(F.col(self.key), F.lit(_LOW)).cast("bigint")

    @staticmethod
    def _percentiles(bins: int) -> Column:
        probs = ",".join(repr(i / bins) for i in range(1, bins))
        return F.expr(f"approx_percentile(k, array({probs}), {max(10_000, bins * 20)})").alias("c")

    def _coarse(self, keys: DataFrame, bins: int) -> list[int]:
        return list((keys.select(self._percentiles(bins)).first()["c"] or []) if bins > 1 else [])

    def _finer(self, keys: DataFrame, cuts: list[int], bins: int) -> list[int]:
        """Cut each range again, without the values that fill ranges alone: these get the cuts of as many ranges."""
        heavy = sorted({c for c, d in zip(cuts, cuts[1:]) if c == d})
        rest = keys.where(~F.col("k").isin(heavy)) if heavy else keys
        got = rest.withColumn("b", self._upto("k", cuts)).groupBy("b").agg(self._percentiles(max(2, bins))).collect()
        return sorted([c for r in got for c in r["c"]] + [c for c in cuts for _ in range(bins if c in heavy else 1)])

    @staticmethod
    def _upto(value: str | Column, cuts: list[int], below: bool = False) -> Column:
        """How many cuts are at or below the value (or below it), by binary search in one array."""
        if not cuts:
            return F.lit(0)
        v = F.col(value) if isinstance(value, str) else value
        all_ = F.lit(np.array(cuts, np.int64))
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])

        def step(at: Column, p: Column) -> Column:
            cut = F.get(all_, at + p - 1)  # null beyond the end
            return F.when(cut < v if below else cut <= v, at + p).otherwise(at)

        return F.aggregate(steps, F.lit(0), step)

    @property
    def count(self) -> int:
        return len(self.cuts) + 1

    def bin(self, tie: Column) -> Column:
        """The bin; tie, from 0 to below 1, orders rows of one key."""
        upto = self._upto(self._value(), self.cuts)
        if len(set(self.cuts)) == len(self.cuts):
            return upto.cast("int")
        below = self._upto(self._value(), self.cuts, below=True)
        return F.when(upto - below < 2, upto).otherwise(below + 1 + F.floor(tie * (upto - below)).cast("int")).cast("int")


def text_tie(hash64: Column) -> Column:
    """A 64-bit hash as a share from 0 to below 1, in its order."""
    return F.least(hash64.cast("double") / 2.0**64 + 0.5, F.lit(1 - 2.0**-40))


def sums_before(totals: DataFrame, order: str, **sums: str) -> DataFrame:
    """Adds what all rows before hold of the columns named. One row for each bin, so one task can order them: 32 bytes for 16 MB of files or more."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({new: F.coalesce(F.sum(old).over(w), F.lit(0)) for new, old in sums.items()})


class TwoGenerations(dict):
    """A bounded cache: when the young generation is full it becomes the old one; what is used again is kept."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def recall(self, keys: Iterable) -> tuple[dict, list]:
        """Values of the keys that are known, and the others."""
        known, missing, old = {}, [], self.old
        for k in keys:
            v = self.get(k)
            if v is None:
                v = old.get(k)
                if v is None:
                    missing.append(k)
                    continue
                self[k] = v
            known[k] = v
        return known, missing

    def room(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


def arrow_map(df: DataFrame, batch: Callable[[pa.RecordBatch], dict | None], schema: str, holds: bool = False) -> DataFrame:
    """mapInArrow by a function from a batch to its output columns. holds: the function keeps something by hold()."""
    ship(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            let_go()
        for b in it:
            got = batch(b)
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in out], schema=out)
        give_back()

    return df.mapInArrow(run, schema)


#: doc_ids, 8 bytes each, or keys of rows, 32, that may be broadcast; beyond it joins are by shuffle.
BROADCAST_IDS = 1_000_000


def bounded(df: DataFrame) -> DataFrame:
    """Marked for broadcast only where its rows, of 32 bytes or so, are counted and few; a written table should come in."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def row_key(*names: str) -> Column:
    """A digest of the named columns, never null: rows that are alike in them share it, null values are values like others."""
    return F.md5(F.concat_ws(",", *[F.coalesce(F.md5(F.col(n).cast("string")), F.lit("null")) for n in names]))


def without_rows(docs: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """The documents whose key isn't among the rejected ones: each row follows its own verdict, with any doc_id or none."""
    rejected = materialize(rejected.select(key).distinct(), "without")
    return docs.join(bounded(rejected), key, "left_anti").select(*docs.columns)


def once(docs: DataFrame) -> DataFrame:
    """One row of each doc_id, that of the smallest text. Texts are moved only for doc_ids that occur more than once."""
    again = materialize(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "again")
    n = again.count()
    if not n:
        return docs
    again = F.broadcast(again) if n <= BROADCAST_IDS else again
    first = Window.partitionBy("doc_id").orderBy("text")
    picked = docs.join(again, "doc_id", "left_semi").withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    return docs.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(picked.select(*docs.columns))
