"""Shared plumbing of the training-data operators: durable tables, bounded Arrow slices, folds."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import ship_package

#: Bytes that one Arrow batch from the JVM may hold, and code points of one slice worked on at once.
BATCH_BYTES = 8 << 20
SLICE_CHARS = 1 << 20
#: A key counts as hot that more than one HOT-th of all rows have: there are fewer than HOT of them.
HOT = 1_000
#: ASCII white space as the word contracts define it.
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(r"[\x20\x09-\x0D]")


#: Paths of the tables that materialise() wrote and discard() may delete.
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, where that is unset on a local master (tests), one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sievework-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage is cut and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote, once nothing that is still to run reads them."""
    for df in tables:
        spark, path = df.sparkSession, _written.pop(df, None)
        if path:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def attach(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of table, which has one row a key and in _rows the number of rows that have it; null keys have none.

    Rows of hot keys meet their fewer than HOT rows of the table by broadcast, the others in a shuffle without skew.
    """
    hot = F.broadcast(table.filter(F.col("_rows") * HOT > total).drop("_rows"))
    some = rows.filter(F.col(key).isNotNull())
    rest = some.join(hot.select(key), key, "left_anti").join(table.filter(F.col("_rows") * HOT <= total).drop("_rows"), key, "left")
    return some.join(hot, key).unionByName(rest).unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, so that long texts never fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bound_batches(df.sparkSession)
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batch: pa.RecordBatch, text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about so many bytes of text; a single longer text is its own run."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64).cumsum()
    at = 0
    while at < n:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + chars, side="right")))
        yield batch.slice(at, to - at)
        at = to


def pieces(text: str, chars: int = SLICE_CHARS) -> Iterator[tuple[int, str]]:
    """(offset, part) of a long text, cut before ASCII white space; a longer run of anything else stays whole."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + chars)
        to = cut.start() if cut else len(text)
        yield at, text[at:to]
        at = to


def annotate(docs: DataFrame, text_col: str, fn: Callable[[list[str | None]], list[pa.Array]], added: str, kinds: list[pa.DataType]) -> DataFrame:
    """All columns of docs as they are, and new ones of each row's text. Names may clash: columns go by position."""
    n, at = len(docs.columns), docs.columns.index(text_col)
    schema = ", ".join(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    names = [*[f"_{i}" for i in range(n)], *[f"_new{k}" for k in range(len(kinds))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"_{at}"):
                new = fn(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *[x.cast(k) for x, k in zip(new, kinds)]], names)

    return map_arrow(docs.toDF(*names[:n]), run, f"{schema}, {added}")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds, is 0; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """(text, label) of at most per_class rows a class, of texts of at most max_chars code points.

    The bound is the documented parameter of the classifiers. Rows are those outside the held-out fold with
    the smallest hash of their id, so the sample is the same on every run; ids outside the labels never count.
    """
    text = docs.select(F.col("doc_id"), F.col("text")).filter(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    # twice the bound, as some ids have no text or too long a one
    ids = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class)
        ids = some if ids is None else ids.unionByName(some)
    rows = text.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")  # ids: at most 4 * per_class rows
    # Both classes in one pass over the documents; each task keeps the first per_class of a class before the shuffle.
    nth = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id", "text"))
    first = rows.withColumn("nth", nth).filter(F.col("nth") <= per_class).select("text", "y", "nth").collect()
    return [(r["text"], r["y"]) for r in sorted(first, key=lambda r: (r["y"], r["nth"]))]
