"""Helpers shared by the operators: table access, shared storage, text columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group of intermediate tables.
ROW_GROUP = 16 << 20
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def let_workers_import(spark: SparkSession) -> None:
    """Puts this library's root on the path of Python workers that share the driver's files."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, by Spark's own reader."""
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and
    all run on one machine, as in local tests, a temporary folder takes its
    place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again.

    This cuts the lineage: a lost executor costs a reread, and what depends on
    the order in which a task saw its rows is fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # Small row groups: a writer of long texts holds one of them in memory.
    df.write.option("compression", codec).option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*frames: DataFrame) -> None:
    """Deletes the files behind tables from :func:`materialize` that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        root = shared_dir(spark)
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
                jvm = spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release_memory() -> None:
    """Gives a worker's freed memory back to the system: workers outlive their stage and share the executor with the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc only
        trim(0)


def bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and gives it to ``body`` under a name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")


def block_count(docs: DataFrame, text: str, bytes_per_block: int) -> int:
    """How many blocks of about ``bytes_per_block`` bytes of text a table makes; one at least."""
    total = docs.select(F.sum(F.octet_length(text_or_empty(text))).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // bytes_per_block))


def frame(**columns) -> pd.DataFrame:
    """A pandas frame whose text and binary columns are plain objects, whatever pandas would infer."""
    out = {}
    for name, x in columns.items():
        if isinstance(x, np.ndarray) and x.dtype != object and x.ndim == 1:
            out[name] = pd.Series(x)
        elif isinstance(x, pd.Series):
            out[name] = x.reset_index(drop=True)
        else:
            out[name] = pd.Series(list(x), dtype=object)
    return pd.DataFrame(out)


class WordCache:
    """What a worker knows of words it has met: two generations of a bounded dict.

    ``learn`` maps a list of new words to their values.  Once the young
    generation is full it becomes the old one; words met again move back.
    """

    def __init__(self, learn, limit: int):
        self.learn, self.limit = learn, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, texts: list[list[str]]):
        """A function from word to value that knows all words of these cut texts."""
        words = set()
        for t in texts:
            words.update(t)
        if len(self.young) + len(words) > self.limit:
            self.young, self.old = {}, self.young
        missing = words.difference(self.young)
        if self.old and missing:
            old = self.old
            back = [w for w in missing if w in old]  # set methods would walk the whole dict
            self.young.update((w, old[w]) for w in back)
            missing.difference_update(back)
        if missing:
            new = list(missing)
            self.young.update(zip(new, self.learn(new), strict=True))
        return self.young.__getitem__
