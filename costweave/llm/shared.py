"""Helpers the training-data operators share."""

from __future__ import annotations

import contextlib
import functools
import os
import re
import shutil
import tempfile
from collections.abc import Callable, Hashable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costweave.sources.scratch import scratch_path

#: Text is handled in slices of about so many bytes, which bounds what a Python task holds.
SLICE_BYTES = 3_000_000
#: A-Z to a-z and nothing else; str.lower would also change other letters.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, which sends this package to the workers first where they would not find it."""

    @functools.wraps(query)
    def run(spark: SparkSession, *rest) -> DataFrame:
        context, root = spark.sparkContext, Path(__file__).resolve().parents[2]
        known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
        if str(root) not in known and not getattr(context, "_costweave_shipped", False):
            archive = os.path.join(tempfile.mkdtemp(prefix="costweave-"), "costweave")
            context.addPyFile(shutil.make_archive(archive, "zip", root, "costweave"))
            context._costweave_shipped = True
        return query(spark, *rest)

    return run


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The tables written within each passing_tables() that is open, innermost last.
_PASSING: list[list[str]] = []


def written(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """The rows, written to the shared folder and read back: cuts the lineage.

    Lost executors lose nothing, and later steps do not compute the rows again. ``kept`` tables outlive the
    innermost passing_tables().
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    layers = _PASSING[:-1] if kept else _PASSING
    if layers:
        layers[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written within, but for kept ones, are removed at the end: nothing may be read from them afterwards."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            removed(spark, path)


#: Rows of a batch on its way between Spark and Python, where steps that hold whole texts or sets follow each other.
BATCH_ROWS = 2000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written within passes between Spark and Python in batches of BATCH_ROWS rows at most, which bounds what
    both hold outside Spark's memory; the session's own limit counts again at the end."""
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


#: What this worker process remembers from one task to the next, by the work that it is for.
_REMEMBERED: dict[Hashable, Any] = {}


def remembered(work: Hashable, make: Callable[[], Any]) -> Any:
    """What this process remembers for ``work``, made by the first task that asks for it, and nothing for other work."""
    forget_others(work)
    if work not in _REMEMBERED:
        _REMEMBERED[work] = make()
    return _REMEMBERED[work]


def forget_others(work: Hashable = None) -> None:
    """Lets go of what earlier tasks of this process remember for other work. Spark gives a worker to one step after
    the other, so what a step needs would otherwise come on top of what those before it left."""
    others = [w for w in _REMEMBERED if w != work]
    for other in others:
        del _REMEMBERED[other]
    if others:
        pa.default_memory_pool().release_unused()


def columns_of(df: DataFrame) -> list[Column]:
    """The columns by name, whatever signs the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh_name(df: DataFrame, base: str) -> str:
    """A name for a working column that none of the columns has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: Places of the bitmap that tells most rows that are not among the chosen ones before their texts are shuffled.
FILTER_BITS = 1 << 26


def with_maybe(df: DataFrame, key: str, chosen: DataFrame, name: str, places: int = FILTER_BITS) -> DataFrame:
    """The rows with a boolean column ``name``, which is true where ``key`` is that of a row of ``chosen`` and seldom
    elsewhere. It is told by a bitmap over a hash, of 8 MB at most however many rows are chosen, so nothing of
    ``df`` is shuffled; an exact join of the rows with true may follow."""
    place = F.pmod(F.xxhash64(key), F.lit(places))
    bucket, bits = fresh_name(df, "bucket"), fresh_name(df, "bits")
    maps = (chosen.groupBy(F.bitmap_bucket_number(place).alias(bucket))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(bits)))
    position = F.bitmap_bit_position(place)
    byte = F.substring(F.col(bits), F.floor(position / 8).cast("int") + 1, F.lit(1))
    hit = F.call_function("shiftright", F.conv(F.hex(byte), 16, 10).cast("int"), (position % 8).cast("int")) % 2 == 1
    return (df.join(F.broadcast(maps), F.bitmap_bucket_number(place) == F.col(bucket), "left")
            .select(*columns_of(df), F.coalesce(hit, F.lit(False)).alias(name)))


def without_keys(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose ``key`` is not among those of ``gone``, without that column; a null stays. Rows that the bitmap does
    not take for any of ``gone`` stay where they are, the others meet ``gone`` in one kind of join at every size."""
    maybe = fresh_name(df, "maybe")
    told = with_maybe(df, key, gone, maybe)
    kept = columns_of(df.drop(key))
    near = told.where(F.col(maybe)).join(gone.select(key).hint("shuffle_merge"), key, "left_anti")
    return told.where(~F.col(maybe)).select(kept).unionByName(near.select(kept))


def no_letter_case(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def fold(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8").translate(LOWER)


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return fold(text).split()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the text column of each holds about ``limit`` bytes (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)


def remainder_of_crc(column: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; a null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(modulus))


#: A space where a text may be cut: something visible on both sides. All of Python's white space
#: counts, which is more than any tokenizer's, so a cut never falls inside a run of white space.
UNSAFE_SPACE = re.compile(r" (?:(?<=\s )|\s|\Z|(?<=\A ))")


def chunks(text: str) -> list[str]:
    """The text split at single spaces; all but the first stand for a chunk with its space before.

    Byte-level pre-tokenizers that attach one space to the following word always begin a piece
    at such a space, so the ids of a text are the ids of its chunks, one after the other.
    Where spaces meet other white space the chunks stay together.
    """
    parts = text.split(" ")
    if UNSAFE_SPACE.search(text) is None:
        return parts
    out = parts[:1]
    for part in parts[1:]:
        if not part or part[0].isspace() or not out[-1] or out[-1][-1].isspace():
            out[-1] = f"{out[-1]} {part}"
        else:
            out.append(part)
    return out
