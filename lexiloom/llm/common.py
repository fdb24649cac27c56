"""Helpers shared by the training-data operators: staged tables, salted joins, byte-bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.stages import clear_staged, delete, shared_dir, staged  # noqa: F401

#: Code points that the contracts count as white space: \x20 and \x09-\x0D.
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: At most so many keys can each hold more than one HOT_KEYS-th of a table's rows.
HOT_KEYS = 10_000


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value once for body; a column used inside a lambda may otherwise be computed again for each element."""
    return F.transform(F.array(value), body)[0]


stage = staged


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no pending plan reads any more, and let Spark drop what finished stages broadcast.

    Executors keep every finished stage's broadcasts in their memory until the driver collects garbage, which a driver with
    little to do may not for half an hour; an operator of hundreds of stages fills their heaps with them.
    """
    for df in frames:
        path = getattr(df, "staged_path", None)
        if path:
            delete(df.sparkSession, path)
    if frames:
        frames[0].sparkSession._jvm.System.gc()


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], row: list[Column], how: str = "left", salts: int = 8) -> DataFrame:
    """Equi-join whose left side may hold a third of its rows under one key.

    right has at most one row a key and, by what its maker keeps, under a tenth of left's rows or a row a host; it is repeated
    `salts` times, and left rows are dealt over (keys, salt) by a hash of `row`. Keys must be non-null (coalesce them first).
    """
    deal = F.pmod(F.xxhash64(*row), F.lit(salts)).cast("int")
    return (
        left.withColumn("_salt", deal)
        .join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "_salt"], how)
        .drop("_salt")
    )


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """Equi-join to a staged right side with one row a key, whose column `weight` says how many of left's `total` rows have the key.

    Keys with more than total / HOT_KEYS rows number HOT_KEYS at most, whatever the data, so they are broadcast. The others
    are joined by a shuffle, in which no key has more than that share. how: left or inner. Keys must be non-null.
    """
    hot, cold = (right.where(F.col(weight) > total // HOT_KEYS), right.where(F.col(weight) <= total // HOT_KEYS))
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys, how))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join for a right side with one row a key that is too large to repeat for salting.

    right is staged first, so both sides come to the join by shuffles of its own, and adaptive execution splits the
    partitions of hot keys (or broadcasts right, should its measured size allow).
    """
    return left.join(stage(right, "keys"), keys, how)


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about most_bytes of the text column, or a single row."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and held + n > most_bytes:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)
