"""Helpers the operators of this package share: inputs, tables between steps, positions, arrays."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor.session import shared_dir

#: White space of the word rules: blank, tab, line feed, vertical tab, form feed, carriage return.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and go on from the written rows."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``function`` for ``mapInArrow``, giving free memory back to the system when a task ends.

    Workers of earlier stages stay alive beside the JVM; without this they keep what their largest batch took.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Hands free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there with the GNU library only
    if trim:
        trim(0)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, row by row; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def one_text_each(docs: DataFrame) -> DataFrame:
    """``texts`` with ids that are unique and not null, for operators that work by id.

    Rows without an id cannot be named in a result and are left out. Of rows that repeat an id
    the one with the greatest text stays. Only ids are counted; texts move only when some id repeats.
    """
    rows = texts(docs).where("doc_id IS NOT NULL")
    repeated = rows.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return rows.groupBy("doc_id").agg(F.max("text").alias("text")) if repeated else rows


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without nulls, starting at 0."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_starts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the bytes that are in words, and of those that begin one; texts never run together."""
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = inside[first]
    return inside, begins


def stretches(at: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring texts of about ``most`` bytes together; a longer text is a run of its own."""
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
        yield low, high
        low = high


def mixed_bits(numbers: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers scrambled one to one."""
    numbers = (numbers ^ (numbers >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    numbers = (numbers ^ (numbers >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return numbers ^ (numbers >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mixed_bits(np.arange(1, 257, dtype=np.uint64) * _BASE)


@lru_cache(maxsize=1)
def power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` powers of the base of rolling numbers, and their inverses."""
    tables = []
    for factor in (_BASE, _INVERSE):
        powers = np.full(size, factor)
        powers[:1] = 1
        tables.append(np.multiply.accumulate(powers))
    return tables[0], tables[1]


def byte_numbers(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


#: Words up to this length are read eight bytes at a time, longer ones by the library.
_LONG_WORD = 256


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit number for each word that depends on its bytes alone, another one for each ``seed``.

    Blocks of eight bytes are mixed into the number one after another, so no regular pattern of bytes cancels out.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    number = mixed_bits(length.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & (1 << 64) - 1))
    short = np.flatnonzero(length <= _LONG_WORD)
    at = 0
    while len(short):
        left = length[short] - at
        keep = np.uint64(8) * np.minimum(left, 8).astype(np.uint64)
        block = eight[starts[short] + at] & (~np.uint64(0) >> (np.uint64(64) - keep))
        number[short] = mixed_bits((number[short] ^ block) * _BASE + np.uint64(0x27D4EB2F165667C5))
        at += 8
        short = short[left > 8]
    body = memoryview(data)
    for i in np.flatnonzero(length > _LONG_WORD).tolist():
        number[i] = xxhash.xxh3_64_intdigest(body[starts[i] : ends[i]], seed)
    return number


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and how many each text has."""
    inside, begins = word_starts(data, at)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | begins[1:]
    return np.flatnonzero(begins), np.flatnonzero(closes) + 1, sums_between(begins, at)


def smallest_reachable(names: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of a few things the smallest name reachable by pairs of their places."""
    label = names.copy()
    if pairs:
        x, y = np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs])
        while True:
            low, before = np.minimum(label[x], label[y]), label.copy()
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            if (label == before).all():
                break
    return label


def sums_between(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each of the stretches between neighbouring offsets."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def letters_of_bytes() -> dict[str, int]:
    """Bytes by the letters that stand for them in a byte-level vocabulary: printable ones for themselves,
    the others, in order, from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Remembered(dict):
    """Values found once for each key. The keys of the last ``2 * limit`` findings are remembered, in two
    generations, so what is asked for often stays; long keys are found anew each time."""

    def __init__(self, find: Callable[[str], object], limit: int, longest: int = 64) -> None:
        super().__init__()
        self._find, self._limit, self._longest, self._older = find, limit, longest, {}

    def __missing__(self, key: str) -> object:
        value = self._older.get(key)
        if value is None:
            value = self._find(key)
        if len(key) <= self._longest:
            if len(self) >= self._limit:
                self._older = dict(self)
                self.clear()
            self[key] = value
        return value


def unit_interval(*columns: Column) -> Column:
    """A number in (0, 1) that depends on the given values alone."""
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def with_running_total(df: DataFrame, order: Sequence[str], value: str, purpose: str) -> DataFrame:
    """Adds ``position`` (0, 1, ... in the global order) and ``before`` (sum of ``value`` over earlier rows).

    The rows are sorted into ranges; each range counts for itself, and the driver sees two numbers
    for each range only. ``order`` must end in something unique where ties matter.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("range_", T.IntegerType())])
    schema = schema.add("position", T.LongType()).add("before", T.LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, rows, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            size = np.asarray(batch.column(value).fill_null(0)).astype(np.int64)
            before = total + np.cumsum(size) - size
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(np.full(len(size), number, np.int32)),
                    pa.array(np.arange(rows, rows + len(size), dtype=np.int64)),
                    pa.array(before.astype(np.int64)),
                ],
                names=schema.names,
            )
            rows, total = rows + len(size), total + int(size.sum())

    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = kept(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(lean(count), schema), purpose)
    ends = local.groupBy("range_").agg(F.count("*").alias("rows"), F.sum(value).alias("total")).orderBy("range_").collect()
    starts, rows, total = [], 0, 0
    for end in ends:
        starts.append((end["range_"], rows, total))
        rows, total = rows + end["rows"], total + int(end["total"] or 0)
    offsets = df.sparkSession.createDataFrame(starts or [(-1, 0, 0)], "range_ int, rows_ long, total_ long")
    return (
        local.join(F.broadcast(offsets), "range_")
        .withColumn("position", F.col("position") + F.col("rows_"))
        .withColumn("before", F.col("before") + F.col("total_"))
        .drop("range_", "rows_", "total_")
    )


_MAP_BITS = 1 << 23


class IdMap:
    """Which ids may be in a table: a bit map of fixed size, never wrong about those that are.

    It keeps rows out of a shuffle that have nothing to meet there; where ids outnumber its bits it only
    keeps out fewer.
    """

    def __init__(self, ids: DataFrame) -> None:
        place = F.pmod(F.xxhash64("doc_id"), F.lit(_MAP_BITS))
        bit = F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(doc_id), {_MAP_BITS}) % 32 AS INT))")
        words = ids.select(F.col("doc_id").cast("long").alias("doc_id")).select((place / 32).cast("int").alias("word"), bit.alias("bit"))
        bits = np.zeros(_MAP_BITS // 32, np.int64)
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most _MAP_BITS / 32 rows
        bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        del found
        give_back()
        self._bits = ids.sparkSession.sparkContext.broadcast(bits)

    def split(self, docs: DataFrame, inside: bool) -> DataFrame:
        """The rows of ``docs``, all columns, that are or are not in the map."""
        shared, columns = self._bits, len(docs.columns)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = np.asarray(batch.column(columns))
                there = (shared.value[place >> 5] >> (place & 31)) & 1 == 1
                yield batch.filter(pa.array(there if inside else ~there)).select(range(columns))

        mark = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(_MAP_BITS))
        return docs.select("*", mark.alias(fresh(docs, "mark")[0])).mapInArrow(lean(choose), docs.schema)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that no column of ``docs`` has."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def without_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose ``doc_id`` is not in the column ``doc_id`` of ``dropped``."""
    dropped = kept(dropped.select("doc_id").distinct(), "dropped")
    ids = IdMap(dropped)
    name = fresh(docs, "gone")[0]
    gone = dropped.withColumnRenamed("doc_id", name).hint("merge")
    maybe = ids.split(docs, True)
    return ids.split(docs, False).unionAll(maybe.join(gone, maybe["doc_id"] == gone[name], "left_anti"))


def one_row_each(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with ids that are unique and not null, by the rule of ``one_text_each``."""
    rows = docs.where("doc_id IS NOT NULL")
    if not rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return rows
    best = rows.groupBy("doc_id").agg(F.max_by(F.struct("*"), F.coalesce("text", F.lit(""))).alias("row"))
    return best.select("row.*")
