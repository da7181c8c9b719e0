"""Neighbour, range and running-total computations that no single task has to hold.

A window without a bounded partition key puts a whole source (or the whole table) into one
task. The helpers below cut the rows into bounded pieces first and carry only the border
rows or totals of a piece to its neighbours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logharbor.session import durable

LINES_PER_BLOCK = 1_000_000


def epoch_micros(ts: Column) -> Column:
    """Clock microseconds since 1970, whatever the session's time zone is."""
    seconds = F.extract(F.lit("SECOND"), ts)
    whole = F.unix_date(F.to_date(ts)).cast("bigint") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return whole * 1_000_000 + (seconds * 1_000_000).cast("bigint")


def micros_between(start: Column, end: Column) -> Column:
    return epoch_micros(end) - epoch_micros(start)


def hour_start(ts: Column) -> Column:
    """The full hour, by clock arithmetic: independent of the session's time zone."""
    past = F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts), F.extract(F.lit("SECOND"), ts))
    return ts - past


def with_previous(
    df: DataFrame,
    value: str,
    output: str,
    source: str = "source",
    order: str = "line_number",
    block: int = LINES_PER_BLOCK,
) -> DataFrame:
    """Value of the previous row of the same source, in ``order``.

    Line numbers are unique within a source, so a block of ``block`` numbers is bounded
    however large the source is. The first row of a block takes the last value of the
    nearest earlier block from a table with one row per block.
    """
    keyed = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    blocks = keyed.groupBy(source, "_block").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("_last")
    )
    by_source = W.partitionBy(source).orderBy("_block")
    carried = blocks.select(source, "_block", F.lag("_last").over(by_source).alias("_carry"))
    in_block = W.partitionBy(source, "_block").orderBy(order)
    return (
        keyed.withColumn("_row", F.row_number().over(in_block))
        .withColumn("_lag", F.lag(F.col(value)).over(in_block))
        .join(carried, [source, "_block"])
        .withColumn(
            output,
            F.when(F.col("_row") == 1, F.col("_carry.v")).otherwise(F.col("_lag")),
        )
        .drop("_block", "_row", "_lag", "_carry")
    )


def salted_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    weight: str,
    row_key: Sequence[str],
    share: int = 1000,
    floor: int = 1_000_000,
) -> DataFrame:
    """Left join to a table with one row per key and the number of rows it will meet.

    A key with more than ``1/share`` of all rows is spread over several join partitions.
    At most ``share`` keys can be that heavy, so the list of them is safe to broadcast.
    Rows with a null key match nothing and are spread as well.
    """
    total = right.agg(F.sum(weight)).scalar()
    limit = F.greatest(total / F.lit(share), F.lit(floor))
    sized = right.withColumn("_salts", F.ceil(F.col(weight) / limit).cast("int"))
    heavy = sized.where(F.col("_salts") > 1).select(*keys, "_salts")
    absent = F.lit(False)
    for key in keys:
        absent = absent | F.col(key).isNull()
    spread = F.when(absent, F.lit(1024)).otherwise(F.coalesce(F.col("_salts"), F.lit(1)))
    salted = (
        left.join(F.broadcast(heavy), list(keys), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*row_key), spread).cast("int"))
        .drop("_salts")
    )
    copies = sized.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    ).drop("_salts", weight)
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def centred_counts(
    df: DataFrame,
    ts: str,
    half_seconds: int,
    output: str,
    partition: Sequence[str] = (),
) -> DataFrame:
    """Per distinct timestamp: rows at it (``n``) and rows within ± ``half_seconds``.

    Equal timestamps are counted before anything is compared, so a burst shrinks to one
    row per microsecond. Buckets are as wide as the whole frame; a timestamp is copied
    into the at most two buckets whose rows can see it.
    """
    half = half_seconds * 1_000_000
    width = 2 * half
    counted = (
        df.where(F.col(ts).isNotNull())
        .groupBy(*partition, ts)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_us", epoch_micros(F.col(ts)))
    )
    bucket_of = lambda micros: F.floor(micros / F.lit(width))
    copied = counted.withColumn(
        "_bucket",
        F.explode(F.sequence(bucket_of(F.col("_us") - half), bucket_of(F.col("_us") + half))),
    )
    # A row enters the frame of the times from half a frame before it and has left it after half a frame.
    moves = F.array(
        F.struct((F.col("_us") - half).alias("at"), F.col("n").alias("change"), F.lit(False).alias("asks")),
        F.struct((F.col("_us") + half + 1).alias("at"), (-F.col("n")).alias("change"), F.lit(False).alias("asks")),
        F.struct(F.col("_us").alias("at"), F.lit(0).cast("bigint").alias("change"), F.lit(True).alias("asks")),
    )
    return _running_frames(copied, moves, bucket_of, output, partition, ts)


def _running_frames(
    copied: DataFrame, moves: Column, bucket_of, output: str, partition: Sequence[str], ts: str
) -> DataFrame:
    """Sizes of sliding frames as running sums of what enters and leaves; for rows of crowded
    frames, summing each frame anew would take the square of their number."""
    moved = copied.select("*", F.explode(moves).alias("_move")).where(
        F.when(F.col("_move.asks"), F.col("_bucket") == bucket_of(F.col("_us"))).otherwise(
            bucket_of(F.col("_move.at")) <= F.col("_bucket")
        )
    )
    upto = W.partitionBy(*partition, "_bucket").orderBy("_move.at").rangeBetween(W.unboundedPreceding, W.currentRow)
    return moved.withColumn(output, F.sum("_move.change").over(upto)).where("_move.asks").select(*partition, ts, "n", output)


def trailing_counts(
    df: DataFrame, ts: str, window_seconds: float, output: str, partition: Sequence[str]
) -> DataFrame:
    """Per distinct key and timestamp: rows at it and rows in the half-open window before
    and at it, ``(t - window, t]``."""
    reach = int(window_seconds * 1_000_000)
    counted = (
        df.groupBy(*partition, ts)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_us", epoch_micros(F.col(ts)))
    )
    bucket_of = lambda micros: F.floor(micros / F.lit(reach))
    copied = counted.withColumn(
        "_bucket",
        F.explode(F.sequence(bucket_of(F.col("_us")), bucket_of(F.col("_us") + (reach - 1)))),
    )
    moves = F.array(
        F.struct(F.col("_us").alias("at"), F.col("n").alias("change"), F.lit(False).alias("asks")),
        F.struct((F.col("_us") + reach).alias("at"), (-F.col("n")).alias("change"), F.lit(False).alias("asks")),
        F.struct(F.col("_us").alias("at"), F.lit(0).cast("bigint").alias("change"), F.lit(True).alias("asks")),
    )
    return _running_frames(copied, moves, bucket_of, output, partition, ts)


_ROWS_PER_PIECE = 5_000_000


def _partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, or more if pieces would get too long."""
    configured = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, -(-df.count() // _ROWS_PER_PIECE))


def range_chunks(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows cut into ordered, evenly filled chunks; adds ``chunk``.

    The cut points come from a sample of the sort keys, so a unique sort key spreads any
    hot value over several chunks. The result is written to shared storage, because a
    second evaluation could sample other cut points.
    """
    ranged = df.repartitionByRange(partitions or _partitions(df), *order)
    return durable(ranged.withColumn("chunk", F.spark_partition_id()))


def running_total(
    df: DataFrame, order: str, amount: str, output: str, partitions: int | None = None
) -> DataFrame:
    """Running sum of ``amount`` in the order of a unique column."""
    chunked = range_chunks(df, [order], partitions)
    sums = chunked.groupBy("chunk").agg(F.sum(amount).alias("_sum"))
    # One row per chunk, so this window is as long as the number of partitions.
    earlier = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_off"))
    in_chunk = W.partitionBy("chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (
        chunked.join(offsets, "chunk")
        .withColumn(output, F.sum(amount).over(in_chunk) + F.col("_off"))
        .drop("chunk", "_off")
    )


def _merged_chunks(chunked: DataFrame, least: int) -> DataFrame:
    """Consecutive chunks joined until each holds at least ``least`` rows.

    Works on one counter per chunk, that is on as many numbers as there are partitions.
    """
    counts = sorted(
        (row["chunk"], row["n"])
        for row in chunked.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    mapping: list[tuple[int, int]] = []
    piece, filled = 0, 0
    for chunk, n in counts:
        mapping.append((chunk, piece))
        filled += n
        if filled >= least:
            piece, filled = piece + 1, 0
    if filled and piece:
        mapping = [(c, min(p, piece - 1)) for c, p in mapping]
    spark = chunked.sparkSession
    return spark.createDataFrame(mapping or [(0, 0)], "chunk int, piece int")


def with_halo(
    df: DataFrame,
    order: Sequence[str],
    before: int,
    after: int,
    partitions: int | None = None,
) -> DataFrame:
    """Ordered pieces plus copies of the neighbours' border rows.

    Adds ``piece`` and ``home`` (false for the copies). A frame of up to ``before``
    preceding and ``after`` following rows can then be evaluated within a piece.
    """
    chunked = range_chunks(df, order, partitions)
    pieces = chunked.join(
        F.broadcast(_merged_chunks(chunked, max(before, after, 1))), "chunk"
    ).drop("chunk")
    ascending = W.partitionBy("piece").orderBy(*[F.col(c).asc() for c in order])
    descending = W.partitionBy("piece").orderBy(*[F.col(c).desc() for c in order])
    heads = pieces.withColumn("_rank", F.row_number().over(ascending)).where(F.col("_rank") <= after)
    tails = pieces.withColumn("_rank", F.row_number().over(descending)).where(F.col("_rank") <= before)
    own = pieces.withColumn("home", F.lit(True))
    to_previous = heads.withColumn("piece", F.col("piece") - 1).withColumn("home", F.lit(False))
    to_next = tails.withColumn("piece", F.col("piece") + 1).withColumn("home", F.lit(False))
    return own.unionByName(to_previous.drop("_rank")).unionByName(to_next.drop("_rank"))
