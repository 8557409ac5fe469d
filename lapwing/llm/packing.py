"""Best-fit packing by minimum bin slack.

A sequence is filled by subset-sum dynamic programming over the lengths that are
left: bitsets of reachable sums, started from the longest piece, give the fullest
feasible combination, which is taken out; then the next sequence. Only the number of
pieces of each length matters for that, so the packing is worked out on a histogram
(as many numbers as a sequence has tokens, whatever the input's size), and a
combination is taken as often as the histogram allows. Each time, one of its lengths
runs short of what the combination takes, and what it takes falls each time it does:
at most sum(capacity / length) combinations, 16,000 for 2048 tokens, exist in all.
That plan is what is broadcast.

Tasks number their pieces within each length; sums over tasks turn these into ranks
within the whole table, and a rank's place in the plan gives sequence and offset.

Defined results: a null text counts as empty and makes a piece of the closing id
only; an empty table gives an empty result; repeated rows are packed each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.llm.bpe import default_vocabulary, word_bpe
from lapwing.llm.common import small_arrow_batches, staged, table, text_or_empty

CAPACITY = 2048
CLOSING_ID = 0


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of lengths (at most counts of each) with the largest sum <= room."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for size in sorted(counts, reverse=True):
        left = min(counts[size], room // size)
        k = 1
        while left > 0:
            take = min(k, left)
            steps.append((size, take, reach))
            reach |= reach << (size * take) & mask
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            used[size] = used.get(size, 0) + take
            total -= size * take
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination, times) until no piece is left."""
    left = {k: n for k, n in histogram.items() if n}
    out = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        used = fullest({k: n for k, n in rest.items() if k <= capacity - longest}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((used, times))
    return out


def places(combinations: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces in each sequence, offset)."""
    rows: dict[int, list] = {}
    first_rank: dict[int, int] = {}
    sequence = 0
    for used, times in combinations:
        offset = 0
        for size in sorted(used, reverse=True):
            n = used[size]
            rows.setdefault(size, []).append((first_rank.get(size, 0), sequence, n, offset))
            first_rank[size] = first_rank.get(size, 0) + n * times
            offset += n * size
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the piece's number among those of
    its length in its task."""
    small_arrow_batches(docs.sparkSession)

    def run(batches):
        bpe = word_bpe(path)
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = bpe.encode(text).tobytes() + CLOSING_ID.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = raw[at : at + 4 * capacity]
                    length = len(ids) // 4
                    for to, value in zip(out, (doc, piece, at // 4, length, zlib.crc32(ids), seen[length]), strict=True):
                        to.append(value)
                    seen[length] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(out, types, strict=True)), pa.array([task] * len(out[0]), pa.int32())], names=["doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, nth long, task int")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    spark = docs.sparkSession
    cut = staged(pieces(docs, path or default_vocabulary(), capacity), "pieces")
    counts = staged(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"))
    # the counts are small on disk but not in memory, and grow with the tasks: never a broadcast
    ranked = cut.join(first.hint("merge"), ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def place(batches):
        at = sent.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                mine = length == size
                rows = at[int(size)]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                nth = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 1] + nth // row[:, 2]
                offset[mine] = row[:, 3] + nth % row[:, 2] * size
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
