"""SimHash near-dedup.

A 64-bit fingerprint takes, bit by bit, the majority over the hashes of a text's
word shingles. Fingerprints that differ in at most k bits are found by pigeonhole:
the bits are cut into seven blocks, so any two within four differing bits agree on
three whole blocks at least. Each distinct fingerprint therefore joins 35 buckets,
one for each choice of three blocks (27 or 28 bits), and whoever is within reach
shares a bucket. Buckets are compared in place, in arrays, and leave at most one
edge for each fingerprint that was linked; pairs are never listed.

A bucket larger than ``dense`` is not compared. Its fingerprints are linked by the
points halfway instead: two are within 2r bits exactly if some 64-bit point is
within r bits of both, and all that share such a point are within 2r bits of each
other, so a star at the smallest suffices (2081 points for each when k is 4). That
costs a fixed number of rows for each fingerprint, however large the group is.

Equal fingerprints are one node, so that copies are not compared at all.

Defined results: a null or empty text, or one without words, has fingerprint zero,
linked like any other; an empty table gives an empty result. Repeated rows get the
same result each.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapwing.llm.common import repeated_ids, small_arrow_batches, staged, table, text_or_empty
from lapwing.llm.graph import components

BITS, DISTANCE, SHINGLE, SEED = 64, 4, 4, 42
#: Blocks that the bits are cut into; pairs within DISTANCE agree on BLOCKS - DISTANCE of them.
BLOCKS = 7
#: Fingerprints of a bucket that are compared with each other in one task.
DENSE = 2048
#: Fingerprints with more than this part of all rows are labelled by a broadcast.
HOT = 1024
#: Shingles hashed at a time.
PIECE = 65_536


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    w = (text or "").encode().lower().split()  # bytes: white space and case of ASCII only
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    ones = np.zeros(BITS, np.int64)
    h = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        part = w[at : min(n, at + PIECE) + words - 1]
        shingles = [part] if len(part) < words else zip(*(part[k:] for k in range(words)))
        hashes = np.array([h(s, SEED) for s in map(b" ".join, shingles)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed 64-bit integer."""
    small_arrow_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty()).mapInArrow(run, "doc_id long, fp long")


def bucket_keys(fp: Column, distance: int = DISTANCE, blocks: int = BLOCKS) -> Column:
    """The buckets of a fingerprint: for each choice of blocks, its number and their bits."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(blocks), blocks - distance)):
        key = F.lit(number).cast("long")
        for k in chosen:
            size = edges[k + 1] - edges[k]
            key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << size) - 1)))
        keys.append(key)
    return F.array(*keys)


def _bucket_links(fps: np.ndarray, distance: int) -> tuple[list, list]:
    """Edges of a spanning forest of a bucket's fingerprints within ``distance``."""
    left = fps.view(np.uint64)
    a, b, waiting = [], [], []
    while len(left) or waiting:
        if not waiting:
            waiting, left = [left[0]], left[1:]
        x = waiting.pop()
        near = np.bitwise_count(left ^ x) <= distance
        if near.any():
            for y in left[near]:
                a.append(int(np.int64(x.view(np.int64))))
                b.append(int(np.int64(y.view(np.int64))))
                waiting.append(y)
            left = left[~near]
    return a, b


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) among the distinct fingerprints ``fps`` (column fp) that connect
    whatever is within ``distance`` bits."""
    keyed = fps.select("fp", F.explode(bucket_keys(F.col("fp"), distance, blocks)).alias("bucket"))
    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        open_key, held, crowded = None, [], False

        def close():
            if crowded or sum(map(len, held)) < 2:
                return [], []
            return _bucket_links(np.concatenate(held), distance)

        for batch in batches:
            key, fp = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(key)) + 1
            a, b, many = [], [], []
            for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if lo == hi:
                    continue
                if key[lo] != open_key:
                    x, y = close()
                    a += x
                    b += y
                    open_key, held, crowded = key[lo], [], False
                held.append(fp[lo:hi])
                if crowded or sum(map(len, held)) > dense:
                    many += np.concatenate(held).tolist()
                    held, crowded = [], True
            yield pa.RecordBatch.from_arrays([pa.array(a + many, pa.int64()), pa.array(b + [None] * len(many), pa.int64())], names=["a", "b"])
        x, y = close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    found = staged(dealt.mapInArrow(run, "a long, b long"), "links")
    edges = found.where("b IS NOT NULL").distinct()
    crowd = found.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if crowd.isEmpty():
        return edges
    return edges.unionByName(halfway_links(crowd, distance))


def halfway_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges among ``fps`` by their halfway points: within r = distance / 2 bits of each
    (for an odd distance, within r + 1 bits of one of the two, checked afterwards)."""
    radius = (distance + 1) // 2
    points = [0]
    for k in range(1, radius + 1):
        for bits in itertools.combinations(range(BITS), k):
            m = sum(1 << x for x in bits)
            points.append(m - (1 << BITS) if m >> (BITS - 1) else m)
    masks = fps.sparkSession.createDataFrame([(points,)], "points array<long>")
    near = fps.join(F.broadcast(masks)).select("fp", F.explode("points").alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("point"))
    least = near.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top").select("point", "b")
    return near.join(least, "point").where("fp <> b").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance).select(F.col("fp").alias("a"), "b").distinct()


def near_dedup(docs: DataFrame, distance: int = DISTANCE, words: int = SHINGLE, blocks: int = BLOCKS, dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    if distance % 2:
        raise ValueError("distance must be even: halfway points are exact for even distances only")
    rows = staged(fingerprints(docs, words), "fingerprints")
    return _labelled(rows, distance, blocks, dense).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(rows: DataFrame, distance: int, blocks: int, dense: int) -> DataFrame:
    """(doc_id, fp, component_id, group) of rows (doc_id, fp); group is a fingerprint of the component."""
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    comp = components(links(nodes.select("fp"), distance, blocks, dense)).select(F.col("node").alias("fp"), "root")
    known = comp.join(nodes, "fp")
    roots = known.groupBy("root").agg(F.min("first").alias("component_id"))
    merged = known.join(roots, "root").select("fp", "component_id", "root")
    labels = nodes.join(merged, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("root", "fp").alias("group"))
    # fewer than HOT fingerprints have more than 1 / HOT of the rows: their rows stay where they are
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = nodes.where(F.col("n") * HOT > total).select("fp")
    settled = rows.join(F.broadcast(labels.join(F.broadcast(hot), "fp", "left_semi")), "fp")
    rest = rows.join(F.broadcast(hot), "fp", "left_anti").join(labels, "fp", "left")
    return settled.unionByName(rest)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with its own columns.

    Documents are found again by their doc_id. Rows that share one, or have none, are told
    apart by their fingerprints; of those of one group and doc_id, one stays.
    """
    rows = staged(fingerprints(docs), "fingerprints")
    labels = _labelled(rows, DISTANCE, BLOCKS, DENSE)
    id_ = F.col("doc_id").cast("long")
    again = repeated_ids(rows.select("doc_id"))
    if again is None:
        stay = labels.where("doc_id = component_id").select(F.col("doc_id").alias("_stays"))
        return docs.join(stay, id_ == F.col("_stays"), "left_semi")
    stay = staged(labels.where("doc_id <=> component_id").select(F.col("doc_id").alias("_stays"), F.col("fp").alias("_print"), F.col("group").alias("_group")).distinct(), "kept-prints")
    single = docs.join(again, id_.eqNullSafe(F.col("_again")), "left_anti").join(stay.select("_stays"), id_ == F.col("_stays"), "left_semi")
    own = _with_prints(docs.join(again, id_.eqNullSafe(F.col("_again")), "left_semi"))
    kept = own.join(stay, (F.col("_own") == F.col("_print")) & id_.eqNullSafe(F.col("_stays")))
    picked = kept.groupBy("_group").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return single.unionByName(picked)


def _with_prints(docs: DataFrame) -> DataFrame:
    """The rows with their fingerprint as _own."""
    schema = docs.withColumn("_own", F.lit(0).cast("long")).schema

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*b.schema.names, "_own"])

    return docs.mapInArrow(run, schema)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
