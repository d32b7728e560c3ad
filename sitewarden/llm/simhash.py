"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint bit is set if it is set in more than half of the 64-bit hashes of a text's word shingles. Two
fingerprints link if they differ in at most 2 bits. The 16 segments of 4 bits of a fingerprint have 0 to 4 set bits
each; these counts are a point of a 16-dimensional grid, and the Manhattan distance of two points never exceeds the
number of differing bits. Two points at distance 2 or less have a grid point within 1 of both, so each fingerprint is
put into its own cell and the (up to 32) neighbouring ones, equal cells meet in an equi-join, and every pair that
meets is verified exactly.

Exact copies of a fingerprint are one row from the start. A cell of more than CROWD fingerprints doesn't list pairs:
its members go to the 65 values within one bit of themselves; those that meet at a value are within 2 bits of each
other by construction, and each links to the least of them. So a group of any size makes rows in proportion to its
members and loses no link.

Defined cases: texts without words have fingerprint zero, linked like any other; texts with fewer words than a
shingle take the whole sequence as one; null texts are empty; repeated rows get the same class; a null doc_id has a
row but names no class; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.common import checkpoint, components, free, hot_keys, lookup_join, map_arrow, shuffle_partitions, small, texts, trim

CROWD = 64
CROWD_LOW = 16
SAMPLE, COMMON = 4, 200_000
TILE, COLUMNS = 512, 2048
BLOCK = 200_000
SEED = 42


def shingles(text: str, size: int):
    """Word shingles of a text, ASCII lower case, separated by ASCII white space: an iterator of bytes."""
    words = text.encode().lower().split()
    if len(words) < size:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(islice(words, i, None) for i in range(size))))


def fingerprint(text: str, size: int) -> int:
    total, counts, left = 0, np.zeros(64, np.int64), shingles(text, size)
    digest = xxhash.xxh64_intdigest
    while block := [digest(s, SEED) for s in islice(left, BLOCK)]:
        bits = np.unpackbits(np.array(block, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
        total += len(block)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big", signed=True)


def fingerprint_of(values: np.ndarray) -> int:
    """The fingerprint of a text by the hashes of all its shingles."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), BLOCK):
        bits = np.unpackbits(values[at : at + BLOCK].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(values)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp holds the bit pattern as a signed long."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return map_arrow(texts(docs, id_col, text_col), run, "doc_id long, fp long")


def grid_cells(fp: Column) -> Column:
    """The grid points within 1 of a fingerprint's, null for those off the grid; a point is 16 counts of 4 bits each in
    one integer."""
    fives, threes = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    odd, even = fp.bitwiseAND(fives), F.shiftrightunsigned(fp, 1).bitwiseAND(fives)
    twos = odd.bitwiseXOR(even).bitwiseOR(F.shiftleft(odd.bitwiseAND(even), 1))
    point = twos.bitwiseAND(threes) + F.shiftrightunsigned(twos, 2).bitwiseAND(threes)
    out = [point]
    for at in range(0, 64, 4):
        count = F.shiftrightunsigned(point, at).bitwiseAND(F.lit(15))
        out += [F.when(count < 4, point + (1 << at)), F.when(count > 0, point - (1 << at))]
    return F.array(*out)


def within_one_bit(fp: Column) -> Column:
    return F.array(fp, *(fp.bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct values of fps.fp that connect all values within 2 bits of each other."""
    parts = shuffle_partitions(fps.sparkSession)
    # fingerprints are few bytes, their cells are not: so many partitions that each task's cells stay small (by another key
    # than fps has, or the step would be dropped as needless and its partitions merged); both sides of
    # the join then read one exchange of the cells, for which both need the same two columns
    cells = fps.repartition(parts, F.xxhash64("fp")).select("fp", F.explode(grid_cells(F.col("fp"))).alias("cell")).where("cell is not null").repartition(parts, "cell")
    shared = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("x"), F.max("fp").alias("y")).where("x < y").select("cell", "n")
    met = checkpoint(cells.join(shared, "cell"))
    pairs = met.where(f"n <= {CROWD}").groupBy("cell").agg(F.collect_list("fp").alias("l"))
    pairs = pairs.select(F.explode(F.expr("flatten(transform(l, a -> transform(filter(l, b -> b > a and bit_count(a ^ b) <= 2), b -> struct(a, b))))")).alias("e")).select("e.a", "e.b").distinct()
    crowd = met.where(f"n > {CROWD}").select("fp").distinct()
    spread = crowd.select("fp", F.explode(within_one_bit(F.col("fp"))).alias("value"))
    centre = spread.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    star = spread.join(centre, "value").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()
    return pairs.unionByName(star)


def classes(prints: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp); component_id is the least doc_id of the linked class."""
    prints = checkpoint(prints)
    fps = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(fps.select("fp")))
    roots = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = roots.join(least, "root").select("fp", "component_id")
    return lookup_join(prints, by_fp, "fp", hot_keys(prints, "fp")).select("doc_id", "fp", "component_id")


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the shingles that several of one text in SAMPLE have, sorted by hash; at most COMMON, those
    with the larger counts. They only say which shingles to look at last, so no link depends on the sample."""
    rows = texts(docs).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()

    def run(batches):
        for batch in batches:
            found = [np.unique(hashes(t, size)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["value"])

    counts = checkpoint(map_arrow(rows, run, "value long").groupBy("value").agg(F.count("*").alias("n")).where("n > 2"))
    total, cut = 0, None
    for n, many in sorted(counts.groupBy("n").agg(F.count("*").alias("many")).collect(), reverse=True):
        total += many
        if total > COMMON:
            break
        cut = n
    if cut is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = counts.where(F.col("n") >= cut).toArrow()
    keys, n = found.column("value").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def sketches(docs: DataFrame, size: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, fp, low, n, weight, same): low has the first of the n distinct hashes of the text's shingles, those in
    `common` last, so many that two texts of the similarity share one; weight is the mean count of the shingles in
    `common`; same is a digest of the text's words."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        keys, counts = shared.value

        def prefix(found):
            if not len(keys) or not len(found):
                return found[: prefix_size(len(found), similarity)], 0.0
            at = np.searchsorted(keys, found)
            at[at == len(keys)] = 0
            n = np.where(keys[at] == found, counts[at], 0)
            return found[np.argsort(n, kind="stable")[: prefix_size(len(found), similarity)]], float(n.mean())

        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                raw = hashes(text, size)
                found = np.unique(raw)
                out.append((fingerprint_of(raw), *prefix(found), len(found), digest_of(text)))
            fp, low, weight, n, same = zip(*out) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64()), pa.array(low, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.array(weight, pa.float64()), pa.array(same, pa.string())], ["doc_id", "fp", "low", "n", "weight", "same"])

    return map_arrow(texts(docs), run, "doc_id long, fp long, low array<long>, n long, weight double, same string")


def digest_of(text: str) -> str:
    return hashlib.blake2b(b" ".join(text.encode().lower().split()), digest_size=16).hexdigest()


def prefix_size(n: int, similarity: float) -> int:
    """So many of a set's n values that, in one order of all values, any two sets of the similarity share one of them."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def hashes(text: str, size: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, size)), np.uint64).view(np.int64)


def near_classes(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): classes of documents that link by a Jaccard similarity of their shingle sets of at least
    `similarity`.

    Texts of the same words are one from the start, a node of the graph; the different texts of one doc_id are linked.
    Fingerprints within 2 bits give candidates, and an exact prefix
    filter gives all others: in one order of all shingles, the commonest last, two sets x and y that are alike share one
    of their first |x| - ceil(similarity |x|) + 1 and |y| - ceil(similarity |y|) + 1. Every candidate pair, of either
    kind, is verified on the whole sets.
    Values that more than CROWD_LOW documents have list no pairs at first: each document meets the one there with the
    commonest shingles, the likely middle of a group. Where that leaves documents in different classes, all of the
    value's documents are held against each other in tiles, which give only the links that join classes."""
    prints = checkpoint(sketches(docs, size, similarity, common_shingles(docs, size)))
    heads = prints.groupBy("same").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("fp", "low", "n", "weight")))
    heads = checkpoint(heads.where("doc_id is not null").withColumn("node", F.monotonically_increasing_id()))
    # the first shingles are the bulk of what is kept: once they have met, nothing names them, and their files go
    prints, wide, heads = checkpoint(prints.select("doc_id", "same")), heads, checkpoint(heads.drop("low"))
    free(docs.sparkSession)
    # both sides of the join read one exchange, so both need the same two columns
    one = wide.select("node", F.explode("low").alias("value")).repartition(shuffle_partitions(docs.sparkSession), "value")
    shared = one.groupBy("value").agg(F.count("*").alias("m"), F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("value", "m")
    met = checkpoint(one.join(shared, "value").join(heads.select("node", "n", "weight"), "node"))
    del wide, one, shared
    free(docs.sparkSession)
    firsts = checkpoint(heads.groupBy("fp").agg(F.min("node").alias("first")))
    equal = heads.join(firsts, "fp").where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    first_of = lambda end: firsts.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_first"))
    close = links(firsts.select("fp")).join(first_of("a"), "a").join(first_of("b"), "b").select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b"))
    crowd = met.where(f"m > {CROWD_LOW}")
    middle = crowd.groupBy("value").agg(F.max_by("node", "weight").alias("middle"), F.max_by("n", "weight").alias("middle_n"))
    star = crowd.join(middle, "value").where(F.least("n", "middle_n") >= similarity * F.greatest("n", "middle_n") - 1e-9).select(F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b")).where("a < b")
    pairs = checkpoint(_pairs(met.where(f"m <= {CROWD_LOW}"), similarity).unionByName(star).unionByName(equal).unionByName(close).coalesce(shuffle_partitions(docs.sparkSession)).distinct())
    free(docs.sparkSession)
    trim(docs.sparkSession)  # the joins before have grown the heaps, what comes needs memory for sets
    sets = _sets(docs, size, heads, pairs.select(F.explode(F.array("a", "b")).alias("node")))

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y):
            a, b = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both >= similarity * (len(a) + len(b) - both))
        return pd.Series(out)

    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    alike_pairs = pairs.join(left, "a").join(right, "b").where(alike("x", "y")).select("a", "b")
    edges = checkpoint(alike_pairs.unionByName(_of_one_document(prints, heads)))
    free(docs.sparkSession)
    found = components(edges)
    rest = _open(crowd, found)
    if not rest.isEmpty():
        found = components(edges.unionByName(_tiles(rest, _sets(docs, size, heads, rest.select("node")), similarity)))
    roots = checkpoint(heads.select("same", "doc_id", "node").join(found, "node", "left").select("same", "doc_id", F.coalesce("root", "node").alias("root")))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    roots = roots.join(least, "root").select("same", "component_id")
    found = prints.select("doc_id", "same")
    return lookup_join(found, roots, "same", hot_keys(found, "same")).select("doc_id", "component_id")


def _of_one_document(prints: DataFrame, heads: DataFrame) -> DataFrame:
    """Links (a, b) between the different texts of one doc_id."""
    text = F.xxhash64("same")
    several = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("x"), F.max(text).alias("y")).where("x <> y").select("doc_id")
    rows = prints.select("doc_id", "same").join(small(several, 8), "doc_id", "left_semi").distinct()
    rows = checkpoint(rows.join(heads.select("same", "node"), "same").select("doc_id", "node"))
    least = rows.groupBy("doc_id").agg(F.min("node").alias("a"))
    return rows.join(least, "doc_id").where("a < node").select("a", F.col("node").alias("b")).distinct()


def _pairs(met: DataFrame, similarity: float) -> DataFrame:
    """The pairs of texts with one value whose sizes allow the similarity; a value has at most CROWD_LOW."""
    lists = met.groupBy("value").agg(F.collect_list(F.struct("node", "n")).alias("l"))
    fits = f"b.node > a.node and least(a.n, b.n) >= {similarity} * greatest(a.n, b.n) - 1e-9"
    return lists.select(F.explode(F.expr(f"flatten(transform(l, a -> transform(filter(l, b -> {fits}), b -> struct(a.node as a, b.node as b))))")).alias("e")).select("e.a", "e.b").distinct()


def _sets(docs: DataFrame, size: int, heads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set): the sorted distinct shingle hashes of the texts of the nodes."""
    wanted = checkpoint(heads.join(nodes.distinct(), "node", "left_semi").select("node", "doc_id", "same"))

    def run(batches):
        for batch in batches:
            found = batch.column("text").to_pylist()
            sets = [np.unique(hashes(t, size)).tobytes() for t in found]
            yield pa.RecordBatch.from_arrays([pa.array(map(digest_of, found), pa.string()), pa.array(sets, pa.binary())], ["same", "set"])

    rows = texts(docs).join(small(wanted.select("doc_id").distinct(), 16), "doc_id", "left_semi")
    return map_arrow(rows, run, "same string, set binary").join(small(wanted.select("same", "node"), 60), "same").select("node", "set").dropDuplicates(["node"])


def _open(crowd: DataFrame, found: DataFrame) -> DataFrame:
    """(value, m, node, root) of the crowded values whose documents are not of one class; of values that the same
    documents have, one. Values that are connected by their documents, up to TILE of these, are one value."""
    rows = crowd.select("value", "m", "node").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    who = [F.bit_xor(F.xxhash64("node")).alias("w1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("w2")]
    values = rows.groupBy("value", "m").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), *who).where("r1 <> r2")
    values = values.groupBy("m", "w1", "w2").agg(F.min("value").alias("value")).select("value")
    rows = checkpoint(rows.join(small(values, 16), "value", "left_semi"))
    least = rows.groupBy("value").agg(F.min("node").alias("a"))
    cluster = components(rows.join(least, "value").select("a", F.col("node").alias("b"))).withColumnRenamed("root", "cluster")
    sizes = cluster.groupBy("cluster").agg(F.count("*").alias("k")).where(f"k <= {TILE}")
    met = rows.join(cluster, "node").join(sizes, "cluster", "left")
    whole = met.where("k is not null").select(F.col("cluster").alias("value"), F.col("k").alias("m"), "node", "root").distinct()
    return checkpoint(met.where("k is null").select("value", "m", "node", "root").unionByName(whole))


def _tiles(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join the classes of all documents with a common value that are alike. A value's documents are
    dealt into blocks of about TILE, and each two blocks are a tile."""
    blocks = f"cast(ceil(m / {TILE}) as int)"
    rows = rest.withColumn("own", F.expr(f"cast(pmod(xxhash64(node, 2), {blocks}) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr(f"sequence(0, {blocks} - 1)")))
    rows = rows.select("value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root").join(sets, "node")

    def run(tile: pa.Table) -> pa.Table:
        ids, (label, _) = tile.column("node").to_numpy(), pd.factorize(tile.column("root").to_numpy())
        own = [np.frombuffer(x, np.int64) for x in tile.column("set").to_pylist()]
        sizes = np.array([len(x) for x in own])
        row, (column, values) = np.repeat(np.arange(len(own)), sizes), pd.factorize(np.concatenate(own))
        both = np.zeros((len(own), len(own)), np.float32)
        shared = np.bincount(column, minlength=len(values)) > 1
        column, row = (np.cumsum(shared) - 1)[column[shared[column]]], row[shared[column]]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        for at in range(0, int(shared.sum()), COLUMNS):
            a, b = np.searchsorted(column, (at, at + COLUMNS))
            part = np.zeros((len(own), COLUMNS), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            both += part @ part.T
        out = []
        for x in range(len(own)):
            near = np.flatnonzero((label != label[x]) & (both[x] >= similarity * (sizes[x] + sizes - both[x].astype(np.float64))))
            while len(near):
                out.append((min(ids[x], ids[near[0]]), max(ids[x], ids[near[0]])))
                label[label == label[near[0]]] = label[x]
                near = near[label[near] != label[x]]
        a, b = zip(*out) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.groupBy("value", "i", "j").applyInArrow(run, "a long, b long")
