"""Exact and near-duplicate groups of page texts: boilerplate removal, equal texts, 64-bit simhash in blocks.

Rows are (id, text). Equal fingerprints are one row from the start. The bits are cut into h + 3 blocks, h being the most
bits that may differ; two fingerprints within h bits have three equal blocks at least, so they meet in an equi-join on
some three blocks with their values. For h = 3 such a key has 32 bits, so that few meet that aren't near."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from sitewarden.functions import text as T
from sitewarden.operators.graph import components
from sitewarden.sources.tables import checkpoint

SHINGLE, BITS = 5, 64
#: Equal blocks of a key: as many as leave at most so many keys a fingerprint.
EQUAL, KEYS = 3, 100
#: Distances of pairs that were never compared.
UNCOMPARED = 4294967295


def boilerplate(rows: DataFrame, min_pages: int) -> DataFrame:
    """(shingle): word 5-grams that at least min_pages texts have."""
    words = rows.select("id", F.explode(F.array_distinct(T.shingles(T.tokens(F.col("text")), SHINGLE))).alias("shingle"))
    return words.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("shingle")


def strip_boilerplate(rows: DataFrame, min_pages: int) -> DataFrame:
    """(id, words): the words of each text that no boilerplate shingle covers, in order.

    A shingle covers SHINGLE words from its place; places meet the boilerplate in an equi-join and come back as one
    row a text, the covered places."""
    words = rows.select("id", T.tokens(F.col("text")).alias("words"))
    if rows.limit(min_pages).count() < min_pages:
        return words
    placed = words.select("id", F.posexplode(T.shingles(F.col("words"), SHINGLE)).alias("pos", "shingle"))
    hits = placed.join(boilerplate(rows, min_pages), "shingle")
    covered = hits.groupBy("id").agg(F.collect_set("pos").alias("starts"))

    @F.pandas_udf("array<string>")
    def keep(words: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for own, at in zip(words, starts):
            if at is None or not len(at):
                out.append(list(own))
                continue
            mark = np.zeros(len(own) + 1, np.int64)
            np.add.at(mark, np.asarray(at), 1)
            np.add.at(mark, np.minimum(np.asarray(at) + SHINGLE, len(own)), -1)
            out.append([w for w, c in zip(own, np.cumsum(mark)) if not c])
        return pd.Series(out, dtype=object)

    return words.join(covered, "id", "left").select("id", keep("words", "starts").alias("words"))


def _fnv(word: str) -> int:
    h = 0xCBF29CE484222325
    for b in word.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(LongType())
def simhash_udf(words: pd.Series) -> pd.Series:
    """Votes of one a bit and occurrence of a word's FNV-1a hash; a tie sets the bit."""
    known: dict[str, int] = {}
    out = []
    for own in words:
        if own is None or not len(own):
            out.append(-1)
            continue
        for w in own:
            if w not in known:
                known[w] = _fnv(w)
        bits = np.unpackbits(np.array([known[w] for w in own], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out.append(int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) >= len(own)).tobytes(), "big", signed=True))
    return pd.Series(out, dtype="int64")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_keys(max_hamming: int) -> list[int]:
    """Masks of bits, of which two fingerprints within max_hamming agree in one at least."""
    for equal in range(EQUAL, 0, -1):
        n = max_hamming + equal
        edges = [BITS * i // n for i in range(n + 1)]
        blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
        masks = [sum(chosen) for chosen in combinations(blocks, equal)]
        if len(masks) <= KEYS:
            break
    return masks


def near_pairs(prints: DataFrame, max_hamming: int) -> DataFrame:
    """(a, b, distance): the pairs of distinct fingerprints within max_hamming."""
    signed = lambda mask: F.lit(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    keys = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(signed(m)).alias("value")) for i, m in enumerate(block_keys(max_hamming))))
    keys = prints.select("fp").distinct().select("fp", F.explode(keys).alias("k")).select("fp", "k.mask", "k.value")
    left, right = keys.withColumnRenamed("fp", "a"), keys.withColumnRenamed("fp", "b")
    pairs = left.join(right, ["mask", "value"]).where("a < b").withColumn("distance", hamming(F.col("a"), F.col("b")))
    return pairs.where(F.col("distance") <= max_hamming).select("a", "b", "distance").distinct()


def groups(rows: DataFrame, min_pages: int = 3, min_tokens: int = 12, max_hamming: int = 3) -> DataFrame:
    """(method, fingerprint, distance, members): exact groups, and clusters of near ones outside exact groups."""
    stripped = strip_boilerplate(rows, min_pages).where(F.size("words") > 0)
    rest = F.array_join("words", " ")
    stripped = checkpoint(stripped.select("id", F.sha2(rest, 256).alias("rest"), rest.alias("text"), F.size("words").alias("n"), simhash_udf("words").alias("fp")))
    sizes = stripped.groupBy("rest").agg(F.count("*").alias("copies"))
    marked = stripped.join(sizes, "rest")
    equal = marked.where("copies > 1").groupBy("rest").agg(F.sort_array(F.collect_list("id")).alias("members"), F.any_value("text").alias("text"))
    exact = equal.select(F.lit("exact").alias("method"), T.hex64(T.fnv1a64(F.col("text"))).alias("fingerprint"), F.lit(None).cast("long").alias("distance"), "members")
    single = checkpoint(marked.where((F.col("copies") == 1) & (F.col("n") >= min_tokens)).select("id", "fp"))
    pairs = checkpoint(near_pairs(single, max_hamming))
    roots = components(pairs.select("a", "b"))
    print_sizes = single.groupBy("fp").agg(F.count("*").alias("k"))
    clustered = single.join(print_sizes, "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").where("root is not null or k > 1").withColumn("root", F.coalesce("root", "fp"))
    members = clustered.groupBy("root").agg(F.sort_array(F.collect_list("id")).alias("members"), F.min_by("fp", "id").alias("fp"), F.count_distinct("fp").alias("k"))
    compared = pairs.join(roots, F.col("a") == F.col("node")).groupBy("root").agg(F.max("distance").alias("most"), F.count("*").alias("found"))
    near = members.join(compared, "root", "left")
    all_pairs = F.expr("k * (k - 1) div 2")
    distance = F.when(F.coalesce("found", F.lit(0)) < all_pairs, F.lit(UNCOMPARED)).otherwise(F.coalesce("most", F.lit(0))).cast("long")
    return exact.unionByName(near.select(F.lit("near").alias("method"), T.hex64(F.col("fp")).alias("fingerprint"), distance.alias("distance"), "members"))
