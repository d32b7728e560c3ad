"""Quality classifier: an interpolated modified Kneser-Ney model of byte 5-grams, trained on trusted texts.

Each task counts the 5-grams of its texts (packed into one integer each) and sends its distinct ones, with their
counts in trusted texts, to shards keyed by the n-gram. The counts of lower orders are continuation counts, the
numbers of different symbols that precede an n-gram, by aggregations of the next higher order's types. Discounts come
from the counts of counts over the whole trusted text. For each distinct 5-gram of the corpus the sharded counts of
every order and context are joined into one log probability. Documents then look their 5-grams up and sum: through a
broadcast where that table is measured to be at most BROADCAST bytes, else by packing documents into chunks,
joining each chunk's distinct 5-grams to the shards and meeting the chunk again. Both give the same figures.

One in HELD of the trusted documents, by doc_id, are not counted but set the limits; in a language of few trusted
documents more of them, up to half, so that some LEAST serve. A document is kept if its perplexity a byte is at most the
QUANTILE of theirs in its language, and that of all languages together where its language has none. Quantiles are taken
to 0.001 of the logarithm.

Defined cases: a null text is empty and is scored by its end alone; a null language is one without trusted documents;
without trusted documents every document is kept and the model is uniform; a document is trusted if any label row for
its doc_id is; repeated rows are scored and counted row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewarden.llm.chunks import NO_ID, chunked, chunks, columns, meet, unpack
from sitewarden.llm.common import checkpoint, map_arrow, small

ORDER = 5
QUANTILE, HELD, LEAST = 0.99, 10, 50
BROADCAST = 32 << 20
BATCH, TABLE = 4 << 20, 1 << 20


def grams(sizes: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The ORDER-grams that end at each byte and at the end of each document; symbol 0 stands before and after one."""
    pad = ORDER - 1
    padded = np.zeros(int(sizes.sum()) + (pad + 1) * len(sizes), np.uint64)
    starts = np.cumsum(sizes + pad + 1) - (sizes + pad + 1)
    inside = np.arange(len(raw)) + np.repeat(starts + pad - (np.cumsum(sizes) - sizes), sizes)
    padded[inside] = raw
    out = np.zeros(len(padded) - pad if len(padded) else 0, np.uint64)
    for i in range(ORDER):
        out = (out << np.uint64(8)) | padded[i : i + len(out)]
    first = np.zeros(len(padded), bool)
    first[(starts[:, None] + np.arange(pad)).ravel()] = True
    return out[~first[pad:]].astype(np.int64)


def count_grams(rows: DataFrame) -> DataFrame:
    """(g, c): every 5-gram of the texts of (doc_id, text, trusted) and how often it occurs in trusted ones."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys, found = pd.factorize(np.concatenate([k for k, _ in held]))
            return found, np.bincount(keys, np.concatenate([c for _, c in held]), len(found)).astype(np.int64)

        def out(keys, counts):
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(counts[at : at + 100_000])], ["g", "c"])

        for sizes, raw, trusted in _with_trust(batches):
            keys, found = pd.factorize(grams(sizes, raw))
            held.append((found, np.bincount(keys, np.repeat(trusted, sizes + 1), len(found))))
            if sum(len(k) for k, _ in held) > TABLE:
                held = [merged()]
                if len(held[0][0]) > TABLE // 2:
                    yield from out(*held[0])
                    held = []
        if held:
            yield from out(*merged())

    return map_arrow(rows, run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _with_trust(batches):
    """(sizes, bytes, trusted) of runs of rows of some BATCH bytes."""
    raw, trust, held = [], [], 0

    def out():
        return np.array([len(r) for r in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8), np.array(trust, np.float64)

    for batch in batches:
        for text, trusted in zip(batch.column("text").to_pylist(), batch.column("trusted").to_pylist()):
            raw.append(text.encode())
            trust.append(trusted)
            held += len(raw[-1])
            if held >= BATCH:
                yield out()
                raw, trust, held = [], [], 0
    if raw:
        yield out()


def probabilities(counts: DataFrame) -> DataFrame:
    """(g, logp) for every g of counts, the model being that of the rows with c > 0."""
    seen = counts.where("c > 0").select(F.col("g").alias("k"), F.col("c").alias("a"))
    models = {ORDER: seen}
    for n in range(ORDER - 1, 0, -1):
        models[n] = checkpoint(models[n + 1].groupBy(F.col("k").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("k")).agg(F.count("*").alias("a")))
    lower: DataFrame | None = None
    for n in range(1, ORDER + 1):
        wanted = counts.select(F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("k"))
        if n < ORDER:
            wanted = wanted.distinct()
        discount = _discounts(models[n])
        model = models[n].withColumn("d", discount(F.col("a")))
        context = model.groupBy(F.shiftright("k", 8).alias("ctx")).agg(F.sum("a").alias("total"), F.sum("d").alias("kept"))
        p = wanted.join(model, "k", "left").withColumn("ctx", F.shiftright("k", 8)).join(context, "ctx", "left")
        own = F.coalesce((F.col("a") - F.col("d")) / F.col("total"), F.lit(0.0))
        back = F.coalesce(F.col("kept") / F.col("total"), F.lit(1.0))
        if lower is None:
            p = p.select("k", (own + back / 256).alias("p"))
        else:
            below = lower.select(F.col("k").alias("short"), F.col("p").alias("q"))
            p = p.withColumn("short", F.col("k").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(below, "short").select("k", (own + back * F.col("q")).alias("p"))
        lower = p if n == ORDER else checkpoint(p)
    return lower.select(F.col("k").alias("g"), F.log("p").cast("float").alias("logp"))


def _discounts(model: DataFrame):
    """The three discounts of modified Kneser-Ney (Chen and Goodman 1998) as a function of a count."""
    n = model.agg(*(F.count_if(F.col("a") == i) for i in range(1, 5))).first()
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    found = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i * 0.5 for i in (1, 2, 3)]
    d = [min(max(x, 0.05), i - 0.05) for i, x in enumerate(found, 1)]

    def of(a: Column) -> Column:
        return F.when(a == 1, d[0]).when(a == 2, d[1]).otherwise(d[2])

    return of


def _score(ids: np.ndarray, sizes: np.ndarray, raw: np.ndarray, lang: pa.Array, keys: np.ndarray, logp: np.ndarray) -> pa.RecordBatch:
    """Mean log probabilities of documents by a table sorted by key that has all their 5-grams."""
    place, found = pd.factorize(grams(sizes, raw))
    at = np.searchsorted(keys, found)
    if len(keys) == 0 or (keys[np.minimum(at, len(keys) - 1)] != found).any():
        raise RuntimeError("an n-gram of a document is not in the table: its rows changed between evaluations")
    each = logp[at].astype(np.float64)[place]
    ends = np.cumsum(sizes + 1)
    total = np.add.reduceat(each, ends - sizes - 1)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=np.asarray(ids) == NO_ID), lang, pa.array(sizes), pa.array(-total / (sizes + 1))], ["doc_id", "lang", "n_bytes", "loss"])


def losses(rows: DataFrame, counts: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """(doc_id, lang, n_bytes, loss) for each row of (doc_id, text, lang): the mean negative log probability of a symbol."""
    table = checkpoint(probabilities(counts))
    schema = "doc_id long, lang string, n_bytes long, loss double"
    rows = rows.select("doc_id", "text", "lang")
    if table.count() * 12 <= limit:
        shared = rows.sparkSession.sparkContext.broadcast(_gather(table))

        def run(batches):
            keys, logp = shared.value
            for ids, raw, others in chunked(batches, BATCH):
                yield _score(np.array([NO_ID if i is None else i for i in ids], np.int64), np.array([len(r) for r in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8), others.column("lang").combine_chunks(), keys, logp)

        return map_arrow(rows, run, schema)
    packed = chunks(rows)

    def distinct(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                _, offsets, raw, _ = unpack(blob.as_py())
                found = pd.unique(grams(np.diff(offsets), raw))
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(found)), pa.array(found)], ["chunk", "g"])

    def reply(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for chunk, own in frame.groupby("chunk", sort=False):
                data = np.stack([own["g"].to_numpy(np.int64), own["logp"].to_numpy(np.float64).view(np.int64)]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([data], pa.binary())], ["chunk", "reply"])

    asked = map_arrow(packed, distinct, "chunk string, g long").join(table, "g")
    replies = map_arrow(asked.repartition("chunk"), reply, "chunk string, reply binary")

    def score(key, blob, own):
        ids, offsets, raw, others = unpack(blob)
        both = np.concatenate([np.frombuffer(r, np.int64).reshape(2, -1) for r in own], axis=1) if own else np.zeros((2, 0), np.int64)
        both = both[:, np.argsort(both[0], kind="stable")]
        yield _score(ids, np.diff(offsets), raw, columns(others)["lang"], both[0], both[1].view(np.float64).astype(np.float32))

    return meet(packed, replies, score, schema)


def _gather(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted keys and the values of a table of measured size, sent to the driver as a few packed rows."""

    def run(batches):
        for batch in batches:
            packed = batch.column("g").to_numpy().tobytes(), batch.column("logp").to_numpy().tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], ["g", "logp"])

    found = map_arrow(table.select("g", "logp"), run, "g binary, logp binary").collect()
    keys = np.frombuffer(b"".join(bytes(r["g"]) for r in found), np.int64)
    logp = np.frombuffer(b"".join(bytes(r["logp"]) for r in found), np.float32)
    order = np.argsort(keys)
    return keys[order], logp[order]


def held_share(n: Column) -> Column:
    """The share of a language's n trusted documents that sets its limit."""
    return F.greatest(F.lit(1 / HELD), F.least(F.lit(0.5), LEAST / n))


def classify(docs: DataFrame, trusted_ids: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, trusted, held, quality) for each row of docs (doc_id, text, lang);
    trusted_ids has the doc_ids of the trusted documents, repeats allowed."""
    ids = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("_known", F.lit(True))
    ids = small(ids, 16, limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    shares = small(rows.select("doc_id", "lang").join(ids, "doc_id").groupBy("lang").agg(held_share(F.count("*")).alias("_share")), 64, limit)
    held = F.pmod(F.xxhash64("doc_id"), F.lit(10_000)) < F.coalesce("_share", F.lit(1 / HELD)) * 10_000
    trusting = rows.join(ids, "doc_id", "left").join(shares, "lang", "left").select("doc_id", "text", (F.coalesce("_known", F.lit(False)) & ~held).alias("trusted"))
    counts = checkpoint(count_grams(trusting))
    found = losses(rows, counts, limit)
    found = found.join(ids, "doc_id", "left").withColumn("trusted", F.coalesce("_known", F.lit(False))).drop("_known")
    found = checkpoint(found.join(shares, "lang", "left").withColumn("bin", F.floor(F.col("loss") * 1000)).withColumn("held", held))
    bins = found.where("trusted and held").groupBy("lang", "bin").agg(F.count("*").alias("n"))
    both = reduce(DataFrame.unionByName, (bins.where("lang is not null").select(F.lit(False).alias("any"), "lang", "bin", "n"), bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(True).alias("any"), F.lit("").alias("lang"), "bin", "n")))
    share = Window.partitionBy("any", "lang")
    running = both.withColumn("below", F.sum("n").over(share.orderBy("bin"))).withColumn("all", F.sum("n").over(share))
    limits = running.where(F.col("below") >= F.col("all") * QUANTILE).groupBy("any", "lang").agg(F.min("bin").alias("cut"))
    own = limits.where("not any").select(F.col("lang").alias("_lang"), F.col("cut").alias("own"))
    every = limits.where("any").agg(F.max("cut").alias("every"))
    found = found.join(own, F.col("lang") == F.col("_lang"), "left").join(F.broadcast(every))
    cut = F.coalesce("own", "every")
    return found.select(
        "doc_id", "lang", "n_bytes",
        F.exp("loss").alias("perplexity"),
        F.exp((cut + 1) / 1000).alias("threshold"),
        "trusted",
        "held",
        F.coalesce(F.col("bin") <= cut, F.lit(True)).alias("quality"),
    )
