"""Documents packed into compressed chunks, and chunks brought together with rows addressed to them.

A chunk is some CHUNK bytes of whole documents of one task, packed and compressed; its key is a digest of its content,
so the same rows give the same key in every evaluation. An operator sends rows keyed by chunk through shuffles and
then meets the chunk's documents again, which moves each text once, compressed.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.common import map_arrow

CHUNK = 4 << 20
NO_ID = -(1 << 63)


def pack(ids: list, raw: list[bytes], others: pa.Table | None = None) -> tuple[str, bytes]:
    """(key, blob) of documents and their other columns, which keep their Arrow types; null ids are kept."""
    import zstandard

    rest = b""
    if others is not None and others.num_columns:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, others.schema) as stream:
            stream.write_table(others)
        rest = sink.getvalue().to_pybytes()
    numbers = [[NO_ID if i is None else i for i in ids], [len(r) for r in raw]]
    whole = struct.pack("<qq", len(ids), len(rest)) + np.array(numbers, np.int64).tobytes() + rest + b"".join(raw)
    return hashlib.blake2b(whole, digest_size=16).hexdigest(), zstandard.ZstdCompressor(level=1).compress(whole)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(ids, offsets, bytes, others): document i is bytes[offsets[i]:offsets[i + 1]]; columns() reads the others."""
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress(blob)
    n, rest = struct.unpack_from("<qq", whole)
    ids, sizes = np.frombuffer(whole, np.int64, 2 * n, 16).reshape(2, n)
    at = 16 + 16 * n
    return ids, np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(whole, np.uint8, int(sizes.sum()), at + rest), whole[at : at + rest]


def columns(others: bytes) -> dict[str, pa.Array]:
    """The other columns of a chunk's documents."""
    if not others:
        return {}
    table = pa.ipc.open_stream(others).read_all().combine_chunks()
    return {name: table.column(name).chunk(0) for name in table.column_names}


def chunked(batches, size: int = CHUNK) -> Iterator[tuple[list, list[bytes], pa.Table]]:
    """The (doc_id, text, ...) rows of record batches as runs of ids, UTF-8 texts of about `size` bytes, and the others."""
    ids, raw, parts, held = [], [], [], 0
    for batch in batches:
        others = batch.select([c for c in batch.schema.names if c not in ("doc_id", "text")])
        start = 0
        for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
            own = text.as_buffer().to_pybytes()
            ids.append(doc)
            raw.append(own)
            held += len(own)
            if held >= size:
                yield ids, raw, pa.Table.from_batches([*parts, others.slice(start, i + 1 - start)])
                ids, raw, parts, held, start = [], [], [], 0, i + 1
        parts.append(others.slice(start))
    if ids:
        yield ids, raw, pa.Table.from_batches(parts)


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk, blob) of (doc_id, text, ...). rows must come from a plan that gives the same rows in the same order again,
    such as a scan of files, if the chunks are made more than once."""

    def run(batches):
        for ids, raw, others in chunked(batches, size):
            key, blob = pack(ids, raw, others)
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([blob], pa.binary())], ["chunk", "blob"])

    return map_arrow(rows, run, "chunk string, blob binary")


def meet(packed: DataFrame, replies: DataFrame, run: Callable[[str, bytes, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run(key, blob, replies) for each chunk, with the replies (chunk, reply binary) that were sent to it."""

    def each(batches):
        own, key = [], None
        for batch in batches:
            for chunk, kind, data in zip(batch.column("chunk"), batch.column("kind"), batch.column("data")):
                chunk = chunk.as_py()
                if chunk != key:
                    own, key = [], chunk
                if kind.as_py() == 0:
                    own.append(data.as_py())
                else:
                    yield from run(key, data.as_py(), own)

    both = replies.select("chunk", F.lit(0).alias("kind"), F.col("reply").alias("data")).unionByName(packed.select("chunk", F.lit(1).alias("kind"), F.col("blob").alias("data")))
    return map_arrow(both.repartition("chunk").sortWithinPartitions("chunk", "kind"), each, schema)
