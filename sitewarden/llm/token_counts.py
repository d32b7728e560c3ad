"""Token counts without token ids.

A byte-level BPE tokenizer merges inside pre-tokens only, so the tokens of a text are the sum over its distinct
pre-tokens of (pieces of the pre-token) x (times it occurs).

1. Texts are split into pre-tokens, and some CHUNK bytes of documents become a chunk: the chunk's distinct pre-tokens,
   and for each document which of them it has, how often.
2. Each chunk sends its distinct pre-tokens to buckets by their hash. A bucket counts the pieces of every distinct
   pre-token once, by the library, in batches, and answers each chunk with the figures alone.
3. The answers meet the chunk's frequencies again; their products are summed by document. No ids are made anywhere.

Pre-tokens that more than one in HOT_DOCS of a sample of documents have are counted on the driver and broadcast, so
that chunks don't all send them to the same buckets. A document has so many distinct pre-tokens only, so few can be
that frequent; at most HOT are taken, the most frequent ones. The sample decides which way a count comes, not its value.

Defined cases: a null text counts as the empty one (0 bytes, 0 tokens); strings of added tokens inside a text count as
one token each, the library's default; repeated rows are counted row by row; an empty table gives an empty result; a
very long text is a chunk of its own, split in blocks.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.chunks import NO_ID, meet
from sitewarden.llm.common import checkpoint, map_arrow, texts, worker_cache
from sitewarden.llm.pretokens import Splitter

#: Bytes of documents in a chunk, and of text a bucket answers for (at least 64 buckets).
CHUNK, PER_BUCKET = 4 << 20, 16 << 20
#: Pre-tokens of a long text that are counted at once, and that the library gets at once.
BLOCK, BATCH = 200_000, 10_000
#: Bytes of the sample for hot pre-tokens, the share of its documents that makes one hot, and the most that are taken.
SAMPLE, HOT_DOCS, HOT = 4 << 20, 100, 20_000


class PieceCounter:
    """Splits texts and counts pieces for a byte-level BPE tokenizer file of the `tokenizers` library."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only a byte-level tokenizer without a normalizer or a prefix space can be counted by pre-tokens")
        added = spec.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take their surroundings along are not supported")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.split = Splitter(pattern)

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """Added tokens in a text, and the frequencies of its pre-tokens."""
        parts, found = [text], Counter()
        if self.added is not None and self.added.search(text):
            parts = self.added.split(text)
        for part in parts:
            pieces = self.split.pieces(part)
            if isinstance(pieces, list):
                found.update(pieces)
            else:
                while block := list(islice(pieces, BLOCK)):
                    found.update(block)
        return len(parts) - 1, found

    def pieces(self, words: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        out = [len(e) for at in range(0, len(words), BATCH) for e in self.tokenizer.encode_batch_fast(words[at : at + BATCH], add_special_tokens=False)]
        return np.array(out, np.int32)


def _counter(path: str, pattern: str) -> PieceCounter:
    kept = worker_cache()
    if ("pieces", path, pattern) not in kept:
        kept["pieces", path, pattern] = PieceCounter(path, pattern)
    return kept["pieces", path, pattern]


class Chunk:
    """The frequencies of a run of documents over the distinct pre-tokens that they have."""

    def __init__(self):
        self.words: defaultdict[str, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.docs: list[tuple[int, int, int, int]] = []
        self.entries: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: int | None, n_bytes: int, added: int, found: Counter) -> None:
        self.docs.append((NO_ID if doc is None else doc, n_bytes, added, len(found)))
        both = np.empty((2, len(found)), np.int32)
        both[0] = list(map(self.words.__getitem__, found))
        both[1] = list(found.values())
        self.entries.append(both)
        self.held += n_bytes

    def pack(self, hot: dict[str, int], buckets: int) -> tuple[str, bytes, list[tuple[int, bytes]]]:
        """(key, what stays, what goes to each bucket). Pre-tokens are numbered anew: the hot ones, then by bucket."""
        import zstandard

        words = list(self.words)
        coded = [w.encode() for w in words]
        known = np.array([hot.get(w, -1) for w in words], np.int32)
        bucket = np.fromiter((xxhash.xxh64_intdigest(c) for c in coded), np.uint64, len(coded)) % np.uint64(buckets)
        bucket = np.where(known >= 0, -1, bucket.astype(np.int64))
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        docs = np.array(self.docs, np.int64).reshape(-1, 4)
        entries = np.concatenate([np.zeros((2, 0), np.int32), *self.entries], axis=1)
        ordered = bucket[order]
        cuts = np.append(np.flatnonzero(np.diff(ordered, prepend=-1)), len(ordered))
        given = known[order[: cuts[0]]]
        squeeze = zstandard.ZstdCompressor(level=1).compress
        blob = squeeze(struct.pack("<qqq", len(docs), entries.shape[1], len(given)) + docs.tobytes() + given.tobytes() + _steps(docs[:, 3], number[entries[0]], entries[1]))
        sent = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = [coded[i] for i in order[a:b].tolist()]
            sent.append((int(ordered[a]), squeeze(struct.pack("<q", len(own)) + np.array([len(c) for c in own], np.int32).tobytes() + b"".join(own))))
        return hashlib.blake2b(blob, digest_size=16).hexdigest(), blob, sent


def _steps(sizes: np.ndarray, number: np.ndarray, times: np.ndarray) -> bytes:
    """The numbers of each document in order, as steps from one to the next, and their times; bytes of one weight together,
    since the high ones are mostly zero and compress well."""
    order = np.argsort(np.repeat(np.arange(len(sizes)) << 32, sizes) + number)
    number = number[order]
    step = np.diff(number, prepend=np.int32(0))
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    step[starts] = number[starts]
    return np.stack([step, times[order]]).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unstep(sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, times) of _steps()."""
    step, times = np.ascontiguousarray(data.reshape(4, -1).T).view("<i4").reshape(2, -1)
    total = np.cumsum(step.astype(np.int64))
    own = sizes[sizes > 0]
    starts = np.cumsum(own) - own
    return total - np.repeat(total[starts] - step[starts], own), times


def _words_of(blob: bytes) -> list[str]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", data)
    ends = (8 + 4 * n + np.cumsum(np.frombuffer(data, np.int32, n, 8).astype(np.int64))).tolist()
    return [data[a:b].decode() for a, b in zip([8 + 4 * n, *ends], ends)]


def _sum(blob: bytes, replies: list[bytes]) -> pa.RecordBatch:
    """(doc_id, n_bytes, n_tokens) of a chunk's documents, by its buckets' answers."""
    import zstandard

    squeezed = zstandard.ZstdDecompressor()
    data = squeezed.decompress(blob)
    n, m, given = struct.unpack_from("<qqq", data)
    docs = np.frombuffer(data, np.int64, 4 * n, 24).reshape(n, 4)
    hot = np.frombuffer(data, np.int32, given, 24 + 32 * n)
    number, times = _unstep(docs[:, 3], np.frombuffer(data, np.uint8, 8 * m, 24 + 32 * n + 4 * given))
    by_bucket = {struct.unpack_from("<q", r)[0]: r for r in replies}
    answers = [np.frombuffer(squeezed.decompress(by_bucket[b][8:]), np.int32) for b in sorted(by_bucket)]
    pieces = np.concatenate([hot, *answers]).astype(np.int64)
    running = np.concatenate([[0], np.cumsum(pieces[number] * times)])
    ends = np.cumsum(docs[:, 3])
    tokens = running[ends] - running[ends - docs[:, 3]] + docs[:, 2]
    return pa.RecordBatch.from_arrays([pa.array(docs[:, 0], pa.int64(), mask=docs[:, 0] == NO_ID), pa.array(docs[:, 1]), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def hot_words(rows: DataFrame, total: int, tokenizer: str, pattern: str) -> dict[str, int]:
    """The pieces of the pre-tokens that more than one in HOT_DOCS of a sample of some SAMPLE bytes of documents have."""

    def run(batches):
        counter = _counter(tokenizer, pattern)
        for batch in batches:
            found, n = Counter(), 0
            for text in batch.column("text").to_pylist():
                found.update(set(counter.frequencies(text)[1]))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([*found, None], pa.string()), pa.array([*found.values(), n], pa.int64())], ["word", "n"])

    one_in = max(1, -(-total // SAMPLE))
    sample = rows.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(one_in)) == 0).select("text")
    counts = checkpoint(map_arrow(sample, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    least = max(1, (counts.where("word is null").agg(F.sum("n")).first()[0] or 0) // HOT_DOCS)
    words = [r["word"] for r in counts.where(F.col("word").isNotNull() & (F.col("n") > least)).orderBy(F.desc("n"), "word").limit(HOT).collect()]
    return dict(zip(words, PieceCounter(tokenizer, pattern).pieces(words).tolist())) if words else {}


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs."""
    rows = texts(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(64, total // PER_BUCKET)
    hot = rows.sparkSession.sparkContext.broadcast(hot_words(rows, total, tokenizer, pattern))

    def out(chunk: Chunk):
        key, blob, sent = chunk.pack(hot.value, buckets)
        yield pa.RecordBatch.from_arrays([pa.array([None, *(b for b, _ in sent)], pa.int64()), pa.array([key] * (1 + len(sent))), pa.array([blob, *(d for _, d in sent)], pa.binary())], ["bucket", "chunk", "blob"])

    def split(batches):
        counter, chunk = _counter(tokenizer, pattern), Chunk()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                chunk.add(doc, len(text.encode()), *counter.frequencies(text))
                if chunk.held >= CHUNK:
                    yield from out(chunk)
                    chunk = Chunk()
        if chunk.docs:
            yield from out(chunk)

    def count(table: pa.Table) -> pa.Table:
        import zstandard

        words: defaultdict[str, int] = defaultdict()
        words.default_factory = words.__len__
        numbers = [np.fromiter(map(words.__getitem__, _words_of(blob.as_py())), np.int64) for blob in table.column("blob")]
        pieces = _counter(tokenizer, pattern).pieces(list(words))
        head = struct.pack("<q", table.column("bucket")[0].as_py())
        replies = [head + zstandard.ZstdCompressor(level=1).compress(pieces[n].tobytes()) for n in numbers]
        return pa.table({"chunk": table.column("chunk"), "reply": pa.array(replies, pa.binary())})

    packed = checkpoint(map_arrow(rows, split, "bucket long, chunk string, blob binary"))
    answers = packed.where("bucket is not null").groupBy("bucket").applyInArrow(count, "chunk string, reply binary")
    return meet(packed.where("bucket is null").select("chunk", "blob"), answers, lambda key, blob, replies: iter([_sum(blob, replies)]), "doc_id long, n_bytes long, n_tokens long")
