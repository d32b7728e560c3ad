"""Removal of byte strings that an earlier document also has, by merging Burrows-Wheeler transforms of shards.

A byte goes if some DEPTH-byte string that covers it also starts in a document with a smaller doc_id. All is judged on
the input. Ordering the suffixes of the whole corpus in one place is neither possible nor needed: a string can only
repeat where its anchor repeats, so suffixes are brought together by anchors.

1. A window of DEPTH bytes has DEPTH - Q + 1 q-grams; its anchor is the one of least hash, so equal windows have
   equal anchors (winnowing). Neighbouring windows with one anchor are a run. Each chunk of documents sends its
   distinct anchors to buckets, which answer with a bit for each: does another chunk have it as well?
2. Chunks send the strings of the runs whose anchor repeats, equal strings once with their least doc_id, to buckets
   by anchor. Strings that share an anchor but differ are dealt to shards; each shard's suffix array and Burrows-Wheeler
   transform are built, and the transforms are merged by refining an interleave: it starts with the shards one after
   the other and is stably sorted by the preceding symbols, two at a time, until it is in the order of the first DEPTH
   symbols. No suffixes of different shards are ever compared or sorted again. The round in which two neighbours come
   apart is the length of their common prefix, in steps of two symbols; repeated intervals are where no prefix is
   shorter than DEPTH, and each gives the least doc_id of its string. A string that is alone with its anchor is an
   interval by itself.
3. The least doc_ids go back to the chunks, which mark and remove.

Every string is sent once by a chunk, however often the chunk has it. An anchor that more than CROWD chunks have, or that
a chunk has more than LOCAL times (a line or a passage that documents everywhere share), sends its windows one by one,
to buckets by their own content, so that what stands around it doesn't meet in one task. Buckets grow in number with
the input.

Defined cases: null texts are empty; texts shorter than DEPTH keep everything; null doc_ids count as larger than all
others and don't remove each other; rows with one doc_id, repeated ones too, never remove each other; an empty table
gives an empty result. The plan of docs must give the same rows in the same order again (a scan does); if it
doesn't, a chunk finds no answers and the job fails by name.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewarden.llm.chunks import NO_ID, chunks, columns, meet, unpack
from sitewarden.llm.common import checkpoint, map_arrow

DEPTH, Q = 50, 24
CROWD, LOCAL = 4096, 400
SHARDS = 2
STEP = 1 << 15
#: Bytes of text a bucket answers for, at least 2**6 buckets; larger with larger executors, so that more is sent in a row.
PER_BUCKET = 4 << 20
LAST = (1 << 63) - 1
CHANGED = "a chunk has no answer for what it sends: the plan of docs gave other rows, or in another order, when it ran again"
#: In an answer: the windows of this string have least doc_ids of their own.
MANY = -(1 << 63)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as far as they go."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw),), np.uint64, padded, strides=(1,))


def _mix(words: list[np.ndarray]) -> np.ndarray:
    h = words[0] * _K[0]
    for i, w in enumerate(words[1:], 1):
        h ^= h >> np.uint64(29)
        h ^= w
        h *= _K[i % 3]
    h ^= h >> np.uint64(29)
    h *= _K[3]
    h ^= h >> np.uint64(32)
    return h


def runs(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, count, document) of the runs: windows first to first + count - 1 have this anchor.

    Works through the text in steps that stay in a processor's cache."""
    n = len(raw) - DEPTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    valid = np.ones(n + 1, bool)  # windows that don't reach over the end of a document
    valid[n] = False
    for end in offsets[1:-1].tolist():
        valid[max(0, end - DEPTH + 1) : end] = False
    words, wide = _words(raw), DEPTH - Q + 1
    anchors, first, last = [], [], []
    before, open_run = -1, False  # the anchor's place of the window before, and whether a run has it
    for a in range(0, n, STEP):
        b = min(a + STEP, n)
        m = b - a + wide - 1
        key = _mix([words[a + 8 * i : a + 8 * i + m] for i in range(Q // 8)])
        # the low 6 bits hold the place, which breaks ties: any of the equal anchors serves
        key &= ~np.uint64(63)
        key |= np.arange(a, a + m, dtype=np.uint64) & np.uint64(63)
        width = 1
        while 2 * width <= wide:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        key = np.minimum(key[: b - a], key[wide - width : wide - width + b - a])
        place = np.arange(a, b)
        anchor = place + ((key.astype(np.int64) - place) & 63)
        ok = valid[a:b]
        new = np.empty(b - a, bool)
        new[0] = not open_run or anchor[0] != before
        new[1:] = (anchor[1:] != anchor[:-1]) | ~ok[:-1]
        starts = np.flatnonzero(ok & new)
        anchors.append(key[starts] >> np.uint64(6))
        first.append(starts + a)
        ends = np.empty(b - a, bool)  # the window before ended a run
        ends[0] = open_run and (new[0] or not ok[0])
        ends[1:] = ok[:-1] & (new[1:] | ~ok[1:])
        last.append(np.flatnonzero(ends) + a - 1)
        before, open_run = anchor[-1], bool(ok[-1])
    if open_run:
        last.append(np.array([n - 1]))
    starts, stops = np.concatenate(first), np.concatenate(last)
    return np.concatenate(anchors), starts, stops - starts + 1, np.searchsorted(offsets, starts, side="right") - 1


class Chunk:
    """A chunk's runs and what it sends; the same each time it is made."""

    def __init__(self, blob: bytes, bits: int):
        self.bits = bits
        self.ids, self.offsets, self.raw, self.others = unpack(blob)
        self.order = np.where(self.ids == NO_ID, LAST, self.ids)
        self.anchor, self.first, self.count, self.doc = runs(self.offsets, self.raw)
        low = np.uint64((1 << bits) - 1)
        code = ((self.anchor & low) << np.uint64(40)) | ((self.anchor >> np.uint64(bits)) & np.uint64((1 << 40) - 1))
        self.codes, self.code_of = np.unique(code, return_inverse=True)

    def anchors(self):
        """(bucket, their number, anchors of 5 bytes each, sorted, and a bit for those that the chunk has often)."""
        bucket = (self.codes >> np.uint64(40)).astype(np.int64)
        often = np.bincount(self.code_of, minlength=len(self.codes)) > LOCAL
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
            yield int(bucket[a]), struct.pack("<q", b - a) + self.codes[a:b].view(np.uint8).reshape(-1, 8)[:, :5].tobytes() + np.packbits(often[a:b]).tobytes()

    def choose(self, answers: list[bytes]) -> None:
        """Keep the runs whose anchor repeats, here or elsewhere; split those of crowded anchors into windows."""
        repeats, crowded = np.zeros(len(self.codes), bool), np.zeros(len(self.codes), bool)
        buckets = (self.codes >> np.uint64(40)).astype(np.int64)
        by_bucket = {struct.unpack_from("<q", a, 1)[0]: a for a in answers}
        if by_bucket.keys() != set(buckets.tolist()):
            raise RuntimeError(CHANGED)
        for answer in by_bucket.values():
            bucket, n = struct.unpack_from("<qq", answer, 1)
            a = int(np.searchsorted(buckets, bucket))
            bits = np.unpackbits(np.frombuffer(answer, np.uint8, -1, 17)).astype(bool)
            repeats[a : a + n], crowded[a : a + n] = bits[:n], bits[n : 2 * n]
        code, doc = self.code_of, self.doc
        order = np.argsort(code * len(self.ids) + doc)
        here = np.zeros(len(self.codes), bool)
        c, d = code[order], self.order[doc[order]]
        here[c[1:][(c[1:] == c[:-1]) & (d[1:] != d[:-1])]] = True
        keep = (repeats | here)[code]
        split = keep & crowded[code]
        whole = np.flatnonzero(keep & ~split)
        split = np.flatnonzero(split)
        n = self.count[split]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        single = np.repeat(self.first[split], n) + inside
        words = _words(self.raw)
        own = _mix([words[single + at] for at in (*range(0, DEPTH - 8, 8), DEPTH - 8)]) >> np.uint64(6) if len(single) else np.zeros(0, np.uint64)
        self.first = np.concatenate([self.first[whole], single])
        self.count = np.concatenate([self.count[whole], np.ones(len(single), np.int64)])
        self.doc = np.concatenate([doc[whole], np.repeat(doc[split], n)])
        self.anchor = np.concatenate([self.anchor[whole], own])
        text = self.raw.tobytes()
        strings: dict[bytes, int] = {}
        self.string_of = np.fromiter((strings.setdefault(text[a:b], len(strings)) for a, b in zip(self.first.tolist(), (self.first + self.count + DEPTH - 1).tolist())), np.int64, len(self.first))
        self.strings = list(strings)
        self.least = np.full(len(strings), LAST, np.int64)
        np.minimum.at(self.least, self.string_of, self.order[self.doc])
        self.anchors_of = np.zeros(len(strings), np.uint64)
        self.anchors_of[self.string_of] = self.anchor
        bucket = (self.anchors_of & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        self.sent = np.argsort(bucket, kind="stable")
        self.bucket = bucket[self.sent]

    def sends(self):
        """(bucket, strings with their anchors and least doc_ids)."""
        import zstandard

        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(self.bucket)]):
            some = self.sent[a:b]
            text = [self.strings[i] for i in some]
            anchors = (self.anchors_of[some] >> np.uint64(self.bits)).astype(np.uint32)
            data = struct.pack("<q", len(some)) + self.least[some].tobytes() + anchors.tobytes() + bytes(len(t) for t in text) + b"".join(text)
            yield int(self.bucket[a]), zstandard.ZstdCompressor(level=1).compress(data)

    def removed(self, answers: list[bytes]) -> np.ndarray:
        """Which bytes of the chunk go."""
        import zstandard

        by_bucket = {struct.unpack_from("<q", a, 1)[0]: a for a in answers}
        if by_bucket.keys() != set(self.bucket.tolist()):
            raise RuntimeError(CHANGED)
        least, own = np.full(len(self.strings), LAST, np.int64), {}
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(self.bucket)]):
            data = zstandard.ZstdDecompressor().decompress(by_bucket[int(self.bucket[a])][9:])
            some = self.sent[a:b]
            least[some] = np.frombuffer(data, np.int64, len(some))
            at = 8 * len(some)
            for i in some[least[some] == MANY].tolist():
                n = len(self.strings[i]) - DEPTH + 1
                own[i] = np.frombuffer(data, np.int64, n, at)
                at += 8 * n
        cover = np.zeros(len(self.raw) + 1, np.int32)
        mine = self.order[self.doc]
        of = least[self.string_of]
        gone = np.flatnonzero((of != MANY) & (of < mine))
        np.add.at(cover, self.first[gone], 1)
        np.add.at(cover, self.first[gone] + self.count[gone] + DEPTH - 1, -1)
        for i in np.flatnonzero(of == MANY).tolist():
            at = self.first[i] + np.flatnonzero(own[int(self.string_of[i])] < mine[i])
            cover[at] += 1
            cover[at + DEPTH] -= 1
        return np.cumsum(cover[:-1]) > 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of text in the order of their first 64 symbols or more, by prefix doubling."""
    key = _words(text).byteswap()
    order, rank = _ordered(key)
    depth = 8
    while depth < DEPTH and rank.max(initial=0) < len(text) - 1:
        key = rank * (len(text) + 1)
        key[:-depth] += rank[depth:] + 1
        order, rank = _ordered(key)
        depth *= 2
    return order


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and their dense ranks by place."""
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if len(order) else 0
    return order, rank


def transform(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The two symbols before each suffix, in suffix order: a Burrows-Wheeler transform in steps of two."""
    return (text[order - 2].astype(np.uint16) << np.uint16(8)) | text[order - 1]


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, lcp) of the merged order of all shards' suffixes: lcp is the length of the common prefix with the suffix
    before, rounded down to an even number, `depth` at most.

    Each round sorts the interleave stably by the two symbols before; a shard's suffixes keep their own order, so the
    transforms are read in sequence and no suffix is looked at. Places of neighbours that differ stay where they are in
    later rounds, so the round in which one appears tells the common prefix."""
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    block, lcp = np.zeros(len(shard), np.int32), np.full(len(shard), depth, np.uint8)
    apart = np.zeros(len(shard), bool)
    for length in range(0, depth, 2):
        before = np.empty(len(shard), np.uint16)
        for s, t in enumerate(transforms):
            before[shard == s] = t
        order = np.argsort(before, kind="stable")
        shard, block, before = shard[order], block[order], before[order]
        now = np.concatenate([[True], (before[1:] != before[:-1]) | (block[1:] != block[:-1])])[: len(shard)]
        lcp[now & ~apart] = length
        apart = now
        block = np.cumsum(now, dtype=np.int32) - 1
    return shard, lcp


def least_by_window(strings: list[bytes], least: np.ndarray) -> list[np.ndarray]:
    """For each string and each window of it, the least of `least` among the strings that have the window."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(strings)
    members = [list(range(s, len(strings), SHARDS)) for s in range(min(SHARDS, len(strings)))]
    built = []
    for own in members:
        # bytes 0 and 1 give way to two that UTF-8 never has, and end the shard and each string
        text = np.frombuffer(b"\x01".join(strings[i].replace(b"\x00", b"\xff").replace(b"\x01", b"\xfe") for i in own) + b"\x01\x00", np.uint8)
        sizes = np.array([len(strings[i]) + 1 for i in own])
        string = np.append(np.repeat(np.array(own, np.int32), sizes), np.int32(-1))
        place = np.append(np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes), 0).astype(np.int32)
        whole = np.append(place[:-1] + DEPTH < np.repeat(sizes, sizes), False)
        order = suffix_array(text)
        built.append((transform(text, order), string[order], place[order], whole[order]))
    shard, lcp = merge([b[0] for b in built], DEPTH)
    interval = np.cumsum(lcp < DEPTH) - 1
    best = np.full(int(interval[-1]) + 1, LAST, np.int64)
    spots = [np.flatnonzero(shard == s) for s in range(len(built))]
    for (_, string, _, whole), spot in zip(built, spots):
        np.minimum.at(best, interval[spot[whole]], least[string[whole]])
    for i, s in enumerate(strings):
        out[i] = np.empty(len(s) - DEPTH + 1, np.int64)
    for (_, string, place, whole), spot in zip(built, spots):
        of, at, value = string[whole], place[whole], best[interval[spot[whole]]]
        order = np.argsort(of.astype(np.int64) * (1 << 20) + at)
        of, value = of[order], value[order]
        cuts = np.flatnonzero(np.diff(of, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(of)]):
            out[int(of[a])] = value[a:b]
    return out


def _repeats(table: pa.Table) -> pa.Table:
    """Which anchors of a bucket more than one row has, as two bits for each."""
    bucket = table.column("bucket")[0].as_py()
    rows, often = [], []
    for blob in table.column("blob"):
        data = blob.as_py()
        (n,) = struct.unpack_from("<q", data)
        rows.append(np.frombuffer(data, np.uint8, 5 * n, 8).reshape(-1, 5))
        often.append(np.unpackbits(np.frombuffer(data, np.uint8, -1, 8 + 5 * n))[:n].astype(bool))
    flat = np.zeros((sum(map(len, rows)), 8), np.uint8)
    flat[:, :5] = np.concatenate(rows)
    values, which, n = np.unique(flat.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    crowded = n > CROWD
    crowded[which[np.concatenate(often)]] = True
    ends = np.cumsum([len(r) for r in rows])
    out = []
    for a, b in zip([0, *ends[:-1]], ends):
        own = which[a:b]
        out.append(b"\x00" + struct.pack("<qq", bucket, b - a) + np.packbits(np.concatenate([n[own] > 1, crowded[own]])).tobytes())
    return pa.table({"chunk": table.column("chunk"), "reply": pa.array(out, pa.binary())})


def _resolve(table: pa.Table) -> pa.Table:
    """The least doc_ids of the windows of a bucket's strings."""
    import zstandard

    bucket = table.column("bucket")[0].as_py()
    known: dict[bytes, int] = {}
    rows, least, anchors = [], [], []
    for blob in table.column("blob"):
        data = zstandard.ZstdDecompressor().decompress(blob.as_py())
        (n,) = struct.unpack_from("<q", data)
        sizes = np.frombuffer(data, np.uint8, n, 8 + 12 * n).astype(np.int64)
        ends = np.cumsum(sizes) + 8 + 13 * n
        rows.append([known.setdefault(data[b - s : b], len(known)) for b, s in zip(ends.tolist(), sizes.tolist())])
        least.append(np.frombuffer(data, np.int64, n, 8))
        anchors.append(np.frombuffer(data, np.uint32, n, 8 + 8 * n))
    which = np.concatenate([np.array(r, np.int64) for r in rows])
    best, anchor = np.full(len(known), LAST, np.int64), np.zeros(len(known), np.uint32)
    np.minimum.at(best, which, np.concatenate(least))
    anchor[which] = np.concatenate(anchors)
    _, group, members = np.unique(anchor, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(members[group] > 1)
    strings = list(known)
    windows: dict[int, np.ndarray] = {}
    if len(shared):
        windows = dict(zip(shared.tolist(), least_by_window([strings[i] for i in shared], best[shared])))
    answer = best.copy()
    for i, w in windows.items():
        answer[i] = w[0] if (w == w[0]).all() else MANY
    out = []
    for row in rows:
        own = answer[row]
        many = [windows[row[i]] for i in np.flatnonzero(own == MANY).tolist()]
        out.append(b"\x01" + struct.pack("<q", bucket) + zstandard.ZstdCompressor(level=1).compress(own.tobytes() + b"".join(w.tobytes() for w in many)))
    return pa.table({"chunk": table.column("chunk"), "reply": pa.array(out, pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: Sequence[str] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept[, others]) for each row of docs; spans are the maximal removed
    runs of the text's UTF-8 bytes, (start, stop), and kept is what remains: bytes, or with as_text a string without what
    is left of characters that were cut, null for a null text. others: columns that travel along, as a struct."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col(text_col).isNull().alias("null"),
        *([F.struct(*(docs[c] for c in others)).alias("others")] if others else []),
    )
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(6, (total // PER_BUCKET).bit_length())
    packed = chunks(rows)

    def send(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                for bucket, data in Chunk(blob.as_py(), bits).anchors():
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([chunk]), pa.array([data], pa.binary())], ["bucket", "chunk", "blob"])

    def send_strings(key, blob, answers):
        chunk = Chunk(blob, bits)
        chunk.choose(answers)
        for bucket, data in chunk.sends():
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([key]), pa.array([data], pa.binary())], ["bucket", "chunk", "blob"])

    def cut(key, blob, answers):
        chunk = Chunk(blob, bits)
        chunk.choose([a for a in answers if a[0] == 0])
        yield _cut(chunk, chunk.removed([a for a in answers if a[0] == 1]), as_text)

    sent = "bucket long, chunk string, blob binary"
    repeats = map_arrow(packed, send, sent).groupBy("bucket").applyInArrow(_repeats, "chunk string, reply binary")
    repeats = checkpoint(repeats)
    strings = meet(packed, repeats, send_strings, sent)
    least = strings.groupBy("bucket").applyInArrow(_resolve, "chunk string, reply binary")
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,stop:long>>, kept " + ("string" if as_text else "binary"))
    if others:
        schema = schema.add(rows.schema["others"])
    return meet(packed, repeats.unionByName(least), cut, schema)


def _cut(chunk: Chunk, gone: np.ndarray, as_text: bool) -> pa.RecordBatch:
    offsets = chunk.offsets
    sizes = np.diff(offsets)
    before = np.concatenate([[0], np.cumsum(gone)])
    removed = before[offsets[1:]] - before[offsets[:-1]]
    edge = np.zeros(len(gone) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]]))) if len(gone) else np.zeros(0, np.int64)
    stops = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1 if len(gone) else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    n_spans = np.bincount(doc, minlength=len(sizes))
    spans = pa.StructArray.from_arrays([pa.array(starts - offsets[doc]), pa.array(stops - offsets[doc])], ["start", "stop"])
    others = columns(chunk.others)
    left = chunk.raw[~gone].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes - removed)]).tolist()
    kept = [left[a:b] for a, b in zip(ends, ends[1:])]
    if as_text:
        kept = [None if null else k.decode("utf-8", "ignore") for k, null in zip(kept, others["null"].to_pylist())]
    found = {
        "doc_id": pa.array(chunk.ids, pa.int64(), mask=chunk.ids == NO_ID),
        "n_bytes": pa.array(sizes), "n_removed": pa.array(removed), "n_spans": pa.array(n_spans),
        "spans": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)), spans),
        "kept": pa.array(kept, pa.string() if as_text else pa.binary()),
    } | {name: others[name] for name in ("others",) if name in others}
    return pa.RecordBatch.from_arrays(list(found.values()), list(found))
