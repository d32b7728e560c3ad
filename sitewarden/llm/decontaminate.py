"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are normalised alike: lower case, ASCII punctuation and white space as single blanks, UTF-8.
An item is cut into windows of WINDOW bytes, a new one every STRIDE (a shorter item is one window); a text is
contaminated by the item if some stretch of it is within an edit budget of one of its windows, RATE of the window's
length. So a verbatim stretch of WINDOW bytes of an item is surely found, wherever it begins: some window is at most
STRIDE / 2 bytes off, which the edit budget covers. A window of m bytes and a stretch at most e edits away share at least m + 1 - Q (e + 1) of the window's q-grams,
and these lie on diagonals no more than e apart.

1. Each q-gram (8 bytes, one machine word) of a text is looked up in a table of the benchmark's; stretches of a
   window's length with fewer hits than the least bound hold no match.
2. The hits of what remains are counted by (window, diagonal band); bands are 2 (e + 1) wide and overlap by half, so
   that some band has all hits of a match. Bands that meet the window's own bound are kept.
3. Those are verified by an alignment within the band (semi-global: the window whole, the stretch anywhere), the pairs
   of a batch of texts side by side.

The benchmark is a stated query set: it is read in blocks of at most BLOCK bytes of text, and each block's index is
held against all documents, whose texts are never shuffled.

Defined cases: null texts and items are empty; items of fewer than LEAST normalised bytes are no witness and match
nothing; repeated rows match row by row; an empty benchmark or table gives an empty result; long texts are searched
in overlapping pieces whose overlap exceeds any match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.common import map_arrow, slices, texts

Q, WINDOW, STRIDE, RATE, LEAST = 8, 64, 8, 0.08, 24
BLOCK = 512 << 10
PIECE = 4 << 20
#: Bytes of texts whose candidates are verified together, and pairs that are aligned side by side.
SLICE, ALIGNED = 4 << 20, 10_000
_BLANK = bytes(32 if i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 else i for i in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lowered(text: str) -> bytes:
    """Lower case with as many characters as the text has, ASCII punctuation and white space blank."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.encode("utf-8", "surrogatepass").translate(_BLANK)


def normalise(text: str) -> bytes:
    return b" ".join(lowered(text).split())


def places(text: str, starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """Spans of normalised bytes as spans of the text's characters."""
    raw = np.frombuffer(lowered(text) + b" ", np.uint8)
    blank = raw == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]  # the first blank of a run stands for it
    first = int(np.argmax(~blank)) if (~blank).any() else 0
    keep[:first] = False
    at = np.flatnonzero(keep)
    chars = np.cumsum((raw & 0xC0) != 0x80) - 1
    return [(int(chars[at[a]]), int(chars[at[b - 1]]) + 1) for a, b in zip(starts, stops)]


@dataclass
class Index:
    """The windows of a block of the benchmark and the places of their q-grams."""

    items: np.ndarray  # item_id of each window
    windows: list[bytes]
    sizes: np.ndarray
    budgets: np.ndarray
    bounds: np.ndarray
    grams: np.ndarray  # sorted distinct q-grams
    offsets: np.ndarray  # postings of grams[i]: offsets[i] to offsets[i + 1]
    window_of: np.ndarray
    place_of: np.ndarray
    table: np.ndarray
    shift: np.uint64
    need: int  # the least bound of a window, and the longest stretch that can match one
    reach: int

    @classmethod
    def build(cls, items: list[tuple[int, str]]) -> Index:
        owners, windows = [], []
        for item, text in items:
            raw = normalise(text or "")
            if len(raw) < LEAST:
                continue
            ends = [*range(WINDOW, len(raw), STRIDE), len(raw)]
            for end in ends:
                windows.append(raw[max(0, end - WINDOW) : end])
                owners.append(item)
        sizes = np.array([len(w) for w in windows], np.int64)
        budgets = np.minimum((sizes * RATE).astype(np.int64), sizes // Q - 1)
        bounds = sizes + 1 - Q * (budgets + 1)
        gram, window, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(windows):
            g = grams_of(np.frombuffer(w, np.uint8))
            gram.append(g)
            window.append(np.full(len(g), i))
            place.append(np.arange(len(g)))
        gram, window, place = np.concatenate(gram), np.concatenate(window), np.concatenate(place)
        order = np.argsort(gram, kind="stable")
        grams, first = np.unique(gram[order], return_index=True)
        bits = max(16, int(len(grams)).bit_length() + 6)
        shift = np.uint64(64 - bits)
        table = np.zeros(1 << bits, bool)
        table[(grams * _MIX) >> shift] = True
        return cls(np.array(owners, np.int64), windows, sizes, budgets, bounds, grams, np.append(first, len(order)), window[order], place[order], table, shift, int(bounds.min()) if windows else 0, int((sizes + budgets).max(initial=0)))

    def candidates(self, text: bytes) -> list[tuple[int, int, int, bytes]]:
        """(window, a, low, stretch): a window, and the stretch of a normalised text, from place a on, where it may match on
        the 2 (e + 1) diagonals of the stretch from low on."""
        if not self.windows or len(text) < Q:
            return []
        grams = grams_of(np.frombuffer(text, np.uint8))
        hit = self.table[(grams * _MIX) >> self.shift]
        at = np.flatnonzero(hit)
        if len(at) < self.need:
            return []
        # stretches with enough hits of any kind: from each hit to the one that completes the least bound
        need = self.need
        close = at[need - 1 :] - at[: len(at) - need + 1] <= self.reach - Q
        cover = np.zeros(len(at) + 1, np.int64)
        cover[np.flatnonzero(close)] += 1
        cover[np.flatnonzero(close) + need] -= 1
        at = at[np.cumsum(cover[:-1]) > 0]
        if not len(at):
            return []
        own = grams[at]
        where = np.searchsorted(self.grams, own)
        where[where == len(self.grams)] = 0
        real = self.grams[where] == own
        at, where = at[real], where[real]
        n = self.offsets[where + 1] - self.offsets[where]
        total = int(n.sum())
        if not total:
            return []
        posting = np.arange(total) + np.repeat(self.offsets[where] - (np.cumsum(n) - n), n)
        window, diagonal = self.window_of[posting], np.repeat(at, n) - self.place_of[posting]
        width = self.budgets[window] + 1
        band = (diagonal + len(text)) // width  # shifted, so that it isn't negative
        span = 2 * len(text) + WINDOW + 2
        keys = np.concatenate([window * span + band, window * span + band - 1])
        found, count = np.unique(keys, return_counts=True)
        which, band = found // span, found % span
        ok = count >= self.bounds[which]
        which, band = which[ok], band[ok]
        out = []
        for w, b in zip(which.tolist(), band.tolist()):
            pattern, e = self.windows[w], int(self.budgets[w])
            low = b * (e + 1) - len(text)  # diagonals low to low + 2 (e + 1) - 1
            a = max(0, low - e)
            out.append((w, a, low - a, text[a : max(0, low + 2 * (e + 1) + e) + len(pattern)]))
        return out

    def verify(self, pairs: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int]]:
        """(edits, start, stop) of the best match of each candidate, in places of its text; more edits than its budget
        allows if it has none."""
        out = np.zeros((len(pairs), 3), np.int64)
        window = np.array([w for w, *_ in pairs], np.int64)
        kinds, kind = np.unique(self.sizes[window], return_inverse=True)  # a window's budget follows from its size
        for i in range(len(kinds)):
            own = np.flatnonzero(kind == i)
            for at in range(0, len(own), ALIGNED):
                some = [pairs[k] for k in own[at : at + ALIGNED].tolist()]
                found = align([self.windows[w] for w, *_ in some], [t for *_, t in some], np.array([low for _, _, low, _ in some]), int(self.budgets[some[0][0]]))
                found[:, 1:] += np.array([a for _, a, *_ in some])[:, None]
                out[own[at : at + ALIGNED]] = found
        return list(map(tuple, out.tolist()))


def grams_of(raw: np.ndarray) -> np.ndarray:
    """All runs of Q = 8 bytes as words."""
    if len(raw) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(raw) - Q + 1,), np.uint64, np.ascontiguousarray(raw), strides=(1,)).copy()


def align(patterns: list[bytes], stretches: list[bytes], low: np.ndarray, budget: int) -> np.ndarray:
    """Rows of (edits, start, stop): the least edits that turn each pattern, all of one length, into a part of its
    stretch, and that part; the leftmost end of those, and its least start.

    A cell is a diagonal of the band, from low - budget to low + 3 budget + 2: no other can be reached within the budget
    from the 2 (budget + 1) diagonals from low on. It holds edits and start in one integer, so that a minimum is one of
    both. All pairs go through the rows of the pattern together; a step to the right is a running minimum."""
    n, m, wide = len(patterns), len(patterns[0]), 4 * budget + 3
    one, never = np.int64(1 << 32), np.int64(1 << 60)
    first = low - budget
    place = first[:, None] + np.arange(m + wide)  # of the stretch, by row + diagonal
    size = np.array([len(t) for t in stretches])
    flat = np.frombuffer(b"".join(stretches) + b"\0", np.uint8).astype(np.int16)
    inside = (place >= 0) & (place < size[:, None])
    letter = np.where(inside, flat[np.where(inside, place + (np.cumsum(size) - size)[:, None], 0)], np.int16(-1))
    off = np.where((place >= 0) & (place <= size[:, None]), np.int64(0), never)
    pattern = np.frombuffer(b"".join(patterns), np.uint8).astype(np.int16).reshape(n, m)
    right = np.arange(wide) * one
    row = np.where(off[:, :wide] == 0, place[:, :wide], never)
    edge = np.full((n, 1), never)
    for i in range(m):
        same = row + (letter[:, i : i + wide] != pattern[:, i : i + 1]) * one
        row = np.minimum(same, np.concatenate([row[:, 1:], edge], axis=1) + one)
        row = np.minimum(row + off[:, i + 1 : i + 1 + wide], never)
        row = np.minimum(np.minimum.accumulate(row - right, axis=1) + right, never) + off[:, i + 1 : i + 1 + wide]
        row = np.minimum(row, never)
    edits = row >> np.int64(32)
    at = np.argmin(edits, axis=1)
    best = row[np.arange(n), at]
    return np.stack([best >> np.int64(32), best & np.int64((1 << 32) - 1), first + m + at], axis=1)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_windows, least_edits, spans): a row for each document row and item that it holds parts of;
    spans are merged (start, stop) characters of the text."""
    rows = texts(docs, id_col, text_col)
    found: DataFrame | None = None
    for index in indexes(benchmark, text_col, item_col):
        part = _against(rows, index)
        found = part if found is None else found.unionByName(part)
    return found


def indexes(benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> Iterator[Index]:
    """The indexes of blocks of the benchmark; of an empty one for an empty benchmark."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    block, size, any_yet = [], 0, False
    for item in items.toLocalIterator():
        block.append((item["item_id"], item["text"]))
        size += len(item["text"])
        if size >= BLOCK:
            yield Index.build(block)
            block, size, any_yet = [], 0, True
    if block or not any_yet:
        yield Index.build(block)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that match no item of the benchmark."""
    for index in indexes(benchmark):
        docs = _without(docs, index)
    return docs


def _without(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vars(index))

    def run(batches):
        own = Index(**shared.value)
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                found = by_item(own, [t or "" for t in batch.column("text").to_pylist()])
                yield batch.filter(pa.array([not f for f in found], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def _against(rows: DataFrame, index: Index) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(vars(index))

    def run(batches):
        own = Index(**shared.value)
        for batch in (part for whole in batches for part in slices(whole, "text", SLICE)):
            out, texts_of = [], batch.column("text").to_pylist()
            for doc, text, found in zip(batch.column("doc_id").to_pylist(), texts_of, by_item(own, texts_of)):
                for item, hits in found.items():
                    spans: list[list[int]] = []
                    for a, b in sorted(places(text, [h[0] for h in hits], [h[1] for h in hits])):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b)
                        else:
                            spans.append([a, b])
                    out.append((doc, item, len({h[2] for h in hits}), min(h[3] for h in hits), [{"start": a, "stop": b} for a, b in spans]))
            doc, item, n, least, spans = zip(*out) if out else ([],) * 5
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(least, pa.int64()), pa.array(spans, kind)], ["doc_id", "item_id", "n_windows", "least_edits", "spans"])

    return map_arrow(rows, run, "doc_id long, item_id long, n_windows long, least_edits long, spans array<struct<start:long,stop:long>>")


def by_item(index: Index, texts: list[str]) -> list[dict[int, list[tuple[int, int, int, int]]]]:
    """For each text (start, stop, window, edits) of the matches in it, by item; long texts in overlapping pieces."""
    owners, pairs = [], []
    for n, text in enumerate(texts):
        raw = normalise(text)
        for at in range(0, max(len(raw), 1), PIECE):
            for pair in index.candidates(raw[at : at + PIECE + 4 * WINDOW]):
                owners.append((n, at))
                pairs.append(pair)
    out: list[dict[int, list[tuple[int, int, int, int]]]] = [{} for _ in texts]
    for (n, at), (window, *_), (edits, start, stop) in zip(owners, pairs, index.verify(pairs)):
        if edits <= index.budgets[window]:
            out[n].setdefault(int(index.items[window]), []).append((at + start, at + stop, window, edits))
    return out
