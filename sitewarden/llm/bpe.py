"""Byte-level BPE encoding and decoding with recursive DuckDB queries.

Each worker has a DuckDB connection with the merge table (left, right, id): all pairs of tokens whose bytes join to a
token, ranked by that token's id. The distinct pre-tokens of a slice of texts become token-position rows, one per
byte; a recursive query joins neighbours to the merge table and contracts each word's leftmost pair of least rank,
until no word has a pair left. A word takes part in a step only if the last one changed it. A text's ids are its words' ids in order. Decoding starts from
those ids: the ordered aggregation joins each id of a text to the vocabulary and strings their bytes together.

The recursion holds a row for each position and step, at most half the square of a word's length; a batch of words is cut
where the squares sum up to SQUARES, which bounds its memory. Words over LONG bytes are merged by a priority queue with the same order of merges. Words are looked up among those that the
worker has encoded lately, in this task or an earlier one: two tables, of which the older is dropped when the newer
holds half of `keep` words. None of these changes a result.

Defined cases: a null text is empty and has no ids; special tokens are ordinary text; invalid ids fail in decode();
repeated rows are encoded one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitewarden.llm.common import map_arrow, slices, texts, worker_cache
from sitewarden.llm.pretokens import Splitter

LONG = 128
#: Words that a worker keeps, about; words, and the sum of their squared lengths, of one recursive query.
KEEP, WORDS, SQUARES = 500_000, 40_000, 8 << 20
#: Bytes of text whose words are encoded together, and ids that one query decodes.
SLICE, DECODED = 4 << 20, 500_000

#: One row a token and step of each word that can still change; a word's last step has its result. A token's key is its
#: word's number and its place in it, 10 bits: one integer to sort by. It stays with the first byte of what it covers.
ENCODE = """
with recursive step(i, k, t) as (
  select 0::utinyint, k, t from bytes_in
  union all
  (with pairs as (select i, k, t, lead(t) over o as t2, lead(k) over o as k2, lag(k) over o as k0 from step window o as (order by k)),
        best as (select pairs.k >> 10 as w, min(m.id * 1024 + (pairs.k & 1023)) as b
                 from pairs join merges m on m.pair = pairs.t::bigint * 65536 + pairs.t2 where pairs.k2 >> 10 = pairs.k >> 10 group by 1)
   select (pairs.i + 1)::utinyint, pairs.k, case when (b & 1023) = (pairs.k & 1023) then (b >> 10)::integer else pairs.t end
   from pairs join best on w = pairs.k >> 10 where not (coalesce(pairs.k0 >> 10, -1) = w and (pairs.k0 & 1023) = (b & 1023)))
), last as (select k >> 10 as w, max(i) as i from step group by 1)
select step.k, step.t from step join last on last.w = step.k >> 10 and last.i = step.i order by step.k
"""
DECODE = "select w, array_to_string(list(v.raw order by p), '') as raw from ids_in join vocab v on v.id = ids_in.t group by w"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encodes and decodes words by a rank file."""

    def __init__(self, path: str, pattern: str, keep: int = KEEP):
        import duckdb

        self.keep = keep
        self.ranks = read_ranks(path)
        self.split = Splitter(pattern)
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        ranks = self.ranks
        pairs = np.array([(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks], np.int64).reshape(-1, 3)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        if len(ranks) > 65536:
            raise ValueError("the merge table packs two ids of 16 bits")
        self.con.register("_m", pa.table({"pair": pairs[:, 0].astype(np.int64) * 65536 + pairs[:, 1], "id": pairs[:, 2].astype(np.int64)}))
        # a byte is the character of the same number, since strings can be aggregated in order
        self.con.register("_v", pa.table({"id": pa.array(ranks.values(), pa.int32()), "raw": [t.decode("latin-1") for t in ranks]}))
        self.con.execute("create table merges as select * from _m")
        self.con.execute("create table vocab as select * from _v")
        self.last = max(ranks.values())
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)

    def _queue(self, word: bytes) -> list[int]:
        """The merges of a long word in the same order, by a priority queue over a linked list."""
        ranks, parts = self.ranks, [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, 1, 1) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if len(parts[i]) != a or j >= len(parts) or len(parts[j]) != b:
                continue
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(parts) and (r := ranks.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, len(parts[x]), len(parts[y])))
        return [ranks[p] for p in parts if p]

    def learn(self, words: list[str]) -> None:
        """Put the ids of words into the table."""
        rest: list[tuple[bytes, str]] = []
        for word in words:
            raw = word.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.ids[word] = rank.to_bytes(4, "little")
            elif len(raw) > LONG:
                self.ids[word] = np.array(self._queue(raw), np.int32).tobytes()
            else:
                rest.append((raw, word))
        rest.sort(key=lambda x: len(x[0]))
        while rest:
            lengths = np.array([len(raw) for raw, _ in rest[:WORDS]])
            n = max(1, int(np.searchsorted(np.cumsum(lengths**2), SQUARES, side="right")))
            some, rest, lengths = rest[:n], rest[n:], lengths[:n]
            ends = np.cumsum(lengths)
            tokens = self.byte_ids[np.frombuffer(b"".join([raw for raw, _ in some]), np.uint8)]
            places = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
            self.con.register("bytes_in", pa.table({"k": (np.repeat(np.arange(len(some)), lengths) * 1024 + places).astype(np.int32), "t": tokens}))
            out = self.con.sql(ENCODE).to_arrow_table()
            self.con.unregister("bytes_in")
            raw = out.column("t").to_numpy().tobytes()
            ends = (4 * np.cumsum(np.bincount(out.column("k").to_numpy() >> 10, minlength=len(some)))).tolist()
            self.ids.update(zip([word for _, word in some], [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of id sequences, by an ordered aggregation of the vocabulary's bytes; long ones in several parts."""
        if len(flat) and (flat.min() < 0 or flat.max() > self.last):
            raise ValueError("an id is not in the vocabulary")
        of, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat))
        out: list[list[bytes]] = [[] for _ in sizes]
        for at in range(0, len(flat), DECODED):
            part = slice(at, at + DECODED)
            self.con.register("ids_in", pa.table({"w": of[part], "p": place[part], "t": flat[part]}))
            found = self.con.sql(DECODE).to_arrow_table()
            self.con.unregister("ids_in")
            for w, raw in zip(found.column("w").to_pylist(), found.column("raw").to_pylist()):
                out[w].append(raw.encode("latin-1"))
        return [b"".join(parts) for parts in out]

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text, as 32-bit integers."""
        if len(self.ids) > self.keep // 2:
            self.ids, self.older = {}, self.ids
        rows = [list(self.split.pieces(t)) for t in batch]
        new = set().union(*rows).difference(self.ids)
        again = new.intersection(self.older)
        self.ids.update((p, self.older[p]) for p in again)
        if new := list(new - again):
            self.learn(new)
        ids = self.ids.__getitem__
        return [b"".join(map(ids, row)) for row in rows]


def roundtrip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP) -> DataFrame:
    """(doc_id, ids, decoded) for each row of docs: the ids of the text and the bytes that they decode to. keep: how
    many words a worker keeps; fewer take less memory and more time."""

    def run(batches):
        kept = worker_cache()
        if (ranks, pattern, keep) not in kept:
            kept[ranks, pattern, keep] = Codec(ranks, pattern, keep)
        codec = kept[ranks, pattern, keep]
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                raw = codec.encode(batch.column("text").to_pylist())
                flat, sizes = np.frombuffer(b"".join(raw), np.int32), np.array([len(r) // 4 for r in raw], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(codec.decode(flat, sizes), pa.binary())], ["doc_id", "ids", "decoded"])

    return map_arrow(texts(docs, id_col, text_col), run, "doc_id long, ids array<int>, decoded binary")
