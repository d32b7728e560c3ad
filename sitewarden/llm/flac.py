"""Media columns in FLAC: 8-bit mono streams in a binary column, encoded and decoded with numpy.

encode_streams() stores payloads as FLAC: frames of up to BLOCK samples, fixed or linear predictors, Rice-coded
residuals, CRC-8 frame headers, CRC-16 frames, an MD5 of the samples and a seek table with one point a frame.
decode_streams() reads such streams: it checks the magic, header and frame checksums, decodes Rice residuals (with
partitions) and predictors of order 0 to 32, and verifies the MD5. A code's place depends on the code before it, so
all frames of a slice are decoded in step: one numpy operation reads one residual of every frame. The seek table
gives the frames' places; blocks() writes PCM blocks with their sample offsets, seek() decodes only the frames that
hold the wanted samples.

A byte b of a payload is the sample b - 128. Payloads are padded by zero bytes to a positive multiple of PAD.

Defined cases: a null text is the empty one and becomes PAD zero bytes; equal texts give equal streams and features;
repeated rows are coded one by one; damaged streams raise ValueError; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarden.llm.common import map_arrow, slices, texts

PAD, BLOCK, SLICE = 64, 1024, 1 << 20
RATE, MAX_LPC, PRECISION = 8000, 4, 10
SEEK_POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for value in range(256):
        c = value << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        table.append(c)
    return np.array(table, np.int64)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _checksum(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each run of data, all runs in step."""
    order = np.argsort(-sizes, kind="stable")
    starts, left = starts[order], sizes[order]
    crc, mask = np.zeros(len(order), np.int64), (1 << bits) - 1
    active = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")
    for j, n in enumerate(active):
        head = crc[:n]
        crc[:n] = ((head << 8) & mask) ^ table[(head >> (bits - 8)) ^ data[starts[:n] + j]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... of each run, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[at + b] = (values >> (width - 1 - b)) & 1


def _predictors(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each column of x (samples, frames): order, coefficients (MAX_LPC, frames), shift and whether fixed.

    Candidates are the fixed predictors of order 0 to 2 and a quantised linear predictor of order MAX_LPC by
    Levinson-Durbin; the least sum of absolute residuals wins."""
    frames = x.shape[1]
    valid = np.arange(x.shape[0])[:, None] < n
    f = np.where(valid, x, 0).astype(np.float64)
    r = np.array([(f[lag:] * f[: len(f) - lag]).sum(0) for lag in range(MAX_LPC + 1)])
    a, err = np.zeros((MAX_LPC, frames)), np.maximum(r[0], 1e-9) * (1 + 1e-9)
    for i in range(MAX_LPC):
        k = (r[i + 1] - (a[:i] * r[1 : i + 1][::-1]).sum(0)) / err
        a[:i] = a[:i] - k * a[:i][::-1]
        a[i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(0), 1e-6)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 15)
    limit = 1 << (PRECISION - 1)
    lpc = np.clip(np.rint(a * (1 << shift)), -limit, limit - 1).astype(np.int64)
    zero = np.zeros((MAX_LPC, frames), np.int64)
    fixed = [zero.copy() for _ in range(3)]
    fixed[1][0], fixed[2][0], fixed[2][1] = 1, 2, -1
    costs, none = [], np.zeros(frames, np.int64)
    for order, c, s in ((0, fixed[0], none), (1, fixed[1], none), (2, fixed[2], none), (MAX_LPC, lpc, shift)):
        costs.append((np.abs(_residual(x, c, s, order)) * valid).sum(0))
    best = np.argmin(costs, axis=0)
    order = np.array([0, 1, 2, MAX_LPC])[best]
    coefficients = np.where(best == 3, lpc, np.where(best == 2, fixed[2], np.where(best == 1, fixed[1], zero)))
    return order, coefficients, np.where(best == 3, shift, 0), best < 3


def _residual(x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray, order: int) -> np.ndarray:
    """Prediction errors with warm-up samples left as they are."""
    total = np.zeros(x.shape, np.int64)
    for j in range(order):
        total[j + 1 :] += coefficients[j] * x[: len(x) - j - 1]
    out = x - (total >> shift)
    out[:order] = x[:order]
    return out


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; lengths are positive multiples of PAD."""
    if not payloads:
        return []
    data = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.array([len(p) for p in payloads], np.int64)
    if (sizes <= 0).any() or (sizes % PAD).any():
        raise ValueError(f"payloads must be positive multiples of {PAD} bytes")
    per = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), per)
    number = _runs(np.zeros(len(per), np.int64), per)
    begin = np.repeat(np.cumsum(sizes) - sizes, per) + number * BLOCK
    n = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    rows = np.arange(BLOCK)[:, None]
    x = data[np.minimum(begin + rows, len(data) - 1)].astype(np.int64) - 128
    valid = rows < n
    x = np.where(valid, x, 0)
    constant = ((x == x[0]) | ~valid).all(0)
    order, coefficients, shift, fixed = _predictors(x, n)
    r = np.zeros_like(x)
    for o in np.unique(order):
        at = np.flatnonzero(order == o)
        r[:, at] = _residual(x[:, at], coefficients[:, at], shift[at], int(o))
    coded = valid & (rows >= order)
    folded = np.where(coded, (r << 1) ^ (r >> 63), 0)
    mean = folded.sum(0) / np.maximum(n - order, 1)
    rice = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int64)
    length = np.where(coded, (folded >> rice) + 1 + rice, 0)
    side = np.where(fixed, 0, 9 + order * PRECISION)
    total = 8 + order * 8 + side + 10 + length.sum(0)
    verbatim = ~constant & (total >= 8 + 8 * n)
    total = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, total))
    body = -(-total // 8)
    # bits of all subframes, each from a byte of its own
    base = (np.cumsum(body) - body) * 8
    bits = np.zeros(int(body.sum()) * 8, np.uint8)
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(fixed, 8 + order, 31 + order)))
    _put(bits, base, kind << 1, 8)
    _put(bits, base[constant] + 8, x[0, constant] & 255, 8)
    raw_at = np.flatnonzero(verbatim)
    if len(raw_at):
        inside = valid[:, raw_at].T
        _put(bits, (base[raw_at][:, None] + 8 + 8 * rows.T)[inside], x[:, raw_at].T[inside] & 255, 8)
    plain = ~constant & ~verbatim
    for j in range(MAX_LPC):
        at = np.flatnonzero(plain & (order > j))
        _put(bits, base[at] + 8 + 8 * j, x[j, at] & 255, 8)
    at = np.flatnonzero(plain & ~fixed)
    place = base[at] + 8 + 8 * order[at]
    _put(bits, place, np.full(len(at), PRECISION - 1), 4)
    _put(bits, place + 4, shift[at], 5)
    for j in range(MAX_LPC):
        _put(bits, place + 9 + PRECISION * j, coefficients[j, at] & ((1 << PRECISION) - 1), PRECISION)
    at = np.flatnonzero(plain)
    place = base[at] + 8 + 8 * order[at] + side[at]
    _put(bits, place + 6, rice[at], 4)
    used = coded[:, at].T
    sizes_of = length[:, at].T
    starts = (place + 10)[:, None] + np.cumsum(sizes_of, axis=1) - sizes_of
    k = np.broadcast_to(rice[at][:, None], used.shape)[used]
    value = folded[:, at].T[used]
    stop = starts[used] + (value >> k)
    bits[stop] = 1
    for b in range(int(k.max()) if len(k) else 0):
        some = k > b
        bits[(stop + k - b)[some]] = ((value >> b) & 1)[some]
    bodies = np.packbits(bits)
    del bits, starts, stop, value, length, folded
    # frame headers: sync, 16-bit block size, mono, 8 bits a sample, number in UTF-8, CRC-8
    head = np.zeros((len(n), 14), np.int64)
    head[:, 0], head[:, 1], head[:, 2], head[:, 3] = 0xFF, 0xF8, 0x70, 0x02
    coded_number = [chr(i).encode("utf-8", "surrogatepass") if i < 0x110000 else _utf8(i) for i in range(int(number.max()) + 1)]
    width = np.array([len(c) for c in coded_number])[number]
    table = np.zeros((len(coded_number), 6), np.int64)
    for i, c in enumerate(coded_number):
        table[i, : len(c)] = list(c)
    head[:, 4:10] = table[number]
    lines = np.arange(len(n))
    head[lines, 4 + width], head[lines, 5 + width] = (n - 1) >> 8, (n - 1) & 255
    head_size = 7 + width
    flat = head.astype(np.uint8).ravel()
    head[lines, 6 + width] = _checksum(flat, lines * 14, head_size - 1, CRC8, 8)
    flat = head.astype(np.uint8).ravel()
    frame = head_size + body + 2
    lead = 42 + 4 + 18 * per
    stream = lead + np.bincount(owner, frame, len(per)).astype(np.int64)
    origin = np.cumsum(stream) - stream
    inside = np.cumsum(frame) - frame
    inside -= np.repeat(inside[np.cumsum(per) - per], per)
    at = (origin + lead)[owner] + inside
    out = np.zeros(int(stream.sum()), np.uint8)
    out[_runs(at, head_size)] = flat[_runs(lines * 14, head_size)]
    out[_runs(at + head_size, body)] = bodies
    crc = _checksum(out, at, frame - 2, CRC16, 16)
    out[at + frame - 2], out[at + frame - 1] = crc >> 8, crc & 255
    points = np.zeros(len(n), SEEK_POINT)
    points["sample"], points["offset"], points["samples"] = number * BLOCK, inside, n
    signed = (data ^ 128).tobytes()
    first, done, result = 0, 0, []
    for i, count in enumerate(per.tolist()):
        a, size = int(origin[i]), int(sizes[i])
        least, most = int(frame[first : first + count].min()), int(frame[first : first + count].max())
        packed = (RATE << 44) | (0 << 41) | (7 << 36) | size
        info = struct.pack(">HH", BLOCK, BLOCK) + least.to_bytes(3, "big") + most.to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed[done : done + size]).digest()
        seek = points[first : first + count].tobytes()
        top = b"fLaC" + b"\x00" + (34).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek
        out[a : a + len(top)] = np.frombuffer(top, np.uint8)
        result.append(out[a : a + int(stream[i])].tobytes())
        first, done = first + count, done + size
    return result


def _utf8(value: int) -> bytes:
    """The extended UTF-8 form of numbers beyond Unicode."""
    tail = []
    for _ in range(4 if value < 1 << 26 else 5):
        tail.append(0x80 | value & 63)
        value >>= 6
    return bytes([(0xF8 if len(tail) == 4 else 0xFC) | value, *reversed(tail)])


def read_head(stream: bytes) -> tuple[int, bytes, np.ndarray, int]:
    """(samples, MD5, seek points, place of the first frame) of a stream."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, samples, md5, points = 4, False, 0, b"", None
    while not last:
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                raise ValueError("only mono streams of 8 bits a sample are read")
            samples, md5 = packed & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            points = np.frombuffer(body, SEEK_POINT)
        at += 4 + size
    if points is None:
        raise ValueError("the stream has no seek table with a point for each frame")
    return samples, md5, points, at


class _Bits:
    """Reads from many bit positions at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(padded) - 8,), ">u8", padded, strides=(1,))

    def window(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each position, at the top of a 64-bit word."""
        return self.words[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned numbers of up to 57 bits; width may differ by position and be 0."""
        return ((self.window(at) >> np.uint64(1)) >> (63 - np.asarray(width)).astype(np.uint64)).astype(np.int64)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        value, half = self.take(at, width), np.int64(1) << (np.asarray(width) - 1)
        return (value ^ half) - half

    def ones(self, at: np.ndarray) -> np.ndarray:
        """The number of zero bits before the next one."""
        top = (self.window(at) >> np.uint64(24)).astype(np.int64)
        zeros = 40 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        for i in np.flatnonzero(top == 0):
            extra, place = 40, at[i : i + 1] + 40
            while not (word := int(self.window(place)[0]) >> 24):
                extra, place = extra + 40, place + 40
            zeros[i] = extra + 40 - word.bit_length()
        return zeros


def decode_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (rows, frames), their counts and the Rice parameter (-1: none) of frames at known places of data."""
    crc = _checksum(data, starts, sizes - 2, CRC16, 16)
    if (crc != (data[starts + sizes - 2].astype(np.int64) << 8 | data[starts + sizes - 1])).any():
        raise ValueError("a frame's checksum is wrong")
    if (data[starts] != 0xFF).any() or (data[starts + 1] != 0xF8).any() or (data[starts + 2] >> 4 != 7).any() or (data[starts + 3] != 2).any():
        raise ValueError("a frame's header is not one of a mono stream of 8 bits")
    lead = data[starts + 4]
    width = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    n = (data[starts + 4 + width].astype(np.int64) << 8 | data[starts + 5 + width]) + 1
    if (_checksum(data, starts, 6 + width, CRC8, 8) != data[starts + 6 + width]).any():
        raise ValueError("a frame header's checksum is wrong")
    order_of = np.argsort(-n, kind="stable")  # the longest first, so that those still active are a prefix
    starts, sizes, n, width = starts[order_of], sizes[order_of], n[order_of], width[order_of]
    bits = _Bits(data)
    at = (starts + 7 + width) * 8
    kind = bits.take(at, 8) >> 1
    at = at + 8
    constant, verbatim = kind == 0, kind == 1
    is_fixed, is_lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | is_fixed | is_lpc).all():
        raise ValueError("a subframe type is reserved")
    order = np.where(is_fixed, kind - 8, np.where(is_lpc, kind - 31, 0))
    top, depth, frames = int(n.max()), int(order.max()), len(n)
    x = np.zeros((top, frames), np.int64)
    x[:, constant] = bits.signed(at[constant], 8)
    for j in np.arange(top if verbatim.any() else 0):
        some = np.flatnonzero(verbatim & (n > j))
        x[j, some] = bits.signed(at[some] + 8 * j, 8)
    for j in range(depth):
        some = np.flatnonzero(order > j)
        x[j, some] = bits.signed(at[some] + 8 * j, 8)
    at = at + 8 * order
    coefficients, shift = np.zeros((max(depth, 1), frames), np.int64), np.zeros(frames, np.int64)
    for o, row in enumerate(((1,), (2, -1), (3, -3, 1), (4, -6, 4, -1)), 1):
        for j, c in enumerate(row[: depth]):
            coefficients[j, is_fixed & (order == o)] = c
    some = np.flatnonzero(is_lpc)
    precision = bits.take(at[some], 4) + 1
    shift[some] = bits.signed(at[some] + 4, 5)
    for j in range(depth):
        has = some[order[some] > j]
        p = precision[order[some] > j]
        coefficients[j, has] = bits.signed(at[has] + 9 + j * p, p)
    at[some] += 9 + order[some] * precision
    coded = is_fixed | is_lpc
    rice = np.full(frames, -1, np.int64)
    which = np.flatnonzero(coded)
    if len(which):
        place, wanted, skip = at[which], n[which], order[which]
        if (bits.take(place, 2) != 0).any():
            raise ValueError("only residuals with 4-bit Rice parameters are read")
        part = wanted >> bits.take(place + 2, 4)
        place = place + 6
        k = np.zeros(len(which), np.int64)
        active = np.searchsorted(-wanted, -np.arange(top), side="left")
        border = np.zeros(len(which), np.int64)  # the sample at which the next partition begins
        for i in range(top):
            m = active[i]
            new = np.flatnonzero(border[:m] == i)
            if len(new):
                k[new] = bits.take(place[new], 4)
                if (k[new] == 15).any():
                    raise ValueError("escaped partitions are not read")
                place[new] += 4
                border[new] += part[new]
            some = slice(0, m) if i >= depth else np.flatnonzero(skip[:m] <= i)
            p, width_k = place[some], k[some]
            zeros = bits.ones(p)
            p = p + zeros + 1
            value = (zeros << width_k) | bits.take(p, width_k)
            place[some] = p + width_k
            x[i, which[some]] = (value >> 1) ^ -(value & 1)
        rice[which] = k
        if ((place + 7) // 8 != (starts + sizes - 2)[which]).any():
            raise ValueError("a frame doesn't end where the next one begins")
        if depth:
            e = np.ascontiguousarray(x[:, which])
            c, s = coefficients[:, which], shift[which]
            for i in range(1, top):
                total = np.zeros(len(which), np.int64)
                for j in range(min(i, depth)):
                    total += c[j] * e[i - 1 - j]
                add = total >> s
                e[i] += add if i >= depth else np.where(skip <= i, add, 0)
            x[:, which] = e
    samples, counts, parameters = np.empty_like(x), np.empty_like(n), np.empty_like(rice)
    samples[:, order_of], counts[order_of], parameters[order_of] = x, n, rice
    return samples, counts, parameters


def decode_streams(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(samples as signed bytes, seek points, Rice parameter of each frame) of each stream, checksums verified."""
    if not streams:
        return []
    heads = [read_head(s) for s in streams]
    data = np.frombuffer(b"".join(streams), np.uint8)
    origin, starts, sizes = 0, [], []
    for stream, (_, _, points, first) in zip(streams, heads):
        offsets = points["offset"].astype(np.int64)
        starts.append(origin + first + offsets)
        sizes.append(np.diff(offsets, append=len(stream) - first))
        origin += len(stream)
    x, n, rice = decode_frames(data, np.concatenate(starts), np.concatenate(sizes))
    flat = x.T[np.arange(len(x)) < n[:, None]].astype(np.int8)
    out, done, frame = [], 0, 0
    for samples, md5, points, _ in heads:
        own = flat[done : done + samples]
        if hashlib.md5(own.tobytes()).digest() != md5 or (n[frame : frame + len(points)] != points["samples"]).any():
            raise ValueError("the samples' checksum is wrong")
        out.append((own, points, rice[frame : frame + len(points)]))
        done, frame = done + samples, frame + len(points)
    return out


def seek(stream: bytes, sample: int, count: int) -> bytes:
    """The payload bytes from a sample on, from only the frames that hold them."""
    _, _, points, first = read_head(stream)
    a = int(np.searchsorted(points["sample"].astype(np.int64), sample, side="right")) - 1
    b = int(np.searchsorted(points["sample"].astype(np.int64), sample + count, side="left"))
    offsets = np.append(points["offset"].astype(np.int64), len(stream) - first)
    x, n, _ = decode_frames(np.frombuffer(stream, np.uint8), first + offsets[a:b], np.diff(offsets[a : b + 1]))
    flat = x.T[np.arange(len(x)) < n[:, None]]
    skip = sample - int(points["sample"][a])
    return (flat[skip : skip + count] + 128).astype(np.uint8).tobytes()


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes, padded, as a FLAC stream."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                raw = [t.encode() for t in batch.column("text").to_pylist()]
                media = encode_streams([r + bytes(-len(r) % PAD if r else PAD) for r in raw])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_arrow(texts(docs, id_col, text_col), run, "doc_id long, n_bytes long, media binary")


def features(samples: np.ndarray, points: np.ndarray, rice: np.ndarray) -> str:
    """Figures of the samples themselves; equal samples give equal strings."""
    x = samples.astype(np.float64)
    crossings = int((np.diff(np.signbit(x)) != 0).sum())
    mean_rice = float(rice[rice >= 0].mean()) if (rice >= 0).any() else -1.0
    return f"samples={len(x)};frames={len(points)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};peak={int(np.abs(x).max())};crossings={crossings};rice={mean_rice:.3f}"


def blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample_offset, byte_offset, n_samples, pcm): the PCM blocks of (doc_id, media)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "media", SLICE):
                streams = batch.column("media").to_pylist()
                for doc, (samples, points, _) in zip(batch.column("doc_id").to_pylist(), decode_streams(streams)):
                    pcm = (samples.view(np.uint8) ^ 128).tobytes()
                    at = points["sample"].astype(np.int64)
                    cut = [pcm[a : a + n] for a, n in zip(at, points["samples"].astype(np.int64))]
                    columns = [pa.array([doc] * len(at), pa.int64()), np.arange(len(at), dtype=np.int32), at, points["offset"].astype(np.int64), points["samples"].astype(np.int32), pa.array(cut, pa.binary())]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "block", "sample_offset", "byte_offset", "n_samples", "pcm"])

    return map_arrow(media.select("doc_id", "media"), run, "doc_id long, block int, sample_offset long, byte_offset long, n_samples int, pcm binary")


def describe(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), decoded from media."""
    kept = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "media", SLICE):
                rows = []
                for samples, points, rice in decode_streams(batch.column("media").to_pylist()):
                    payload = (samples.view(np.uint8) ^ 128).tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), features(samples, points, rice)))
                size, sha, crc, feature = zip(*rows)
                found = [pa.array(size, pa.int64()), pa.array(sha), pa.array(crc, pa.int64()), pa.array(feature)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], [*kept, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    digests = media.select("doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    return map_arrow(digests, run, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
