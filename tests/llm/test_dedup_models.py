import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sitewarden.llm import chunks, common, decontaminate, flac, kneser_ney, langid, queries, simhash, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, tmp_path, name, rows, ddl):
    spark.createDataFrame(rows, ddl).withColumn("fingerprint", F.lit("clash")).withColumn("kept", F.lit(1)).repartition(3).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\v", " ").replace("\f", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, tmp_path):
    random.seed(1)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "One", "ÄB c", "x y"] + [" ".join(random.choices(words, k=random.randrange(2, 80))) for _ in range(40)]
    for t in texts[6:30]:
        own = t.split(" ")
        for _ in range(3):
            copy = list(own)
            copy[random.randrange(len(copy))] = random.choice(words)
            texts.append(" ".join(copy).upper())
    texts += [texts[8]] * 5 + [" ".join(random.choices(words, k=4000))]
    folder = write(spark, tmp_path, "documents", [(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in queries.op1_simhash_components(spark, folder).collect()}
    prints = [fingerprint(t) for t in texts]
    roots = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    for i in range(len(texts)):
        assert got[i].fingerprint == f"{prints[i]:016x}" and got[i].component_id == roots[i]


@pytest.mark.parametrize("crowd", [64, 1])
def test_links_lose_nothing(spark, monkeypatch, crowd):
    """Chains, stars and a crowd around one value, whatever the size of a cell from which members are linked by stars."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    random.seed(2)
    values = [random.getrandbits(64) for _ in range(20)]
    for _ in range(120):
        x = random.choice(values)
        for _ in range(random.choice((1, 2, 3))):
            x ^= 1 << random.randrange(64)
        values.append(x)
    base = random.getrandbits(64)
    values += [base ^ (1 << i) for i in range(64)] + [base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)]
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    got = {r.doc_id: r.component_id for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    roots = components(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2])
    assert got == dict(enumerate(roots))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(5, 5), (9, -4), (7, 9)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {9: -4, -4: -4, 7: -4}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    """Many tasks, a node with half of the edges on either side of them: the same classes as a plain search."""
    monkeypatch.setattr(common, "EDGES", 20)
    monkeypatch.setattr(common, "HOT_ONE_IN", 10)
    random.seed(20)
    pairs = [(50, i) for i in range(51, 160)] + [(500, i) for i in range(300, 400)] + [(random.randrange(160, 300), random.randrange(160, 300)) for _ in range(60)] + [(159, 400), (399, 600)]
    roots = components(601, pairs)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: roots[i] for i in {x for p in pairs for x in p if p[0] != p[1]}}


def test_near_classes(spark):
    random.seed(3)
    words = [f"w{i}" for i in range(500)]
    base = random.choices(words, k=200)
    far = random.choices(words, k=200)
    edited = list(base)
    edited[100] = "other"
    rows = [(4, " ".join(base)), (7, " ".join(edited)), (2, " ".join(far)), (9, " ".join(base[:100] + far[:100])), (None, " ".join(base)), (11, "one two"), (12, "one two")]
    rows += [(100 + i, " ".join(base[:50] + random.choices(words, k=150))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[7] == 4 and got[4] == 4 and got[2] == 2 and got[9] == 9 and got[12] == 11
    assert all(got[100 + i] == 100 + i for i in range(40))


@pytest.mark.parametrize("sample,tile", [(16, 512), (1, 512), (1, 16)])
def test_near_classes_lose_no_crowd(spark, monkeypatch, sample, tile):
    """A large group whose original has a high doc_id, pairs inside a shared template, and sizes about the limit."""
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    monkeypatch.setattr(simhash, "TILE", tile)
    random.seed(8)
    words = [f"w{i}" for i in range(3000)]

    def changed(text, k):
        own = list(text)
        for i in random.sample(range(len(own)), k):
            own[i] = random.choice(words)
        return own

    base, template = random.choices(words, k=200), random.choices(words, k=130)
    texts = [changed(base, 4) for _ in range(150)] + [base]
    for i in range(60):
        filled = template + random.choices(words, k=40)
        texts += [filled] + [changed(filled, 1 + i % 4)] * (i % 3 == 0)
    texts += [random.choices(words[:4], k=random.randrange(5, 60)) for _ in range(40)]
    ids = random.sample(range(10**6), len(texts))
    ids[150] = 10**6
    rows = list(zip(ids, map(" ".join, texts)))
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots = components(len(sets), linked)
    least = {}
    for root, i in zip(roots, ids):
        least[root] = min(least.get(root, i), i)
    got = {r.doc_id: r.component_id for r in simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: least[root] for i, root in zip(ids, roots)}
    assert len({got[i] for i in ids[:151]}) < 20


def test_near_classes_of_texts_that_share_a_doc_id(spark):
    """Each text of a doc_id is held against its own near copies, whatever the order of the rows."""
    random.seed(9)
    words = [f"w{i}" for i in range(500)]
    one, two, far = (random.choices(words, k=200) for _ in range(3))
    near = lambda t, i: " ".join([*t[:i], "other", *t[i + 1 :]])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (9, near(one, 20)), (11, near(two, 30)), (3, " ".join(far)), (8, near(far, 40)), (8, near(far, 150)), (4, near(far, 150))]
    for own in (rows, rows[::-1]):
        got = {(r.doc_id, r.component_id) for r in simhash.near_classes(spark.createDataFrame(own, "doc_id long, text string")).collect()}
        assert got == {(5, 5), (9, 5), (11, 5), (3, 3), (8, 3), (4, 3)}


def brute_removed(docs):
    best = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            best[w] = min(best.get(w, suffix_dedup.LAST), suffix_dedup.LAST if d is None else d)
    out = []
    for d, t in docs:
        b, order = (t or "").encode(), suffix_dedup.LAST if d is None else d
        gone = [False] * len(b)
        for i in range(len(b) - 49):
            if best[b[i : i + 50]] < order:
                gone[i : i + 50] = [True] * 50
        out.append((str(d), len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("crowd,local,size,step", [(4096, 400, 4 << 20, 1 << 15), (0, 400, 4 << 20, 64), (48, 3, 20000, 37), (2, 5, 3000, 101)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, crowd, local, size, step):
    for name, value in (("CROWD", crowd), ("LOCAL", local), ("STEP", step)):
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(chunks.chunks, "__defaults__", (size,))
    random.seed(5)
    syllables = ["tion", "the", "er", "ou", "\x00", "\x01", "é", "中", "a", " ", " the ", "\n"]
    make = lambda n: "".join(random.choice(syllables) for _ in range(n))
    passages, line = [make(60) for _ in range(4)], "All rights reserved. Do not copy this line without asking first, please."
    docs = []
    for i in range(150):
        text = make(random.randrange(1, 150))
        for _ in range(random.randrange(3)):
            text += random.choice(passages)[random.randrange(20) :] + make(20)
        if i % 2:
            text += "\n" + line + "\n" + make(10)
        if docs and i % 9 == 0:
            text = random.choice(docs)[1]
        if docs and i % 10 == 0:
            own = list(random.choice(docs)[1] or "x")
            own[random.randrange(len(own))] = "Q"
            text = "".join(own)
        docs.append((random.randrange(10**6), text))
    docs += [(None, passages[0] + passages[1]), (None, passages[0] + "x"), (3, None), (4, ""), (5, "a" * 400), (6, "a" * 120), (7, "ab" * 100), (8, "ba" * 100), docs[5], docs[5], (9, "x" * 49), (10, "x" * 49)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").coalesce(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(rows).collect())
    assert got == brute_removed(docs)


def test_merge_orders_shards():
    """The interleave of two shards equals the order of their suffixes by the first symbols."""
    random.seed(6)
    strings = ["".join(random.choices("ab", k=random.randrange(50, 90))).encode() for _ in range(12)]
    least = np.arange(12, dtype=np.int64)[::-1].copy()
    got = suffix_dedup.least_by_window(strings, least)
    for i, s in enumerate(strings):
        for o in range(len(s) - 49):
            assert got[i][o] == min(least[j] for j, t in enumerate(strings) if s[o : o + 50] in t)


def test_a_chunk_without_its_answers_fails():
    _, blob = chunks.pack([1, 2], [b"x" * 60, b"y" * 70])
    with pytest.raises(RuntimeError, match="chunk has no answer"):
        suffix_dedup.Chunk(blob, 6).choose([])


def test_merge_derives_common_prefixes():
    """The merged order is that of the first symbols, and lcp what neighbours share of them, in steps of two."""
    random.seed(16)
    texts, built = [], []
    for _ in range(3):
        own = "".join(random.choices("ab", k=70)) + random.choice(["", "ab" * 30])
        texts.append(np.frombuffer((own + "\x01\x00").encode(), np.uint8))
        order = suffix_dedup.suffix_array(texts[-1])
        built.append((suffix_dedup.transform(texts[-1], order), order))
    shard, lcp = suffix_dedup.merge([t for t, _ in built], 50)
    left = [iter(order.tolist()) for _, order in built]
    heads = [np.roll(texts[s], -next(left[s])).tobytes()[:50] for s in shard.tolist()]
    assert heads == sorted(heads)
    for i in range(1, len(heads)):
        shared = next((n for n in range(50) if heads[i][n] != heads[i - 1][n]), 50)
        assert lcp[i] == shared // 2 * 2


def test_flac_round_trips():
    random.seed(7)
    payloads = [bytes(64), bytes(random.randrange(256) for _ in range(4096)), bytes([7] * 1024) + bytes(range(256)) * 5, b"text and more text " * 64, bytes(np.cumsum(np.random.default_rng(1).integers(-3, 4, 8192)).astype(np.int64) & 255)]
    payloads += [bytes(random.randrange(97, 100) for _ in range(64 * k)) for k in (1, 15, 16, 17, 130 * 16)]
    streams = flac.encode_streams(payloads)
    for p, (samples, points, _) in zip(payloads, flac.decode_streams(streams)):
        assert (samples.view(np.uint8) ^ 128).tobytes() == p and int(points["samples"].sum()) == len(p)
    assert flac.seek(streams[1], 1000, 2000) == payloads[1][1000:3000] and flac.seek(streams[1], 4095, 1) == payloads[1][4095:]
    assert [flac.encode_streams([p])[0] for p in payloads] == streams
    for at in (60, len(streams[1]) - 1, len(streams[1]) // 2):
        broken = bytearray(streams[1])
        broken[at] ^= 4
        with pytest.raises((ValueError, IndexError)):
            flac.decode_streams([bytes(broken)])
    with pytest.raises(ValueError):
        flac.encode_streams([b"x"])


class NaiveFlac:
    """A decoder of one-channel streams, a bit at a time, from the format's description (RFC 9639)."""

    def __init__(self, stream):
        self.data, self.at = stream, 0

    def bits(self, n):
        value = 0
        for _ in range(n):
            value = value << 1 | self.data[self.at >> 3] >> 7 - (self.at & 7) & 1
            self.at += 1
        return value

    def signed(self, n):
        value = self.bits(n)
        return value - (1 << n) if n and value >> n - 1 else value

    def unary(self):
        n = 0
        while not self.bits(1):
            n += 1
        return n

    def crc(self, start, poly, width):
        value = 0
        for byte in self.data[start : self.at >> 3]:
            value ^= byte << width - 8
            for _ in range(8):
                value = (value << 1 ^ (poly if value >> width - 1 else 0)) & (1 << width) - 1
        return value

    def residual(self, block, order):
        wide = 4 + self.bits(2)
        parts, out = 1 << self.bits(4), []
        for part in range(parts):
            rice = self.bits(wide)
            for _ in range(block // parts - (order if part == 0 else 0)):
                assert rice != (1 << wide) - 1, "no escapes are written"
                folded = self.unary() << rice | self.bits(rice)
                out.append(folded >> 1 ^ -(folded & 1))
        return out

    def subframe(self, block, width):
        assert self.bits(1) == 0
        kind = self.bits(6)
        assert self.bits(1) == 0
        if kind == 0:
            return [self.signed(width)] * block
        if kind == 1:
            return [self.signed(width) for _ in range(block)]
        order = kind - 8 if kind < 32 else kind - 31
        out = [self.signed(width) for _ in range(order)]
        if kind < 32:
            weights, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
        else:
            precision, shift = self.bits(4) + 1, self.signed(5)
            weights = [self.signed(precision) for _ in range(order)]
        for error in self.residual(block, order):
            out.append(error + (sum(w * v for w, v in zip(weights, out[::-1])) >> shift))
        return out

    def samples(self):
        assert self.bits(32) == int.from_bytes(b"fLaC")
        last = 0
        while not last:
            last, kind, size = self.bits(1), self.bits(7), self.bits(24)
            if kind == 0:
                self.bits(80)
                rate, channels, width, total = self.bits(20), self.bits(3) + 1, self.bits(5) + 1, self.bits(36)
                digest = self.bits(128).to_bytes(16)
                assert (channels, width, rate) == (1, 8, flac.RATE)
            else:
                self.bits(8 * size)
        out = []
        while len(out) < total:
            start = self.at >> 3
            assert self.bits(14) == 0x3FFE and self.bits(1) == 0 and self.bits(1) == 0
            size, _, channel, depth = self.bits(4), self.bits(4), self.bits(4), self.bits(3)
            assert channel == 0 and depth in (0, 1) and self.bits(1) == 0
            lead = self.bits(8)
            more = 0 if lead < 128 else format(lead, "08b").index("0") - 1
            number = lead if lead < 128 else lead & (1 << 6 - more) - 1
            for _ in range(more):
                number = number << 6 | self.bits(8) & 63
            assert number == len(out) // flac.BLOCK
            block = 192 if size == 1 else 144 << size if size < 6 else self.bits(8) + 1 if size == 6 else self.bits(16) + 1 if size == 7 else 1 << size
            check = self.crc(start, 0x07, 8)
            assert self.bits(8) == check
            out += self.subframe(block, 8)
            self.at += -self.at % 8
            check = self.crc(start, 0x8005, 16)
            assert self.bits(16) == check
        assert self.at == 8 * len(self.data) and hashlib.md5(bytes(v & 255 for v in out)).digest() == digest
        return out


def test_flac_streams_follow_the_format():
    random.seed(14)
    payloads = [bytes(64), bytes(random.randrange(256) for _ in range(1088)), b"text and more text  " * 16, "schöne Wörter, très été ".encode() * 90, bytes(np.cumsum(np.random.default_rng(1).integers(-3, 4, 3072)).astype(np.int64) & 255), bytes(range(256)) * 2 + bytes(1024)]
    payloads = [p + bytes(-len(p) % 64) for p in payloads]
    for payload, stream in zip(payloads, flac.encode_streams(payloads)):
        assert bytes(v + 128 for v in NaiveFlac(stream).samples()) == payload


def test_flac_rice_codes_with_long_quotients():
    bits = np.zeros(400, np.uint8)
    bits[3], bits[3 + 1 + 130] = 1, 1
    reader = flac._Bits(np.packbits(bits))
    assert reader.ones(np.array([0, 4])).tolist() == [3, 130]


def test_media_query(spark, tmp_path):
    import hashlib
    import zlib

    texts = [None, "", "a", "é" * 40, "same", "same", "word " * 9000]
    folder = write(spark, tmp_path, "documents", [(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in queries.op6_flac_media(spark, folder).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[4].media_sha256 == got[5].media_sha256 and got[4].feature == got[5].feature
    media = flac.encode_column(spark.read.parquet(f"{folder}/documents.parquet").where("doc_id = 6"))
    blocks = flac.blocks(media).orderBy("block").collect()
    assert b"".join(bytes(b.pcm) for b in blocks).startswith(texts[6].encode()) and [b.sample_offset for b in blocks] == [1024 * i for i in range(len(blocks))]


def test_language_id(spark, tmp_path):
    random.seed(8)
    stems = {"en": "the of and tion ing that with", "de": "der und die schaft ung nicht ein", "fr": "le des une eau que dans pour"}
    rows = [(i, " ".join(random.choices(stems[lang].split(), k=random.randrange(3, 60))), lang, "s", 0) for i, lang in enumerate(random.choices(list(stems), k=400))]
    rows += [(1000, None, "en", "s", 0), (1001, "123 !!", "en", "s", 0), (1002, "the of and", None, "s", 0), (None, "der und die", "de", "s", 0), rows[0], (1003, "", "de", None, None)]
    folder = write(spark, tmp_path, "documents", rows, DOCS)
    got = queries.op4_language_id(spark, folder).collect()
    assert len(got) == len(rows)
    import zlib

    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(held) > 40 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.doc_id in (1000, 1001, 1003):
            assert r.lang_pred == "und"


def test_language_features_dont_depend_on_blocks(monkeypatch):
    text = "Thé quick, brown  fox 123 jumps! " * 20
    whole = langid.counts(text)[0]
    for size in (1, 2, 7):
        monkeypatch.setattr(langid, "BLOCK", size)
        assert (langid.counts(text)[0] == whole).all()


def naive_features(text):
    """Counts of hashed 1- to 3-grams, one at a time."""
    codes, out = [32], Counter()
    for c in text.lower():
        code = ord(c) if c.isalpha() else 32
        if code != 32 or codes[-1] != 32:
            codes.append(code)
    for at in range(1, len(codes)):
        mixed = 0
        for n in range(3):
            if at - n < 0:
                break
            mixed = (mixed + codes[at - n] * int(langid._MIX[n]) + n) & 0xFFFFFFFF
            out[((mixed ^ mixed >> 15) * int(langid._MIX[1]) & 0xFFFFFFFF) >> 32 - langid.BITS] += 1
    return out


def test_language_features_against_brute_force():
    for text in ("Thé quick, 12 brown  fox!", "a", "ab", "ß ñ 中文 xyz", "  lead", "x" * 50):
        got = langid.counts(text)[0]
        assert {int(i): int(got[i]) for i in np.flatnonzero(got)} == naive_features(text)


def test_ftrl_and_temperature_against_brute_force(monkeypatch):
    """Every coordinate and class by itself, from the update rule; the divisor from a plain search of its grid."""
    monkeypatch.setattr(langid, "BITS", 4)
    random.seed(17)
    train = []
    for _ in range(40):
        at = np.array(sorted(random.sample(range(16), 4)))
        label = int(at[0]) % 3
        train.append((at, np.array([random.random() for _ in at]), label))
    weights, bias = langid._ftrl(train, 3)
    z, n = {}, {}

    def w(key):
        if abs(z.get(key, 0.0)) <= langid.L1:
            return 0.0
        return -(z[key] - math.copysign(langid.L1, z[key])) / ((langid.BETA + math.sqrt(n[key])) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(0)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(len(train)):
            at, x, label = train[i]
            pairs = [*zip(at.tolist(), x.tolist()), ("bias", 1.0)]
            own = {(f, c): w((f, c)) for f, _ in pairs for c in range(3)}
            scores = [sum(v * own[f, c] for f, v in pairs) for c in range(3)]
            total = sum(math.exp(s - max(scores)) for s in scores)
            for c in range(3):
                slip = math.exp(scores[c] - max(scores)) / total - (c == label)
                for f, v in pairs:
                    g = v * slip
                    before = n.get((f, c), 0.0)
                    n[f, c] = before + g * g
                    z[f, c] = z.get((f, c), 0.0) + g - (math.sqrt(n[f, c]) - math.sqrt(before)) / langid.ALPHA * own[f, c]
    assert np.allclose(weights, [[w((f, c)) for c in range(3)] for f in range(16)]) and np.allclose(bias, [w(("bias", c)) for c in range(3)])
    assert (weights == 0).any() and (weights != 0).any()

    def loss(t):
        out = 0.0
        for at, x, label in train:
            scores = [(sum(v * weights[f, c] for f, v in zip(at, x)) + bias[c]) / t for c in range(3)]
            out -= scores[label] - math.log(sum(map(math.exp, scores)))
        return out / len(train)

    grid = [math.exp(math.log(0.2) + i * (math.log(5) - math.log(0.2)) / 64) for i in range(65)]
    assert abs(langid._temperature(train, weights, bias) - min(grid, key=loss)) < 1e-9


def test_language_scores_against_brute_force():
    """A prediction from its parts: features, weights of log counts by rarity, unit length, a softmax at the temperature."""
    random.seed(18)
    rng = np.random.default_rng(5)
    model = langid.Model(["a", "b", "c"], rng.random(1 << langid.BITS) + 1, rng.normal(size=(1 << langid.BITS, 3)), rng.normal(size=3), 1.7)
    for text in ("Das ist ein Satz.", "the cat", "é"):
        x = {f: math.log1p(k) * model.idf[f] for f, k in naive_features(text).items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        scores = [(sum(v / size * model.weights[f, c] for f, v in x.items()) + model.bias[c]) / 1.7 for c in range(3)]
        p = [math.exp(s) / sum(map(math.exp, scores)) for s in scores]
        lang, score = model.predict(text)
        assert lang == "abc"[p.index(max(p))] and abs(score - max(p)) < 1e-9
    assert model.predict("12 !") == ("und", 0.0) and model.predict(None) == ("und", 0.0)


def test_language_id_without_training_rows(spark, tmp_path):
    folder = write(spark, tmp_path, "documents", [(1, "the cat", None, "s", 0)], DOCS)
    assert [(r.lang_pred, r.score) for r in queries.op4_language_id(spark, folder).collect()] == [("und", 0.0)]


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        now = [i]
        for j, c in enumerate(text, 1):
            now.append(min(row[j] + 1, row[j - 1] + (p != c), now[j - 1] + 1))
        row = now
    return min(row)


def test_banded_alignment_against_brute_force():
    """Pairs of all kinds side by side: where the band has a match within the budget, the least edits and a stretch with them."""
    random.seed(19)
    budget, pairs = 3, []
    for _ in range(300):
        pattern = "".join(random.choices("abc", k=24))
        own = list(pattern)
        for _ in range(random.randrange(6)):
            own[random.randrange(len(own))] = random.choice(["", "x", "yy"])
        before = "".join(random.choices("abc", k=random.randrange(12)))
        pairs.append((pattern, before + "".join(own) + "".join(random.choices("abc", k=random.randrange(9))), len(before) - random.randrange(2 * budget)))
    pairs += [("a" * 24, "", 0), ("a" * 24, "a" * 22, -1), ("b" * 24, "a" * 40, 3)]
    got = decontaminate.align([p.encode() for p, _, _ in pairs], [t.encode() for _, t, _ in pairs], np.array([low for *_, low in pairs]), budget)
    for (pattern, text, _), (edits, start, stop) in zip(pairs, got.tolist()):
        least = edit_distance_in(pattern, text)
        assert edits >= least
        if edits <= budget:
            assert edits == edit_distance_in(pattern, text[start:stop]) and 0 <= start <= stop <= len(text)
        else:
            assert least > 0
    inside = [(edits, edit_distance_in(p, t)) for (p, t, _), edits in zip(pairs, got[:, 0])]
    assert sum(e == b for e, b in inside if b <= budget) >= 0.9 * sum(b <= budget for _, b in inside) > 100


def test_decontamination_against_brute_force(spark, tmp_path):
    random.seed(9)
    syllables = "tion the er ou ing ha and re th on".split()
    sentence = lambda n: " ".join("".join(random.choices(syllables, k=2)) for _ in range(n))
    items = [(i, sentence(25).capitalize() + ".") for i in range(6)] + [(90, "short one"), (91, None), (92, "a little item of thirty letters")]
    texts = [sentence(120) for _ in range(12)] + [None, ""]
    for i, item in items[:6]:
        for edits in (0, 2, 4, 30):
            own = list(item.upper() if edits == 2 else item.replace(" ", "\n  "))
            for _ in range(edits):
                own[random.randrange(len(own))] = random.choice(["", "q", "zz"])
            texts.append(sentence(30) + " " + "".join(own) + ", " + sentence(30))
    texts.append("x " + items[0][1][:95] + " y")
    write(spark, tmp_path, "benchmark", items, "item_id long, text string")
    folder = write(spark, tmp_path, "documents", [(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    found = queries.op5_benchmark_leaks(spark, folder).collect()
    index = decontaminate.Index.build(items)
    want = {(d, int(index.items[w])) for d, t in enumerate(texts) for w, pattern in enumerate(index.windows) if edit_distance_in(pattern, decontaminate.normalise(t or "")) <= index.budgets[w]}
    assert {(r.doc_id, r.item_id) for r in found} == want and {(14 + 4 * i, i) for i in range(6)} <= want and (len(texts) - 1, 0) in want
    for r in found:
        if r.doc_id == 14:
            assert [texts[14][s.start : s.stop] for s in r.spans] == [items[0][1].replace(" ", "\n  ").rstrip(".")]


def test_decontamination_finds_partial_leaks():
    """A verbatim stretch of WINDOW bytes of an item is found wherever it begins, and one of 71 with 5 edits."""
    random.seed(10)
    letters = "abcdefghijklmnopqrstuvwxyz"
    make = lambda n: " ".join("".join(random.choices(letters, k=random.randrange(2, 9))) for _ in range(n))
    item = decontaminate.normalise(make(50)).decode()
    index = decontaminate.Index.build([(1, item), (2, make(60))])
    for size, edits in ((64, 0), (71, 5)):
        for at in range(len(item) - size + 1):
            leak = list(item[at : at + size])
            for i in random.sample(range(size), edits):
                leak[i] = random.choice("0123456789")
            assert 1 in decontaminate.by_item(index, [f"{make(20)}q{''.join(leak)}q{make(20)}"])[0], at
    assert decontaminate.by_item(index, [make(200), "", make(5)]) == [{}, {}, {}]


def test_kneser_ney_against_brute_force(spark):
    share = F.pmod(F.xxhash64("id"), F.lit(10_000)) >= 5000  # of so few trusted documents half sets limits
    first, second, third = (r.id for r in spark.range(100, 200).where(share).orderBy("id").limit(3).collect())
    docs = [(first, "the cat sat on the mat the cat", "en"), (second, "the dog sat on the log", "en"), (2, "", "en"), (3, None, None), (4, "zzz qqq ###", "fr"), (4, "zzz qqq ###", "fr"), (None, "the cat", "en"), (third, "le chat était là", "fr"), (1, "the log", "en")]
    trusted = {first, second, third, 1}
    frame, ids = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(i,) for i in [*trusted, 1]], "doc_id long")
    held = {r.doc_id for r in ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(10_000)) < 5000).collect()}
    assert not held & {first, second, third}

    def grams(text):
        raw = bytes(4) + (text or "").encode() + b"\0"
        return [raw[i - 4 : i + 1] for i in range(4, len(raw))]

    counts = {5: Counter(g for d, t, _ in docs if d in trusted - held for g in grams(t))}
    for n in (4, 3, 2, 1):
        counts[n] = Counter(k[1:] for k in counts[n + 1])
    discounts = {}
    for n, own in counts.items():
        c = Counter(own.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
        discounts[n] = [min(max(i - (i + 1) * y * c[i + 1] / c[i] if c[i] else i * 0.5, 0.05), i - 0.05) for i in (1, 2, 3)]

    def p(k):
        if not k:
            return 1 / 256
        own = counts[len(k)]
        context = {q: a for q, a in own.items() if q[:-1] == k[:-1]}
        if not context:
            return p(k[1:])
        d, total = lambda a: discounts[len(k)][min(a, 3) - 1], sum(context.values())
        a = context.get(k, 0)
        return (a - d(a) if a else 0) / total + sum(map(d, context.values())) / total * p(k[1:])

    want = sorted((str(d), round(sum(-math.log(p(g)) for g in grams(t)) / len(grams(t)), 4)) for d, t, _ in docs)
    for limit in (32 << 20, 1):  # by a broadcast, and by chunks that meet the shards
        got = kneser_ney.classify(frame, ids, limit).collect()
        assert sorted((str(r.doc_id), round(math.log(r.perplexity), 4)) for r in got) == want


def test_quality_separates(spark):
    random.seed(10)
    words = "the of and that with from have were their they this not".split()
    rows = [(i, " ".join(random.choices(words, k=40)), "en") for i in range(120)] + [(1000 + i, "".join(chr(random.randrange(33, 127)) for _ in range(200)), "en") for i in range(20)]
    got = kneser_ney.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.range(100).withColumnRenamed("id", "doc_id")).collect()
    assert all(r.quality == (r.doc_id < 1000) for r in got)
    empty = kneser_ney.classify(spark.createDataFrame(rows[:3], "doc_id long, text string, lang string"), spark.range(0).withColumnRenamed("id", "doc_id")).collect()
    assert len(empty) == 3 and all(r.quality and r.threshold is None for r in empty)


@pytest.mark.parametrize("limit", [0, 32 << 20])
def test_quality_limits_against_brute_force(spark, tmp_path, limit):
    """Each language's limit is the quantile of its held-out trusted documents; one without any has that of all."""
    random.seed(12)
    words = "the of and that with from have were their they this not".split()
    rows = [(i, " ".join(random.choices(words, k=random.randrange(0, 30))) + "".join(random.choices("abcdefgh ", k=random.randrange(20))), ("en", "de", "xx", None)[i % 4], "clash") for i in range(400)]
    rows += [(None, None, "en", "clash"), (7, "again", "de", "clash"), (900, "x" * 300_000, "fr", "clash"), (901, "", "fr", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, threshold string")
    trusted = spark.createDataFrame([(i,) for i in range(300) if i % 4 != 2] * 2 + [(None,)], "doc_id long")
    got = kneser_ney.classify(docs, trusted, limit).collect()
    assert len(got) == len(rows)
    bins = lambda lang=None: sorted(math.floor(math.log(r.perplexity) * 1000 + 1e-9) for r in got if r.trusted and r.held and (lang is None or r.lang == lang))
    quantile = lambda b: next(x for i, x in enumerate(b, 1) if i >= len(b) * kneser_ney.QUANTILE)
    assert len(bins("en")) > 20 and len(bins("de")) > 20 and not bins("xx")
    for r in got:
        cut = quantile(bins(r.lang) if r.lang in ("en", "de") else bins())
        assert abs(math.log(r.threshold) * 1000 - cut - 1) < 1e-6 and r.quality == (math.log(r.perplexity) * 1000 < cut + 1)
    for lang in ("en", "de"):
        own = [r for r in got if r.trusted and r.lang == lang]
        assert 0.3 < sum(r.held for r in own) / len(own) <= 0.7


def test_quality_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert kneser_ney.classify(docs, spark.createDataFrame([], "doc_id long")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    random.seed(11)
    stems = {"en": "the of and tion ing that with were have from", "de": "der und die schaft ung nicht ein auch mit sie"}
    make = lambda lang, n: " ".join("".join(random.choices(stems[lang].split(), k=2)) for _ in range(n))
    rows = [(i, make(lang, 60), lang, "s", None) for i, lang in enumerate(["en", "de"] * 40)]
    item = make("en", 30)
    near = rows[0][1].split()
    near[30] = "other"
    rows += [(200, "12345 !!!", "en", "s", None), (201, None, "en", "s", None), (202, rows[0][1], "en", "t", None), (203, " ".join(near), "en", "s", None), (204, make("en", 40) + " " + item + " " + make("en", 20), "en", "s", None), (205, make("de", 40) + " " + rows[3][1][:200], "de", "s", None)]
    write(spark, tmp_path, "benchmark", [(0, item)], "item_id long, text string")
    folder = write(spark, tmp_path, "documents", rows, DOCS)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.checkpoint(stage(spark, docs, folder))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "bpe_roundtrip":
            assert docs.columns == columns
        if name == "suffix_dedup":
            assert docs.where("doc_id = 205").first().text.strip() and len(docs.where("doc_id = 205").first().text) <= len(rows[-1][1]) - 195
    assert ids == set(range(80)) | {205}
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == ids


def test_first_shingles_are_not_kept_once_they_have_met(spark, monkeypatch):
    from sitewarden.llm import simhash

    kept, frees = [], []
    monkeypatch.setattr(simhash, "checkpoint", lambda df, f=simhash.checkpoint: kept.append(df.columns) or f(df))
    monkeypatch.setattr(simhash, "free", lambda spark, f=simhash.free: frees.append(len(kept)) or f(spark))
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, words + " x"), (3, words), (4, "other text of its own here")], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_classes(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}
    slim = [c for c in kept if c == ["doc_id", "same"]]
    assert slim and frees and not any("low" in c for c in kept[frees[0]:])
