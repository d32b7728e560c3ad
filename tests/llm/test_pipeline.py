"""The pipeline against a brute-force version, and what its stages do with odd columns, empty tables and odd texts."""

import datetime
import decimal
import hashlib
import math
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from sitewarden.llm import bpe, common, decontaminate, langid

STEMS = {"en": "the of and tion ing that with were have from this not out".split(), "de": "der und die schaft ung nicht ein auch mit sie das kei".split()}
DDL = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of many types, with names that operators use inside.
ODD = "`_gone` int, `when` timestamp, `others` map<string,int>, `null` binary, kept double, `node` array<struct<a:int,b:string>>, same decimal(20,4), component_id string, `_text` timestamp_ntz, `chunk` date, fp boolean, `a` float"


def prose(lang, n):
    return " ".join("".join(random.choices(STEMS[lang], k=2)) for _ in range(n))


def corpus():
    """Texts in two languages with copies, near copies, shared passages, leaks and junk."""
    item = prose("en", 18)
    texts = [prose(lang, random.randrange(30, 60)) for lang in ("en", "de") * 25]
    texts += [None, "", " \t ", "12345 !!!", texts[0], texts[3].upper(), texts[4]]
    for i in (6, 9, 10, 13):
        own = texts[i].split(" ")
        own[len(own) // 2] = "other"
        texts += [" ".join(own)]
    texts += [prose("en", 30) + " " + item + " " + prose("en", 20), prose("de", 30) + " " + item[5:85].upper(), prose("de", 40) + " " + texts[3][:200], texts[20][-120:] + prose("en", 30), "ß" * 20 + texts[21][:150]]
    return texts, item


def jaccard_roots(texts):
    sets = []
    for t in texts:
        words = t.encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def edits_within(window, text, budget):
    """Whether some stretch of text is within the budget of the window, by Sellers' algorithm."""
    row = list(range(len(window) + 1))
    for c in text:
        now = [0]
        for i, p in enumerate(window, 1):
            now.append(min(now[-1] + 1, row[i] + 1, row[i - 1] + (p != c)))
        if now[-1] <= budget:
            return True
        row = now
    return False


def brute(texts, item, model):
    rows = {i: t for i, t in enumerate(texts) if t is not None and model.predict(t)[0] != "und" and model.predict(t)[1] >= corpus_pipeline.LEAST_SCORE}
    ids = list(rows)
    rows = {i: rows[i] for n, i in enumerate(ids) if jaccard_roots([rows[j] for j in ids])[n] == n}
    seen, cut = set(), {}
    for i in sorted(rows):
        raw = rows[i].encode()
        windows = [raw[a : a + 50] for a in range(len(raw) - 49)]
        gone = {b for a, w in enumerate(windows) if w in seen for b in range(a, a + 50)}
        kept = bytes(c for b, c in enumerate(raw) if b not in gone).decode("utf-8", "ignore")
        seen.update(windows)
        if not gone or kept.strip():
            cut[i] = kept
    normal = decontaminate.normalise(item)
    windows = [normal[max(0, e - 64) : e] for e in [*range(64, len(normal), 8), len(normal)]]
    clean = {i: t for i, t in cut.items() if not any(w in decontaminate.normalise(t) or edits_within(w, decontaminate.normalise(t), min(int(len(w) * 0.08), len(w) // 8 - 1)) for w in windows)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = {}
    for i, t in clean.items():
        ids = library.encode_ordinary(t)
        out[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    random.seed(21)
    texts, item = corpus()
    docs = spark.createDataFrame([(i, t, "de" if i < 50 and i % 2 else "en", "s", len(t or "")) for i, t in enumerate(texts)], DDL)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item), (1, None), (2, "short")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute(texts, item, langid.fit(spark.read.parquet(str(tmp_path / "documents.parquet"))))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert {0, 3, 20} <= set(got) and not {50, 51, 52, 53, 54, 55, 56, 61, 62} & set(got)


def test_other_columns_travel_unchanged(spark, tmp_path):
    random.seed(22)
    texts, item = corpus()
    stamp = datetime.datetime(2024, 2, 29, 1, 2, 3, 123456)

    def odd(i):
        if i % 5 == 0:
            return (None,) * 12
        return (i, stamp, {"k": i, "": None}, bytes([0, 255, i]), math.nan if i % 2 else -0.0, [(i, "ü\x00"), None], decimal.Decimal("12345678.0001"), "c", stamp, stamp.date(), True, math.inf)

    docs = spark.createDataFrame([(i, t, "de" if i < 50 and i % 2 else "en", None, len(t or ""), *odd(i)) for i, t in enumerate(texts)] + [(None, prose("en", 40), "en", "s", 5, *odd(7))], f"{DDL}, {ODD}")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    schema, names = docs.schema, [c for c in docs.columns if c not in ("text", "n_chars")]
    plain = lambda r: repr([r[c] for c in names])
    want = {r.doc_id: plain(r) for r in docs.collect()}
    texts_of = {r.doc_id: r.text for r in docs.collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in schema], name
        out.write.parquet(str(tmp_path / f"stage{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{n}"))
        rows = docs.collect()
        assert rows and all(plain(r) == want[r.doc_id] for r in rows), name
        assert all(r.text == texts_of[r.doc_id] or name in ("suffix_dedup", "decontamination") for r in rows)
        assert None in {r.doc_id for r in rows}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)


def test_suffix_stage_keeps_null_and_empty_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " ", None, "s", 1)], DDL)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.suffix_dedup_stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "").collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in rows) == [(1, None, None), (2, "", 0), (3, " ", 1)]


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)))
def test_empty_tables(spark, tmp_path, step):
    spark.createDataFrame([], f"{DDL}, {ODD}").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = common.checkpoint(corpus_pipeline.STAGES[step][1](spark, docs, str(tmp_path)))
    assert out.count() == 0 and (step == 4 or out.columns == docs.columns)


def test_empty_benchmark_and_repeated_rows(spark, tmp_path):
    """Without benchmark items nothing goes; repeated rows are one document, of which every row stays or goes."""
    random.seed(23)
    rows = [(i, prose("en", 40), "en", "s", 1) for i in range(5)]
    spark.createDataFrame(rows * 2, DDL).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert sorted(r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()) == sorted([r[0] for r in rows] * 2), name
    assert docs.agg(F.count("*")).first()[0] == 10


def test_the_drivers_native_memory_is_given_back(spark):
    from sitewarden.llm import common

    assert "native heap" in common.trim_native(spark)
