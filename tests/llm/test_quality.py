"""The Kneser-Ney model against a plain dictionary version, and held-out accuracy."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict
from statistics import NormalDist

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from storelake.llm import quality
from storelake.llm.quality import keep_good, quality_scores

SF = "/root/testdata/sf0.01"


def _model(texts):
    """Interpolated modified Kneser-Ney over characters, order 5, as dictionaries."""
    grams = Counter()
    for t in texts:
        s = "\x02\x02\x02\x02" + t + "\x03"
        grams.update(s[i : i + 5] for i in range(len(s) - 4))
    tables = {5: grams}
    for o in (4, 3, 2, 1):
        tables[o] = Counter(g[1:] for g in tables[o + 1])
    parts = {}
    for o, table in tables.items():
        n = Counter(table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = {k: max(0.01, k - (k + 1) * y * n[k + 1] / n[k]) if n[k] else 0.5 for k in (1, 2, 3)}
        total, cut = defaultdict(int), defaultdict(float)
        for g, c in table.items():
            total[g[:-1]] += c
            cut[g[:-1]] += d[min(c, 3)]
        parts[o] = (table, d, total, cut)

    def p(g):
        if not g:
            return 1 / 4096
        table, d, total, cut = parts[len(g)]
        lower = p(g[1:])
        h = g[:-1]
        if h not in total:
            return lower
        c = table.get(g, 0)
        return (c - d[min(c, 3)] if c else 0) / total[h] + cut[h] / total[h] * lower

    return p


def _bits(p, t):
    s = "\x02\x02\x02\x02" + t + "\x03"
    return -sum(math.log2(p(s[i : i + 5])) for i in range(len(s) - 4)) / (len(s) - 4)


@pytest.mark.parametrize("block_bytes", [2000, 1 << 20])
def test_scores_match_brute_force(spark, block_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").select("doc_id", F.substring("text", 1, 400).alias("text"), "lang")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.collect()
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    got = {r.doc_id: r for r in quality_scores(docs, labels, block_bytes=block_bytes).collect()}
    assert len(got) == len(rows)
    folds = {i: r.fold for i, r in got.items()}
    assert {i for i, k in folds.items() if k is not None} == good & got.keys() and set(folds.values()) == {0, 1, 2, None}
    models = {(lang, k): _model([r.text for r in rows if r.lang == lang and folds[r.doc_id] not in (k, None)]) for lang in {r.lang for r in rows} for k in range(3)}
    for r in rows:
        fold = folds[r.doc_id]
        by = [_bits(models[r.lang, k], r.text) for k in range(3) if fold in (k, None)]  # a model that counted it has no say
        assert got[r.doc_id].bits == pytest.approx(sum(by) / len(by), rel=1e-5)


def _threshold(told, quantile=0.995, least=200):
    """Limits by sorting: (middle, width) of each language, from (lang, n_grams, bits) of trusted texts."""

    def quantile_of(pairs, q):
        total, upto = sum(w for _, w in pairs), 0.0
        for x, w in sorted(pairs):
            upto += w
            if upto >= total * q - 1e-6:
                return x

    up = lambda x: math.ceil(x * 10_000) / 10_000
    langs = {lang for lang, _, _ in told}
    middle = {a: up(quantile_of([(b, 1) for lang, _, b in told if lang == a], 0.5)) for a in langs}
    off = [(lang, (b - middle[lang]) / math.sqrt(1 + 4096 / n)) for lang, n, b in told]
    whole = up(quantile_of([(abs(x), 1) for _, x in off], 0.5))
    out = {}
    spread = {}
    for a in langs:
        own = [abs(x) for lang, x in off if lang == a]
        spread[a] = max((len(own) * up(quantile_of([(x, 1) for x in own], 0.5)) + 4 * whole) / (len(own) + 4), 1e-4)
    score = [(lang, min(100, max(-100, x / spread[lang]))) for lang, x in off]
    for a in langs:
        n = sum(lang == a for lang, _ in score)
        top = quantile_of([(x, (lang == a) + least / len(score)) for lang, x in score], quantile)
        z = NormalDist().inv_cdf(quantile)
        out[a] = middle[a], spread[a] * max(top, 0) * math.sqrt(1 + math.pi / 2 / n) * (1 + (z * z + 1) / (4 * 0.37 * (n + 4)))
    return out


def test_thresholds_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400").select("doc_id", "text", "lang")
    got = quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    told = {(r.lang, r.text_key): (r.lang, r.n_grams, r.bits) for r in got if r.fold is not None}
    by = _threshold(list(told.values()))
    for r in got:
        middle, width = by[r.lang]
        assert r.threshold == pytest.approx(middle + width * math.sqrt(1 + 4096 / r.n_grams), rel=0.01)
        if abs(r.bits - r.threshold) > 0.02 * r.threshold:
            assert r.kept == (r.bits <= r.threshold)


def test_held_out_accuracy(spark):
    """Half of the labels train; on the other half good text stays and bad text mostly goes."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_scores(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    kept = {r.quality: r.share for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert kept[1] > 0.97 and kept[0] < 0.25


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (6, 1), (None, 1)], "doc_id long, quality int")
    got = quality_scores(edge_docs, labels).collect()
    assert len(got) == edge_docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fold is not None and by[6].fold is not None and by[2].fold is None  # labels that disagree
    assert by[8].kept and by[8].threshold is None  # no trusted text in its language
    assert by[3].n_grams == 1 and by[9].lang == "und"
    stay = keep_good(edge_docs, labels)
    assert stay.columns == edge_docs.columns
    assert stay.count() == sum(r.kept for r in got)
    assert quality_scores(no_docs, labels).count() == 0
    none = quality_scores(edge_docs, labels.where("1 = 0"))
    assert none.where("kept").count() == edge_docs.count()


def test_thresholds_follow_the_length(spark):
    """One short text does not set the threshold of long ones, and no class of lengths has a rule of its own."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_scores(docs, labels).join(labels, "doc_id").select("lang", "quality", "n_grams", "threshold", "kept").toPandas()
    bad = got[(got.quality == 0) & got.kept].groupby("lang").size()
    assert bad["de"] <= 14 and bad["en"] <= 20 and bad["fr"] <= 18  # 19, 25 and 20 by length classes
    assert got[got.quality == 1].kept.mean() > 0.995
    for _, own in got.groupby("lang"):
        own = own.sort_values("n_grams")
        assert (own.threshold.diff().dropna() <= 1e-9).all()  # longer texts never have a higher one


@pytest.mark.parametrize("n_labels", [1, 3, 8, 20])
def test_a_rare_language_keeps_its_clean_documents(spark, n_labels):
    """Few labels of a language do not make its other clean documents go."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    good = labels.where("quality = 1").select("doc_id")
    rare = docs.where("lang = 'fr'").join(good, "doc_id").orderBy("doc_id").limit(80).select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    rare_ids = [r.doc_id for r in rare.select("doc_id").orderBy("doc_id").collect()]
    some = docs.where("lang = 'en' AND doc_id < 1500").unionByName(rare)
    told = labels.where(~F.col("doc_id").isin(rare_ids[n_labels:]))
    got = quality_scores(some, told).where("lang = 'und'").toPandas()
    assert len(got) == len(rare_ids) and got.kept.mean() > 0.95


def test_a_block_does_not_hold_its_texts_unpacked():
    texts = [f"{i} some words of text {i * 7} and more of them. " * 2000 for i in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([i]), pa.array(["en"]), pa.array([t])], ["doc_id", "text_key", "lang", "text"]) for i, t in enumerate(texts)]
    tracemalloc.start()
    (row,) = quality._blocks(1 << 30, quality.LEVEL, far=True)(iter(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(map(len, texts)) / 4
    cells, said = quality._one_by_one(pa.Table.from_batches([row]))
    assert cells["doc_ids"] == list(range(40)) and [t.decode() for t in said] == texts
    assert quality._documents(pa.Table.from_batches([row]))[1] == [t.encode() for t in texts]


def test_counting_a_block_does_not_hold_its_texts():
    texts = [f"{i} some words of text {i * 7} and more of them. " * 2000 for i in range(160)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([i]), pa.array(["en" if i % 3 else "de"]), pa.array([t])], ["doc_id", "text_key", "lang", "text"]) for i, t in enumerate(texts)]
    (row,) = quality._blocks(1 << 30, quality.LEVEL, far=True)(iter(batches))
    folds = {i: i % quality.FOLDS for i in range(0, 160, 2)}
    trusted = pa.table({"place": pa.array(list(folds), pa.int32()), "fold": pa.array(list(folds.values()), pa.int32())})
    block = pa.Table.from_batches([row])
    tracemalloc.start()
    found = quality._count(block, trusted)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # what is held does not grow with the texts: slices of n-grams and their distinct ones
    assert peak < 10 * 8 * quality._HELD < 4 * sum(map(len, texts))
    want = {}
    for i, t in enumerate(texts):
        for g, n in Counter(quality.ngrams(t.encode()).tolist()).items():
            counts = want.setdefault(("en" if i % 3 else "de", g), [0] * quality.FOLDS)
            if i in folds:
                counts[folds[i]] += n
    got = {(r["lang"], r["gram"]): [r[n] for n in quality._COUNTS] for r in found.to_pylist()}
    assert got == want and len(got) == found.num_rows


def test_counts_are_handed_back_in_small_batches():
    text = "".join(map(chr, random.Random(1).choices(range(0x4E00, 0x9000), k=200_000)))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array(["zh"]), pa.array([text])], ["doc_id", "text_key", "lang", "text"])
    (row,) = quality._blocks(1 << 30)(iter([batch]))
    found = quality._count(pa.Table.from_batches([row]), pa.table({"place": pa.array([], pa.int32()), "fold": pa.array([], pa.int32())}))
    sizes = [b.num_rows for b in found.to_batches()]
    assert len(sizes) > 1 and max(sizes) <= quality._ROWS
    assert sorted(found.column("gram").to_pylist()) == sorted(set(quality.ngrams(text.encode()).tolist()))


def test_blocks_are_not_written_with_buffers_of_a_whole_block(spark, monkeypatch):
    written = []
    plainly = quality.written_bucketed
    monkeypatch.setattr(quality, "written_bucketed", lambda df, path, *keys, **options: written.append(path) or plainly(df, path, *keys, **options))
    docs = spark.createDataFrame([(1, "a text", "en"), (2, "another text", "en")], "doc_id long, text string, lang string")
    assert quality_scores(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 2
    (blocks,) = (p for p in written if p.endswith("/blocks"))
    files = spark.read.format("binaryFile").load(f"{blocks}/*.parquet").select("content").collect()
    codecs = {f.row_group(g).column(c).compression for r in files for f in [pq.ParquetFile(pa.BufferReader(r.content)).metadata] for g in range(f.num_row_groups) for c in range(f.num_columns)}
    assert codecs == {"ZSTD"}
