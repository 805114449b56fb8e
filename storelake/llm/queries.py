"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelake.llm.bpe import bpe_encode_decode
from storelake.llm.chat import format_chats
from storelake.llm.exact_dedup import exact_dedup
from storelake.llm.fingerprints import edited_pairs
from storelake.llm.licenses import license_scan
from storelake.llm.mixing import mix_sources
from storelake.llm.near_dedup import near_duplicates
from storelake.llm.periodic_runs import periodic_runs
from storelake.llm.quality import quality_scores
from storelake.llm.registry import register
from storelake.llm.secret_scan import secret_scan
from storelake.llm.spans import span_dedup
from storelake.llm.toxicity import toxicity_scores
from storelake.llm.whitening import whiten

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


OP1_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), k AS (
  SELECT doc_id, norm, length(x) AS n_chars,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(x) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""


@register("op1_exact_dedup", OP1_SQL)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents through the extendible-hash index."""
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, CAST(floor(turn / 512) AS BIGINT) AS part FROM conversations
), whole AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS said, count(*) AS n FROM turns GROUP BY conv_id
), inner_prefix AS (
  SELECT DISTINCT k, list_slice(said, 1, k) AS said FROM (SELECT said, unnest(range(1, n)) AS k FROM whole)
), ends AS (
  SELECT said, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM whole GROUP BY said, n
), kept AS (
  SELECT e.* FROM ends e WHERE NOT EXISTS (SELECT 1 FROM inner_prefix p WHERE p.k = e.n AND p.said = e.said)
)
SELECT t.conv_id, t.part, k.n AS n_turns, k.n_copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS text
FROM turns t JOIN kept k ON t.conv_id = k.conv_id GROUP BY t.conv_id, t.part, k.n, k.n_copies
"""


@register("op6_chat_formatting", OP6_SQL)
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapse snapshots of logged conversations and render the maximal ones."""
    return format_chats(table(spark, sf_dir, "conversations"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS said FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(said) >= 2 THEN list_transform(range(1, len(said)), lambda i: said[i] || ' ' || said[i + 1])
                                      WHEN len(said) = 1 THEN said ELSE [] END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id) - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a
)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.other) AS component_id, w.doc_id = min(r.other) AS kept
FROM w JOIN reach r ON r.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""


@register("op2_near_dedup", OP2_SQL)
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets are 80 % alike."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2).select("doc_id", "n_shingles", "component_id", "kept")


@register("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the Kneser-Ney model of trusted text, and the decision."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


@register("op5_mixing")
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Pfair slot of every document."""
    return mix_sources(table(spark, sf_dir, "documents")).drop("text_key")


@register("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    return bpe_encode_decode(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY), with_ids=False)


@register("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    return edited_pairs(table(spark, sf_dir, "documents"))


@register("op9_licenses")
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered template spans of every document."""
    return license_scan(table(spark, sf_dir, "documents"))


@register("op7_secrets")
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan(table(spark, sf_dir, "documents"))


@register("op10_span_dedup")
def op10_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences of spans that an earlier document has."""
    return span_dedup(table(spark, sf_dir, "documents"))


def periodic_edit(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every document, where by the contract one in ten repeats its words from some place on.

    With h the CRC-32 of the decimal doc_id and g = h // 10, every word i >= a = g % n of a document of n words
    with h % 10 = 0 becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). A null id repeats nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.coalesce("text", F.lit(""))
    said = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", text.alias("text"), h.alias("h")).withColumn("said", F.when(F.col("h") % 10 == 0, said))
    edited = """array_join(transform(sequence(0, size(said) - 1), i -> said[if(i < a, i, a + (i - a) % p)]), ' ')"""
    g, n = F.floor(F.col("h") / 10), F.size("said")
    rows = rows.withColumn("a", F.when(n > 0, F.pmod(g, n)).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.pmod(g, F.lit(8))))).cast("int"))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.expr(edited)).otherwise(F.col("text")).alias("text"))


@register("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document (edited as the contract says) and the text without their repeats."""
    found = periodic_runs(periodic_edit(table(spark, sf_dir, "documents")))
    # the longest run; of equal ones the first, then the shortest period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    found = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("best.less"), F.col("best.period")
    return found.select("doc_id", "n_words", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@register("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings without gaps, in steps of 1/1024 from -100000, whitened to eight components.

    Entries beyond 2 ** 50 steps count as that many."""
    most = float(1 << 50)
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    step = lambda c: F.floor(F.greatest(F.least(1024 * c.cast("double"), F.lit(most)), F.lit(-most))) + 100000
    rows = table(spark, sf_dir, "embeddings").where(F.coalesce(whole, F.lit(False)))
    return whiten(rows.select("vec_id", F.transform("embedding", step).alias("embedding")))


@register("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely every document is to be labelled toxic, learnt from the labels of four fifths of them."""
    found = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_words", "bits")
