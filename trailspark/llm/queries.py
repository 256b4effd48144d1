"""The thirteen operators over their whole tables: one query each, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import crc32_of_id
from . import audio, bpe, exact_dedup, jaccard_join, langid, packing, pii, quality, resharding, runs, search, secret_scan, warc


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    import public_tokenizers

    ranks, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encode(_read(spark, sf_dir, "documents"), ranks, pattern)
    out = bpe.decode(ids, ranks, pattern)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and their places in sequences of 4096 tokens."""
    pieces = packing.tokenize_pieces(_read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    told = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(told).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row of equal texts stays, for every document."""
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and spans."""
    found = pii.with_spans(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["rank"] < len(pii.BASE))
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model that held-out documents had no part in."""
    docs = _read(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return out.select("doc_id", langid.held_out("doc_id").alias("held_out"), "language.lang_pred", "language.score", "language.accepted")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through the capture index."""
    pages = _read(spark, sf_dir, "pages")
    captures = warc.write_archive(pages)
    found = warc.lookup(pages, warc.build_index(captures))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as audio, read back, with a digest of its features."""
    out = audio.read_tensors(audio.features(audio.store(_read(spark, sf_dir, "documents"))))
    mean = F.transform("tensors", lambda t: F.bround(F.aggregate(t, F.lit(0.0), lambda a, x: a + x.cast("double")) / (audio.TENSOR_FRAMES * audio.MELS), 3).cast("string"))
    spans = F.zip_with("span_starts", "span_ends", lambda a, b: F.concat_ws("-", F.bround(a, 3).cast("string"), F.bround(b, 3).cast("string")))
    feature = F.concat_ws("|", F.col("frames").cast("string"), F.array_join(mean, ","), F.array_join(spans, ","))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and spans."""
    found = secret_scan.find_secrets(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return found.select("doc_id", *map(count, secret_scan.KINDS[:3]), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op11_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from six shards by id to eight of even bytes, as read back from the rewritten layout."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    path, schema = resharding.write_layout(docs, F.pmod(F.xxhash64("doc_id"), F.lit(6)), size, "doc_id")
    out, _ = resharding.reshard(spark, path, schema, lambda total: resharding.even_capacities(total, 8))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search.rank_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents whose id has a checksum divisible by ten repeat p of their words from word a on."""
    h = crc32_of_id("doc_id")
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    told = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words")).withColumn("n", F.size("words"))
    told = told.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    told = told.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    planted = F.array_join(F.transform("words", lambda w, i: F.get("words", place(i))), " ")
    return told.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four and more periods in every document, and what is left without their repeats."""
    found = runs.periodic_runs(_with_planted_runs(_read(spark, sf_dir, "documents").select("doc_id", "text")))
    found = found.select("doc_id", "periodic.runs", "periodic.collapsed").withColumn("best", runs.best_run(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_packing, op3_exact_dedup, op4_pii, op5_language_id, op6_warc, op7_quality, op8_jaccard_join, op9_media, op10_secrets, op11_resharding, op12_ranked_search, op13_periodic_runs)
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
        SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
        FROM g""",
    "op12_ranked_search": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
             n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
             s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM n),
             f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
             w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM f, s GROUP BY term, docs),
             q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
             r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // length))))) AS BIGINT) AS score
                   FROM q JOIN f USING (term) JOIN w USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM r WHERE score > 0 QUALIFY rank <= 10""",
}
