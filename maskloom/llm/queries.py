"""The numbered queries: each maps the given tables to an operator's records and its results back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.llm import (
    alignment, byte_bpe, dialogues, language_model, licences, metric_search, mixing, near_copies, near_vectors, periodic_runs,
    quality_classifier, quality_rules, repeats,
)
from maskloom.llm.records import REGION_ID, TEXT, stored, text_regions
from maskloom.plans.registry import query
from maskloom.sources.adapters import table


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_regions(table(spark, sf_dir, "documents"))


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode_texts(_regions(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode_tokens(encoded, ranks).select(
        F.col(REGION_ID).alias("doc_id"),
        F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(byte_bpe.joined_ids(), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op1_license_scans")
def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(_regions(spark, sf_dir))
    base = F.filter("detections", lambda d: d["base"])

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")

    return found.select(
        F.col(REGION_ID).alias("doc_id"),
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.size("detections").cast("bigint").alias("n_detections"),
    )


@query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, labels = _regions(spark, sf_dir), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col(REGION_ID).cast("string").cast("binary")) % 5
    learn = labels.select(F.col("doc_id").alias(REGION_ID), "quality").filter(fold != 0)
    # Labels grow with the documents: sent to neither side whole, whatever their size.
    model = quality_classifier.fit_quality(regions.join(learn.hint("merge"), REGION_ID))
    return quality_classifier.score_quality(regions, model).select(
        F.col(REGION_ID).alias("doc_id"),
        (fold == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored(quality_rules.text_statistics(_regions(spark, sf_dir)), "statistics")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(REGION_ID), "quality")
    rules = quality_rules.learn_rules(counts.join(labels, REGION_ID))
    return counts.select(
        F.col(REGION_ID).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality_rules.base_failed().alias("base_failed"),
        (~quality_rules.base_failed() & quality_rules.verdict(rules)).alias("kept"),
    )


@query("op2_minhash_near_copies")
def op2_minhash_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(_regions(spark, sf_dir), percent=85).withColumnRenamed(REGION_ID, "doc_id")


@query("op6_near_vectors")
def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(near_vectors.ID), "embedding")
    return near_vectors.near_vectors(images).withColumnRenamed(near_vectors.ID, "vec_id")


@query("op7_cut_repeats")
def op7_cut_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(_regions(spark, sf_dir)).select(
        F.col(REGION_ID).alias("doc_id"), F.size("cuts").cast("bigint").alias("n_cuts"),
        F.coalesce(F.aggregate("cuts", F.lit(0).cast("bigint"), lambda n, c: n + c["last"] - c["first"]), F.lit(0)).alias("cut_chars"),
        "cuts", F.col("original_text").alias("text"))


#: Shares of all tokens that the mix is to have, by language.
MIX = {"en": 0.50, "de": 0.18, "fr": 0.18, "es": 0.14}


def domain_labels(documents: DataFrame) -> DataFrame:
    """The language that a document declares is its label; what its text belongs to is for the classifier to say."""
    return documents.select(F.col("doc_id").cast("bigint").alias(REGION_ID), F.col("lang").alias("domain"))


@query("op8_soft_mixing")
def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    members, model, rates = mixing.mixed_rates(text_regions(documents), domain_labels(documents), MIX)
    rate = rates.column()
    return members.select(
        F.col(REGION_ID).alias("doc_id"), "n_tokens",
        *[F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(model.domains)],
        rate.alias("rate"), mixing.copies(rate, F.col(REGION_ID)).alias("copies"))


@query("op5_chat_formatting")
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    told = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("messages"))
    said = F.lit("</s>[INST] ok [/INST]")
    planted = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), said.alias("prompt"), said.alias("completion"))
    records = told.unionByName(planted, allowMissingColumns=True)
    texts = dialogues.formatted(dialogues.canonical_turns(records, "conv_id"), "conv_id")
    back = dialogues.read_back(texts, "conv_id")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(F.array_join("learned", "")).cast("bigint").alias("loss_chars"),
        F.sha2(F.array_join("learned", ""), 256).alias("loss_sha256"), "formatted_chars")


@query("op4_katz_backoff")
def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = _regions(spark, sf_dir)
    held_out = F.crc32(F.col(REGION_ID).cast("string").cast("binary")) % 7 == 2
    model = language_model.learn(regions.filter(~F.coalesce(held_out, F.lit(False))))
    return language_model.score(regions, model).select(
        F.col(REGION_ID).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(hashed / 10)
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    n = F.size(words)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (3 + g % 8))
    turns = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), turns)), F.lit(1), (n - a).cast("int"))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    text = F.when((hashed % 10 == 0) & (n > 0), planted).otherwise(F.col("text"))
    regions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(REGION_ID), text.alias(TEXT))
    found = periodic_runs.periodic_runs(regions)
    kind = found.schema["runs"].dataType.elementType.simpleString()
    best = F.aggregate("runs", F.lit(None).cast(kind), lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        F.col(REGION_ID).alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_metric_search", """
    WITH sound AS (
        SELECT vec_id, [floor(256 * e::DOUBLE)::BIGINT for e in embedding] AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce(list_bool_or([e IS NULL OR NOT isfinite(e) for e in embedding]), false)),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)]), 0)::BIGINT AS score
        FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM scored QUALIFY rank <= 5""")
def op12_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("embedding").cast("array<double>")
    sound = ~F.exists(number, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    images = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias(metric_search.ID), F.when(sound, F.transform(number, lambda e: F.floor(256 * e))).alias(metric_search.VECTOR))
    found = metric_search.top_products(images, images.filter(F.col(metric_search.ID) % 50 == 0), 5)
    return found.select("query_id", "rank", F.col(metric_search.ID).alias("vec_id"), "score")


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (alignment.read_model(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    aligned = alignment.aligned_texts(_regions(spark, sf_dir), a, b)
    aligned = stored(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counts = stored(alignment.link_counts(aligned), "counts")
    return alignment.with_counts(aligned, counts).select(
        F.col(REGION_ID).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
