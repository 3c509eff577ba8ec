"""Queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import exact_dedup

    return exact_dedup.assign(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


#: Turns of a transcript that stand in one row, and pieces above which the pieces of a row (of repeated positions) stay apart.
TURNS_A_ROW = 3
MOST_PIECES = 64


def marked_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, said (the turn's text) and line (as it stands in a transcript).

    Speakers are marked by a style of the conversation; one turn in nine (never a first one) has no marker, and follows a
    blank line; one in thirteen ends by quoting a marker.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    user = F.when(style == 0, "User: ").when(style == 1, "### Human: ").when(style == 2, "<|user|> ").otherwise("Q: ")
    assistant = F.when(style == 0, "Assistant: ").when(style == 1, "### Assistant: ").when(style == 2, "<|assistant|> ").otherwise("A: ")
    system = F.when(style == 2, "<|system|> ").otherwise("System: ")
    later = F.col("turn") > 0
    bare = F.coalesce(later & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(9)) == 0), F.lit(False))
    mark = F.when(bare, "").when(F.col("role") == "user", user).when(F.col("role") == "assistant", assistant).when(F.col("role") == "system", system).otherwise("")
    quote = F.when(F.pmod(F.xxhash64("turn", "conv_id"), F.lit(13)) == 0, F.concat(F.lit("\n> "), user, F.lit("as it was said"))).otherwise("")
    gap = F.when(bare | (later & (style % 2 == 1)), "\n").otherwise("")
    said = F.concat(F.coalesce("text", F.lit("")), quote)
    return conversations.select("conv_id", "turn", "role", said.alias("said"), F.concat(gap, mark, said).alias("line"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """conversations without their roles: conv_id, turn (the number of a row) and text, several turns in one text.

    A turn that is the last of its row goes on in the next one by half of its lines, if a hash says so.
    """
    row = F.coalesce(F.floor(F.col("turn") / TURNS_A_ROW), F.lit(-1)).cast("long")
    lines = F.split("line", "\n", -1)
    spans = (F.pmod(F.col("turn"), F.lit(TURNS_A_ROW)) == TURNS_A_ROW - 1) & (F.pmod(F.xxhash64("said"), F.lit(2)) == 0) & (F.size("lines") > 3)
    half = F.floor(F.size("lines") / 2).cast("int")
    piece = lambda k, at, text: F.struct((row + k).alias("row"), (F.col("turn") * 2 + k).alias("at"), text.alias("text"))
    cut = F.array(piece(0, 0, F.array_join(F.slice("lines", F.lit(1), half), "\n")), piece(1, 0, F.array_join(F.slice("lines", half + 1, F.size("lines")), "\n")))
    pieces = (
        marked_turns(conversations).withColumn("lines", lines)
        .select("conv_id", F.explode(F.when(spans, cut).otherwise(F.array(piece(0, 0, F.col("line"))))).alias("p")).select("conv_id", "p.*")
    )
    many = pieces.groupBy("conv_id", "row").agg(F.count("*").alias("n")).where(F.col("n") > MOST_PIECES).select(F.col("conv_id").alias("c"), F.col("row").alias("r"))
    each = pieces.join(many, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("row") == F.col("r")), "left")
    together, alone = each.where("r is null"), each.where("r is not null")
    joined = together.groupBy("conv_id", "row").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"))
    return joined.select("conv_id", F.col("row").alias("turn"), F.array_join(F.transform("x", lambda p: p["text"]), "\n").alias("text")).unionByName(
        alone.select("conv_id", F.col("row").alias("turn"), "text")
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import chat

    return chat.format_turns(transcripts(table(spark, sf_dir, "conversations")))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import media

    return media.store_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import simhash

    return simhash.group(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm import packing

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import sharding

    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import html

    return html.extract(table(spark, sf_dir, "pages"), ("page_id", "url"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import pii

    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda x: x["ord"] < 4)
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS[:4]],
        F.sha2(pii.spans_text(base), 256).alias("base_sha256"), pii.spans_text(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda x: F.format_string("%.2f", x["score"])), ",").alias("scores"),
    )


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm import pieces

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, network).select(
        "doc_id", F.coalesce(quality.held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= quality.BAR).cast("int").alias("predicted"),
    )


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm import align

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm import bpe

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import trie

    return trie.build(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_chat": op2_chat,
    "op3_media": op3_media,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_html": op7_html,
    "op8_pii": op8_pii,
    "op9_pieces": op9_pieces,
    "op10_quality": op10_quality,
    "op11_align": op11_align,
    "op12_lexicon": op12_lexicon,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
}
