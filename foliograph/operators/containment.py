"""Which texts hold which items (benchmark passages, phrases) letter for letter.

An item's inner words stand whole in any text that holds it (its first and last may be parts of longer ones), so five of
them are its key: those whose hash is the least, the same wherever the item stands. Texts are cut into their grams of five
words inside their row, and only grams that are some item's key leave it, so a frequent gram of the texts is never dealt
out. Items too short for a key are looked for in every text as they are; there are as many comparisons as there are such
items and texts, which is the query's own size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.operators.blocks import let

WORDS = 5
#: Bytes of keys that may be sent to every task; more are joined by shuffle.
MOST_SENT = 32 << 20


def _words(text: Column) -> Column:
    return F.split(text, r"\s+")


def _grams(words: Column) -> Column:
    """Hashes of all runs of WORDS words; the words are made once."""

    def runs(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - WORDS + 1)
        return F.when(F.size(w) >= WORDS, F.transform(at, lambda i: F.xxhash64(F.slice(w, i, WORDS)))).otherwise(F.array().cast("array<bigint>"))

    return let(words, runs)


def contained(texts: DataFrame, items: DataFrame, text: str = "text", text_id: str = "doc_id", item: str = "text", item_id: str = "item_id") -> DataFrame:
    """item_id and doc_id of each item and each text that holds it. Null texts and items hold and are held by nothing."""
    wanted = items.where(F.col(item).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item).alias("_item"), _words(F.col(item)).alias("_w"))
    inner = F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0)))
    keyed = wanted.withColumn("_key", F.array_min(_grams(inner))).drop("_w")
    long, short = keyed.where("_key is not null"), keyed.where("_key is null").drop("_key")
    rows = texts.where(F.col(text).isNotNull()).select(F.col(text_id).alias("doc_id"), F.col(text).alias("_text"))
    keys = long.select("_key").distinct()
    n = keys.count()
    grams = rows.withColumn("_grams", _grams(_words(F.col("_text"))))
    if 16 * n <= MOST_SENT:
        # The keys are counted, so a single row with all of them fits; a text's grams never leave its row.
        known = keys.agg(F.collect_list("_key").alias("_known"))
        hits = grams.join(F.broadcast(known)).withColumn("_grams", F.array_intersect("_grams", "_known")).drop("_known")
    else:
        hits = grams.withColumn("_grams", F.array_distinct("_grams"))
    near = hits.select("doc_id", "_text", F.explode("_grams").alias("_key")).join(long, "_key")
    found = near.where(F.contains("_text", "_item")).select("item_id", "doc_id")
    n_short = short.count()
    if not n_short:
        return found
    return found.unionByName(rows.join(F.broadcast(short) if n_short <= 1000 else short, F.contains("_text", "_item")).select("item_id", "doc_id"))
