"""Translations: memory, learning, glossary, replies, deterministic repairs.

Tables are immutable, so an upsert is a new table made of the old one and what comes in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.functions.text import ascii_lower, glossary_candidate, strip
from foliograph.functions.values import memory_key

SCOPE = ("source_language", "target_language", "policy_fingerprint")


def distinct_texts(blocks: DataFrame, text: str = "source_text") -> DataFrame:
    return blocks.select(strip(F.col(text)).alias("source_text")).where("source_text <> ''").distinct()


def memory_lookup(blocks: DataFrame, memory: DataFrame, source_language: str, target_language: str, policy: str, text: str = "source_text") -> DataFrame:
    """``blocks`` with ``memory_target``: the exact translation of its stripped text under the same languages and
    policy, null without one. The three equalities go down to the memory's scan."""
    scope = memory.where((F.col("source_language") == source_language) & (F.col("target_language") == target_language) & (F.col("policy_fingerprint") == policy))
    known = scope.where(strip(F.col("target_text")) != "").select(F.col("source_text").alias("_text"), F.col("target_text").alias("memory_target"))
    return blocks.join(known, strip(F.col(text)) == F.col("_text"), "left").drop("_text")


def memory_misses(looked_up: DataFrame) -> DataFrame:
    return looked_up.where("memory_target is null").drop("memory_target")


def valid_pairs(pairs: DataFrame) -> DataFrame:
    """Stripped pairs, neither side empty, and not the same."""
    p = pairs.withColumns({"source_text": strip(F.col("source_text")), "target_text": strip(F.col("target_text"))})
    return p.where("source_text <> '' and target_text <> '' and source_text <> target_text")


def pair_occurrences(pairs: DataFrame, keys: tuple[str, ...] = (), order: str = "ord") -> DataFrame:
    return valid_pairs(pairs).groupBy(*keys, "source_text", "target_text").agg(F.count("*").alias("occurrences"), F.min(order).alias("ord"))


def settled_pairs(counted: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One target for each source: that of the pair first seen last; its occurrences are all of the source's."""
    return counted.groupBy(*keys, "source_text").agg(F.max_by("target_text", "ord").alias("target_text"), F.sum("occurrences").alias("occurrences"))


def memory_changes(memory: DataFrame, pairs: DataFrame, source_language: str, target_language: str, policy: str, model: str, job: Column) -> DataFrame:
    """The memory's rows that a job's settled pairs make or change: targets replaced, occurrences added."""
    new = pairs.select(
        memory_key(F.lit(source_language), F.lit(target_language), F.lit(policy), F.col("source_text")).alias("source_hash"), "source_text", "target_text",
        F.lit(source_language).alias("source_language"), F.lit(target_language).alias("target_language"), F.lit(policy).alias("policy_fingerprint"),
        F.lit(model).alias("model"), F.col("occurrences").cast("long").alias("occurrences"), job.alias("last_job_id"),
    )
    a, b = memory.alias("a"), new.alias("b")
    joined = b.join(a, F.col("a.source_hash") == F.col("b.source_hash"), "left")
    newest = ["source_hash", "source_text", "target_text", *SCOPE, "model", "last_job_id"]
    return joined.select(*(F.col(f"b.{c}").alias(c) for c in newest), (F.coalesce("a.occurrences", F.lit(0)) + F.col("b.occurrences")).cast("long").alias("occurrences"))


def memory_upsert(memory: DataFrame, pairs: DataFrame, source_language: str, target_language: str, policy: str, model: str, job: Column) -> DataFrame:
    """The whole memory after a job's settled pairs: the rows that they do not touch, and ``memory_changes``."""
    changed = memory_changes(memory, pairs, source_language, target_language, policy, model, job)
    return memory.join(changed.select("source_hash"), "source_hash", "left_anti").select(*changed.columns).unionByName(changed)


def bucket_of(source_hash: Column, buckets: int) -> Column:
    """The bucket that a memory row is kept in."""
    return F.pmod(F.xxhash64(source_hash), F.lit(buckets)).cast("int")


def memory_store(path: str, pairs: DataFrame, buckets: int, *how) -> None:
    """Brings a job's settled pairs into the memory at a path that is partitioned by ``bucket``: only the buckets that they
    fall into are read and written, so a job costs what it brings and not what is there."""
    from foliograph.sources.sinks import write_partitions

    spark = pairs.sparkSession
    memory = spark.read.parquet(path)
    touched = [r[0] for r in pairs.select(bucket_of(memory_key(F.lit(how[0]), F.lit(how[1]), F.lit(how[2]), F.col("source_text")), buckets)).distinct().collect()]
    own = memory.where(F.col("bucket").isin(touched)).drop("bucket") if touched else memory.limit(0).drop("bucket")
    after = memory_upsert(own, pairs, *how)
    # What is read is what is replaced: the new rows are made before any is written.
    write_partitions(after.withColumn("bucket", bucket_of(F.col("source_hash"), buckets)).checkpoint(), path, "bucket")


def glossary_candidates(counted: DataFrame, mode: str = "review") -> DataFrame:
    """What a job proposes: nothing if learning is off; approved at once in mode ``auto``."""
    found = counted.where(glossary_candidate(F.col("source_text"), F.col("occurrences")) & F.lit(mode != "off"))
    return found.withColumns({"confidence": F.when(F.col("occurrences") >= 2, 0.92).otherwise(0.82), "status": F.lit("approved" if mode == "auto" else "pending")})


def candidate_upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("job_id", "source_text")) -> DataFrame:
    """New rows replace old ones of their key, occurrences too."""
    return old.join(new, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def glossary_upsert(old: DataFrame, new: DataFrame, order: str = "ord", default_category: str = "general") -> DataFrame:
    """The glossary after terms came in: one row for each source up to ASCII case. A known term keeps its id, source
    spelling and created_at; of several incoming ones the last counts."""
    fold = lambda c: ascii_lower(c)
    category = F.when(F.trim(F.coalesce("category", F.lit(""))) == "", default_category).otherwise(F.trim("category"))
    fresh = new.withColumns({"_key": fold(F.col("source_text")), "category": category})
    values = ["target_text", "category", "updated_at"]
    last = fresh.groupBy("_key").agg(F.max(F.struct(order, *values)).alias("n"), F.min(F.struct(order, "id", "source_text", "updated_at")).alias("f"))
    old = old.withColumn("_key", fold(F.col("source_text")))
    both = old.join(last, "_key", "full_outer")
    return both.select(
        F.coalesce("id", "f.id").alias("id"),
        F.when(F.col("id").isNull(), F.col("f.source_text")).otherwise(F.col("source_text")).alias("source_text"),
        *(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in values),
        F.coalesce("created_at", "f.updated_at").alias("created_at"),
    )


def glossary_delete(glossary: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the named terms. Snapshots taken before stay as they are."""
    return glossary.join(ids, "id", "left_anti")


def unknown_ids(glossary: DataFrame, ids: DataFrame) -> DataFrame:
    """Named ids that the glossary lacks: a deletion of these is an error."""
    return ids.join(glossary, "id", "left_anti")


def glossary_snapshot(jobs: DataFrame, glossary: DataFrame) -> DataFrame:
    """Every term frozen into every new job, longest source first. The result is all pairs of the two by definition; terms
    are ranked once, before, and the planner chooses by size how to pair a list that people keep with the new jobs."""
    terms = glossary.select("source_text", "target_text", "category").dropDuplicates(["source_text"])
    terms = terms.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.length("source_text")), "source_text")))
    return jobs.select("job_id").distinct().crossJoin(terms)


def override(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Two maps of key to value: the second's value where it has one."""
    a, b = first.select(key, F.col(value).alias("_a")), second.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("_b", "_a").alias(value))


def dictionary_repair(rows: DataFrame, phrases: DataFrame, words: DataFrame, flagged: Column) -> DataFrame:
    """Flagged rows whose translation is the source up to case take the dictionary's entry, phrases before words.
    Dictionaries: key (lower case), value."""
    p, w = phrases.select(F.col("key").alias("_pk"), F.col("value").alias("_pv")), words.select(F.col("key").alias("_wk"), F.col("value").alias("_wv"))
    source = F.lower(strip(F.col("source_text")))
    todo = flagged & (F.lower(strip(F.col("target_text"))) == source)
    joined = rows.join(p, source == F.col("_pk"), "left").join(w, source == F.col("_wk"), "left")
    return joined.withColumn("target_text", F.when(todo, F.coalesce("_pv", "_wv", "target_text")).otherwise(F.col("target_text"))).drop("_pk", "_pv", "_wk", "_wv")


def table_term_repair(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Common table terms get their one translation, by exact match, then by case-blind match."""
    exact = terms.select(F.col("key").alias("_ek"), F.col("value").alias("_ev"))
    loose = terms.groupBy(F.lower("key").alias("_lk")).agg(F.min("value").alias("_lv"))
    source = strip(F.col("source_text"))
    joined = rows.join(exact, source == F.col("_ek"), "left").join(loose, F.lower(source) == F.col("_lk"), "left")
    value = F.coalesce("_ev", "_lv")
    return joined.withColumns({"repaired": F.coalesce(value != F.col("target_text"), F.lit(False)), "target_text": F.coalesce(value, "target_text")}).drop("_ek", "_ev", "_lk", "_lv")


def resolve_reply(expected: DataFrame, reply: DataFrame, batch: list[str]) -> DataFrame:
    """A model's reply (position, id, text) against the blocks it was asked for (position, id, source_text), for each
    batch: ``status`` ok, positional, duplicate, unknown or missing, and the targets of good ones. Blank texts keep the
    source. Only an id that was asked for can come twice: others are unknown, however often they come. If ids are missing but
    as many items came back as were asked for, they are taken by position."""
    known = reply.join(expected.select(*batch, "id").distinct(), [*batch, "id"], "left_semi")
    dup = known.groupBy(*batch, "id").count().where("count > 1").select(*batch).distinct().withColumn("_dup", F.lit(True))
    counts = expected.groupBy(*batch).agg(F.count("*").alias("_asked")).join(reply.groupBy(*batch).agg(F.count("*").alias("_got")), batch, "left")
    hits = expected.join(reply, [*batch, "id"], "left_semi").groupBy(*batch).agg(F.count("*").alias("_hits"))
    state = counts.join(hits, batch, "left").join(dup, batch, "left").fillna(0, ["_got", "_hits"])
    status = (
        F.when(F.col("_dup"), "duplicate")
        .when((F.col("_hits") == F.col("_asked")) & (F.col("_got") == F.col("_asked")), "ok")
        .when((F.col("_hits") == F.col("_asked")) & (F.col("_got") > F.col("_asked")), "unknown")
        .when(F.col("_got") == F.col("_asked"), "positional")
        .when(F.col("_got") > F.col("_hits"), "unknown")
        .otherwise("missing")
    )
    state = state.select(*batch, status.alias("status"))
    by_id = reply.select(*batch, F.col("id").alias("_rid"), F.col("text").alias("_by_id"))
    by_place = reply.select(*batch, F.col("position").alias("_rpos"), F.col("text").alias("_by_place"))
    e = expected.join(state, batch)
    on = lambda other, c, mine: [F.col(f"e.{b}") == F.col(f"{other}.{b}") for b in batch] + [F.col(f"e.{mine}") == F.col(f"{other}.{c}")]
    joined = e.alias("e").join(by_id.alias("i"), on("i", "_rid", "id"), "left").join(by_place.alias("p"), on("p", "_rpos", "position"), "left")
    text = F.when(F.col("e.status") == "ok", F.col("i._by_id")).when(F.col("e.status") == "positional", F.col("p._by_place"))
    target = F.when(F.col("e.status").isin("ok", "positional"), F.coalesce(F.nullif(strip(text), F.lit("")), F.col("e.source_text")))
    return joined.select(*(F.col(f"e.{c}") for c in e.columns), target.alias("target_text")).dropDuplicates([*batch, "id"])


def missing_translations(blocks: DataFrame, translations: DataFrame, keys: tuple[str, ...] = ("doc_id", "id")) -> DataFrame:
    """Translatable blocks without a translation that says anything."""
    said = translations.where(strip(F.col("target_text")) != "")
    return blocks.where("preserve_reason is null and fragment_confidence >= 0.55").join(said, list(keys), "left_anti")


def payload(blocks: DataFrame, batch: list[str]) -> DataFrame:
    """The request of each batch: a JSON array of id and text in reading order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "id", F.col("source_text").alias("text")))), lambda r: F.struct(r["id"].alias("id"), r["text"].alias("text")))
    return blocks.groupBy(*batch).agg(F.to_json(items).alias("payload"))


def parse_reply(replies: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Rows (position, id, text) of a reply's translations array."""
    from foliograph.functions.text import json_body

    parsed = F.from_json(json_body(F.col(column)), "struct<translations:array<struct<id:string,text:string>>>")
    return replies.select(*keep, F.posexplode(parsed["translations"]).alias("position", "_t")).select(*keep, "position", "_t.id", "_t.text")
