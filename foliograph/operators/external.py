"""Work that an outside model or service does, behind functions that are passed in.

A translator takes [{id, text}] and gives ({id: text}, usage). It runs inside ``mapInPandas``, once a batch, with retries
inside, so that Spark's own retries do not call a service twice for one answer. ``repartition`` first to bound how many
run at once. Tests pass a dictionary."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions.geometry import Box, from_thousandths, line_font_size, valid_thousandths
from foliograph.functions.text import kept_name_tokens, name_in_language, name_or_original, newline_count, strip
from foliograph.operators.blocks import capacity

Items = list[dict]
Translator = Callable[[Items], tuple[dict[str, str], dict[str, int]]]
#: Answers worth another try.
RETRY_CODES = frozenset((408, 429, 500, 502, 503, 504))
MOST_READ = 24


class Busy(Exception):
    """A call that may work later; ``code`` is the service's answer, None for a broken connection."""

    def __init__(self, code: int | None = None):
        super().__init__(f"service answered {code}")
        self.code = code


def with_retries(call: Callable, retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> Callable:
    def run(*args):
        for attempt in range(retries + 1):
            try:
                return call(*args)
            except Busy as e:
                if attempt == retries or (e.code is not None and e.code not in RETRY_CODES):
                    raise
                sleep(min(4.0, 0.5 * 2**attempt))

    return run


def translate_halving(translate: Translator, items: Items) -> tuple[dict[str, str], dict[str, int], int]:
    """A batch, or its halves where it fails, down to one block; the number of calls made."""
    try:
        texts, usage = translate(items)
        return texts, usage, 1
    except Exception:
        if len(items) <= 1:
            raise
    half = max(1, len(items) // 2)
    a, b = translate_halving(translate, items[:half]), translate_halving(translate, items[half:])
    return a[0] | b[0], {k: a[1].get(k, 0) + b[1].get(k, 0) for k in a[1] | b[1]}, a[2] + b[2] + 1


def dictionary_translator(words: dict[str, str]) -> Translator:
    def translate(items: Items) -> tuple[dict[str, str], dict[str, int]]:
        out = {i["id"]: words.get(i["text"], i["text"]) for i in items}
        return out, {"input_tokens": sum(len(i["text"]) for i in items), "output_tokens": sum(map(len, out.values()))}

    return translate


def translate_batches(blocks: DataFrame, batch: list[str], translate: Translator, done: DataFrame | None = None) -> DataFrame:
    """Rows (batch keys, id, target_text, calls) for blocks with their batch; those that ``done`` (batch keys, id,
    target_text) has already are taken from there and not sent."""
    todo = blocks if done is None else blocks.join(done, [*batch, "id"], "left_anti")
    requests = todo.groupBy(*batch).agg(F.array_sort(F.collect_list(F.struct("reading_order", "id", F.col("source_text").alias("text")))).alias("items"))
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    ddl = ", ".join(f"{b} {kinds[b]}" for b in batch) + ", id string, target_text string, calls int"
    call = with_retries(translate)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                items = [{"id": str(i["id"]), "text": i["text"]} for i in r.items]
                texts, _, calls = translate_halving(call, items)
                out += [(*(getattr(r, b) for b in batch), i["id"], (texts.get(i["id"]) or "").strip() or i["text"], calls) for i in items]
            yield pd.DataFrame(out, columns=[*batch, "id", "target_text", "calls"])

    fresh = requests.mapInPandas(run, ddl)
    return fresh if done is None else fresh.unionByName(done.select(*batch, F.col("id").cast("string").alias("id"), "target_text", F.lit(0).alias("calls")))


def retranslate(blocks: DataFrame, flagged: DataFrame, translate: Translator, batch: tuple[str, ...] = ("doc_id", "page_index")) -> DataFrame:
    """Fresh translations (batch keys, id, target_text, calls) of the blocks that are flagged (doc_id, id), and of no others."""
    return translate_batches(blocks.join(flagged.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi"), list(batch), translate)


def shorten(blocks: DataFrame, translate: Translator, batch: tuple[str, ...] = ("doc_id", "page_index")) -> DataFrame:
    """Shorter translations of blocks (with their ``target_text``) that overflow their box. The translator's text is JSON: the
    source, the current translation and how many characters the box holds; without an answer the current one stays."""
    asked = F.to_json(F.struct(F.col("source_text").alias("source"), F.col("target_text").alias("current"), capacity(Box.flat(), F.col("region_type")).alias("most_characters")))
    rows = blocks.withColumns({"source_text": asked, "_current": F.col("target_text")})
    said = translate_batches(rows, list(batch), translate).withColumnRenamed("target_text", "_said")
    kept = F.when(F.col("_said") == F.col("source_text"), F.col("_current")).otherwise(F.col("_said"))
    return rows.join(said, [*batch, "id"]).select(*batch, "id", kept.alias("target_text"))


def passthrough(blocks: DataFrame) -> DataFrame:
    """Blocks that are not translated keep their text."""
    return blocks.where("preserve_reason is not null or fragment_confidence < 0.55").select("doc_id", "id", F.col("source_text").alias("target_text"))


def seen_blocks(items: DataFrame, regions: DataFrame, ident: str = "v%04d", most: int = MOST_READ) -> DataFrame:
    """Blocks from what a model read in image regions (doc_id, region_id, position, source_text, target_text, bbox: array of
    thousandths): boxes that can't be are skipped, and a region with more than ``most`` items is left out whole.
    See ``unreadable_regions`` for those of which nothing is left."""
    of = ["doc_id", "region_id"]
    few = items.groupBy(*of).count().where(F.col("count") <= most).select(*of)
    said = items.withColumns({"_b": _place(), "_said": _says()}).where("_b is not null and _said")
    r = regions.select("doc_id", F.col("id").alias("region_id"), "page_index", *Box.flat().named("r_"))
    page = from_thousandths(Box.of("_b"), Box.flat("r_"))
    placed = said.join(few, of, "left_semi").join(r, of).select("doc_id", "region_id", "page_index", "position", "source_text", "target_text", *page.named())
    size = line_font_size(F.col("bottom") - F.col("top"), newline_count(strip(F.col("source_text"))), 0.78, 5.0, 18.0)
    return placed.withColumns({"id": F.format_string("%s-" + ident, F.col("region_id"), F.col("position") + 1), "font_size": size, "source_type": F.lit("vision")})


def _place() -> Column:
    at = lambda i: F.try_element_at("bbox", F.lit(i + 1))
    return F.when(F.size("bbox") == 4, valid_thousandths(Box(at(0), at(1), at(2), at(3))))


def _says() -> Column:
    said = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    return said("source_text") & said("target_text")


def unreadable_regions(items: DataFrame, most: int = MOST_READ) -> DataFrame:
    """Regions of which every item is unusable: an error of the model, not a region without text."""
    usable = F.coalesce(_place().isNotNull() & _says(), F.lit(False))
    counted = items.groupBy("doc_id", "region_id").agg(F.count("*").alias("items"), F.count_if(usable).alias("_usable"))
    return counted.where((F.col("items") <= most) & (F.col("_usable") == 0)).drop("_usable")


def residual_blocks(residuals: DataFrame, regions: DataFrame, attempt: int) -> DataFrame:
    """Repair blocks for untranslated text that a review found, numbered by the attempt."""
    return seen_blocks(residuals, regions, f"q{attempt:02d}-v%04d", most=1 << 30)


def usage(payload: Column) -> Column:
    """Token counts of a reply's JSON under either name; the total is the sum where it isn't given. Counts that aren't
    whole numbers from 0 on count as missing."""
    number = lambda *names: F.coalesce(*(F.get_json_object(payload, f"$.usage.{n}") for n in names))
    whole = lambda c: F.when(c.rlike("^[0-9]{1,18}$"), c.cast("long"))
    i, o, t = whole(number("prompt_tokens", "input_tokens")), whole(number("completion_tokens", "output_tokens")), whole(number("total_tokens"))
    zero = F.lit(0).cast("long")
    return F.struct(
        F.coalesce(i, zero).alias("input_tokens"), F.coalesce(o, zero).alias("output_tokens"),
        F.coalesce(t, F.coalesce(i, zero) + F.coalesce(o, zero)).alias("total_tokens"),
        (i.isNotNull() | o.isNotNull() | t.isNotNull()).alias("token_usage_available"),
    )


def content(message: Column) -> Column:
    """A message's stripped text from its JSON: a string, or the parts of type text or output_text of an array. Null where
    it says nothing, which is an error of the service."""
    parts = F.from_json(message, "array<struct<type:string,text:string>>")
    said = F.filter(parts, lambda p: p["type"].isin("text", "output_text"))
    texts = F.array_join(F.transform(said, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    plain = F.from_json(F.concat(F.lit('{"v":'), message, F.lit("}")), "v string")["v"]
    return F.nullif(strip(F.when(F.ltrim(message).startswith("["), texts).when(F.ltrim(message).startswith('"'), plain)), F.lit(""))


def translate_names(jobs: DataFrame, dictionary: DataFrame, translate: Translator, simplified: str) -> DataFrame:
    """job_id and stem of each job's result (job_id, stem, target_language, protected_terms: array): the dictionary's
    (target_language, key, value), itself if it is in the language already, else the translator's, with the original's
    numbers, codes and terms that it lost, unless it came out in another language. Only the last kind is sent."""
    known = dictionary.select("target_language", F.col("key").alias("_key"), F.col("value").alias("_known"))
    asked = jobs.join(known, (jobs["target_language"] == known["target_language"]) & (strip(F.col("stem")) == F.col("_key")), "left").drop(known["target_language"]).drop("_key")
    settled = F.coalesce("_known", F.when(F.coalesce(name_in_language(F.col("stem"), F.col("target_language"), simplified), F.lit(False)), F.col("stem")))
    asked = asked.withColumn("_settled", settled).drop("_known")
    call = with_retries(translate)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            said = [call([{"id": str(i), "text": t}])[0].get(str(i), "").strip() for i, t in zip(part["job_id"], part["stem"], strict=True)]
            if not all(said):
                raise ValueError("the model gave an empty file name")
            yield pd.DataFrame({"_id": part["job_id"], "_said": said})

    sent = asked.where("_settled is null").select("job_id", "stem").mapInPandas(run, f"_id {jobs.schema['job_id'].dataType.simpleString()}, _said string")
    made = name_or_original(F.col("stem"), kept_name_tokens(F.col("stem"), F.col("_said"), F.col("protected_terms")), F.col("target_language"))
    joined = asked.join(sent, F.col("job_id") == F.col("_id"), "left")
    return joined.select("job_id", F.coalesce("_settled", made).alias("stem"))
