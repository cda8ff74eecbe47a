"""Mixing sources to target weights by a time-varying curriculum.

Everything here is DataFrame functions; no Python runs on the executors.

1. *Targets.* Sources in code-point order (null last) weigh ``weights`` in turn and share
   ``share`` of all words. No target exceeds ``most_epochs`` times its source's words; what is
   over goes to the others by weight. Sources are sorted by words a weight: those that are full
   come first, so running sums give the level at which the rest is shared out, in one pass.
2. *Schedule.* While training runs from 0 to 1, source s demands words at the rate
   ``target * (1 + tilt * (2t - 1))``; its integral is the cumulative demand, whose inverse says
   at what time a word of the source is due. All sources' demand up to then is its position.
3. *Order within a source.* By md5 of doc_id (where it is null, of the text's hash), over again for
   each epoch. The running sum is made in two levels, over slices of a source and within each slice,
   so that a source with a third of all rows is spread over ``SLICES`` groups. Sums over the sources
   are made in two levels, too (``running``): there may be as many sources as hosts.

The document that crosses the target is taken up to the word that meets it. A null or empty text
has size 0 and is never taken. Rows that share a doc_id are rows of their own, in the order of their
texts' hashes, so reruns agree. An empty table gives an empty mix. Extra columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph.llm.common import BLANK_CLASS, words_of, written

#: Leading hexadecimal digits of the md5 that name a slice, and the number of slices.
SLICE_DIGITS, SLICES = 3, 16**3
WEIGHTS, TILTS = (3, 1, 2), (-0.5, 0.0, 0.5)
COPIES = 2


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def running(rows: DataFrame, order: list[str], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with, under each name, the sum of its column over all rows before in the order. Rows are range-sorted into
    partitions, summed within each, and offset by the partitions before: a table of as many rows as there are partitions."""
    ranged = written(rows.withColumns({f"_v_{k}": v for k, v in sums.items()}).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(f"_v_{k}") for k in sums))
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_v_{k}").over(ahead), F.lit(0)).alias(f"_o_{k}") for k in sums))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = ranged.join(parts, "_part")
    return both.withColumns({k: F.col(f"_o_{k}") + F.coalesce(F.sum(f"_v_{k}").over(within), F.lit(0)) for k in sums}).drop("_part", *(f"_{x}_{k}" for k in sums for x in "vo"))


def _keyed(docs: DataFrame, source: str, doc_id: str) -> DataFrame:
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.col("_hash").cast("string")))
    return docs.withColumns({"_src": F.coalesce(F.col(source), F.lit("")), "_null": F.col(source).isNull(), "_md5": digest, "_slice": F.substring(digest, 1, SLICE_DIGITS)})


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS) -> DataFrame:
    """A row for each source (``_src``, ``_null``): source_size, weight, tilt, target."""
    per = sizes.groupBy("_src", "_null").agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("source_size"))
    per = running(per, ["_null", "_src"], {"_rank": F.lit(1)}, "sources")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("_rank") % len(values)).cast("int"))
    room = COPIES * F.col("source_size")
    per = per.withColumns({"weight": pick(weights), "tilt": pick(tilts)}).withColumn("_fill", room / F.col("weight"))
    per = written(running(per, ["_fill", "_null", "_src"], {"_full": room, "_spent": F.col("weight")}, "sources"), "sources")
    whole = per.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    level = (F.lit(share) * F.lit(whole.words or 0) - F.col("_full")) / (F.lit(whole.weight or 0) - F.col("_spent"))
    # Full sources are a prefix of this order; the first that isn't full sets the level.
    rest = per.withColumn("_level", level).where("_level <= _fill").agg(F.min(F.struct("_fill", "_null", "_src", "_level")).alias("r")).first().r
    goal = F.least(room.cast("double"), F.coalesce(F.lit(rest._level if rest else None).cast("double") * F.col("weight"), room.cast("double")))
    return per.select("_src", "_null", "source_size", "weight", "tilt", goal.alias("target"))


def _time(words: Column) -> Column:
    """When the source's cumulative demand reaches ``words``, from 0 to 1."""
    q, s = words / F.col("target"), F.col("tilt")
    return F.when(s == 0, q).otherwise((s - 1 + F.sqrt((1 - s) * (1 - s) + 4 * s * q)) / (2 * s))


def _position(words: Column) -> Column:
    t = _time(words)
    return F.floor(F.col("_demand") * t + F.col("_tilted") * (t * t - t))


def assign(docs: DataFrame, sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` (with its ``_size``) and, for each row: source_size, target, first and second (words
    that the mix takes in either epoch), position_1 and position_2 (words of training before it,
    null if not taken), and _total (words of training in all). ``sizes`` is a narrow copy of the same rows, for the sums; both have the text's ``_hash``."""
    keyed = _keyed(sizes.select(doc_id, source, "_size", "_hash"), source, doc_id)
    per = targets(keyed, share, weights, tilts)
    whole = per.agg(F.sum("target").alias("demand"), F.sum(F.col("target") * F.col("tilt")).alias("tilted")).first()
    per = per.withColumns({"_demand": F.lit(whole.demand).cast("double"), "_tilted": F.lit(whole.tilted).cast("double")})
    slices = keyed.groupBy("_src", "_null", "_slice").agg(F.sum("_size").alias("_sum"))
    ahead = Window.partitionBy("_src", "_null").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_base", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum").join(per, ["_src", "_null"])
    within = Window.partitionBy("_src", "_null", "_slice").orderBy("_md5", doc_id, "_size", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    df = _keyed(docs, source, doc_id).join(slices, ["_src", "_null", "_slice"])
    start = F.col("_base") + F.coalesce(F.sum("_size").over(within), F.lit(0))
    df = df.withColumns({"_start": start, "_quota": F.floor("target")})
    again = F.col("_start") + F.col("source_size")
    took = lambda at: F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_quota") - at)).cast("long")
    df = df.withColumns({"first": took(F.col("_start")), "second": took(again)})
    df = df.withColumns({"position_1": F.when(F.col("first") > 0, _position(F.col("_start"))), "position_2": F.when(F.col("second") > 0, _position(again))})
    return df.drop("_src", "_null", "_slice", "_md5", "_hash", "_base", "_start", "_quota", "weight", "tilt", "_tilted").withColumnRenamed("_demand", "_total")


def plan(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The mix of a table, a row for each document, range-sorted by training position:
    doc_id, size, source_size, target, taken, position (of its first copy; null if not taken)."""
    sizes = written(docs.select("doc_id", "source", size_of(F.col(text)).alias("_size"), F.xxhash64(text).alias("_hash")), "sizes")
    df = assign(sizes, sizes, **how)
    out = df.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("first") + F.col("second")).alias("taken"), F.col("position_1").alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The training documents themselves: the columns of ``docs``, a row for each copy taken, sorted by
    position. A document that crosses its source's target is cut after its last word taken."""
    sized = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"], docs["source"], size_of(docs[text]).alias("_size"), F.xxhash64(docs[text]).alias("_hash"))
    sizes = written(sized.select("doc_id", "source", "_size", "_hash"), "sizes")
    df = assign(sized, sizes, **how)
    copies = F.filter(F.array(F.struct(F.col("first").alias("n"), F.col("position_1").alias("at")), F.struct(F.col("second").alias("n"), F.col("position_2").alias("at"))), lambda c: c["n"] > 0)
    df = df.select("_row", "doc_id", "_size", "_total", F.explode(copies).alias("_copy"))
    cut = F.array_join(F.slice(words_of(F.col("_row")[text]), 1, F.col("_copy.n").cast("int")), " ")
    whole = F.when(F.col("_copy.n") == F.col("_size"), F.col("_row")[text]).otherwise(cut)
    # Positions are words of training, so equal shares of them are partitions of equal size: no pass over the texts to
    # sample them, and each text moves once more.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.lit(parts - 1), F.floor(F.col("_copy.at") / F.col("_total") * parts)).cast("int")
    ordered = df.repartitionById(parts, part).sortWithinPartitions("_copy.at", "doc_id")
    return ordered.select(*[(whole if c == text else F.col("_row")[c]).alias(c) for c in docs.columns])
