"""Benchmark decontamination by a positional inverted index (native: DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bitfilter
from .common import Plain, Scratch

#: What stands between words, once A-Z are lower case.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a unit, a stretch of a test item: its places are the bits of a long.
UNIT = 62


def words(text: Column) -> Column:
    """The words of a text, empty for null."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS)
    return F.array_remove(cut, "")


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def units_of(bench: DataFrame, k: int) -> DataFrame:
    """(item, n, terms): each item's words in overlapping stretches of at most UNIT, so that each window of n words lies in one.

    n is ``k``, or the number of words of an item that has fewer; items without words have no windows.
    """
    items = bench.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("_w")).where(F.size("_w") > 0).distinct()
    items = items.withColumn("n", F.least(F.size("_w"), F.lit(k)))
    first = F.sequence(F.lit(0), F.size("_w") - F.col("n"), UNIT - F.col("n") + 1)
    return items.select("item", "n", "_w", F.explode(first).alias("_at")).select("item", "n", F.slice("_w", F.col("_at") + 1, UNIT).alias("terms"))


def build_index(docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Writes the positional inverted index of ``docs`` (doc_id, text): one pass over the texts, no shuffle.

    A posting is (term, key, pos): word ``pos``, from 0, of the row ``key``. The index holds every word of every row and serves any
    benchmark. It is sharded by documents: each task writes the postings of its rows in the order of their terms. A row without
    term stands for each document: key, doc_id, text_hash, n_words.
    """
    d = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("_w"))
    d = d.select("key", "doc_id", "text_hash", F.size("_w").cast("long").alias("n_words"), F.concat(F.array(F.lit(None).cast("string")), F.col("_w")).alias("_w"))
    d = d.select("key", "doc_id", "text_hash", "n_words", F.posexplode("_w").alias("pos", "term"))
    one = [F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("doc_id", "text_hash", "n_words")]
    return scratch.table(d.select("term", "key", (F.col("pos") - 1).alias("pos"), *one).sortWithinPartitions("term", "key", "pos"), name)


def rarest(units: DataFrame, lists: DataFrame) -> DataFrame:
    """(unit, item, n, terms, windows): ``windows`` has for each window its place in the unit and those of its two rarest terms."""
    places = units.select("unit", F.posexplode("terms").alias("j", "term"))
    count = lists.join(places.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    places = places.join(count, "term", "left").select("unit", F.struct(F.coalesce("c", F.lit(0)).alias("c"), "j").alias("p"), "j")
    places = places.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("j", "p"))).alias("p"))

    def window(i: Column) -> Column:
        order = F.array_sort(F.slice(F.transform("p", lambda x: x["p"]), i + 1, F.col("n")))
        return F.struct(i.alias("i"), F.get(order, F.lit(0))["j"].alias("r1"), F.get(order, F.least(F.lit(1), F.col("n") - 1))["j"].alias("r2"))

    windows = F.transform(F.sequence(F.lit(0), F.size("terms") - F.col("n")), window)
    return units.join(places, "unit").select("unit", "item", "n", "terms", windows.alias("windows"))


def phrase_matches(docs: DataFrame, bench: DataFrame, k: int = 10, slop: int | None = None) -> tuple[DataFrame, DataFrame, Scratch]:
    """The documents (key, doc_id, text_hash, n_words), the matches (key, item, start, n, kind), and the folder of both.

    ``kind`` is ``phrase`` where the n words from word ``start`` on are those of a window of the item. With ``slop``,
    ``proximity`` rows tell where all terms of a window are near without being the phrase: its rarest term at its place,
    each other one within ``slop`` words of its own.

    The posting lists of the two rarest terms of each window, by their number in all documents, are joined with the units by
    term. A posting, less its term's place in the unit, names an alignment of document and unit; the lists are
    intersected by alignment. Where a window's two rarest terms meet, its other terms are looked up in their lists at the
    places that the alignment names. ``k`` is UNIT at most. Null texts have no postings, repeated rows have each their own,
    repeated items count once, a null item_id makes windows without a name. Empty tables give no matches. All
    steps are one plan at any size of the benchmark; Spark broadcasts what is small once written.
    """
    if not 0 < k <= UNIT:
        raise ValueError(f"a window has 1 to {UNIT} words")
    scratch, near = Scratch(docs.sparkSession, "contamination"), slop or 0
    units = scratch.table(units_of(bench, k).withColumn("unit", F.monotonically_increasing_id()), "units")
    index = build_index(docs, scratch, "index")
    documents, lists = index.where("term is null").select("key", "doc_id", "text_hash", "n_words"), index.where("term is not null").select("term", "key", "pos")
    units = scratch.table(rarest(units, lists), "windows")

    asked = units.select("unit", "n", "terms", F.explode(F.array_distinct(F.flatten(F.transform("windows", lambda w: F.array(w["r1"], w["r2"]))))).alias("j"))
    asked = scratch.table(asked.select(F.get("terms", F.col("j")).alias("term"), "unit", "j", F.least("n", F.lit(2)).alias("least")), "asked")
    named = lists.join(asked, "term").select("key", "unit", (F.col("pos") - F.col("j")).alias("a"), bit(F.col("j")).alias("have"), "least")
    met = named.repartition("key", "unit").groupBy("key", "unit", "a").agg(F.bit_or("have").alias("have"), F.max("least").alias("least"))
    around = Window.partitionBy("key", "unit").orderBy("a").rangeBetween(-near, near)
    met = met.withColumn("near", F.bit_or("have").over(around) if near else F.col("have"))
    met = met.where(F.bit_count("near") >= F.col("least")).select("key", "unit", "a", "have", "near")

    def may(w: Column) -> Column:
        return (F.col("have").bitwiseAND(bit(w["r1"])) != 0) & (F.col("near").bitwiseAND(bit(w["r2"])) != 0)

    met = met.join(units, "unit").withColumn("windows", F.filter("windows", may)).where(F.size("windows") > 0)
    met = scratch.table(met.select("key", "unit", "a", "item", "n", "terms", "windows"), "candidates")

    # the places of all terms of these windows, looked up in the lists of their documents
    every = F.array_distinct(F.flatten(F.transform("windows", lambda w: F.sequence(w["i"], w["i"] + F.col("n") - 1))))
    places = met.select("key", "unit", "a", "terms", F.explode(every).alias("j")).withColumn("term", F.get("terms", F.col("j"))).drop("terms")
    places = places.withColumn("d", F.explode(F.sequence(F.lit(-near), F.lit(near)))) if near else places.withColumn("d", F.lit(0))
    places = places.withColumn("pos", F.col("a") + F.col("j") + F.col("d")).where("pos >= 0")
    own = lists.join(met.select("key").distinct(), "key", "left_semi")
    there = places.join(own, ["key", "pos", "term"]).groupBy("key", "unit", "a")
    there = there.agg(F.bit_or(F.when(F.col("d") == 0, bit(F.col("j"))).otherwise(F.lit(0).cast("long"))).alias("exact"), F.bit_or(bit(F.col("j"))).alias("near"))
    both = met.join(there, ["key", "unit", "a"])

    def kind(w: Column) -> Column:
        whole = F.call_function("shiftleft", bit(F.col("n")) - 1, w["i"])
        same = F.col("exact").bitwiseAND(whole) == whole
        close = (F.col("near").bitwiseAND(whole) == whole) & (F.col("exact").bitwiseAND(bit(w["r1"])) != 0)
        return F.struct((F.col("a") + w["i"]).alias("start"), F.when(same, "phrase").when(close & F.lit(slop is not None), "proximity").alias("kind"))

    found = both.select("key", "item", "n", F.explode(F.transform("windows", kind)).alias("w")).select("key", "item", "w.start", "n", "w.kind").where("kind is not null")
    matches = scratch.table(found.distinct(), "matches")
    scratch.free("candidates", "asked", "windows", "units")
    return documents, matches, scratch


def contamination(docs: DataFrame, bench: DataFrame, k: int = 10, slop: int | None = None) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, n_near) for every row of ``docs`` (doc_id, text).

    A word inside any occurrence of a window of any item of ``bench`` (item_id, text) is hit. ``n_near`` counts the proximity
    matches within ``slop`` (0 without). Null and empty texts have no words on either side. Repeated rows give repeated
    results. Null doc_ids are kept, null item_ids make windows that count but have no name. More columns are ignored.
    Empty tables give empty or clean results.
    """
    documents, matches, scratch = phrase_matches(docs.select("doc_id", "text"), bench, k, slop)
    phrase = F.col("kind") == "phrase"
    spans = matches.where(phrase).groupBy("key", "start").agg(F.max("n").alias("n"), F.collect_set("item").alias("_items"))
    per = spans.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "n"))).alias("_spans"), F.array_distinct(F.flatten(F.collect_set("_items"))).alias("_items")
    )
    close = matches.where(~phrase).select("key", "item", "start").groupBy("key").agg(F.count(F.lit(1)).alias("_near"))

    def cover(state: Column, span: Column) -> Column:
        end = span["start"] + span["n"]
        more = F.greatest(end - F.greatest(state["end"], span["start"]), F.lit(0))
        return F.struct((state["hit"] + more).alias("hit"), F.greatest(state["end"], end).alias("end"))

    zero = F.lit(0).cast("int")
    hit = F.aggregate("_spans", F.struct(zero.alias("hit"), zero.alias("end")), cover, lambda s: s["hit"])
    per = per.select("key", hit.cast("long").alias("n_hit"), "_items")
    out = documents.join(per.join(close, "key", "full"), "key", "left").withColumn("_items", F.coalesce("_items", F.array().cast("array<string>")))
    out = out.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("_near", F.lit(0)).alias("n_near"),
    )
    out = scratch.table(out, "judged")
    scratch.free("index", "matches")
    return out


def clean(docs: DataFrame, bench: DataFrame, k: int = 10) -> DataFrame:
    """The rows of ``docs`` without any window of the benchmark, with all their columns.

    Null and empty texts stay, repeated rows share their fate, an empty benchmark lets all rows stay.
    """
    found = contamination(docs, bench, k).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).distinct()
    plain = Plain(docs)
    # only texts whose hash a contaminated one may have are joined, the others stay where they are
    may, clear = bitfilter.parted(plain.df.withColumn("_hash", F.xxhash64(plain["text"])), "_hash", found.select(F.col("_h").alias("_hash")))
    kept = may.join(found, plain["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left_anti")
    return plain.back(clear.unionByName(kept))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, bench).drop("text_hash", "n_near")
