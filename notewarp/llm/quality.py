"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Plain, Scratch, by_value, give_back, process_store, small_batches, thrifty
from .textnp import LOWER, Words, slices

by_value(__name__)

#: Bytes of an n-gram, and bits of its bucket.
GRAM, BITS = 5, 18
#: N-grams' worth of raw text that the target's model starts from.
PSEUDO = 1 << 14
#: Labelled rows that the target's model is fitted on at most, those of the least hashes of doc_id.
SAMPLE = 20_000
#: Bins a unit of keys, of mean log ratios and of toxicity that a cut is placed by.
FINE, FINE_MEAN, FINE_TONE = 8, 4096, 64
#: Bits of the bucket of a word, and how many labelled documents of either kind a word is taken to be in besides.
WORD_BITS, PRIOR = 20, 1
#: What is no letter parts words, case aside.
LETTERS = LOWER.copy()
LETTERS[[i for i in range(128) if not chr(i).isalpha()]] = 32
#: Digits count as one character.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[48:58] = 48


def gram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of the bytes of each text, and the text it is of. Shorter texts have none."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = FOLD[data].astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(0x100000001B3) + data[j : j + n] + np.uint64(1)
    h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    each = np.maximum(np.diff(offsets) - GRAM + 1, 0)
    text = np.repeat(np.arange(len(each)), each)
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(offsets[:-1], each)
    return h[at].astype(np.int64), text


def count_both(batches):
    """Rows (kind, bucket, a, b), one set a task. Kind g: n-grams of all texts and of good ones. Kind w: labelled toxic
    and other texts with a word of the bucket; bucket -1 has all texts."""
    process_store("text")
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    toxic, clean, texts = np.zeros(1 << WORD_BITS, np.int64), np.zeros(1 << WORD_BITS, np.int64), np.zeros(2, np.int64)
    for batch in batches:
        good, known, bad = (batch[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "known", "toxic"))
        for a, b, data, offsets in slices(batch["text"]):
            bucket, text = gram_buckets(data, offsets)
            raw += np.bincount(bucket, minlength=len(raw))
            target += np.bincount(bucket[good[a:b][text]], minlength=len(raw))
        some = np.flatnonzero(known)
        for a, b, data, offsets in slices(batch["text"].take(pa.array(some))):
            bucket, text = word_buckets(data, offsets)
            both = np.unique((text << WORD_BITS) + bucket)  # a word counts once a text
            bucket, of = both & ((1 << WORD_BITS) - 1), bad[some[a:b]][both >> WORD_BITS]
            toxic += np.bincount(bucket[of], minlength=len(toxic))
            clean += np.bincount(bucket[~of], minlength=len(clean))
        texts += (known & bad).sum(), (known & ~bad).sum()
    for kind, x, y in (("g", raw, target), ("w", toxic, clean)):
        at = np.flatnonzero(x + y)
        cols = [at, x[at], y[at]] if kind == "g" else [np.append(at, -1), np.append(x[at], texts[0]), np.append(y[at], texts[1])]
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(cols[0]), pa.string()), *map(pa.array, cols)], ["kind", "bucket", "a", "b"])


def left_out(raw: np.ndarray, target: np.ndarray, bucket: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The log ratio of each n-gram under the target's model without the text that the n-gram is of."""
    _, place, times = np.unique((text << BITS) + bucket, return_inverse=True, return_counts=True)
    p_raw = ((raw + 1) / (raw.sum() + len(raw)))[bucket]
    rest = target.sum() - np.bincount(text)[text]
    return np.log((target[bucket] - times[place] + PSEUDO * p_raw) / (rest + PSEUDO)) - np.log(p_raw)


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of each text, and the text it is of."""
    words = Words(LETTERS[data], offsets, False)
    bucket = (words.hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    return bucket, np.repeat(np.arange(len(offsets) - 1), words.count())


def greatest(value: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """The greatest value of the words of each of n texts, 0 at least."""
    out = np.zeros(n)
    np.maximum.at(out, text, value)
    return out


def tone(toxic: np.ndarray, clean: np.ndarray, texts: tuple[int, int]) -> np.ndarray:
    """The log ratio of the rates of toxic and clean texts that have a word, of the numbers that have it and of all."""
    n = sum(texts)
    return np.log(toxic * n / texts[0] + PRIOR) - np.log(clean * n / texts[1] + PRIOR)


class Models:
    """Counts of n-grams (all texts, good ones) and of words that toxic texts have (in toxic texts, in others), and the log ratios of each bucket.

    Words are given by their buckets ``at``; the others have no tone. What is derived is made anew where a copy arrives.
    """

    def __init__(self, raw: np.ndarray, target: np.ndarray, at: np.ndarray, toxic: np.ndarray, clean: np.ndarray, texts: tuple[int, int]):
        self.given = raw, target, at, toxic, clean, texts
        self.raw, self.target, self.texts = raw, target, texts
        self.toxic, self.clean = (np.zeros(1 << WORD_BITS, np.int32) for _ in "ab")
        self.toxic[at], self.clean[at] = toxic, clean
        self.ratio, self.tone = log_ratio(raw, target), None
        if min(texts):
            self.tone = np.zeros(1 << WORD_BITS, np.float32)
            self.tone[at] = tone(toxic, clean, texts)

    def __reduce__(self):
        return Models, self.given


def score(models: Models, text_column: str, good_column: str, toxic_column: str):
    """Scores rows and drops their text.

    Adds the number of n-grams, the sum of their log ratios and the greatest tone of a word; for labelled rows besides
    the same sum and the greatest tone under models that have not seen the text.
    """

    def run(batches):
        process_store("text")
        for batch in batches:
            good, toxic = (batch[c].to_numpy(zero_copy_only=False) for c in (good_column, toxic_column))
            fitted, known, bad = good == True, ~np.equal(toxic, None), toxic == True  # noqa: E712 (null is neither)
            n, own = len(batch), known | ~np.equal(good, None)
            out = {c: np.zeros(n) for c in ("_n", "_sum", "_tone", "_own", "_own_tone")}
            for a, b, data, offsets in slices(batch[text_column]):
                bucket, text = gram_buckets(data, offsets)
                value = models.ratio[bucket]
                out["_n"][a:b] = np.bincount(text, minlength=b - a)
                out["_sum"][a:b] = np.bincount(text, value, b - a)
                some = fitted[a:b][text]
                value[some] = left_out(models.raw, models.target, bucket[some], text[some])
                out["_own"][a:b] = np.bincount(text, value, b - a)
                if models.tone is not None:
                    bucket, text = word_buckets(data, offsets)
                    out["_tone"][a:b] = greatest(models.tone[bucket], text, b - a)
                    seen = known[a:b][text]
                    bucket, text, of = bucket[seen], text[seen], bad[a:b][text[seen]]
                    value = tone(np.maximum(models.toxic[bucket] - of, 0), np.maximum(models.clean[bucket] - ~of, 0), models.texts)
                    out["_own_tone"][a:b] = greatest(value, text, b - a)
            cols = [pa.array(x, mask=~own) if "own" in c else pa.array(x) for c, x in out.items()]
            kept = [c for c in batch.schema.names if c != text_column]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *cols], [*kept, *out])

    return run


def judged(labels: DataFrame) -> DataFrame:
    """(_id, _good, _toxic) of labelled documents, at most SAMPLE of each kind.

    Good are those of quality 1 that are not toxic; those toxic only are neither good nor bad (null), those with labels
    of both qualities are left out.
    """
    quality, toxic = F.col("quality"), F.coalesce(F.col("toxic") == 1, F.lit(False))
    each = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id"))
    each = each.agg(F.bool_or(quality == 1).alias("one"), F.bool_or(quality == 0).alias("zero"), F.bool_or(toxic).alias("_toxic"))
    good = F.when(F.col("zero") & ~F.col("one"), False).when(F.col("one") & ~F.col("zero") & ~F.col("_toxic"), True)
    each = each.select("_id", good.alias("_good"), "_toxic").where("_good is not null or _toxic")
    kinds = ("_good", "not _good and not _toxic", "_toxic")
    some = [each.where(k).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE) for k in kinds]
    return some[0].unionAll(some[1]).unionAll(some[2])


def labelled(docs: DataFrame, sample: DataFrame) -> Plain:
    """``docs`` with the labels of ``sample`` (at most 3 * SAMPLE rows) as ``_good`` and ``_toxic``, null where there are none."""
    plain = Plain(docs)
    return Plain(plain.df.join(F.broadcast(sample), plain["doc_id"] == F.col("_id"), "left").select(*[F.col(c).alias(n) for c, n in zip(plain.columns, plain.names)], "_good", "_toxic"))


def fit(docs: DataFrame, sample: DataFrame) -> Models:
    """The models of all texts and of the labelled ones in ``sample``, in one pass over the texts.

    The target's model of n-grams starts from the raw one with PSEUDO pseudo-counts, so a bucket that good texts lack
    weighs the less the more of them there are, and weighs 0 without any.
    """
    rows = labelled(docs.select("doc_id", "text"), sample)
    flags = F.coalesce(rows["_good"], F.lit(False)).alias("good"), rows["_toxic"].isNotNull().alias("known"), F.coalesce(rows["_toxic"], F.lit(False)).alias("toxic")
    counts = rows.df.select(rows["text"].alias("text"), *flags).mapInArrow(thrifty(count_both), "kind string, bucket long, a long, b long")
    counts = counts.groupBy("kind", "bucket").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("kind = 'g' or a > 0 or bucket = -1")
    found = counts.select((F.col("kind") == "w").alias("word"), F.col("bucket").cast("int").alias("bucket"), "a", "b").toArrow()  # one row a bucket
    grams, words = [np.zeros(1 << BITS, np.int64) for _ in "ab"], []
    for batch in found.to_batches():
        word, bucket, *ab = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        for x, c in zip(grams, ab):
            x[bucket[~word]] = c[~word]
        words.append([x[word] for x in (bucket, *ab)])
    del found
    at, toxic, clean = (np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32) for x in (zip(*words) if words else [()] * 3))
    texts, some = at == -1, at >= 0
    models = Models(*grams, at[some], toxic[some], clean[some], (int(toxic[texts].sum()), int(clean[texts].sum())))
    give_back()  # the driver's memory is small
    return models


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    p_raw = (raw + 1) / (raw.sum() + len(raw))
    p_target = (target + PSEUDO * p_raw) / (target.sum() + PSEUDO)
    return np.log(p_target) - np.log(p_raw)


def gumbel(seed: Column | int, *of: Column) -> Column:
    """Gumbel noise by the columns ``of``, the same in each run."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    u = (F.shiftrightunsigned(F.xxhash64(seed, *of), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def log_weight(total: Column, n: Column, rate: float) -> Column:
    """The log importance weight of a text of n n-grams whose log ratios come to ``total``.

    Nearly each byte is in GRAM n-grams; the mean over the GRAM ways to tile a text with n-grams is a GRAM-th of the sum.
    The target's model has not seen all n-grams of its kind of text, which takes from the sum in proportion to n: ``rate``
    is the log ratio an n-gram at which a text is as likely under either model, so that length alone decides nothing.
    """
    return (total - n * F.lit(rate)) / F.lit(float(GRAM))


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column of doubles, by histograms of 4,096 bins, each of the bin before that holds it."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return math.inf if n else None
    k = min(k, n)
    while low < high:
        width = (high - low) / 4096
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(4095)) if width > 0 else F.lit(0)
        bins = keys.where(F.col(column).between(low, high)).groupBy(at.alias("at"))
        bins = bins.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for row in sorted(bins.collect(), key=lambda r: -r["at"]):  # 4,096 rows at most
            if k <= row["n"]:
                break
            k -= row["n"]
        if (row["low"], row["high"]) == (low, high):
            break
        low, high = row["low"], row["high"]
    return high if low == high else low


def cut_between(at: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float | None:
    """Where to part numbers of good and bad rows by their score ``at``; none if they are not told apart.

    The share of good rows below and that of bad rows above come to the least there, in the middle of the widest such gap.
    """
    order = np.argsort(at)
    at, good, bad = at[order], good[order], bad[order]
    if len(at) < 2 or not good.sum() or not bad.sum():
        return None
    wrong = (np.cumsum(good) / good.sum() + 1 - np.cumsum(bad) / bad.sum())[:-1]
    best = np.flatnonzero(wrong < wrong.min() + 1e-9)
    i = best[np.argmax(at[best + 1] - at[best])]
    return float(at[i] + at[i + 1]) / 2 if wrong[i] < 1 else None


def cut_of(rows: DataFrame, value: Column, yes: str, fine: int) -> float | None:
    """Where ``value`` parts the rows in which the boolean column ``yes`` is true from those in which it is false."""
    bins = rows.groupBy((F.round(value * fine) / fine).alias("at"))
    bins = bins.agg(*[F.sum((F.col(yes) == x).cast("long")).alias(str(x)) for x in (True, False)]).toPandas()
    return cut_between(*[bins[c].to_numpy(float) for c in ("at", "True", "False")])


def share_of_toxic_kept(found: DataFrame, labels: DataFrame) -> float | None:
    """The share of documents labelled toxic among the rows (doc_id, kept) of ``found`` that are kept."""
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    return found.join(toxic, "doc_id").agg(F.avg(F.col("kept").cast("double"))).first()[0]


def share_of_target(labels: DataFrame) -> float:
    """The share of quality 1, toxic ones apart, among labelled rows."""
    good = (F.col("quality") == 1) & F.coalesce(F.col("toxic") != 1, F.lit(True))
    good, n = labels.where(F.col("quality").isNotNull()).agg(F.sum(good.cast("long")), F.count(F.lit(1))).first()
    return good / n if n else 1.0


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 29, carry: tuple[str, ...] | None = None) -> DataFrame:
    """(row, n_grams, log_ratio, weight, toxicity, key, toxic, kept) for every row of ``docs``; ``row`` is a struct of its columns ``carry`` (all).

    ``docs`` needs doc_id and text, ``labels`` doc_id, quality and toxic; more columns pass through or are ignored. The
    importance of a text is the ratio of its probabilities under the target's and the raw model of hashed n-grams (see
    ``log_weight`` for its length; its rate is the mean that parts good and bad labelled texts best, each under a model that
    has not seen it, 0 where there is none). The log weight plus Gumbel noise is the key, and the k rows of the largest keys are
    kept: Gumbel top-k, a sample without replacement by importance. k is read off the keys: all rows from the key on that parts
    good and bad labelled texts best, each weighed by a model that has not seen it, whatever the number of labels; or ``share`` of all rows where that
    is given. Where labels know one kind only, or keys do not tell the two apart, the share is that of quality 1 among
    labels. Rows that tie with the last key kept are kept, so repeated rows share their fate. Null, empty and shorter texts
    than an n-gram have weight 0; as nothing speaks against them, they are on no side of the cut and stay. Without labels all
    rows stay. Empty input: empty result. Texts of any length are read whole, in slices. Texts are read twice: to fit and to score.

    ``kept`` is by quality alone; callers drop what is ``toxic`` besides. Toxicity is the greatest log ratio of a word, how
    much more often labelled toxic texts have it than others, 0 at least: a mean over a text would drown a few words.
    Toxic is what reaches the value that parts the two. Toxic labels are no part of the target.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "quality")
    carry = carry or tuple(docs.columns)
    with small_batches(spark):
        sample = scratch.table(judged(labels), "judged")
        models = fit(docs, sample)
        plain = Plain(docs.select(*carry, F.col("doc_id").alias("_doc"), F.col("text").alias("_text")))
        rows = plain.df.withColumn("_noise", gumbel(seed, plain["_doc"], plain["_text"])).join(F.broadcast(sample), plain["_doc"] == F.col("_id"), "left")
        rows = rows.select(*plain.columns[: len(carry)], "_noise", "_good", "_toxic", plain["_text"].alias("_text"))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
        added = "".join(f", {c} double" for c in ("_n", "_sum", "_tone", "_own", "_own_tone"))
        scored = scratch.table(rows.mapInArrow(thrifty(score(models, "_text", "_good", "_toxic")), fields + added), "scored")
    known = scored.where("_good is not null or _toxic is not null")
    bound = cut_of(known.where("_toxic is not null"), F.col("_own_tone"), "_toxic", FINE_TONE) if models.tone is not None else None
    own = known.where("_good is not null and _n > 0")
    rate = cut_of(own, F.col("_own") / F.col("_n"), "_good", FINE_MEAN) or 0.0
    least = cut_of(own, log_weight(F.col("_own"), F.col("_n"), rate) + F.col("_noise"), "_good", FINE) if share is None else None
    weight = log_weight(F.col("_sum"), F.col("_n"), rate)
    scored = scored.withColumns({"_weight": weight, "_key": weight + F.col("_noise")})
    if least is not None:
        kept = (F.col("_key") >= least) | (F.col("_n") == 0)
    else:
        share = share_of_target(labels) if share is None else share
        last = kth_largest(scored, "_key", math.ceil(share * scored.count()))
        kept = F.col("_key") >= F.lit(last if last is not None else math.inf)
    row = F.struct(*[F.col(c).alias(n) for c, n in zip(plain.columns, carry)]).alias("row")
    mean = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).otherwise(F.lit(0.0))
    return scored.select(
        row, F.col("_n").cast("long").alias("n_grams"), mean.alias("log_ratio"), F.col("_weight").alias("weight"), F.col("_tone").alias("toxicity"),
        F.col("_key").alias("key"), (F.col("_tone") >= F.lit(math.inf if bound is None else bound)).alias("toxic"), kept.alias("kept"),
    )


def op8_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = resample(docs.select("doc_id", "text"), labels, carry=("doc_id",))
    kept = (F.col("kept") & ~F.col("toxic")).alias("kept")
    return out.select("row.doc_id", "n_grams", "log_ratio", F.col("weight").alias("log_weight"), F.col("key").alias("gumbel_key"), kept, "toxicity", "toxic")
