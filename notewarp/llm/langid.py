"""Language identification by cross-parsing entropy over suffix automata."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Plain, Scratch, by_value, small_batches

by_value(__name__)

#: What the model learns from at most: whole labelled texts of a language, characters of them in all (a text that would
#: go over is passed by, the first is taken at any length), and languages, the most frequent.
ROWS, CHARS, LANGS = 48, 40_000, 256
#: Labelled texts that these are chosen from, those of the least hashes.
FROM = 4 * ROWS
#: Characters that are parsed side by side; the phrases of a text do not depend on it.
STRETCH = 512
#: Bytes of text that are parsed together.
BATCH = 8 << 20
#: What all characters that are not letters become; letters outside the alphabet become its last symbol.
GAP = " "
UNKNOWN = "und"
#: Odd multipliers that spread the keys of a transition table.
SPREAD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def normal(text: str | None) -> str:
    """Lower case, each run of what is neither letter nor mark of a number as one space; empty without any letter."""
    text = re.sub(r"[\W\d_]+", GAP, (text or "").lower()).strip()
    return text if any(map(str.isalpha, text)) else ""


class Automaton:
    """Suffix automaton of a text, as a list of transitions. A path from state 0 spells a substring."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class Table:
    """Transitions (state * width + symbol) -> state by cuckoo hashing: a key lies in one of two places of a table a few times as large as their number.

    An entry holds the key above ``shift`` bits of the state; its size does not depend on the alphabet.
    """

    def __init__(self, keys: np.ndarray, states: np.ndarray, n_states: int):
        keys = keys.astype(np.uint64)
        self.shift, self.bits, seed = np.uint64(max(1, n_states.bit_length())), max(4, (3 * len(keys)).bit_length()), 0
        while not self.place(keys, seed):
            self.bits, seed = self.bits + (seed % 4 == 3), seed + 1
        entries = (keys << self.shift) | states.astype(np.uint64)
        self.cells = np.where(self.owner >= 0, entries[self.owner] if len(keys) else np.uint64(0), ~np.uint64(0))
        self.mask = (np.uint64(1) << self.shift) - np.uint64(1)
        del self.owner

    def place(self, keys: np.ndarray, seed: int) -> bool:
        """Tries to give each key one of its places, each newcomer turning out who is there."""
        self.by = [np.uint64(x + 2 * seed) for x in SPREAD]
        self.down = np.uint64(64 - self.bits)
        at = np.stack([(keys * x) >> self.down for x in self.by]).astype(np.int64)
        self.owner, side, out = np.full(1 << self.bits, -1, np.int64), np.zeros(len(keys), np.int64), np.arange(len(keys))
        for _ in range(200):
            if not len(out):
                return True
            to = at[side[out], out]
            there = self.owner[to]
            self.owner[to] = out
            there = np.unique(there[there >= 0])
            out = np.concatenate([out[self.owner[to] != out], there[self.owner[at[side[there], there]] != there]])
            side[out] ^= 1
        return False

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states behind keys, and where there is one."""
        one, two = (self.cells.take(((keys * x) >> self.down).view(np.int64)) for x in self.by)
        first = (one >> self.shift) == keys
        return (np.where(first, one, two) & self.mask).view(np.int64), first | ((two >> self.shift) == keys)


class Parser:
    """The automaton of one language. ``first`` tells where a phrase that begins with a symbol stands."""

    def __init__(self, symbols: list[int], width: int):
        auto, self.width = Automaton(symbols), np.int64(width)
        n = len(auto.next)
        rows = [(state * width + c, to) for state, edges in enumerate(auto.next) if state for c, to in edges.items()]
        keys, states = np.array(rows, np.int64).reshape(-1, 2).T
        self.table = Table(keys, states, n + 1)
        self.nowhere = n  # behind an unknown symbol nothing goes on
        self.first = np.full(width, n, np.int64)
        for c, to in auto.next[0].items():
            self.first[c] = to

    def marks(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Where phrases begin in texts cut into stretches (places ``begin``, ``size``; ``follows``: those that go on from the one before).

        All stretches are parsed side by side, each as if a phrase began there. Then the state in which a stretch ends is
        carried into the next one, which is parsed again up to the first place where both ways begin a phrase: from there
        on they agree. That is repeated until no stretch begins in another state, so stretches leave no trace.
        """
        out, final = np.zeros(len(flat), bool), np.zeros(len(begin), np.int64)

        def run(piece: np.ndarray, state: np.ndarray, again: bool) -> None:
            piece, state = (x[np.argsort(-size[piece], kind="stable")] for x in (piece, state))
            for i in range(int(size[piece].max(initial=0))):
                if size[piece[-1]] <= i:
                    live = int(np.searchsorted(-size[piece], -i, "left"))
                    final[piece[live:]] = state[live:]
                    piece, state = piece[:live], state[:live]
                place = begin[piece] + i
                symbol = flat.take(place)
                got, goes = self.table.get((state * self.width + symbol).view(np.uint64))
                state = np.where(goes, got, self.first.take(symbol))
                begins = ~goes if i or again else np.ones(len(piece), bool)
                if again:
                    apart = ~(begins & out[place])
                    out[place] = begins
                    piece, state = piece[apart], state[apart]
                    if not len(piece):
                        return
                else:
                    out[place] = begins
            final[piece] = state

        entered = np.full(len(begin), self.nowhere, np.int64)
        run(np.arange(len(begin)), entered, False)
        while True:
            changed = follows[final[follows - 1] != entered[follows]]
            if not len(changed):
                return out
            entered[changed] = final[changed - 1]
            run(changed, entered[changed], True)


class Model:
    """The automata of all languages over one alphabet.

    A symbol that does not continue a phrase begins the next one. A symbol that a language's sample lacks is a phrase of
    its own.
    """

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.alphabet = sorted(set("".join(texts.values())) | {GAP})
        code = {c: i for i, c in enumerate(self.alphabet)}
        self.parsers = [Parser([code[c] for c in texts[lang]], len(code) + 1) for lang in self.langs]
        self.codes = np.full(0x110000, len(code), np.int32)
        for c, i in code.items():
            self.codes[ord(c)] = i
        # a phrase of an automaton of n characters costs about log2(n) bits
        self.bits = np.array([math.log2(len(texts[x]) + 1) for x in self.langs])

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each text takes in each language, parsed greedily by longest matches from its first character on."""
        codes = [self.codes[np.frombuffer(x.encode("utf-32-le", "replace"), np.uint32)] for x in texts]
        lens = np.array([len(c) for c in codes], np.int64)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        pieces = -(-lens // STRETCH)
        total = int(pieces.sum())
        if not total:
            return out
        at = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(np.repeat(lens, pieces) - at * STRETCH, STRETCH)
        begin = at * STRETCH + np.repeat(np.cumsum(lens) - lens, pieces)
        flat, upto = np.concatenate(codes), np.concatenate([[0], np.cumsum(lens)])
        for j, parser in enumerate(self.parsers):
            count = np.concatenate([[0], np.cumsum(parser.marks(flat, begin, size, np.flatnonzero(at)))])
            out[:, j] = count[upto[1:]] - count[upto[:-1]]
        return out


def chosen(found: list[tuple[str, int, int]]) -> set[tuple[str, int]]:
    """Of (lang, hash, length) the texts to learn from, by hash, within the bounds on rows and characters."""
    out, rows, chars = set(), {}, {}
    for lang, h, n in sorted(found):
        if rows.get(lang, 0) < ROWS and (lang not in rows or chars[lang] + n <= CHARS):
            rows[lang], chars[lang] = rows.get(lang, 0) + 1, chars.get(lang, 0) + n
            out.add((lang, h))
    return out


def train(docs: DataFrame) -> Model:
    """The model of the languages among the non-null ``lang`` of ``docs`` (text, lang).

    A bounded sample of labelled rows, each learned from whole: of each language (the LANGS most frequent, ties by code
    point) up to ROWS of the texts with letters that have the least hashes, with CHARS characters in all.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("_h"), F.length("text").alias("_c"))
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).select("lang")
    least = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "_c"))
    some = rows.select("lang", "_h", "_c").distinct().join(F.broadcast(langs), "lang").withColumn("_n", least).where(F.col("_n") <= FROM)
    keys = chosen([tuple(r) for r in some.select("lang", "_h", "_c").collect()])
    if not keys:
        return Model({})
    wanted = docs.sparkSession.createDataFrame(sorted(keys), "lang string, _h long")
    texts: dict[str, list[str]] = {}
    for lang, _, text in sorted(rows.join(F.broadcast(wanted), ["lang", "_h"]).groupBy("lang", "_h").agg(F.min("text")).collect()):
        texts.setdefault(lang, []).append(normal(text))
    return Model({lang: GAP.join(parts) for lang, parts in texts.items()})


def classify(model: Model, column: str):
    """Adds the language and its score to rows by their text ``column``."""

    def run(batches):
        for batch in batches:
            langs, scores = [], []
            texts = [normal(x) for x in batch[column].to_pylist()]
            for x, c in zip(texts, model.phrases(texts) * model.bits):
                if not x or not len(c):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(np.argmin(c))
                rest = np.delete(c, best)
                langs.append(model.langs[best])
                # 1 if all other languages need far more phrases, 0.5 if the next needs as many
                scores.append(float(rest.min() / (rest.min() + c[best])) if len(rest) else 1.0)
            kept = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "_lang", "_score"])

    return run


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, unless given) with ``lang_pred`` and ``score``, written to a scratch table.

    ``docs`` needs text, whatever else it has passes through; its own columns ``lang_pred`` and ``score`` give way to
    the new ones. A null text and one without letters are ``und`` with score 0. Repeated rows are judged alike. Empty input: empty result.
    """
    keep = tuple(c for c in keep or docs.columns if c not in ("lang_pred", "score"))
    plain = Plain(docs.select(*keep, F.col("text").alias("_text")))
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in plain.df.schema.fields[:-1])
    with small_batches(docs.sparkSession, BATCH):
        found = plain.df.mapInArrow(classify(model, plain.columns[-1]), f"{fields}_lang string, _score double")
        named = [F.col(c).alias(n) for c, n in zip(plain.columns, keep)]
        return Scratch(docs.sparkSession, "langid").table(found.select(*named, F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")), "found")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang; more columns are ignored).

    A suffix automaton of a bounded sample of labelled texts per language, from documents that are not held out, cuts a
    whole text into the longest phrases that occur in the sample. Phrases times log2 of the sample's length estimate
    the text's cross-entropy, and the language of the least wins, ties by code point. A null text or one without letters
    is ``und`` with score 0, as is every text where there is nothing to learn from. A null doc_id is never held out and
    is not learned from. Repeated rows give repeated rows. Empty input: empty result.
    """
    held = held_out(F.col("doc_id"))
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model, ("doc_id", "held_out"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
