"""Token-ID output as a content-addressed store of chunks, with recipes and Merkle manifests."""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, by_value, give_back, process_store, running_total, salted_join, small_batches
from .textnp import BASE_BYTE, BASE_WORD, mix64, powers, slices, spans

by_value(__name__)

#: Ids under the rolling hash; least, mean and largest length of a chunk in ids. A chunk is cut by its content alone.
ROLL, LEAST, MEAN, MOST = 16, 128, 512, 4096
#: Pieces of text whose ids a Python worker keeps, in each of two generations.
PIECES = 200_000
#: Bytes whose pieces are hashed together.
BLOCK = 1 << 18
#: Pieces that are encoded as one text.
JOINED = 1000
#: Bytes of text that are encoded together.
SLICE = 4 << 20
#: Bytes that begin a piece: 1 for a space or line feed, 2 for a comma or full stop.
MARK = np.zeros(256, np.uint8)
MARK[[32, 10]], MARK[[44, 46]] = 1, 2
BLANK = np.zeros(256, bool)
BLANK[[0, *range(9, 14), *range(28, 33)]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: The reflected polynomial of CRC-32 (fixed by the algorithm).
CRC_POLY = 0xEDB88320


class Encoder:
    """Ids of texts by the tokenizers library, with the ids of repeated pieces kept.

    A byte-level BPE cuts a text by a pattern before it merges. The pattern always cuts before a space or line feed that
    stands between two characters that are not white space, and before a comma or full stop behind a letter or digit. So
    the ids of a text are those of its pieces between such places, one after the other. A text with such characters in
    other places (``pieces_of`` tells) is encoded whole. Ids are kept by the bytes of their piece; a 64-bit hash only finds
    the equal pieces of one slice.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.code = "H" if self.tok.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(f"<u{array(self.code).itemsize}")
        # a token of a byte-level BPE is written with one character a byte
        size = {i: len(t) for t, i in self.tok.get_vocab(with_added_tokens=False).items()}
        added = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        size |= {i: len(t.encode()) for i, t in added.items()}
        self.bytes_of = np.zeros(max(size, default=0) + 1, np.int64)
        self.bytes_of[list(size)] = list(size.values())
        self.joins = not any(" " in t for t in added.values())
        self.forget()

    def forget(self) -> None:
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def raw(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, pieces: list[bytes]) -> list[bytes]:
        return self.raw([x.decode() for x in pieces])

    def joined(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of ``spaced`` pieces, which the pattern parts again when they follow each other in one text. The bytes of the tokens tell where a piece ends."""
        whole = b"".join(self.raw([b"".join(pieces[i : i + JOINED]).decode() for i in range(0, len(pieces), JOINED)]))
        upto, ends = np.cumsum(self.bytes_of[np.frombuffer(whole, self.kind)]), np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        at = np.searchsorted(upto, ends)
        if len(pieces) and (not len(upto) or upto[-1] != ends[-1] or (upto[at] != ends).any()):
            return self.apart(pieces)
        cut = [0, *((at + 1) * self.kind.itemsize).tolist()]
        return [whole[a:b] for a, b in zip(cut, cut[1:])]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a slice, and where those of each text begin."""
        starts, ends, doubtful = pieces_of(data, offsets)
        which, hashes = pd.factorize(piece_hashes(data, starts, ends))
        at = np.zeros(len(hashes), np.int64)
        at[which[::-1]] = np.arange(len(which) - 1, -1, -1)  # the first place of each
        if len(self.new) > PIECES:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        view = data.tobytes()
        keys = [view[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        found = list(map(new.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        if old:
            for i in missing:
                if (x := old.get(keys[i])) is not None:
                    found[i] = new[keys[i]] = x
            missing = [i for i in missing if found[i] is None]
        missing = np.array(missing, np.int64)
        alike = self.joins & spaced(data, starts[at[missing]], ends[at[missing]])
        for some, ids_of in ((missing[alike], self.joined), (missing[~alike], self.apart)):
            some = some.tolist()
            for i, x in zip(some, ids_of([keys[i] for i in some])):
                found[i] = new[keys[i]] = x
        whole = np.flatnonzero(doubtful).tolist()
        found += self.raw([view[offsets[i] : offsets[i + 1]].decode() for i in whole]) if whole else []
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        pool, place = np.frombuffer(b"".join(found), self.kind), np.cumsum(size) - size
        # a doubtful text is one piece, after those of the other texts
        begin = starts
        if whole:
            begin = np.concatenate([starts, offsets[:-1][doubtful]])
            order = np.argsort(begin, kind="stable")
            which, begin = np.concatenate([which, np.arange(len(keys), len(found))])[order], begin[order]
        n = size[which]
        upto = np.cumsum(n)
        total = int(upto[-1]) if len(upto) else 0
        ids = pool[np.arange(total) + np.repeat(place[which] - upto + n, n)]
        first = np.concatenate([[0], upto])[np.searchsorted(begin, offsets)]
        return ids, first


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a slice of texts, and the texts to encode whole, of which there are no pieces.

    A text is doubtful if a space or line feed has white space or an end of the text beside it, or a comma or full stop
    does not follow a letter or digit. Of letters beyond ASCII only those of U+00C0 to U+00FF count before a comma, and
    beside a space only characters of blocks without white space.
    """
    n = len(data)
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(1, np.uint8)])
    kind = MARK[data]
    mark = np.flatnonzero(kind)
    p3, p2, p1, nx = padded[mark], padded[mark + 1], padded[mark + 2], padded[mark + 4]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid_before = np.where(p1 < 128, ~BLANK[p1], ((p2 >= 0xC3) & (p2 <= 0xDF)) | ((p3 >= 0xE4) & (p3 <= 0xED)))
    solid_after = np.where(nx < 128, ~BLANK[nx], ((nx >= 0xC3) & (nx <= 0xDF)) | ((nx >= 0xE4) & (nx <= 0xED)) | (nx >= 0xF0))
    letter = ALNUM[p1] | ((p1 >= 128) & (p2 == 0xC3) & (p1 != 0x97) & (p1 != 0xB7))
    gap = kind[mark] == 1
    bad = np.where(gap, ~solid_before | ~solid_after | edge[mark + 1], ~letter) | edge[mark]
    doubtful = np.zeros(len(offsets) - 1, bool)
    doubtful[np.searchsorted(offsets, mark[bad], "right") - 1] = True
    begins = kind > 0
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    keep = ~doubtful[np.searchsorted(offsets, starts, "right") - 1]
    return starts[keep], ends[keep], doubtful & (np.diff(offsets) > 0)


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hashes of pieces in order, some BLOCK bytes of them at a time: sums over a whole slice take eight times its size, several times over."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        a, j = starts[i], max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        out[i:j] = spans(data[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a, BASE_BYTE)
        i = j
    return out


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a piece begins with a space and ends, behind it, with an ASCII character that is not white space or a letter of U+00C0 to U+00FF."""
    last = data[ends - 1]
    solid = np.where(last < 128, ~BLANK[last], (data[ends - 2] == 0xC3) & (ends - starts > 2))
    return (data[starts] == 32) & (ends - starts > 1) & solid


def cut_places(ids: np.ndarray) -> np.ndarray:
    """Where a rolling hash over the last ROLL ids hits; the place is that behind them."""
    n = len(ids)
    if n < ROLL:
        return np.zeros(0, np.int64)
    up, down = powers(BASE_WORD, n + 1)
    kept = process_store()
    if "mixed_ids" not in kept:
        kept["mixed_ids"] = mix64(np.arange(1 << 16))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((kept["mixed_ids"][ids] if ids.dtype.itemsize == 2 else mix64(ids)) * up[:n], out=total[1:])
    ends = np.arange(ROLL, n + 1)
    h = (total[ends] - total[ends - ROLL]) * down[ends - ROLL]
    return ends[(h >> np.uint64(40)) % np.uint64(MEAN) == 0]


def cuts(n: int, places: list[int]) -> list[int]:
    """Ends of the chunks of a document of n ids: at its places, none under LEAST (but the last) or over MOST ids."""
    out, last = [], 0
    for e in places:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST:
            out.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def merkle(hashes: list[bytes]) -> bytes:
    """The root of a binary hash tree; an odd node goes up unchanged; the root of nothing is the hash of nothing."""
    if not hashes:
        return hashlib.sha256().digest()
    while len(hashes) > 1:
        up = [hashlib.sha256(a + b).digest() for a, b in zip(hashes[::2], hashes[1::2])]
        hashes = up + hashes[len(up) * 2 :]
    return hashes[0]


ROWS = "kind string, key binary, doc_id long, n_tokens long, root binary, recipe array<struct<off:bigint,n:int,hash:binary>>, n int, payload binary"


def chunked(path: str, end_id: int):
    """Rows of ROWS. Kind recipe: a document and its chunks; ``key`` is its own. Kind chunk: ids where this task meets their hash, the ``key``, for the first time."""
    chunk = pa.struct([("off", pa.int64()), ("n", pa.int32()), ("hash", pa.binary())])
    names = ["kind", "key", "doc_id", "n_tokens", "root", "recipe", "n", "payload"]

    def run(batches):
        kept = process_store("tokens")
        if kept.get("encoder_path") != path:
            kept["encoder_path"], kept["encoder"] = path, Encoder(path)
        encoder, seen, row = kept["encoder"], set(), TaskContext.get().partitionId() << 40
        width = encoder.kind.itemsize
        for batch in batches:
            for a, b, data, offsets in slices(batch["text"], SLICE):
                found, first = encoder.encode(data, offsets)
                # each document's end id goes in behind its ids
                ids = np.insert(found, first[1:], end_id)
                first = first + np.arange(len(first))
                places, raw = cut_places(ids), ids.tobytes()
                at = np.searchsorted(places, first[:-1] + ROLL), np.searchsorted(places, first[1:], "right")
                off, size, hashes, upto, roots, fresh = [], [], [], [0], [], []
                for begin, end, low, high in zip(first[:-1].tolist(), first[1:].tolist(), *(x.tolist() for x in at)):
                    last = 0
                    for e in cuts(end - begin, (places[low:high] - begin).tolist()):
                        payload = raw[(begin + last) * width : (begin + e) * width]
                        h = hashlib.sha256(payload).digest()
                        off.append(last)
                        size.append(e - last)
                        hashes.append(h)
                        if h not in seen:
                            seen.add(h)
                            fresh.append((h, e - last, payload))
                        last = e
                    roots.append(merkle(hashes[upto[-1] :]))
                    upto.append(len(hashes))
                n = b - a
                recipe = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([pa.array(off, pa.int64()), pa.array(size, pa.int32()), pa.array(hashes, pa.binary())], fields=list(chunk)))
                own = [(row + i).to_bytes(8, "big") for i in range(n)]
                row += n
                cols = [same("recipe", n), pa.array(own, pa.binary()), batch["doc_id"].slice(a, n), pa.array(np.diff(first)), pa.array(roots, pa.binary()), recipe, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)
                m = len(fresh)
                h, size, payload = zip(*fresh) if m else ((), (), ())
                cols = [same("chunk", m), pa.array(h, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.list_(chunk)), pa.array(size, pa.int32()), pa.array(payload, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names)
        give_back()  # what comes next needs the memory

    def same(value, n):
        return pa.array([value]).take(pa.array(np.zeros(n, np.int32)))

    return run


#: Children of a node of the manifest.
FAN = 1024


def write_manifest(scratch: Scratch, documents: DataFrame, name: str) -> bytes | None:
    """The root of a hash tree over all documents in order (ord, start, n_tokens, root), its levels written as ``name``0 and so on.

    A leaf is the SHA-256 of a document's start, length and root, a node that of its up to FAN children in order.
    """
    leaf = F.sha2(F.concat_ws("|", F.col("start").cast("string"), F.col("n_tokens").cast("string"), F.hex("root")).cast("binary"), 256)
    level, step = documents.select("ord", leaf.alias("hash")), 0
    while True:
        nodes = level.groupBy(F.floor(F.col("ord") / FAN).alias("ord")).agg(F.array_sort(F.collect_list(F.struct("ord", "hash"))).alias("below"))
        below = F.array_join(F.transform("below", lambda x: x["hash"]), "")
        level = scratch.table(nodes.select("ord", F.sha2(below.cast("binary"), 256).alias("hash")), f"{name}{step}")
        top = level.limit(2).collect()
        if len(top) < 2:
            return top[0]["hash"] if top else None
        step += 1


def write_store(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch) -> None:
    """Writes the ids of all texts under ``scratch`` in ascending doc_id order.

    ``store/kind=chunk``: key (the hash), n, payload (ids, little-endian, two bytes if the vocabulary fits, else four), each once.
    ``documents``: one row per document in ascending order of (doc_id, ids), null doc_id first: its number ``ord``, start, n_tokens, the
    root of its hash tree, and its recipe: chunks as (off, n, hash). ``manifest``: the tree over all documents; ``root`` its root.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    # a recipe's key is its own, and a task sends a hash once: no key has more rows than there are tasks
    rows = docs.mapInArrow(chunked(tokenizer, end_id), ROWS).repartition("key")
    rows = rows.withColumn("_one", F.row_number().over(Window.partitionBy("key").orderBy("n"))).where("_one = 1").drop("_one")
    rows.write.option("compression", "zstd").partitionBy("kind").parquet(scratch.path("store"))
    recipes = store(scratch).where("kind = 'recipe'").select("doc_id", "n_tokens", "root", "recipe", F.lit(1).cast("long").alias("one"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("root")]
    placed = running_total(scratch, recipes, order, {"n_tokens": "start", "one": "ord"}, "ranges")
    placed = placed.repartitionByRange(docs.sparkSession.sparkContext.defaultParallelism, "ord").sortWithinPartitions("ord")
    documents = scratch.table(placed.select("ord", "doc_id", "start", "n_tokens", "root", "recipe"), "documents")
    scratch.free("ranges")
    root = write_manifest(scratch, documents.select("ord", "start", "n_tokens", "root"), "manifest")
    scratch.table(docs.sparkSession.createDataFrame([(root,)], "root string"), "root")


def store(scratch: Scratch) -> DataFrame:
    names = [x.split(" ")[0] for x in ROWS.split(", ")]
    return scratch.spark.read.schema(ROWS).parquet(scratch.path("store")).select(*names)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the CRC polynomial, bits reflected."""
    p = np.zeros_like(a)
    for i in range(31, -1, -1):
        p ^= np.where((a >> np.uint32(i)) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(CRC_POLY), b >> np.uint32(1))
    return p


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs as they count with ``length`` more bytes behind them: the CRC of a whole is the xor of its parts' shifted CRCs."""
    power = np.full(1, 1 << 23, np.uint32)  # x^8
    crc, length = crc.astype(np.uint32), length.astype(np.int64)
    while length.any():
        at = np.flatnonzero(length & 1)
        crc[at] = times(np.broadcast_to(power, len(at)).copy(), crc[at])
        power = times(power, power)
        length = length >> 1
    return crc


def read_chunks(width: int):
    """Chunks as they are in the files: hash, CRC-32 of the ids as 32-bit integers. A wrong hash is an error."""

    def run(batches):
        for batch in batches:
            crc = []
            for h, n, payload in zip(*(batch[c].to_pylist() for c in ("hash", "n", "payload"))):
                if hashlib.sha256(payload).digest() != h or len(payload) != n * width:
                    raise ValueError(f"chunk {h.hex()} of the store is damaged")
                crc.append(zlib.crc32(np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch["hash"], pa.array(crc, pa.int64())], ["hash", "crc"])

    return run


def read_recipes(batches):
    """The chunks of each document as its recipe lists them. A recipe that does not give the document's root is an error."""
    for batch in batches:
        out = [[] for _ in range(4)]
        for start, n, root, recipe in zip(*(batch[c].to_pylist() for c in ("start", "n_tokens", "root", "recipe"))):
            if merkle([x["hash"] for x in recipe]) != root or sum(x["n"] for x in recipe) != n:
                raise ValueError(f"the recipe of the document at {start} does not give its root")
            for x in recipe:
                for o, v in zip(out, (start, x["hash"], x["n"], 4 * (n - x["off"] - x["n"]))):
                    o.append(v)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], ["start", "key", "n", "behind"])


def shift_rows(batches):
    for batch in batches:
        crc = shifted(batch["crc"].to_numpy(zero_copy_only=False), batch["behind"].to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([batch["start"], batch["n"], pa.array(crc.astype(np.int64))], ["start", "n", "crc"])


def read_store(scratch: Scratch, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    The manifest's root must come out of the documents, each document's root out of its recipe, each chunk's hash out of its
    ids; all else is an error. Each chunk is read once. The CRC of a document is put together from those of its chunks (CRCs are
    linear), so no ids are shuffled. A chunk of very many documents is dealt over several tasks.
    """
    documents = scratch.read("documents")
    root = write_manifest(scratch, documents.select("ord", "start", "n_tokens", "root"), "read")
    if root != scratch.read("root").first()["root"]:
        raise ValueError("the documents do not give the root of the manifest")
    chunks = store(scratch).where("kind = 'chunk'").select(F.col("key").alias("hash"), "n", "payload").mapInArrow(read_chunks(width), "hash binary, crc long")
    parts = documents.select("start", "n_tokens", "root", "recipe").mapInArrow(read_recipes, "start long, key binary, n long, behind long")
    parts = salted_join(scratch.table(parts, "parts"), chunks.withColumnRenamed("hash", "key"), "key", "start")
    parts = parts.select("start", "n", "crc", "behind").mapInArrow(shift_rows, "start long, n long, crc long")
    whole = parts.groupBy("start").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return documents.select("doc_id", "start").join(whole, "start").select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(scratch: Scratch, width: int = 2) -> DataFrame:
    """(doc_id, start, ids) of every document, put together from its recipe and the chunks; ids are an array in order."""
    documents = scratch.read("documents").select("doc_id", "start", F.explode("recipe").alias("c")).select("doc_id", "start", "c.off", F.col("c.hash").alias("key"))
    chunks = store(scratch).where("kind = 'chunk'").select("key", "payload")
    parts = salted_join(documents, chunks, "key", "start").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("off", "payload"))).alias("parts"))

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["payload"] for x in parts), f"<u{width}").astype(np.int64) for parts in batch["parts"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return parts.mapInArrow(run, "doc_id long, start long, ids array<long>")


def encode(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the ids of every row of ``docs`` (doc_id, text; more columns are ignored) and reads the files back.

    Texts are encoded whole, null as empty, strings of special tokens as ordinary text; ``end_id`` ends each document.
    Rows are in ascending doc_id order, null first; rows of one doc_id by number of ids and root. Repeated rows are
    written as often as they occur, their chunks once. Empty input: empty result.
    """
    from tokenizers import Tokenizer

    scratch = Scratch(docs.sparkSession, "tokens")
    with small_batches(docs.sparkSession, SLICE):
        write_store(docs, tokenizer, end_id, scratch)
        found = scratch.table(read_store(scratch, 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4), "found")
    scratch.free("parts")
    return found


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
