import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from notewarp.llm import tokenstore as S
from notewarp.llm.common import Scratch
from notewarp.llm.textnp import slices

PATH = public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(1)
PARTS = [" ", "  ", "\n", " \n", "\t", "a", "foo", "é", "'s", " 're", "1", "12", "!", "!!", ",", ".", "<|endoftext|>", "中文", "🙂", "_", "\x1c", "\x85", "\r\n", "²", "a,", "b.", "é.", "÷.", "…,", "\0", "я,", " ", " ", "á,", "　", "🙂 "]


@pytest.fixture(scope="module")
def tok():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_pieces_give_the_ids_of_whole_texts(tok):
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(4000)] + ["Ein Satz, noch einer.\nUnd so weiter."]
    encoder, got = S.Encoder(PATH), []
    for a, b, data, offsets in slices(pa.array(texts, pa.string()), 5000):
        ids, first = encoder.encode(data, offsets)
        got += [ids[x:y].tolist() for x, y in zip(first[:-1], first[1:])]
    assert got == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_words_are_encoded_together(tok, monkeypatch):
    texts = [" ".join("".join(rng.choices(["ab", "re", "é", "中", "1", "-", "'s", "\t", "\u3000", "\xa0", "!", "🙂"], k=rng.randint(1, 6))) for _ in range(40)) for _ in range(300)]
    encoder, asked = S.Encoder(PATH), []
    monkeypatch.setattr(encoder, "raw", lambda x, raw=encoder.raw: (asked.append(len(x)), raw(x))[1])
    for a, b, data, offsets in slices(pa.array(texts, pa.string())):
        ids, first = encoder.encode(data, offsets)
        assert [ids[x:y].tolist() for x, y in zip(first[:-1], first[1:])] == [e.ids for e in tok.encode_batch(texts[a:b], add_special_tokens=False)]
    words = {f" w{i}x": tok.encode(f" w{i}x", add_special_tokens=False).ids for i in range(2500)}
    asked.clear()
    ids, _ = encoder.encode(np.frombuffer("".join(words).encode()[1:], np.uint8), np.array([0, len("".join(words)) - 1]))
    assert ids.tolist()[-len(words[" w2499x"]) :] == words[" w2499x"] and sum(asked) < 10
    assert all(np.frombuffer(encoder.new[w.encode()], encoder.kind).tolist() == i for w, i in list(words.items())[1:])
    # where the tokens' bytes do not part at the pieces, each is encoded alone
    encoder.bytes_of += 1
    assert encoder.joined([b" one", b" two"]) == encoder.apart([b" one", b" two"])


def test_hashes_of_pieces_take_little_memory():
    import tracemalloc

    data = np.frombuffer((" one two three four" * 250_000).encode()[: S.SLICE], np.uint8)
    starts = np.flatnonzero(data == 32)
    ends = np.append(starts[1:], len(data))
    S.process_store().pop("powers", None)
    tracemalloc.start()
    got = S.piece_hashes(data, starts, ends)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 10 * len(data)
    assert (got == S.spans(data, starts, ends, S.BASE_BYTE)).all() and len(set(got[:-1].tolist())) == 4
    long = np.frombuffer(b" a " + b"x" * (3 * S.BLOCK) + b" b", np.uint8)
    starts = np.flatnonzero(long == 32)
    assert (S.piece_hashes(long, starts, np.append(starts[1:], len(long))) == S.spans(long, starts, np.append(starts[1:], len(long)), S.BASE_BYTE)).all()


def test_round_trip(docs_of, tok):
    base = " ".join(rng.choices(["foo", "bar,", "Übung", "qux."], k=3000))
    rows = [(5, "hello there"), (3, None), (None, "no id"), (9, base), (2, base + " more"), (9, base), (7, ""), (1, "x" * 20000)]
    got = [tuple(r) for r in S.encode(docs_of(rows), PATH).collect()]
    ids = [[*tok.encode(x or "", add_special_tokens=False).ids, 0] for _, x in rows]
    want, start = [], 0
    for (d, _), i in sorted(zip(rows, ids), key=lambda r: (r[0][0] is not None, r[0][0] or 0, len(r[1]))):
        want.append((d, start, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        start += len(i)
    assert sorted(got, key=lambda r: r[1]) == want


def test_chunks_are_stored_once_and_damage_is_found(docs_of, spark):
    base = " ".join(rng.choices(["alpha", "beta", "gamma"], k=4000))
    scratch = Scratch(spark, "t")
    S.write_store(docs_of([(i, f"{i} " + base) for i in range(6)]), PATH, 0, scratch)
    chunks = S.store(scratch).where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    stored, whole = chunks.selectExpr("sum(n) n").first()["n"], scratch.read("documents").selectExpr("sum(n_tokens) n").first()["n"]
    assert stored < whole / 3
    assert S.read_store(scratch).count() == 6
    bad = chunks.selectExpr("key hash", "n", "concat(substring(payload, 2), substring(payload, 1, 1)) payload").toArrow().to_batches()
    with pytest.raises(ValueError):
        list(S.read_chunks(2)(bad))


def test_ids_and_manifest(docs_of, spark, tok):
    rows = [(i, "same text" if i % 3 else f"text {i} " * (50 * i)) for i in range(40)] + [(None, None)]
    scratch = Scratch(spark, "m")
    S.write_store(docs_of(rows), PATH, 0, scratch)
    got = {r["doc_id"]: r["ids"] for r in S.read_ids(scratch).collect()}
    assert got == {d: [*tok.encode(x or "", add_special_tokens=False).ids, 0] for d, x in rows}
    documents = scratch.read("documents").select("ord", "start", "n_tokens", "root")
    assert sorted(r["ord"] for r in documents.collect()) == list(range(41))
    moved = documents.withColumn("start", documents["start"] + (documents["ord"] == 7).cast("long"))
    roots = {S.write_manifest(scratch, x, f"x{i}_") for i, x in enumerate((documents, documents.repartition(7), moved))}
    assert len(roots) == 2 and scratch.read("root").first()["root"] in roots


def test_manifest_has_levels(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(S, "FAN", 3)
    df = spark.range(20).selectExpr("id ord", "id * 2 start", "2L n_tokens", "cast(id as string) root").selectExpr("ord", "start", "n_tokens", "cast(root as binary) root")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    level = [sha(f"{2 * i}|2|{str(i).encode().hex().upper()}") for i in range(20)]
    while len(level) > 1:
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    assert S.write_manifest(Scratch(spark, "l"), df, "n") == level[0]
    assert S.write_manifest(Scratch(spark, "l"), df.where("false"), "n") is None


def test_crcs_of_parts():
    raw = rng.randbytes(5000)
    for cut in (0, 1, 1234, 5000):
        a, b = raw[:cut], raw[cut:]
        both = S.shifted(np.array([zlib.crc32(a), zlib.crc32(b)]), np.array([len(b), 0]))
        assert int(both[0] ^ both[1]) == zlib.crc32(raw)


def test_cuts():
    for n in (1, 127, 128, 129, 4096, 4097, 20000):
        for places in ([], list(range(10, n, 300)), [1, 2, 3]):
            ends = S.cuts(n, [p for p in places if p <= n])
            sizes = np.diff([0, *ends])
            assert ends[-1] == n and max(sizes) <= S.MOST and all(x >= S.LEAST for x in sizes[:-1])


def test_empty(docs_of):
    assert S.encode(docs_of([(1, "x")]).where("false"), PATH).collect() == []
