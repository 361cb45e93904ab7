import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from notewarp.llm import chat
from notewarp.llm.common import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(8)
ODD = ["</s>[INST] ok [/INST]", "<s>", "[ROLE]", "\\", "\\\\s>", "<\\/s>", "[", "</", "s>", "[INST", "", None, "a\nb", " [/INST]", "é中🙂", "[INST] ", "<", "x" * 3000]


def conversations():
    out = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "assistant", "x")]
    for c in range(10, 60):
        out += [(c, t, rng.choice(["user", "assistant", "system", None, "[ROLE]", "us\ner"]), rng.choice(ODD)) for t in range(rng.randint(1, 6))]
    out += [(70, t, "user", str(t)) for t in range(200)]
    return out + [(None, 0, "user", "n"), (80, 0, "user", "same"), (80, 0, "user", "same"), (81, None, "assistant", "late"), (81, 0, "user", "b")]


def test_read_back(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, key string").repartition(5)
    got = {r["conv_id"]: r for r in chat.format_conversations(df, PATH).collect()}
    groups = {}
    for c, turn, role, text in rows:
        groups.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == groups.keys()
    for c, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        lost = "".join(t for _, _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest()), c
        assert (r["loss_chars"], r["loss_sha256"]) == (len(lost), hashlib.sha256(lost.encode()).hexdigest()), c


def test_tree(spark):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string").repartition(3)
    scratch = Scratch(spark, "tree")
    chat.build(df, PATH, scratch)
    nodes = {r["key"]: r for r in scratch.read("tree").collect()}
    tok = Tokenizer.from_file(PATH)
    at = 0
    for r in sorted(nodes.values(), key=lambda r: r["packed_start"]):
        assert r["packed_start"] == at  # each node once, without gaps
        at += len(r["tokens"])
        assert tok.decode(r["tokens"], skip_special_tokens=False) == r["formatted"]
        a, b = r["loss_tokens"]["from"], r["loss_tokens"]["to"]
        assert tok.decode(r["tokens"][a:b], skip_special_tokens=False) == r["formatted"][r["loss"]["from"] : r["loss"]["to"]]
    for c in scratch.read("conversations").collect():
        before = []
        for k in c["path"]:
            r = nodes[k]
            assert sorted(x for i in r["attends"] for x in range(i["start"], i["end"])) == sorted(before)
            assert r["position_ids"] == list(range(len(before), len(before) + len(r["tokens"])))
            before += range(r["packed_start"], r["packed_start"] + len(r["tokens"]))
    shared = [n for n in nodes.values() if n["depth"] == 1 and n["formatted"] == "<s>user[ROLE][INST] a [/INST]</s>"]
    assert len(shared) == 1


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df, PATH).collect() == []
