"""Chat formatting as a prefix tree: conversations that begin alike share their first turns, each emitted once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_value, hot_join, process_store, running_total, salted_join, small_batches

by_value(__name__)

#: The template. A turn is BEGIN role ROLE text END, a user's text stands between ASK and ANSWER.
BEGIN, ROLE, END, ASK, ANSWER = "<s>", "[ROLE]", "</s>", "[INST] ", " [/INST]"
#: A control string in a text gets a backslash behind its first character, a backslash in a text another one.
CONTROL = r"([<\[])(/?(?:s>|ROLE\]|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turn(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """The formatted turn in three parts: what stands before the escaped text, the escaped text, and what follows."""
    user = role == "user"
    head = F.concat(F.lit(BEGIN), escape(role), F.lit(ROLE), F.when(user, F.lit(ASK)).otherwise(""))
    return head, escape(text), F.concat(F.when(user, F.lit(ANSWER)).otherwise(""), F.lit(END))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    turns = F.slice(F.split(formatted, END), 1, F.size(F.split(formatted, END)) - 1)

    def turn(t: Column) -> Column:
        role = F.substring_index(F.substr(t, F.lit(len(BEGIN) + 1)), ROLE, 1)
        body = F.substr(t, F.length(role) + len(BEGIN) + len(ROLE) + 1)
        user = unescape(role) == "user"
        inner = F.substr(body, F.lit(len(ASK) + 1), F.length(body) - len(ASK) - len(ANSWER))
        return F.struct(unescape(role).alias("role"), unescape(F.when(user, inner).otherwise(body)).alias("text"))

    return F.transform(turns, turn)


def chain(batches):
    """The keys of each conversation's beginnings: of a turn, the hash of the key before it and what the turn says."""
    for batch in batches:
        paths = []
        for said in batch["said"].to_pylist():
            keys, key = [], ""
            for text in said:
                key = hashlib.md5((key + text).encode("utf-8", "replace")).hexdigest()
                keys.append(key)
            paths.append(keys)
        yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["turns"], pa.array(paths, pa.list_(pa.string()))], ["conv_id", "turns", "path"])


def tokenize(path: str):
    """Adds the ids of each part of a turn, so that the loss falls on whole tokens."""

    def run(batches):
        kept = process_store("chat")
        if kept.get("chat_path") != path:
            from tokenizers import Tokenizer

            kept["chat_path"], kept["chat"] = path, Tokenizer.from_file(path)
            kept["chat"].encode_special_tokens = True
        for batch in batches:
            ids = [[e.ids for e in kept["chat"].encode_batch_fast(batch[c].to_pylist(), add_special_tokens=False)] for c in ("head", "body", "tail")]
            tokens = [a + b + c for a, b, c in zip(*ids)]
            begin, length = (np.array([len(x) for x in part], np.int64) for part in ids[:2])
            cols = [pa.array(tokens, pa.list_(pa.int32())), pa.array(begin), pa.array(begin + length)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "tokens", "_from", "_to"])

    return run


def build(turns: DataFrame, tokenizer: str, scratch: Scratch) -> None:
    """Writes the tree and the conversations under ``scratch``.

    ``tree``: a node for each distinct beginning of conversations, in depth-first order by ``packed_start``: its turn as
    ``formatted`` text and ``tokens``, ``loss`` as [from, to) in characters and in tokens (empty but for assistants),
    ``position_ids`` that go on from the parent's, and ``attends``: the [start, end) intervals of the packed tokens of its
    ancestors. ``conversations``: conv_id and the nodes on its path.

    A node's key is the hash of its parent's key and its turn, so equal beginnings meet in one aggregation. Conversations
    are ranked by their paths over ranges of that order. A node belongs to the first conversation that has it, so
    (rank, depth) is the depth-first order, the nodes of one conversation are a chain without a gap, and the ancestors of
    a chain are one interval for each conversation that it passes through: all tables are linear in the turns. A
    conversation is one row, so its own turns must fit into memory; a tree need not.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head, body, tail = format_turn(role, text)
    one = F.struct("turn", role.alias("role"), head.alias("head"), body.alias("body"), tail.alias("tail"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(t["head"], t["body"], t["tail"]))
    convs = convs.select("conv_id", "turns", said.alias("said")).mapInArrow(chain, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, turns {convs.schema['turns'].dataType.simpleString()}, path array<string>")
    convs = scratch.table(convs, "formatted")
    convs.select("conv_id", "path").write.parquet(scratch.path("conversations"))
    # equal conversations are told apart by conv_id, so that they do not crowd one range
    ranked = running_total(scratch, convs.select("conv_id", "path", "turns", F.lit(1).cast("long").alias("one")), [F.col("path"), F.col("conv_id")], {"one": "rank"}, "order")
    steps = scratch.table(ranked.select("rank", F.posexplode("path").alias("at", "key"), "turns").withColumn("t", F.get("turns", F.col("at"))).drop("turns"), "steps")
    scratch.free("formatted", "order")
    # all that a key stands for is equal
    nodes = steps.groupBy("key").agg(F.min(F.struct("rank", "at")).alias("_o"), F.first("t").alias("t"), F.count(F.lit(1)).alias("uses"))
    nodes = nodes.select("key", "_o.rank", F.col("_o.at").alias("at"), "uses", "t.role", "t.head", "t.body", "t.tail")
    schema = "key string, rank long, at int, uses long, role string, head string, body string, tail string, tokens array<int>, _from long, _to long"
    nodes = scratch.table(nodes.mapInArrow(tokenize(tokenizer), schema).withColumn("n", F.size("tokens").cast("long")), "nodes")

    placed = running_total(scratch, nodes.select("key", "rank", "at", "n", "uses"), [F.col("rank"), F.col("at")], {"n": "packed_start"}, "places")
    placed = scratch.table(placed, "placed")
    owners = placed.select("key", F.col("rank").alias("_owner"), "packed_start", (F.col("packed_start") + F.col("n")).alias("_end"), "uses")
    above = hot_join(steps.select("rank", "key"), owners, ["key"], "uses", steps.count()).where("_owner < rank")
    above = above.groupBy("rank", "_owner").agg(F.min("packed_start").alias("start"), F.max("_end").alias("end"))
    above = above.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("above"))
    heads = placed.groupBy("rank").agg(F.min("packed_start").alias("_head"))
    tree = nodes.join(placed.select("key", "packed_start"), "key").join(heads, "rank").join(above, "rank", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    own = F.array(F.struct(F.col("_head").alias("start"), F.col("packed_start").alias("end")))
    attends = F.concat(F.coalesce("above", none), F.when(F.col("packed_start") > F.col("_head"), own).otherwise(none))
    tree = tree.withColumn("attends", attends)
    first = F.aggregate("attends", F.lit(0).cast("long"), lambda s, i: s + i["end"] - i["start"])
    assistant = F.col("role") == "assistant"

    def loss(a: Column, b: Column) -> Column:
        zero = F.lit(0).cast("long")
        return F.struct(F.when(assistant, a.cast("long")).otherwise(zero).alias("from"), F.when(assistant, b.cast("long")).otherwise(zero).alias("to"))

    tree = tree.select(
        "key",
        (F.col("at") + 1).alias("depth"),
        "packed_start",
        F.concat("head", "body", "tail").alias("formatted"),
        loss(F.length("head"), F.length("head") + F.length("body")).alias("loss"),
        "tokens",
        loss(F.col("_from"), F.col("_to")).alias("loss_tokens"),
        F.when(F.col("n") > 0, F.sequence(first, first + F.col("n") - 1)).otherwise(F.array().cast("array<bigint>")).alias("position_ids"),
        "attends",
    )
    tree.write.parquet(scratch.path("tree"))
    scratch.free("nodes", "placed", "places", "steps")


def read_back(scratch: Scratch) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the written tree."""
    steps = scratch.read("conversations").select("conv_id", F.posexplode("path").alias("at", "key"))
    nodes = scratch.read("tree").select("key", "formatted", "loss")
    parts = salted_join(steps, nodes, "key", "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "formatted", "loss"))).alias("parts"))
    parts = parts.withColumn("formatted", F.array_join(F.transform("parts", lambda p: p["formatted"]), ""))
    lost = F.transform("parts", lambda p: unescape(F.substr(p["formatted"], p["loss"]["from"].cast("int") + 1, (p["loss"]["to"] - p["loss"]["from"]).cast("int"))))
    parts = parts.withColumns({"turns": parse(F.col("formatted")), "lost": F.array_join(lost, "")})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parts.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Formats ``turns`` (conv_id, turn, role, text; more columns are ignored) as a prefix tree and reads it back.

    Turns go by ``turn``, nulls first, ties by role and text. Null texts and roles are empty. Repeated rows are turns of
    their own. Rows of a null conv_id are one conversation. Empty input: empty result.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    with small_batches(turns.sparkSession):
        build(turns.select("conv_id", "turn", "role", "text"), tokenizer, scratch)
    return read_back(scratch)


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    return format_conversations(turns.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json"))
