"""The prefix trie of conversations, built as a burst trie.

A turn is named by 16 bytes: 12 of the SHA-256 digest of its role and text, and 4 with its length. A
conversation is the string of its turns' names, so a prefix of turns is a prefix of bytes. Equal
conversations are one sequence with a count. All sequences begin in one container, at the root; a
container of more than ``most`` sequences is burst by its next turns (one at first, and in each round
twice as many), which become trie heads. The remaining containers are small; each is sorted and swept
by one task, which writes its nodes and a summary for the head that it hangs from. Heads get their
figures from these summaries by sums over prefixes, combined before they are shuffled, so that a head
with very many children, or a container of copies, isn't gathered anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm.shared import forget, hot_join, saved, small_batches

#: Bytes of a turn's name, of which the last LENGTH are its code points.
NAME, LENGTH = 16, 4
#: Sequences of a container.
MOST = 200
#: Digits of ids that are joined before they are hashed.
CHUNK = 1 << 16
_NONE = hashlib.sha256(b"").hexdigest()

_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def named_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, at, name) of turns (conv_id, turn, role, text): the place in the conversation, from 1, and the name in hexadecimal digits.

    Turns go by ``turn``, null first; ties by their names. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * (NAME - LENGTH))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.concat(F.upper(digest), F.lpad(F.hex(F.char_length(text).cast("long")), 2 * LENGTH, "0")).alias("name"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "name")
    return rows.filter("conv_id IS NOT NULL").select("conv_id", F.row_number().over(order).alias("at"), "name")


def _joined(turns: DataFrame) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), "")


def rebuilt(turns: DataFrame, shared: int = 6, group: int = 100) -> DataFrame:
    """(conv_id, seq): each conversation with the first h turns of the first conversation of its group of ids, and its own after its first h.

    h is the CRC-32 of the decimal conv_id, modulo ``shared``. A conversation's own turns are joined to one value of 16 bytes a turn.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = turns.filter((F.col("conv_id") % group == 0) & (F.col("at") < shared)).groupBy(F.col("conv_id").alias("base")).agg(_joined(turns).alias("head"))
    own = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("at") > h, F.struct("at", "name")))), lambda x: x["name"]), "").alias("own"))
    whole = own.select("conv_id", "own", base.alias("base"), h.alias("h")).join(heads, "base", "left")
    head = F.substr(F.coalesce("head", F.lit("")), F.lit(1), (F.col("h") * (2 * NAME)).cast("int"))
    return whole.select("conv_id", F.unhex(F.concat(head, F.col("own"))).alias("seq"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, conv_id), sorted -> (cls, first, ids): runs of ids of one class, joined by commas."""
    cls, first, ids, size = None, 0, [], 0

    def run() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([cls], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["cls", "first", "ids"])

    for batch in batches:
        out = []
        for c, conv in zip(batch.column("cls").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (c != cls or size > CHUNK):
                out.append(run())
                ids, size = [], 0
            if not ids:
                cls, first = c, conv
            ids.append(str(conv))
            size += len(ids[-1])
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if ids:
        yield run()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, ids), sorted -> (cls, ends): the SHA-256 of all ids of a class, joined by commas, as a stream."""
    cls, state = None, None
    for batch in batches:
        done = []
        for c, ids in zip(batch.column("cls").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if c == cls:
                state.update(b",")
            else:
                if state:
                    done.append((cls, state.hexdigest()))
                cls, state = c, hashlib.sha256()
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done]) for k in (0, 1)], ["cls", "ends"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([cls]), pa.array([state.hexdigest()])], ["cls", "ends"])


def _id_digests(members: DataFrame) -> DataFrame:
    """(cls, ends) of members (cls, conv_id): the digest of each class's ascending ids.

    Ids are dealt by ranges and joined to chunks there, so that few rows of a large class meet in one task.
    """
    chunks = members.repartitionByRange("cls", "conv_id").sortWithinPartitions("cls", "conv_id").mapInArrow(_chunks, "cls binary, first bigint, ids string")
    return chunks.repartition("cls").sortWithinPartitions("cls", "first").mapInArrow(_hashed, "cls binary, ends string")


def _burst(sequences: DataFrame, most: int) -> DataFrame:
    """sequences (seq, ...) with key, the bytes of the head that the sequence's container hangs from."""
    now = sequences.withColumn("key", F.unhex(F.lit("")))
    settled, depth, step = None, 0, 1
    while True:
        sizes = saved(now.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > most), "trie-large")
        if sizes.isEmpty():
            forget(sizes)
            return now if settled is None else settled.unionByName(now)
        fine = now.join(sizes, "key", "left_anti")
        settled = fine if settled is None else settled.unionByName(fine)
        depth, step = depth + step, 2 * step
        large = hot_join(now, sizes, "key", "c", now.count()).drop("c")
        now = saved(large.withColumn("key", F.expr(f"substring(seq, 1, {depth * NAME})")), "trie-burst")
        # a sequence that ends in its head has a container of its own
        ended = F.octet_length("seq") < depth * NAME
        settled, now = settled.unionByName(now.filter(ended)), now.filter(~ended)


class _Container:
    """The nodes of one container, from its sequences in order: a node is finished once a sequence leaves it.

    An open node is [smallest member, members, children, leaves, saved, digest of ends, finished children].
    """

    def __init__(self, key: bytes, rows: list[tuple]):
        self.key, self.base, self.rows = key, len(key) // NAME, rows
        self.path, self.open = key, [self.node()]

    @staticmethod
    def node() -> list:
        return [None, 0, 0, 0, 0, _NONE, []]

    def add(self, seq: bytes, n: int, conv: int, ends: str) -> None:
        at, common = self.base, min(len(seq), len(self.path)) // NAME
        while at < common and seq[at * NAME : (at + 1) * NAME] == self.path[at * NAME : (at + 1) * NAME]:
            at += 1
        self.close(at)
        self.open += [self.node() for _ in range(len(seq) // NAME - at)]
        self.path = seq
        for node in self.open:
            node[0] = conv if node[0] is None else min(node[0], conv)
            node[1] += n
        self.open[-1][5] = ends

    def close(self, depth: int) -> None:
        """Finish the open nodes deeper than depth."""
        while len(self.open) - 1 + self.base > depth:
            at, node, up = len(self.open) - 1 + self.base, self.open.pop(), self.open[-1]
            node[3] += not node[2]
            node[4] += (node[1] - 1) * int.from_bytes(self.path[at * NAME - LENGTH : at * NAME], "big")
            self.give(node, at)
            up[2] += 1
            up[3] += node[3]
            up[4] += node[4]
            up[6].append((node[0], at, *node[1:6]))

    def give(self, node: list, depth: int) -> None:
        """Write a finished node's children, as its smallest member is known now."""
        self.rows += [(None, conv, at, node[0], n, children, leaves, saved_, ends) for conv, at, n, children, leaves, saved_, ends in node[6]]

    def finish(self) -> None:
        """Write the summary for the head."""
        self.close(self.base)
        head = self.open[0]
        self.give(head, self.base)
        self.rows.append((self.key, head[0], self.base, None, *head[1:6]))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seq, n, conv_id, ends), sorted by key and seq -> nodes, and with a key the summaries of containers."""
    kinds = dict(zip(("key", *(x.split()[0] for x in _NODE.split(", "))), (pa.binary(), *[pa.int64()] * 7, pa.string()), strict=True))
    rows: list[tuple] = []
    now = None

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    for batch in batches:
        for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "seq", "n", "conv_id", "ends")), strict=True):
            if now is None or now.key != key:
                if now is not None:
                    now.finish()
                now = _Container(key, rows)
            now.add(*row)
            if len(rows) > 10_000:
                yield out()
        if rows:
            yield out()
    if now is not None:
        now.finish()
        yield out()


def _prefixes(key: str) -> Column:
    """All prefixes of a head, the root and itself included."""
    return F.expr(f"transform(sequence(0, cast(octet_length({key}) / {NAME} as int)), d -> substring({key}, 1, d * {NAME}))")


def trie(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """The nodes of the conversations' (conv_id, turn, role, text) prefix trie, a row for each.

    Conversations are rebuilt as by rebuilt(); null roles and texts are empty, texts are taken whole, and
    of rows that agree in conv_id and turn the one whose name sorts first comes first, so repeated rows are
    turns of their own. Rows without conv_id are passed over, other columns ignored; an empty table has no
    nodes. A node is a sequence of the first ``depth`` turns: conv_id is its smallest member, n_convs its
    members, n_leaves and saved_tokens count its whole subtree, and ends_sha256 is of the members that end
    there. Two different turns of equal length share a name with a chance of 2**-96.
    """
    turns = saved(named_turns(conversations), "trie-turns")
    members = saved(rebuilt(turns).withColumn("cls", F.unhex(F.substring(F.sha2("seq", 256), 1, 32))), "trie-members")
    ends = _id_digests(members.select("cls", "conv_id"))
    sequences = members.groupBy("cls", "seq").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    sequences = saved(sequences.join(ends, "cls").drop("cls"), "trie-sequences")
    swept = saved(_burst(sequences, most).repartition("key").sortWithinPartitions("key", "seq").select("key", "seq", "n", "conv_id", "ends").mapInArrow(_swept, f"key binary, {_NODE}"), "trie-swept")

    # heads: what containers sum up to, for every prefix of their keys
    hangs = F.col("prefix") == F.col("key")
    exploded = swept.filter("key IS NOT NULL").select("*", F.explode(_prefixes("key")).alias("prefix"))
    heads = exploded.groupBy("prefix").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum(F.when(hangs, F.col("n_children")).otherwise(0)).alias("inner_children"),
        F.sum(F.when(hangs, F.col("n_leaves")).otherwise(0)).alias("inner_leaves"), F.sum(F.when(hangs, F.col("saved_tokens")).otherwise(0)).alias("inner_saved"),
        F.max(F.when(hangs & (F.col("ends_sha256") != _NONE), F.col("ends_sha256"))).alias("ends"),
    )
    size = F.octet_length("prefix")
    heads = heads.withColumns({"parent": F.when(size > 0, F.expr(f"substring(prefix, 1, octet_length(prefix) - {NAME})")), "chars": F.coalesce(F.conv(F.hex(F.expr(f"substring(prefix, octet_length(prefix) - {LENGTH - 1}, {LENGTH})")), 16, 10).cast("long"), F.lit(0))})
    heads = saved(heads, "trie-heads")
    children = heads.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("head_children"))
    heads_ = heads.join(children, "prefix", "left").withColumn("head_children", F.coalesce("head_children", F.lit(0))).withColumn("n_children", F.col("inner_children") + F.col("head_children"))
    own = heads_.select("prefix", ((F.col("n_convs") - 1) * F.col("chars") + F.col("inner_saved")).alias("own_saved"), (F.col("inner_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("own_leaves"))
    sums = own.select(F.explode(_prefixes("prefix")).alias("prefix"), "own_saved", "own_leaves").groupBy("prefix").agg(F.sum("own_saved").alias("saved_tokens"), F.sum("own_leaves").alias("n_leaves"))
    heads_ = saved(heads_.join(sums, "prefix"), "trie-summed")
    parents = heads_.filter("head_children > 0").select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "head_children")
    named = hot_join(heads_.filter("parent IS NOT NULL").drop("head_children"), parents, "parent", "head_children", heads_.count()).drop("head_children")
    root = heads_.filter("parent IS NULL").drop("head_children").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = [x.split()[0] for x in _NODE.split(", ")]
    depth = (F.octet_length("prefix") / NAME).cast("long").alias("depth")
    tops = named.unionByName(root).select("conv_id", depth, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256"))
    return tops.unionByName(swept.filter("key IS NULL").select(*columns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations."""
    small_batches(spark)
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda k, z: xor(k >> 1, 3988292384 * (k & 1))))"
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, md5(coalesce(role, '') || chr(0) || coalesce(text, '')) AS name, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor({_CRC}, 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM n)),
r AS (
  SELECT c.conv_id, n.pos, n.name, n.chars, 0 AS part FROM c JOIN n ON n.conv_id = c.base AND n.pos <= c.h
  UNION ALL SELECT c.conv_id, n.pos, n.name, n.chars, 1 FROM c JOIN n ON n.conv_id = c.conv_id AND n.pos > c.h
),
d AS (SELECT *, row_number() OVER w AS depth, string_agg(name, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
m AS (SELECT conv_id, depth, path, chars, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM d UNION ALL SELECT conv_id, 0, '', 0, NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id) FROM c),
g AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, left(path, 32 * (depth - 1)) AS up,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY path, depth
),
k AS (SELECT up, count(*) AS n FROM g WHERE depth > 0 GROUP BY up),
o AS (SELECT g.*, coalesce(k.n, 0) AS n_children FROM g LEFT JOIN k ON k.up = g.path),
s AS (SELECT left(path, 32 * u.i) AS path, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM o, LATERAL (SELECT unnest(range(depth + 1)) AS i) u GROUP BY 1)
SELECT o.conv_id, o.depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, s.n_leaves, s.saved_tokens, o.ends_sha256
FROM o JOIN s USING (path) LEFT JOIN g p ON o.depth > 0 AND p.path = o.up
"""
