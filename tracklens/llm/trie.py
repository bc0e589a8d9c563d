"""The trie of conversation prefixes, by chained digests.

A turn is a SHA-256 digest of its role and text, so no text is shuffled. The turns of a conversation, in order, are chained:
the digest of a prefix is that of the shorter prefix's digest and the next turn's. One streaming pass over rows sorted by
conversation gives every prefix (``prefixes``); memory holds one digest. Equal digests are one node (``nodes``): an
aggregate with partial sums, so a first turn or a conversation that a third of all share is added up before it moves.

A node's name is its smallest member. Along the conversation of that name the nodes it names are the deepest ones, without
a gap. So what the nodes give to their ancestors is added up along each such conversation first, and every prefix of it
gets one row: exploding each node to all its ancestors, with the sums taken before the shuffle. Rows grow with the turns
and not with the square of a conversation's length.

The ids of the conversations that end at a node are hashed in order without gathering them: rows sorted by node and id
over range partitions become runs of at most ``RUN`` ids, and the runs of a node are hashed one after the other.

Defined cases: a null role or text is empty; null turns come first; equal turn numbers are ordered by the turn's digest; a
repeated row is a repeated turn. Rows without conv_id belong to no conversation and are left out. Role and text are set
apart by the role's length. Without conversations there is no node. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import dropped, stored, table

#: Ids in a run.
RUN = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), entry (32 bytes) and bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    entry = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", entry.alias("entry"), F.octet_length(text).cast("long").alias("bytes"))
    # A row of a window holds a digest; a long conversation is sorted on disk.
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "entry")
    return rows.where("conv_id IS NOT NULL").select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "entry", "bytes")


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, bytes, last of every prefix of every conversation.

    ``conversations``: conv_id, pos, entry, bytes, with one row at pos 0 without an entry for each conversation.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The row of a prefix is given out once the next row tells whether it is the last.
        held: tuple | None = None
        for b in batches:
            out = []
            for conv, entry, size in zip(*(b.column(c).to_pylist() for c in ("conv_id", "entry", "bytes")), strict=True):
                if held is not None:
                    out.append((*held, held[0] != conv))
                if held is None or held[0] != conv:
                    depth, node, parent = 0, hashlib.sha256().digest(), None
                if entry is not None:
                    depth, parent = depth + 1, node
                    node = hashlib.sha256(parent + entry).digest()
                held = conv, depth, node, parent, size
            yield made(out)
        if held is not None:
            yield made([(*held, True)])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "depth", "node", "parent", "bytes", "last"])

    rows = conversations.select("conv_id", "pos", "entry", "bytes").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return rows.mapInArrow(chain, "conv_id long, depth long, node binary, parent binary, bytes long, last boolean")


def ends(paths: DataFrame) -> DataFrame:
    """node and ends_sha256, for nodes at which conversations end."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        for b in batches:
            out = []
            for node, conv in zip(b.column("node").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if node != now or len(ids) == RUN:
                    if ids:
                        out.append((now, ids[0], ",".join(map(str, ids))))
                    now, ids = node, []
                ids.append(conv)
            yield made(out)
        if ids:
            yield made([(now, ids[0], ",".join(map(str, ids)))])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["node", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        named = lambda rows: pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["node", "ends_sha256"])
        for b in batches:
            out = []
            for node, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if node == now:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state = node, hashlib.sha256(ids.encode())
            yield named(out)
        if state is not None:
            yield named([(now, state.hexdigest())])

    rows = paths.where("last").select("node", "conv_id")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = rows.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(runs, "node binary, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def nodes(paths: DataFrame) -> DataFrame:
    """node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    ``paths``: what ``prefixes`` gives, stored, since it is read several times.
    """
    # Depth, parent and bytes follow from the node.
    found = paths.groupBy("depth", "node", "parent", "bytes").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    found = stored(found, "nodes")
    children = found.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    trie = stored(found.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")
    # Along each conversation, from its end: what the nodes that it names add up to, at every prefix.
    own = trie.select("conv_id", "depth", F.lit(None).cast("binary").alias("node"), F.expr("(n_convs - 1) * coalesce(bytes, 0)").alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"), F.lit(1).alias("mine"))
    every = paths.select("conv_id", "depth", "node", F.lit(0).cast("long").alias("saved"), F.lit(0).alias("leaf"), F.lit(0).alias("mine")).unionByName(own)
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    given = every.select("node", *[F.sum(c).over(deeper).alias(c) for c in ("saved", "leaf", "mine")]).where("node IS NOT NULL AND mine > 0")
    sums = given.groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = trie.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = trie.join(sums, "node").join(ends(paths), "node", "left").join(above, "parent", "left")
    none = hashlib.sha256().hexdigest()
    out = stored(out.select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")), "prefix-trie")
    dropped(found, trie)
    return out


def starts(rows: DataFrame) -> DataFrame:
    """The rows of ``turns`` and one at pos 0 for each conversation."""
    roots = rows.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("entry"), F.lit(None).cast("long").alias("bytes"))
    return rows.select("conv_id", "pos", "entry", "bytes").unionByName(roots)


def trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of a table of conversations (conv_id, turn, role, text)."""
    paths = stored(prefixes(starts(turns(conversations))), "prefixes")
    out = nodes(paths)
    dropped(paths)
    return out


def branched(rows: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Conversations that share beginnings: the first h turns of conversation c - c % ``every``, then c's own after its first h.

    h is the crc32 of c in decimal, modulo ``most``. ``rows``: what ``turns`` gives. A conversation gets the turns of one
    other; one gives at most ``most`` - 1 turns to fewer than twice ``every`` others.
    """
    ids = rows.select("conv_id").distinct()
    h = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % most
    own = rows.where(F.col("pos") > h("conv_id"))
    given = ids.select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % every).alias("conv_id"), h("conv_id").alias("h"))
    lent = rows.where(F.col("pos") < most).join(given, "conv_id").where("pos <= h").select(F.col("c").alias("conv_id"), "pos", "entry", "bytes")
    roots = ids.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("entry"), F.lit(None).cast("long").alias("bytes"))
    return roots.unionByName(lent).unionByName(own.select("conv_id", "pos", "entry", "bytes"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    rows = stored(turns(table(spark, sf_dir, "conversations")), "turns")
    paths = stored(prefixes(branched(rows)), "prefixes")
    out = nodes(paths)
    dropped(rows, paths)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return out.select(*(F.col(c).cast("long").alias(c) for c in columns), "ends_sha256")


def oracle(every: int = 5, most: int = 9) -> str:
    """Prefixes as lists of turns, every node joined with all its ancestors."""
    bits = "list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)) + y)"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda z: ('0x' || z)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
    entry = "sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
    return f"""
WITH RECURSIVE crcs AS (SELECT list({bits} ORDER BY i) AS t FROM (SELECT i::BIGINT AS i FROM range(256) r(i))),
given AS (SELECT conv_id, list({{'e': {entry}, 'b': strlen(coalesce(text, ''))}} ORDER BY turn NULLS FIRST, {entry}) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
heads AS (SELECT *, {crc} % {most} AS h FROM given, crcs),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.w[1:c.h], []), c.w[c.h + 1:]) AS w FROM heads c LEFT JOIN given b ON b.conv_id = c.conv_id - c.conv_id % {every}),
steps AS (SELECT conv_id, w, 0::BIGINT AS d, sha256('') AS node, NULL::VARCHAR AS parent FROM rebuilt UNION ALL SELECT conv_id, w, d + 1, sha256(node || w[d + 1].e), node FROM steps WHERE d < len(w)),
nodes AS (SELECT node, any_value(parent) AS parent, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(w[d].b), 0) AS b, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(w)), '')) AS ends_sha256 FROM steps GROUP BY node, d),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
full_ AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
up AS (SELECT node AS top, parent, (n_convs - 1) * b AS saved, (n_children = 0)::INT AS leaf FROM full_ UNION ALL SELECT n.node, n.parent, saved, leaf FROM up JOIN full_ n ON n.node = up.parent),
sums AS (SELECT top AS node, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY 1)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256 FROM full_ f JOIN sums USING (node) LEFT JOIN full_ p ON p.node = f.parent"""
