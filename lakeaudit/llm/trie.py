"""Prefix trie of conversations, rolled up by pointer jumping.

A node is a distinct sequence of turns (role, text) that some conversation starts with;
the root is the empty one. Its key is a digest of the sequence. Keys come from chunks of
WIDTH turns: digests within a chunk, then, by the same step over the chunks' own
digests, of all chunks before; a conversation of n turns takes log(n) rounds to base WIDTH,
and no window holds more than WIDTH rows.

Sums over subtrees: every node adds its sums to the one it points at and then points
at what that one pointed at, so pointers go 1, 2, 4, ... levels up and the rounds are
the logarithm of the depth; only nodes deep enough to point take part in a round. Hot
targets (a common first turn) are set apart: keys with over a SHARE-th of
the rows are SHARE at most, and are joined by broadcast.

Defined results: null roles and texts are empty; a null turn comes first; equal turns of a
conversation stand by the digest of role and text. Rows without a conversation id belong
to no conversation and take no part. Repeated rows are turns of their own. No conversations: no
nodes. Other columns of the table don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CRC32_SQL, discard, materialise, ranked, shuffle_width

#: Turns in a chunk (a power of two), ids in a list, and keys that may be hot.
BITS, LIST, SHARE = 5, 256, 512
ROOT = ""


def _digest(*parts: Column) -> Column:
    """128 bits of SHA-256, in hex."""
    return F.left(F.sha2(F.concat(*parts), 256), F.lit(32))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, at, of, key, words): turns in order, at from 0, of all turns of the conversation; texts are left behind."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(32))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), key.alias("key"), words.alias("words"))
    return ranked(rows, ["conv"], ["turn", "key"], "turns").select("conv", F.col("__at").alias("at"), F.col("__of").alias("of"), "key", "words")


def prefixes(items: DataFrame) -> DataFrame:
    """items (conv, at, key, ...) with digest (of all keys up to the item) and parent (that of the item before; null for the first)."""
    chunk = Window.partitionBy("conv", "chunk").orderBy("at")
    rows = items.withColumn("chunk", F.shiftright("at", BITS)).withColumn("own", _digest(F.array_join(F.collect_list("key").over(chunk.rowsBetween(Window.unboundedPreceding, 0)), "")))
    rows = rows.withColumn("before", F.lag("own").over(chunk))
    if (items.agg(F.max("at")).first()[0] or 0) >> BITS == 0:
        return rows.withColumnRenamed("own", "digest").withColumnRenamed("before", "parent").drop("chunk")
    rows = materialise(rows, "chunks")
    full = rows.where(F.col("at").bitwiseAND(F.lit((1 << BITS) - 1)) == (1 << BITS) - 1)
    above = prefixes(full.select("conv", F.col("chunk").alias("at"), F.col("own").alias("key")))
    above = above.select("conv", (F.col("at") + 1).alias("chunk"), F.col("key").alias("a_key"), F.col("digest").alias("a_digest"), F.col("parent").alias("a_parent"))
    # the item before the first of a chunk ends the chunk before, whose digest follows from that chunk's own parent
    last = F.when(F.col("a_parent").isNull(), F.col("a_key")).otherwise(_digest(F.col("a_parent"), F.col("a_key")))
    rows = rows.join(above, ["conv", "chunk"], "left")
    digest = F.when(F.col("chunk") == 0, F.col("own")).otherwise(_digest(F.col("a_digest"), F.col("own")))
    parent = F.when(F.col("chunk") == 0, F.col("before")).when(F.col("before").isNull(), last).otherwise(_digest(F.col("a_digest"), F.col("before")))
    return rows.select(*items.columns, digest.alias("digest"), parent.alias("parent"))


def join_one(rows: DataFrame, single: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """Inner join of rows with a table that has each key once; keys with over a share-th of the rows (at most share of them) by broadcast."""
    least = rows.count() / share
    hot = rows.groupBy(key).count().where(F.col("count") > least).select(key)
    hot = rows.sparkSession.createDataFrame([tuple(r) for r in hot.collect()], hot.schema)
    few = single.join(F.broadcast(hot), key, "left_semi")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(single, key))


def id_lists(ends: DataFrame) -> DataFrame:
    """(digest, ends): SHA-256 of the ids of each key, ascending and comma-joined.

    Lists of LIST ids are made first, wherever they are; a key with one list is hashed in place, the others' lists are
    streamed through one hash for each key, in order, a batch at a time.
    """
    rows = ranked(ends, ["digest"], ["conv"], "ends")
    lists = rows.groupBy("digest", F.floor(F.col("__at") / LIST).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"), F.first("__of").alias("of"))
    lists = materialise(lists, "lists")
    short = lists.where(F.col("of") <= LIST).select("digest", F.sha2("ids", 256).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, h, out = None, None, []
        done = lambda: pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["digest", "ends"])
        for b in batches:
            for d, ids in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if d != own:
                    if own is not None:
                        out.append((own, h.hexdigest()))
                    own, h = d, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield done()
                out = []
        if own is not None:
            out = [(own, h.hexdigest())]
            yield done()

    long = lists.where(F.col("of") > LIST).select("digest", "part", "ids").repartition(shuffle_width(lists.sparkSession), "digest").sortWithinPartitions("digest", "part")
    return short.union(long.select("digest", "ids").mapInArrow(run, "digest string, ends string"))


def rolled_up(nodes: DataFrame, share: int = SHARE) -> DataFrame:
    """(digest, leaves, saved): sums over the subtrees of nodes (digest, parent, depth, leaves, saved)."""
    active = nodes.where("depth > 0").select("digest", F.col("parent").alias("up"), "depth", "leaves", "saved")
    sums, reach = [nodes.select("digest", "leaves", "saved")], 1
    staged: list[DataFrame] = []
    while True:
        # active: the nodes of depth >= reach, each pointing reach levels up, with the sums of what is less than reach below
        given = materialise(active.groupBy(F.col("up").alias("digest")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "given")
        sums.append(given)
        reach *= 2
        deep = active.where(F.col("depth") >= reach)
        if deep.isEmpty():
            break
        own = deep.join(given.select("digest", F.col("leaves").alias("l"), F.col("saved").alias("s")), "digest", "left")
        own = own.select("digest", "up", "depth", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        further = active.select(F.col("digest").alias("up"), F.col("up").alias("next"))
        active = materialise(join_one(own, further, "up", share).select("digest", F.col("next").alias("up"), "depth", "leaves", "saved"), "active")
        staged.append(active)
    total = sums[0]
    for s in sums[1:]:
        total = total.unionByName(s)
    total = materialise(total.groupBy("digest").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "sums")
    discard(*staged, *sums[1:])
    return total


def trie(items: DataFrame, empty: DataFrame, share: int = SHARE) -> DataFrame:
    """Nodes of the trie of some conversations.

    items: (conv, at, of, key, words), one row for each turn; empty: (conv) of the
    conversations without turns. Returns digest, parent, conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    items = materialise(items, "items")
    rows = materialise(prefixes(items).withColumn("depth", F.col("at") + 1).withColumn("parent", F.coalesce("parent", F.lit(ROOT))), "prefixes")
    of_root = rows.where("at = 0").select("conv").union(empty).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = of_root.select(F.lit(ROOT).alias("digest"), F.lit(None).cast("string").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = rows.groupBy("digest").agg(F.first("parent").alias("parent"), F.min("conv").alias("conv_id"), F.first("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"))
    nodes = materialise(root.unionByName(nodes), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = materialise(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    sums = rolled_up(nodes, share).select("digest", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    ends = id_lists(rows.where("depth = of").select("digest", "conv").union(empty.select(F.lit(ROOT), "conv")))
    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = join_one(nodes.where("depth > 0"), parents, "parent", share)
    out = below.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = out.join(sums, "digest").join(ends, "digest", "left").withColumn("ends_sha256", F.coalesce("ends", F.sha2(F.lit(""), 256)))
    return out.select("digest", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(own: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group of ids: (items, empty) for trie.

    Conversation c takes the first h turns of c - c % group and goes on with its own after its first h; h = crc32(c) % heads.
    """
    own = materialise(own, "own")
    head = (F.crc32(F.col("conv").cast("string")) % heads).alias("h")
    convs = own.where("at = 0").select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), head, F.col("of").alias("own_of"))
    lent = own.where(F.col("at") < heads - 1).select(F.col("conv").alias("base"), "at", "key", "words")
    size = own.where("at = 0").select(F.col("conv").alias("base"), F.col("of").alias("base_of"))
    convs = materialise(convs.join(size, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_of", F.lit(0))).alias("lent"), F.greatest(F.lit(0), F.col("own_of") - F.col("h")).alias("rest")), "convs")
    of = (F.col("lent") + F.col("rest")).alias("of")
    first = convs.join(lent, "base").where(F.col("at") < F.col("lent")).select("conv", "at", of, "key", "words")
    # nearly all turns: the first of a conversation says how it is rebuilt, so a conversation of any length is joined as it is spread
    then = join_one(own.drop("of"), convs.where("rest > 0").drop("base"), "conv").where(F.col("at") >= F.col("h"))
    then = then.select("conv", (F.col("at") - F.col("h") + F.col("lent")).alias("at"), of, "key", "words")
    return first.unionByName(then), convs.where("lent + rest = 0").select("conv")


ORACLE = rf"""
with o as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) as p, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
k as (select distinct c, c - c % 20 as b, {CRC32_SQL.format('cast(c as varchar)')} % 4 as h from o),
m as (select k.c, o.p as q, o.role, o.text from k join o on o.c = k.b and o.p <= k.h union all select k.c, 100 + o.p, o.role, o.text from k join o on o.c = k.c and o.p > k.h),
r as (select c, row_number() over (partition by c order by q) as d, role, text from m),
x as (select c, d, text, md5(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '' order by d) over (partition by c order by d rows unbounded preceding)) as g, count(*) over (partition by c) as n from r
  union all select k.c, 0, '', '', coalesce(l.n, 0) from k left join (select c, count(*) as n from r group by c) l on l.c = k.c),
nd as (select g, min(c) as c, any_value(d) as d, count(*) as n, (any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) * (count(*) - 1))::bigint as saved, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where d = n), '')) as ends from x group by g),
up as (select nd.g, p.g as pg from nd join x p on p.c = nd.c and p.d = nd.d - 1),
ch as (select pg, count(*) as n from up group by pg),
su as (select a.g, sum(nd.saved)::bigint as saved, sum((ch.n is null)::int)::bigint as leaves from nd left join ch on ch.pg = nd.g join x a on a.c = nd.c and a.d <= nd.d group by a.g)
select nd.c as conv_id, nd.d::bigint as depth, pn.c as parent_conv_id, nd.n::bigint as n_convs, coalesce(ch.n, 0)::bigint as n_children, su.leaves as n_leaves, su.saved as saved_tokens, nd.ends as ends_sha256
from nd left join up on up.g = nd.g left join nd pn on pn.g = up.pg left join ch on ch.pg = nd.g join su on su.g = nd.g
"""
