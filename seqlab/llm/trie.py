"""The prefix trie of conversations: what sharing their first turns saves, by the Euler-tour technique.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Every node gives an
enter arc and an exit arc of a tour that walks the trie depth first. list_rank() finds each arc's place in the tour;
prefix sums at these places, of the leaves entered and of what entered nodes save, differ between a node's exit and
enter by its subtree's share.

Nothing but 16-byte keys moves after the texts are read: a turn gives two 64-bit hashes with its position, and the key
of a sequence is the xor of its turns', so a long conversation is worked on by ranges of rows, of which only the ends
meet. Siblings have consecutive numbers, as nodes are numbered in the order of their parents, so the links of all arcs
come from the numbers of parent and children. A parent with very many children is joined by parts, and the member ids
of a sequence with very many copies are joined to strings by ranges before they meet.

Edge cases: rows are ordered by turn (null first), then by role and a hash of the text, repeated rows are turns of their
own; null roles and texts are empty; rows with a null conv_id are one conversation, which isn't the smallest member
unless it is the only one, and which leaves no id in ends_sha256; no rows give no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.series import with_ordinal
from .common import dealt, hot_keys, materialize, repeated

#: Below so many list elements the rest of a list is ranked in one task.
SMALL = 1 << 16
#: The key of the empty sequence.
_ROOT = bytearray(16)


def _long(x: Column) -> Column:
    return F.lpad(F.hex(x), 16, "0")


def _key() -> Column:
    return F.unhex(F.concat(_long(F.col("x1")), _long(F.col("x2"))))


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with _range, written once: the range of a total order that a row is in."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def _running(ranged: DataFrame, conv: str, order: list[Column]) -> DataFrame:
    """ranged with seen, x1, x2: rows and xor of t1, t2 of the conversation, up to and with each row.

    Only the first conversation of a range can have begun before it; what it had so far comes from the last ones of
    the ranges before, one row each.
    """
    sums = [F.count("*").alias("seen"), F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2")]
    bounds = ranged.groupBy("_range").agg(F.min(F.struct(conv)).alias("first"), F.max(F.struct(conv)).alias("last"))
    bounds = bounds.select("_range", F.col("first")[conv].alias("first"), F.col("last")[conv].alias("last"))
    ends = ranged.join(F.broadcast(bounds.select("_range", F.col("last"))), "_range").where(F.col(conv).eqNullSafe(F.col("last"))).groupBy("_range", "last").agg(*sums)
    along = Window.orderBy("_range")
    upto = Window.partitionBy("last").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select("_range", "last", F.sum("seen").over(upto).alias("seen"), F.bit_xor("x1").over(upto).alias("x1"), F.bit_xor("x2").over(upto).alias("x2"))
    same = ends.select(F.col("_range"), *(F.lag(c).over(along).alias(f"_{c}") for c in ("last", "seen", "x1", "x2")))  # one row per range
    carried = bounds.select("_range", "first").join(same, "_range").where(F.col("first").eqNullSafe(F.col("_last"))).drop("_last")
    carried = carried.where("_seen is not null").select("_range", F.struct("first", "_seen", "_x1", "_x2").alias("carried"))
    inside = Window.partitionBy("_range", conv).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = ranged.select("*", F.count("*").over(inside).alias("seen"), F.bit_xor("t1").over(inside).alias("x1"), F.bit_xor("t2").over(inside).alias("x2"))
    held = here.join(F.broadcast(carried), "_range", "left")  # a row per range at most
    mine = F.col("carried").isNotNull() & F.col("carried.first").eqNullSafe(F.col(conv))
    return held.withColumns(
        {
            "seen": F.col("seen") + F.when(mine, F.col("carried._seen")).otherwise(0),
            "x1": F.col("x1").bitwiseXOR(F.when(mine, F.col("carried._x1")).otherwise(0)),
            "x2": F.col("x2").bitwiseXOR(F.when(mine, F.col("carried._x2")).otherwise(0)),
        }
    ).drop("carried")


def _tagged(place: str) -> list[Column]:
    """Two hashes of a turn at its place."""
    return [F.xxhash64(place, "h1", "h2").alias("t1"), F.xxhash64("h2", F.lit("second"), place, "h1").alias("t2")]


def turns_of(rows: DataFrame) -> DataFrame:
    """conv, place (from 0), h1 and h2 (hashes of role and text), bytes of the text, of each turn of rows (conv_id, turn, role, text)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    flat = rows.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), F.xxhash64(role, text).alias("h1"), F.xxhash64(text, F.lit("second"), role).alias("h2"), F.octet_length(text).cast("long").alias("bytes"))
    ranged = _ranged(flat.withColumns({"t1": F.lit(0).cast("long"), "t2": F.lit(0).cast("long")}), ["conv", "turn", "role", "h1", "h2"])
    numbered = _running(ranged, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("h1"), F.col("h2")])
    return numbered.select("conv", (F.col("seen") - 1).alias("place"), "h1", "h2", "bytes")


def shared_starts(turns: DataFrame, group: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations (all, with the head they take), and their turns after conversation c took the first turns of c - c % group.

    The head of c has crc32(c) % longest turns of the other conversation, or as many as it has; c's own turns follow from
    there on. Heads are short, so joining them moves fewer than longest rows a conversation; own turns are joined to
    their conversation by parts where it has very many.
    """
    turns = materialize(turns, "turns")
    counts = materialize(turns.groupBy("conv").agg(F.count("*").alias("n")), "conversations")
    wanted = (F.crc32(F.coalesce(F.col("conv").cast("string"), F.lit(""))) % longest).alias("h")
    convs = counts.select("conv", "n", wanted, (F.col("conv") - F.col("conv") % group).alias("base"))
    first = turns.where(F.col("place") < longest - 1).select(F.col("conv").alias("base"), "place", "h1", "h2", "bytes")
    heads = materialize(convs.join(first, "base").where("place < h").select("conv", "place", "h1", "h2", "bytes"), "heads")
    taken = heads.groupBy("conv").agg(F.count("*").alias("taken"))
    convs = materialize(convs.join(taken, "conv", "left").select("conv", "n", "h", F.coalesce("taken", F.lit(0)).alias("taken")), "taken")
    total = convs.agg(F.sum("n")).first()[0] or 0
    named, nameless = F.col("conv").isNotNull(), F.col("conv").isNull()
    hot = hot_keys(convs.where(named).select("conv", "n"), ["conv"], total)
    own = dealt(turns.where(named), hot, ["conv"], "place").join(repeated(convs.select("conv", "h", "taken"), hot, ["conv"]), ["conv", "_salt"]).drop("_salt")
    own = own.where("place >= h").withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    lone = turns.where(nameless)  # crc32 of nothing is 0: the conversation without an id keeps its turns
    columns = ["conv", "place", "h1", "h2", "bytes"]
    return convs.select("conv"), heads.select(columns).union(own.select(columns)).union(lone.select(columns))


def nodes_of(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, parent, depth, conv_id, n_convs, bytes) and where each conversation ends (conv, key)."""
    ranged = _ranged(turns.select("conv", "place", "bytes", *_tagged("place")), ["conv", "place"])
    each = _running(ranged, "conv", [F.col("place")])
    before = F.unhex(F.concat(_long(F.col("x1").bitwiseXOR(F.col("t1"))), _long(F.col("x2").bitwiseXOR(F.col("t2")))))
    each = materialize(each.select("conv", F.col("seen").alias("depth"), "bytes", _key().alias("key"), F.when(F.col("place") == 0, F.lit(_ROOT)).otherwise(before).alias("parent")), "members")
    inner = each.groupBy("key", "depth").agg(F.first("parent").alias("parent"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"))
    root = convs.groupBy().agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(_ROOT).alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"))
    last = each.groupBy(F.struct("conv").alias("c")).agg(F.max_by("key", "depth").alias("key"))
    ends = convs.select(F.struct("conv").alias("c")).join(last, "c", "left").select(F.col("c.conv").alias("conv"), F.coalesce("key", F.lit(_ROOT)).alias("key"))
    return inner.unionByName(root), ends


def ends_digest(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of the ascending, comma-joined ids of the conversations (conv, key) that end there.

    Ranges of (key, conv) are joined to strings in batches; a digest then reads the strings of its key in order, one
    at a time, whatever their number.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.where(F.col("conv").isNotNull()).repartitionByRange(n, "key", "conv").withColumn("range", F.spark_partition_id()).sortWithinPartitions("key", "conv")

    def pieces(batches) -> Iterator[pa.RecordBatch]:
        place = 0
        for batch in batches:
            if not len(batch):
                continue
            keys, ids = np.array(batch.column("key").to_pylist(), object), batch.column("conv").to_pylist()
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1])]
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(starts, [*starts[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[a] for a in starts], pa.binary()), pa.array([batch.column("range")[0].as_py()] * len(texts), pa.int32()), pa.array(range(place, place + len(texts)), pa.int64()), pa.array(texts, pa.string())],
                ["key", "range", "place", "ids"],
            )
            place += len(texts)

    def digests(batches) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    digest.update(b"," + ids.encode())
                else:
                    if digest is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(ids.encode())
            yield _digests(done)
        yield _digests([(key, digest.hexdigest())] if digest is not None else [])

    joined = ranged.select("key", "conv", "range").mapInArrow(pieces, "key binary, range int, place long, ids string")
    return joined.repartition(n, "key").sortWithinPartitions("key", "range", "place").mapInArrow(digests, "key binary, ends_sha256 string")


def _digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], ["key", "ends_sha256"])


def linked(nodes: DataFrame) -> DataFrame:
    """nodes with id (siblings are consecutive), parent_id, parent_conv_id, lo and hi (ids of the children), from and upto (of the siblings)."""
    numbered = materialize(with_ordinal(nodes, [F.col("parent").asc_nulls_first(), F.col("key"), F.col("depth")], "id"), "numbered")
    families = materialize(numbered.where("parent is not null").groupBy("parent").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")), "families")
    parents = numbered.join(families.select(F.col("parent").alias("key"), "lo", "hi"), "key", "left")
    parents = materialize(parents, "parents")
    hot = hot_keys(families.select("parent", "n"), ["parent"], families.agg(F.sum("n")).first()[0] or 0)
    above = parents.where("lo is not null").select(F.col("key").alias("parent"), F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"), F.col("lo").alias("from"), F.col("hi").alias("upto"))
    children = dealt(parents.where("parent is not null"), hot, ["parent"], "id").join(repeated(above, hot, ["parent"]), ["parent", "_salt"]).drop("_salt")
    none = F.lit(None).cast("long")
    roots = parents.where("parent is null").withColumns({"parent_id": none, "parent_conv_id": F.lit(None).cast(nodes.schema["conv_id"].dataType), "from": none, "upto": none})
    return children.unionByName(roots)


def tour(family: DataFrame) -> DataFrame:
    """The arcs of the depth-first walk: arc (2 id on entering, 2 id + 1 on leaving), before and after (arcs; -1 at the ends)."""
    none = F.lit(-1).cast("long")
    id_, lo, hi, parent = F.col("id"), F.col("lo"), F.col("hi"), F.col("parent_id")
    enter = F.struct(
        (2 * id_).alias("arc"),
        F.when(parent.isNull(), none).when(id_ > F.col("from"), 2 * (id_ - 1) + 1).otherwise(2 * parent).alias("before"),
        F.coalesce(2 * lo, 2 * id_ + 1).alias("after"),
    )
    leave = F.struct(
        (2 * id_ + 1).alias("arc"),
        F.coalesce(2 * hi + 1, 2 * id_).alias("before"),
        F.when(parent.isNull(), none).when(id_ < F.col("upto"), 2 * (id_ + 1)).otherwise(2 * parent + 1).alias("after"),
    )
    return family.select(F.inline(F.array(enter, leave)))


def list_rank(arcs: DataFrame, small: int = SMALL) -> DataFrame:
    """arc, place: how many arcs come before it in its doubly linked list (arc, before, after; -1 at the ends).

    Each round takes out the arcs whose hash is above both neighbours' (about a third, no two adjacent): the arc before
    takes over their length and remembers the own one. Once few are left, they are ranked in one task; then the rounds
    are undone in turn, and each arc taken out starts where the own length of the arc before it ends. All rounds
    together move a few times the rows of the first.
    """
    live = materialize(arcs.select("arc", "before", "after", F.lit(1).cast("long").alias("length")), "list")
    rounds: list[DataFrame] = []
    while live.count() > small:
        salt = F.lit(len(rounds))
        mine, left, right = (F.xxhash64(F.col(c), salt) for c in ("arc", "before", "after"))
        above = lambda c, other: (F.col(c) == -1) | (mine > other) | ((mine == other) & (F.col("arc") > F.col(c)))
        out = (F.col("before") != -1) & above("before", left) & above("after", right)
        marked = materialize(live.withColumn("out", out), "marked")
        none = F.lit(None).cast("long")
        kept = marked.where("not out").select("arc", F.struct("before", "after", "length").alias("own"), none.alias("gone"), none.alias("gain"), none.alias("next"), none.alias("prior"))
        gone = marked.where("out")
        own = F.lit(None).cast(kept.schema["own"].dataType)
        to_left = gone.select(F.col("before").alias("arc"), own.alias("own"), F.col("arc").alias("gone"), F.col("length").alias("gain"), F.col("after").alias("next"), none.alias("prior"))
        to_right = gone.where("after <> -1").select(F.col("after").alias("arc"), own.alias("own"), none.alias("gone"), none.alias("gain"), none.alias("next"), F.col("before").alias("prior"))
        names = ("own", "gone", "gain", "next", "prior")
        met = kept.union(to_left).union(to_right).groupBy("arc").agg(*(F.max(c).alias(c) for c in names))
        met = materialize(met, "met")
        rounds.append(met.where("gone is not null").select("arc", "gone", F.col("own.length").alias("length")))
        live = met.select("arc", F.coalesce("prior", "own.before").alias("before"), F.coalesce("next", "own.after").alias("after"), (F.col("own.length") + F.coalesce("gain", F.lit(0))).alias("length"))
    ranked = materialize(live.coalesce(1).mapInArrow(_walk, "arc long, place long"), "ranked")
    for taken in reversed(rounds):
        back = taken.join(ranked, "arc").select(F.col("gone").alias("arc"), (F.col("place") + F.col("length")).alias("place"))
        ranked = materialize(ranked.union(back), "ranked")
    return ranked


def _walk(batches) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    arc, before, after, length = (table.column(c).to_numpy() for c in ("arc", "before", "after", "length"))
    row = {a: i for i, a in enumerate(arc.tolist())}
    at, place, places, next_ = row[int(arc[before == -1][0])], 0, np.full(len(arc), -1), after.tolist()
    while places[at] < 0:
        places[at] = place
        place += int(length[at])
        at = row.get(next_[at], at)
    if (places < 0).any():
        raise ValueError("the arcs are not one list")
    yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(places)], ["arc", "place"])


def prefix_sums(places: DataFrame, amounts: list[str], chunk: int = 1 << 16) -> DataFrame:
    """places (arc, place, amounts) with each amount replaced by its sum over all earlier places, by ranges of places."""
    ranged = places.withColumn("_chunk", F.floor(F.col("place") / chunk))
    along = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_chunk").agg(*(F.sum(a).alias(a) for a in amounts))
    before = sums.select("_chunk", *(F.coalesce(F.sum(a).over(along), F.lit(0)).alias(f"_{a}") for a in amounts))  # one row per chunk
    inside = Window.partitionBy("_chunk").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(before, "_chunk").select("arc", "place", *((F.coalesce(F.sum(a).over(inside), F.lit(0)) + F.col(f"_{a}")).cast("long").alias(a) for a in amounts))


def subtrees(family: DataFrame, small: int = SMALL) -> DataFrame:
    """id, n_leaves, saved: the childless nodes of each node's subtree, and its sum of saved, by prefix sums along the tour."""
    places = list_rank(tour(family), small)
    leaf = F.when(F.col("lo").isNull(), 1).otherwise(0).cast("long")
    entered = family.select((2 * F.col("id")).alias("arc"), leaf.alias("leaves"), F.col("saved"))
    summed = prefix_sums(places.join(entered, "arc", "left").na.fill(0, ["leaves", "saved"]), ["leaves", "saved"])
    sign = F.when(F.col("arc") % 2 == 1, 1).otherwise(-1)
    return summed.groupBy(F.floor(F.col("arc") / 2).alias("id")).agg(F.sum(sign * F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved"))


def trie(convs: DataFrame, turns: DataFrame, small: int = SMALL) -> DataFrame:
    """All nodes of conversations (conv) with turns (conv, place, h1, h2, bytes).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes of last texts
    that the copies in the subtree need not repeat), ends_sha256.
    """
    nodes, ends = nodes_of(convs, turns)
    family = linked(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")))
    family = materialize(family, "family")
    held = family.join(subtrees(family, small).withColumnRenamed("saved", "saved_tokens"), "id").join(ends_digest(ends), "key", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return held.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce(F.col("hi") - F.col("lo") + 1, F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def rebuilt_trie(rows: DataFrame, group: int = 5, longest: int = 9, small: int = SMALL) -> DataFrame:
    """trie() of rows (conv_id, turn, role, text) after shared_starts()."""
    convs, turns = shared_starts(turns_of(rows), group, longest)
    return trie(convs, turns, small)
