"""Chat formatting into a prefix tree.

Turns are marked by a template, and control strings inside roles and texts are escaped reversibly. Conversations that
share their first turns share those nodes of a tree. In depth-first order each distinct conversation is a segment of
one stream: it emits only the turns that no earlier one has emitted, with the position its first token has in the
conversation, and the intervals of the stream that its tokens attend to besides their own segment (its ancestors).
Tokens are code points here, so a tokenizer that works turn by turn can be put in their place.

Depth-first order is the order of the paths of turn hashes, so a sort by ranges makes it; offsets come from the sums
of the ranges. No tree, however many conversations share its first turn, has to be in one task: turns that very many
share are joined to their owner by parts. Only the turns of one conversation are gathered in one row.

Edge cases: a null role or text is empty; null turns come first, equal turns are ordered by role and text; repeated
rows are turns of their own; rows with a null conv_id form one conversation; equal conversations share one segment;
one that begins another is a segment that emits its own turns; columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dealt, hot_keys, materialize, repeated

#: The marks of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    """Puts a backslash after each `<` that begins `<|`, `<\\|`, `<\\\\|` and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As escape; line ends and backslashes of a role become \\n and \\\\."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, leaf, path, and keys, turns, starts per turn, of rows (conv_id, turn, role, text).

    A turn's key hashes it and all before it; leaf is the last key, path the keys as sortable bytes; starts are positions.
    """
    blank = F.lit("")
    role, text = F.coalesce(F.col("role"), blank), F.coalesce(F.col("text"), blank)
    turn = F.struct("turn", role.alias("role"), text.alias("text"))
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    marked = grouped.withColumn(
        "turns",
        F.transform(
            "t",
            lambda t: F.struct(
                F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == LEARNT).alias("learnt")
            ),
        ),
    ).select("conv_id", "turns")
    whole = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    first = F.struct(F.array().cast("array<string>").alias("keys"), F.lit("").alias("last"))

    def chain(done, turn):
        key = F.substring(F.sha2(F.concat(done["last"], turn), 256), 1, 32)
        return F.struct(F.concat(done["keys"], F.array(key)).alias("keys"), key.alias("last"))

    def add(done, turn):
        return F.concat(done, F.array(F.element_at(done, -1) + F.char_length(turn)))

    hashed = marked.withColumn("whole", whole)
    hashed = hashed.withColumn("keys", F.aggregate("whole", first, chain)["keys"]).withColumn("starts", F.aggregate("whole", F.array(F.lit(0)), add))
    return hashed.select("conv_id", F.element_at("keys", -1).alias("leaf"), F.unhex(F.array_join(F.transform("keys", lambda k: F.substring(k, 1, 24)), "")).alias("path"), "keys", "turns", "starts")


def pack(chats: DataFrame, partitions: int | None = None) -> DataFrame:
    """The stream: one row per distinct conversation of conversations().

    leaf, part and place (its order), offset, position (of its first token), length, text, learnt (intervals of text
    under the loss mask, as stream offsets), attends (the ancestors' intervals: depth, leaf that emits it, lo, hi).
    """
    spark = chats.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = chats.groupBy("leaf").agg(*(F.first(c).alias(c) for c in ("path", "keys", "turns", "starts")))
    ranged = leaves.repartitionByRange(partitions, "path").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "leaves")
    ranked = ranged.select("leaf", "part", "keys", "starts", F.row_number().over(Window.partitionBy("part").orderBy("path")).alias("place"))
    ranked = materialize(ranked, "ranked")
    turns = F.arrays_zip("keys", F.col("starts").alias("lo"), F.slice("starts", 2, F.size("keys")).alias("hi"))
    nodes = ranked.select("leaf", "part", "place", F.posexplode(F.slice(turns, 1, F.size("keys"))).alias("depth", "turn"))
    nodes = nodes.select("leaf", "part", "place", "depth", F.col("turn.keys").alias("key"), F.col("turn.lo").alias("lo"), F.col("turn.hi").alias("hi"))
    owners = materialize(nodes.groupBy("key").agg(F.min(F.struct("part", "place", "leaf")).alias("owner"), F.count("*").alias("n")), "owners")
    hot = hot_keys(owners, ["key"], _sum(owners))
    owned = dealt(nodes, hot, ["key"], "leaf").join(repeated(owners.drop("n"), hot, ["key"]), ["key", "_salt"])
    owned = materialize(owned.withColumn("mine", F.col("owner.leaf") == F.col("leaf")), "nodes")
    segments = owned.groupBy("leaf", "part", "place").agg(
        F.coalesce(F.min(F.when(F.col("mine"), F.col("lo"))), F.max("hi")).alias("position"), F.max("hi").alias("end"), F.coalesce(F.min(F.when(F.col("mine"), F.col("depth"))), F.max("depth") + 1).alias("skip")
    )
    segments = segments.withColumn("length", (F.col("end") - F.col("position")).cast("long"))
    sums = segments.groupBy("part").agg(F.sum("length").alias("total"))
    before = sums.select("part", F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    along = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.join(F.broadcast(before), "part").withColumn("offset", F.coalesce("before", F.lit(0)) + F.coalesce(F.sum("length").over(along), F.lit(0)))
    placed = materialize(placed.select("leaf", "offset", "position", "length", "skip"), "segments")
    source = placed.select(F.col("leaf").alias("from"), (F.col("offset") - F.col("position")).alias("shift"))
    shared = owned.where("not mine").select("leaf", "depth", "lo", "hi", F.col("owner.leaf").alias("from")).groupBy("leaf", "from").agg(F.min("depth").alias("depth"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    shared = materialize(shared, "shared")
    descendants = materialize(shared.groupBy("from").agg(F.count("*").alias("n")), "descendants")
    hot = hot_keys(descendants, ["from"], _sum(descendants))
    ancestors = dealt(shared, hot, ["from"], "leaf").join(repeated(source, hot, ["from"]), ["from", "_salt"]).select("leaf", F.struct("depth", "from", (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi")).alias("x"))
    ancestors = ancestors.groupBy("leaf").agg(F.sort_array(F.collect_list("x")).alias("attends"))
    own = F.slice("turns", F.col("skip") + 1, F.greatest(F.size("turns") - F.col("skip"), F.lit(0)))
    lows = F.slice("starts", F.col("skip") + 1, F.greatest(F.size("turns") - F.col("skip"), F.lit(0)))
    shift = F.col("offset") - F.col("position")
    spans = F.zip_with(
        own, lows,
        lambda t, lo: F.struct((lo + F.char_length(t["head"]) + shift).alias("lo"), (lo + F.char_length(t["head"]) + F.char_length(t["body"]) + shift).alias("hi"), t["learnt"].alias("learnt")),
    )
    texts = ranged.select("leaf", "part", "turns", "starts").join(placed, "leaf").join(ancestors, "leaf", "left")
    return texts.select(
        "leaf", "part", "offset", "position", "length",
        F.array_join(F.transform(own, lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("text"),
        F.transform(F.filter(spans, lambda s: s["learnt"]), lambda s: F.struct(s["lo"], s["hi"])).alias("learnt"),
        F.coalesce("attends", F.array().cast("array<struct<depth:int,from:string,lo:bigint,hi:bigint>>")).alias("attends"),
    )


def _sum(counts: DataFrame) -> int:
    return counts.agg(F.sum("n")).first()[0] or 0


def unpack(stream: DataFrame) -> DataFrame:
    """leaf, formatted and learnt (the texts under the mask) of each segment's whole conversation, read from the stream alone."""
    pieces = stream.select("leaf", F.explode(F.concat("attends", F.array(F.struct(F.lit(1 << 30).alias("depth"), F.col("leaf").alias("from"), F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"))))).alias("x"))
    pieces = pieces.select("leaf", F.col("x.depth").alias("depth"), F.col("x.from").alias("from"), F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))
    counts = materialize(pieces.groupBy("from").agg(F.count("*").alias("n")), "readers")
    hot = hot_keys(counts, ["from"], _sum(counts))
    emitted = stream.select(F.col("leaf").alias("from"), "offset", "text", F.col("learnt").alias("spans"))
    held = dealt(pieces, hot, ["from"], "leaf").join(repeated(emitted, hot, ["from"]), ["from", "_salt"])

    def cut(lo, hi):
        return F.substring(F.col("text"), (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int"))

    inside = F.filter("spans", lambda s: (s["lo"] >= F.col("lo")) & (s["hi"] <= F.col("hi")))
    read = held.select("leaf", F.struct("depth", cut(F.col("lo"), F.col("hi")).alias("text"), F.transform(inside, lambda s: cut(s["lo"], s["hi"])).alias("learnt")).alias("x"))
    read = read.groupBy("leaf").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return read.select("leaf", F.array_join(F.transform("x", lambda p: p["text"]), "").alias("formatted"), F.transform(F.flatten(F.transform("x", lambda p: p["learnt"])), unescape).alias("learnt"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda b: b != "")
    bodies = F.transform(blocks, lambda b: F.substring(b, len(START) + 1, 1 << 30))
    return F.transform(
        bodies, lambda b: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substring(b, F.char_length(F.substring_index(b, "\n", 1)) + 2, F.lit(1 << 30))).alias("text"))
    )


def digest_read_back(rows: DataFrame) -> DataFrame:
    """Packs rows (conv_id, turn, role, text), reads every conversation back from the stream and describes it.

    conv_id, n_turns, turns_sha256 (role, line end, text, line end per turn), loss_chars and loss_sha256 (of the
    texts under the mask, unescaped), formatted_chars.
    """
    chats = materialize(conversations(rows), "chats")
    back = unpack(materialize(pack(chats), "stream")).withColumn("turns", parse(F.col("formatted")))
    said, learnt = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), F.array_join("learnt", "")
    digests = back.select(
        "leaf",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    counts = materialize(chats.groupBy("leaf").agg(F.count("*").alias("n")), "equals")
    hot = hot_keys(counts, ["leaf"], _sum(counts))
    return dealt(chats.select("conv_id", "leaf"), hot, ["leaf"], "conv_id").join(repeated(digests, hot, ["leaf"]), ["leaf", "_salt"]).drop("leaf", "_salt")
