"""Sharding by balanced label propagation (operator 6, DataFrame functions only).

Nodes begin in pseudorandom shards of even size. In every round a node wants the shard that most of its neighbours
are in (ties: the smaller number) if that beats its own. Wishes from shard a to shard b are granted up to a quota:
as many as want the opposite way, plus what b has free under its capacity; which nodes move is decided by a hash of
the node and the round, so no task has to see all that want one shard. The flow table has shards squared rows.

Only linked nodes propagate; the others have no wishes and go wherever there is room in the end. A last step settles
the sizes exactly: a group's homes are the shards that most of it has gathered in, as many as it fills; it goes there
in chunks of a shard's size at most, the largest first. Chunks that find their home full, the large ones again first,
and after them the unlinked nodes are numbered through and fill what is free.

Law: ``rows``, counts of rows differ by one at most. Null texts have the size of none; documents of equal text are
linked, empty ones too: a group is one star for every shard that it could fill. Nodes are numbered in the order of a
hash of id and text, so that placement doesn't hang on how files are split. Rows that repeat an id are nodes of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, HOT_SHARE, bucket_count, in_range, lookup, materialise, running_start, text_or_empty

SHARDS = 40
ROUNDS = 6
#: Rows that a shard may hold beyond an even share while labels propagate.
SLACK = 0.3
ROW_BYTES = 16


def propagate(nodes: DataFrame, edges: DataFrame, shards: int, even: int, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """``nodes``: node (long, unique). ``edges``: u, v, each link once. ``even``: what a shard should hold. Returns
    (node, shard) after ``rounds`` rounds in which linked nodes gather, shards held to about ``even`` and ``slack``."""
    labels = materialise(nodes.select("node", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(shards)).cast("int").alias("shard")), "labels")
    both = materialise(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v"), "links")
    ends = both.count()
    degree = materialise(both.groupBy("v").agg(F.count("*").alias("degree")), "degrees")
    capacity = even * (1 + slack)
    for k in range(rounds):
        near = lookup(both, labels.join(degree, labels.node == degree.v).select("v", "degree", "shard"), "v", "degree", ends)
        # If both ends of a link could move at once they might swap places for ever: nodes hear their smaller
        # neighbours in even rounds and their larger ones in odd rounds.
        votes = near.where("v < u" if k % 2 == 0 else "v > u").groupBy("u", "shard").agg(F.count("*").alias("n"))
        ranked = F.col("n") * shards + (shards - 1 - F.col("shard"))
        best = votes.groupBy("u").agg(F.max(ranked).alias("top"))
        best = best.select(F.col("u").alias("node"), (shards - 1 - F.col("top") % shards).cast("int").alias("wish"), F.floor(F.col("top") / shards).alias("won"))
        own = votes.select(F.col("u").alias("node"), "shard", F.col("n").alias("held"))
        asked = labels.join(best, "node", "left").join(own, ["node", "shard"], "left")
        asked = asked.withColumn("wish", F.when((F.col("won") > F.coalesce("held", F.lit(0))) & (F.col("wish") != F.col("shard")), F.col("wish")))
        asked = materialise(asked.select("node", "shard", "wish"), "wishes")
        sizes = asked.groupBy("shard").agg(F.count("*").alias("size"))
        flows = asked.where("wish is not null").groupBy("shard", "wish").agg(F.count("*").alias("want"))
        opposite = flows.select(F.col("shard").alias("wish"), F.col("wish").alias("shard"), F.col("want").alias("back"))
        into = flows.groupBy("wish").agg(F.sum("want").alias("all_in"))
        room = sizes.select(F.col("shard").alias("wish"), F.greatest(F.lit(capacity) - F.col("size"), F.lit(0.0)).alias("room"))
        quota = (
            flows.join(opposite, ["shard", "wish"], "left").join(into, "wish").join(room, "wish", "left")
            .select("shard", "wish", ((F.least("want", F.coalesce("back", F.lit(0))) + F.coalesce("room", F.lit(capacity)) * F.col("want") / F.col("all_in")) / F.col("want")).alias("granted"))
        )
        chance = F.pmod(F.xxhash64("node", F.lit(k + 2)), F.lit(1 << 30)) / float(1 << 30)
        moved = asked.join(F.broadcast(quota), ["shard", "wish"], "left")  # shards squared rows at most
        labels = materialise(moved.select("node", F.when(chance < F.col("granted"), F.col("wish")).otherwise(F.col("shard")).alias("shard")), "labels")
    return labels


def numbered(rows: DataFrame, total: int) -> DataFrame:
    """Adds ``node``, from 0, in the order of ``h``; rows of equal ``h`` (a hash) in any order. Buckets of one frequent
    ``h`` are cut further."""
    often = rows.groupBy("h").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") * HOT_SHARE >= total))
    marked = rows.join(F.broadcast(often.select("h", F.lit(True).alias("often"))), "h", "left")  # HOT_SHARE rows at most
    buckets = bucket_count(total)
    cut = F.when(F.col("often"), F.pmod(F.xxhash64("row_key"), F.lit(buckets))).otherwise(F.lit(0))
    dealt = marked.withColumns({"bucket": F.pmod("h", F.lit(buckets)), "own": F.when(F.col("often"), F.col("h")).otherwise(F.lit(0)), "cut": cut})
    return running_start(dealt, [], ["bucket", "own", "cut"], ["h", "row_key"], F.lit(1), "node").drop("bucket", "own", "cut", "often", "row_key")


def homes(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, chunk, home): the shards that a group goes to, the one that holds most of it first."""
    held = members.join(labels, "node").groupBy("key", "chunks", "shard").agg(F.count("*").alias("n"))
    order = Window.partitionBy("key").orderBy(F.desc("n"), "shard")  # no more rows to a key than shards
    found = held.withColumn("chunk", (F.row_number().over(order) - 1).cast("long")).where("chunk < chunks")
    return found.select("key", "chunk", F.col("shard").alias("home"))


def chunked(members: DataFrame, labels: DataFrame, home: DataFrame, even: int) -> DataFrame:
    """(node, key, chunk, within): members of groups dealt into chunks of ``even`` rows; those that are in one of their
    group's homes already come first, home by home."""
    known = members.join(labels, "node").join(home.select("key", F.col("home").alias("shard"), F.col("chunk").alias("turn")), ["key", "shard"], "left")
    known = known.withColumn("turn", F.coalesce("turn", F.col("chunks")))
    cut = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BUCKET_ROWS))
    placed = running_start(known.withColumn("cut", cut), ["key"], ["turn", "cut"], ["node"], F.lit(1), "number")
    return placed.select("node", "key", F.expr(f"number div {even}").alias("chunk"), F.expr(f"number % {even}").alias("within"))


def placed_chunks(chunks: DataFrame, shards: int, total: int) -> tuple[DataFrame, DataFrame]:
    """``chunks``: key, chunk, size, home. They come back with ``begin``: where they begin in their home, or, those
    whose home has no room or that have none (``home`` is then null), in the common filling. The second table has the
    ``shard``s' ranges of the filling: start, length, used (by chunks that are at home)."""
    dealt = chunks.withColumns({"class": -F.floor(F.log2("size")), "cell": F.pmod(F.xxhash64("key", "chunk"), F.lit(bucket_count(total)))})
    at_home = dealt.where("home is not null").withColumn("shard", F.col("home"))
    inside = running_start(at_home, ["shard"], ["class", "cell"], ["key", "chunk"], F.col("size"), "begin").drop("shard")
    room = F.lit(total // shards) + (F.col("home") < total % shards).cast("long")
    inside = materialise(inside.withColumn("fits", F.col("begin") + F.col("size") <= room), "chunks")
    used = inside.where("fits").groupBy(F.col("home").alias("shard")).agg(F.sum("size").alias("used"))
    every = chunks.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(used, "shard", "left")
    free = (F.lit(total // shards) + (F.col("shard") < total % shards).cast("long") - F.coalesce("used", F.lit(0))).alias("length")
    before = Window.orderBy(F.desc("length"), "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    ranges = every.select("shard", F.coalesce("used", F.lit(0)).alias("used"), free)
    ranges = materialise(ranges.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0))), "ranges")
    rest = inside.where("not fits").drop("begin", "fits").unionByName(dealt.where("home is null")).withColumn("home", F.lit(None).cast("int"))
    outside = running_start(rest, [], ["class", "cell"], ["key", "chunk"], F.col("size"), "begin")
    found = inside.where("fits").drop("fits").unionByName(outside).select("key", "chunk", "size", "home", "begin")
    return materialise(found, "placed"), ranges


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size (UTF-8 bytes and 16), text_crc32, law, shard, slot, grown_shard."""
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text, 256).alias("key"),
    )
    rows = materialise(rows.withColumns({"h": F.xxhash64("doc_id", "key"), "row_key": F.monotonically_increasing_id()}), "rows")
    total = rows.count()
    even = max(1, total // shards)
    nodes = materialise(numbered(rows, total), "nodes")
    groups = materialise(nodes.groupBy("key").agg(F.count("*").alias("members")), "groups")
    groups = groups.withColumn("chunks", F.ceil(F.col("members") / even))
    members = materialise(lookup(nodes.select("node", "key"), groups.where("members > 1"), "key", "members", total), "members")
    stars = members.withColumn("star", F.pmod(F.xxhash64("node", F.lit(0)), F.col("chunks")))
    heads = stars.groupBy("key", "star").agg(F.min("node").alias("head"), F.count("*").alias("n"))
    edges = lookup(stars, heads, ["key", "star"], "n", total).where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"))
    labels = propagate(members.select("node"), edges, shards, even, rounds)
    home = materialise(homes(members, labels), "homes")
    dealt = materialise(chunked(members, labels, home, even), "dealt")
    chunks = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    chunks = chunks.join(home, ["key", "chunk"], "left").select("key", "chunk", F.least(F.lit(even), F.col("members") - F.col("chunk") * even).alias("size"), "home")
    placed, ranges = placed_chunks(chunks, shards, total)
    own = nodes.join(dealt.drop("key"), "node", "left").withColumns({"chunk": F.coalesce("chunk", F.lit(0)), "within": F.coalesce("within", F.lit(0))})
    facts = ["doc_id", own["size"].alias("size"), "text_crc32", "key", "chunk", "within"]
    own = materialise(lookup(own.select(*facts), placed.withColumnRenamed("size", "rows"), ["key", "chunk"], "rows", total).withColumn("place", F.col("begin") + F.col("within")), "own")
    out = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    filling = in_range(own.where("home is null"), "place", ranges, shards, max(1, total))
    filling = filling.withColumn("slot", F.col("used") + F.col("place") - F.col("start")).select(*out)
    return own.where("home is not null").withColumns({"shard": F.col("home"), "slot": F.col("place")}).select(*out).unionByName(filling)
