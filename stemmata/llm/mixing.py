"""Mixing sources to target weights (operator 2, DataFrame functions only).

Each source's documents form one stream of words, cut into blocks of BLOCK_WORDS. A mix has SHARD_SLOTS slots a shard.
How many slots of a shard go to each source is drawn multinomially under the condition that the totals over all
shards meet the targets: one keyed permutation of all slots gives every slot a place in the sources' joint list, and
so a source and a running number within it. The running number modulo the source's blocks, put through the source's
own keyed permutation, is the block that fills the slot: every epoch takes each block once, the last one a
pseudorandom part of them. Blocks are then joined by index. Permutations are swap-or-not shuffles (Hoang, Morris and
Rogaway 2012), which are exact on any domain; each round has a key of 60 bits of its own, and whether it swaps hangs
on squares modulo a prime, so that rounds don't add up to a line. Reruns agree.

Targets: sources in code-point order, null last, weigh 1, 2, 3 and so on, repeating; a target stops at 3 times the
source's words and the excess goes to the others by weight, again and again until none is above. Null texts have size
0 and are never taken; a null source is a source of its own. Rows that repeat an id count as rows. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BUCKET_ROWS, bucket_count, in_range, lookup, materialise, ranked, running_start, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
MAX_REPEATS = 3
ROUNDS = 20
#: Slots that a task deals out.
TASK_SLOTS = 1 << 17
PRIME = 2147483647
#: A whole copy in the fixed-point numbers of ``mixed_documents``.
WHOLE = 1 << 30


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))


def scramble(x: Column) -> Column:
    """A number under PRIME from any long."""
    return F.pmod(F.pmod(x, F.lit(PRIME)) * 48271 + 11, F.lit(PRIME))


def round_keys(key: int) -> list[tuple[str, str]]:
    """The keys of the rounds of the permutation that a number names, as SQL."""
    made = [hashlib.md5(f"{key}:{r}".encode()).hexdigest() for r in range(1, ROUNDS + 1)]
    return [(f"{int(h[:15], 16)}L", f"{int(h[16:23], 16)}L") for h in made]


def with_round_keys(df: DataFrame, key: str) -> DataFrame:
    """Adds the same keys as arrays ``moves`` and ``salts``, whose elements are ROUND_COLUMNS."""
    digests = F.transform(F.sequence(F.lit(1), F.lit(ROUNDS)), lambda r: F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), r.cast("string"))))
    number = lambda h, at, n: F.conv(F.substring(h, at, n), 16, 10).cast("long")
    return df.withColumns({"moves": F.transform(digests, lambda h: number(h, 1, 15)), "salts": F.transform(digests, lambda h: number(h, 17, 7))})


ROUND_COLUMNS = [(f"moves[{r}]", f"salts[{r}]") for r in range(ROUNDS)]


def permuted(df: DataFrame, x: str, n: str, rounds: list[tuple[str, str]]) -> DataFrame:
    """Replaces ``x`` by its image under the permutation of 0..n-1 (``n``: SQL) with the keys ``rounds``. Every round
    is a few plain columns, for which code is generated: the place to change with, the pair's number mixed with the
    round's salt, and the place after the round."""
    kept = [c for c in df.columns if c != x]
    df = df.withColumnRenamed(x, "_at")
    for move, salt in rounds:
        df = df.selectExpr(*kept, "_at", f"({move} % {n} + {n} - _at) % {n} AS _other")
        pair = "greatest(_at, _other)"
        df = df.selectExpr(*kept, "_at", "_other", f"(({pair} & {PRIME}) * 48271 + shiftright({pair}, 31) * 69621 + {salt}) % {PRIME} AS _mixed")
        square = f"(_mixed * _mixed + {salt}) % {PRIME}"
        df = df.selectExpr(*kept, f"if(shiftright((({square}) * ({square}) + _mixed) % {PRIME}, 10) % 2 = 1, _other, _at) AS _at")
    return df.withColumnRenamed("_at", x)


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds rank (from 1), weight and target to one row per source with ``source`` and ``words``. The driver sees sums
    over the sources only, once for every time that an excess is shared again."""
    found = ranked(sources, F.col("source").asc_nulls_last())
    found = found.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", F.col("words") * MAX_REPEATS)
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") < F.col("weight") * F.lit(level)
        words, caps, weights, now = found.agg(F.sum("words"), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if now == capped or not weights:
            break
        level, capped = (words - (caps or 0)) / weights, now
    return found.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))).drop("cap")


def mix_slots(plan: DataFrame, slots: int) -> DataFrame:
    """One row per slot of the mix: shard, slot, rank, epoch, block. ``plan``: a row per source with rank, blocks,
    draws and start (of the source's draws in the joint list)."""
    drawn = plan.sparkSession.range(0, slots, 1, max(1, -(-slots // TASK_SLOTS))).select(F.col("id").alias("slot"), F.col("id").alias("place"))
    # Written out, since the optimiser would push a join's null checks through all rounds, doubling them in each.
    drawn = materialise(permuted(drawn, "place", f"{max(slots, 1)}L", round_keys(0)), "places")
    ranges = with_round_keys(plan.withColumnRenamed("draws", "length"), "rank")
    found = in_range(drawn, "place", ranges, plan.count(), slots).withColumn("number", F.col("place") - F.col("start"))
    found = found.withColumns({"epoch": F.expr("number div blocks"), "block": F.expr("number % blocks")})
    filled = permuted(found, "block", "blocks", ROUND_COLUMNS)
    return materialise(filled.select(F.expr(f"slot div {SHARD_SLOTS}").alias("shard"), "slot", "rank", "epoch", "block"), "slots")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, *, by_row: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row per row of ``docs`` (doc_id, size, source_size, target, taken), and the slots of the mix.
    ``by_row`` adds row_key, source_key and text_hash to the first."""
    sized = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("row_key"),
            *([F.xxhash64(text_or_empty()).alias("text_hash")] if by_row else []),
        ).withColumn("source_key", source_key()),
        "sizes",
    )
    rows = sized.count()
    sources = sized.groupBy("source_key", "source").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    blocks = F.ceil(F.col("words") / block_words)
    draws = F.when(F.col("words") > 0, F.floor(F.col("target") * blocks / F.col("words") + 0.5)).otherwise(0).cast("long")
    plan = source_targets(sources).withColumn("blocks", blocks).withColumn("draws", draws).withColumn("part", F.expr(f"rank div {BUCKET_ROWS}"))
    plan = materialise(running_start(plan, [], ["part"], ["rank"], F.col("draws"), "start"), "plan")
    slots = plan.agg(F.sum("draws")).first()[0] or 0
    filled = mix_slots(plan.select("rank", "blocks", "draws", "start"), slots)

    owned = lookup(sized.drop("source"), plan.select("source_key", "rank", "rows", "words", "target"), "source_key", "rows", rows)
    bucket = (scramble(F.coalesce("doc_id", F.lit(0))) + F.col("size")) % bucket_count(rows)
    streamed = running_start(owned.withColumn("bucket", bucket), ["rank"], ["bucket"], ["doc_id", "size", "row_key"], F.col("size"), "first")
    end, at = F.col("first") + F.col("size"), F.col("block") * block_words
    last = F.floor((end - 1) / block_words)
    spans = streamed.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first") / block_words), last))))
    spans = spans.withColumn("part", F.least(end, at + block_words) - F.greatest(F.col("first"), at))
    more = ["source_key", "text_hash"] if by_row else []
    times = filled.groupBy("rank", "block").agg(F.count("*").alias("times"))
    taken = (
        spans.join(times, ["rank", "block"], "left")
        .groupBy("row_key", "doc_id", "size", *more, F.col("words").alias("source_size"), "target")
        .agg(F.coalesce(F.sum(F.col("part") * F.col("times")), F.lit(0)).alias("taken"))
    )
    return taken if by_row else taken.drop("row_key"), filled


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in whole copies, taken / size of each on average: the whole part, and one more for a
    pseudorandom part of the rows. Which ones is a systematic draw along each source's rows by size, so that not only
    each row's expectation is right but also the source's words, to about a document. Rows that repeat id, source and
    text share their copies."""
    taken = materialise(mix(docs, by_row=True)[0].where("size > 0"), "taken")
    part = F.expr(f"(taken % size) * {WHOLE}L div size")
    placed = taken.withColumn("class", F.floor(F.log2("size") * 4)).withColumn("slice", scramble(F.col("row_key")) % bucket_count(taken.count(), 16 * BUCKET_ROWS))
    placed = running_start(placed.withColumn("part", part), ["source_key"], ["class", "slice"], ["size", "row_key"], F.col("part"), "before")
    placed = placed.withColumn("before", F.col("before") + F.pmod(F.xxhash64("source_key"), F.lit(WHOLE)))
    copies = F.expr(f"taken div size + (before + part) div {WHOLE}L - before div {WHOLE}L")
    key = ["doc_id", "source_key", "text_hash"]
    shares = placed.groupBy(*key).agg(F.sum(copies).alias("copies"), F.count("*").alias("sharers")).where("copies > 0")
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), source_key().alias("own_source"), F.xxhash64(text_or_empty()).alias("own_hash")
    )
    joined = rows.join(shares, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_source") == F.col("source_key")) & (F.col("own_hash") == F.col("text_hash")))
    number = F.row_number().over(Window.partitionBy("own_id", "own_source", "own_hash").orderBy(F.xxhash64("row")))
    dealt = joined.withColumn("number", number).withColumn("times", F.expr("copies div sharers + if(number <= copies % sharers, 1, 0)"))
    return dealt.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
ranked AS (
  SELECT source, words, rank, (rank - 1) % 3 + 1 AS weight, words * {MAX_REPEATS} AS cap
  FROM (SELECT source, sum(size)::BIGINT AS words, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source)),
levels AS (
  SELECT *, ((SELECT sum(words) FROM ranked)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM ranked),
aimed AS (
  SELECT source, words, rank, least(cap::DOUBLE, weight * (SELECT arg_min(level, cap / weight * 1e6 + rank) FROM levels WHERE cap >= weight * level)) AS target FROM levels),
planned AS (
  SELECT *, CASE WHEN words > 0 THEN floor(target * blocks / words + 0.5) ELSE 0 END::BIGINT AS draws
  FROM (SELECT *, ceil(words / {BLOCK_WORDS})::BIGINT AS blocks FROM aimed)),
drawn AS (
  SELECT rank, blocks, unnest(range(draws)) % blocks AS x,
    list_transform(range(1, {ROUNDS + 1}), lambda r: ('0x' || substr(md5(rank || ':' || r), 1, 15))::BIGINT) AS moves,
    list_transform(range(1, {ROUNDS + 1}), lambda r: ('0x' || substr(md5(rank || ':' || r), 17, 7))::BIGINT) AS salts FROM planned WHERE draws > 0),
mixed AS (
  SELECT rank, list_reduce(range(1, {ROUNDS + 1}), lambda p, r: CASE WHEN ((SQUARE * SQUARE + MIXED) % {PRIME} >> 10) % 2 = 1 THEN OTHER ELSE p END, x) AS block FROM drawn),
times AS (SELECT rank, block, count(*) AS times FROM mixed GROUP BY rank, block),
streamed AS (
  SELECT doc_id, size, rank, words, target, sum(size) OVER (PARTITION BY rank ORDER BY (((coalesce(doc_id, 0) % {PRIME}) * 48271 + 11) % {PRIME} + size) % nb, doc_id, size)::BIGINT - size AS first
  FROM sized JOIN planned ON sized.source IS NOT DISTINCT FROM planned.source, (SELECT greatest(1, ceil(count(*) / {BUCKET_ROWS}))::BIGINT AS nb FROM documents)),
spans AS (
  SELECT *, unnest(range(first // {BLOCK_WORDS}, CASE WHEN size > 0 THEN (first + size - 1) // {BLOCK_WORDS} + 1 ELSE first // {BLOCK_WORDS} END)) AS block FROM streamed),
sums AS (
  SELECT doc_id, rank, first, sum((least(first + size, (block + 1) * {BLOCK_WORDS}) - greatest(first, block * {BLOCK_WORDS})) * times) AS taken
  FROM spans JOIN times USING (rank, block) GROUP BY doc_id, rank, first)
SELECT doc_id, size, words AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM streamed LEFT JOIN sums USING (doc_id, rank, first)
"""
for _name, _text in (
    ("SQUARE", f"((MIXED * MIXED + salts[r]) % {PRIME})"),
    ("MIXED", f"(((greatest(p, OTHER) & {PRIME}) * 48271 + (greatest(p, OTHER) >> 31) * 69621 + salts[r]) % {PRIME})"),
    ("OTHER", "((moves[r] % blocks + blocks - p) % blocks)"),
):
    ORACLE = ORACLE.replace(_name, _text)
