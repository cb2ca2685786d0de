"""Vector bin packing (operator 10).

Documents become token ids, cut into pieces of at most ``capacity`` ids; each piece is an example with a demand on
three limits: tokens, segments (one a piece) and loss-bearing tokens. Sequences are opened one after the other; each
takes, again and again, the example that still fits and has the largest dot product between its demand and what the
sequence has left, both as shares of the limits, until none fits. Examples of equal demand are interchangeable, so
the choice is among the distinct demands of a group. Groups of about GROUP_PIECES pieces are packed independently.

Null and empty texts are the closing id alone. Rows that repeat an id are packed as rows of their own. An example
that breaks a limit by itself gets a sequence of its own. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

GROUP_PIECES = 8192
CAPACITY = 1024
MAX_SEGMENTS = 256
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: White space of this many characters is taken out of a text and encoded by itself: the splitting pattern looks back
#: over a whole run, which exhausts its stack on very long ones. Python's class has four control characters more.
LONG_RUN = 4096
LONG_SPACE = re.compile(r"[^\S\x1c-\x1f]{%d,}" % LONG_RUN)


@lru_cache(maxsize=4)
def encoder(ranks_path: str) -> Callable[[str], list[int]]:
    """From whole texts to token ids under a file of ranks, with the added tokens of the tokenizer file beside it, if
    there is one. Texts of any length: a run of white space before ordinary text is one piece but for its last character."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole, added = ranks_path.removesuffix(".tiktoken") + ".json", {}
    if os.path.exists(whole):
        with open(whole, "rb") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    made = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    names = tuple(added)
    plain, piece = partial(made.encode, allowed_special="all"), made._core_bpe.encode_single_piece

    def encode(text: str) -> list[int]:
        if len(text) < LONG_RUN:
            return plain(text)
        ids, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text) and not text.startswith(names, run.end()))
            ids += plain(text[at : run.start()]) + piece(text[run.start() : end].encode())
            at = end
        return ids + plain(text[at:])

    return encode


def token_pieces(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers),
    doc_tokens (with the closing id)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks_path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(text), end_id], "<u4")
                out += [(doc, k, len(p := ids[k : k + capacity]), zlib.crc32(p.tobytes()), len(ids)) for k in range(0, len(ids), capacity)]
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(cut, PIECE)


def pack_group(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For each row of ``demand`` (examples by limits, whole numbers) the number of its sequence, from 0."""
    kinds, kind_of = np.unique(demand, axis=0, return_inverse=True)
    kind_of = kind_of.ravel()
    order = np.argsort(kind_of, kind="stable")
    upto = np.searchsorted(kind_of[order], np.arange(len(kinds)), side="right")
    left = np.bincount(kind_of, minlength=len(kinds))
    share, out, opened = kinds / limits, np.empty(len(demand), np.int64), 0
    for k in np.flatnonzero((kinds[:, 0] >= limits[0]) | (kinds > limits).any(axis=1)):
        alone = order[upto[k] - left[k] : upto[k]]  # full or beyond a limit: a sequence each
        out[alone] = opened + np.arange(len(alone))
        opened, left[k] = opened + len(alone), 0
    live = np.flatnonzero(left)
    while live.size:
        rest, shares, room = kinds[live], share[live], limits.astype(float).copy()
        able = np.ones(len(live), bool)
        while True:
            able &= (rest <= room).all(axis=1) & (left[live] > 0)
            if not able.any():
                break
            best = int(np.argmax(np.where(able, shares @ (room / limits), -1.0)))
            k = live[best]
            out[order[upto[k] - left[k]]] = opened
            left[k] -= 1
            room -= kinds[k]
        opened += 1
        live = live[left[live] > 0]
    return out


def pack(pieces: DataFrame, limits: dict[str, int], *, length: str = "length", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset (where the piece begins in its sequence) to ``pieces``. ``limits`` maps columns of
    whole numbers, the demands, to what a sequence may hold of each; the first is of tokens. Null demands count as 0.
    Columns that are called like the two new ones are replaced."""
    from pyspark.sql.types import LongType, StructField, StructType

    pieces = pieces.drop("sequence_id", "offset")
    called = {c: f"c{k}" for k, c in enumerate(pieces.columns)}  # names as they come may clash, or have dots
    held = materialise(pieces.toDF(*called.values()).withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-held.count() // group_pieces))
    names, most = [called[c] for c in limits], np.array(list(limits.values()), np.int64)
    kept = [StructField(called[f.name], f.dataType) for f in pieces.schema.fields]
    schema = StructType([*kept, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        local = pack_group(frame[names].fillna(0).to_numpy(np.int64), most)
        group = int(frame["deal"].iloc[0])
        sizes = frame[called[length]].fillna(0).to_numpy(np.int64)
        order = np.lexsort((np.arange(len(local)), local))
        total = np.cumsum(sizes[order]) - sizes[order]
        opens = np.r_[True, local[order][1:] != local[order][:-1]]
        offset = np.empty(len(local), np.int64)
        offset[order] = total - np.maximum.accumulate(np.where(opens, total, 0))
        return frame.drop(columns=["row", "deal"]).assign(sequence_id=(group << 32) + local, offset=offset)

    dealt = held.withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("deal").applyInPandas(place, schema).toDF(*pieces.columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, ranks_path: str, *, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """All documents in sequences of ``capacity`` ids: every id of a plain document bears loss."""
    pieces = token_pieces(docs, ranks_path, capacity).withColumns({"segments": F.lit(1).cast("long"), "loss_tokens": F.col("length")})
    packed = pack(pieces, {"length": capacity, "segments": max_segments, "loss_tokens": capacity})
    return packed.drop("segments", "loss_tokens")


INSTRUCTION = "conv_id long, turn long, start long, length long, loss_tokens long, ids array<int>, loss_mask array<boolean>"


def instruction_pieces(conversations: DataFrame, ranks_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One example for each assistant turn: the turn before it (nothing, if there is none), the answer and the closing
    id, of which the last two bear loss; cut into pieces. Of other turns that repeat conversation and number the
    smallest text counts; answers that repeat them are examples each. Null texts are empty."""
    at = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")]
    answer = F.col("role").eqNullSafe("assistant")
    answers = conversations.where(answer).select(*at, text_or_empty().alias("answer"))
    prompts = conversations.where(~answer).select(at[0], (at[1] + 1).alias("turn"), text_or_empty().alias("text"))
    prompts = prompts.groupBy("conv_id", "turn").agg(F.min("text").alias("prompt"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(ranks_path)
        for batch in batches:
            out: list[tuple] = []
            for conv, turn, text, before in zip(batch["conv_id"], batch["turn"], batch["answer"], batch["prompt"], strict=True):
                asked, said = encode(before or ""), [*encode(text), end_id]
                ids, loss = np.array(asked + said, np.int32), np.repeat([False, True], [len(asked), len(said)])
                out += [(conv, turn, k, len(ids[k : k + capacity]), int(loss[k : k + capacity].sum()), ids[k : k + capacity], loss[k : k + capacity]) for k in range(0, len(ids), capacity)]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in INSTRUCTION.split(", ")])
            yield frame.astype({"conv_id": "Int64", "turn": "Int64"})

    return answers.join(prompts, ["conv_id", "turn"], "left").select("conv_id", "turn", "answer", "prompt").mapInPandas(cut, INSTRUCTION)


def packed_instructions(conversations: DataFrame, ranks_path: str, *, capacity: int = CAPACITY, max_segments: int = 16, max_loss: int = CAPACITY // 2) -> DataFrame:
    """The examples of ``instruction_pieces`` in sequences within all three limits; here they don't go together, since a
    long question has many tokens and a long answer much loss."""
    pieces = instruction_pieces(conversations, ranks_path, capacity).withColumn("segments", F.lit(1).cast("long"))
    return pack(pieces, {"length": capacity, "segments": max_segments, "loss_tokens": max_loss}).drop("segments")
