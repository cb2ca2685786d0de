"""SimHash near-dedup of texts at a similarity (the form of operator 9 that the pipeline uses).

Two texts link if the Jaccard similarity of their sets of five-word shingles is LIKE_OF_TEN tenths or more. Links are
complete and exact: no candidate is missed, and each is decided on the full sets of 64-bit shingle hashes.

SimHash comes first, by the multi-index hashing of operator 9 (``simhash_dedup.links``): every set has a 64-bit
fingerprint, fingerprints of 2 or fewer differing bits are linked, all of them, and the texts of a component of
fingerprints are one group, whose links are then decided on the sets. The fingerprint is of the distinct shingles, so
that equal sets have equal ones and a passage that is repeated weighs no more than others.

Sets of similarity 0.8 mostly differ in more bits than 2. These links are found, without loss, by what follows; it
takes the components that SimHash left and looks only at texts of different ones. Its candidates come from prefixes. Put the shingles of every set in one order that all sets share; two sets of similarity
0.8 or more then have a shingle in common among the first n - ceil(0.8 n) + 1 of each, n being its size. That holds for
any order and any number of texts. The order puts shingles that a sample of texts shows to be common last, so that
stock lines bring few texts together; the sample decides how much is compared and never what is found.

Between the two a cheaper step brings together texts by BANDS of smallest hashes. It may miss links, and only serves to
join most members of large groups: the round over prefixes then looks only at shingles that texts of different
components share, which loses no link between components. In both steps before the prefixes a group of any size is
worked off in blocks of BLOCK_ROWS members, each by itself; then a few members of each component that came out stand
for it in the next turn. A link that blocks don't show is left to the prefixes.

Most shingles of prefixes are in one text only. So that these cost little, the prefixes' shingles, but for the common
ones, are dealt as arrays into buckets of half a million, and only those that two texts hold become
rows. A bucket is held whole, which is bounded since what is left of common shingles is rare; the common ones are rows
from the start, and aggregated before they are sent.

Before sets are sent anywhere, sketches rule out members that can't link to another one of their group. A sketch
counts a set's hashes by their lowest bits, in about as many counters as the set has hashes and BINS at least, of two
bits each: the counts of two sets, cut off at 3, differ by no more than the sets do, so this too loses nothing.

No pairs are listed. The texts that hold a key are one group; groups of the same members are taken once; a group comes
back as a spanning forest of its links, which has fewer edges than members. In the round over prefixes, groups of over
BLOCK_ROWS members are dealt into blocks, each pair of which is worked off by itself. Where that would be over
MOST_BLOCKS blocks, the key is taken together with each other shingle of the prefix that is one longer, since alike
sets have two in common there: a member then has as many rows as its prefix has shingles, however many hold the key.
So no task sees an unbounded group, no member is sent more often than a number that doesn't grow with the corpus
unless thousands share two rare shingles, and nothing is capped or left out.

Texts of equal shingle sets are one node, told by a 128-bit digest of the whole set. Null and empty texts have the
empty set and are alike; texts of under five words are one shingle. Of rows that repeat id and text one stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_python, lookup, materialise, scratch, small_batches, text_or_empty
from .components import components
from .exact_dedup import one_of_each
from .simhash_dedup import fingerprint_of, links, shingle_hashes

WIDTH = 5
LIKE_OF_TEN = 8
BANDS, BAND_BINS = 4, 3
BLOCK_ROWS = 2048
MOST_BLOCKS = 16
#: Members that stand for their component in a group.
STAND_INS = 16
#: Turns of each step before the round over prefixes; each makes groups smaller by BLOCK_ROWS / STAND_INS.
TURNS = 5
#: Texts in the sample that the order comes from, the count there from which a shingle is common, and how many are told.
SAMPLE, COMMON, MOST_COMMON = 10_000, 4, 200_000
SLOTS = 1 << 23
BINS = 512
#: What counts of sketches are cut off at, and where each of the four in a byte begins.
MOST_COUNT, PLACES = 3, np.arange(0, 8, 2)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(np.array(shingle_hashes(text, WIDTH), "<u8"))


def prefix(shingles: np.ndarray, common: np.ndarray, grade: np.ndarray, shared: int = 1) -> np.ndarray:
    """The shingles of a set of which ``shared`` at least are in this prefix of every set alike (that has so many).
    ``common``: ascending, with the ``grade`` by which they come after all others."""
    n = len(shingles)
    most = n - -(-LIKE_OF_TEN * n // 10) + shared if n else 0
    if not len(common):
        return shingles[:most]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    late = np.where(common[at] == shingles, grade[at], 0)
    return shingles[np.argsort(late, kind="stable")[:most]]  # equal grades by hash


def bands(shingles: np.ndarray) -> np.ndarray:
    """BANDS numbers, each of the smallest hashes in BAND_BINS equal parts of the range of hashes; of the empty set none."""
    if not len(shingles):
        return shingles
    parts = np.uint64(2**64 // (BANDS * BAND_BINS) + 1)
    held, first = np.unique(shingles // parts, return_index=True)
    least = np.zeros(BANDS * BAND_BINS, "<u8")
    least[held.astype(np.int64)] = shingles[first]
    rows = least.reshape(BANDS, BAND_BINS)
    return np.array([int.from_bytes(hashlib.blake2b(bytes([k]) + r.tobytes(), digest_size=8).digest(), "little") for k, r in enumerate(rows)], "<u8")


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(bytes(t)) for t in batch["text"]]
        simhash = np.array([fingerprint_of(s) for s in sets], "<i8")
        sets = [s.tobytes() for s in sets]
        digests = [hashlib.blake2b(s, digest_size=16).digest() for s in sets]
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "sha": batch["sha"], "fp": digests, "simhash": simhash, "shingles": sets})


def _keys(of):
    """From rows (node, shingles) to rows (node, keys): the numbers that ``of`` makes of a set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "keys": [of(np.frombuffer(s, "<u8")).view("<i8") for s in batch["shingles"]]})

    return run


def _two_keys(told):
    """From rows (node, root, wide, shingles), ``wide`` being keys of the node's prefix, to rows (node, root, keys): each
    of them together with each other shingle of the prefix in which alike sets share two."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = []
            for wide, s in zip(batch["wide"], batch["shingles"], strict=True):
                a, b = np.meshgrid(np.asarray(wide, "<i8").view("<u8"), prefix(np.frombuffer(s, "<u8"), *told.value, shared=2))
                a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
                keys.append(np.unique(a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)).view("<i8"))
            yield pd.DataFrame({"node": batch["node"], "root": batch["root"], "keys": keys})

    return run


#: Shingles of prefixes that a bucket holds, and that are dealt at a time.
BUCKET_KEYS, DEAL_KEYS = 500_000, 500_000


def is_common(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    if not len(common):
        return np.zeros(len(shingles), bool)
    return common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles


def _dealt_keys(told, buckets: int):
    """From rows (node, shingles) to rows (bucket, keys, nodes): the shingles of prefixes that aren't common, as arrays."""

    def blobs(keys: list[np.ndarray], nodes: list[int]) -> pd.DataFrame:
        flat, owner = np.concatenate(keys), np.repeat(np.array(nodes, "<i8"), [len(k) for k in keys])
        at = (flat % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0]) if len(flat) else np.zeros(0, np.int64)
        parts = [[x.tobytes() for x in np.split(a[order], cuts[1:])] if len(cuts) else [] for a in (flat, owner)]
        return pd.DataFrame({"bucket": at[order][cuts], "keys": parts[0], "nodes": parts[1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, nodes, held = [], [], 0
            for node, s in zip(batch["node"], batch["shingles"], strict=True):
                own = prefix(np.frombuffer(s, "<u8"), *told.value)
                own = own[~is_common(own, told.value[0])]
                keys.append(own)
                nodes.append(node)
                held += len(own)
                if held >= DEAL_KEYS:
                    yield blobs(keys, nodes)
                    keys, nodes, held = [], [], 0
            if keys:
                yield blobs(keys, nodes)

    return run


def _held_by_two(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows (bucket, keys, nodes) sorted by bucket to rows (key, node) of the keys that two nodes or more hold."""

    def found(rows: list[tuple[bytes, bytes]]) -> pd.DataFrame:
        keys, nodes = (np.frombuffer(b"".join(part), "<i8") for part in zip(*rows, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, nodes = keys[order], nodes[order]
        same = keys[1:] == keys[:-1]
        two = np.r_[same, False] | np.r_[False, same]
        return pd.DataFrame({"key": keys[two], "node": nodes[two]})

    bucket, rows = None, []
    for batch in batches:
        for at, keys, nodes in zip(batch["bucket"], batch["keys"], batch["nodes"], strict=True):
            if at != bucket and rows:
                yield found(rows)
                rows = []
            bucket = at
            rows.append((keys, nodes))
    if rows:
        yield found(rows)


def held_keys(sets: DataFrame, told) -> DataFrame:
    """(node, key) for the shingles of the prefixes of ``sets`` that two texts or more hold; of the common ones all."""
    total = sets.agg(F.sum(F.octet_length("shingles") * (10 - LIKE_OF_TEN) / 80 + 1)).first()[0] or 0
    buckets = 1 + int(total) // BUCKET_KEYS
    narrow = sets.select("node", "shingles")
    dealt = in_python(narrow, _dealt_keys(told, buckets), "bucket long, keys binary, nodes binary")
    rare = in_python(dealt.repartition("bucket").sortWithinPartitions("bucket"), _held_by_two, "key long, node long")

    def common(s: np.ndarray) -> np.ndarray:
        own = prefix(s, *told.value)
        return own[is_common(own, told.value[0])]

    often = in_python(narrow, _keys(common), "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    return rare.select("node", "key").unionByName(often)


def _each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for k in range(0, len(batch), 256):
            yield pd.DataFrame({"key": np.frombuffer(b"".join(batch["shingles"].iloc[k : k + 256]), "<i8")})


def common_shingles(sets: DataFrame, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that come last in the order, ascending, and their grades; bounded whatever the number of texts."""
    sample = sets.where(F.pmod(F.xxhash64("node"), F.lit(max(1, -(-texts // SAMPLE)))) == 0).select("shingles")
    counted = in_python(sample, _each, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    found = counted.orderBy(F.desc("n"), "key").limit(MOST_COMMON).toArrow()
    keys = found["key"].to_numpy().view("<u8")
    order = np.argsort(keys)
    return keys[order], found["n"].to_numpy()[order]


def sets_of(sets: DataFrame, nodes: DataFrame, of, schema: str) -> DataFrame:
    """``of`` of the rows of ``sets`` (node, shingles) without most of those whose node is not among ``nodes``, so that
    they need no shuffle: a table of SLOTS bits says which may be wanted."""
    slot = F.pmod(F.xxhash64("node"), F.lit(SLOTS)).cast("int").alias("slot")
    bits = np.zeros(SLOTS, bool)
    bits[nodes.select(slot).distinct().toArrow()["slot"].to_numpy()] = True
    told = sets.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["slot"].to_numpy()
            yield of(batch.loc[(told.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool), ["node", "shingles"]])

    return in_python(sets.select("node", "shingles", slot), wanted, schema)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """How many hashes have each value of their lowest bits, up to MOST_COUNT, by as many values as there are hashes,
    about; four counts a byte."""
    bins = max(BINS, 1 << max(0, len(shingles) - 1).bit_length())
    counts = np.minimum(np.bincount((shingles & np.uint64(bins - 1)).astype(np.int64), minlength=bins), MOST_COUNT)
    return (counts.reshape(-1, 4) << PLACES).sum(axis=1).astype(np.uint8)


def counts_of(sketches: list[bytes], length: int) -> np.ndarray:
    """The counts of sketches that have ``length`` bytes each, a row each."""
    packed = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, length, 1)
    counts = packed >> PLACES.astype(np.uint8)
    counts &= MOST_COUNT
    return counts.reshape(-1, 4 * length).view(np.int8)


def _sketches(batch: pd.DataFrame) -> pd.DataFrame:
    """The size of each set and its sketch."""
    sets = [np.frombuffer(s, "<u8") for s in batch["shingles"]]
    return pd.DataFrame({"node": batch["node"].to_numpy(), "n": np.array([len(s) for s in sets], np.int64), "counts": [sketch(s).tobytes() for s in sets]})


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """From rows (key, low, high, ...) sorted by group, frames of whole groups and where each begins and ends; a group
    that goes on in the next batch is kept."""
    held: list[pd.DataFrame] = []
    by = ["key", "low", "high"]
    for batch in chain(batches, [None]):
        if batch is None:
            now, held = pd.concat(held) if held else None, []
        elif not len(batch):
            continue
        else:
            last = (batch[by] == batch[by].iloc[-1]).all(axis=1).to_numpy()
            if last.all() and (not held or (held[0][by].iloc[0] == batch[by].iloc[0]).all()):
                held.append(batch)
                continue
            now, held = pd.concat([*held, batch[~last]]), [batch[last]]
        if now is not None and len(now):
            group = now[by].to_numpy()
            starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)]).tolist()
            yield now, list(zip(starts, [*starts[1:], len(now)], strict=True))


def may_link(counts: list[bytes], sizes: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Which members of a group another one of another root may link to. What sketches differ by is no more than the
    sets do, and no more when both are cut off at the same count, so this rules out no link. Sketches of alike sets are
    as long as each other or one is twice as long; it is then folded, and cut off at that count again."""
    found, length = np.zeros(len(sizes), bool), np.array([len(c) for c in counts])
    for bins in np.unique(length).tolist():
        own, longer = np.flatnonzero(length == bins), np.flatnonzero(length == 2 * bins)
        if len(own) + len(longer) < 2:
            continue
        wide = counts_of([counts[k] for k in own], bins)
        if len(longer):
            halves = counts_of([counts[k] for k in longer], 2 * bins).reshape(len(longer), 2, -1)
            wide = np.concatenate([wide, np.minimum(halves.sum(axis=1, dtype=np.int8), MOST_COUNT)])
        at = np.concatenate([own, longer])
        for k, i in enumerate(own):
            rest = np.arange(k + 1, len(at))
            other = at[rest]
            rest = rest[(roots[other] != roots[i]) & ~(found[other] & found[i]) & (10 * np.minimum(sizes[other], sizes[i]) >= LIKE_OF_TEN * np.maximum(sizes[other], sizes[i]))]
            apart = np.abs(wide[rest] - wide[k]).sum(axis=1, dtype=np.int64)
            near = at[rest[(10 + LIKE_OF_TEN) * apart <= (10 - LIKE_OF_TEN) * (sizes[at[rest]] + sizes[i])]]
            found[near] = True
            found[i] |= near.size > 0
    return found


def _may_link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for now, groups in _groups(batches):
        counts, n, root = now["counts"].tolist(), now["n"].to_numpy(), now["root"].to_numpy()
        yield now.loc[np.concatenate([may_link(counts[a:b], n[a:b], root[a:b]) for a, b in groups]), ["key", "node", "root"]]


def _forest(shingles: np.ndarray, sizes: np.ndarray, roots: np.ndarray) -> list[tuple[int, int]]:
    """Links among a group's members that with those known (equal ``roots``) have the components of all its links.
    ``shingles``: the members' sets, one after the other."""
    ids = np.unique(shingles, return_inverse=True)[1].ravel()
    starts = np.cumsum(sizes) - sizes
    _, kin, members = np.unique(roots, return_inverse=True, return_counts=True)
    of_kin = np.split(np.argsort(kin, kind="stable"), np.cumsum(members)[:-1])
    ends: list[tuple[int, int]] = []
    waiting = np.arange(len(sizes))
    open_kin = np.ones(len(members), bool)
    has = np.zeros(ids.max(initial=-1) + 1, bool)
    flat, begins = ids, starts
    for k in np.argsort(members, kind="stable"):  # the smaller first: each asks all that wait at once
        if not open_kin[k]:
            continue
        open_kin[k] = False
        reached = of_kin[k].tolist()
        while reached:
            keep = open_kin[kin[waiting]]
            if not keep.any():
                return ends
            if 2 * keep.sum() <= len(waiting):  # those reached go, or each look would cost as much as the first
                waiting, keep = waiting[keep], keep[keep]
                flat = np.concatenate([ids[starts[x] : starts[x] + sizes[x]] for x in waiting])
                begins = np.cumsum(sizes[waiting]) - sizes[waiting]
            at = reached.pop()
            own = ids[starts[at] : starts[at] + sizes[at]]
            has[own] = True
            both = np.add.reduceat(has[flat], begins, dtype=np.int64)
            has[own] = False
            near = keep & (10 * both >= LIKE_OF_TEN * (sizes[at] + sizes[waiting] - both))
            for x in waiting[near].tolist():
                if open_kin[kin[x]]:
                    open_kin[kin[x]] = False
                    ends.append((at, x))
                    reached += of_kin[kin[x]].tolist()
    return ends


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    said: set[tuple[int, int]] = set()
    for now, groups in _groups(batches):
        node, root, sets = now["node"].to_numpy(), now["root"].to_numpy(), now["shingles"].to_numpy()
        ends: set[tuple[int, int]] = set()
        for a, b in groups:
            if b - a > 1:
                sizes = np.array([len(s) // 8 for s in sets[a:b]], np.int64)
                found = _forest(np.frombuffer(b"".join(sets[a:b]), "<u8"), sizes, root[a:b])
                ends |= {(int(node[a + x]), int(node[a + y])) for x, y in found}
        fresh = ends - said
        said = fresh if len(said) > 1_000_000 else said | fresh
        yield pd.DataFrame(list(fresh), columns=["u", "v"], dtype="int64")


def _tasks(members: DataFrame, pairs: bool) -> DataFrame:
    """From the members (key, node, root) of groups to rows (key, low, high, node, root): groups of the same members
    once, those of over BLOCK_ROWS by blocks or, with ``pairs``, by pairs of blocks."""
    kin = [F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.min("node").alias("low"), F.max("node").alias("high")]
    groups = members.groupBy("key").agg(*kin).where("n > 1").groupBy("n", "sum", "low", "high").agg(F.min("key").alias("key"))
    groups = groups.select("key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = members.join(groups, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    if not pairs:
        return dealt.select("key", "node", "root", F.col("mine").alias("low"), F.col("mine").alias("high"))
    tasks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return tasks.select("key", "node", "root", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))


def _by_group(tasks: DataFrame, more: DataFrame) -> DataFrame:
    return tasks.join(more, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")


def _across(own: DataFrame) -> DataFrame:
    """The rows (node, root, key) of ``own`` whose key members of several components hold."""
    shared = own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return own.join(shared, "key", "left_semi")


def near_links(members: DataFrame, sets: DataFrame, pairs: bool = True) -> DataFrame:
    """``members``: key, node, root; ``sets``: node, shingles. Edges (u, v) with the components of all links between
    components among texts that share a key; without ``pairs``, among those that are in one block."""
    sketches = sets_of(sets, members, _sketches, "node long, n long, counts binary")
    able = _by_group(_tasks(members, pairs), sketches).select("key", "low", "high", "node", "root", "n", "counts")
    able = materialise(in_python(able, _may_link, "key long, node long, root long").distinct(), "able")
    whole = _by_group(_tasks(able, pairs), sets_of(sets, able, lambda batch: batch, "node long, shingles binary"))
    edges = in_python(whole.select("key", "low", "high", "node", "root", "shingles"), _forests, "u long, v long").distinct()
    return materialise(edges, "edges")


def simhash_keys(nodes: DataFrame) -> DataFrame:
    """From rows (node, simhash) to rows (node, keys): the component of the node's fingerprint under links of 2 bits or
    fewer, for those whose component has other nodes."""
    prints = materialise(nodes.groupBy("simhash").agg(F.count("*").alias("rows")), "prints")
    roots = components(links(prints.select(F.col("simhash").alias("fp"))))
    rooted = prints.join(roots.select(F.col("node").alias("simhash"), "root"), "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    several = rooted.groupBy("root").agg(F.sum("rows").alias("all")).where("all > 1").select("root")
    classes = materialise(rooted.join(several, "root").select("simhash", "rows", "root"), "print-classes")
    return lookup(nodes, classes, "simhash", "rows", nodes.count()).select("node", F.array("root").alias("keys"))


def gathered(made: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the nodes that ``roots`` (node, root) joins, or that link to another with which they share one of
    the ``keys`` in ``made`` (node, keys), as far as blocks show it."""
    edges = roots.toDF("u", "v")
    for turn in range(TURNS):
        rooted = made.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("keys").alias("key"))
        if turn:
            rooted = rooted.groupBy("key", "root", F.pmod(F.xxhash64("node", "key"), F.lit(STAND_INS)).alias("seat")).agg(F.min("node").alias("node"))
        members = materialise(_across(rooted.select("node", "root", "key")), "members")
        widest = members.groupBy("key").count().agg(F.max("count")).first()[0] or 0
        found = near_links(members, sets, pairs=False)
        if found.isEmpty():
            break
        edges = edges.unionByName(found)
        roots = components(edges)
        if widest <= BLOCK_ROWS:
            break
    return roots


def simhash_roots(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of the ``nodes`` (node, simhash) that link to another whose fingerprint is near, by multi-index hashing."""
    none = sets.sparkSession.createDataFrame([], "node long, root long")
    return gathered(materialise(simhash_keys(nodes), "simhash-keys"), sets, none)


def banded_roots(nodes: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """``roots`` with what links by a band joined too."""
    made = in_python(sets, _keys(bands), "node long, keys array<long>").join(nodes, "node", "left_semi")
    return gathered(materialise(made, "bands"), sets, roots)


def narrowed(members: DataFrame, sets: DataFrame, told) -> DataFrame:
    """``members`` with groups of two keys in place of those that are over MOST_BLOCKS blocks."""
    wide = members.groupBy("key").count().where(F.col("count") > BLOCK_ROWS * MOST_BLOCKS).select("key")
    if wide.isEmpty():
        return members
    held = members.join(wide, "key", "left_semi").groupBy("node", "root").agg(F.collect_set("key").alias("wide"))  # of one text
    more = in_python(sets.join(held, "node").select("node", "root", "wide", "shingles"), _two_keys(told), "node long, root long, keys array<long>")
    more = _across(materialise(more, "two-keys").select("node", "root", F.explode("keys").alias("key")))
    return materialise(members.join(wide, "key", "left_anti").unionByName(more.select(*members.columns)), "members")


def near_components(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of the ``nodes`` (node, simhash) that link to another. ``sets``: node, shingles; those of ``nodes``
    count."""
    spark = sets.sparkSession
    told = spark.sparkContext.broadcast(common_shingles(sets, sets.count()))
    with scratch(spark):
        near = materialise(simhash_roots(nodes, sets), "near", lasting=True)
    with scratch(spark):
        first = materialise(banded_roots(nodes, sets, near), "first", lasting=True)
    with scratch(spark):
        rooted = nodes.join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        own = materialise(materialise(held_keys(sets, told), "keys").join(rooted, "node"), "rooted-keys")
        edges = near_links(narrowed(materialise(_across(own), "members"), sets, told), sets)
        return materialise(components(edges.unionByName(first.select(F.col("node").alias("u"), F.col("root").alias("v")))), "roots", lasting=True)


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (the smallest doc_id of its class), kept (one row a class),
    text_sha256."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("sha"), text.cast("binary").alias("text"))
    made = in_python(rows, _sets, "doc_id long, sha string, fp binary, simhash long, shingles binary")
    with scratch(docs.sparkSession), small_batches(docs.sparkSession):
        return materialise(_classes(made), "near", lasting=True)


def _classes(made: DataFrame) -> DataFrame:
    held = materialise(made.withColumn("row_key", F.monotonically_increasing_id()), "sets")
    fps = held.groupBy("fp").agg(F.min("row_key").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.min("simhash").alias("simhash"))  # equal sets have one
    fps = materialise(fps, "fps")
    roots = near_components(fps.select("node", "simhash"), held.select(F.col("row_key").alias("node"), "shingles"))
    rooted = fps.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    final = materialise(rooted.join(least, "root").select("fp", "root", "rows", "component_id"), "classes")
    narrow = held.drop("simhash", "shingles")
    found = materialise(lookup(narrow, final, "fp", "rows", narrow.count()).select("row_key", "doc_id", "sha", "root", "component_id"), "found")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row_key").alias("row_key"), F.lit(True).alias("first"))
    return found.join(first.select("row_key", "first"), "row_key", "left").select("doc_id", "component_id", F.coalesce("first", F.lit(False)).alias("kept"), F.col("sha").alias("text_sha256"))


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text one stays."""
    kept = near_duplicate_classes(docs).where("kept").select("doc_id", F.col("text_sha256").alias("sha")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.sha2(text_or_empty(), 256).alias("own_sha"))
    joined = rows.join(kept, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_sha") == F.col("sha")))
    return one_of_each(joined, ["own_id", "own_sha"]).select("row.*")
