import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stemmata.llm import mixing, packing, sharding, warc
from stemmata.llm.common import scratch_path
from stemmata.llm.queries import ranks_path

from .conftest import rows


def water(sizes, weights):
    """Targets by sharing the excess again until none is above."""
    total, capped = sum(sizes), {}
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        rest = total - sum(capped.values())
        share = {k: rest * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if share[k] > 3 * sizes[k]]
        if not over:
            return [capped.get(k, share.get(k)) for k in range(len(sizes))]
        capped |= {k: 3.0 * sizes[k] for k in over}


def test_targets(spark):
    draw = random.Random(3)
    for _ in range(3):
        sizes = [draw.choice([0, 1, 10, 500, 5000]) for _ in range(9)] + [7000]
        df = spark.createDataFrame([(chr(97 + k), s) for k, s in enumerate(sizes)], "source string, words long")
        got = [r.target for r in mixing.source_targets(df).orderBy("rank").collect()]
        assert np.allclose(got, water(sizes, [k % 3 + 1 for k in range(len(sizes))]))


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 97, 1000):
        got = [r[0] for r in mixing.permuted(spark.range(n), "id", f"{n}L", mixing.round_keys(5)).collect()]
        assert sorted(got) == list(range(n)) and (n < 97 or got != sorted(got))
    keyed = mixing.with_round_keys(spark.range(1000).withColumn("key", F.lit(5)), "key")
    assert [r.id for r in mixing.permuted(keyed, "id", "1000L", mixing.ROUND_COLUMNS).collect()] == got


@pytest.mark.parametrize("bits", [20, 36, 50])
def test_images_spread(spark, bits):
    """Neighbouring numbers go everywhere alike: by octile, and by octile together with the next number's."""
    got = mixing.permuted(spark.range(40_000), "id", f"{1 << bits}L", mixing.round_keys(0)).toPandas()["id"].to_numpy() >> (bits - 3)
    for seen, cells in ((got, 8), (got[:-1] * 8 + got[1:], 64)):
        n = np.bincount(seen, minlength=cells)
        assert ((n - n.mean()) ** 2 / n.mean()).sum() / (cells - 1) < 2


def dispersion(slots, shards):
    """Chi-squared a degree of freedom of the sources' counts in the full shards."""
    n = slots.where(f"shard < {shards}").groupBy("shard", "rank").count().toPandas().pivot(index="shard", columns="rank", values="count").fillna(0).to_numpy()
    expected = n.sum(axis=0) / n.shape[0]
    return ((n - expected) ** 2 / expected).sum() / ((n.shape[0] - 1) * (n.shape[1] - 1))


def test_shards_hold_every_source_in_proportion(spark):
    slots = 1 << 20
    plan = spark.createDataFrame([(1, 1000, slots // 2, 0), (2, 70_000, slots // 2, slots // 2)], "rank long, blocks long, draws long, start long")
    assert 0.6 < dispersion(mixing.mix_slots(plan, slots), slots // mixing.SHARD_SLOTS) < 1.5
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    filled = mixing.mix(docs)[1]
    assert dispersion(filled, filled.count() // mixing.SHARD_SLOTS) < 1.5
    assert filled.groupBy("rank", "epoch", "block").count().where("count > 1").isEmpty()


def test_mix(spark, odd, none):
    got = mixing.mix(odd)[0].collect()
    assert len(got) == len(rows()) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert Counter(r.size for r in got) == Counter(len((r[1] or "").split()) for r in rows())
    assert Counter((r.doc_id, r.taken) for r in mixing.mix(odd.repartition(3))[0].collect()) == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(none)[0].count() == 0 and mixing.mixed_documents(none).columns == none.columns
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(empty)[0].collect()] == [0, 0]


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken, slots = mixing.mix(docs)
    got = taken.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 0.01 * r["max(target)"] for r in got)
    assert slots.select("slot").distinct().count() == slots.count()


def test_pack_group_keeps_every_limit():
    draw = np.random.default_rng(2)
    limits = np.array([1024, 12, 300])
    demand = np.stack([draw.integers(1, 1025, 800), np.ones(800, int), draw.integers(0, 301, 800)], axis=1)
    demand[5] = [2000, 1, 0]
    bins = packing.pack_group(demand, limits)
    used = np.zeros((bins.max() + 1, 3), int)
    np.add.at(used, bins, demand)
    alone = Counter(bins)[bins[5]] == 1
    used[bins[5]] = 0
    assert (used <= limits).all() and alone and sorted(set(bins)) == list(range(bins.max() + 1))
    assert packing.pack_group(np.zeros((0, 3), int), limits).size == 0


def test_packed_documents(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.packed_documents(odd, ranks_path(), max_segments=3).collect()
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    want = Counter()
    for r in rows():
        ids = np.array(plain.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 1024):
            want[r[0], k, len(ids[k : k + 1024]), zlib.crc32(ids[k : k + 1024].tobytes()), len(ids)] += 1
    assert pieces == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024 and len(held) <= 3
    assert packing.packed_documents(none, ranks_path()).count() == 0


def check_shards(got, shards):
    counts = Counter(r.shard for r in got)
    sizes = [counts.get(k, 0) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(counts) <= set(range(shards))
    for k in counts:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))


@pytest.mark.parametrize("shards", [4, 40])
def test_shards(odd, none, shards):
    got = sharding.shard_documents(odd, shards).collect()
    check_shards(got, shards)
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard_documents(none, shards).count() == 0


@pytest.mark.parametrize("n, shards, hot", [(2000, 8, 4), (8000, 40, 4)])
def test_shards_keep_groups_together(spark, n, shards, hot):
    """No group lies in over one shard more than it fills, and how the rows are split changes nothing."""
    draw = random.Random(1)
    data = [(k, "hot" if k % hot == 1 else f"copy {draw.randrange(60)}" if k % hot == 0 else f"single {k}") for k in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sharding.shard_documents(docs, shards).collect()
    check_shards(got, shards)
    text, where = dict(data), defaultdict(Counter)
    for r in got:
        where[text[r.doc_id]][r.shard] += 1
    assert all(len(s) <= -(-s.total() // (n // shards)) + 1 for s in where.values())
    assert sum(len(s) > 1 for t, s in where.items() if t.startswith("copy")) <= 6
    for parts in (1, 3) if n == 2000 else ():
        again = sharding.shard_documents(docs.repartition(parts), shards).collect()
        assert Counter(again) == Counter(got)


def test_warc_round_trip(spark):
    html = "<p>" + "x" * 700_000 + "</p>"
    data = [(1, "http://a", "same"), (2, "http://b\r\nEvil: 1", "same"), (3, None, "same"), (4, "http://c", None), (5, "u", ""), (6, "u", html), (7, "u", "é"), (None, "u", "lost"), (9, "u", "one"), (9, "http://" + "x" * 100_000, "one")]
    pages = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, key string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    best = defaultdict(lambda: None)
    for page, _, body in data:
        best[body or ""] = max(filter(lambda v: v is not None, (best[body or ""], page)), default=None)
    want = Counter()
    for page, _, body in data:
        raw = (body or "").encode()
        revisit = page != best[body or ""]
        want[page, len(raw), warc.digest(raw), "revisit" if revisit else "response", best[body or ""] if revisit else None] += 1
    assert got == want
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    small = warc.with_revisits(pages, min_bytes=5).where("revisit").count()
    assert small == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_seeks_one_frame(spark):
    pages = spark.createDataFrame([(k, f"http://{k}", f"{k} " * 60_000) for k in range(9)], "page_id long, url string, html string")
    index = warc.write_bundles(warc.with_revisits(pages), scratch_path(spark, "seek")).collect()
    assert max(r.frame for r in index) > 0
    for r in index:
        assert r.record_id == warc.record_id(r.page_id, warc.digest((f"{r.page_id} " * 60_000).encode()))
        headers, block = warc.read_record(r.bundle, r.record_id)
        assert headers["X-Page-Id"] == str(r.page_id)
        assert hashlib.sha1(block.split(b"\r\n\r\n", 1)[1]).digest() == hashlib.sha1((f"{r.page_id} " * 60_000).encode()).digest()


def test_warc_repeated_ids_have_records_of_their_own(spark):
    data = [(1, "a", "one"), (1, "b", "two"), (2, "c", "three"), (2, "d", "three"), (1, "e", "three"), (None, "f", "four"), (None, "g", "four")]
    index = warc.write_bundles(warc.with_revisits(spark.createDataFrame(data, "page_id long, url string, html string")), scratch_path(spark, "seek")).collect()
    assert len({r.record_id for r in index}) == len(data)
    found = set()
    for r in index:
        headers, block = warc.read_record(r.bundle, r.record_id)
        assert headers["WARC-Record-ID"] == r.record_id
        found.add((r.page_id, headers["WARC-Target-URI"], headers["WARC-Type"], headers.get("X-Refers-To-Page-Id")))
    assert found == {(1, "a", "response", None), (1, "b", "response", None), (2, "c", "response", None), (2, "d", "response", None), (1, "e", "revisit", "2"), (None, "f", "response", None), (None, "g", "response", None)}


def test_warc_bundles_are_read_by_as_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1)
    pages = spark.createDataFrame([(k, None, str(k)) for k in range(30)], "page_id long, url string, html string").repartition(2)
    index = warc.write_bundles(warc.with_revisits(pages), scratch_path(spark, "many"))
    bundles = index.select("bundle").distinct()
    read = warc.read_bundles(bundles)
    assert read.rdd.getNumPartitions() == bundles.count() > 1 and read.count() == 30


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.count() > 0
        if name == corpus_pipeline.STAGES[-1][0]:
            break
        assert after.columns == docs.columns and set(r.doc_id for r in after.collect()) <= set(r.doc_id for r in docs.collect())
        docs = after
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, "/root/testdata/sf0.001").count()
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0


def test_mixed_documents_meet_the_targets(spark):
    """A third of the rows is moved to one source, which then gives a small share of its words."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source")))
    size = F.regexp_count("text", F.lit(mixing.WORD))
    want = {r.source: r for r in mixing.mix(docs)[0].join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.max("target").alias("target"), F.max("size").alias("most")).collect()}
    got = {r.source: r.words for r in mixing.mixed_documents(docs).groupBy("source").agg(F.sum(size).alias("words")).collect()}
    assert all(abs(got.get(s, 0) - r.target) <= 2 * r.most for s, r in want.items())
    assert abs(got["src0"] / want["src0"].target - 1) < 0.1


def test_packing_knows_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n y", "<|endoftext"]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.packed_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranks_path()).collect()}
    for k, t in enumerate(texts):
        ids = np.array(plain.encode(t, add_special_tokens=False).ids + [0], "<u4")
        assert got[k] == (len(ids), zlib.crc32(ids.tobytes()))


def test_encoder_on_long_runs():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(ranks_path())
    draw = random.Random(4)
    texts = ["a" + " " * 5000 + "b", "a" + "\n" * 5000, "\t " * 4000 + "<|endoftext|>" + " " * 4096 + "!", "\u3000" * 4097 + "x", "\x1c" * 5000 + " y", " " * 4095 + "z"]
    texts += ["".join(draw.choice([" " * 4096, "\n" * 4100, "word", " ", "9", "é", "<|endoftext|>"]) for _ in range(12)) for _ in range(40)]
    texts += [" " * 2_000_000, "\n" * 2_000_000 + "x", "a" * 2_000_000]
    for t in texts:
        assert encode(t) == plain.encode(t, add_special_tokens=False).ids
    many = packing.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert many("x") and 50256 not in many("<|endoftext|>") and len(many(" " * 2_000_000)) > 0


def test_packed_instructions_keep_every_limit(spark):
    draw = random.Random(6)
    data = [(c, t, "assistant" if t % 2 else "user", "word " * draw.randrange(1, 700)) for c in range(60) for t in range(4)]
    data += [(99, 0, "assistant", "no question"), (99, 3, "assistant", None), (None, 1, "assistant", "x"), (98, 0, None, "left alone"), (1, 1, "assistant", "again")]
    talks = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = packing.packed_instructions(talks, ranks_path()).collect()
    encode = packing.encoder(ranks_path())
    want = Counter()
    for c, t, role, text in data:
        if role == "assistant":
            asked = [x for d, u, r, x in data if d == c and c is not None and u == t - 1 and r != "assistant"]
            want[c, t] += len(encode(asked[0] if asked else "")) + len(encode(text or "")) + 1
    have, used = Counter(), defaultdict(lambda: np.zeros(3, int))
    for r in got:
        have[r.conv_id, r.turn] += r.length
        used[r.sequence_id] += [r.length, 1, r.loss_tokens]
        assert len(r.ids) == r.length and sum(r.loss_mask) == r.loss_tokens
    assert have == want
    held = Counter(r.sequence_id for r in got)
    assert all((n <= [1024, 16, 512]).all() or held[k] == 1 for k, n in used.items())
    loss = sum(n[2] for n in used.values())
    assert any(n[2] > 400 and n[0] < 900 for n in used.values()) and loss > 0


def test_pack_with_clashing_columns(spark):
    pieces = spark.range(50).selectExpr("id", "id * 7 + 1 AS length", "id AS _row", "id AS _group", "id AS _row0", "'x' AS sequence_id", "'y' AS offset", "id AS `a.b`")
    got = packing.pack(pieces, {"length": 500}).collect()
    assert sorted(r.id for r in got) == list(range(50)) and all(r._row == r._row0 == r["a.b"] == r.id for r in got)
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 500


def test_stages_keep_columns_with_dots(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).selectExpr("*", "doc_id AS `a.b`", "source AS row", "1 AS copy", "'z' AS sha")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == docs.columns and after.count() > 0, name
