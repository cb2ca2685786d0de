import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from stemmata.llm import licenses, quality, quartile_digest, token_rollups
from stemmata.llm.common import scratch_path
from stemmata.llm.queries import ranks_path

from .conftest import rows


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def test_license_base(odd):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(odd).collect())
    want = Counter()
    for r in rows():
        w = words_of(r[1])
        at = [(k, label) for label, phrase in licenses.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in at]
        want[r[0], len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert got == want


def test_license_spans(spark, none):
    full = next(t for label, t in licenses.TEMPLATES if label == "bsd-3")
    w = full.split()
    texts = ["so " + full, " ".join(w[:8] + ["really"] + w[8:]), " ".join(w[:3]), "under the mit\nlicense; All rights reserved. " * 2, "Under the mıt license", "CC by NC 4.0, Kelvin cc by nc"]
    found = [r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [r.labels for r in found] == ["bsd-3", "bsd-3", "", "mit,proprietary", "", "cc-by-nc"]
    assert found[0].score == 1.0 and found[1].score == 1.0 and 0 < found[2].score < 0.5 and found[5].n_base == 2
    assert licenses.scan(none).count() == 0


def test_statistics_tell_junk_from_prose():
    prose, junk = b"A plain sentence about the river and the town. Another one follows it.", b"A!! B%%% C*** D$$$ | e | f"
    s = dict(zip(quality.NAMES, zip(quality.statistics(prose), quality.statistics(junk)), strict=True))
    assert s["signs"][0] < s["signs"][1] and s["signed_words"][0] < s["signed_words"][1]
    assert len(quality.statistics(b"")) == len(quality.NAMES) and np.isfinite(quality.statistics(b"")).all()


def test_discriminant_against_densities():
    draw = np.random.default_rng(1)
    model = quality.Discriminant(np.array([[0.0, 0], [1, 2]]), np.linalg.cholesky(np.array([[[1, 0.2], [0.2, 2]], [[2, -0.3], [-0.3, 1]]])), np.array([-0.5, 0.3]))
    x = draw.normal(size=(50, 2))
    want = []
    for k in (1, 0):
        cov = model.factors[k] @ model.factors[k].T
        d = x - model.means[k]
        want.append(model.constants[k] - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d))
    assert np.allclose(model.log_odds(x), want[0] - want[1])


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.quality_scores(docs, labels)
    assert scored.count() == docs.count()
    rows_ = scored.where("held_out").join(labels, "doc_id").collect()
    assert len(rows_) > 50
    assert np.mean([r.predicted == r.quality for r in rows_]) > 0.95
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows_)


def test_quality_without_evidence(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    one_class = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0)], "doc_id long, quality int")
    for labels in (empty, one_class):
        got = quality.quality_scores(odd, labels).collect()
        assert len(got) == len(rows()) and {r.score for r in got} == {0.5}
    assert quality.accepted(odd, empty).count() == len(rows())
    assert quality.quality_scores(none, empty).count() == 0
    both = spark.createDataFrame([(k, int(k != 12)) for k in range(1, 13)], "doc_id long, quality int")
    got = quality.quality_scores(odd, both).collect()
    assert len(got) == len(rows()) and all(np.isfinite(r.score) for r in got)


@pytest.mark.parametrize("range_rows", [1, 3, 2048])
def test_digests_of_neighbours(odd, range_rows):
    data = [(r[0], r[1] or "") for r in rows()]
    got = quartile_digest.fingerprints(odd, range_rows).collect()
    assert len(got) == len(data)
    by_id = {r.doc_id: r for r in got if r.doc_id not in (None, 10)}
    ordered = sorted({d for d, _ in data if d is not None})
    text = {d: t for d, t in data if d is not None}
    for d, r in by_id.items():
        assert r.fingerprint == quartile_digest.digest(text[d].encode()) and r.n_chars == len(text[d])
        k = ordered.index(d)
        if k + 1 < len(ordered):
            after = text[ordered[k + 1]]
            changed = quartile_digest.edited(text[d], after).encode()
            assert r.edited_sha256 == hashlib.sha256(changed).hexdigest()
            assert r.near_next == quartile_digest.likeness(r.fingerprint, quartile_digest.digest(after.encode()))
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert by_id[1].fingerprint == by_id[2].fingerprint


def test_digests_wrap_around(spark, none):
    df = spark.createDataFrame([(5, "abcdefgh"), (3, "12345678")], "doc_id long, text string")
    got = {r.doc_id: r.edited_sha256 for r in quartile_digest.fingerprints(df, 1).collect()}
    assert got == {3: hashlib.sha256(b"123456ab").hexdigest(), 5: hashlib.sha256(b"abcdef12").hexdigest()}
    large = spark.createDataFrame([(2**60 + k, "abcdefgh"[k:] * 3) for k in range(7)], "doc_id long, text string")
    assert quartile_digest.fingerprints(large, 1).count() == 7
    alone = quartile_digest.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert [r.edited_sha256 for r in alone] == [hashlib.sha256(b"abcdefab").hexdigest()]
    assert quartile_digest.fingerprints(none).count() == 0


def test_likeness_orders_texts():
    a = b"the river runs past the old mill and under the stone bridge to the sea " * 20
    b = a[: len(a) * 3 // 4] + b"0123456789 " * 40
    c = bytes(range(32, 120)) * 20
    near, far = (quartile_digest.likeness(quartile_digest.digest(a), quartile_digest.digest(x)) for x in (b, c))
    assert quartile_digest.likeness(quartile_digest.digest(a), quartile_digest.digest(a)) == 1 and near > far


def image(source, lang, tokenizer, tokens):
    return None if source is None else {"source": source, "lang": lang, "tokenizer": tokenizer, "tokens": tokens}


def test_rollup(spark):
    struct = "struct<source:string,lang:string,tokenizer:string,tokens:long>"
    schema = f"before {struct}, after {struct}"
    change = lambda *pairs: spark.createDataFrame([{"before": b, "after": a} for b, a in pairs], schema)
    rollup = token_rollups.Rollup(spark, scratch_path(spark, "test"))
    assert rollup.totals().count() == 0
    load = change((None, image("a", "en", "t1", 10)), (None, image("a", "en", "t1", 5)), (None, image("b", None, "t1", None)))
    assert rollup.commit("load/1", load) and not rollup.commit("load/1", load)
    assert rollup.commit("revise", change((image("a", "en", "t1", 5), image("a", "en", "t2", 7))))
    assert rollup.commit("delete", change((image("a", "en", "t1", 10), None)))
    assert rollup.commit("nothing", change((None, None)))
    assert sorted((r.source, r.lang or "", r.tokenizer, r.documents, r.tokens) for r in rollup.totals().collect()) == [("a", "en", "t2", 1, 7), ("b", "", "t1", 1, 0)]


def test_token_counts_are_the_tokenizers(odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter((r.doc_id, r.image.tokens) for r in token_rollups.counted(odd, "t", ranks_path()).collect())
    assert got == Counter((r[0], len(plain.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())


def test_rollup_writers_meet(spark, monkeypatch):
    """Whoever enters a version second starts again from the first one's; a batch counts once whoever brings it."""
    struct = "struct<source:string,lang:string,tokenizer:string,tokens:long>"
    new = lambda n: spark.createDataFrame([{"before": None, "after": image("a", "en", "t", n)}], f"before {struct}, after {struct}")
    path = scratch_path(spark, "race")
    one, two = token_rollups.Rollup(spark, path), token_rollups.Rollup(spark, path)
    publish, done = token_rollups.Rollup._publish, []

    def late(self, number, batch, folder):
        if self is one and not done:
            done.append(two.commit("second", new(5)) and two.commit("third", new(7)))
        return publish(self, number, batch, folder)

    monkeypatch.setattr(token_rollups.Rollup, "_publish", late)
    assert one.commit("first", new(1)) and done == [True] and not two.commit("first", new(1))
    total = lambda: [(r.documents, r.tokens) for r in one.totals().collect()]
    assert total() == [(3, 13)]
    one.vacuum()
    assert total() == [(3, 13)] and not one.commit("third", new(7)) and one.commit("fourth", new(1)) and total() == [(4, 14)]
    assert one._latest()[0] == 4


def test_token_counts_query_against_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from stemmata.llm import packing
    from stemmata.llm.queries import op4_token_counts

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "labels"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    many = packing.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    toxic = {r.doc_id for r in labels if r.toxic == 1}
    want = Counter()
    for r in docs:
        if r.doc_id not in toxic:
            name = "byte_bpe_50k" if r.lang == "en" else "byte_bpe_multi_50k"
            ids = plain.encode(r.text or "", add_special_tokens=False).ids if r.lang == "en" else many(r.text or "")
            want[r.source, r.lang, name, "documents"] += 1
            want[r.source, r.lang, name, "tokens"] += len(ids)
    got = Counter()
    for r in op4_token_counts(spark, sf).collect():
        got[r.source, r.lang, r.tokenizer, "documents"], got[r.source, r.lang, r.tokenizer, "tokens"] = r.documents, r.tokens
    assert got == want


def test_digest_against_plain_counting():
    """The digest and the likeness, by loops over triplets and buckets."""
    draw = np.random.default_rng(5)

    def plain(data):
        n = [0] * 256
        for a, b, c in zip(data, data[1:], data[2:], strict=False):
            n[((a | b << 8 | c << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 24] += 1
        ordered = sorted(n)
        grades = [sum(x > ordered[k] for k in (63, 127, 191)) for x in n]
        step = lambda x: min(255, round(8 * np.log1p(x)))
        bits = "".join(f"{g:02b}" for g in grades)
        return f"{step(len(data)):02x}{step(sum(n) / 256):02x}{int(bits, 2):0128x}", grades, step(len(data))

    apart = {0: 0, 1: 1, 2: 2, 3: 6}
    held = [b"", b"ab", b"abc", bytes(draw.integers(32, 120, 5000, np.uint8)), bytes(draw.integers(97, 123, 700, np.uint8)) * 3, "Ünïcode ".encode() * 90]
    for x in held:
        assert quartile_digest.digest(x) == plain(x)[0]
        for y in held:
            (a, g, m), (b, h, n) = plain(x), plain(y)
            far = sum(apart[abs(p - q)] for p, q in zip(g, h, strict=True)) + 4 * max(0, abs(m - n) - 1)
            assert quartile_digest.likeness(a, b) == pytest.approx(max(0, 1 - far / 512))


def test_ranges_get_tasks_of_their_own(spark):
    from pyspark.sql import functions as F

    for n in (1, 7, 125, 1000):
        keys = quartile_digest.deal_keys(spark, n)
        assert keys.count() == n
        dealt = keys.repartition(n, "key").select("range", F.spark_partition_id().alias("task"))
        assert dealt.select("task").distinct().count() == n and dealt.where("range <> task").isEmpty()


def test_fit_against_plain_moments(spark):
    draw = np.random.default_rng(8)
    d = len(quality.NAMES)
    x = {c: draw.normal(c, 1 + c, (300 + 50 * c, d)) for c in (0, 1)}
    train = spark.createDataFrame([([float(v) for v in row], c) for c in x for row in x[c]], "stats array<double>, label int")
    model = quality.fit(train.repartition(5))
    own = {c: np.cov(x[c].T, bias=True) for c in x}
    total = sum(len(v) for v in x.values())
    pooled = sum(len(x[c]) * own[c] for c in x) / total
    for c in x:
        mixed = (1 - quality.POOL) * own[c] + quality.POOL * pooled
        shrunk = (1 - quality.DIAGONAL) * mixed + quality.DIAGONAL * np.diag(np.diag(mixed)) + quality.FLOOR * np.eye(d)
        assert np.allclose(model.means[c], x[c].mean(axis=0)) and np.allclose(model.factors[c] @ model.factors[c].T, shrunk)
        assert np.allclose(model.inverses[c] @ model.factors[c], np.eye(d))
        assert model.constants[c] == pytest.approx(np.log(len(x[c]) / total) - 0.5 * np.linalg.slogdet(shrunk)[1])


def test_tasks_hand_memory_back(spark):
    from stemmata.llm.common import hand_back, in_python

    def doubled(batches):
        for batch in batches:
            yield batch * 2

    assert sorted(r.id for r in in_python(spark.range(5), doubled, "id long").collect()) == [0, 2, 4, 6, 8]
    assert in_python(spark.range(0), doubled, "id long").count() == 0
    hand_back()
