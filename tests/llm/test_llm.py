"""Small tests of the training-data operators: brute force, exact round trips, held-out accuracy, and awkward rows."""

import base64
import hashlib
import io
import math
import os
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import decontaminate, html_text, lm_score, media, mixing, ngram_join, quality, queries, shared, token_counts, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key string"


def odd_docs(spark, rows=None):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = rows if rows is not None else [(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "ONE two"), (5, long), (6, long + " tail"), (None, "loose row"), (7, "Ångström 中文 x=1!"), (8, "a b c d e f g h"), (9, "a b c d e f g h")]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 8 else "s", 1, "x", "y") for i, t in rows], DOCS)


def items(spark):
    return spark.createDataFrame([(1, "b c d"), (2, None), (3, ""), (4, " ".join(f"w{i}" for i in range(100, 125))), (1, "b c d"), (None, "a b")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(8, 1, 0), (9, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


def words_of(text):
    return (text or "").encode().lower().split()


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = words_of(t)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("block", [400_000, 600, 60])
def test_join_equals_brute_force(spark, block):
    rng = np.random.default_rng(block)
    base = [rng.integers(0, 4000, 60).tolist() for _ in range(12)]
    rows = []
    for i in range(90):
        w = list(base[int(rng.integers(0, 12))])
        for _ in range(int(rng.integers(0, 5))):
            w[int(rng.integers(0, 60))] = int(rng.integers(0, 4000))
        rows.append((i, " ".join(map(str, w[: int(rng.integers(40, 61))]))))
    got = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), block_tokens=block).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_join_of_odd_rows(spark):
    got = {(r.id, r.n_shingles, r.component_id) for r in ngram_join.link_components(odd_docs(spark)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (8, 4, 8), (9, 4, 8), (None, 1, None)} <= got
    assert next(c for i, _, c in got if i == 6) == 5
    assert ngram_join.link_components(odd_docs(spark, [])).count() == 0


def test_join_of_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(80)) for x in "abcd")
    half = " ".join(a.split()[:42] + b.split()[38:])
    run = lambda rows: {(r.id, r.component_id) for r in ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert run([(1, a), (1, b), (4, half)]) == {(1, 1), (4, 4)}
    # 5 is one document with two texts, so whoever equals either is linked with it
    assert run([(1, a), (5, a), (5, c), (7, c + " tail"), (2, d), (9, b), (9, d), (9, ""), (9, None)]) == {(1, 1), (5, 1), (7, 1), (2, 2), (9, 2), (9, 9)}
    with pytest.raises(TypeError):
        ngram_join.link_components(spark.createDataFrame([("x", a)], "doc_id string, text string"))


def test_one_of_each(spark):
    docs = odd_docs(spark).withColumn("GONE_ID", F.lit(1))
    kept = ngram_join.one_of_each(docs)
    got = Counter((r.doc_id, r.text and r.text[:9]) for r in kept.collect())
    assert kept.columns == docs.columns
    assert got == Counter({(1, None): 1, (2, ""): 1, (3, "one two"): 2, (5, "w0 w1 w2 "): 1, (None, "loose row"): 1, (7, "Ångström "): 1, (8, "a b c d e"): 1})


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    key = lambda r: tuple(round(v, 7) if isinstance(v, float) else v for v in r)
    assert Counter(map(key, queries.QUERIES[name](spark, sf).select(*columns).collect())) == Counter(map(key, want.fetchall()))


def test_decontamination_of_odd_rows(spark):
    got = {r.id: r for r in decontaminate.contaminate(odd_docs(spark), items(spark)).collect()}
    assert got[8].n_hit == 3 and got[8]["items"] == ["1"] and got[1].n_words == 0 and got[5]["items"] == ["4"]
    assert got[5].n_hit == 25 * 31 - (25 if 30_000 - 30 * 977 < 125 else 0)
    assert decontaminate.contaminate(odd_docs(spark), items(spark).limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    kept = decontaminate.clean(odd_docs(spark), items(spark))
    assert kept.columns == odd_docs(spark).columns and kept.count() == 7


def test_media_round_trip(spark):
    rows = odd_docs(spark)
    for r, text in ((r, r.text) for r in media.describe(media.store_payload(rows, "text"), payload=True).collect()):
        raw = (text or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert r.stored.n_bytes == len(raw) and r.stored.payload_sha256 == hashlib.sha256(full).hexdigest() and r.stored.tail_crc32 == zlib.crc32(full[-32:])
    bad = spark.createDataFrame([(None,), (bytearray(b""),), (bytearray(b"\xff\xd8junk"),), (bytearray(media.encode([b"abc"])[0][:-9]),)], "media binary")
    assert all(r.jpeg.error for r in media.describe(bad).collect())


def test_general_jpeg_scan():
    """Two components, zero runs and no restart markers, against bits laid out by hand."""
    dc, ac = media.codes(media.DC_BITS, media.DC_VALUES), media.codes(media.AC_BITS, media.AC_VALUES)
    rng = np.random.default_rng(1)
    blocks = np.where(rng.random((4, 2, 64)) < 0.2, rng.integers(-90, 90, (4, 2, 64)), 0)
    bits, before = "", [0, 0]
    number = lambda v, n: format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""
    code = lambda c: format(c[0], f"0{c[1]}b")
    for mcu in blocks:
        for part, block in enumerate(mcu):
            d = int(block[0]) - before[part]
            before[part] = int(block[0])
            bits += code(dc[abs(d).bit_length()]) + number(d, abs(d).bit_length())
            run = 0
            last = max([k for k in range(1, 64) if block[k]], default=0)
            for k in range(1, last + 1):
                if not block[k]:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + code(ac[0xF0]), run - 16
                n = abs(int(block[k])).bit_length()
                bits, run = bits + code(ac[run << 4 | n]) + number(int(block[k]), n), 0
            if last < 63:
                bits += code(ac[0])
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    head = media._header(0, 1)
    image = head[:2] + media._segment(0xC0, bytes([8, 0, 16, 0, 16, 2, 1, 0x11, 0, 2, 0x11, 0]))
    image += media._segment(0xC4, b"\0" + bytes(media.DC_BITS) + media.DC_VALUES) + media._segment(0xC4, b"\x10" + bytes(media.AC_BITS) + media.AC_VALUES) + media._segment(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (found,) = media.decode([image])[0]
    assert (found["coefficients"].reshape(4, 2, 64) == blocks).all()
    assert (found["luma"] == blocks[:, 0, 0].reshape(2, 2)).all()


def test_jpeg_of_several_scans():
    """Three parts, one of them of half size, each in a scan of its own, against the same blocks laid out part by part."""
    dc, ac = media.codes(media.DC_BITS, media.DC_VALUES), media.codes(media.AC_BITS, media.AC_VALUES)
    code = lambda c: format(c[0], f"0{c[1]}b")
    number = lambda v, n: format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def scan(values):
        bits, before = "", 0
        for v in values:
            d, before = v - before, v
            bits += code(dc[abs(d).bit_length()]) + number(d, abs(d).bit_length()) + code(ac[0])
        bits += "1" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")

    luma, two, three = [5, -9, 30, 2, 0, -4], [7, 8], [1, -1]  # 24 x 16 pixels, the others at half size both ways
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + b"\2" * 64)
    head += media._segment(0xC0, bytes([8, 0, 16, 0, 24, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    head += media._segment(0xC4, b"\0" + bytes(media.DC_BITS) + media.DC_VALUES) + media._segment(0xC4, b"\x10" + bytes(media.AC_BITS) + media.AC_VALUES)
    parts = [(1, luma), (3, three), (2, two)]
    image = head + b"".join(media._segment(0xDA, bytes([1, k, 0, 0, 63, 0])) + scan(v) for k, v in parts) + b"\xff\xd9"
    (found,), = media.decode([image])
    assert found["luma"].tolist() == [luma[:3], luma[3:]] and found["q_dc"] == 2
    assert found["coefficients"][:, 0].tolist() == luma + three + two
    assert isinstance(media.decode([head + media._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan(luma) + b"\xff\xd9"])[0], str)


def test_token_rollup(spark, tmp_path):
    roll = token_counts.Rollup(spark, str(tmp_path / "r"))
    assert roll.totals().count() == 0
    docs = odd_docs(spark)
    assert roll.commit("one", token_counts.inserts(docs, "words-1")) and not roll.commit("one", token_counts.inserts(docs, "words-1"))
    total = roll.totals().agg(F.sum("documents"), F.sum("tokens")).first()
    assert tuple(total) == (11, sum(len(words_of(r.text)) for r in docs.collect()))
    back = token_counts.inserts(docs, "words-1").select(F.col("after").alias("before"), token_counts.nothing().alias("after"))
    assert roll.commit("two", back) and roll.totals().count() == 0


def test_rollup_commits_once_and_compacts(spark, tmp_path):
    docs = odd_docs(spark)
    roll, other = (token_counts.Rollup(spark, str(tmp_path / "r")) for _ in range(2))
    rows = lambda r: sorted(map(tuple, r.totals().collect()), key=str)
    assert roll.commit("one", token_counts.inserts(docs, "words-1"))
    # a second writer that has not seen the first one's commit
    aside = str(tmp_path / "r" / "aside-late")
    token_counts.deltas(token_counts.inserts(docs, "words-1")).write.parquet(aside)
    assert not other._publish(aside, str(tmp_path / "r" / "batch=one")) and not (tmp_path / "r" / "aside-late").exists()
    before = rows(roll)
    roll.commit("two", token_counts.inserts(docs, "alnum-1"))
    both = rows(roll)
    roll.compact()
    assert rows(roll) == both and len(both) == 2 * len(before) and roll.committed() == ["one", "two"]
    assert not other.commit("one", token_counts.inserts(docs, "words-1")) and rows(other) == both
    other.commit("three", token_counts.inserts(docs, "words-1"))
    other.compact()
    other.compact()
    assert roll.committed() == ["one", "three", "two"] and sum(r[3] for r in rows(roll)) == 33
    changes = spark.createDataFrame([(None, None)], f"before {token_counts.IMAGE}, after {token_counts.IMAGE}")
    assert roll.commit("none", changes) and sum(r[3] for r in rows(roll)) == 33


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="no vocabulary files")
def test_counts_of_public_vocabularies(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, "<|endoftext|>")], "doc_id long, text string")
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        got = {r.doc_id: r.tokens for r in token_counts.vocabulary_counts(docs, f"/opt/tokenizers/{name}").collect()}
        assert got[1] >= 2 and got[2] == 0 and got[3] > 1
    changes = token_counts.inserts(token_counts.vocabulary_counts(docs.withColumns({"source": F.lit("s"), "lang": F.lit("en")}), "/opt/tokenizers/byte_bpe_50k.json"), "byte-bpe-50k", F.col("tokens"))
    assert token_counts.deltas(changes).first().documents == 3


def test_lm(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    rows = [(r.doc_id, words_of(r.text) + [b"\n"]) for r in docs.collect()]
    learn = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    c = Counter(w for i, ws in rows if learn(i) for w in ws)
    total, distinct = sum(c.values()), len(c)
    want = Counter((i, len(ws), sum(w in c for w in ws), round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws), 4)) for i, ws in rows)
    got = lm_score.digest(docs).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.score <= 0 and r.train_tokens == total for r in got)
    assert lm_score.digest(odd_docs(spark, [])).count() == 0


def small_vocabulary(head=900, seed=0):
    rng = np.random.default_rng(seed)
    words = sorted({"".join(rng.choice(list("abcdefg"), int(rng.integers(2, 6)))).encode() for _ in range(head)})
    counts = np.sort(rng.integers(1, 500, len(words)))[::-1].astype(float)
    return lm_score.Vocabulary(lm_score.Words({w: i for i, w in enumerate(words)}), counts, 1 + rng.random(lm_score.BUCKETS) * 50, int(counts.sum()), len(words))


def test_lm_is_normalised():
    known = small_vocabulary()
    rng = np.random.default_rng(1)
    place, edge = rng.integers(-lm_score.BUCKETS, len(known.words), 3000).astype(np.int32), np.array([0, 1000, 1000, 3000])
    p, _, _ = lm_score.nce(known, start := lm_score.initial(known), {k: np.full_like(v, 1e-6) for k, v in start.items()}, place, edge, least=60)
    every = np.concatenate([np.arange(-lm_score.BUCKETS, 0), np.arange(len(known.words))]).astype(np.int32)
    for before in ([], [5], [7, 600], [-3, 1]):
        texts = np.concatenate([np.array([*before, y], np.int32) for y in every])
        got = lm_score.log_probabilities(known, p, texts, np.arange(0, len(texts) + 1, len(before) + 1))[len(before) :: len(before) + 1]
        assert abs((10**got).sum() - 1) < 1e-3


def test_lm_score_equals_a_plain_computation(spark, sf):
    """The query's model score of every row against sums of exponentials over all classes and words, token by token."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 400").limit(25).unionByName(odd_docs(spark, [(1, None), (2, ""), (3, "one two"), (3, "One two")]).select("doc_id", "text", "lang", "source", "n_chars"))
    base = docs.select(F.col("doc_id").alias("id"), "text")
    learn = shared.remainder(F.col("id"), 7) != 2
    counts = lm_score.count(base, learn)
    c, known = {r.word.encode(): r.c for r in counts.collect()}, lm_score.vocabulary(counts)
    p = {k: v.astype(float) for k, v in lm_score.train(base, learn, known).items()}

    def plain(words):
        total, none = 0.0, known.vectors + lm_score.BUCKETS
        own = [known.words[w] for w in words]
        at = [none, none] + [x if x >= 0 else known.vectors - 1 - x for x in own]
        for i, (w, x) in enumerate(zip(words, own, strict=True)):
            h = p["q"][at[i + 1]] @ p["one"] + p["q"][at[i]] @ p["two"]
            scores = p["r"][:, :-1] @ h + p["r"][:, -1]
            y = int(known.classes[x]) if x >= 0 else lm_score.SINGLES - 1 - x
            total += scores[y] - np.log(np.exp(scores).sum())
            if x < 0:
                total += np.log((c.get(w, 0) + 1) / known.mass[-1 - x])
            elif x >= lm_score.SINGLES:
                low = int(known.slot[x]) // lm_score.GROUP * lm_score.GROUP
                inner = p["s"][low : low + lm_score.GROUP] @ np.append(h, 1)
                total += inner[int(known.slot[x]) - low] - np.log(np.exp(inner).sum())
        return total / math.log(10)

    want = Counter((r.doc_id, round(plain(words_of(r.text) + [b"\n"]), 2)) for r in docs.collect())
    got = Counter((r.doc_id, round(r.score, 2)) for r in lm_score.digest(docs).collect())
    near = lambda a, b: all(any(x[0] == y[0] and abs(x[1] - y[1]) < 0.03 for y in b) for x in a)
    assert near(want, got) and near(got, want) and want.total() == got.total()


def test_lm_does_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    base = docs.select(F.col("doc_id").alias("id"), "text")
    learn = shared.remainder(F.col("id"), 7) != 2
    known = lm_score.vocabulary(lm_score.count(base, learn))
    made = [lm_score.train(base.repartition(n), learn, known, shard=20_000, rounds=2) for n in (1, 48)]
    assert all(np.allclose(made[0][k], made[1][k], atol=1e-5) for k in made[0])


def test_nonnegative_pu():
    rng = np.random.default_rng(2)
    def draw(n, rate):
        y = rng.random(n) < rate
        x = (rng.random((n, 6)) < np.where(y[:, None], [0.7, 0.7, 0.7, 0.3, 0.3, 0.3], [0.02, 0.02, 0.02, 0.3, 0.3, 0.3])).astype(np.uint8)
        return x, y
    p, u, (x, y) = draw(400, 1.1)[0], draw(3000, 0.1)[0], draw(3000, 0.1)
    rows = lambda m: toxicity.Rows([np.flatnonzero(r) for r in m], m.shape[1])
    w, b = toxicity.fit(rows(p), rows(u), 0.1)
    said = x @ w + b > 0
    assert (said == y).mean() > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, module):
    for rows, marks in ((None, labels(spark)), (None, labels(spark).limit(0)), ([], labels(spark))):
        docs = odd_docs(spark, rows)
        got = module.digest(docs, marks).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert module.clean(docs, marks).columns == docs.columns


def test_scores_equal_the_models_own(spark, sf):
    """Every row of the query against the trained model applied to the row's text alone, term by term."""
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet").limit(80).unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, marks)
    for r in quality.score(docs, model).collect():
        x = quality.figures(np.frombuffer((r.text or "").encode(), np.uint8), np.array([0, len((r.text or "").encode())]))[0]
        place = [int(sum(c <= v for c in cuts)) for v, cuts in zip(x, model.cuts, strict=True)]
        coarse = [b * quality.PAIR_BINS // (len(c) + 1) for b, c in zip(place, model.cuts, strict=True)]
        g = model.bias + sum(t[b] for t, b in zip(model.tables, place, strict=True)) + sum(t[coarse[f], coarse[g]] for f, g, t in model.pairs)
        assert abs(r.score - 1 / (1 + math.exp(-g))) < 1e-9
    model = toxicity.Model({b"\0\1bad": 2.0, b"\4\1rott": 1.0, b"\4\2rott": 0.5, b"\4\3rott": 0.25}, -1.0)
    want = {"fine": -1.0, "Bad bad": 1.0, "rotten": 0.0, "rott": -1.0, "rotten rotter": 0.5, "rotten rotter rotting rotted bad": 2.75, "": -1.0}
    got = toxicity.score(spark.createDataFrame([(t,) for t in want], "text string"), model).collect()
    assert all(abs(r.score - 1 / (1 + math.exp(-want[r.text]))) < 1e-12 for r in got)


def test_draws_of_any_size(spark):
    share = lambda bound, rows: spark.range(200_000).where(shared.drawn(F.col("id"), bound, rows, 6)).count()
    assert share(10, 10) == 200_000 and abs(share(20_000, 200_000) - 20_000) < 800
    top = -(1 << 63) + (12_000 << 64) // 10**11
    assert str(top) in str(shared.drawn(F.col("id"), 12_000, 10**11, 6)) and top > -(1 << 63)
    docs, marks = odd_docs(spark), labels(spark).unionByName(spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int"))
    with pytest.raises(ValueError):
        toxicity.train(docs, marks, learn=F.lit(True), rows=10**18)
    with pytest.raises(ValueError):
        quality.train(docs, marks, marked=10**18)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_cleaning_keeps_columns_of_any_name(spark, module):
    docs = odd_docs(spark).withColumns({"toxicity_score": F.lit(1), "QUALITY_SCORE": F.lit(2), "score": F.lit(3)})
    got = module.clean(docs, labels(spark))
    assert got.columns == docs.columns and got.count() <= docs.count()
    assert module.clean(docs, labels(spark).limit(0)).count() == docs.count()


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/ \r\nx", "<p>\r\nWARC/1.1\r\n</p>"), (2, None, None), (3, "u", ""), (4, "http://b", "<p>\r\nWARC/1.1\r\n</p>"), (None, "n", "n")], "page_id long, url string, html string")
    pages = pages.unionByName(spark.createDataFrame([(5, "x", "one"), (5, "x", "two"), (None, "n", "n"), (6, "u", "y" * 70_000), (7, "u", "z" * 1_200_000)], pages.schema))
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to, r.n_requests, r.n_metadata) for r in warc.digest(pages).collect())
    new = lambda page, size: (page, size, "response", None, 1, 1)
    assert got == [new(0, 1), new(0, 1), new(1, 19), new(2, 0), (3, 0, "revisit", 2, 1, 1), (4, 19, "revisit", 1, 1, 1), new(5, 3), new(5, 3), new(6, 70_000), new(7, 1_200_000)]
    assert warc.digest(pages.limit(0)).count() == 0


def test_warc_rows_equal_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for page, html in sorted(rows):
        first.setdefault(html, page)
    sha = lambda html: base64.b32encode(hashlib.sha1(html).digest()).decode()
    want = {page: (len(html), sha(html), *(("response", None) if first[html] == page else ("revisit", first[html]))) for page, html in rows}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.digest(pages).collect()} == want


def test_warc_captures_hold_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, "v", "<p>a</p>")], "page_id long, url string, html string")
    warc.write_pages(pages, str(tmp_path / "w"))
    got = {r.main.record_id.split(":")[2]: r for r in warc.assemble(warc.read(spark, str(tmp_path / "w"))).collect()}
    assert bytes(got["1"].main.payload) == b"<p>a</p>" and got["2"].main.payload is None and got["2"].main.refers_to == got["1"].main.record_id
    assert got["1"].requests[0].fields.startswith("GET u ")


def test_tree_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    parent, level = np.array([-1, 0, 0, 1, 1]), np.array([0, 1, 1, 2, 2])
    unary, pair = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    total, mine = 0.0, np.zeros((5, 2))
    for k in range(32):
        s = [k >> i & 1 for i in range(5)]
        v = math.exp(sum(unary[i, s[i]] for i in range(5)) + sum(pair[s[parent[i]], s[i]] for i in range(1, 5)))
        total += v
        for i in range(5):
            mine[i, s[i]] += v
    assert np.allclose(html_text.marginals(unary, pair, parent, level)[0], mine / total)


def test_html(spark):
    model = html_text.train(html_text.labelled_pages())
    held = [html_text.parse(p) for p in html_text.labelled_pages(60, seed=5)]
    right = [("" if not x else (q >= 0.5) == bool(y)) for t, p in zip(held, model.content(held), strict=True) for x, q, y in zip(t.texts, p, t.label, strict=True) if x]
    assert np.mean(right) > 0.97
    page = '<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Title here</h1><p>One &amp; two,\n three. It goes on.<p>Four <b>five</b>, and six.</article><footer>&copy; me</footer>'
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (None, "v", "<p"), (3, "w", "<<<>>&#xFFFFFFFF;")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages, model=model).collect()}
    assert got[1] == "Title here\nOne & two, three. It goes on.\nFour five, and six." and got[2] == ""


def test_raking(spark):
    cells = spark.createDataFrame([("a", "x", "p", 100), ("a", "y", "q", 10), ("b", "x", "p", 30), (None, "y", "q", 0), ("b", "y", "p", 7)], "source string, lang string, topic string, tokens long")
    local, wide = (mixing.rake(cells, 30, local=n).collect() for n in (100, 1))
    key = lambda r: (r.source or "", r.lang, r.topic)
    assert np.allclose([r.weight for r in sorted(local, key=key)], [r.weight for r in sorted(wide, key=key)])
    assert abs(sum(r.weight for r in local if r.source == "a") - 110**0.5 / (110**0.5 + 37**0.5)) < 1e-3
    got = mixing.digest(odd_docs(spark))
    assert got.count() == 11 and mixing.digest(odd_docs(spark, [])).count() == 0


@pytest.mark.parametrize("given", [None, {"big": 0.7, "small": 0.3}])
def test_draw_has_the_target_marginals(spark, given):
    rows = [(i, "w " * 20, "en", "big") for i in range(40)] + [(100 + i, "w " * 4, "en", "small") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    tables = given and {"source": spark.createDataFrame([*given.items(), ("none here", 9.0)], "source string, target double")}
    want = given or {"big": 800**0.5 / (800**0.5 + 32**0.5), "small": 32**0.5 / (800**0.5 + 32**0.5)}
    mixed = mixing.mix(docs, given=tables, calibrate=True)
    got = {r.value: r for r in mixing.marginals(mixed, tables, None).where("dimension = 'source'").collect()}
    assert all(abs(got[k].target - v) < 1e-6 and abs(got[k].expected - v) < 1e-6 for k, v in want.items())
    assert abs(mixed.agg(F.max("probability")).first()[0] - 1) < 1e-6
    n = mixing.sample(docs, given=tables, calibrate=True).where("source = 'small'").count()
    assert n == 8


def test_draw_within_a_budget(spark):
    """Shares that all documents of a value can't fill are lowered to what they can; the rest of the draw goes to the others."""
    rows = [(i, "w " * 20, "en", "big" if i < 300 else "mid" if i < 380 else "small") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    given = {"source": spark.createDataFrame([("big", 0.3), ("mid", 0.3), ("small", 0.4)], "source string, target double")}
    got = {r.value: r for r in mixing.marginals(mixing.mix(docs, given=given), given).where("dimension = 'source'").collect()}
    want = {"big": (0.3, 0.5), "mid": (0.3, 0.4), "small": (0.4, 0.1)}  # mid: 80 of 200 documents at most, small: 20
    assert all(abs(got[k].wanted - a) < 1e-9 and abs(got[k].target - b) < 1e-9 and abs(got[k].expected - b) < 2e-3 for k, (a, b) in want.items())
    assert mixing.sample(docs, given=given).where("source <> 'big'").count() == 100


def test_drawn_shares_are_near_their_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(5, 60)), rng.choice(["en", "de", "fr"], p=[0.7, 0.2, 0.1]), rng.choice(["a", "b", "c", "d"], p=[0.6, 0.2, 0.15, 0.05])) for i in range(6000)]
    docs = spark.createDataFrame([(i, t, str(a), str(b)) for i, t, a, b in rows], "doc_id long, text string, lang string, source string")
    got = mixing.marginals(mixing.mix(docs)).collect()
    assert all(abs(r.expected - r.target) < 2e-3 and abs(r.drawn - r.target) < 0.02 for r in got)
    assert any(r.target < r.wanted - 1e-6 for r in got)


def test_sample_of_odd_rows(spark):
    docs = odd_docs(spark).withColumns({"mix_topic": F.lit("own"), "MIX_SOURCE": F.lit(2), "_id": F.lit(3), "cell_lang": F.lit(4)})
    got = mixing.sample(docs, budget=1.0)
    assert got.columns == [*docs.columns, "mix_topic_", "mix_tokens", "mix_probability"]
    assert got.count() == 11 and mixing.sample(docs.limit(0)).count() == 0
    # rows of one id in two cells are drawn one by one
    twice = spark.createDataFrame([(7, "w " * 10, "en", "s"), (7, "w " * 10, "en", "t")] + [(100 + i, "w " * 10, "en", "t") for i in range(8)], "doc_id long, text string, lang string, source string")
    given = {"source": spark.createDataFrame([("s", 1.0)], "source string, target double")}
    assert [r.source for r in mixing.sample(twice, 0.1, given).collect()] == ["s"]


def test_raking_to_given_targets_both_ways(spark):
    cells = spark.createDataFrame([("a", "x", "p", 100), ("a", "y", "q", 10), ("b", "x", "p", 30), (None, "y", "q", 5), ("b", "y", "p", 7)], "source string, lang string, topic string, tokens long")
    given = {"source": spark.createDataFrame([("a", 9.0), (None, 1.0)], "source string, target double")}
    for local in (100, 1):
        got = mixing.rake(cells, 6, dimensions=("source", "lang"), local=local, given=given).groupBy("source").agg(F.sum("weight").alias("w")).collect()
        assert np.allclose([r.w for r in sorted(got, key=lambda r: r.source or "")], [0.1, 0.9, 0], atol=1e-3)


def test_decontamination_drops_rows_not_ids(spark):
    docs = odd_docs(spark, [(None, "a b c d e"), (None, "loose row"), (3, "x b c d"), (3, "clean one"), (3, None)])
    kept = decontaminate.clean(docs, items(spark).where("item_id = 1")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "loose row"), (3, ""), (3, "clean one")]


def test_feature_is_of_all_images(spark):
    tail = F.when(F.col("id") == 1, F.repeat(F.lit("a"), 2_000_000)).otherwise(F.repeat(F.lit("z"), 2_000_000))
    long = spark.range(1, 3, 1, 1).select("id", F.concat(F.repeat(F.lit("ab"), 8191 * 576 // 2), tail).alias("text"))
    one, two = (r.jpeg for r in media.describe(media.store_payload(long, "text").drop("text")).orderBy("id").collect())
    rows = 8191 + -(-2_000_000 // 576)
    assert one.height == two.height == 8 * rows and one.width == two.width
    assert (one.thumb_ahash, one.thumb_dhash) != (two.thumb_ahash, two.thumb_dhash)


def test_warc_links_in_both_directions(spark):
    def made(kind, name, *beside):
        head = warc.record(kind, name, b"HTTP/1.1 200 OK\r\n\r\nx" if kind == "response" else b"y", Target_URI="u").split(b"\r\n", 1)
        return head[0] + b"\r\n" + b"".join(b"WARC-Concurrent-To: <%s>\r\n" % b.encode() for b in beside) + head[1] + b"\n"

    parts = [
        made("response", "r1", "q1"), made("request", "q1"), made("metadata", "m1", "q1"),  # the response names its request
        made("response", "r2"), made("request", "q2", "r2"), made("metadata", "m2", "q2"),  # the request names its response
        made("response", "r3", "q3", "m3"), made("request", "q3"), made("metadata", "m3"),  # repeated headers
        made("response", "r4"), made("request", "q4", "r4"), made("metadata", "m4", "q4"), made("metadata", "n4", "m4"),  # three links
        made("metadata", "m5", "r1", "r2"), made("request", "q6", "q7"), made("request", "q7"),  # two responses, none
    ]
    rows = [tuple(r[k] for k in warc.FIELDS) for r in warc.parse(io.BytesIO(b"".join(parts)))]
    got = warc.assemble(spark.createDataFrame(rows, ", ".join(f"{k} {t}" for k, t in warc.FIELDS.items()))).collect()
    names = lambda x: [i.record_id for i in x]
    assert {r.main.record_id: (names(r.requests), names(r.metadata)) for r in got} == {"r1": (["q1"], ["m1", "m5"]), "r2": (["q2"], ["m2", "m5"]), "r3": (["q3"], ["m3"]), "r4": (["q4"], ["m4", "n4"])}


def test_html_of_unclosed_and_deep_markup(spark):
    times = []
    for n in (4_000, 16_000):
        began = time.time()
        tree = html_text.parse("<button>x" * n + "<div>" * n + "deep" + "</div>" * n)
        times.append(time.time() - began)
        assert tree.level[-1] > n and tree.texts[-1] == "deep"
    assert times[1] < 12 * times[0] + 1
    pages = spark.createDataFrame([(1, "u", "<div>" * 3000 + "<p>Some text here, and more of it.</p>")], "page_id long, url string, html string")
    assert html_text.extract(pages).count() == 1 and html_text.digest(pages.limit(0)).count() == 0


def test_decontamination_of_repeated_ids(spark):
    docs = odd_docs(spark, [(3, "x b c d"), (3, "clean one"), (3, "b c d b c d"), (None, "b c d")])
    got = sorted((r.id or 0, r.n_words, r.n_hit, len(r["items"])) for r in decontaminate.contaminate(docs, items(spark)).collect())
    assert got == [(0, 3, 3, 1), (3, 2, 0, 0), (3, 4, 3, 1), (3, 6, 6, 1)]


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.shared_dir(Session)


def test_pipeline(spark, sf, tmp_path):
    """Stage by stage against each operator's own rows, brute force where there is one; then the whole run."""
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(9001, "bad idiot text", "en", None, 5), (None, "no id here at all, but words", None, "s", 9), (9002, None, "en", "s", 0), (9001, "bad idiot text", "en", None, 5)]
    odd = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    now = odd
    for name, stage in pipe.STAGES:
        after = shared.materialise(stage(spark, now, sf), name)
        rows, left = (Counter((r.doc_id, r.text) for r in d.collect()) for d in (now, after))
        assert left <= rows
        if name != "mixing":
            assert after.columns == docs.columns
        gone = rows - left
        if name == "toxicity":
            bad = toxicity.score(now, toxicity.train(now, spark.read.parquet(f"{sf}/labels.parquet"))).where(F.col("score") >= toxicity.THRESHOLD)
            assert gone == Counter((r.doc_id, r.text) for r in bad.collect())
        if name == "quality":
            bad = quality.score(now, quality.train(now, spark.read.parquet(f"{sf}/labels.parquet"))).where(F.col("score") < quality.THRESHOLD)
            assert gone == Counter((r.doc_id, r.text) for r in bad.collect())
        if name == "ngram_join":
            want = brute_components([(i, t) for i, t in rows if i is not None])
            assert {i for i, _ in gone} == {i for i, (n, c) in want.items() if c < i}
        if name == "decontamination":
            cut = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
            windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (w := cut(r.text)) for i in range(max(len(w) - 10, 0) + 1)}
            sizes = {len(w) for w in windows}
            hit = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
            assert gone == Counter({r: n for r, n in rows.items() if hit(cut(r[1]))})
        if name == "mixing":
            want = mixing.mix(now).where("sampled")
            assert Counter(r.doc_id for r in after.collect()) == Counter(r.id for r in want.collect())
        now = after
    whole = pipe.run(spark, sf)
    assert whole.count() > 0 and set(docs.columns) < set(whole.columns)
    empty = tmp_path / "none"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(empty / f"{t}.parquet"))
    assert pipe.run(spark, str(empty)).count() == 0
