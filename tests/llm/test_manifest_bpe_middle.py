"""The manifest, byte-level BPE and fill-in-the-middle against plain computations and public libraries."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.llm import byte_bpe, fill_middle, merkle, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Lang_ string, leaf string, rank int, ids string, n int, form string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z", 2, "w") for r in rows], DOCS).repartition(5)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def low(text):
    return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def leaf(row):
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in merkle.COLUMNS))


def tree(nodes):
    """The root of a list of digests, and each one's siblings (their place, their digests) up to it."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            j, first = at[i], at[i] // 8 * 8
            path.append((j - first, nodes[first:j] + nodes[j + 1 : first + 8]))
            at[i] = j // 8
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), leaf({**r, "text": low(r["text"])}) if hit else None))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    if not names:
        return
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
    subs = [tree([x[2] for x in groups[g]]) for g in names]
    root, tops = tree([s[0] for s in subs])
    for g, (sub, paths), top in zip(names, subs, tops, strict=True):
        for (known, doc_id, digest, changed), path in zip(groups[g], paths, strict=True):
            x = changed or digest
            for at, others in path + top:
                x = sha("".join([*others[:at], x, *others[at:]]))
            yield doc_id if known else None, digest, sub, root, sha("".join(o for _, others in path + top for o in others)), x, x == root


ODD = [
    (1, None, None, "s", 1), (1, None, None, "s", 1), (2, "", "", None, None), (3, "ABC Ä", "en", "s", 3), (None, "X", "en", "s", 1), (None, "X", "en", "s", 1), (None, None, None, None, None),
    (-5, "neg", "en", "s", 3), (-(2**63), "A", "en", "s", 1), (2**63 - 1, "B", "en", "s", 1), (4, "W" * 300_000, "en", "s", 1),
]
MANY = [*ODD, *[(7, "SAME", "de", "s", 4)] * 1300, *((7, f"Other{i}", "de", "s", 4) for i in range(20)), *((10**15 + i, "t", "fr", "s", 1) for i in range(70)), *((i, f"T{i}", f"l{i}", "s", i) for i in range(540))]


@pytest.mark.parametrize("rows", [MANY, ODD, ODD[3:4], []])
def test_manifest_equals_plain_trees(spark, rows):
    docs = frame(spark, rows)
    got = merkle.digest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(plain_manifest([r.asDict() for r in docs.collect()]))


def test_manifest_of_other_columns(spark):
    docs = spark.createDataFrame([(i, i % 2, f"v{i}") for i in range(20)], "k int, g int, v string")
    got = merkle.manifest(docs, ("k", "v"), "g", "k").collect()
    assert len({r.root for r in got}) == 1 and Counter(len(r.proof) for r in got) == Counter({3: 20})
    assert {r.leaf for r in got if r.k == 12} == {sha("2:12" + "3:v12")}
    assert sorted(r["rank"] for r in got if r.k % 2) == list(range(10))


@pytest.mark.parametrize("bucket", [1, 7, 10_000])
def test_radix_ranks(spark, bucket):
    rng = random.Random(bucket)
    keys = {(f"g{rng.randrange(3)}", "7777" + "".join(rng.choice("0123456789ABCDEF") for _ in range(rng.randrange(9)))): rng.randrange(1, 4) for _ in range(1500)}
    got = merkle.radix_ranks(spark.createDataFrame([(g, k, w) for (g, k), w in keys.items()], "g string, k string, w long"), "g", "k", "w", bucket).collect()
    want, total = {}, Counter()
    for g, k in sorted(keys):
        want[g, k] = total[g]
        total[g] += keys[g, k]
    assert {(r.g, r.k): r["rank"] for r in got} == want and len(got) == len(want)


@pytest.fixture(scope="module")
def public():
    P, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    ranks = byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return ranks, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=held, special_tokens={})


PARTS = ["a", "b", "'", " ", "\n", "\t", "1", "23", "é", "中", "'re", "'ll", "!", "?", "🙂", "　", "\x1c", "the", " ing", "ß"]


@pytest.mark.parametrize("seed", range(4))
def test_encoding_in_halves(public, seed):
    """Segments and leaves of a few characters, so that nearly every token is near a join."""
    ranks, pattern, own = public
    rng = random.Random(seed)
    codec = byte_bpe.Codec(ranks, pattern, rng.choice([1, 2, 5]), rng.choice([1, 2, 8]))
    for _ in range(300):
        some = rng.sample(PARTS, rng.choice([2, 3, 6, len(PARTS)]))
        text = "".join(rng.choice(some) * rng.choice([1, 1, 2, 9]) for _ in range(rng.randrange(60)))
        ids = codec.encode(text)
        assert ids == byte_bpe.packed(own.encode_ordinary(text)), text
        assert codec.decode(ids) == text.encode()


def test_encoding_of_long_runs_and_any_character(public):
    ranks, pattern, own = public
    codec = byte_bpe.Codec(ranks, pattern)
    for text in (" " * 40_001, "a" * 40_001, "ab" * 20_001 + "c", "'" * 9_001, "é" * 9_001, "x1 " * 30_001, *("a" + chr(c) + " b" + chr(c) * 2 + "  x" for c in range(0, 0x3100) if not 0xD800 <= c < 0xE000)):
        assert codec.encode(text) == byte_bpe.packed(own.encode_ordinary(text))


def test_bpe_equals_public_library(spark, sf, public):
    own = public[2]
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = byte_bpe.packed(own.encode_ordinary(r.text or ""))
        want[r.doc_id] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), sha(r.text or ""))
    got = queries.QUERIES["op12_byte_bpe"](spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == want


def test_bpe_of_odd_rows(spark, public):
    ranks, pattern, own = public
    docs = frame(spark, ODD)
    got = byte_bpe.decode(byte_bpe.encode(docs, ranks, pattern), ranks, pattern)
    assert got.columns == [*(c for c in docs.columns if c != "ids"), "ids", "data"]
    rows = got.collect()
    assert len(rows) == len(ODD) and all(r.data.decode() == (r.text or "") and r.ids == byte_bpe.packed(own.encode_ordinary(r.text or "")) for r in rows)
    assert byte_bpe.encode(docs.limit(0), ranks, pattern).count() == 0
    bad = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61FF62') AS string) AS text")
    assert byte_bpe.decode(byte_bpe.encode(bad, ranks, pattern), ranks, pattern).first().data == "a�b".encode()
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decode(spark.sql("SELECT unhex('FFFFFFFF') AS ids"), ranks, pattern).collect()


GRAMMARS = {"lines": r"[^\n]*\n|[^\n]+", "sentences": r"[^.!?]*[.!?]|[^.!?]+", "words": r"\s*\S+|\s+", "words with space": r"\S+\s*|\s+", "characters": r"(?s:.)"}


@pytest.mark.parametrize("unit", sorted(GRAMMARS))
def test_units_equal_their_grammar(spark, unit):
    rng = random.Random(3)
    texts = ["", "\n", "\n\n", "a", "a\nb", "a\n", *("".join(rng.choice(["a", " ", "\n", "\r", "é", "🙂", ".", "?", "b"]) for _ in range(rng.randrange(30))) for _ in range(200))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fill_middle.units(F.col("t"), fill_middle.UNITS[unit]).alias("u")).collect()
    assert all(r.u == re.findall(GRAMMARS[unit], r.t) for r in got)


def plain_middle(doc_id, text, unit, seed, rate, spm, marks):
    p, s, m = marks
    text, h = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = re.findall(GRAMMARS[unit], text)
    if not text or any(x in text for x in marks) or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    i, j = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    a, b, c = "".join(u[:i]), "".join(u[i:j]), "".join(u[j:])
    return (len(u), "spm", len(a), len(b), s + c + p + a + m + b) if h4 % 100 < spm else (len(u), "psm", len(a), len(b), p + a + s + c + m + b)


TEXTS = [(100 + i, "".join(random.Random(i).choice(["a\n", "🙂", "<", "P>", "<S", ">", "M", "\n", " w"]) for _ in range(i % 23)), "en", "s", 1) for i in range(300)]


@pytest.mark.parametrize("kept", [("lines", 7, 100, 50, ("<P>", "<S>", "<M>")), ("words", 11, 60, 0, ("<P>", "<S>", "<M>")), ("characters", 2, 100, 100, ("{a}", "{b}", "{c}"))])
def test_middle_equals_plain(spark, kept):
    unit, seed, rate, spm, marks = kept
    docs = frame(spark, ODD + TEXTS)
    got = fill_middle.transform(docs, unit=unit, seed=seed, rate=rate, spm=spm, markers=marks)
    rows = got.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"), marks)).collect()
    assert Counter(tuple(r)[:-1] for r in rows) == Counter((r.doc_id, *plain_middle(r.doc_id, r.text, unit, seed, rate, spm, marks)) for r in docs.collect())
    assert Counter((r.doc_id, r.back) for r in rows) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert fill_middle.digest(docs.limit(0)).count() == 0


def test_markers_that_could_not_be_found_again():
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "<PP", "P>x"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>"), ("<S>", "x<S>y", "<M>")):
        with pytest.raises(ValueError, match="markers"):
            fill_middle.transform(None, markers=marks)
