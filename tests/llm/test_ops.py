"""Operators for training data against brute-force versions and on odd input."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taqlspark.llm import ann, bpe, chroma, dac, licenses, packing, pieces, pii, quality, queries, simhash, urls
from taqlspark.session import stage_path

ODD = [
    (1, ""), (2, None), (3, " "), (4, "a"), (5, "A b"), (6, "the same text twice"), (7, "The SAME text twice"), (7, "the same text twice"), (None, "the same text twice"),
    (8, "x" * 40_000), (9, ("word " * 9000).strip()), (10, "  two  spaces \n\n and\tmore "), (11, "Straße 日本語 é ́ \x00 end"), (12, "don't 12,345.6!? ### ok"), (None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", "y", 1, "z") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, score string, n_tokens int, component_id string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def tokenizer(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


# near duplicates
def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (id, fingerprint); the smallest id within reach over at most two bits a step."""
    distinct = sorted({p for _, p in prints})
    up = {p: p for p in distinct}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                up[root(a)] = root(b)
    best = {}
    for i, p in prints:
        r = root(p)
        if i is not None:
            best[r] = min(best.get(r, i), i)
        best.setdefault(r, best.get(r))
    return [best.get(root(p)) for _, p in prints]


def test_simhash_queries(spark, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op1_simhash(spark, DATA).collect()}
    prints = [(i, plain_fingerprint(t)) for i, t in texts.items()]
    want = plain_components(prints)
    assert got == {i: (f"{p:016x}", c) for (i, p), c in zip(prints, want, strict=True)}


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        if r["id"] in (6, 7) or r["component_id"] == 6:
            assert r["component_id"] == 6
    zero = [r for r in got if r["fp"] == 0]
    assert len(zero) == 4 and {r["component_id"] for r in zero} == {1}
    assert simhash.near_duplicates(empty).collect() == []
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["text"] and "same" in r["text"].lower()) == [6]
    assert simhash.deduplicate(odd.unionByName(odd)).count() == kept.count()


@pytest.mark.parametrize("bucket", [2, 128])
def test_pivot_links_either_way(spark, bucket):
    """Small buckets send almost all through neighbouring words; the components are the same."""
    draw = random.Random(5)
    values = set()
    for _ in range(60):
        x = draw.getrandbits(64)
        values.add(x)
        for _ in range(draw.randrange(12)):
            x ^= 1 << draw.randrange(64) | 1 << draw.randrange(64)
            values.add(x)
    signed = [(int(np.array(v, np.uint64).astype(np.int64)),) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), bucket)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    prints = [(k, v) for k, v in enumerate(sorted(values))]
    want = plain_components(prints)
    groups = {}
    for (k, v), c in zip(prints, want, strict=True):
        s = int(np.array(v, np.uint64).astype(np.int64))
        groups.setdefault(c, set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({x for g in groups.values() for x in g}) == len(groups)


# personal data
def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans():
    draw = random.Random(1)
    for _ in range(30_000):
        letters = draw.choice(["a@.b-1", "12.+ ()-a", "+1 2-", "0123456789 -", "a@b.c@", "1.2.34", "255.0 "])
        t = "".join(draw.choice(letters) for _ in range(draw.randrange(40)))
        assert plain_spans(t) == pii.base_spans(t)
    assert pii.base_spans("9" * 200_000 + "a" * 200_000 + "." * 9 + "@") == []


def test_pii_query(spark, texts):
    for r in queries.op2_pii(spark, DATA).collect():
        base = plain_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert set(joined.split(",")) <= set(r["spans"].split(","))


def test_bootstrap_discovers(spark):
    """Numbers without a country code are found where known ones taught the context, and only there."""
    rows = [(i, f"please call me at +1 (555) 010-{1000 + i} after lunch") for i in range(30)]
    rows += [(100, "please call me at 555 0199 888 after lunch"), (101, "the part number 555 0188 777 is sold out"), (102, None), (103, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r for r in pii.find(docs).collect()}
    assert got[100]["n_added"] == 1 and got[100]["spans"].startswith("phone:18:30")
    assert got[101]["n_added"] == 0 and got[102]["spans"] == "" and got[103]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[100] == "please call me at <phone> after lunch" and clean[0] == clean[100]
    assert clean[101] == rows[31][1] and clean[102] is None


def test_pii_odd(odd, empty):
    assert pii.find(odd).count() == len(ODD)
    assert pii.find(empty).collect() == []
    assert pii.redact(odd).columns == odd.columns


# tokens
def ranks():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def plain_coding():
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})


def test_stitching(plain_coding):
    coder = bpe.Coder.of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    draw = random.Random(3)
    for _ in range(3000):
        letters = draw.choice([" \n", "ab 1.\n'", "abs' t\n\t", "a", "  a", "a1.,é ", "'s re"])
        t = "".join(draw.choice(letters) * draw.choice([1, 1, 1, 2, 5, 30]) for _ in range(draw.randint(1, 60)))
        size, over = draw.choice([3, 7, 16, 40]), draw.choice([1, 2, 5, 8, 16])
        starts = bpe.chunk_starts(len(t), size)
        scans = [[b + s for b in coder.borders(t[s : s + size + over], 0, len(t[s : s + size + over]))] for s in starts]
        parts = bpe.stitch(t, scans, starts, lambda a, b, t=t: coder.borders(t, a, b)) if len(starts) > 1 else [t]
        assert "".join(parts) == t and coder.encode(parts) == plain_coding.encode_ordinary(t)


def test_bpe_query(spark, texts, plain_coding):
    for r in queries.op3_bpe_chunks(spark, DATA).collect():
        ids = plain_coding.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_odd(odd, empty, plain_coding):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    got = bpe.encode_documents(odd, path, pattern, keep_ids=True, chunk=500, overlap=20).collect()
    want = sorted((str(i), plain_coding.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD)
    assert sorted((str(r["id"]), list(r["ids"]), bytes(r["decoded"])) for r in got) == want
    assert bpe.encode_documents(empty, path, pattern).collect() == []


@pytest.mark.parametrize(("name", "words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces(name, words):
    draw = random.Random(2)
    made = ["".join(draw.choice(" \n\tab1É.,'s 　") for _ in range(draw.randint(1, 60))) for _ in range(2000)]
    made += ["".join(draw.choice([" ", "\n", "ab", "Ab", "É", "1", ".", "###", "|", " a"]) for _ in range(draw.randint(1, 30))) for _ in range(2000)]
    made += [t for _, t in ODD] + ["\n", "a\n", "\na b", "a\x00 b \x00c", "<|endoftext|> a", "İΣς ﬁ"]
    plain = tokenizer(name)
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch([t or "" for t in made], add_special_tokens=False)]
    encoder = pieces.PieceEncoder.of(public_tokenizers.path(name), words)
    assert encoder.ids(made) == want
    assert encoder.ids(made, entries=10) == want and encoder.ids(made, entries=10) == want


def test_levels():
    draw = np.random.default_rng(1)
    ids = draw.integers(0, 2**32, 3000, dtype=np.uint32) >> draw.integers(0, 32, 3000, dtype=np.uint32)
    shard = dac.Shard(dac.write_shard([5, None, 7], [1000, 0, 2000], ids))
    assert [shard[i] for i in range(3000)] == ids.tolist()
    for a, b in [(0, 3000), (0, 0), (7, 8), (511, 1025), (2999, 3000)]:
        assert np.array_equal(shard.ids(a, b), ids[a:b])
    assert shard.doc_ids == [5, None, 7] and shard.starts.tolist() == [0, 1000, 1000, 3000]
    with pytest.raises(IndexError):
        shard[3000]
    assert dac.Shard(dac.write_shard([], [], np.zeros(0, np.uint32))).ids(0, 0).tolist() == []


def test_dac_query(spark, texts):
    plain, start = tokenizer("byte_bpe_50k.json"), 0
    got = {r["doc_id"]: r for r in queries.op4_dac(spark, DATA).collect()}
    for i in sorted(texts):
        ids = np.array([*plain.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_dac_odd(spark, odd, empty):
    plain = tokenizer("byte_bpe_50k.json")
    path = stage_path(spark, "dac-test")
    manifest = dac.write_tokens(odd, path, public_tokenizers.path("byte_bpe_50k.json"), shard_ids=50)
    got = sorted(dac.read_tokens(spark, path, manifest, keep_ids=True).collect(), key=lambda r: r["start"])
    assert sorted((str(r["id"]), r["ids"]) for r in got) == sorted((str(i), [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in ODD)
    ids = [r["id"] for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got][:-1]]).tolist()
    path = stage_path(spark, "dac-empty")
    assert dac.read_tokens(spark, path, dac.write_tokens(empty, path, public_tokenizers.path("byte_bpe_50k.json"))).collect() == []


def check_pieces(rows, want, limit):
    """Every id in one piece, sequences gapless and within their limit."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(str(r["id"]), []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by_seq.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= limit
    assert sorted(by_doc) == sorted(want)
    for key, n in want.items():
        assert sum(r["length"] for r in by_doc[key]) == n
    return [sum(n for _, n in s) for s in by_seq.values()]


def test_packing_query(spark, docs, texts):
    plain = tokenizer("word_bpe_49k.json")
    rows = queries.op6_packing(spark, DATA).withColumnRenamed("doc_id", "id").collect()
    ids = {i: np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    sizes = check_pieces(rows, {str(i): len(x) for i, x in ids.items()}, 4096)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(ids[r["id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["id"]])
    assert sum(4096 - s for s in sizes if s & (s - 1)) <= 0.01 * sum(sizes)


def test_packing_odd(spark, odd, empty):
    name = public_tokenizers.path("word_bpe_49k.json")
    plain = tokenizer("word_bpe_49k.json")
    unique = odd.where("doc_id is not null and doc_id <> 7")
    want = {str(i): len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in ODD if i not in (None, 7)}
    check_pieces(packing.pack_texts(unique, name).collect(), want, 4096)
    assert packing.pack_texts(odd, name).agg(F.sum("length")).first()[0] == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)
    assert packing.pack_texts(empty, name).collect() == []


def test_packing_limits():
    """All three limits hold, and nothing is lost, whatever the mix of prompts and answers."""
    draw = random.Random(4)
    for _ in range(200):
        n = packing.Limits(draw.randint(4, 64), draw.randint(1, 6), draw.randint(1, 64), draw.randint(1, 5))
        packer, out, lengths = packing.Packer(n), [], {}
        for k in range(draw.randint(0, 60)):
            lengths[k] = draw.choice([0, 1, 2, 3, 10, 50, 200])
            out += packer.add(packing.Example(k, 0, lengths[k], draw.choice([0, 5, 1000])))
        out += packer.finish()
        seen = {}
        for s in out:
            assert sum(p.length for p in s) <= n.tokens and len(s) <= n.segments and sum(p.loss(p.length) for p in s) <= n.loss
            for p in s:
                seen.setdefault(p.key, []).append((p.start, p.length))
        for k, size in lengths.items():
            at = 0
            for start, length in sorted(seen.get(k, [])):
                assert start == at
                at += length
            assert at == size


def test_packing_conversations(spark):
    rows = spark.createDataFrame([("a", 10, 4), ("b", None, 0), ("c", 5, None), (None, 3, 1)], "id string, length long, loss_start long")
    got = packing.pack_examples(rows, packing.Limits(8, 2, 6), loss_start_col="loss_start").collect()
    check_pieces(got, {"a": 10, "c": 5, "None": 3}, 8)


# URLs
def test_urls_query(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = duck.sql(queries.ORACLE_SQL["op5_urls"]).fetchall()
    assert sorted(map(str, (tuple(r) for r in queries.op5_urls(spark, DATA).collect()))) == sorted(map(str, want))


URLS = {
    "http://Example.ORG/es/a": ("example.org", "/es/a", "example.org/es/", "block"),
    "http://a.example.org/en/12?x#y": ("a.example.org", "/en/12", "example.org/en/1", "block"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
    "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
    "http://org": ("org", "", None, "allow"),
    "nothing": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    "http://sub.bad.net/x": ("sub.bad.net", "/x", None, "block"),
    "http://bad.net.evil/x": ("bad.net.evil", "/x", None, "allow"),
    "https://www.page.net/A/?utm_source=1&b=2&a=1#z": ("www.page.net", "/A/", None, "block"),
    "https://page.net/A?a=1": ("page.net", "/A", None, "allow"),
    "http://" + "a." * 5000 + "bad.net/": ("a." * 5000 + "bad.net", "/", None, "block"),
}


def test_urls_odd(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, "http://bad.net", "x")], "page_id long, url string, key string")
    listed = spark.createDataFrame([("bad.net/",), ("page.net/A?a=1&b=2",), (None,), ("bad.net/",)], "key string")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, listed).collect()}
    assert [got[i] for i in range(len(URLS))] == list(URLS.values()) and got[None][3] == "block"
    assert urls.judge(pages.limit(0), listed).collect() == []
    assert {r["verdict"] for r in urls.judge(pages, listed.limit(0)).where("rule is null").collect()} == {"allow"}


def test_urls_without_filter(spark, monkeypatch):
    """Beyond the filter's bound the exact join does all."""
    pages = spark.createDataFrame([(1, "http://bad.net/x"), (2, "http://good.net/x")], "page_id long, url string")
    listed = spark.createDataFrame([("bad.net/",)], "key string")
    monkeypatch.setattr(urls, "FILTER_BYTES", 1)
    assert sorted((r["id"], r["verdict"]) for r in urls.judge(pages, listed).collect()) == [(1, "block"), (2, "allow")]


def test_filter_false_positives(spark):
    listed = spark.range(20_000).select(F.concat(F.lit("h"), "id").alias("key"))
    bits = urls.build_filter(listed, 20_000)
    blocks = len(bits) * 8 // urls.BLOCK_BITS

    def hits(keys):
        block, at = urls.positions(keys, blocks)
        bit = block[:, None] * urls.BLOCK_BITS + at
        return (bits[bit // 8] >> (bit % 8) & 1).all(axis=1)

    assert hits([f"h{i}" for i in range(20_000)]).all()
    assert hits([f"n{i}" for i in range(20_000)]).mean() < 0.01


# quality
def test_quality_held_out(spark):
    base = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op8_quality(spark, base).collect()}
    labels = spark.read.parquet(f"{base}/labels.parquet").collect()
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert all(g["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, g in got.items())
    assert all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.3) for g in got.values())
    assert np.mean([p == q for p, q in held]) > 0.95
    assert np.mean([p for p, q in held if q == 1]) > 0.97


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1), (6, 0), (9, 1), (None, 1), (4, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    assert quality.score(odd, model, keep=["doc_id"]).where("score between 0 and 1").count() == len(ODD)
    for nothing in (labels.limit(0), labels):
        assert quality.score(empty, quality.fit(empty, nothing), keep=["doc_id"]).collect() == []
    assert quality.features(None).tolist() == quality.features(b"  ").tolist() == [0.0] * len(quality.FEATURES)


def test_nonnegative_risk():
    """Negatives hidden among the unlabelled are told apart."""
    draw = np.random.default_rng(0)
    d = len(quality.FEATURES)
    positive, negative = draw.normal(1, 1, (2000, d)), draw.normal(-1, 1, (1000, d))
    model = quality.train(positive[:1000], np.concatenate([positive[1000:], negative]), 0.5)
    assert (model.score(draw.normal(1, 1, (500, d))) > 0.5).mean() > 0.95
    assert (model.score(draw.normal(-1, 1, (500, d))) < 0.5).mean() > 0.95


# neighbours
def plain_nearest(rows, k=20, modulus=20):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in good:
        if i % modulus:
            continue
        found = []
        for j, c in good:
            if j != i and len(c) == len(q):
                s = 0.0
                for a, b in zip(q, c, strict=True):
                    s += a * b
                found.append((-s, j, s))
        out += [(i, r + 1, j, s) for r, (_, j, s) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_nearest_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op9_ann(spark, DATA).collect()) == plain_nearest(rows)


def test_nearest_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (20, [-3.0, 1e-3]), (None, [1.0, 1.0]), (40, [2.0]), (60, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for sizes in ({}, {"queries_per_block": 1, "candidates_per_run": 2}):
        assert sorted(tuple(r) for r in ann.nearest(df, **sizes).collect()) == plain_nearest(exact)
    assert sorted(tuple(r) for r in ann.nearest(df, k=2).collect()) == plain_nearest(exact, 2)
    assert ann.nearest(df.limit(0)).collect() == []


# recordings
def tune(notes, seconds=0.125):
    t = np.arange(int(chroma.RATE * seconds)) / chroma.RATE
    return np.rint(np.concatenate([12000 * np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in notes])).astype("<i2")


def test_chroma_alignment():
    draw = np.random.default_rng(3)
    notes = draw.integers(0, 24, 120)
    a = chroma.fingerprint(tune(notes).tobytes())
    noisy = tune(notes[20:90]) + draw.normal(0, 300, 70 * 500).astype("<i2")
    found = chroma.align(a, chroma.fingerprint(noisy.tobytes()))
    assert found is not None and found[0] == -20 and found[1] <= 0.1 * found[2]
    assert chroma.align(a, chroma.fingerprint(tune(draw.integers(0, 24, 120)).tobytes())) is None
    assert chroma.fingerprint(None).size == chroma.fingerprint(b"").size == chroma.fingerprint(b"\0" * 99).size == 0
    assert chroma.fingerprint(b"\0" * 20_000).size


def test_chroma_integral_image():
    image = np.random.default_rng(1).random((20, 12))
    packed = chroma.pack(image)
    for at in range(len(packed)):
        want = 0
        for k, (kind, y, h, w, x) in enumerate(chroma._FILTERS):
            area = image[at + x : at + x + w, y : y + h]
            total, n = area.sum(), area.shape[1]
            first = {0: lambda: area[:, : h // 2].sum(), 1: lambda: area[: w // 2].sum(), 2: lambda: area[: w // 2, : h // 2].sum() + area[w // 2 :, h // 2 :].sum(), 3: lambda: area[:, h // 3 : 2 * h // 3].sum()}[kind]()
            assert n == h
            value = round(np.log1p(first) - np.log1p(total - first), 9)
            want |= [0, 1, 3, 2][sum(value >= s for s in (-0.25, 0.0, 0.25))] << 2 * k
        assert want == packed[at]


def test_chroma_match(spark):
    draw = np.random.default_rng(5)
    tunes = [draw.integers(0, 24, 60) for _ in range(6)]
    rows = [(i, bytearray(tune(tunes[i % 6]).tobytes())) for i in range(12)]
    rows += [(20, bytearray(tune(tunes[1][5:]).tobytes())), (21, None), (22, bytearray()), (None, bytearray(tune(tunes[2]).tobytes()))]
    df = spark.createDataFrame([(i, p, 0) for i, p in rows], "rec long, pcm binary, class_id int")
    prints = {i: chroma.fingerprint(bytes(p) if p else None) for i, p in rows if i is not None}
    for sizes in ({}, {"queries": 1, "candidates": 2}):
        got = chroma.match(df, "rec", F.col("pcm"), **sizes).collect()
        members = [(r["id"], r["class_id"]) for r in got if r["kind"] == "member"]
        assert sorted(members, key=str) == sorted([*((i, i % 6) for i in range(12)), (20, 20), (21, 21), (22, 21), (None, 2)], key=str)
        want = set()
        for q in (0, 20):
            for c in (0, 1, 2, 3, 4, 5, 20):
                if c != q and (m := chroma.align(prints[q], prints[c])):
                    want.add((q, c, *m))
        assert {(r["id"], r["class_id"], r["offset"], r["bit_errors"], r["bits"]) for r in got if r["kind"] == "match"} == want
        assert (20, 1) in {w[:2] for w in want}
    assert chroma.match(df.limit(0), "rec", F.col("pcm")).collect() == []


def test_chroma_query(spark):
    got = queries.op7_chroma(spark, DATA).collect()
    rows = {r["vec_id"]: chroma.fingerprint(chroma.render_vector(r["embedding"])) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").limit(10**9).collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i].tobytes(), i)
    assert {(r["vec_id"], r["class_id"]) for r in got if r["kind"] == "member"} == {(i, first[p.tobytes()]) for i, p in rows.items()}
    asked = {first[p.tobytes()] for i, p in rows.items() if i % 20 == 0}
    want = {(q, c, *m) for q in asked for c in first.values() if c != q and (m := chroma.align(rows[q], rows[c]))}
    assert {(r["vec_id"], r["class_id"], r["offset"], r["bit_errors"], r["bits"]) for r in got if r["kind"] == "match"} == want


# licences
def plain_dice(a, b):
    from collections import Counter

    x, y = (Counter(licenses.bigrams(t)) for t in (a, b))
    n = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / n if n else 0.0


def plain_scan(text):
    found = [(plain_dice(u, t), i) for u in licenses.units(text) for i, (_, t) in enumerate(licenses.TEMPLATES)] if text else []
    found = [(c, i) for c, i in found if c >= licenses.DICE]
    top = min(found, key=lambda x: (-x[0], x[1]), default=None)
    return (licenses.TEMPLATES[top[1]][0] if top else None, top[0] if top else None, ",".join(sorted({licenses.TEMPLATES[i][0] for _, i in found})))


def test_licenses_query(spark, texts):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op10_licenses(spark, DATA).collect()}
    assert got == {i: plain_scan(t) for i, t in texts.items()}
    assert sum(x[0] is not None for x in got.values()) > 0


def test_licenses_texts(spark, odd, empty):
    rows = []
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        wrapped = "\n".join(" ".join(words[i : i + 12]) for i in range(0, len(words), 12))
        rows.append((k, f"Some words before.\n\n{wrapped.lower()}\n\nAnd some after."))
    got = {r["id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (name, _) in enumerate(licenses.TEMPLATES):
        assert name in got[k]["licenses"].split(",") and got[k]["dice"] == 1.0
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(empty).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(odd, least=0)
