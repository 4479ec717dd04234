"""Similar texts against all pairs of whole sets."""

import random

import pytest
from conftest import DATA

import corpus_pipeline
from taqlspark.llm import similar, simhash


def plain_groups(texts, words=5, least=(4, 5)):
    """The root of each text, by comparing all pairs of whole sets."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x == y or len(x & y) * least[1] >= len(x | y) * least[0]:
                up[root(a)] = root(b)
    return [root(i) for i in range(len(sets))]


def varied():
    """Texts with 0 to 40 of 60 to 300 words replaced, some from frequent words only, and sets at exactly 0.8."""
    draw = random.Random(3)
    out = []
    for k in range(25):
        base = [f"w{draw.randrange(30 if k % 5 == 0 else 5000)}" for _ in range(draw.randint(60, 300))]
        for _ in range(5):
            own = list(base)
            for _ in range(draw.choice([0, 1, 2, 5, 12, 40])):
                own[draw.randrange(len(own))] = f"x{draw.randrange(9999)}"
            out.append(" ".join(own[draw.choice([0, 0, 3, 9]) :]))
    line = [f"v{i}" for i in range(44)]  # 40 shingles; 32 are 0.8 of them, 31 are less
    return [*out, " ".join(line), " ".join(line[:36]), " ".join([*line[20:44], "z"] * 2), "a b", "A  b", "", None, " "]


@pytest.mark.parametrize("listed", [0, 200_000])
def test_similar_groups(spark, monkeypatch, listed):
    monkeypatch.setattr(similar, "LISTED", listed)
    texts = varied()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["group"] for r in similar.groups(docs).collect()}
    want = plain_groups(texts)
    assert len(set(want)) < len(texts) - 20
    pairs = {(got[i], want[i]) for i in range(len(texts))}
    assert len(pairs) == len(set(want)) == len(set(got.values()))


def test_pipeline_near_duplicates(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = {}
    for (i, _), g in zip(rows, plain_groups([t for _, t in rows]), strict=True):
        want.setdefault(g, i)
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect()]
    assert sorted(got) == sorted(want.values())


def test_deduplicate_repeated_and_null_ids(spark):
    """Groups are told apart by what they hold, not by ids."""
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (2, one + " z"), (1, two), (3, two), (None, "c " * 30 + one[:99]), (None, "c " * 30 + one[:99] + " y")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in kept) == [(0, "c"), (1, "a"), (1, "b")]
