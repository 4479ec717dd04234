"""Licences within lines and long documents."""

import random
from collections import Counter

from taqlspark.llm import licenses


def best_dice(text, template):
    """Over all runs of words."""
    x, y = licenses.bigrams(text), Counter(licenses.bigrams(template))
    n = sum(y.values())
    return max((2 * sum((Counter(x[a:b]) & y).values()) / (b - a + n) for a in range(len(x)) for b in range(a + 1, min(len(x), a + 2 * n) + 1)), default=0)


def test_licences_within_texts(spark):
    """Templates in several paragraphs within long documents, and in the middle of lines."""
    before, after = (" ".join(f"{w}{i}" for i in range(400)) for w in ("lorem", "ipsum"))
    rows = []
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        words = text.split()
        parts = "\n\n".join(" ".join(words[i : i + 40]) for i in range(0, len(words), 40))
        rows += [(2 * k, f"{before}\n\n{parts}\n\n{after}"), (2 * k + 1, f"{before} footer. {text} All else {after}")]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert licenses.TEMPLATES[r["id"] // 2][0] in r["licenses"].split(",") and r["dice"] == 1.0


def test_licences_best_run():
    draw = random.Random(4)
    templates = tuple((f"L{k}", " ".join(draw.choice("abcdefgh") for _ in range(n))) for k, n in enumerate([2, 3, 5, 9, 16]))
    index = licenses.Index.of(templates)
    for _ in range(60):
        text = " ".join(draw.choice("abcdefgh" if draw.random() < 0.8 else "xyz") for _ in range(draw.randint(1, 20)))
        words = templates[draw.randrange(5)][1].split()
        if draw.random() < 0.7:
            words[draw.randrange(len(words))] = "q"
        text += " " + " ".join(words) + " x c b"
        want = {i: c for i, (_, t) in enumerate(templates) if (c := best_dice(text, t)) >= 0.8}
        assert {i: c for c, i in index.matches(text, 0.8)} == want
