"""Quality classifier by positive-unlabelled learning.

The model learns from trusted positives (documents labelled good) and from unlabelled documents. With
the class prior p, the risk on negatives is what the unlabelled sample shows minus p times what the
positives show; it can't be negative in truth, so the non-negative risk

    p * L+(positives) + max(0, L-(unlabelled) - p * L-(positives))

is minimised, and where the second part falls below zero its gradient is turned round. The prior is
estimated as the share of good documents among labelled ones. Features are shape statistics of the
text alone; label, language, source and id are no inputs.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import batches_of
from .workers import tidy

#: Bounds of the two training samples. Which rows are in them depends on a hash of the id alone.
POSITIVES, UNLABELLED = 12_000, 24_000
#: Words per window in which repeats are counted, and the score from which a document is predicted good.
WINDOW, THRESHOLD = 64, 0.3
HIDDEN, ROUNDS, RATE = 16, 900, 0.02

FEATURES = (
    "upper", "symbol", "bar", "exclaim", "digit", "stop", "comma", "other_mark", "non_ascii", "word_length",
    "fresh", "again", "capital_words", "log_words", "breaks",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*@~^+=<>{}[]\\"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ":;?\"'()/_-`"]] = True


def features(text: bytes | None) -> np.ndarray:
    """Shape statistics of a UTF-8 text; all zero for a null text or one without words."""
    out = np.zeros(len(FEATURES))
    words = text.split() if text else []
    if not words:
        return out
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size, count = len(text), len(words)
    upper, letters = n[_UPPER].sum(), n[_UPPER].sum() + n[_LOWER].sum()
    fresh = sum(len(set(words[i : i + WINDOW])) for i in range(0, count, WINDOW))
    again = sum(map(bytes.__eq__, words, words[1:]))
    heads = b"".join([w[:1] for w in words])
    out[:] = (
        upper / max(letters, 1),
        n[_SYMBOL].sum() / size,
        n[ord("|")] / count,
        n[ord("!")] / count,
        n[_DIGIT].sum() / size,
        n[ord(".")] / count,
        n[ord(",")] / count,
        n[_MARK].sum() / size,
        n[128:].sum() / size,
        min(size / count, 40) / 10,
        fresh / count,
        again / count,
        _UPPER[np.frombuffer(heads, np.uint8)].mean(),
        np.log1p(count) / 10,
        n[10] / count,
    )
    return out


@dataclass
class Model:
    """A small network on standardised features; a few hundred numbers."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative risk with the logistic loss; the same samples give the same model.

    Without positives or unlabelled rows the model scores every text with the prior.
    """
    d = len(FEATURES)
    everything = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, d))
    mean, scale = everything.mean(axis=0), everything.std(axis=0)
    scale[scale < 1e-9] = 1.0
    draw = np.random.default_rng(8)
    m = Model(mean, scale, draw.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(prior / (1 - prior))), prior)
    if not len(positive) or not len(unlabelled):
        return m
    m.w2 = draw.normal(0, HIDDEN**-0.5, HIDDEN)
    xp, xu = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    both = np.concatenate([xp, xu])
    p, u = len(xp), len(xu)
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (m.w1, m.b1, m.w2, np.zeros(1))]
    for step in range(1, ROUNDS + 1):
        h = np.tanh(both @ m.w1 + m.b1)
        g = h @ m.w2 + m.b2
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        minus = np.logaddexp(0, g)  # loss if the row were negative
        negative = minus[p:].mean() - prior * minus[:p].mean()
        dg = np.empty(p + u)
        if negative >= 0:
            dg[:p] = prior * ((s[:p] - 1) - s[:p]) / p
            dg[p:] = s[p:] / u
        else:
            dg[:p] = prior * s[:p] / p
            dg[p:] = -s[p:] / u
        dh = dg[:, None] * m.w2 * (1 - h * h)
        grads = [both.T @ dh + 1e-4 * m.w1, dh.sum(axis=0), h.T @ dg + 1e-4 * m.w2, np.array([dg.sum()])]
        steps = []
        for (a, b), gr in zip(state, grads, strict=True):
            a += 0.1 * (gr - a)
            b += 0.001 * (gr * gr - b)
            steps.append(RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8))
        m.w1, m.b1, m.w2, m.b2 = m.w1 - steps[0], m.b1 - steps[1], m.w2 - steps[2], m.b2 - float(steps[3][0])
    return m


def held_out(id_col: str = "doc_id") -> F.Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, text_col: str) -> np.ndarray:
    """Features of a bounded frame's texts, on the driver."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t) for t in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(1), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["h", "x"])

    found = docs.select(F.col(text_col).cast("binary").alias("t"), F.col("_h").alias("h")).mapInArrow(run, "h long, x array<double>").toArrow()
    order = np.argsort(found["h"].to_numpy(), kind="stable")
    rows = found["x"].to_pylist()
    x = np.array([rows[i] for i in order], dtype=float)
    return x.reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from the rows that are not held out.

    Positives: at most ``positives`` documents labelled 1. Unlabelled: about ``unlabelled`` documents,
    whatever their label, which isn't looked at. Label rows with a null id or quality are ignored; of
    contradicting labels of an id the lower counts.
    """
    batches_of(docs.sparkSession)
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & ~held_out(id_col))
        .groupBy(id_col)
        .agg(F.min("quality").alias("quality"))
    )
    n, good = known.agg(F.count(F.lit(1)), F.sum((F.col("quality") == 1).cast("long"))).first()
    prior = ((good or 0) + 1.0) / (n + 2.0)
    order = F.xxhash64(F.col(id_col).cast("long"), F.lit(8))
    chosen = known.where("quality = 1").orderBy(order, id_col).limit(positives).select(F.col(id_col).cast("long").alias("_id"))
    own = docs.withColumn("_h", order)
    # at most `positives` ids: a broadcast of a stated size
    xp = _sample(own.join(F.broadcast(chosen), own[id_col].cast("long") == F.col("_id"), "left_semi"), text_col)
    open_rows = own.where(~held_out(id_col))
    total = open_rows.select(id_col).count()
    share = min(1.0, unlabelled / max(total, 1))
    xu = _sample(open_rows.where(F.pmod("_h", F.lit(1_000_003)) < int(share * 1_000_003)), text_col)
    return train(xp, xu, prior)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Columns ``keep`` (default: all) of each row with its score under ``name``; needs no shuffle.

    Null and empty texts get a score too: that of all-zero features.
    """
    batches_of(docs.sparkSession)

    @F.pandas_udf("double")
    @tidy
    def of(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in columns:
            x = np.array([features(t) for t in c]).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x))

    return docs.select(*(keep if keep is not None else docs.columns), of(F.col(text_col).cast("binary")).alias(name))
