"""Personal data by bootstrapped contextual extraction.

Fixed expressions find the seed entities (e-mail, IP, card and phone numbers). The words around the
seeds induce lexical patterns. Patterns and the strings they surround form a bipartite graph, and
Spark scores both sides in turn: a pattern by the share of its distinct instances that are known, an
instance by the patterns that surround it. Patterns with high confidence pull in identifiers that the
expressions miss (obfuscated addresses, numbers with a wrong check digit or without a country code,
dotted numbers out of range); those count as known in the next round.

Base spans are never dropped or changed; the method only adds spans that don't overlap them.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import batches_of, stage
from .workers import tidy

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; distinct known instances a pattern needs, its least confidence, an instance's least score.
ROUNDS, SUPPORT, CONFIDENCE, SCORE = 3, 5, 0.8, 0.8

# Forms equivalent to the plain expressions that never scan a run of characters twice.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]++")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and _LOCAL.match(text[begin - 1]):
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            done, at = at + 1, text.find("@", at + 1)


def _quads(text: str) -> Iterator[tuple[int, int, bool]]:
    """Spans of four dotted numbers from the left, and whether all are at most 255."""
    for m in _DOTTED.finditer(text):
        run = m.group()
        if run.count(".") < 3:
            continue
        parts, at = run.split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            yield at, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four)
            at = end + 1


def _phones(text: str) -> Iterator[tuple[int, int, bool]]:
    done, at = 0, text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        run = m.group() if m else ""
        stop = next((i for i in range(len(run) - 1, 2, -1) if run[i].isdigit()), 0) + 1 if run else 1
        if stop > 3:
            yield at, at + stop, 9 <= len(_DIGIT.findall(run[:stop])) <= 15
            done = at + stop
        else:
            done = at + 1
        at = text.find("+", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed expressions, by kind as listed, then start; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", a, b) for a, b, good in _quads(text) if good]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", a, b) for a, b, good in _phones(text) if good]
    return out


# Strings that may be identifiers of a kind though no base expression takes them.
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,24}(?![0-9A-Za-z])")
_SPELT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z0-9-]{1,63}){1,5}",
    re.I,
)


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Possible identifiers outside the base spans; a number may be a candidate of two kinds."""
    found = []
    if _DIGIT.search(text):
        found += [("ip", a, b) for a, b, good in _quads(text) if not good]
        for m in _NUMBER.finditer(text):
            a, b = m.span()
            n = len(_DIGIT.findall(m.group()))
            if 7 <= n <= 15:
                found.append(("phone", a, b))
            if 13 <= n <= 19:
                found.append(("card", a, b))
    lower = text.lower()
    if "at)" in lower or "at]" in lower or " at " in lower and " dot " in lower:
        found += [("email", *m.span()) for m in _SPELT.finditer(text)]
    if not found:
        return []
    taken = sorted((a, b) for _, a, b in base)
    from bisect import bisect_left

    def free(a: int, b: int) -> bool:
        i = bisect_left(taken, (b, 0))
        return i == 0 or taken[i - 1][1] <= a

    return [x for x in found if free(x[1], x[2])]


_WORD = re.compile(r"\w+|[^\w\s]")


def _norm(words: list[str]) -> str:
    return " ".join("#" if any(c.isdigit() for c in w) else w.lower()[:32] for w in words)


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before it, one on each side, two after it. Marks count as words."""
    before = _WORD.findall(text[max(0, start - 80) : start])[-2:]
    after = _WORD.findall(text[end : end + 80])[:2]
    out = []
    if len(before) == 2:
        out.append(f"{_norm(before)} _")
    if before and after:
        out.append(f"{_norm(before[-1:])} _ {_norm(after[:1])}")
    if len(after) == 2:
        out.append(f"_ {_norm(after)}")
    return [c for c in out if any(x.isalpha() for x in c)]


def value_of(kind: str, text: str) -> str:
    """One form of an identifier however it is written."""
    if kind == "email":
        s = re.sub(r" ?(?:\[at\]|\(at\)| at ) ?", "@", text.lower())
        return re.sub(r" ?(?:\[dot\]|\(dot\)| dot ) ?", ".", s)
    return text if kind == "ip" else "".join(_DIGIT.findall(text))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("known", pa.bool_()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
_SPAN_SQL = "array<struct<kind:string,start:int,end:int,known:boolean,value:string,patterns:array<string>>>"


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda x: (order[x[0]], x[1], x[2])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_email, n_ip, n_card, n_phone, base_spans, found): one row per document.

    found holds base spans (known) and candidates with their values and patterns.
    """
    batches_of(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[], [], [], []]
            joined, found = [], []
            for t in b.column(1).to_pylist():
                text = t or ""
                base = base_spans(text)
                for c, kind in zip(counts, KINDS, strict=True):
                    c.append(sum(k == kind for k, _, _ in base))
                joined.append(join_spans(base))
                both = [(x, True) for x in base] + [(x, False) for x in candidates(text, base)]
                found.append(
                    [(k, s, e, known, value_of(k, text[s:e]), contexts(text, s, e)) for (k, s, e), known in both]
                )
            rows = [[dict(zip(("kind", "start", "end", "known", "value", "patterns"), x, strict=True)) for x in f] for f in found]
            yield pa.record_batch(
                [b.column(0), b.column(2), *(pa.array(c, pa.int64()) for c in counts), pa.array(joined, pa.string()), pa.array(rows, pa.list_(_SPAN))],
                names=["id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "found"],
            )

    return docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.col(text_col)).alias("text_hash")
    ).mapInArrow(run, f"id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, found {_SPAN_SQL}")


def bootstrap(scanned: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE, least: float = SCORE) -> DataFrame:
    """Identifiers that confident patterns discover: (kind, value, score, patterns).

    The graph's edges are the distinct (kind, pattern, value) triples of the whole corpus, so copies
    of a passage count once. Each round, a pattern's confidence is the summed score of its instances
    over their number, if at least ``support`` distinct ones are known; an instance's score is that at
    least one of its confident patterns is right.
    """
    edges = stage(
        scanned.select(F.explode("found").alias("x"))
        .select("x.kind", "x.value", "x.known", F.explode("x.patterns").alias("pattern"))
        .groupBy("kind", "pattern", "value")
        .agg(F.max("known").alias("seed")),
        "pattern-graph",
    )
    # a value that is known anywhere is known everywhere
    nodes = edges.groupBy("kind", "value").agg(F.max("seed").cast("double").alias("score"), F.lit(0).cast("long").alias("patterns"))
    for _ in range(rounds):
        scored = edges.join(nodes.select("kind", "value", "score"), ["kind", "value"])
        patterns = (
            scored.groupBy("kind", "pattern")
            .agg(
                (F.sum("score") / F.count(F.lit(1))).alias("confidence"),
                F.sum((F.col("score") >= least).cast("long")).alias("known"),
            )
            .where((F.col("known") >= support) & (F.col("confidence") >= confidence))
        )
        pulled = (
            edges.join(patterns.select("kind", "pattern", "confidence"), ["kind", "pattern"])
            .groupBy("kind", "value")
            .agg(
                F.round(1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence"))))), 9).alias("by_pattern"),
                F.count(F.lit(1)).alias("by"),
            )
        )
        nodes = stage(
            edges.groupBy("kind", "value")
            .agg(F.max("seed").alias("seed"))
            .join(pulled, ["kind", "value"], "left")
            .select(
                "kind",
                "value",
                F.when(F.col("seed"), 1.0).otherwise(F.coalesce("by_pattern", F.lit(0.0))).alias("score"),
                F.coalesce("by", F.lit(0)).cast("long").alias("patterns"),
                "seed",
            ),
            "pattern-scores",
        )
    return nodes.where(~F.col("seed") & (F.col("score") >= least)).select("kind", "value", "score", "patterns")


def added_spans(scanned: DataFrame, accepted: DataFrame) -> DataFrame:
    """(id, text_hash, added array<struct<kind,start,end>>): spans of discovered identifiers, one row per text that has some.

    A number accepted as two kinds counts as the first of them as listed.
    """
    hits = (
        scanned.select("id", "text_hash", F.explode("found").alias("x"))
        .where("not x.known")
        .select("id", "text_hash", "x.kind", "x.start", "x.end", "x.value")
        .join(accepted.select("kind", "value"), ["kind", "value"])
    )
    first = F.min(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))).alias("k")
    one = hits.groupBy("id", "text_hash", "start", "end").agg(first)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("k").cast("int"))
    # spans of one text, so a group is bounded by the text
    return one.groupBy("id", "text_hash").agg(
        F.array_sort(F.collect_list(F.struct(kind.alias("kind"), F.col("start"), F.col("end")))).alias("added")
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_added, base_spans, spans) for each row.

    The counts are of base spans; ``spans`` holds base and added ones. A null text counts as empty. Rows
    with null ids and repeated rows each give a row. Overlapping candidates of a text may both be added.
    Other columns are not read. Empty tables give no rows.
    """
    scanned = stage(scan(docs, id_col, text_col), "pii-scan", compact=True)
    added = stage(added_spans(scanned, bootstrap(scanned)), "pii-added")
    own = scanned.drop("found")
    more = added.select(F.col("id").alias("_id"), F.col("text_hash").alias("_h"), "added")
    joined = own.join(more, own["id"].eqNullSafe(F.col("_id")) & (own["text_hash"] == F.col("_h")), "left")
    base = F.transform(
        F.filter(F.split("base_spans", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.substring_index(s, ":", 1).alias("kind"),
            F.element_at(F.split(s, ":"), 2).cast("int").alias("start"),
            F.element_at(F.split(s, ":"), 3).cast("int").alias("end"),
        ),
    )
    order = F.array(*map(F.lit, KINDS))
    every = F.array_sort(
        F.transform(
            F.concat(base, F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))),
            lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return joined.select(
        "id", "n_email", "n_ip", "n_card", "n_phone",
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"), "base_spans", text.alias("spans"),
    )


def sha256(spans: F.Column) -> F.Column:
    return F.sha2(spans.cast("binary"), 256)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Put ``<kind>`` in place of each span; of overlapping ones the longest run is taken out once."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The columns of ``docs`` with all spans taken out of the text, and its new length in ``length_col``.

    Texts without spans, nulls among them, stay as they are. Rows are neither added nor dropped. Base
    spans are found where the text is; only the few added spans are joined to it.
    """
    scanned = stage(scan(docs, id_col, text_col), "pii-scan", compact=True)
    added = stage(added_spans(scanned, bootstrap(scanned)), "pii-added")
    more = added.select(F.col("id").alias("_pii_id"), F.col("text_hash").alias("_pii_hash"), F.col("added").alias("_pii_added"))
    own = docs.withColumn("_pii_own", F.xxhash64(F.col(text_col)))
    joined = own.join(
        more, own[id_col].cast("long").eqNullSafe(F.col("_pii_id")) & (F.col("_pii_own") == F.col("_pii_hash")), "left"
    )

    import pandas as pd

    @F.pandas_udf("string")
    def clean(texts: pd.Series, extra: pd.Series) -> pd.Series:
        out = []
        for t, x in zip(texts, extra, strict=True):
            spans = base_spans(t) if t else []
            if x is not None:
                spans = spans + [(s["kind"], s["start"], s["end"]) for s in x]
            out.append(redact_text(t, spans) if spans else t)
        return pd.Series(out, dtype=object)

    done = joined.withColumn(text_col, clean(F.col(text_col), F.col("_pii_added")))
    if length_col is not None and length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        done = done.withColumn(length_col, F.char_length(F.col(text_col)).cast(kind))
    return done.select(*docs.columns)
