"""URL filter: host and path rules, and a blocked Bloom filter before an exact hash join.

The list holds canonical URLs. ``host/`` lists a host with its subdomains, anything else one page.
Each page is looked up under its own canonical URL and under each of its parent hosts. A blocked
Bloom filter (one 512-bit block a key, so one cache line is read) lets possible hits pass to an exact
join with the list, which removes false positives; pages without a possible hit never move.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import batches_of

#: (text, verdict): host and the beginning of the path.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Listed hosts of the query: families of junk hosts under each ending.
FAMILIES = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track", "adult-x")
LISTED = tuple(f"{f}.example.{e}/" for f in FAMILIES for e in ("com", "net", "org"))
#: Query parameters that don't name a page.
TRACKING = ("ref", "fbclid", "gclid")

BLOCK_BITS, BITS_PER_KEY, PROBES = 512, 16, 8
#: Bytes up to which the filter is built and sent to all tasks; a longer list goes to the exact join alone.
FILTER_BYTES = 64 << 20


def lower_ascii(c: F.Column) -> F.Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host and path as literally found: after the first ``://``, up to ``/``, ``?``, ``#`` or the end."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = rest.substr(F.char_length(raw) + 1, F.char_length(rest))
    return pages.withColumns({"host": lower_ascii(raw), "path": F.regexp_extract(tail, r"^[^?#]*", 0)})


def rule_for(host: F.Column, path: F.Column, rules: tuple[tuple[str, str], ...]) -> tuple[F.Column, F.Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of, slash, begin = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + begin)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, says).otherwise(verdict)
    return text, verdict


def canonical(url: F.Column, host: F.Column, path: F.Column) -> F.Column:
    """host without port, user, trailing dot and ``www.``; path without closing slash; sorted parameters that name the page."""
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"^www\.|\.$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    names = F.filter(
        F.split(query, "&"),
        lambda p: (p != "") & ~p.startswith("utm_") & ~F.substring_index(p, "=", 1).isin(*TRACKING),
    )
    kept = F.array_join(F.array_sort(names), "&")
    page = F.when(F.regexp_replace(path, r"/+$", "") == "", "/").otherwise(F.regexp_replace(path, r"/+$", ""))
    return F.concat(own, page, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def lookups(host: F.Column, full: F.Column) -> F.Column:
    """Keys under which a page can be listed: its canonical URL, and its host's endings of two labels or more.

    A host name has at most 127 labels, so longer endings can't be listed.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    labels = F.split(bare, r"\.")
    last = F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 126), 127)
    ends = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(last) - 1, F.lit(1))),
        lambda i: F.concat(F.array_join(F.slice(last, i, F.lit(127)), "."), F.lit("/")),
    )
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(full), ends)))


def positions(keys: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key, and its PROBES bits within the block (four of the second half of its hash, four of a mix of that)."""
    import xxhash

    raw = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), dtype="<u8").reshape(-1, 2)
    block = raw[:, 0] % np.uint64(blocks)
    mixed = (raw[:, 1] ^ (raw[:, 1] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    words = [raw[:, 1] >> np.uint64(9 * i) & np.uint64(511) for i in range(4)]
    words += [mixed >> np.uint64(9 * i + 19) & np.uint64(511) for i in range(4)]
    return block.astype(np.int64), np.stack(words, axis=1).astype(np.int64) if len(raw) else np.zeros((0, PROBES), np.int64)


def build_filter(listed: DataFrame, n: int) -> np.ndarray | None:
    """Filter bits as bytes, from a list of n keys (column key); None if it would exceed FILTER_BYTES.

    Tasks set bits of their keys; equal words are joined before the shuffle and the driver gets each
    word of the filter once, so what it holds is bounded by FILTER_BYTES.
    """
    blocks = max(1, -(-n * BITS_PER_KEY // BLOCK_BITS))
    if blocks * BLOCK_BITS // 8 > FILTER_BYTES:
        return None

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            block, at = positions(b["key"].tolist(), blocks)
            flat = (block[:, None] * BLOCK_BITS + at).ravel()
            yield pd.DataFrame({"w": flat // 32, "bit": np.left_shift(np.int64(1), flat % 32)})

    words = listed.select("key").mapInPandas(bits, "w long, bit long").groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(blocks * BLOCK_BITS // 32, dtype="<u4")
    for row in words.toLocalIterator():
        out[row["w"]] = row["bits"]
    return out.view(np.uint8)


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict, listed_as) for each page.

    verdict is that of the longest fitting rule; without one, ``block`` if the page is listed, else
    ``allow``. A null url, or one without ``://``, has an empty host and path, fits no rule and is
    allowed. listed: keys in a column ``key`` (nulls and repeats change nothing; empty lists none).
    Repeated rows and null ids stay rows of their own. Other columns are not read.
    """
    spark = pages.sparkSession
    batches_of(spark, 4096)
    keys = listed.where(F.col("key").isNotNull()).select("key").distinct()
    bits = build_filter(keys, keys.count())
    sent = None if bits is None else spark.sparkContext.broadcast(bits.tobytes())

    own = with_parts(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url")))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "says": says})
    own = own.withColumn("keys", lookups(F.col("host"), canonical(F.coalesce("url", F.lit("")), F.col("host"), F.col("path"))))

    if sent is not None:

        @F.pandas_udf("array<string>")
        def possible(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            table = np.frombuffer(sent.value, np.uint8)
            blocks = len(table) * 8 // BLOCK_BITS
            for c in columns:
                lists = [list(x) for x in c]
                flat = [k for x in lists for k in x]
                block, at = positions(flat, blocks)
                bit = block[:, None] * BLOCK_BITS + at
                hit = (table[bit // 8] >> (bit % 8) & 1).all(axis=1) if len(flat) else np.zeros(0, bool)
                out, i = [], 0
                for x in lists:
                    out.append([k for k, h in zip(x, hit[i : i + len(x)].tolist(), strict=True) if h])
                    i += len(x)
                yield pd.Series(out)

        own = own.withColumn("keys", possible("keys"))

    found = (
        own.where(F.size("keys") > 0)
        .select("url", F.explode("keys").alias("key"))
        .distinct()
        .join(keys.hint("shuffle_hash"), "key")
        .groupBy(F.col("url").alias("hit_url"))
        .agg(F.min("key").alias("listed_as"))
    )
    passed = own.where(F.size("keys") > 0).join(found, F.col("url") == F.col("hit_url"), "left").drop("hit_url")
    missed = own.where(F.size("keys") == 0).withColumn("listed_as", F.lit(None).cast("string"))
    verdict = F.coalesce("says", F.when(F.col("listed_as").isNotNull(), "block").otherwise("allow"))
    return passed.unionByName(missed).select("id", "host", "path", "rule", verdict.alias("verdict"), "listed_as")
