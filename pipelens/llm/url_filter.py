"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

The filter is tested on the rows where they stand; only URLs with a possible hit are shuffled to the join.

The list holds canonical entries ``(host, path, verdict)``. An entry covers its host and all subdomains, where the
URL's path starts with the entry's path. Of the entries that cover a URL the longest wins (ties: the greater text; an
entry listed twice with both verdicts blocks). A URL that no entry covers gets the verdict of the method itself, the
default: nothing listed blocks it.

Every step is a DataFrame operation. Candidate keys of a URL are made only for the shapes (labels of the host, length
of the path) that occur in the list, so a URL of any length gives a bounded number of keys.

Null urls and urls without ``://`` have empty host and path and get the default. Repeated rows are judged alike, extra
columns pass through (columns named host, path, rule or verdict are replaced), an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 16
BLOCK_BITS = 256
WORDS = 4
#: A filter of up to this many blocks, of 32 bytes each, is sent to every task: 4 million entries, 16 MB. The filter of a
#: longer list stays dealt over the cluster, and keys are shuffled to its blocks; results are the same.
SENT_BLOCKS = 1 << 18


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """Two bits in each of the four 64-bit words of the key's block."""
    bits = F.xxhash64(key, F.lit(1))

    def bit(k: int) -> Column:
        place = F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    return [bit(2 * j).bitwiseOR(bit(2 * j + 1)) for j in range(WORDS)]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """Blocked Bloom filter of the column ``key``: a row (block, w0..w3) for each block that is in use."""
    masks = _masks(F.col("key"))
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*[F.bit_or(m).alias(f"w{j}") for j, m in enumerate(masks)])


def _sent(blocks_in_use: DataFrame, blocks: int) -> DataFrame:
    """The filter as one row: for each word of the blocks an array in order of the blocks."""
    whole = blocks_in_use.sparkSession.range(blocks).withColumnRenamed("id", "block").join(blocks_in_use, "block", "left")
    names = [f"w{j}" for j in range(WORDS)]
    rows = whole.select(F.struct("block", *[F.coalesce(w, F.lit(0)).alias(w) for w in names]).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("__filter"))
    return rows.select(*[F.col("__filter")[w].alias(f"__{w}") for w in names])


def _possible(key: Column, blocks: int) -> Column:
    """The filter, in the columns __w0.., may hold the key."""
    place = (_block(key, blocks) + 1).cast("int")
    words = [F.element_at(f"__w{j}", place).bitwiseAND(m) == m for j, m in enumerate(_masks(key))]
    return key.isNotNull() & words[0] & words[1] & words[2] & words[3]


def filter_urls(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null where nothing listed covers the URL) and verdict."""
    pages = pages.drop(*[c for c in pages.columns if c in ("host", "path", "rule", "verdict")])
    host, path = split_url(F.col(f"`{url}`"))
    pages = pages.withColumns({"host": host, "path": path})
    listed = (
        listed.where("host is not null and verdict is not null")
        .select(
            F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
        )
        .withColumn("key", F.concat("host", "path"))
        .groupBy("key")
        .agg(F.max("verdict").alias("verdict"), F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("path")).alias("chars"))
    )
    n = listed.count()
    # At most 128 labels by as many lengths as paths have: a list of shapes, not of entries.
    shapes = sorted((r.labels, r.chars) for r in listed.select("labels", "chars").distinct().collect())
    if not shapes:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    blocks = 1
    while blocks * BLOCK_BITS < n * BITS_PER_KEY:
        blocks *= 2

    labels = F.split("host", r"\.")
    ends = {k: F.array_join(F.slice(labels, F.size(labels) - (k - 1), F.lit(k)), ".") for k in {s[0] for s in shapes}}
    keys = F.array(
        *[
            F.when((F.col("host") != "") & (F.size(labels) >= k) & (F.length("path") >= c), F.concat(ends[k], F.substring("path", 1, c) if c else F.lit("")))
            for k, c in shapes
        ]
    )
    in_use = bloom_blocks(listed, blocks)
    if blocks <= SENT_BLOCKS:
        # One row, of SENT_BLOCKS blocks at most, beside every page.
        tested = pages.withColumn("__keys", keys).crossJoin(F.broadcast(_sent(in_use, blocks)))
        tested = tested.select(*pages.columns, F.filter("__keys", lambda k: _possible(k, blocks)).alias("__keys"))
        rest = tested.where(F.size("__keys") == 0).select(*pages.columns, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
        hit = tested.where(F.size("__keys") > 0)
        possible = hit.select("host", "path", "__keys").distinct().select("host", "path", F.explode("__keys").alias("key"))
        hit = hit.select(*pages.columns)
    else:
        rest, hit = None, pages
        wanted = pages.withColumn("__keys", keys).select("host", "path", "__keys").distinct().select("host", "path", F.explode(F.array_compact("__keys")).alias("key"))
        passes = [F.col(f"w{j}").bitwiseAND(m) == m for j, m in enumerate(_masks(F.col("key")))]
        possible = wanted.withColumn("block", _block(F.col("key"), blocks)).join(in_use, "block").where(passes[0] & passes[1] & passes[2] & passes[3])
    best = (
        possible.join(listed.select("key", "verdict"), "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), "verdict")).alias("best"))
        .select("host", "path", "best.rule", "best.verdict")
    )
    judged = hit.join(best, ["host", "path"], "left").select(*pages.columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    return judged if rest is None else judged.unionByName(rest)
