"""Line dedup by winnowing: delete later repeats of runs of lines.

A line is trimmed; blank lines take no part. Lines are hashed, and a window starts at each line and reaches over as few
lines as hold ``min_words`` words; another ends at each line and reaches up as far. The least hash of a window is its
fingerprint. A run of at least ``min_words`` words that two places share holds a whole window over each of its lines
(up from the line where that stays in the run, else down from the run's first line), so that both places have the same
fingerprints in it: the guarantee of winnowing.

A fingerprint alone may be a frequent line that first stands in other surroundings, and one window a fingerprint may
reach out of the shared run. So each window is named by its fingerprint and by a hash of all its lines, and is joined
with the first place of that name (documents in order of doc_id, then of the text's hash; null ids first), never with
all others. A window that stands earlier is deleted; those of a document that touch are one run. Each deleted line
equals an earlier line, and following those leads to a line that is kept, so no content is lost.

All is DataFrame operations. Identity is (doc_id, text): repeated rows are one document and come out alike. Null or
empty texts have no lines and stay as they are; documents under ``min_words`` words lose nothing; extra columns pass
through; an empty table gives an empty result. Words of a line are its gaps (spaces, tabs and the like) and one, but at
least one for each UNSPACED characters, so that passages in scripts without spaces count too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelens.llm.common import staged

MIN_WORDS = 50
#: Far above the length of words that spaces part, so that it changes nothing there.
UNSPACED = 20
GAPS = " \t\u000b\f\r\u00a0\u3000"


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line that is not blank: document, place, hash, and the words before and after it."""
    line = F.trim(F.col("line"))
    rows = (
        docs.where("text is not null")
        .select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("lines"))  # before the lines: one hash a text
        .select("doc_id", "th", F.posexplode_outer("lines").alias("pos", "line"))  # outer: no filter that splits again is inferred
        .select("doc_id", "th", "pos", line.alias("line"))
        .where("line <> ''")
        .select(
            "doc_id", "th", "pos", F.xxhash64("line").alias("hash"),
            F.greatest(F.length("line") - F.length(F.translate("line", GAPS, "")) + 1, F.ceil(F.length("line") / UNSPACED)).cast("long").alias("words"),
        )
        .repartition("doc_id", "th")  # the only exchange of lines: what follows needs a document's together
        .dropDuplicates(["doc_id", "th", "pos"])
    )
    doc = Window.partitionBy("doc_id", "th")
    return rows.withColumn("stop", F.sum("words").over(doc.orderBy("pos"))).withColumn("start", F.col("stop") - F.col("words"))


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each window: document, fingerprint, hash of all its lines, and where it begins and ends (words, lines)."""
    doc = Window.partitionBy("doc_id", "th")
    down = doc.orderBy("start").rangeBetween(0, min_words - 1)
    up = doc.orderBy("stop").rangeBetween(1 - min_words, 0)
    window = lambda full, hashes, a, b, first, last: F.when(full, F.struct(
        F.array_min(hashes).alias("least"), F.xxhash64(hashes).alias("whole"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(first).alias("first_line"), F.col(last).alias("last_line")
    ))
    from_here = window(F.col("total") - F.col("start") >= min_words, "hashes", "start", "b", "pos", "last")
    # one that is also the window from its first line is not needed twice
    to_here = window((F.col("stop") >= min_words) & (F.col("start") - F.col("a") >= min_words), "hashes_up", "a", "stop", "first", "pos")
    return (
        _lines(docs)
        .withColumn("total", F.max("stop").over(doc))
        .withColumns({"hashes": F.collect_list("hash").over(down), "b": F.max("stop").over(down), "last": F.max("pos").over(down)})
        .withColumns({"hashes_up": F.collect_list("hash").over(up), "a": F.min("start").over(up), "first": F.min("pos").over(up)})
        .select("doc_id", "th", F.explode(F.array_compact(F.array(from_here, to_here))).alias("w"))
        .select("doc_id", "th", "w.*")
    )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, runs): the runs of lines to delete, as (first, last) places of lines; th is the text's hash."""
    doc = Window.partitionBy("doc_id", "th")
    windows = staged(_windows(docs, min_words), "windows")  # read twice below
    firsts = (
        windows.groupBy("least", "whole")
        .agg(F.min(F.struct("doc_id", "th", "a")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("least", "whole", "first")
    )
    matched = windows.join(firsts, ["least", "whole"]).where(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th")) & (F.col("a") == F.col("first.a")))
    ).select("doc_id", "th", "first_line", "last_line", "a", "b")
    sweep = doc.orderBy("a", "b")
    return (
        matched.withColumn("reach", F.max("b").over(sweep.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("run", F.sum(F.when(F.col("a") > F.col("reach"), 1).otherwise(0)).over(sweep))
        .groupBy("doc_id", "th", "run")
        .agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("first_line").alias("first"), F.max("last_line").alias("last"))
        .where(F.col("b") - F.col("a") >= min_words)
        .groupBy("doc_id", "th")
        .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated runs cut out of text, n_chars (if there) set anew, and n_removed, the lines cut."""
    docs = docs.drop("n_removed")
    runs = repeated_runs(docs, min_words).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("runs").alias("__runs"))
    kept = F.filter(
        F.split("text", "\n"), lambda line, i: ~F.exists("__runs", lambda r: (i >= r["first"]) & (i <= r["last"]))
    )
    text = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    lines = lambda t: F.when(t.isNull() | (t == ""), 0).otherwise(F.size(F.split(t, "\n")))
    joined = docs.join(runs, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left")
    out = joined.select(*[F.col(f"`{c}`") for c in docs.columns], "__runs", text.alias("__cut_text"))
    columns = [F.col("__cut_text").alias("text") if c == "text" else F.length("__cut_text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    removed = F.when(F.col("__runs").isNull(), 0).otherwise(lines(F.col("text")) - lines(F.col("__cut_text")))
    return out.select(*columns, removed.cast("long").alias("n_removed"))
