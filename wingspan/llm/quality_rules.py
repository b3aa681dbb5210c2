"""Quality rules: counted signals, and a hashed n-gram log-likelihood ratio. DataFrame functions only.

Words are split at white space (space, \\x09-\\x0D). Their 1- and 2-grams are hashed into ``buckets``. Two multinomials over the buckets are estimated from whole counts with add-``smooth`` smoothing: the raw
corpus (all rows) and the trusted target (rows whose doc_id is labelled good). A document's score is the mean over its
n-grams of log(p_target / p_raw), so it doesn't grow with length; documents with a score under ``threshold`` are not
kept, each by the same comparison, none drawn at random. Counts are exact whole numbers, so a score does not depend on
how rows are dealt out.

Both counts are reduced to buckets within each task; only the join with the labels shuffles texts. The counting rules
need no shuffle: each row's windows of eight words are compared, by 64-bit hashes of their words' 64-bit hashes, within the row.

``judge_left_out`` scores each document against the counts of all others: its own n-grams are taken out of the raw counts
and, if it is trusted, out of the target, so that words seen seldom are not held against the document that has them. The
raw counts are smoothed by ``smooth`` times raw / target, so an n-gram that no other document has speaks neither way. Its
threshold is the greatest multiple of 1 / BINS under which at most ``lost_share`` of the trusted documents that pass
the base rules score; with no such document none fails by its score. Copies of a document are other documents.

Cases: a null or empty text has no words, no symbols and no lines with words; it fails the base rules (under 20 words)
and its score is 0. A null doc_id is never trusted. Repeated rows count and are judged each. A doc_id labelled good
anywhere in ``labels`` is trusted, however often. With no trusted rows no document fails by its score. Other columns are
left out of the result, so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wingspan.llm.common import cut

WINDOW = 8
#: Steps of the left-out threshold in a unit of score.
BINS = 1000
_SIGNALS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
_SPACE = r"[\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]"
_BLANKS = " \t\n\x0b\x0c\r"


def _split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE + "+"), "")


def _word_hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _joined(hashes: str, apart: int) -> Column:
    """The hash of each element with the one ``apart`` places on: so of twice as many words."""
    n = f"size({hashes}) - {apart}"
    return F.expr(
        f"CASE WHEN {n} > 0 THEN zip_with(slice({hashes}, 1, {n}), slice({hashes}, {apart + 1}, {n}), (a, b) -> xxhash64(a, b)) "
        "ELSE cast(array() AS array<bigint>) END"
    )


def _repeats(hashes: str) -> Column:
    return F.size(hashes) - F.size(F.array_distinct(hashes))


def signals(docs: DataFrame) -> DataFrame:
    """(row, doc_id, ones, twos, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) for every row.

    row: the row as it was; ones, twos: hashes of its words and of its pairs of words, in order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("words", _split_words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(_BLANKS))) > 0)
    long = lambda c: c.cast("long")
    rows = rows.select(
        "row", "doc_id", _word_hashes("words").alias("ones"), lines.alias("lines"),
        long(F.size("words")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        F.when(F.col("text").rlike(_SYMBOLS), long(F.size(F.split("text", _SYMBOLS)) - 1)).otherwise(F.lit(0).cast("long")).alias("n_symbols"),
    )
    rows = rows.withColumn("twos", _joined("ones", 1)).withColumn("fours", _joined("twos", 2))
    # a window that is found twice holds five runs of four words that are found twice
    rows = rows.select(
        "row", "doc_id", "ones", "twos", "n_words", "word_chars", "n_symbols", long(_repeats("lines")).alias("n_dup_lines"),
        F.when(_repeats("fours") >= 5, _joined("fours", 4)).alias("windows"),
    )
    # windows that are found twice or more: neighbours in the order of their hashes; each covers WINDOW words
    rows = rows.withColumn("placed", F.sort_array(F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN transform(windows, (h, i) -> struct(h AS h, i AS i)) END")))
    rows = rows.withColumn(
        "found",
        F.sort_array(F.expr("transform(filter(placed, (x, i) -> x.h = get(placed, i - 1).h OR x.h = get(placed, i + 1).h), x -> x.i)")),
    )
    covered = F.expr(
        f"CASE WHEN size(found) > 1 THEN {WINDOW} + aggregate(sequence(1, size(found) - 1), 0, (n, i) -> n + least({WINDOW}, found[i] - found[i - 1])) ELSE 0 END"
    )
    rows = rows.withColumn("n_repeat_words", long(covered)).drop("lines", "windows", "placed", "found")
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _bucket(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")


def bucket_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how often 1- and 2-grams of each bucket stand in the texts."""
    words = docs.select(_split_words(F.col("text")).alias("words")).select(_word_hashes("words").alias("ones"))
    # explode_outer: explode would first filter by the array's size, and so make each array twice
    grams = words.select(F.explode_outer(F.concat("ones", _joined("ones", 1))).alias("h")).filter("h IS NOT NULL")
    return grams.groupBy(_bucket(F.col("h"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def _good_ids(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("good_id"))


def _counts(docs: DataFrame, labels: DataFrame, buckets: int) -> tuple[list[int], list[int]]:
    """For every bucket how often it stands in all texts and in the trusted ones. As many numbers as buckets come to the driver."""
    good = _good_ids(labels)
    # labels grow with the documents: one plan at every size, which shuffles both sides and splits a frequent doc_id
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trusted = rows.join(good.hint("merge"), F.col("doc_id") == F.col("good_id"), "left_semi")
    counts = bucket_counts(docs, buckets).select("bucket", F.col("n").alias("raw"), F.lit(0).cast("long").alias("target")).union(
        bucket_counts(trusted, buckets).select("bucket", F.lit(0).cast("long"), "n")
    )
    raw, target = [0] * buckets, [0] * buckets
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return raw, target


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int, smooth: float) -> list[float]:
    """For every bucket log(p_target / p_raw), all 0 if nothing is trusted."""
    raw, target = _counts(docs, labels, buckets)
    raws, targets = sum(raw) + smooth * buckets, sum(target) + smooth * buckets
    if not any(target):
        return [0.0] * buckets
    return [math.log((t + smooth) / targets) - math.log((r + smooth) / raws) for r, t in zip(raw, target, strict=True)]


def _constant(numbers: list) -> Column:
    """As a constant, which Spark folds into one array."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


def _scored(docs: DataFrame, labels: DataFrame, buckets: int, smooth: float, threshold: float) -> DataFrame:
    if buckets & (buckets - 1):
        raise ValueError("buckets is a power of two")
    rows = signals(docs).withColumn("grams", F.concat("ones", "twos"))
    ratios = _constant(log_ratios(docs, labels, buckets, smooth))
    total = F.aggregate("grams", F.lit(0.0), lambda a, h: a + F.get(ratios, _bucket(h, buckets)))
    rows = rows.withColumn("score", F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0))
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop("ones", "twos", "grams")
    # behind a generator: Spark would push a filter on these columns down and write each array out again wherever it stands
    return rows.select(F.inline_outer(F.array(F.struct("*"))))


def judge(docs: DataFrame, labels: DataFrame, buckets: int = 8192, smooth: float = 1.0, threshold: float = -0.05) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): the signals, base_failed, score and kept. ``labels``: doc_id, quality."""
    return _scored(docs, labels, buckets, smooth, threshold).select(*_SIGNALS, "score", "kept")


def _left_out_scores(docs: DataFrame, labels: DataFrame, buckets: int, smooth: float) -> DataFrame:
    """(the signals, text_hash, trusted, score) for every row, each scored against the counts of all other rows."""
    raw, target = _counts(docs, labels, buckets)
    raws, targets = sum(raw), sum(target)
    rows = signals(docs).withColumn("cells", F.sort_array(F.transform(F.concat("ones", "twos"), lambda h: _bucket(h, buckets))))
    rows = rows.select(*_SIGNALS, F.xxhash64("row.text").alias("text_hash"), "cells", F.size("cells").alias("n"))
    if targets:
        raw_smooth = smooth * raws / targets
        # the logs of a cell that a text has once, which most are, are looked up; cells that it has again correct them
        less = lambda n, c: max(n - c, 0)
        once_raw = [math.log(less(r, 1) + raw_smooth) for r in raw]
        once = {
            "plain": [math.log(t + smooth) - x for t, x in zip(target, once_raw, strict=True)],
            "own": [math.log(less(t, 1) + smooth) - x for t, x in zip(target, once_raw, strict=True)],
        }
        in_raw, in_target = _constant(raw), _constant(target)

        def ended(s: Column) -> tuple[Column, ...]:
            """The corrections with the run of one cell that the state holds; the text has it ``again`` + 1 times.

            Each array stands here once: Spark writes a constant out wherever it stands in the plan."""
            c = s["again"] + 1
            of_raw = F.log1p(s["again"] / (F.get(in_raw, s["cell"]) - c + raw_smooth))
            of_target = F.log1p(-s["again"] / (F.greatest(F.get(in_target, s["cell"]) - 1, s["again"]) + smooth))
            return (s["plain"] + c * of_raw).alias("plain"), (s["extra"] + c * of_target).alias("extra")

        def step(s: Column, x: Column) -> Column:
            more = F.struct(s["cell"].alias("cell"), (s["again"] + 1).alias("again"), s["plain"].alias("plain"), s["extra"].alias("extra"))
            return F.when(x == s["cell"], more).otherwise(F.struct(x.alias("cell"), F.lit(1.0).alias("again"), *ended(s)))

        rows = rows.withColumn("more", F.filter("cells", lambda x, i: x == F.get("cells", i - 1)))
        start = F.struct(F.get("more", F.lit(0)).alias("cell"), *(F.lit(0.0).alias(k) for k in ("again", "plain", "extra")))
        # runs of equal cells; the -1 ends the last one
        rows = rows.withColumn("corrected", F.when(F.size("more") > 0, F.aggregate(F.concat("more", F.array(F.lit(-1))), start, step)))
        looked_up = lambda of: F.aggregate("cells", F.lit(0.0), lambda a, x: a + F.get(of, x))
        more = {k: F.coalesce(f"corrected.{k}", F.lit(0.0)) for k in ("plain", "extra")}
        sums = {"plain": looked_up(_constant(once["plain"])) + more["plain"], "own": looked_up(_constant(once["own"])) + more["plain"] + more["extra"]}
        of_raw = F.log(F.lit(float(raws)) - F.col("n") + raw_smooth * buckets)
        plain = sums["plain"] / F.col("n") - F.log(F.lit(targets + smooth * buckets)) + of_raw
        own = sums["own"] / F.col("n") - F.log(F.greatest(F.lit(float(targets)) - F.col("n"), F.lit(0.0)) + smooth * buckets) + of_raw
        told = [F.when(F.col("n") > 0, x).otherwise(0.0).alias(k) for k, x in (("plain", plain), ("own", own))]
        rows = rows.select(*_SIGNALS, "text_hash", *told)
    else:
        rows = rows.select(*_SIGNALS, "text_hash", F.lit(0.0).alias("plain"), F.lit(0.0).alias("own"))
    # the ids are written out, so that the join stands right on two shuffles and Spark can split a frequent doc_id; no texts go
    good = cut(_good_ids(labels).filter("good_id IS NOT NULL").distinct())
    rows = rows.join(good.hint("merge"), F.col("doc_id") == F.col("good_id"), "left")
    trusted = F.col("good_id").isNotNull()
    return rows.select(*_SIGNALS, "text_hash", trusted.alias("trusted"), F.when(trusted, F.col("own")).otherwise(F.col("plain")).alias("score"))


def _lost_threshold(rows: DataFrame, lost_share: float) -> float | None:
    """The greatest multiple of 1 / BINS under which at most this share of the trusted rows that pass the base rules score."""
    bins = rows.filter("trusted AND NOT base_failed").groupBy(F.floor(F.col("score") * BINS).alias("bin")).agg(F.count("*").alias("n"))
    held = sorted((r.bin, r.n) for r in bins.collect())  # scores are logs of ratios of counts: some ten thousand bins at most
    left = math.floor(lost_share * sum(n for _, n in held))
    for b, n in held:
        left -= n
        if left < 0:
            return b / BINS
    return None


def _judged_left_out(docs: DataFrame, labels: DataFrame, buckets: int, smooth: float, lost_share: float) -> DataFrame:
    if buckets & (buckets - 1):
        raise ValueError("buckets is a power of two")
    rows = cut(_left_out_scores(docs, labels, buckets, smooth))
    threshold = _lost_threshold(rows, lost_share)
    above = F.lit(True) if threshold is None else F.col("score") >= threshold
    return rows.withColumn("kept", ~F.col("base_failed") & above)


def judge_left_out(docs: DataFrame, labels: DataFrame, buckets: int = 32_768, smooth: float = 1.0, lost_share: float = 0.005) -> DataFrame:
    """As ``judge``, each row scored against all others and the threshold taken from the trusted rows' scores."""
    return _judged_left_out(docs, labels, buckets, smooth, lost_share).select(*_SIGNALS, "score", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, buckets: int = 32_768, smooth: float = 1.0, lost_share: float = 0.005) -> DataFrame:
    """The rows of ``docs`` that ``judge_left_out`` keeps, with all their columns as they were."""
    kept = _judged_left_out(docs, labels, buckets, smooth, lost_share).filter("kept")
    # by doc_id and text, from which the verdict follows; written out, so that the join stands right on two shuffles
    kept = cut(kept.select(F.col("doc_id").alias("__kept_id"), F.col("text_hash").alias("__kept_hash")).distinct())
    same = F.col("__kept_id").eqNullSafe(docs["doc_id"].cast("long")) & (F.col("__kept_hash") == F.xxhash64(docs["text"]))
    return docs.join(kept.hint("merge"), same, "left_semi")
