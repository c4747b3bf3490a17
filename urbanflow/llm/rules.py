"""Quality rules: per-document statistics and a log-likelihood ratio of hashed word n-grams, with DataFrame functions only.

Words and pairs of neighbouring words are hashed into ``2 ** BITS`` buckets.  Bucket counts over all documents give the
raw multinomial; those of the trusted documents (all that are labelled good) give the target multinomial; both are
smoothed towards the raw one.  A document's score is the mean of
log(target / raw) over its n-grams.  One half of the trusted documents gives the target, the other half, which the model
has not seen, fixes the threshold: their mean score less ``WIDTH`` standard deviations.  Every document is held against
it, and against the two base rules (fewer than 50 words; more than half of the words inside repeated 3-word windows).

The model is one array of ``2 ** BITS`` numbers (0.5 MB) whatever the data and goes into the plan as a literal; counting
combines before the shuffle, and scoring needs neither a join nor a shuffle.  Only the texts of trusted documents are
shuffled, once: a bit table of 8 MB keeps the others where they are.

Cases: a null text has no words and fails the base rules; a text without n-grams scores 0; with no trusted document at
all the ratio is 0 for every text and only the base rules decide; repeated rows count and score as often as they occur; very
long texts are read whole; an empty table gives an empty result.  Columns named
like a result column are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanflow.llm.common import BLANKS, bit_table, quoted, with_bit, word_array
from urbanflow.session import checkpointed

BITS = 16
#: Weight of the raw distribution in the target one, in n-grams for every bucket.
SMOOTHING = 0.5
WIDTH = 3.0
#: Scores are added up as integers of this many units.
UNITS = 10 ** 9
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]


def _statistics(rows: DataFrame, text: Column) -> DataFrame:
    """Adds the base statistics and ``codes``, a 64-bit hash of each word.

    Arrays that a lambda reads are columns of their own, so that they are made once for a row.
    """
    rows = rows.withColumn("body", F.coalesce(text, F.lit(""))).withColumn("words", word_array(F.col("body")))
    lines = F.filter(F.split("body", "\n"), lambda line: line.rlike(f"[^{BLANKS}]"))
    rows = rows.withColumns({
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long"),
        "lines": lines,
        "codes": F.transform("words", lambda w: F.xxhash64(w))}).drop("body", "words")
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    return _repeated_words(rows)


def _repeated_words(rows: DataFrame, window: int = 3) -> DataFrame:
    """Adds ``n_repeat_words``: words in windows of ``window`` words that the text has twice or more.

    Hashes of the windows are sorted with their places; a window is repeated if a neighbour has its hash.  Places of
    repeated windows in order then cover at most ``window`` words more than the place before.
    """
    starts = F.sequence(F.lit(0), F.size("codes") - window)
    grams = F.when(F.size("codes") >= window, F.transform(
        starts, lambda i: F.xxhash64(*[F.get("codes", i + k) for k in range(window)])))
    rows = rows.withColumn("grams", grams)
    rows = rows.withColumn("marked", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.array_sort(
        F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    places = F.filter("marked", lambda x, n: ((n > 0) & F.get("marked", n - 1)["h"].eqNullSafe(x["h"]))
                      | F.get("marked", n + 1)["h"].eqNullSafe(x["h"]))
    covered = F.aggregate(
        F.array_sort(F.transform(places, lambda x: x["i"])), F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"])
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("grams", "marked")


def _buckets(codes: str) -> Column:
    """The buckets of the words and of the pairs of neighbours."""
    size = F.lit(1 << BITS)
    starts = F.sequence(F.lit(0), F.size(codes) - 2)
    pairs = F.when(F.size(codes) >= 2, F.transform(
        starts, lambda i: F.pmod(F.xxhash64(F.get(codes, i), F.get(codes, i + 1)), size).cast("int")))
    return F.concat(F.transform(codes, lambda c: F.pmod(c, size).cast("int")),
                    F.coalesce(pairs, F.array().cast("array<int>")))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the documents labelled good."""
    good = labels.where((F.col("quality") == 1) & quoted(id_col).isNotNull()).select(quoted(id_col).alias("trusted_id"))
    return checkpointed(good.distinct())


def _trusted_texts(df: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(first_half, codes) of the trusted documents, as a table.

    A bit table lets only rows through whose id can be trusted, so no other text is shuffled, whatever the size; the join
    with the ids themselves then leaves out those that came through by chance.
    """
    texts = df.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("body"))
    bits = bit_table(trusted, ["trusted_id"])
    near = with_bit(texts.withColumnRenamed("id", "trusted_id"), ["trusted_id"], bits, "maybe").where("maybe").drop("maybe")
    # The same plan at every size: ids grow with the labels, so they are never broadcast.
    own = near.join(trusted.hint("shuffle_merge"), "trusted_id")
    first_half = F.pmod(F.xxhash64("trusted_id"), F.lit(2)) == 0
    return checkpointed(own.select(first_half.alias("first_half"), "body"))


def _counts(rows: DataFrame, name: str) -> DataFrame:
    """(bucket, name): n-grams of ``body`` in each bucket."""
    codes = rows.select(F.transform(word_array(F.col("body")), lambda w: F.xxhash64(w)).alias("codes"))
    return codes.select(F.explode(_buckets("codes")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def fit(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[float], float]:
    """The weight of each bucket, and the threshold; ``trusted`` has the column ``trusted_id``."""
    good = _trusted_texts(df, trusted, id_col, text_col)
    raw = _counts(df.select(F.coalesce(quoted(text_col), F.lit("")).alias("body")), "raw")
    target = _counts(good.where("first_half"), "target")
    spark = df.sparkSession
    every = spark.range(1 << BITS).select(F.col("id").cast("int").alias("bucket")).join(raw, "bucket", "left").join(
        target, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    packed = checkpointed(every.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows")))
    sums = packed.select(*[F.aggregate(f"rows.{c}", F.lit(0).cast("long"), lambda a, x: a + x).alias(f"{c}_sum")
                           for c in ("raw", "target")], "rows")
    size, extra = float(1 << BITS), SMOOTHING * (1 << BITS)
    share = (F.col("raw_sum") + size)

    def weight(row: Column) -> Column:
        raw = (row["raw"] + 1.0) / share
        return F.log((row["target"] + extra * raw) / (F.col("target_sum") + extra) / raw)

    model = sums.select(F.transform("rows", weight).alias("weights")).first()["weights"]
    held = good.where("not first_half").select(F.transform(word_array(F.col("body")), lambda w: F.xxhash64(w)).alias("codes"))
    # Integer sums do not depend on the order in which tasks end, so the threshold is the same in every run.
    unit = F.round(F.col("score") * UNITS).cast("decimal(38,0)")
    seen = _scored(held, model).where("size(codes) > 0").agg(F.count("*"), F.sum(unit), F.sum((unit * unit).cast("decimal(38,0)")))
    n, total, squares = seen.first()
    if not n:
        return model, float("-inf")
    variance = (int(squares) * n - int(total) ** 2) / n ** 2
    return model, (int(total) / n - WIDTH * variance ** 0.5) / UNITS


def _scored(rows: DataFrame, model: list[float]) -> DataFrame:
    """Adds ``score``: the mean weight of the n-grams in ``codes``."""
    rows = rows.withColumn("buckets", _buckets("codes"))
    weights = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # folded to one literal
    total = F.aggregate("buckets", F.lit(0.0), lambda acc, b: acc + F.get(weights, b))
    return rows.withColumn("score", F.when(F.size("buckets") > 0, total / F.size("buckets")).otherwise(0.0)).drop("buckets")


def apply_rules(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the statistics, ``score``, ``base_failed`` and ``kept``; ``labels`` has ``id_col`` and ``quality``."""
    kept = [c for c in df.columns if c.lower() not in RESULT]
    model, threshold = fit(df, trusted_ids(labels, id_col), id_col, text_col)
    rows = df.select(*[quoted(c).alias(f"in{n}") for n, c in enumerate(kept)], quoted(text_col).alias("source_text"))
    rows = _scored(_statistics(rows, F.col("source_text")), model)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
    return rows.select(*[F.col(f"in{n}").alias(c) for n, c in enumerate(kept)], *RESULT)
