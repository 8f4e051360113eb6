"""Katz backoff models of any order as stored tables, which score texts other than those they were learned from.

``fit`` writes, below one folder, for each order m

    grams/order=m      (history, word, n, log_p)    n-grams of m words, history of m - 1; log_p = log10 of the discounted probability
    histories/order=m  (history, n, log_alpha)      m > 1: how often a history occurs, and its backoff weight

and ``score`` evaluates a token from the highest order down: its n-gram's log_p where it was seen, else the history's
log_alpha (0 where the history is new) and the n-gram without its first word.  Tokens and marks are those of ``katz``:
words without blanks, A-Z lower-cased, one end; the first words have start marks before them.  The first order is

    P1(w) = cut(c(w)) / N, and for all words that training lacks together the mass that is left

with cut(c) = d(c) c for c <= K by Good-Turing.  ``above="whole"`` leaves larger counts whole, as Katz does; a history
all of whose words occur more than K times would keep nothing for others, so one is added to its count.  With ``"half"``
larger counts lose half a count instead, which is what ``katz.score_texts`` does: at order two both give the same scores.
alpha(h) is such that the probabilities after h sum to one exactly.

How it is computed.  Texts are read once: every token is one n-gram of the highest order, and counts of m - 1 words are sums over
counts of m words.  All is grouping and joins of DataFrames; each table is written before the next reads it.  Joins whose left
side has keys with very many rows (a frequent history) spread these keys over ``SALTS`` copies of the right side's row.

Edge cases: a null or empty text is one end token; a null doc_id is a row like others; repeated rows are scored each; a model of
no texts gives every token probability one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .katz import K, discounts
from .textkit import shared_dir, stored

#: No word contains these.
START, END = "\t", "\n"
#: A key is spread where it has more rows than this and than a ``MOST_HOT``-th of all.
HOT, MOST_HOT, SALTS = 200_000, 1_000, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Model:
    """Where the tables are, and what scoring needs besides: training tokens and the probability of all unknown words."""

    path: str
    order: int
    tokens: int
    unknown: float

    def grams(self, spark: SparkSession, m: int) -> DataFrame:
        return spark.read.schema("history string, word string, n bigint, log_p double").parquet(f"{self.path}/grams/order={m}")

    def histories(self, spark: SparkSession, m: int) -> DataFrame:
        return spark.read.schema("history string, n bigint, log_alpha double").parquet(f"{self.path}/histories/order={m}")


def tokens(docs: DataFrame, order: int, *keep: str) -> DataFrame:
    """(*keep, history, word): a row for each token, the history being the order - 1 words before it, joined by blanks."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    padded = docs.select(*keep, F.concat(F.array_repeat(F.lit(START), order - 1), words, F.array(F.lit(END))).alias("w"))
    history = lambda i: F.concat_ws(" ", *(F.get("w", i - k) for k in range(order - 1, 0, -1)))
    grams = F.transform(F.sequence(F.lit(order - 1), F.size("w") - 1), lambda i: F.struct(history(i).alias("history"), F.get("w", i).alias("word")))
    return padded.select(*keep, F.explode(grams).alias("g")).select(*keep, "g.*")


def shorter(m: int):
    """The history of an n-gram of m words without its first word."""
    return F.lit("") if m == 2 else F.expr("substring(history, instr(history, ' ') + 1)")


def spread_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a side of unique keys; rows of ``left`` under keys that have very many of them go to several tasks."""
    bound = max(HOT, left.count() // MOST_HOT)
    hot = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > bound).select(*on, F.lit(True).alias("_hot"))
    hot = stored(hot)  # fewer than MOST_HOT rows
    if hot.isEmpty():
        return left.join(right, on, "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(0).cast("int")
    many = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_hot")
    copies = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(many)).drop("_hot")
    return dealt.join(copies, [*on, "_salt"], "left").drop("_salt")


def _cut(n: str, d: list[float], whole: bool):
    """A count after its discount."""
    out = F.when(F.col(n) == 1, F.lit(d[0]))
    for r in range(2, K + 1):
        out = out.when(F.col(n) == r, F.lit(d[r - 1] * r))
    return out.otherwise(F.col(n) if whole else F.col(n) - 0.5)


def _discounts(counts: DataFrame) -> list[float]:
    seen = dict(counts.filter(F.col("n") <= K + 1).groupBy("n").count().collect())
    return discounts([float(seen.get(r, 0)) for r in range(1, K + 2)])


def fit(docs: DataFrame, order: int = 3, above: str = "whole", path: str | None = None) -> Model:
    """Learns a model of ``docs`` (text) and writes its tables below ``path`` (a fresh shared folder if None)."""
    if order < 1 or above not in ("whole", "half"):
        raise ValueError("the order is 1 or more, larger counts are left whole or lose half a count")
    spark, whole = docs.sparkSession, above == "whole"
    path = path or shared_dir(spark)
    counts = {order: stored(tokens(docs, order).groupBy("history", "word").agg(F.count(F.lit(1)).alias("n")))}
    for m in range(order, 1, -1):
        counts[m - 1] = stored(counts[m].groupBy(shorter(m).alias("history"), "word").agg(F.sum("n").alias("n")))

    d = _discounts(counts[1])
    total, least, used = counts[1].agg(F.sum("n"), F.min("n"), F.sum(_cut("n", d, whole))).first()
    size = (total or 0) + (1 if whole and (least or 0) > K else 0)
    model = Model(path, order, total or 0, 1 - used / size if size else 1.0)
    one = counts[1].select("history", "word", "n", F.log10(_cut("n", d, whole) / F.lit(float(max(size, 1)))).alias("log_p"))
    one.write.parquet(f"{path}/grams/order=1")
    for m in range(2, order + 1):
        d = _discounts(counts[m])
        sums = counts[m].groupBy("history").agg(F.sum("n").alias("of"), F.min("n").alias("least"), F.sum(_cut("n", d, whole)).alias("used"))
        size = F.col("of") + (F.when(F.col("least") > K, 1).otherwise(0) if whole else F.lit(0))
        sums = stored(sums.select("history", "of", size.alias("size"), (1 - F.col("used") / size).alias("kept")))
        grams = spread_join(counts[m], sums.select("history", "size"), ["history"])
        grams.select("history", "word", "n", F.log10(_cut("n", d, whole) / F.col("size")).alias("log_p")).write.parquet(f"{path}/grams/order={m}")
        # what the words seen after a history have in the order below
        seen = counts[m].select(F.col("history").alias("long"), shorter(m).alias("history"), "word")
        lower = spread_join(seen, model.grams(spark, m - 1).select("history", "word", "log_p"), ["history", "word"])
        lower = lower.groupBy(F.col("long").alias("history")).agg(F.sum(F.pow(F.lit(10.0), "log_p")).alias("below"))
        weights = sums.join(lower, "history").select("history", F.col("of").alias("n"), F.log10(F.col("kept") / (1 - F.col("below"))).alias("log_alpha"))
        weights.write.parquet(f"{path}/histories/order={m}")
    spark.createDataFrame([(model.order, model.tokens, model.unknown)], "`order` int, tokens bigint, unknown double").write.parquet(f"{path}/model")
    return model


def load(spark: SparkSession, path: str) -> Model:
    """A model that ``fit`` has written."""
    return Model(path, *spark.read.parquet(f"{path}/model").select("order", "tokens", "unknown").first())


def evaluate(grams: DataFrame, model: Model) -> DataFrame:
    """Rows of ``grams`` (history, word and other columns) with log_p, log10 of the word's probability after its history."""
    spark = grams.sparkSession
    others = [c for c in grams.columns if c not in ("history", "word")]
    rest, done = grams.withColumn("backed", F.lit(0.0)), None
    for m in range(model.order, 0, -1):
        met = stored(spread_join(rest, model.grams(spark, m).select("history", "word", "log_p"), ["history", "word"]))
        hit = met.filter("log_p is not null").select(*others, (F.col("backed") + F.col("log_p")).alias("log_p"))
        done = hit if done is None else done.unionByName(hit)
        rest = met.filter("log_p is null").drop("log_p")
        if m > 1:
            weighed = spread_join(rest, model.histories(spark, m).select("history", "log_alpha"), ["history"])
            rest = weighed.select(*others, "word", (F.col("backed") + F.coalesce("log_alpha", F.lit(0.0))).alias("backed"), shorter(m).alias("history"))
    return done.unionByName(rest.select(*others, (F.col("backed") + F.log10(F.lit(model.unknown))).alias("log_p")))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, score) of every row of docs (doc_id, text): log10 of the text's probability."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    grams = stored(tokens(numbered, model.order, "row", "doc_id").groupBy("row", "doc_id", "history", "word").agg(F.count(F.lit(1)).alias("times")))
    each = evaluate(grams, model).groupBy("row", "doc_id").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.col("log_p")).alias("score"))
    return each.select("doc_id", "n_tokens", "score")
