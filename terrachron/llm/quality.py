"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts are computed in Arrow batches, to which only the text goes. A random forest of shallow trees is grown on a bounded
sample of labelled texts; each path from a root to a node is a rule, a conjunction of thresholds. A lasso logistic
regression over the rules keeps a few of them. The model is compiled into one Spark column expression over the
statistics, which scores every text inside the JVM.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T

from terrachron.llm.common import materialise

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "bangs", "pipes", "marks", "stops", "wide",
    "distinct_words", "commonest_word", "repeated_neighbours", "distinct_triples", "line_words", "distinct_lines", "odd_words",
)
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
UPPER, DIGITS, WIDE = bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, all finite; all zero without text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    size, n = len(data), len(words)

    def share(chars: bytes) -> float:
        return (size - len(data.translate(None, chars))) / size

    letters = share(LETTERS) * size
    lines = [line for line in data.split(b"\n") if line.strip()]
    triples = n - 2
    return [
        math.log1p(size), math.log1p(n), sum(map(len, words)) / n, share(UPPER) * size / max(1.0, letters), share(DIGITS), share(b"!"), share(b"|"), share(b"#$%&*@^~=<>{}[]\\"), share(b".,;:?"), share(WIDE),
        len(set(words)) / n, Counter(words).most_common(1)[0][1] / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(set(zip(words, words[1:], words[2:]))) / triples if triples > 0 else 1.0, n / len(lines), len(set(lines)) / len(lines),
        sum(not w.translate(None, DIGITS + b"!|#$%&*@^~=<>{}[]\\.,;:?\"'()-_/+") for w in words) / n,
    ]


STRUCT = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])


def _statistics(texts: pa.Array) -> pa.Array:
    rows = [statistics(t) for start in range(0, len(texts), 1024) for t in texts.slice(start, 1024).to_pylist()]
    columns = list(zip(*rows)) if rows else [[]] * len(STATISTICS)
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], names=list(STATISTICS))


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with the struct _tc_stats. Only the text goes to Python; the other columns stay where they are."""
    # Not deterministic to the optimizer, so that it is computed once and not again for each use.
    return docs.withColumn("_tc_stats", F.arrow_udf(_statistics, STRUCT).asNondeterministic()("text"))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, threshold)


def tree_paths(description: str) -> set[Rule]:
    """The paths to all nodes but the root, from a Spark tree's description. Thresholds on one statistic and side are merged."""
    found: set[Rule] = set()
    path: list[tuple[int, bool, float]] = []
    for line in description.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (int(m[2]), m[3] == ">", float(m[4]))))
        tight: dict[tuple[int, bool], float] = {}
        for _, (f, above, t) in path:
            old = tight.get((f, above))
            tight[f, above] = t if old is None else max(old, t) if above else min(old, t)
        found.add(tuple(sorted((f, above, t) for (f, above), t in tight.items())))
    return found


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for f, above, t in rule:
        out = out & ((F.col("_tc_stats")[STATISTICS[f]] > t) if above else (F.col("_tc_stats")[STATISTICS[f]] <= t))
    return out


@dataclass
class RuleModel:
    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        """The probability of label 1, as one column expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, w in self.weights.items():
            total = total + F.when(rule_column(rule), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labels: int = 20_000, trees: int = 24, depth: int = 3, penalty: float = 0.001) -> RuleModel:
    """Learns from labelled rows that aren't held out: of all of them, the max_labels with the least hash of their doc_id.

    Labels other than 0 and 1 and rows without doc_id teach nothing. Of rows that share a doc_id, the least text teaches.
    With one class only, the score is a constant.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_tc_id"), F.col(label).cast("double").alias("_tc_label"))
    known = materialise(known.orderBy(F.xxhash64("_tc_id"), "_tc_id", "_tc_label").limit(max_labels))
    # At most max_labels rows of two numbers are broadcast.
    rows = docs.join(F.broadcast(known), docs["doc_id"] == F.col("_tc_id")).groupBy("_tc_id", "_tc_label").agg(F.min("text").alias("text"))
    rows = rows.select("_tc_id", F.col("_tc_label").alias("label"), "text")
    sample = materialise(with_statistics(rows).select("_tc_id", "label", "_tc_stats"))
    ones, n = sample.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return RuleModel(math.log(share / (1 - share)), {})
    # The forest draws its rows by their order, so that is set: equal tables give equal models, however they are partitioned.
    sample = sample.repartition(4, "_tc_id").sortWithinPartitions("_tc_id", "label")
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(sample.select("label", "_tc_stats.*"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", maxBins=64, seed=7).fit(vectors)
    rules = sorted(set().union(*(tree_paths(t.toDebugString) for t in forest.trees)))
    if not rules:
        return RuleModel(math.log(ones / (n - ones)), {})
    fired = sample.select("label", *(rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    fired = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(fired).select("label", "features")
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(fired)
    weights = {r: float(w) for r, w in zip(rules, lasso.coefficients) if w}
    return RuleModel(float(lasso.intercept), weights)


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted.

    A null or empty text has the statistics 0 and gets their score. Repeated rows get equal scores; a null doc_id
    isn't held out. An empty table gives no rows; other columns are ignored.
    """
    model = fit(docs, labels, **options)
    out = with_statistics(docs.select("doc_id", "text")).select("doc_id", model.score().alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows whose score is below 0.5; all columns stay as they are.

    A null or empty text is judged by the statistics 0, like any text of white space. Repeated rows stay or go
    together, a null doc_id makes no difference, an empty table gives no rows. Without a usable label
    every score is 0.5 and all rows stay; with labels of one class only, all rows get that verdict.
    """
    model = fit(docs, labels, **options)
    return with_statistics(docs).where(model.score() >= 0.5).drop("_tc_stats")
