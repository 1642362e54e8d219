"""A text classifier on hashed words, and local explanations of a scorer.

Training uses all labelled rows. Defined results: rows without text or label are not trained on; a test row without
text gets the commonest label's prediction from an empty vector; explanations of texts without words have no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloka.constants import PRIORITY, RULES, SELF_TRAINING, SOURCE_PRIORITY
from sparkloka.functions.text import candidates, dedupe_key, is_indonesian, language_scores, normalize_text
from sparkloka.operators import rules
from sparkloka.operators.evaluation import class_weights
from sparkloka.operators.rows import keep_one, top_per

#: Cells of the table of masks that are made at a time.
CELLS = 1 << 20


def _words(df: DataFrame) -> DataFrame:
    return df.withColumn("words", F.filter(F.split(normalize_text(F.col("text")), " "), lambda w: w != ""))


def fit(train: DataFrame, label: str = "final_signal") -> PipelineModel:
    rows = _words(train.filter(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).alias("label_name"), "text"))
    rows = rows.join(F.broadcast(class_weights(rows, "label_name").select("label_name", "weight")), "label_name")
    index = StringIndexer(inputCol="label_name", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    stages = [index, HashingTF(inputCol="words", outputCol="tf", numFeatures=1 << 14), IDF(inputCol="tf", outputCol="features", minDocFreq=2), LogisticRegression(maxIter=30, regParam=0.05, weightCol="weight"), IndexToString(inputCol="prediction", outputCol="guess", labels=index.labels)]
    return Pipeline(stages=stages).fit(rows)


def _scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds ``guess`` and ``p``, the probabilities from the highest down."""
    from pyspark.ml.functions import vector_to_array

    made = _words(rows)
    for stage in model.stages[1:]:
        made = stage.transform(made)
    return made.select(*rows.columns, "guess", F.sort_array(vector_to_array("probability"), asc=False).alias("p"))


def predict(model: PipelineModel, rows: DataFrame, label: str = "final_signal") -> DataFrame:
    """(row_id, truth, guess, confidence, margin)."""
    made = _scored(model, rows.select("row_id", "text", F.col(label).alias("truth")))
    p = F.col("p")
    return made.select("row_id", "truth", "guess", F.round(p[0], 6).alias("confidence"), F.round(p[0] - p[1], 6).alias("margin"))


def hinted(pool: DataFrame, known: DataFrame) -> DataFrame:
    """(row_id, pos, text, hint, score): the pool's candidates for self-training, at most a quota of each hint label.

    Candidates are the Indonesian pieces of a text that the rule book gives a label by their own words; the first of
    each dedupe key counts, and keys of ``known`` texts are left out."""
    order = {name: -i for i, name in enumerate(SELF_TRAINING)}
    made = pool.select("row_id", "source", F.posexplode(candidates(F.col("text"))).alias("pos", "text"))
    made = made.filter(F.length("text").between(12, 220) & F.size(F.split("text", " ")).between(3, 42) & is_indonesian(language_scores(F.col("text"))))
    made = rules.label(made, "text", priority=order).filter("score > 0").select("row_id", "pos", "source", "text", F.col("label").alias("hint"), "score", dedupe_key(F.col("text")).alias("key")).filter("key <> ''")
    first = keep_one(made, ["key"], [F.col("row_id"), F.col("pos")])
    fresh = first.join(known.select(dedupe_key(F.col("text")).alias("key")).distinct(), "key", "left_anti").drop("key")
    most = _limit(0, "hint")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv]), F.col("source")), F.lit(0))
    return top_per(fresh, "hint", [F.desc("score"), rank.desc(), F.col("text"), F.col("row_id")], most).drop("rank_in_group", "source")


def _limit(i: int, name: str) -> Column:
    return F.create_map(*[F.lit(x) for k, v in SELF_TRAINING.items() for x in (k, v[i])])[F.col(name)]


def agreed(scored: DataFrame) -> DataFrame:
    """Of candidates (hint, guess, confidence, margin, score, text, row_id, pos) those where model and hint agree and
    confidence and margin reach the label's limits; then the best of each label up to the most that is kept."""
    sure = scored.filter((F.col("guess") == F.col("hint")) & (F.col("confidence") >= _limit(1, "guess")) & (F.col("margin") >= _limit(2, "guess")))
    return top_per(sure, "guess", [F.desc("confidence"), F.desc("margin"), F.desc("score"), F.col("text"), F.col("row_id"), F.col("pos")], _limit(3, "guess"))


def pseudolabels(train: DataFrame, pool: DataFrame, known: DataFrame) -> DataFrame:
    """(row_id, pos, text, label, confidence, margin, score, rank_in_group): one round of self-training."""
    rows = _scored(fit(train), hinted(pool, known))
    # limits are tried on the probabilities as they are, not as they are rounded
    kept = agreed(rows.withColumn("confidence", F.col("p")[0]).withColumn("margin", F.col("p")[0] - F.col("p")[1]))
    return kept.select("row_id", F.col("pos").cast("long").alias("pos"), "text", F.col("guess").alias("label"), F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"), "score", F.col("rank_in_group").cast("long").alias("rank_in_group"))


def _bucket(word: str, size: int) -> int:
    """HashingTF's place of a word: MurmurHash3 of its bytes with seed 42."""
    data, h, full = word.encode(), 42, 0xFFFFFFFF
    rot = lambda x, r: (x << r | x >> (32 - r)) & full
    mix = lambda k: rot(k * 0xCC9E2D51 & full, 15) * 0x1B873593 & full
    whole = len(data) & ~3
    for i in range(0, whole, 4):
        h = (rot(h ^ mix(int.from_bytes(data[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & full
    h ^= mix(int.from_bytes(data[whole:], "little")) ^ len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & full
    h = (h ^ h >> 13) * 0xC2B2AE35 & full
    h ^= h >> 16
    return (h - (h >> 31 << 32)) % size


class ModelScorer:
    """The probability that a fitted model gives a masked text for the label it predicts for the whole text.

    The model is linear in the counts of words up to the softmax, so a masked text's logits are a sum over its words."""

    def __init__(self, model: PipelineModel) -> None:
        index, _, idf, lr, _ = model.stages
        self.labels = list(index.labels)
        coef, self.bias = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
        if len(coef) == 1 and len(self.labels) == 2:  # two labels: one row of coefficients for the second
            coef, self.bias = np.vstack([np.zeros_like(coef), coef]), np.array([0.0, self.bias[0]])
        self.coef = np.ascontiguousarray((coef * idf.idf.toArray()).T)

    def of(self, words: list[str], vocab: list[str]) -> tuple[str, Callable[[np.ndarray], np.ndarray]] | None:
        counts = Counter(words)
        parts = np.array([self.coef[_bucket(w, len(self.coef))] * counts[w] for w in vocab])

        def probabilities(masks: np.ndarray) -> np.ndarray:
            logits = masks @ parts + self.bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        best = int(probabilities(np.ones((1, len(vocab))))[0].argmax())
        return self.labels[best], lambda masks: probabilities(masks)[:, best]


class RuleScorer:
    """The rule book's score of a masked text for the label it gives the whole text; None for texts without a hit."""

    def of(self, words: list[str], vocab: list[str]) -> tuple[str, Callable[[np.ndarray], np.ndarray]] | None:
        whole = {name: rules.score_words(words, name) for name in RULES}
        best = max(RULES, key=lambda name: (whole[name], PRIORITY[name]))
        if whole[best] <= 0:
            return None
        at = {w: i for i, w in enumerate(vocab)}
        return best, lambda masks: np.array([rules.score_words([w for w in words if m[at[w]]], best) for m in masks])


def explain(rows: DataFrame, model: PipelineModel | None = None, samples: int = 500, top: int = 3) -> DataFrame:
    """(row_id, label, token, weight): which words move the score of the predicted label.

    A ridge regression of the scorer (a fitted model, else the rule book) over random word masks of each text, as a
    local surrogate; every masked text is scored. Texts of many distinct words get eight masks a word."""
    scorer = rows.sparkSession.sparkContext.broadcast(ModelScorer(model) if model else RuleScorer())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row_id, words in zip(pdf["row_id"], pdf["words"]):
                words = list(words)
                vocab = list(dict.fromkeys(words))
                if not vocab or not (found := scorer.value.of(words, vocab)):
                    continue
                name, score = found
                rng = np.random.default_rng(int(row_id) & 0xFFFFFFFF)
                n, todo = len(vocab), max(samples, 8 * len(vocab))
                left, right = 0.1 * np.eye(n + 1), np.zeros(n + 1)
                step = max(1, CELLS // n)
                for start in range(0, todo, step):  # in parts, so long texts take no more memory for their masks
                    masks = (rng.random((min(step, todo - start), n)) < 0.5).astype(float)
                    if start == 0:
                        masks[0] = 1.0
                    x = np.hstack([np.ones((len(masks), 1)), masks])
                    near = np.exp(-((1 - masks.mean(axis=1)) ** 2) / 0.25)
                    left += x.T @ (x * near[:, None])
                    right += x.T @ (near * score(masks))
                beta = np.linalg.solve(left, right)[1:]
                for i in sorted(range(n), key=lambda i: (-abs(beta[i]), vocab[i]))[:top]:
                    out.append((row_id, name, vocab[i], round(float(beta[i]), 6)))
            yield pd.DataFrame(out, columns=["row_id", "label", "token", "weight"])

    return _words(rows.filter("text IS NOT NULL").select("row_id", "text")).select("row_id", "words").mapInPandas(run, "row_id bigint, label string, token string, weight double")
