"""Toxicity by a chain of linear classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import small_batches, written
from graphweave.llm.models import bounded_sample, fit_logistic, sigmoid

#: Bounds of the fit: labelled documents sampled, words kept as features per category.
SAMPLE_DOCS = 20_000
FEATURE_WORDS = 600
FOLDS = 5
#: Chance that any word without a bearing on a category is taken for a feature of it.
BY_CHANCE = 0.05
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Chain:
    """Category names in order; feature words; per category weights (words, then earlier probabilities) and bias; the last category's cut."""

    categories: list[str]
    words: list[str]
    weights: list[np.ndarray] = field(default_factory=list)
    biases: list[float] = field(default_factory=list)
    cut: float = 1.0

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """One row per text, one column per category; each category's model sees the ones before it."""
        place = {w: i for i, w in enumerate(self.words)}
        known = place.keys()
        found = [[place[w] for w in words_of(text) & known] for text in texts]
        row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        at = np.array([i for f in found for i in f], np.int64)
        out = np.zeros((len(texts), len(self.categories)))
        for c, (w, b) in enumerate(zip(self.weights, self.biases)):
            own = np.bincount(row, weights=w[at], minlength=len(texts))
            out[:, c] = sigmoid(own + out[:, :c] @ w[len(place) :] + b)
        return out


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The cut on probabilities ``p`` with the best F1 for labels ``y``, the highest of equals, halfway to the next lower probability; 1 without positives."""
    if not y.sum():
        return 1.0
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # equal probabilities fall on one side
    at = int(f1.argmax())
    return float(p[at] + p[at + 1]) / 2 if at + 1 < len(p) else float(p[at]) / 2


def choose_words(sample: DataFrame, categories: list[str], most: int = FEATURE_WORDS) -> list[str]:
    """For each category the ``most`` words at most whose document counts depend on it most, by the log-likelihood ratio G2.

    A word counts if its G2 is beyond what chance gives any of the words (chance BY_CHANCE, shared among all words). Counted over the
    sample's whole texts, summed by word before the best are taken; ties go to the lesser word.
    """

    def frame(held: dict[str, list[int]]) -> pd.DataFrame:
        rows = pd.DataFrame.from_dict(held, orient="index", columns=[*categories, "n"])
        return rows.rename_axis("word").reset_index()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}
        for pdf in batches:
            for text, *labels in pdf.itertuples(index=False):
                add = [*labels, 1]
                for w in words_of(text):
                    held[w] = [a + b for a, b in zip(held[w], add)] if w in held else add
                if len(held) > 50_000:
                    yield frame(held)
                    held = {}
        if held:
            yield frame(held)

    kinds = ", ".join(f"`{c}` long" for c in categories)
    counts = sample.select("text", *categories).mapInPandas(run, f"word string, {kinds}, n long")
    counts = written(counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in categories], F.sum("n").alias("n")).where("n >= 3"), "words")
    totals = sample.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    need = 2 * np.log(max(counts.count(), 1) / BY_CHANCE)
    term = lambda x: F.when(x > 0, x * F.log(x.cast("double"))).otherwise(0.0)
    chosen: dict[str, None] = {}
    for c in categories:
        whole, yes = F.lit(totals["n"] or 0), F.lit(totals[c] or 0)
        n, a = F.col("n"), F.col(c)
        g = 2 * (term(a) + term(n - a) + term(yes - a) + term(whole - yes - n + a) + term(whole) - term(n) - term(whole - n) - term(yes) - term(whole - yes))
        best = counts.select("word", g.alias("g")).where(F.col("g") > float(need)).orderBy(F.desc("g"), "word").limit(most)
        chosen.update(dict.fromkeys(r["word"] for r in best.collect()))
    return list(chosen)


def fit_chain(labelled: DataFrame, categories: list[str], most: int = SAMPLE_DOCS) -> Chain:
    """Fit the chain on ``doc_id, text`` and one 0/1 column per category; rows with a null label are left out.

    Later models are trained with out-of-fold probabilities of the earlier categories, so they
    see inputs as unsure as those at prediction; equal texts share a fold. The cut for the last category is the one with
    the best F1 on its out-of-fold probabilities. The fit uses about ``most`` rows at most.
    """
    usable = labelled.select("doc_id", "text", *[F.col(c).cast("long").alias(c) for c in categories]).dropna(subset=categories)
    sample = bounded_sample(usable, F.col("doc_id"), most)
    small_batches(labelled.sparkSession)
    words = choose_words(sample, categories)
    place = {w: i for i, w in enumerate(words)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(at=[sorted(place[w] for w in words_of(t) & place.keys()) for t in pdf["text"]]).drop(columns="text")

    kinds = ", ".join(f"`{c}` long" for c in categories)
    rows = sample.withColumn("fold", F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(FOLDS)))
    data = rows.mapInPandas(run, f"doc_id {labelled.schema['doc_id'].dataType.simpleString()}, {kinds}, fold long, at array<int>").toPandas()
    data = data.sort_values(["doc_id", "fold"], kind="stable")
    # One matrix for all models: words, then a column for each earlier category's probability.
    x = np.zeros((len(data), len(words) + len(categories)), np.float32)
    for r, at in enumerate(data["at"]):
        x[r, np.asarray(at, int)] = 1
    fold, chain = data["fold"].to_numpy(), Chain(list(categories), words)
    for number, c in enumerate(categories):
        y, inputs = data[c].to_numpy(float), x[:, : len(words) + number]
        held = np.full(len(y), y.mean() if len(y) else 0.0)
        for k in range(FOLDS):
            rest, mine = fold != k, fold == k
            if mine.any() and rest.any():
                w, b = fit_logistic(inputs, y, counted=rest)
                held[mine] = sigmoid(inputs[mine] @ w.astype(np.float32) + b)
        w, b = fit_logistic(inputs, y) if len(y) else (np.zeros(inputs.shape[1]), -30.0)
        chain.weights.append(w)
        chain.biases.append(float(b))
        x[:, len(words) + number] = held
        chain.cut = best_cut(held, y)
    return chain


def score(docs: DataFrame, chain: Chain, reject_at: float | None = None) -> DataFrame:
    """Add ``p_<category>`` for each category and ``rejected`` (the last category's probability is at the chain's cut, or ``reject_at``, or more).

    Whole texts are scored; null and empty text have no words and get the base rates. All columns and rows of ``docs`` stay;
    columns of those names are replaced. A probability equal to the cut rejects. Without labelled rows nothing is rejected; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("array<double>")
    def predict(text: pd.Series) -> pd.Series:
        return pd.Series(list(cast.value.probabilities(text.tolist())))

    made = [f"p_{c}" for c in chain.categories]
    own = docs.select(*[c for c in docs.columns if c not in [*made, "rejected", "_gw_p"]])
    out = own.withColumn("_gw_p", predict("text"))
    for i, name in enumerate(made):
        out = out.withColumn(name, F.element_at("_gw_p", i + 1))
    return out.withColumn("rejected", F.col(made[-1]) >= (chain.cut if reject_at is None else reject_at)).drop("_gw_p")


CATEGORIES = ["low_quality", "toxic"]


def fit_on_tables(spark, sf_dir: str) -> Chain:
    """The production chain: low quality first, then toxic, from the tables ``documents`` and ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = labels.where("toxic IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max(1 - F.col("quality")).alias("low_quality"), F.max("toxic").alias("toxic"))
    sample = bounded_sample(known, F.col("doc_id"), SAMPLE_DOCS)
    return fit_chain(docs.join(F.broadcast(sample), "doc_id"), CATEGORIES)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit_on_tables(spark, sf_dir)).select("doc_id", "p_low_quality", "p_toxic", "rejected")
