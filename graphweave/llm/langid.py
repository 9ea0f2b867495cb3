"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import small_batches
from graphweave.llm.models import fit_logistic

#: Bounds of the fit: documents sampled per language and over all languages. Cells that hashed bigrams and trigrams share.
SAMPLE_PER_LANGUAGE = 600
SAMPLE_DOCS = 4800
CELLS = 1 << 13
UNKNOWN = "und"
AMBIGUOUS_UNDER = 0.2
_LETTER = regex.compile(r"\p{L}")
_JUNK = regex.compile(r"[^\p{L}\p{M}']+")


def features(text: str | None) -> np.ndarray | None:
    """Root of the share of every cell among the text's n-grams, or None for a text without a letter.

    Bytes of the lower-cased letters with one space between words; bigrams and trigrams hashed into cells.
    """
    if not text or not _LETTER.search(text):
        return None
    raw = np.frombuffer(_JUNK.sub(" ", f" {text.lower()} ").encode("utf-8", "replace"), np.uint8).astype(np.int64)
    two = raw[:-1] << 8 | raw[1:]
    three = two[:-1] << 8 | raw[2:]
    half = CELLS // 2
    cells = np.concatenate([(two * 40503 >> 4) % half, half + (three * 2654435761 >> 9) % half])
    return np.sqrt(np.bincount(cells, minlength=CELLS) / len(cells)).astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """A row of +1/-1 per class. Up to 7 classes: every split of the classes in two; more: pseudo-random
    splits, 16 bits per doubling of the classes, the same for the same k."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        return np.array([[1 if c == 0 or split >> (c - 1) & 1 else -1 for split in range((1 << (k - 1)) - 1)] for c in range(k)])
    rng = np.random.default_rng(k)
    return rng.choice([-1, 1], (k, 16 * int(np.ceil(np.log2(k)))))


@dataclass
class Coder:
    """Learned languages, their codewords, a linear classifier per bit and the bit's weight in the loss."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    biases: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Per row and class the weighted logistic loss of the class's codeword against the bits' margins."""
        margins = np.clip(x @ self.weights + self.biases, -20, 20)
        # log(1 + exp(-code * margin)) takes two values a bit; the codeword picks one.
        plus, minus = np.logaddexp(0, -margins) * self.trust, np.logaddexp(0, margins) * self.trust
        return (plus @ (self.codes > 0).T + minus @ (self.codes < 0).T) / self.trust.sum()

    def predict_all(self, texts: list[str | None], rows: int = 256) -> list[tuple[str, float, bool]]:
        """Language, score from 0 to 1 (share of exp(-loss) over all codewords) and whether the best two are close, some ``rows`` texts at a time.

        Of languages with equal loss the first by name is taken.
        """
        out = [(UNKNOWN, 0.0, True)] * len(texts)
        for at in range(0, len(texts) if self.languages else 0, rows):
            found = [(i, x) for i, t in enumerate(texts[at : at + rows], at) if (x := features(t)) is not None]
            if not found:
                continue
            loss = self.losses(np.stack([x for _, x in found]))
            share = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
            share /= share.sum(axis=1, keepdims=True)
            first = loss.argmin(axis=1)
            top = np.sort(share, axis=1)
            second = top[:, -2] if top.shape[1] > 1 else np.zeros(len(top))
            for (i, _), c, best, next_ in zip(found, first.tolist(), top[:, -1].tolist(), second.tolist()):
                out[i] = self.languages[c], best, best - next_ < AMBIGUOUS_UNDER
        return out

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        return self.predict_all([text])[0]


def fit_coder(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Coder:
    """Fit on ``doc_id, text, lang``, about ``per_language`` rows of each language and SAMPLE_DOCS in all at most; null lang rows are left out.

    The rate of each language comes from its count over all rows; rows are then chosen by hash.
    """
    known = labelled.where(F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    share = min(per_language, SAMPLE_DOCS / max(1, len(counts)))
    rates = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, int((1 << 30) * min(1.0, share / n)))]) if counts else F.create_map(F.lit(""), F.lit(0))
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < rates[F.col("lang")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "x": [None if v is None else v.tobytes() for v in x]}).dropna(subset="x")

    kind = labelled.schema["doc_id"].dataType.simpleString()
    data = sample.select("doc_id", "text", "lang").mapInPandas(run, f"doc_id {kind}, lang string, x binary").toPandas().sort_values(["lang", "doc_id"])
    languages = sorted(set(data["lang"]))
    codes = codewords(len(languages))
    x = np.stack([np.frombuffer(v, np.float32) for v in data["x"]]) if len(data) else np.zeros((0, CELLS), np.float32)
    at = data["lang"].map({c: i for i, c in enumerate(languages)}).to_numpy(int)
    weights, biases, trust = [], [], []
    for bit in codes.T:
        y = (bit[at] > 0).astype(float)
        w, b = fit_logistic(x, y, 1e-5, 60, 2.0) if len(y) else (np.zeros(CELLS), 0.0)
        weights.append(w)
        biases.append(b)
        trust.append(max(0.05, 2 * np.mean(((x @ w + b) > 0) == (y > 0.5)) - 1) if len(y) else 1.0)
    return Coder(languages, codes, np.array(weights).reshape(-1, CELLS).T.astype(np.float32), np.array(biases), np.array(trust))


def identify(docs: DataFrame, coder: Coder) -> DataFrame:
    """Add ``lang_pred, score, ambiguous`` from whole texts.

    ``und`` (score 0, ambiguous) for null text or text without a letter. All other columns and rows stay, repeated ones too;
    columns of those names are replaced; no rows give no rows.
    """
    small_batches(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(coder)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(cast.value.predict_all(text.tolist()), columns=["lang_pred", "score", "ambiguous"])

    made = ["lang_pred", "score", "ambiguous"]
    own = docs.select(*[c for c in docs.columns if c not in [*made, "_gw_found"]])
    return own.withColumn("_gw_found", predict("text")).select("*", *[F.col(f"_gw_found.{c}") for c in made]).drop("_gw_found")


def query(spark, sf_dir: str) -> DataFrame:
    """Learns from documents with crc32(doc_id) mod 4 other than 2; a null doc_id neither teaches nor is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2
    coder = fit_coder(docs.where(~held))
    out = identify(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), coder)
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
