"""Language identification: multinomial logistic regression on TF-IDF of hashed character n-grams.

Training (once per call, deterministic):
1. document frequencies of all n-gram buckets over every learning row (a fixed-size array per task, summed);
2. a bounded sample of ``sample_per_class`` learning rows a language, lowest hashes first, as sparse features;
3. follow-the-regularised-leader (FTRL-Proximal) with L1 and L2 penalties, one row at a time;
4. a temperature that minimises the log loss of a part of the sample kept out of step 3.
Prediction reads whole texts, one Arrow batch at a time, without a shuffle; the model is a table of 2^16 buckets.

Term frequency is the share of a bucket among a text's n-grams, so a long text costs one table look-up a character
and needs no sort.

Edge cases: a null text and one without a letter get ``und`` with score 0; equal probabilities go to the smallest
language name; without a single learning row every text is ``und``; repeated rows count as often as they occur;
extra columns are carried through unless they clash with an output name, in which case the output wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.text_arrays import steps
from quern.plans.shared import ship_package

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Characters of a text that are taken at once.
LONG = 1 << 20
#: Odd multipliers of the n-gram hash.
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
UND = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def buckets(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ends of each text (padded by one blank on either side) and, for each order, the bucket of the n-gram ending at each place."""
    padded = [f" {t.lower()} " for t in texts]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(sizes)
    return ends, _gram_buckets("".join(padded), ends - sizes)


def pieces(text: str, size: int) -> Iterator[list[np.ndarray]]:
    """What buckets() finds in one text, a stretch of ``size`` places at a time."""
    padded, reach = f" {text.lower()} ", max(ORDERS) - 1
    for a in range(0, len(padded), size):
        before = min(a, reach)
        yield [ids[before:] for ids in _gram_buckets(padded[a - before : a + size], np.zeros(1, np.int64))]


def _gram_buckets(joined: str, starts: np.ndarray) -> list[np.ndarray]:
    """Blanks stand before every start, whatever text is laid before it; texts have two places or more."""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found, mixed = [], np.zeros(len(points), np.uint32)
    for k in range(max(ORDERS)):
        shifted = points if k == 0 else np.concatenate([np.full(k, 32, np.uint32), points[:-k]])
        for j in range(k):
            shifted[starts + j] = 32
        mixed = (mixed ^ shifted) * np.uint32(MIX[k % 3]) + np.uint32(k)
        if k + 1 in ORDERS:
            found.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(MIX[2]) >> np.uint32(16)).astype(np.int32))
    return found


def sparse_features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF values of one text."""
    counts = sum(np.bincount(ids, minlength=BUCKETS) for found in pieces(text, LONG) for ids in found)
    ids = np.flatnonzero(counts)
    counts = counts[ids]
    return ids, counts / counts.sum() * idf[ids] * SCALE


#: Brings term shares near 1, so that the penalties and the learning rate are of a usual size.
SCALE = 30.0


class Ftrl:
    """FTRL-Proximal for multinomial logistic regression with elastic-net penalties."""

    def __init__(self, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, ids: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, ids: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(ids)
        p = softmax(values @ w)
        p[label] -= 1.0
        g = values[:, None] * p[None, :]
        n = self.n[ids]
        grown = n + g * g
        self.z[ids] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = grown


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Golden-section search for the temperature of least log loss."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    lo, hi, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    for _ in range(40):
        if loss(a) <= loss(b):
            hi, b = b, a
            a = hi - r * (hi - lo)
        else:
            lo, a = a, b
            b = lo + r * (hi - lo)
    return float(np.exp((lo + hi) / 2))


class LanguageModel:
    """Languages, the bucket table (TF-IDF weight times class weight) and the temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, temperature: float):
        self.languages, self.table, self.temperature = languages, table, temperature

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = np.array([has_letter(t) for t in texts], bool) & bool(self.languages)
        langs, scores = [UND] * len(texts), np.zeros(len(texts))
        rows = np.array([i for i in np.flatnonzero(known) if len(texts[i]) <= LONG], np.int64)
        for i in np.flatnonzero(known):
            if len(texts[i]) > LONG:
                z = sum(np.array([[t[ids].sum(dtype=np.float64) for t in self.table] for ids in found]).sum(0) for found in pieces(texts[i], LONG))
                p = softmax(z * SCALE / (len(ORDERS) * (len(texts[i].lower()) + 2)) / self.temperature)
                langs[i], scores[i] = self.languages[int(p.argmax())], p.max()
        if len(rows):
            ends, found = buckets([texts[i] for i in rows])
            starts = np.concatenate([[0], ends[:-1]])
            logits = np.zeros((len(rows), len(self.languages)))
            for ids in found:
                for c in range(len(self.languages)):
                    logits[:, c] += np.add.reduceat(self.table[c][ids], starts, dtype=np.float64)
            logits *= SCALE / (len(found) * (ends - starts))[:, None]
            p = softmax(logits / self.temperature)
            best = p.argmax(1)
            for k, i in enumerate(rows):
                langs[i] = self.languages[best[k]]
            scores[rows] = p[np.arange(len(rows)), best]
        return langs, scores


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Rows that hold each bucket, and rows; each task sends one fixed-size array of sums."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        seen = np.zeros(BUCKETS, bool)
        for batch in batches:
            for part in steps(batch, text_col):
                texts = [t or "" for t in part.column(text_col).to_pylist()]
                if len(texts) == 1 and len(texts[0]) > LONG:
                    seen[:] = False
                    for found in pieces(texts[0], LONG):
                        seen[np.concatenate(found)] = True
                    total[:-1] += seen
                    total[-1] += 1
                    continue
                ends, found = buckets(texts)
                for a, b in zip([0, *ends[:-1]], ends):
                    seen[:] = False
                    for ids in found:
                        seen[ids[a:b]] = True
                    total[:-1] += seen
                total[-1] += len(texts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    sums = docs.select(text_col).mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS + 1)
    total[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return total[:-1], int(total[-1])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_per_class: int = 1000, epochs: int = 3) -> LanguageModel:
    """Learns from the rows of docs with a non-null language; at most sample_per_class of each are fitted."""
    ship_package(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((0, BUCKETS), np.float32), 1.0)
    df, total = document_frequencies(rows, "text")
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    # hashes are even, so the lowest share of them holds about the bound; the exact bound is cut after
    share = F.lit(2.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(2.0, 1.2 * sample_per_class / counts[lang] + 20 / counts[lang]))).otherwise(share)
    chosen = rows.filter((F.col("h") / F.lit(2.0**64) + 0.5) < share)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("h", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("values", T.BinaryType())])

    def featurise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [sparse_features(t or "", idf) for t in frame["text"]]
            yield pd.DataFrame({"lang": frame["lang"], "h": frame["h"], "ids": [i.astype("<i4").tobytes() for i, _ in made], "values": [v.astype("<f4").tobytes() for _, v in made]})

    sample = chosen.mapInPandas(featurise, schema).toPandas().sort_values(["lang", "h", "ids"], kind="stable")
    sample = sample[sample.groupby("lang").cumcount() < sample_per_class].sort_values(["h", "lang", "ids"], kind="stable")
    xs = [(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4").astype(float)) for i, v in zip(sample["ids"], sample["values"])]
    ys = np.array([languages.index(x) for x in sample["lang"]])
    apart = np.arange(len(ys)) % 5 == 4
    model = Ftrl(len(languages))
    for _ in range(epochs):
        for k in np.flatnonzero(~apart):
            model.update(*xs[k], ys[k])
    w = model.weights()
    logits = np.array([v @ w[i] for i, v in (xs[k] for k in np.flatnonzero(apart))]).reshape(-1, len(languages))
    return LanguageModel(languages, np.ascontiguousarray((w * idf[:, None]).T.astype(np.float32)), fit_temperature(logits, ys[apart]))


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language and its calibrated probability."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)  # 2^16 floats a language
    docs = docs.select(*[docs[c] for c in docs.columns if c not in (lang_col, score_col)])
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_col, T.StringType(), False), T.StructField(score_col, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, text_col):
                langs, scores = sent.value.predict(part.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)
