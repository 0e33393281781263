"""Operator 8, language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import map_arrow, table

#: Length of subwords in bytes, and hash buckets of each length.
GRAMS, BITS = (2, 3, 4), 16
DIMENSIONS = 16
#: Bounds of the training sample: languages (the most frequent), rows of a language, rows in all, bytes of a text.
LANGUAGES, ROWS_EACH, ROWS_ALL, TEXT_BYTES = 256, 500, 4000, 20_000
EPOCHS, RATE, BATCH, VALIDATION = 6, 1.0, 64, 5
#: Share of right validation predictions that calibrated rejection may turn away.
REJECTED = 0.01
UNKNOWN = "und"

_ASCII = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_PIECE = 1 << 20


def _clean(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the end): lower case, ASCII other than letters blank, blanks between."""
    raw = [b" " + (t or "").lower().encode().translate(_ASCII) + b"   " for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def _buckets(buf: np.ndarray) -> Iterator[np.ndarray]:
    """For each length the bucket of the subword that begins at each place but the last three."""
    n, value = len(buf) - max(GRAMS) + 1, np.zeros(len(buf) - max(GRAMS) + 1, np.uint32)
    for k in range(max(GRAMS)):
        value = (value << np.uint32(8)) | buf[k : k + n]
        if k + 1 in GRAMS:
            region = GRAMS.index(k + 1) << BITS
            yield ((value * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64) + region


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Whole texts, in pieces of some MB; embeddings are averaged over all subwords of a text, none of which reaches into the next."""
        buf, at = _clean(texts)
        last = max(GRAMS) - 1
        few = len(self.languages) <= DIMENSIONS
        lookup = self.embedding @ self.weights if few else self.embedding
        total, places = np.zeros((len(texts), lookup.shape[1])), np.diff(at) - last
        ends = (at[1:, None] - np.arange(1, last + 1)).reshape(-1)  # places of subwords that would
        end = len(buf) - max(GRAMS) + 1
        for a in range(0, end, _PIECE):
            b = min(a + _PIECE, end)
            part = sum(lookup[i] for i in _buckets(buf[a : b + last]))
            part[ends[(ends >= a) & (ends < b)] - a] = 0
            lo, hi = np.searchsorted(at, a, "right") - 1, np.searchsorted(at, b, "left")
            starts = np.maximum(at[lo:hi], a) - a
            total[lo:hi] += np.add.reduceat(part, starts, axis=0, dtype=np.float64)
        mean = total / (places * len(GRAMS))[:, None]
        return (mean if few else mean @ self.weights) + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, calibrated probability); unknown with 0 where a text is null or has no letter (number signs aren't)."""
        if not texts:
            return [], np.empty(0)
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        said = [any(map(str.isalpha, t or "")) for t in texts]  # letters are the Unicode categories L
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, said, strict=True)], np.where(said, p.max(axis=1), 0.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent on whole texts; every fifth text calibrates the temperature and the rejection."""
    names = sorted(set(langs))
    y = np.searchsorted(names, langs)
    rng = np.random.default_rng(seed)
    d = DIMENSIONS
    model = Model(names, rng.normal(0, 0.1, (len(GRAMS) << BITS, d)).astype(np.float32), np.zeros((d, len(names)), np.float32), np.zeros(len(names), np.float32))
    model.weights += rng.normal(0, 0.3, model.weights.shape).astype(np.float32)
    check = np.arange(len(texts)) % VALIDATION == VALIDATION - 1
    bags = []
    for t in texts:
        buf, _ = _clean([t])
        ids, n = np.unique(np.concatenate(list(_buckets(buf))), return_counts=True)
        bags.append((ids, (n / n.sum()).astype(np.float32)))
    learn = np.flatnonzero(~check)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        rng.shuffle(learn)
        for a in range(0, len(learn), BATCH):
            rows = learn[a : a + BATCH]
            ids, share = (np.concatenate([bags[r][k] for r in rows]) for k in (0, 1))
            owner = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
            starts = np.searchsorted(owner, np.arange(len(rows)))
            mean = np.add.reduceat(model.embedding[ids] * share[:, None], starts, axis=0)
            error = _softmax(mean @ model.weights + model.bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            back = error @ model.weights.T
            model.weights -= rate * (mean.T @ error) / len(rows)
            model.bias -= rate * error.mean(axis=0)
            # subwords are rare: each text moves its own embeddings by the whole rate
            np.add.at(model.embedding, ids, -rate * 20 * share[:, None] * back[owner])
    held = np.flatnonzero(check) if check.any() else np.arange(len(texts))
    logits = model.logits([texts[i] for i in held])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
    model.threshold = float(np.quantile(right, REJECTED)) if len(right) else 0.0
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from a bounded sample of the labelled rows that aren't held out; None where there are none.

    Sampled are, by a hash of the id, about ROWS_EACH rows of each of the LANGUAGES most frequent languages, but
    about ROWS_ALL in all, of texts with a letter. They are texts of at most TEXT_BYTES bytes, each read whole; only a
    language without any such text is learned from the first TEXT_BYTES characters of its longer ones.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & ~held_out(id_col) & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("train"), id_col).alias("h"), (F.octet_length(text_col) > TEXT_BYTES).alias("long"))
    counts = rows.groupBy("lang").agg(F.count_if(~F.col("long")).alias("short"), F.count("*").alias("all"))
    counts = counts.select("lang", (F.col("short") == 0).alias("only_long"), F.when(F.col("short") > 0, F.col("short")).otherwise(F.col("all")).alias("count")).orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    each = min(ROWS_EACH, ROWS_ALL // len(counts))
    rate = docs.sparkSession.createDataFrame([(r["lang"], r["only_long"], min(1.0, each / r["count"])) for r in counts], "lang string, long boolean, rate double")
    rows = rows.withColumn("text", F.substring("text", 1, TEXT_BYTES))  # of texts that aren't long, the whole
    sample = rows.join(F.broadcast(rate), ["lang", "long"]).filter(F.col("h") / float(1 << 64) + 0.5 < F.col("rate")).select("h", "text", "lang").collect()
    sample.sort(key=lambda r: (r["h"], r["lang"], r["text"]))
    if not sample:  # a tiny table whose few rows all fell out of the sample
        sample = rows.join(F.broadcast(rate), ["lang", "long"]).select("h", "text", "lang").orderBy("h").limit(each).collect()
    return train([r["text"] for r in sample], [r["lang"] for r in sample])


def language_id(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs, in one pass without a shuffle.

    score is the calibrated probability of lang_pred; rejected tells that it is below the calibrated threshold.
    Null texts and texts without a letter are `und` with score 0 and rejected, and so is everything without a model
    (no labelled rows). Whole texts are read. Repeated rows are predicted alike; null ids stay; other columns, lang
    and source among them, are ignored. The model sent to the workers has a fixed size.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = b.column(2).to_pylist()
            langs, score = m.predict(texts) if m else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            low = score < m.threshold if m else np.ones(len(texts), bool)
            unknown = np.array([x == UNKNOWN for x in langs], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(low | unknown)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", deal=True)
    return language_id(docs, fit(docs))
