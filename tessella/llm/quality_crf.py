"""Quality classifier: a linear-chain CRF labels every line good or bad.

A line's features come from itself and from its neighbours; forward-backward marginals of
"good", weighted by line length, add up to the document's quality, which a two-parameter
logistic curve maps to a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessella.llm._base import checkpointed, small_batches, text_or_empty, trimmed

#: Bounds of the labelled sample that the model is fitted on. Everything else covers all rows.
MAX_TRAIN_DOCS = 4000
MAX_TRAIN_CHARS = 60_000
MAX_TRAIN_LINES = 200_000
THRESHOLD = 0.3
_MARKS = "!?|#$%&*<>{}[]=+_~^@\\/"


def line_features(line: str) -> list[float]:
    n = len(line)
    words = line.split()
    if not words:
        return [1.0, 0.0, float(n > 0), *[0.0] * 12]
    k = len(words)
    distinct = len(set(words))
    bars = line.count("|")
    bangs = line.count("!")
    marks = sum(map(line.count, _MARKS))
    upper = sum(map(str.isupper, words)) / k
    echo = sum(map(eq, words, words[1:])) / k
    digits = sum(map(line.count, "0123456789"))
    stops = line.count(". ") + line.endswith(".") + line.count("? ") + line.count("! ")
    commas = line.count(",")
    return [
        1.0,
        min(np.log1p(k), 8.0) / 4,
        0.0,
        1.0 - distinct / k,
        float(distinct / k < 0.35 and k > 5),
        upper,
        float(upper > 0.5),
        min(marks / k, 2.0),
        float(marks > 0.4 * k),
        min(bars / k, 1.0),
        min(bangs / k, 1.0),
        min(digits / n * 5, 2.0),
        min((stops + commas) / k * 4, 2.0),
        min(n / k / 10, 3.0),
        echo,
    ]


N_OWN = 15


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line with its neighbours', line lengths); empty text is one empty line."""
    lines = text.split("\n")
    own = np.array([line_features(x) for x in lines])
    around = np.zeros((len(lines), 2 * (N_OWN - 1)))
    around[1:, : N_OWN - 1] = own[:-1, 1:]
    around[:-1, N_OWN - 1 :] = own[1:, 1:]
    return np.hstack([own, around]), np.array([max(len(x), 1) for x in lines], dtype=float)


def _chain(scores: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward of one chain of two labels: marginals of label 1, summed pair marginals, log partition."""
    n = len(scores)
    shift = scores.max(axis=1, keepdims=True)
    emit, step = np.exp(scores - shift), np.exp(move)
    alpha, beta, scale = np.empty((n, 2)), np.empty((n, 2)), np.empty(n)
    a0, a1 = emit[0]
    (m00, m01), (m10, m11) = step.tolist()
    e = emit.tolist()
    for t in range(n):
        if t:
            a0, a1 = (a0 * m00 + a1 * m10) * e[t][0], (a0 * m01 + a1 * m11) * e[t][1]
        z = a0 + a1
        a0, a1 = a0 / z, a1 / z
        alpha[t] = a0, a1
        scale[t] = z
    b0 = b1 = 1.0
    beta[n - 1] = 1.0, 1.0
    for t in range(n - 2, -1, -1):
        x0, x1 = e[t + 1][0] * b0, e[t + 1][1] * b1
        b0, b1 = (m00 * x0 + m01 * x1) / scale[t + 1], (m10 * x0 + m11 * x1) / scale[t + 1]
        beta[t] = b0, b1
    both = alpha * beta
    marginal = both[:, 1] / both.sum(axis=1)
    pairs = np.zeros((2, 2))
    if n > 1:
        p = alpha[:-1, :, None] * step[None] * (emit[1:] * beta[1:] / scale[1:, None])[:, None, :]
        pairs = (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return marginal, pairs, float(np.log(scale).sum() + shift.sum())


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 12, decay: float = 1e-3) -> dict:
    """Fit weights by Adam on the conditional likelihood of each document's label on all its lines, then the curve over scores."""
    width = 3 * N_OWN - 2
    w, move = np.zeros(width), np.zeros((2, 2))
    if not docs:
        return {"w": w, "move": move, "curve": (0.0, 0.0)}
    weight = {y: len(docs) / (2 * max(1, sum(d[2] == y for d in docs))) for y in (0, 1)}
    rng = np.random.default_rng(7)
    state = np.zeros((2, width + 4))
    turn = 0
    for _ in range(rounds):
        for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 256)):
            turn += 1
            g, gm, total = decay * w, decay * move, sum(weight[docs[i][2]] for i in batch)
            for i in batch:
                x, _, y = docs[i]
                s = x @ w
                p, pairs, _ = _chain(np.column_stack([np.zeros(len(s)), s]), move)
                true = np.zeros((2, 2))
                true[y, y] = len(s) - 1
                c = weight[y] / total / len(s)
                g = g + c * (x.T @ (p - y))
                gm = gm + c * (pairs - true)
            grad = np.concatenate([g, gm.ravel()])
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.99 * state[1] + 0.01 * grad**2
            delta = 0.05 * (state[0] / (1 - 0.9**turn)) / (np.sqrt(state[1] / (1 - 0.99**turn)) + 1e-8)
            w, move = w - delta[:width], np.clip(move - delta[width:].reshape(2, 2), -2, 2)
    model = {"w": w, "move": move, "curve": (1.0, 0.0)}
    raw = np.array([_logit(_mean(x, n, model)) for x, n, _ in docs])
    y = np.array([d[2] for d in docs], dtype=float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-(a * raw + b)))
        r, v = p - y, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[np.sum(v * raw * raw) + 1.0, np.sum(v * raw)], [np.sum(v * raw), np.sum(v) + 1.0]])
        da, db = np.linalg.solve(h, [np.sum(r * raw) + a - 1.0, np.sum(r) + b])
        a, b = max(a - da, 0.05), b - db
    return model | {"curve": (float(a), float(b))}


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _mean(x: np.ndarray, lengths: np.ndarray, model: dict) -> float:
    s = x @ model["w"]
    p, _, _ = _chain(np.column_stack([np.zeros(len(s)), s]), model["move"])
    return float((p * lengths).sum() / lengths.sum())


def score_text(text: str | None, model: dict) -> float:
    a, b = model["curve"]
    return float(1 / (1 + np.exp(-(a * _logit(_mean(*document_features(text or ""), model)) + b))))


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS, max_lines: int = MAX_TRAIN_LINES) -> dict:
    """Fit on labelled rows whose crc32(id) mod 5 is not 0; of more than max_docs, the ones of least hash.

    Texts of over max_chars are left out of the fit, and in the order of their hash so are those
    from where max_lines lines are reached, so that what the driver holds is bounded (172 bytes a
    line, 34 MB); they are scored like all others. Of rows repeated with one id, one teaches; rows
    without an id, a text or a label teach nothing. Without any row to learn from, every score is
    0.5.
    """
    small_batches(docs.sparkSession)
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    y = y.groupBy("id").agg(F.min("y").alias("y"))
    chosen = y.orderBy(F.xxhash64("id"), "id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(chosen), "id")  # max_docs rows of an id and a label
    rows = checkpointed(rows.groupBy("id").agg(F.min("y").alias("y"), F.min("text").alias("text")))
    lines = F.size(F.split("text", "\n", -1))
    before = F.sum("lines").over(Window.orderBy(F.xxhash64("id"), "id"))  # max_docs rows of an id and a number
    kept = rows.select("id", lines.alias("lines")).withColumn("lines", before).where(F.col("lines") <= max_lines).select("id")
    rows = rows.join(F.broadcast(kept), "id")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType()), T.StructField("n", T.BinaryType())])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [document_features(t) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "x": [x.astype("f4").tobytes() for x, _ in made], "n": [n.astype("f4").tobytes() for _, n in made]})

    got = sorted(rows.select("id", "y", "text").mapInPandas(trimmed(features), schema).collect(), key=lambda r: r["id"])
    read = [(np.frombuffer(r["x"], "f4").reshape(-1, 3 * N_OWN - 2).astype(float), np.frombuffer(r["n"], "f4").astype(float), r["y"]) for r in got]
    return fit(read)


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, lines, good_lines.

    Null text is scored as empty; null ids are scored too (held_out is false). Repeated rows get
    the same score, an empty table none. Labels, language, source and id are no inputs.
    """
    small_batches(docs.sparkSession)
    schema = "id string, score double, lines long, good_lines long"
    a, b = model["curve"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                x, n = document_features(text)
                s = x @ model["w"]
                p, _, _ = _chain(np.column_stack([np.zeros(len(s)), s]), model["move"])
                m = _logit(float((p * n).sum() / n.sum()))
                out.append((1 / (1 + np.exp(-(a * m + b))), len(p), int((p >= 0.5).sum())))
            yield pd.DataFrame({"id": batch["id"], "score": [r[0] for r in out], "lines": [r[1] for r in out], "good_lines": [r[2] for r in out]})

    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text")).mapInPandas(trimmed(run), schema)
    fold = F.crc32(F.col("id").cast("binary")) % 5
    return rows.select(F.col("id").cast(kind).alias(id_col), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "lines", "good_lines")


def keep_good(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns; scored in place, without a join."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(t, model) for t in texts], dtype="float64")

    return docs.where(score(text_or_empty(text_col)) >= threshold)
