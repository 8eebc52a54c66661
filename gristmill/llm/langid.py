"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is cut into windows of 256 bytes, the last one filled up with zeros. Each byte has a learned vector; filters of
several widths slide over the window (as one matrix product, narrower filters having zero weights at the far end), max
pooling keeps each filter's strongest answer, and a softmax layer gives the languages' probabilities. A document has
the mean over all its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.tokens import blocks, column_bytes

WINDOW, DIM, FILTERS = 256, 6, {2: 8, 3: 12, 4: 12}
WIDEST = max(FILTERS)
#: At most so many rows of each language are learned from, those with the smallest hash of doc_id.
PER_LANGUAGE = 240
_SPAN = WINDOW - WIDEST + 1


@dataclass
class Model:
    """languages: sorted; empty if there was nothing to learn from."""

    languages: list[str]
    vectors: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDEST * DIM x filters
    bias: np.ndarray
    weights: np.ndarray  # filters x languages
    prior: np.ndarray


def windows(data: bytes | np.ndarray) -> np.ndarray:
    """Zero-filled windows of all bytes, at least one; uint8 (n, WINDOW)."""
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    out = np.zeros((max(1, -(-len(raw) // WINDOW)), WINDOW), np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    return out


def _patches(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(n * _SPAN, WIDEST * DIM): what the filters see at each place."""
    flat = np.ascontiguousarray(vectors[rows].reshape(len(rows), -1))
    view = np.lib.stride_tricks.as_strided(flat, (len(rows), _SPAN, WIDEST * DIM), (flat.strides[0], DIM * flat.itemsize, flat.itemsize))
    return view.reshape(-1, WIDEST * DIM)


def _mask() -> np.ndarray:
    """Which weights of the joint filter matrix exist."""
    return np.concatenate([np.repeat((np.arange(WIDEST * DIM) < w * DIM)[:, None], n, 1) for w, n in FILTERS.items()], 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def predict(model: Model, rows: np.ndarray, at_once: int = 256) -> np.ndarray:
    """Probabilities (n, languages) of windows."""
    out = np.empty((len(rows), len(model.languages)), np.float32)
    for i in range(0, len(rows), at_once):
        part = rows[i : i + at_once]
        seen = (_patches(model.vectors, part) @ model.filters).reshape(len(part), _SPAN, -1).max(1)
        out[i : i + at_once] = _softmax(np.maximum(seen + model.bias, 0) @ model.weights + model.prior)
    return out


def train(texts: list[bytes], labels: list[str], epochs: int = 4, at_once: int = 64, rate: float = 0.004, seed: int = 7) -> Model:
    """Adam on the cross-entropy of windows. Ends with a model without languages if there are no labels."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    kinds = sum(FILTERS.values())
    mask = _mask()
    p = {
        "vectors": rng.normal(0, 0.5, (256, DIM)),
        "filters": rng.normal(0, 1, mask.shape) * mask / np.sqrt(mask.sum(0)),
        "bias": np.zeros(kinds),
        "weights": rng.normal(0, 0.2, (kinds, max(1, len(languages)))),
        "prior": np.zeros(max(1, len(languages))),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    if len(languages) < 2:
        return Model(languages, **p)
    # every third text also in capitals, so that case doesn't tell languages apart
    texts, labels = texts + [x.decode("utf-8", "replace").upper().encode() for x in texts[::3]], labels + labels[::3]
    cut = [windows(x) for x in texts]
    x = np.concatenate(cut)
    y = np.repeat([languages.index(v) for v in labels], [len(c) for c in cut])
    # each language weighs the same, however many windows it has
    weight = (len(y) / len(languages) / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in "mv")
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), at_once):
            rows = x[order[i : i + at_once]]
            n = len(rows)
            seen = _patches(p["vectors"], rows)
            made = (seen @ p["filters"]).reshape(n, _SPAN, kinds)
            best = made.argmax(1)
            pooled = np.take_along_axis(made, best[:, None], 1)[:, 0] + p["bias"]
            kept = np.maximum(pooled, 0)
            d = _softmax(kept @ p["weights"] + p["prior"])
            d[np.arange(n), y[order[i : i + at_once]]] -= 1
            d *= weight[order[i : i + at_once], None] / n
            up = (d @ p["weights"].T) * (pooled > 0)
            patch = seen.reshape(n, _SPAN, -1)[np.arange(n)[:, None], best]  # n x kinds x WIDEST * DIM
            down = up[:, :, None] * p["filters"].T  # to the patches
            d_vectors = np.zeros_like(p["vectors"])
            places = np.minimum(best[:, :, None] + np.arange(WIDEST), WINDOW - 1)
            np.add.at(d_vectors, rows[np.arange(n)[:, None, None], places].reshape(-1), down.reshape(-1, DIM))
            g = {"vectors": d_vectors, "filters": np.einsum("nk,nkd->dk", up, patch) * mask, "bias": up.sum(0), "weights": kept.T @ d, "prior": d.sum(0)}
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return Model(languages, **{k: a.astype(np.float32) for k, a in p.items()})


def fit(docs: DataFrame, of: Column, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from text and lang of the rows where `of` holds and neither is null or doc_id null.

    A bounded sample of rows: for each language the `per_language` ones with the smallest hash of doc_id, their whole texts.
    Ids are chosen in a pass over doc_id and lang alone (each task keeps its own smallest before the shuffle); only the
    chosen texts are read. Of rows with one doc_id and language the smallest text counts. Other columns are not read.
    """
    known = docs.where(of & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id")), "doc_id"))
    ids = known.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= per_language)
    chosen = [r[0] for r in ids.select("doc_id").distinct().collect()]
    if not chosen:
        return train([], [])
    rows = sorted(known.where(F.col("doc_id").isin(chosen)).groupBy("doc_id", "lang").agg(F.min(F.encode("text", "utf-8")).alias("raw")).collect())
    return train([bytes(r["raw"]) for r in rows], [r["lang"] for r in rows])


def _has_letter(data: np.ndarray, text: pa.Scalar) -> bool:
    if ((data | 32) - 97 < 26).any():
        return True
    return bool((data > 127).any()) and any(map(str.isalpha, text.as_py()))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text.

    `und` with score 0 where the text is null or has no letter, or where nothing was learned. A model of one language
    gives that one with score 1. Equal texts get equal answers, whatever rows they stand in; ties go to the first language
    in order. Texts of any length are read in full; a null doc_id stays null. Other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in blocks(batches, "text", 1 << 20):
            data, offs = column_bytes(batch.column(1))
            sizes = np.diff(offs)
            counts = np.maximum(1, -(-sizes // WINDOW))
            first = np.concatenate([[0], np.cumsum(counts)])
            rows = np.zeros((first[-1], WINDOW), np.uint8)
            # every row's bytes begin at a window's start
            to = np.repeat(first[:-1] * WINDOW - offs[:-1], sizes) + np.arange(len(data))
            rows.reshape(-1)[to] = data
            letter = np.array([_has_letter(data[a:b], t) for a, b, t in zip(offs[:-1], offs[1:], batch.column(1), strict=True)], bool)
            if len(net.languages) > 1:
                used = np.full(first[-1], WINDOW, np.float64)
                used[first[1:] - 1] = sizes - (counts - 1) * WINDOW
                sums = np.add.reduceat(predict(net, rows) * used[:, None], first[:-1], 0)
                mean = np.round(sums / np.maximum(sizes, 1)[:, None], 5)
                best = mean.argmax(1)
                names, score = np.array(net.languages, object)[best], mean[np.arange(len(best)), best]
            else:
                names, score = np.full(batch.num_rows, net.languages[0] if net.languages else "und", object), np.full(batch.num_rows, float(len(net.languages)))
            names[~letter], score[~letter] = "und", 0.0
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
