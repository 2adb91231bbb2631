"""Document quality from bytes: a small convolutional network in numpy.

Bytes are looked up in a learned table, learned filters slide over the whole
document, and their answers are max-pooled over chunks that overlap by a filter's
width. The mean and the maximum over a document's chunks are combined into one
probability. Training runs in one task on a bounded sample of labelled documents;
scoring covers every byte of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridemetrics.llm.common import NULL_ID, joined_utf8, keyed, public_id, utf8_slices

#: Width of a byte's vector, bytes from one filter place to the next; a filter spans two steps.
BYTE_WIDTH = 8
STEP = 4
FILTERS = 24
#: Filter places in a chunk.
CHUNK = 128
#: Labelled documents learnt from at most, and bytes of them.
MOST_TRAINING = 6000
MOST_TRAINING_BYTES = 24 << 20
UPDATES = 500
BATCH = 48
SEED = 42
FOLDS = 5
THRESHOLD = 0.3

Model = dict[str, np.ndarray]


def new_model(seed: int = SEED) -> Model:
    r = np.random.default_rng(seed)
    span = STEP * BYTE_WIDTH
    return {
        "table": (r.normal(size=(257, BYTE_WIDTH)) * 0.5).astype(np.float32),
        "near": (r.normal(size=(span, FILTERS)) * np.sqrt(1 / span)).astype(np.float32),
        "far": (r.normal(size=(span, FILTERS)) * np.sqrt(1 / span)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": np.zeros(2 * FILTERS, np.float32),
        "offset": np.zeros(1, np.float32),
    }


class Layout:
    """Texts as one row of symbols, each padded to whole steps, and their chunks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        lengths = np.diff(offsets)
        # One step of padding more, so that the last filter place is whole.
        steps = np.maximum(1, -(-lengths // STEP)) + 1
        ends = np.cumsum(steps)
        self.symbols = np.full(int(ends[-1]) * STEP, 256, np.int16)
        begin = (ends - steps) * STEP
        at = np.arange(int(offsets[-1])) + np.repeat(begin - offsets[:-1], lengths)
        self.symbols[at] = data
        # A document has a place less than it has steps; the place over two documents is in no chunk.
        places = steps - 1
        chunks = -(-places // CHUNK)
        first = np.repeat(ends - steps, chunks)
        nth = np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        self.start = first + nth * CHUNK
        self.stop = np.minimum(self.start + CHUNK, np.repeat(ends - 1, chunks))
        self.doc_first = np.cumsum(chunks) - chunks
        self.chunks = chunks


def filter_answers(model: Model, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    blocks = model["table"][layout.symbols].reshape(-1, STEP * BYTE_WIDTH)
    answers = blocks[:-1] @ model["near"]
    answers += blocks[1:] @ model["far"]
    return answers, blocks


def pooled(model: Model, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each document; the pooled answers; the symbols' vectors."""
    answers, blocks = filter_answers(model, layout)
    cuts = np.stack([layout.start, layout.stop], axis=1).reshape(-1)
    # The last stop may be the end of the array, which reduceat does not take.
    answers = np.concatenate([answers, np.full((1, FILTERS), -np.inf, np.float32)])
    most = np.maximum.reduceat(answers, cuts, axis=0)[::2]
    active = np.maximum(most + model["bias"], 0)
    mean = np.add.reduceat(active, layout.doc_first, axis=0) / layout.chunks[:, None].astype(np.float32)
    top = np.maximum.reduceat(active, layout.doc_first, axis=0)
    return np.concatenate([mean, top], axis=1), active, answers


def probability(model: Model, features: np.ndarray) -> np.ndarray:
    logit = features.astype(np.float64) @ model["out"].astype(np.float64) + float(model["offset"][0])
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def gradients(model: Model, layout: Layout, target: np.ndarray, weight: np.ndarray) -> Model:
    features, active, answers = pooled(model, layout)
    error = ((probability(model, features) - target) * weight / weight.sum()).astype(np.float32)
    doc = np.repeat(np.arange(len(target)), layout.chunks)
    back = error[:, None] * model["out"][None, :]
    tops = features[:, FILTERS:][doc] == active
    share = tops / np.maximum(np.add.reduceat(tops, layout.doc_first, axis=0), 1)[doc]
    flow = back[doc, :FILTERS] / layout.chunks[doc][:, None] + back[doc, FILTERS:] * share
    flow = np.where(active > 0, flow, 0).astype(np.float32)
    # Only the place that won a chunk learns.
    won = np.empty(active.shape, np.int64)
    for k, (a, b) in enumerate(zip(layout.start.tolist(), layout.stop.tolist())):
        won[k] = a + answers[a:b].argmax(axis=0)
    symbols = layout.symbols.reshape(-1, STEP)
    grad = {"out": features.T @ error, "offset": error.sum(keepdims=True), "bias": flow.sum(axis=0)}
    table = np.zeros_like(model["table"])
    for name, shift in (("near", 0), ("far", 1)):
        seen = symbols[won + shift]
        vectors = model["table"][seen].reshape(*won.shape, -1)
        grad[name] = np.einsum("kfd,kf->df", vectors, flow)
        spread = flow[:, :, None] * model[name].T[None]
        np.add.at(table, seen.reshape(-1), spread.reshape(-1, BYTE_WIDTH))
    grad["table"] = table
    return grad


def train(texts: list[bytes], labels: np.ndarray, updates: int = UPDATES, seed: int = SEED) -> Model:
    """Adam on both classes at equal weight; the same input gives the same model."""
    model = new_model(seed)
    if not len(labels):
        return model
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    r = np.random.default_rng(seed)
    deck = np.zeros(0, np.int64)
    for step in range(1, updates + 1):
        if len(deck) < BATCH:
            deck = np.r_[deck, r.permutation(len(texts))]
        pick, deck = deck[:BATCH], deck[BATCH:]
        body = [texts[i] for i in pick.tolist()]
        offsets = np.cumsum([0, *map(len, body)])
        layout = Layout(np.frombuffer(b"".join(body), np.uint8), offsets)
        grad = gradients(model, layout, labels[pick].astype(np.float64), weights[pick])
        rate = 0.01 * min(1.0, 2 * (1 - step / (updates + 1)))
        for name, g in grad.items():
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.01 * (g * g - second[name])
            move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)
            model[name] -= (rate * move).astype(np.float32)
            if name in ("near", "far", "out"):
                model[name] *= np.float32(1 - 1e-4)
    return model


def _trainer(most_bytes: int, updates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        for batch in batches:
            for place, doc_id, label, text in zip(*(batch.column(c).to_pylist() for c in ("place", "doc_id", "label", "text"))):
                rows.append((place, doc_id, label, text.encode()))
        rows.sort()
        used, texts, labels = 0, [], []
        for _, _, label, text in rows:
            if texts and used + len(text) > most_bytes:
                continue
            used += len(text)
            texts.append(text)
            labels.append(label)
        model = train(texts, np.array(labels, np.int64), updates)
        names = sorted(model)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([model[n].astype("<f4").tobytes() for n in names], pa.binary())],
            ["name", "body"],
        )

    return run


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = FOLDS,
    most: int = MOST_TRAINING,
    most_bytes: int = MOST_TRAINING_BYTES,
    updates: int = UPDATES,
) -> Model:
    """A model of the labels of documents outside fold 0.

    Learns from at most `most` documents, the first by a hash of their id, and
    whole texts of them up to `most_bytes`. A document with several labels counts
    by its largest; NULL labels and ids are left out. Without labels every score is a half.
    """
    doc_id = labels[id_col].cast("long")
    picked = (
        labels.select(doc_id.alias("label_id"), labels[label_col].cast("int").alias("label"))
        .filter("label_id IS NOT NULL AND label IS NOT NULL")
        .filter(fold_of(F.col("label_id"), folds) != 0)
        .groupBy("label_id")
        .agg(F.max("label").alias("label"))
        .withColumn("place", F.xxhash64("label_id"))
        .orderBy("place", "label_id")
        .limit(most)
    )
    # At most `most` rows of three numbers: small enough to send to every task.
    sample = keyed(docs, id_col, text_col).join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
    found = (
        sample.select("place", "doc_id", "label", "text")
        # The scan stays spread; only the sample meets in one task.
        .repartition(1)
        .mapInArrow(_trainer(most_bytes, updates), "name string, body binary")
        .collect()
    )
    if not found:
        return new_model()
    shapes = {k: v.shape for k, v in new_model().items()}
    return {r["name"]: np.frombuffer(bytes(r["body"]), "<f4").reshape(shapes[r["name"]]) for r in found}


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in utf8_slices(batches, limit=1 << 19):
            layout = Layout(*joined_utf8(batch.column("text")))
            features, _, _ = pooled(model, layout)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(probability(model, features))], ["doc_id", "score"]
            )

    return run


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    folds: int = FOLDS,
    **fitting,
) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    score is the probability of label 1 from the text's bytes alone. held_out
    documents are those whose crc32(id as text) is divisible by `folds`; nothing
    is learnt from them. NULL and empty texts are scored like a text of padding.
    A NULL id is held out and stays NULL; repeated rows are scored once each.
    """
    model = fit(docs, labels, id_col, text_col, label_col, folds, **fitting)
    rows = keyed(docs, id_col, text_col).select("doc_id", "text")
    scored = rows.mapInArrow(_scorer(model), "doc_id long, score double")
    held_out = (F.col("doc_id") == NULL_ID) | (fold_of(F.col("doc_id"), folds) == 0)
    return scored.select(
        public_id(),
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose text is predicted to be good; columns as they are."""
    model = fit(docs, labels, id_col, text_col, **{k: v for k, v in options.items() if k != "threshold"})
    threshold = options.get("threshold", THRESHOLD)

    @F.pandas_udf("double")
    def score(texts):
        out = np.empty(len(texts))
        body = [("" if t is None else t).encode() for t in texts]
        for at in range(0, len(body), 64):
            part = body[at : at + 64]
            layout = Layout(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]))
            out[at : at + 64] = probability(model, pooled(model, layout)[0])
        return type(texts)(out)

    return docs.filter(score(docs[text_col]) >= threshold)
