"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word (a run without ASCII space; a longer run than ``MAX_BYTES`` in pieces) forwards and
backwards, labels every byte position, and a document's probabilities are the mean over its positions that hold
letters. A word that occurs often in a batch is read once. The network is trained in numpy by backpropagation
through time on pieces of a bounded, balanced sample of labelled rows (``SAMPLE_ROWS`` per language, ``PIECES`` pieces of
``PIECE_CHARS`` characters each, taken anywhere in the text); every document is labelled over its whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a null key is hashed as an empty text;
repeated rows are labelled each; rows without a language are not learned from; with no labelled row all is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hindcast.llm import text as tx
from hindcast.llm.toxicity import fold

HELD_OUT_FOLD = (4, 2)
UNDETERMINED = "und"
SAMPLE_ROWS = 250
PIECES, PIECE_CHARS = 4, 160
MAX_BYTES = 24
HIDDEN = 8
STEPS, BATCH, RATE = 260, 384, 0.02
# Bytes of text whose words are read together.
BLOCK = 12 << 20

_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) | (_BYTES >= 0x80)


def _sigmoid(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@dataclass
class Network:
    """Per direction: input table (256, 3H), recurrent weights (H, 3H); one output layer (2H, classes) and its bias."""

    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(classes: int, hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(
            [draw(256, 3 * hidden, scale=0.3) for _ in range(2)],
            [draw(hidden, 3 * hidden, scale=hidden**-0.5) for _ in range(2)],
            draw(2 * hidden, classes, scale=0.3),
            np.zeros(classes, np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, self.output, self.bias]

    def run(self, direction: int, codes: np.ndarray, inside: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, word, H) in reading order of one direction. ``inside`` is false on padding."""
        table, weights = self.inputs[direction], self.recurrent[direction]
        size = weights.shape[0]
        h = np.zeros((codes.shape[1], size), np.float32)
        states = np.empty((*codes.shape, size), np.float32)
        for t in range(len(codes)) if direction == 0 else range(len(codes) - 1, -1, -1):
            x, u = table[codes[t]], h @ weights
            gates = _sigmoid(x[:, : 2 * size] + u[:, : 2 * size])
            update, reset = gates[:, :size], gates[:, size:]
            fresh = np.tanh(x[:, 2 * size :] + reset * u[:, 2 * size :])
            if inside is not None:
                update = update * inside[t][:, None]
            if keep is not None:
                keep.append((t, h, u[:, 2 * size :], update, reset, fresh))
            h = h + update * (fresh - h)
            states[t] = h
        return states

    def probabilities(self, codes: np.ndarray, inside: np.ndarray | None = None) -> np.ndarray:
        """Probabilities (time, word, class) of every position."""
        both = np.concatenate([self.run(d, codes, inside) for d in (0, 1)], axis=2)
        scores = both @ self.output + self.bias
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        return scores / scores.sum(axis=2, keepdims=True)

    def gradients(self, codes: np.ndarray, inside: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradient by backpropagation through time."""
        kept: list[list] = [[], []]
        both = np.concatenate([self.run(d, codes, inside, kept[d]) for d in (0, 1)], axis=2)
        scores = both @ self.output + self.bias
        scores -= scores.max(axis=2, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=2, keepdims=True)
        weight = inside.astype(np.float32) / inside.sum()
        loss = -float((np.log(p[:, np.arange(len(labels)), labels] + 1e-9) * weight).sum())
        p[:, np.arange(len(labels)), labels] -= 1
        p *= weight[:, :, None]
        d_output = np.einsum("twh,twc->hc", both, p)
        d_states = p @ self.output.T
        size, d_inputs, d_recurrent = self.recurrent[0].shape[0], [], []
        for d in (0, 1):
            weights = self.recurrent[d]
            d_table, d_weights = np.zeros_like(self.inputs[d]), np.zeros_like(weights)
            dh = np.zeros((codes.shape[1], size), np.float32)
            for t, before, u_fresh, update, reset, fresh in reversed(kept[d]):
                dh = dh + d_states[t, :, d * size : (d + 1) * size]
                d_fresh = dh * update * (1 - fresh * fresh)
                d_update = dh * (fresh - before) * update * (1 - update) * inside[t][:, None]
                d_reset = d_fresh * u_fresh * reset * (1 - reset)
                d_x = np.concatenate([d_update, d_reset, d_fresh], axis=1)
                d_u = np.concatenate([d_update, d_reset, d_fresh * reset], axis=1)
                np.add.at(d_table, codes[t], d_x)
                d_weights += before.T @ d_u
                dh = dh * (1 - update) + d_u @ weights.T
            d_inputs.append(d_table)
            d_recurrent.append(d_weights)
        return loss, [*d_inputs, *d_recurrent, d_output, p.sum(axis=(0, 1))]


def trained(words: list[bytes], labels: np.ndarray, classes: int, hidden=HIDDEN, steps=STEPS, batch=BATCH, seed=3) -> Network:
    """A network fitted to words with a language each, by Adam over batches of words of like length."""
    network, rng = Network.fresh(classes, hidden, seed), np.random.default_rng(seed)
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths + rng.random(len(words)), kind="stable")
    padded = np.zeros((len(words), MAX_BYTES), np.uint8)
    for i, w in enumerate(words):
        padded[i, : len(w)] = np.frombuffer(w, np.uint8)
    parameters = network.parameters()
    first = [np.zeros_like(p) for p in parameters]
    second = [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1):
        at = rng.integers(0, max(1, len(words) - batch + 1))
        chosen = order[at : at + batch]
        longest = int(lengths[chosen].max())
        codes = np.ascontiguousarray(padded[chosen, :longest].T)
        inside = np.arange(longest)[:, None] < lengths[chosen][None, :]
        _loss, gradients = network.gradients(codes, inside, labels[chosen])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(parameters, gradients, first, second):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return network


def _pieces(found: tx.Words) -> tx.Words:
    """Words cut into pieces of at most MAX_BYTES bytes. Pieces of long words get the hash of their bounds."""
    length = found.end - found.start
    count = -(-length // MAX_BYTES)
    if not len(count) or count.max() == 1:
        return found
    source = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
    start = found.start[source] + number * MAX_BYTES
    end = np.minimum(start + MAX_BYTES, found.end[source])
    hashes = np.where(count[source] == 1, found.hash[source], tx.mix(found.hash[source] + number.astype(np.uint64)))
    return tx.Words(found.doc[source], start, end, hashes)


def position_sums(network: Network, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Per word, the summed probabilities of its positions that hold letters, and in the last column their number."""
    classes = len(network.bias)
    out = np.zeros((len(start), classes + 1), np.float32)
    length = end - start
    for size in np.unique(length):
        members = np.flatnonzero(length == size)
        for at in range(0, len(members), 4096):
            part = members[at : at + 4096]
            codes = data[start[part][None, :] + np.arange(size)[:, None]]
            letters = _LETTER[codes].astype(np.float32)
            p = network.probabilities(codes)
            out[part, :classes] = np.einsum("twc,tw->wc", p, letters)
            out[part, classes] = letters.sum(axis=0)
    return out


def document_probabilities(network: Network, texts: pa.Array) -> np.ndarray:
    """Mean probabilities over the letters of each text; zeros without any."""
    classes = len(network.bias)
    totals = np.zeros((len(texts), classes + 1))
    block: list = []

    def read(block) -> None:
        data = np.concatenate([d for d, *_ in block])
        shift = np.cumsum([0, *(len(d) for d, *_ in block)])
        doc = np.concatenate([w.doc + first for _d, first, w in block])
        start = np.concatenate([w.start + s for (_d, _f, w), s in zip(block, shift)])
        end = np.concatenate([w.end + s for (_d, _f, w), s in zip(block, shift)])
        _h, once, which = np.unique(np.concatenate([w.hash for *_, w in block]), return_index=True, return_inverse=True)
        sums = position_sums(network, data, start[once], end[once])
        low, high = int(doc[0]) if len(doc) else 0, int(doc[-1]) + 1 if len(doc) else 0
        for c in range(classes + 1):
            totals[low:high, c] += np.bincount(doc - low, sums[which, c], minlength=high - low)

    size = 0
    for first, _last, data, offsets in tx.chunks(texts):
        block.append((data, first, _pieces(tx.words(data, offsets, tx.NOT_SPACE))))
        size += len(data)
        if size >= BLOCK:
            read(block)
            block, size = [], 0
    if block:
        read(block)
    return totals[:, :classes] / np.maximum(totals[:, classes:], 1)


def training_words(pieces: list[tuple[str, str]], languages: list[str]) -> tuple[list[bytes], np.ndarray]:
    words, labels = [], []
    for language, piece in pieces:
        for word in piece.split():
            data = word.encode()
            for at in range(0, len(data), MAX_BYTES):
                words.append(data[at : at + MAX_BYTES])
                labels.append(languages.index(language))
    return words, np.array(labels)


@dataclass
class Model:
    languages: list[str]
    network: Network | None


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Train on the labelled rows outside the held-out fold."""
    parts, held = HELD_OUT_FOLD
    order = F.xxhash64(key)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(F.col(key), parts) != held))
    narrow = known.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), order.alias("_order"))
    first = Window.partitionBy("_lang").orderBy("_order", "_key")
    picked = narrow.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample_rows).select("_key", "_lang").distinct()
    chosen = docs.sparkSession.createDataFrame(picked.collect(), picked.schema)  # sample_rows per language at most
    places = F.sequence(F.lit(0), F.lit(PIECES - 1))
    room = F.greatest(F.length(text) - PIECE_CHARS, F.lit(1))
    pieces = F.transform(places, lambda i: F.substring(F.col(text), F.pmod(F.xxhash64(F.col(key), i), room).cast("int") + 1, F.lit(PIECE_CHARS)))
    rows = (
        known.join(F.broadcast(chosen), (F.col(key) == F.col("_key")) & (F.col(lang) == F.col("_lang")))
        .select("_key", "_lang", pieces.alias("_pieces"))
        .groupBy("_key", "_lang")
        .agg(F.min("_pieces").alias("_pieces"))
        .orderBy("_lang", "_key")
        .collect()
    )
    languages = sorted({r["_lang"] for r in rows})
    words, labels = training_words([(r["_lang"], p) for r in rows for p in r["_pieces"]], languages)
    if not words:
        return Model([], None)
    return Model(languages, trained(words, labels, len(languages)))


def labelled(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with held_out, lang_pred and score, the pooled probability of the predicted language."""
    languages, network = model.languages, model.network

    def predict(texts: pa.Array) -> pa.Array:
        if network is None:
            names, best = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        else:
            p = document_probabilities(network, texts)
            names, best = [languages[i] for i in p.argmax(axis=1)], p.max(axis=1) if len(p) else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(best, pa.float64())], ["lang", "score"])

    parts, held = HELD_OUT_FOLD
    readable = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    names = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    found = F.arrow_udf(predict, "lang string, score double")(F.col(text))
    return docs.withColumn("_found", found).select(
        *[F.col(f"`{c}`") for c in names],
        (fold(F.col(key), parts) == held).alias("held_out"),
        F.when(readable, F.col("_found.lang")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(readable, F.least(F.lit(1.0), F.col("_found.score"))).otherwise(0.0).alias("score"),
    )
