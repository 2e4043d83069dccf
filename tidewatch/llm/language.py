"""Language of whole texts: a bidirectional gated recurrent network over bytes labels every position."""
from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label of texts without a letter.
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Shape and training of the network."""
    hidden: int = 8           # units per direction
    window: int = 64          # bytes that a state is carried over; windows tile the whole text
    sample: int = 600         # labelled rows per language that training sees at most, about
    languages: int = 256      # languages that can be learned, the most frequent ones
    windows: int = 3          # windows drawn from a sampled text
    batch: int = 256
    steps: int = 260
    rate: float = 0.02
    seed: int = 7
    at_once: int = 1024       # windows labelled at a time


@dataclass
class Network:
    """Weights of both directions (0 forward, 1 backward) for update gate, reset gate and candidate; output over both states."""
    table: np.ndarray    # 3 x 2 x 256 x H, what a byte adds
    recur: np.ndarray    # 3 x 2 x H x H
    out: np.ndarray      # 2 x H x L
    bias: np.ndarray     # L
    labels: list[str]


def _gate(v: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    v *= 0.5
    np.tanh(v, out=v)
    v += 1
    v *= 0.5
    return v


def _run(net: Network, x: np.ndarray, keep: bool = False):
    """States of both directions at every position of the windows x (B x T): 2 x T x B x H, each at its own position."""
    b, t = x.shape
    h = net.recur.shape[-1]
    columns = np.ascontiguousarray(x.T).astype(np.intp)
    states = np.empty((2, t, b, h), np.float32)
    saved = []
    state = np.zeros((2, b, h), np.float32)

    def into(gate: int, k: int) -> np.ndarray:
        v = np.empty((2, b, h), np.float32)
        np.take(net.table[gate, 0], columns[k], axis=0, out=v[0], mode="clip")
        np.take(net.table[gate, 1], columns[t - 1 - k], axis=0, out=v[1], mode="clip")
        return v

    for k in range(t):
        update, reset, cand = into(0, k), into(1, k), into(2, k)
        update += np.matmul(state, net.recur[0])
        reset += np.matmul(state, net.recur[1])
        back = np.matmul(state, net.recur[2])
        _gate(update), _gate(reset)
        cand += reset * back
        np.tanh(cand, out=cand)
        if keep:
            saved.append((state, update, reset, cand, back))
        state = state - cand
        state *= update
        state += cand
        states[0, k], states[1, t - 1 - k] = state[0], state[1]
    return states, saved


def position_probabilities(net: Network, states: np.ndarray) -> np.ndarray:
    """Label probabilities at every position: L x T x B."""
    _, t, b, h = states.shape
    z = states[0].reshape(-1, h) @ net.out[0]
    z += states[1].reshape(-1, h) @ net.out[1]
    z += net.bias
    z = np.ascontiguousarray(z.T)
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return z.reshape(-1, t, b)


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss (mean cross-entropy of all positions) and its gradients, by backpropagation through time."""
    b, t = x.shape
    h = net.recur.shape[-1]
    states, saved = _run(net, x, keep=True)
    d = np.ascontiguousarray(position_probabilities(net, states).transpose(1, 2, 0))
    total = max(mask.sum(), 1)
    loss = float(-(np.log(d[:, np.arange(b), y] + 1e-9) * mask.T).sum() / total)
    d[:, np.arange(b), y] -= 1
    d *= (mask.T / total)[:, :, None]
    g_out = np.stack([np.tensordot(states[i], d, axes=([0, 1], [0, 1])) for i in (0, 1)])
    d_states = np.stack([d @ net.out[i].T for i in (0, 1)])
    g_table, g_recur = np.zeros_like(net.table), np.zeros_like(net.recur)
    carry = np.zeros((2, b, h), np.float32)
    for k in range(t - 1, -1, -1):
        state, update, reset, cand, back = saved[k]
        carry = carry + np.stack([d_states[0, k], d_states[1, t - 1 - k]])
        d_cand = carry * (1 - update) * (1 - cand * cand)
        d_update = carry * (state - cand) * update * (1 - update)
        d_reset = d_cand * back * reset * (1 - reset)
        turned = state.transpose(0, 2, 1)
        carry = carry * update
        for g, (d_in, d_back) in enumerate(((d_update, d_update), (d_reset, d_reset), (d_cand, d_cand * reset))):
            g_recur[g] += np.matmul(turned, d_back)
            for i, at in enumerate((k, t - 1 - k)):
                np.add.at(g_table[g, i], x[:, at], d_in[i])
            carry += np.matmul(d_back, net.recur[g].transpose(0, 2, 1))
    return loss, [g_table, g_recur, g_out, d.sum(axis=(0, 1))]


def train(x: np.ndarray, mask: np.ndarray, y: np.ndarray, labels: list[str], settings: Settings) -> Network:
    """Fits the network to windows of bytes (N x T), the positions that count, and each window's label number."""
    rng = np.random.default_rng(settings.seed)
    h, n = settings.hidden, len(labels)
    make = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    net = Network(make(3, 2, 256, h), make(3, 2, h, h), make(2, h, n), np.zeros(n, np.float32), labels)
    weights = [net.table, net.recur, net.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    by_label = [np.flatnonzero(y == i) for i in range(n)]
    by_label = [i for i in by_label if len(i)]
    for step in range(1, settings.steps + 1):
        each = max(1, settings.batch // len(by_label))
        pick = np.concatenate([rng.choice(i, each) for i in by_label])  # every label alike, however frequent
        _, grads = _gradients(net, x[pick], y[pick], mask[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = settings.rate * (1 - step / (settings.steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for w, g, m, v in zip(weights, grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def windows_of(data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that tile the texts (N x width, zeros behind a text's end), positions in use per window, and each window's text."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    count = -(-sizes // width)
    flat = np.zeros(int(count.sum()) * width, np.uint8)
    start = (np.cumsum(count) - count) * width
    for d, s in zip(data, start.tolist()):
        flat[s:s + len(d)] = np.frombuffer(d, np.uint8)
    used = np.full(int(count.sum()), width)
    some = count > 0
    used[(np.cumsum(count) - 1)[some]] = (sizes - (count - 1) * width)[some]
    return flat.reshape(-1, width), used, np.repeat(np.arange(len(data)), count)


def _windows_at_once(data: Iterable[bytes], width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of `windows_of`, `most` at a time and then the rest: only those of one step are held."""
    at = 0
    for i, d in enumerate(data):
        lo = 0
        while lo < len(d):
            if not at:
                flat, used, owner = np.zeros(most * width, np.uint8), np.full(most, width), np.zeros(most, np.int64)
            part = np.frombuffer(d, np.uint8, min(len(d) - lo, (most - at) * width), lo)
            n = -(-len(part) // width)
            flat[at * width:at * width + len(part)] = part
            used[at + n - 1] = len(part) - (n - 1) * width
            owner[at:at + n] = i
            lo, at = lo + len(part), at + n
            if at == most:
                yield flat.reshape(-1, width), used, owner
                at = 0
    if at:
        yield flat.reshape(-1, width)[:at], used[:at], owner[:at]


def label_texts(net: Network, data: Iterable[bytes], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Label number and pooled probability of each text: the mean over all its positions. Texts are read one after the other."""
    sizes: list[int] = []
    total: list[np.ndarray] = []  # of each text so far, by label

    def seen() -> Iterator[bytes]:
        for d in data:
            sizes.append(len(d))
            total.append(np.zeros(len(net.labels)))
            yield d

    for x, used, owner in _windows_at_once(seen(), settings.window, settings.at_once):
        p = position_probabilities(net, _run(net, x)[0])
        p *= np.arange(settings.window)[:, None] < used[None, :]
        first = owner[0]
        found = np.stack([np.bincount(owner - first, sums) for sums in p.sum(axis=1)], axis=1)
        for i, sums in enumerate(found, first):
            total[i] += sums
    mean = np.array(total).reshape(len(sizes), len(net.labels)).T / np.maximum(np.array(sizes, np.int64), 1)
    return mean.argmax(axis=0), np.clip(mean.max(axis=0), 0, 1)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Network | None:
    """A network trained on a bounded sample of labelled rows; None where no usable row has a label.

    Per language about `sample` rows are drawn by a hash of the id, at a rate that follows from the language's row count, and
    from each up to `windows` windows at hashed places of the whole text. Only these windows reach the driver.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = usable.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang_col).limit(settings.languages).collect()
    if not counts:
        return None
    labels = sorted(r[0] for r in counts)
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col(lang_col) == r[0], min(1.0, settings.sample / r["n"])).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(settings.seed)), F.lit(1_000_000)) / 1_000_000
    drawn = usable.where(draw < rate).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    width, many, seed = settings.window, settings.windows, settings.seed

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text, lang in zip(b["id"], b["text"], b["lang"]):
                data = text.encode("utf-8", "replace")
                rng = np.random.default_rng([seed, zlib.crc32(str(i).encode())])
                for at in sorted({0, *rng.integers(0, max(1, len(data) - width + 1), many - 1).tolist()}):
                    rows.append((str(i), at, data[at:at + width], lang))
            yield pd.DataFrame(rows, columns=["id", "at", "bytes", "lang"])

    rows = drawn.mapInPandas(cut, "id string, at int, bytes binary, lang string").collect()
    rows.sort(key=lambda r: (r["id"], r["at"], bytes(r["bytes"])))
    x, used, _ = windows_of([bytes(r["bytes"]) for r in rows], width)
    mask = (np.arange(width)[None, :] < used[:, None]).astype(np.float32)
    return train(x, mask, np.array([labels.index(r["lang"]) for r in rows]), labels, settings)


def identify(docs: DataFrame, net: Network | None, text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Adds `lang_pred` and `score` to every row; existing columns of these names are replaced.

    Each text is read whole. `und` with score 0 where the text is null, empty or has no letter, and everywhere without a network.
    """
    docs = docs.drop("lang_pred", "score")
    letters = F.col(text_col).rlike(r"\p{L}")
    if net is None:
        return docs.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for t in texts:
            known = t.notna().to_numpy()
            lang, score = np.full(len(t), UNKNOWN, object), np.zeros(len(t))
            if known.any():
                best, p = label_texts(net, (x.encode("utf-8", "replace") for x in t[known]), settings)
                lang[known], score[known] = np.array(net.labels, object)[best], p
            yield pd.DataFrame({"lang": lang, "score": score})

    said = predict(F.when(letters, F.col(text_col)))
    return docs.withColumn("__said", said).withColumn("lang_pred", F.col("__said.lang")).withColumn("score", F.col("__said.score")).drop("__said")


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
