"""Small neural classifiers of word sequences, trained on shares of the rows by barrier tasks.

Two networks: ``convolution`` (embedding, convolution over words, the maximum over the text, a
hidden layer, classes) and ``pooling`` (embedding, the mean over the text, classes). An exchange
between barrier tasks takes a second, however small it is, so there is none a batch: rows are dealt
into shares by a hash of their number, a share takes the steps (Adam) of its own batches, and some
times an epoch the shares' weights are averaged by their rows. How many shares there are is told by
the number of rows, and which batch of an epoch a row is in by a hash, so the run is the same on any
number of tasks, but for the order in which floats are added. Only weights, whose size the layout
bounds, pass between tasks; the driver gets one row.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import ml


@dataclass(frozen=True)
class Layout:
    kind: str = "convolution"
    classes: int = 2
    words: int = ml.VOCABULARY
    length: int = 200
    embedding: int = 32
    filters: int = 64
    kernel: int = 3
    hidden: int = 64


@dataclass(frozen=True)
class Training:
    """Training stops after ``patience`` epochs in which the validation loss fell by less than ``least``; the best weights count.

    Rows of at least twice ``apart`` batches are dealt into shares of so many, ``shares`` at most, whose
    weights are averaged ``rounds`` times an epoch.
    """

    epochs: int = 20
    batch: int = 32
    rate: float = 0.001
    patience: int = 5
    least: float = 0.0001
    seed: int = 42
    tasks: int = 4
    shares: int = 8
    apart: int = 64
    rounds: int = 16


def first_weights(net: Layout, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    spread = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
    out = {"embedding": rng.uniform(-0.05, 0.05, (net.words + 2, net.embedding))}  # 0 pads, 1 is any other word
    if net.kind == "pooling":
        return out | {"w": spread(net.embedding, net.classes), "b": np.zeros(net.classes)}
    out |= {"k": spread(net.kernel * net.embedding, net.filters), "kb": np.zeros(net.filters)}
    out |= {"h": spread(net.filters, net.hidden), "hb": np.zeros(net.hidden)}
    return out | {"w": spread(net.hidden, net.classes), "b": np.zeros(net.classes)}


def forward(net: Layout, weights: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, dict]:
    """Class probabilities of sequences (rows of ``x``), and what the way back needs."""
    seen = weights["embedding"][x]
    if net.kind == "pooling":
        top, kept = seen.mean(axis=1), {}
    else:
        windows = np.lib.stride_tricks.sliding_window_view(seen, net.kernel, axis=1).swapaxes(2, 3).reshape(len(x), -1, net.kernel * net.embedding)
        rising = windows @ weights["k"] + weights["kb"]
        at = rising.argmax(axis=1)
        most = np.maximum(np.take_along_axis(rising, at[:, None], axis=1)[:, 0], 0)
        hidden = np.maximum(most @ weights["h"] + weights["hb"], 0)
        top, kept = hidden, {"at": at, "most": most, "windows": windows}
    scores = top @ weights["w"] + weights["b"]
    odds = np.exp(scores - scores.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True), kept | {"top": top}


def gradients(net: Layout, weights: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
    """Summed gradients and loss (cross entropy) of rows."""
    out = {k: np.zeros_like(v) for k, v in weights.items()}
    if not len(x):
        return out, 0.0
    p, kept = forward(net, weights, x)
    loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).sum())
    back = p.copy()
    back[np.arange(len(y)), y] -= 1
    out["w"], out["b"] = kept["top"].T @ back, back.sum(axis=0)
    back = back @ weights["w"].T
    if net.kind == "pooling":
        np.add.at(out["embedding"], x, np.repeat(back[:, None] / x.shape[1], x.shape[1], axis=1))
        return out, loss
    back = back * (kept["top"] > 0)
    out["h"], out["hb"] = kept["most"].T @ back, back.sum(axis=0)
    back = (back @ weights["h"].T) * (kept["most"] > 0)
    best = kept["windows"][np.arange(len(x))[:, None], kept["at"]]  # (row, filter, place in the window)
    out["k"], out["kb"] = np.einsum("bfk,bf->kf", best, back), back.sum(axis=0)
    down = (back[:, :, None] * weights["k"].T[None]).reshape(len(x), net.filters, net.kernel, net.embedding)
    words = x[np.arange(len(x))[:, None, None], kept["at"][:, :, None] + np.arange(net.kernel)]
    np.add.at(out["embedding"], words, down)
    return out, loss


def _packed(parts: dict[str, np.ndarray], *sums: float) -> str:
    return base64.b64encode(np.concatenate([*(v.ravel() for v in parts.values()), np.array(sums)]).astype(np.float64).tobytes()).decode()


def _sum_of(messages: list[str], like: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    whole = sum(np.frombuffer(base64.b64decode(m), np.float64) for m in messages)
    out, at = {}, 0
    for k, v in like.items():
        out[k] = whole[at : at + v.size].reshape(v.shape)
        at += v.size
    return out, whole[at:]


def batch_of(rows: np.ndarray, epoch: int, batches: int) -> np.ndarray:
    """The batch of an epoch that a row's number falls into, by a hash of both."""
    h = (rows.astype(np.uint64) + np.uint64((epoch + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(batches)).astype(np.int64)


class Share:
    """Rows that are trained on in turn, in the order of their numbers, and their steps' running sums."""

    def __init__(self, net: Layout, plan: Training, rows: np.ndarray, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        fit, self.held = order[~held[order]], (x[order[held[order]]], y[order[held[order]]])
        self.plan, self.net, self.rows, self.x, self.y = plan, net, rows[fit], x[fit], y[fit]
        self.batches, self.step = max(1, round(len(fit) / plan.batch)), 0
        self.slow, self.fast = ({k: np.zeros_like(v) for k, v in first_weights(net, plan.seed).items()} for _ in range(2))

    def shuffle(self, epoch: int) -> None:
        turn = batch_of(self.rows, epoch, self.batches)
        self.order = np.argsort(turn, kind="stable")
        self.ends = np.searchsorted(turn[self.order], np.arange(self.batches + 1))

    def steps(self, weights: dict[str, np.ndarray], part: int, parts: int) -> tuple[dict[str, np.ndarray], float]:
        """(weights, summed loss) after the batches of one of an epoch's parts."""
        weights, lost = dict(weights), 0.0
        for number in range(self.batches * part // parts, self.batches * (part + 1) // parts):
            mine = self.order[self.ends[number] : self.ends[number + 1]]
            if not len(mine):
                continue
            grad, loss = gradients(self.net, weights, self.x[mine], self.y[mine])
            lost, self.step = lost + loss, self.step + 1
            for k in weights:
                g = grad[k] / len(mine)
                self.slow[k] = 0.9 * self.slow[k] + 0.1 * g
                self.fast[k] = 0.999 * self.fast[k] + 0.001 * g * g
                weights[k] = weights[k] - self.plan.rate * (self.slow[k] / (1 - 0.9**self.step)) / (np.sqrt(self.fast[k] / (1 - 0.999**self.step)) + 1e-7)
        return weights, lost

    def held_loss(self, weights: dict[str, np.ndarray]) -> float:
        x, y = self.held
        parts = [slice(i, i + 256) for i in range(0, len(y), 256)]
        return sum(float(-np.log(np.maximum(forward(self.net, weights, x[i])[0][np.arange(len(y[i])), y[i]], 1e-12)).sum()) for i in parts)


def fit_shares(net: Layout, plan: Training, shares: list[Share], rounds: int, exchange) -> tuple[dict[str, np.ndarray], list[tuple[float, float]]]:
    """(best weights, losses by epoch) from this task's shares; ``exchange`` gives all tasks' messages for one's own."""
    weights = first_weights(net, plan.seed)
    total = _sum_of(exchange(_packed({}, float(sum(len(s.y) for s in shares)), float(sum(len(s.held[1]) for s in shares)))), {})[1]
    best, worse, history = (np.inf, weights), 0, []
    for epoch in range(plan.epochs):
        lost = 0.0
        for share in shares:
            share.shuffle(epoch)
        for part in range(rounds):
            own, loss = {k: np.zeros_like(v) for k, v in weights.items()}, 0.0
            for share in shares:
                got, more = share.steps(weights, part, rounds)
                own, loss = {k: own[k] + len(share.y) * got[k] for k in own}, loss + more
            summed, losses = _sum_of(exchange(_packed(own, loss)), weights)
            lost += losses[0]
            if total[0]:
                weights = {k: v / total[0] for k, v in summed.items()}
        val = _sum_of(exchange(_packed({}, sum(s.held_loss(weights) for s in shares))), {})[1][0] / max(total[1], 1)
        history.append((lost / max(total[0], 1), val))
        worse = 0 if val < best[0] - plan.least else worse + 1
        if val < best[0]:
            best = (val, weights)
        if worse >= plan.patience:
            break
    return best[1], history


@dataclass
class Network:
    layout: Layout
    vocabulary: list[str]
    labels: list[str]
    weights: dict[str, np.ndarray]
    history: list[tuple[float, float]]


def train_network(rows: DataFrame, text: str = "description", label: str = "label", kind: str = "convolution", plan: Training | None = None, number: str = "seq", **layout) -> Network:
    """A classifier of texts. ``number`` is a long that tells rows apart: a fifth of them, by its hash, is for validation.

    Rows without text or label don't count. The labels and the vocabulary are on the driver, as
    the weights are. The tasks run at once (barrier execution), each with its shares of the rows
    in memory, some 2 bytes a word; if one dies, the stage begins anew.
    """
    plan = plan or Training()
    rows = rows.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # classes
    labels, shares = sorted(sizes), max(1, min(plan.shares, sum(sizes.values()) * 4 // 5 // (plan.batch * plan.apart)))
    tasks, rounds = min(plan.tasks, shares), plan.rounds if shares > 1 else 1
    size = layout.pop("words", ml.VOCABULARY)
    words = [r["word"] for r in ml.vocabulary(rows, text, size).collect()]  # ``size`` words
    net = Layout(kind=kind, classes=max(len(labels), 1), words=len(words), **layout)
    classes = F.array_position(F.array(*[F.lit(x) for x in labels] or [F.lit("")]), F.col(label)).cast("int") - 1
    held = F.pmod(F.xxhash64(number, F.lit(plan.seed)), F.lit(5)) == 0
    share = F.pmod(F.xxhash64(number, F.lit(plan.seed), F.lit("share")), F.lit(shares)).cast("int")
    data = ml.sequences(rows, text, words, net.length).select(F.col(number).cast("long").alias("number"), "sequence", classes.alias("y"), held.alias("held"), share.alias("share"))
    narrow = np.min_scalar_type(net.words + 2)

    def run(batches):
        context, parts = BarrierTaskContext.get(), []
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, net.length).astype(narrow)
            parts.append((b.column(0).to_numpy(), x, b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy()))
        none = [(np.zeros(0, np.int64), np.zeros((0, net.length), narrow), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32))]
        *own, of = (np.concatenate(c) for c in zip(*(parts or none), strict=True))
        del parts
        weights, history = fit_shares(net, plan, [Share(net, plan, *(c[of == s] for c in own)) for s in np.unique(of)], rounds, context.allGather if tasks > 1 else lambda m: [m])
        if context.partitionId() == 0:
            blob = np.concatenate([v.ravel() for v in weights.values()]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([[list(h) for h in history]], pa.list_(pa.list_(pa.float64())))], ["weights", "history"])

    dealt = data.repartitionById(tasks, F.col("share") % tasks)
    got = dealt.mapInArrow(run, "weights binary, history array<array<double>>", barrier=True).collect()[0]  # one row
    like, at, weights = first_weights(net, plan.seed), 0, {}
    flat = np.frombuffer(got["weights"], np.float64)
    for k, v in like.items():
        weights[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return Network(net, words, labels, weights, [tuple(h) for h in got["history"]])


def predict_network(model: Network, rows: DataFrame, text: str = "description") -> DataFrame:
    """``rows`` with ``predicted`` and ``scores`` by class."""
    shared = rows.sparkSession.sparkContext.broadcast((model.layout, model.weights))  # of the layout's size

    @F.arrow_udf("array<double>")
    def scored(sequences: pa.Array) -> pa.Array:
        net, weights = shared.value
        x = sequences.flatten().to_numpy(zero_copy_only=False).reshape(len(sequences), net.length)
        p = np.concatenate([forward(net, weights, x[i : i + 256])[0] for i in range(0, len(x), 256)]) if len(x) else np.zeros((0, net.classes))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * net.classes, pa.int32()), pa.array(p.ravel()))

    got = ml.sequences(rows, text, model.vocabulary, model.layout.length).withColumn("scores", scored("sequence")).drop("sequence")
    best = F.array_position("scores", F.array_max("scores")).cast("int") - 1
    return got.withColumn("predicted", F.get(F.array(*[F.lit(x) for x in model.labels]), best))
