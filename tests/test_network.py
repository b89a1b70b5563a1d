"""Networks: gradients against differences, runs in step against one process, and what they learn."""

import numpy as np
import pytest
from gleaner.operators import network
from gleaner.operators.network import Layout, Training


@pytest.mark.parametrize("kind", ["convolution", "pooling"])
def test_gradients(kind):
    net = Layout(kind, classes=3, words=20, length=9, embedding=4, filters=5, kernel=3, hidden=6)
    weights, rng = network.first_weights(net, 1), np.random.default_rng(2)
    x, y = rng.integers(0, 22, (7, 9)), rng.integers(0, 3, 7)
    grad, loss = network.gradients(net, weights, x, y)
    for name, w in weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in w.shape)
            moved = {k: v.copy() for k, v in weights.items()}
            moved[name][at] += 1e-6
            assert abs((network.gradients(net, moved, x, y)[1] - loss) / 1e-6 - grad[name][at]) < 1e-4
    assert network.gradients(net, weights, x[:0], y[:0])[1] == 0.0


def rows(spark, n=240):
    rng = np.random.default_rng(5)
    word = {"cats": ["cat", "purr", "milk"], "dogs": ["dog", "bark", "bone"], "birds": ["bird", "sing", "seed"]}
    noise = [f"w{i}" for i in range(30)]
    data = []
    for i in range(n):
        label = sorted(word)[i % 3]
        data.append((i, " ".join(rng.permutation([*rng.choice(word[label], 3), *rng.choice(noise, 12)])), label))
    return spark.createDataFrame([*data, (n, None, "cats"), (n + 1, "cat", None)], "seq long, description string, label string")


@pytest.mark.parametrize("kind", ["convolution", "pooling"])
def test_runs_in_step_equal_one_process(spark, kind):
    plan = {"epochs": 3, "batch": 16, "rate": 0.02}
    one, many = (network.train_network(rows(spark), kind=kind, plan=Training(tasks=t, **plan), length=20, filters=8, hidden=8, embedding=8) for t in (1, 3))
    assert np.allclose(one.history, many.history, atol=1e-9)
    assert all(np.allclose(one.weights[k], many.weights[k], atol=1e-7) for k in one.weights)


def test_learns_and_predicts(spark):
    model = network.train_network(rows(spark), plan=Training(epochs=12, batch=16, rate=0.01), length=20, filters=16, hidden=16, embedding=8)
    assert model.labels == ["birds", "cats", "dogs"] and model.history[-1][1] < model.history[0][1]
    got = network.predict_network(model, rows(spark)).where("description is not null and label is not null").collect()
    assert sum(r["predicted"] == r["label"] for r in got) / len(got) > 0.95
    assert all(abs(sum(r["scores"]) - 1) < 1e-9 for r in got)
    assert network.predict_network(model, rows(spark).limit(0)).count() == 0


def test_stops_early(spark):
    model = network.train_network(rows(spark), kind="pooling", plan=Training(epochs=30, batch=64, rate=0.0, patience=2), length=20, embedding=4)
    assert len(model.history) == 3
