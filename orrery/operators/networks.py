"""Small neural models described by JSON, trained by synchronous mini-batch steps.

A description is a list of layers in order: {"name", "type", "inputs": [...], ...}. Each step
broadcasts the parameters, runs forward and backward over Arrow batches with numpy, and sums the
flattened gradients; only these sums reach the driver, whose size is that of the model.

Layers: input, linear, embedding, fc (dims, activations), bi_inner_sum, bi_inner, bi_interaction,
attention, cross, concat, sum, dot, mixture. Losses: logloss, hinge, l2, huber, softmax.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ACT = {
    "identity": (lambda x: x, lambda x, y: np.ones_like(x)),
    "relu": (lambda x: np.maximum(x, 0), lambda x, y: (x > 0).astype(float)),
    "sigmoid": (lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30))), lambda x, y: y * (1 - y)),
    "tanh": (np.tanh, lambda x, y: 1 - y * y),
}


def _pairs(k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(k, 1)


class Network:
    """Parameters, forward and backward of one description. ``fields`` is the number of feature
    slots of an example for embedding layers, ``features`` the length of the input vectors."""

    def __init__(self, spec: list[dict] | str, features: int, fields: int = 0, seed: int = 1) -> None:
        self.spec = json.loads(spec) if isinstance(spec, str) else spec
        self.features, self.fields = features, fields
        rng = np.random.Generator(np.random.PCG64(seed))
        self.params: dict[str, np.ndarray] = {}
        width = {"input": features}
        make = lambda name, *shape, scale=None: self.params.__setitem__(name, rng.normal(0, scale or 1 / np.sqrt(max(shape[0], 1)), shape))
        for l in self.spec:
            n, kind = l["name"], l["type"]
            ins = [width[i] for i in l.get("inputs", ["input"])]
            if kind == "linear":
                make(f"{n}.w", features, l.get("outputs", 1), scale=0.01)
                self.params[f"{n}.b"] = np.zeros(l.get("outputs", 1))
                width[n] = l.get("outputs", 1)
            elif kind == "embedding":
                make(f"{n}.e", features, l["factors"], scale=0.05)
                width[n] = (fields, l["factors"])
            elif kind == "fc":
                at = ins[0] if isinstance(ins[0], int) else ins[0][0] * ins[0][1]
                for i, d in enumerate(l["dims"]):
                    make(f"{n}.w{i}", at, d)
                    self.params[f"{n}.b{i}"] = np.zeros(d)
                    at = d
                width[n] = at
            elif kind == "bi_inner_sum":
                width[n] = 1
            elif kind == "bi_inner":
                width[n] = fields * (fields - 1) // 2
            elif kind == "bi_interaction":
                width[n] = ins[0][1]
            elif kind == "attention":
                make(f"{n}.w", ins[0][1], l["size"])
                self.params[f"{n}.b"] = np.zeros(l["size"])
                make(f"{n}.h", l["size"], 1)
                width[n] = ins[0][1]
            elif kind == "cross":
                make(f"{n}.w", self._flat(ins[0]), 1)
                self.params[f"{n}.b"] = np.zeros(self._flat(ins[0]))
                width[n] = self._flat(ins[0])
            elif kind == "concat":
                width[n] = sum(self._flat(w) for w in ins)
            elif kind in ("sum", "dot"):
                width[n] = self._flat(ins[0]) if kind == "sum" else 1
            elif kind == "mixture":
                make(f"{n}.u", features, l["parts"], scale=0.1)
                make(f"{n}.w", features, l["parts"], scale=0.1)
                width[n] = 1
            else:
                raise ValueError(f"unknown layer type {kind}")
        self.output = self.spec[-1]["name"]

    @staticmethod
    def _flat(w) -> int:
        return w if isinstance(w, int) else w[0] * w[1]

    def run(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Output (rows x k) and what backward needs. The first ``fields`` columns' embeddings are
        those of the features scaled by their values."""
        p, out, memo = self.params, {"input": x}, {}
        for l in self.spec:
            n, kind, ins = l["name"], l["type"], [out[i] for i in l.get("inputs", ["input"])]
            if kind == "linear":
                y = x @ p[f"{n}.w"] + p[f"{n}.b"]
            elif kind == "embedding":
                y = x[:, : self.fields, None] * p[f"{n}.e"][None, : self.fields]
            elif kind == "fc":
                a, steps = ins[0].reshape(len(x), -1), []
                for i, act in enumerate(l["activations"]):
                    z = a @ p[f"{n}.w{i}"] + p[f"{n}.b{i}"]
                    nxt = _ACT[act][0](z)
                    steps.append((a, z, nxt))
                    a = nxt
                y, memo[n] = a, steps
            elif kind == "bi_inner_sum":
                s = ins[0].sum(1)
                y = 0.5 * (s * s - (ins[0] ** 2).sum(1)).sum(1, keepdims=True)
            elif kind == "bi_inner":
                i, j = _pairs(self.fields)
                y = (ins[0][:, i] * ins[0][:, j]).sum(-1)
            elif kind == "bi_interaction":
                s = ins[0].sum(1)
                y = 0.5 * (s * s - (ins[0] ** 2).sum(1))
            elif kind == "attention":
                i, j = _pairs(self.fields)
                pair = ins[0][:, i] * ins[0][:, j]
                z = pair @ p[f"{n}.w"] + p[f"{n}.b"]
                r = np.maximum(z, 0)
                a = (r @ p[f"{n}.h"])[..., 0]
                a = np.exp(a - a.max(1, keepdims=True))
                a /= a.sum(1, keepdims=True)
                y, memo[n] = (a[..., None] * pair).sum(1), (pair, z, r, a)
            elif kind == "cross":
                x0, xl = (v.reshape(len(x), -1) for v in (ins[0], ins[-1]))
                y, memo[n] = x0 * (xl @ p[f"{n}.w"]) + p[f"{n}.b"] + xl, (x0, xl)
            elif kind == "concat":
                y = np.hstack([v.reshape(len(x), -1) for v in ins])
            elif kind == "sum":
                y = sum(v.reshape(len(x), -1) for v in ins)
            elif kind == "dot":
                y = (ins[0].reshape(len(x), -1) * ins[1].reshape(len(x), -1)).sum(1, keepdims=True)
            else:
                u, w = x @ p[f"{n}.u"], x @ p[f"{n}.w"]
                gate = np.exp(u - u.max(1, keepdims=True))
                gate /= gate.sum(1, keepdims=True)
                s = _ACT["sigmoid"][0](w)
                q = np.clip((gate * s).sum(1, keepdims=True), 1e-9, 1 - 1e-9)
                y, memo[n] = np.log(q / (1 - q)), (gate, s, q)
            out[n] = y
        return out[self.output].reshape(len(x), -1), {"out": out, "memo": memo}

    def backward(self, x: np.ndarray, state: dict, grad: np.ndarray) -> dict[str, np.ndarray]:
        p, out, memo = self.params, state["out"], state["memo"]
        g = {self.output: grad.reshape(out[self.output].shape)}
        dp = {k: np.zeros_like(v) for k, v in p.items()}

        def give(name: str, value: np.ndarray) -> None:
            if name != "input":
                value = value.reshape(out[name].shape)
                g[name] = g[name] + value if name in g else value

        for l in reversed(self.spec):
            n, kind, names = l["name"], l["type"], l.get("inputs", ["input"])
            if n not in g:
                continue
            d, ins = g[n], [out[i] for i in names]
            if kind == "linear":
                dp[f"{n}.w"] += x.T @ d
                dp[f"{n}.b"] += d.sum(0)
            elif kind == "embedding":
                dp[f"{n}.e"][: self.fields] += (x[:, : self.fields, None] * d).sum(0)
            elif kind == "fc":
                for i in reversed(range(len(memo[n]))):
                    a, z, y = memo[n][i]
                    d = d * _ACT[l["activations"][i]][1](z, y)
                    dp[f"{n}.w{i}"] += a.T @ d
                    dp[f"{n}.b{i}"] += d.sum(0)
                    d = d @ p[f"{n}.w{i}"].T
                give(names[0], d)
            elif kind in ("bi_inner_sum", "bi_interaction"):
                e = ins[0]
                give(names[0], (e.sum(1, keepdims=True) - e) * d.reshape(len(x), 1, -1))
            elif kind in ("bi_inner", "attention"):
                i, j = _pairs(self.fields)
                e = ins[0]
                if kind == "bi_inner":
                    dpair = np.broadcast_to(d[..., None], (*d.shape, e.shape[-1]))
                else:
                    pair, z, r, a = memo[n]
                    da = (pair * d[:, None]).sum(-1)
                    ds = a * (da - (a * da).sum(1, keepdims=True))
                    dp[f"{n}.h"] += np.einsum("bps,bp->s", r, ds)[:, None]
                    dz = ds[..., None] * p[f"{n}.h"][:, 0] * (z > 0)
                    dp[f"{n}.w"] += np.einsum("bpf,bps->fs", pair, dz)
                    dp[f"{n}.b"] += dz.sum((0, 1))
                    dpair = a[..., None] * d[:, None] + dz @ p[f"{n}.w"].T
                de = np.zeros_like(e)
                np.add.at(de, (slice(None), i), dpair * e[:, j])
                np.add.at(de, (slice(None), j), dpair * e[:, i])
                give(names[0], de)
            elif kind == "cross":
                x0, xl = memo[n]
                s = (d * x0).sum(1, keepdims=True)
                dp[f"{n}.w"] += xl.T @ s
                dp[f"{n}.b"] += d.sum(0)
                give(names[0], d * (xl @ p[f"{n}.w"]))
                give(names[-1], s @ p[f"{n}.w"].T + d)
            elif kind == "concat":
                at = 0
                for name in names:
                    w = out[name].reshape(len(x), -1).shape[1]
                    give(name, d[:, at : at + w])
                    at += w
            elif kind == "sum":
                for name in names:
                    give(name, d)
            elif kind == "dot":
                a, b = (v.reshape(len(x), -1) for v in ins)
                give(names[0], d * b)
                give(names[1], d * a)
            else:
                gate, s, q = memo[n]
                dq = d / (q * (1 - q))
                dp[f"{n}.w"] += x.T @ (dq * gate * s * (1 - s))
                dp[f"{n}.u"] += x.T @ (gate * (s - q) * dq)
        return dp


def loss_of(kind: str, out: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row and its gradient in the outputs."""
    if kind == "softmax":
        p = np.exp(out - out.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        hot = np.eye(out.shape[1])[y.astype(int)]
        return -np.log(np.maximum((p * hot).sum(1), 1e-300)), p - hot
    o, s = out[:, 0], np.where(y > 0, 1.0, -1.0)
    if kind == "logloss":
        return np.logaddexp(0, -s * o), (-s / (1 + np.exp(np.clip(s * o, -30, 30))))[:, None]
    if kind == "hinge":
        return np.maximum(0, 1 - s * o), np.where(s * o < 1, -s, 0.0)[:, None]
    e = o - y
    if kind == "l2":
        return 0.5 * e * e, e[:, None]
    return np.where(abs(e) <= 1, 0.5 * e * e, abs(e) - 0.5), np.clip(e, -1, 1)[:, None]


class NetworkModel:
    def __init__(self, network: Network, loss: str, features: str = "features") -> None:
        self.network, self.loss, self.features, self.history = network, loss, features, []

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds output (array), probability (of the classes or of the positive one) and prediction."""
        net, loss = self.network, self.loss

        @F.pandas_udf("array<double>")
        def outputs(v: pd.Series) -> pd.Series:
            out, _ = net.run(np.stack(v.to_numpy())) if len(v) else (np.empty((0, 1)), None)
            return pd.Series(list(out))

        df = df.withColumn("output", outputs(self.features))
        if loss == "softmax":
            return df.withColumn("prediction", (F.array_position("output", F.array_max("output")) - 1).cast("double"))
        if loss in ("l2", "huber"):
            return df.withColumn("prediction", F.get("output", 0))
        return df.withColumn("probability", 1 / (1 + F.exp(-F.get("output", 0)))).withColumn("prediction", (F.get("output", 0) > 0).cast("double"))

    def to_json(self) -> str:
        n = self.network
        return json.dumps({"spec": n.spec, "features": n.features, "fields": n.fields, "loss": self.loss, "params": {k: v.tolist() for k, v in n.params.items()}})

    @staticmethod
    def from_json(text: str) -> NetworkModel:
        d = json.loads(text)
        net = Network(d["spec"], d["features"], d["fields"])
        net.params = {k: np.array(v) for k, v in d["params"].items()}
        return NetworkModel(net, d["loss"])


def train_network(df: DataFrame, network: Network, loss: str = "logloss", features: str = "features", label: str = "label", weight: str | None = None, rate: float = 0.01, epochs: int = 5, batches: int = 1, optimizer: str = "adam", decay: str = "none") -> NetworkModel:
    """Rows are dealt to ``batches`` mini-batches by a hash of their features; each step is one pass
    over its rows that returns one summed gradient for each partition."""
    from orrery.operators.params_table import decayed

    model = NetworkModel(network, loss, features)
    rows = df.select(features, F.col(label).cast("double").alias("__y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"))
    names = list(network.params)
    m = {k: np.zeros_like(v) for k, v in network.params.items()}
    v2 = {k: np.zeros_like(v) for k, v in network.params.items()}
    step = 0
    for epoch in range(epochs):
        lr, total, count = decayed(decay, rate, epoch), 0.0, 0.0
        for b in range(batches):
            part = rows if batches == 1 else rows.where(F.pmod(F.xxhash64(features), F.lit(batches)) == b)
            net = network

            def run(frames, net=net):
                grad, loss_sum, n = np.zeros(sum(net.params[k].size for k in names)), 0.0, 0.0
                for pdf in frames:
                    for at in range(0, len(pdf), 2048):
                        some = pdf.iloc[at : at + 2048]
                        x, y, w = np.stack(some[features].to_numpy()).astype(float), some["__y"].to_numpy(), some["__w"].to_numpy()
                        out, state = net.run(x)
                        each, slope = loss_of(loss, out, y)
                        dp = net.backward(x, state, slope * w[:, None])
                        grad += np.concatenate([dp[k].ravel() for k in names])
                        loss_sum += float((each * w).sum())
                        n += float(w.sum())
                yield pd.DataFrame({"g": [grad.tobytes()], "l": [loss_sum], "n": [n]})

            got = part.mapInPandas(run, "g binary, l double, n double").collect()  # one row for each partition
            n = sum(r.n for r in got) or 1.0
            grad = sum(np.frombuffer(r.g) for r in got) / n
            total, count, step, at = total + sum(r.l for r in got), count + n, step + 1, 0
            for k in names:
                size = network.params[k].size
                g = grad[at : at + size].reshape(network.params[k].shape)
                at += size
                if optimizer == "adam":
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    g = (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
                elif optimizer == "momentum":
                    m[k] = 0.9 * m[k] + g
                    g = m[k]
                network.params[k] = network.params[k] - lr * g
        model.history.append(total / count)
    return model


def _head(*inputs: str) -> dict:
    return {"name": "out", "type": "sum", "inputs": list(inputs)}


def family(name: str, factors: int = 4, hidden: tuple[int, ...] = (16, 16), parts: int = 4) -> tuple[list[dict], str]:
    """(description, loss) of the usual models: logreg, svm, linreg, robustreg, fm, mixedlr, dnn, daw
    (deep and wide), deepfm, nfm, pnn, afm, dcn; softmax takes its classes from ``parts``."""
    wide = {"name": "wide", "type": "linear"}
    emb = {"name": "emb", "type": "embedding", "factors": factors}
    mlp = lambda i, act="relu": {"name": "mlp", "type": "fc", "inputs": [i], "dims": [*hidden, 1], "activations": [act] * len(hidden) + ["identity"]}
    table = {
        "logreg": ([wide], "logloss"),
        "svm": ([wide], "hinge"),
        "linreg": ([wide], "l2"),
        "robustreg": ([wide], "huber"),
        "softmax": ([{"name": "wide", "type": "linear", "outputs": parts}], "softmax"),
        "fm": ([wide, emb, {"name": "pair", "type": "bi_inner_sum", "inputs": ["emb"]}, _head("wide", "pair")], "logloss"),
        "mixedlr": ([{"name": "mix", "type": "mixture", "parts": parts}], "logloss"),
        "dnn": ([mlp("input", "sigmoid")], "logloss"),
        "daw": ([wide, emb, mlp("emb"), _head("wide", "mlp")], "logloss"),
        "deepfm": ([wide, emb, {"name": "pair", "type": "bi_inner_sum", "inputs": ["emb"]}, mlp("emb"), _head("wide", "pair", "mlp")], "logloss"),
        "nfm": ([wide, emb, {"name": "bi", "type": "bi_interaction", "inputs": ["emb"]}, mlp("bi"), _head("wide", "mlp")], "logloss"),
        "pnn": ([wide, emb, {"name": "in", "type": "bi_inner", "inputs": ["emb"]}, {"name": "cat", "type": "concat", "inputs": ["emb", "in"]}, mlp("cat"), _head("wide", "mlp")], "logloss"),
        "afm": ([wide, emb, {"name": "att", "type": "attention", "inputs": ["emb"], "size": factors}, {"name": "p", "type": "fc", "inputs": ["att"], "dims": [1], "activations": ["identity"]}, _head("wide", "p")], "logloss"),
        "dcn": ([emb, {"name": "c1", "type": "cross", "inputs": ["emb"]}, {"name": "c2", "type": "cross", "inputs": ["emb", "c1"]}, {"name": "deep", "type": "fc", "inputs": ["emb"], "dims": list(hidden), "activations": ["relu"] * len(hidden)}, {"name": "cat", "type": "concat", "inputs": ["c2", "deep"]}, {"name": "last", "type": "fc", "inputs": ["cat"], "dims": [1], "activations": ["identity"]}], "logloss"),
    }
    return table[name]
