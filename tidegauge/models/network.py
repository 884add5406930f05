"""A small dense network in numpy, used inside tasks and for weight updates on the driver."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

ACTIVATIONS = ("relu", "tanh", "gelu")
LOSSES = ("smoothl1", "huber", "smooth_l1", "mse")


def _erf(x: np.ndarray) -> np.ndarray:
    """Error function to 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    t = 1.0 / (1.0 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1.0 - poly * np.exp(-x * x))


def _activate(name: str, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Activation and its derivative."""
    if name == "relu":
        return np.maximum(z, 0.0), (z > 0).astype(z.dtype)
    if name == "tanh":
        a = np.tanh(z)
        return a, 1.0 - a * a
    if name == "gelu":
        cdf = 0.5 * (1.0 + _erf(z / np.sqrt(2.0)))
        return z * cdf, cdf + z * np.exp(-0.5 * z * z) / np.sqrt(2.0 * np.pi)
    raise ValueError(f"unsupported activation: {name}")


def loss_and_slope(name: str, diff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per-row loss of prediction minus truth, and its derivative."""
    if name == "mse":
        return diff * diff, 2.0 * diff
    if name in LOSSES:
        small = np.abs(diff) < 1.0
        return np.where(small, 0.5 * diff * diff, np.abs(diff) - 0.5), np.where(small, diff, np.sign(diff))
    raise ValueError(f"unsupported loss: {name}")


@dataclass
class Network:
    """Layer sizes from input to the single output, and one flat parameter vector."""

    sizes: tuple[int, ...]
    activation: str
    params: np.ndarray

    @staticmethod
    def create(in_dim: int, hidden: Sequence[int], activation: str = "relu", seed: int = 0) -> "Network":
        if activation not in ACTIVATIONS:
            raise ValueError(f"unsupported activation: {activation}")
        sizes = (int(in_dim), *[int(h) for h in hidden], 1)
        rng = np.random.default_rng(seed)
        flat = []
        for a, b in zip(sizes, sizes[1:]):
            bound = 1.0 / np.sqrt(a)
            flat += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
        return Network(sizes, activation, np.concatenate(flat))

    @property
    def hidden(self) -> tuple[int, ...]:
        return self.sizes[1:-1]

    def copy(self) -> "Network":
        return Network(self.sizes, self.activation, self.params.copy())

    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            w = self.params[at : at + a * b].reshape(a, b)
            out.append((w, self.params[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def align(self, x: np.ndarray) -> np.ndarray:
        """Cut or zero-pad the columns to the input size."""
        d = self.sizes[0]
        if x.shape[1] >= d:
            return x[:, :d]
        return np.hstack([x, np.zeros((len(x), d - x.shape[1]))])

    def predict(self, x: np.ndarray) -> np.ndarray:
        a = self.align(x)
        layers = self.layers()
        for i, (w, b) in enumerate(layers):
            z = a @ w + b
            a = z if i == len(layers) - 1 else _activate(self.activation, z)[0]
        return a[:, 0]

    def gradient(self, x: np.ndarray, y: np.ndarray, loss: str) -> tuple[float, np.ndarray]:
        """Summed loss over the rows and its gradient in the parameters."""
        layers = self.layers()
        inputs, slopes, a = [], [], self.align(x)
        for i, (w, b) in enumerate(layers):
            inputs.append(a)
            z = a @ w + b
            if i == len(layers) - 1:
                a = z
            else:
                a, slope = _activate(self.activation, z)
                slopes.append(slope)
        per_row, delta = loss_and_slope(loss, a[:, 0] - y)
        delta = delta[:, None]
        parts: list[np.ndarray] = []
        for i in range(len(layers) - 1, -1, -1):
            parts = [(inputs[i].T @ delta).ravel(), delta.sum(axis=0), *parts]
            if i:
                delta = (delta @ layers[i][0].T) * slopes[i - 1]
        return float(per_row.sum()), np.concatenate(parts)

    def frozen(self, n: int) -> int:
        """Number of leading parameters in the first ``n`` layers."""
        return sum(a * b + b for a, b in list(zip(self.sizes, self.sizes[1:]))[:n])

    def to_json(self) -> str:
        return json.dumps(
            {"sizes": list(self.sizes), "activation": self.activation, "params": self.params.tolist()}
        )

    @staticmethod
    def from_json(text: str) -> "Network":
        d = json.loads(text)
        return Network(tuple(d["sizes"]), d["activation"], np.asarray(d["params"]))


class Adam:
    """Adam steps on a parameter vector; the first ``frozen`` parameters stay fixed."""

    def __init__(self, size: int, lr: float, weight_decay: float = 0.0, frozen: int = 0):
        self.lr, self.weight_decay, self.frozen = lr, weight_decay, frozen
        self.m, self.v, self.t = np.zeros(size), np.zeros(size), 0

    def step(self, params: np.ndarray, grad: np.ndarray) -> np.ndarray:
        if self.weight_decay or self.frozen:
            grad = grad + self.weight_decay * params
            grad[: self.frozen] = 0.0
        self.t += 1
        square = 0.001 * grad
        square *= grad
        self.m *= 0.9
        self.m += 0.1 * grad
        self.v *= 0.999
        self.v += square
        change = self.m / (1 - 0.9**self.t)
        change *= self.lr
        scale = np.sqrt(self.v / (1 - 0.999**self.t), out=square)
        scale += 1e-8
        change /= scale
        change[: self.frozen] = 0.0
        return params - change


def fit_epochs(
    net: Network, x: np.ndarray, y: np.ndarray, opt: Adam, loss: str, batch: int, rng: np.random.Generator
) -> None:
    """One epoch of shuffled mini-batches, in place."""
    for idx in np.array_split(rng.permutation(len(x)), max(1, -(-len(x) // batch))):
        _, grad = net.gradient(x[idx], y[idx], loss)
        net.params = opt.step(net.params, grad / len(idx))
