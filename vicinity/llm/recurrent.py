"""A bidirectional gated recurrent network over bytes, in numpy.

Both directions are computed side by side: arrays have a leading axis of two, and the
second direction reads its window from the end.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 12
WINDOW = 64
SYMBOLS = 256

Weights = dict[str, np.ndarray]


def new_weights(classes: int, hidden: int = HIDDEN, seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)

    def normal(scale, *shape):
        return (rng.normal(size=shape) * scale).astype(np.float32)

    return {
        "embed": normal(0.3, 2, SYMBOLS, 3 * hidden),
        "state": normal(hidden**-0.5, 2, hidden, 3 * hidden),
        "bias": np.zeros((2, 1, hidden), np.float32),
        "out": normal((2 * hidden) ** -0.5, 2, hidden, classes),
        "base": np.zeros(classes, np.float32),
    }


def _step(w: Weights, h: np.ndarray, symbols, given: np.ndarray, kept: np.ndarray) -> tuple:
    """Next state of both directions, with the update, the reset and the candidate.

    ``given`` and ``kept`` are room for what symbols and state bring to the gates.
    """
    size = h.shape[2]
    for d in (0, 1):
        np.take(w["embed"][d], symbols[d], axis=0, out=given[d], mode="clip")
    np.matmul(h, w["state"], out=kept)
    gates = given[:, :, : 2 * size] + kept[:, :, : 2 * size]
    # The logistic function as half a hyperbolic tangent.
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    update, reset = gates[:, :, :size], gates[:, :, size:]
    own = kept[:, :, 2 * size :]
    own += w["bias"]
    cand = reset * own
    cand += given[:, :, 2 * size :]
    np.tanh(cand, out=cand)
    new = h - cand
    new *= update
    new += cand
    return new, update, reset, cand


def states(w: Weights, windows: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (2, time, rows, hidden) of rows of bytes; the second direction in reading order."""
    rows, time = windows.shape
    size = w["state"].shape[1]
    symbols = np.ascontiguousarray(windows.T)
    out = np.empty((2, time, rows, size), np.float32)
    h = np.zeros((2, rows, size), np.float32)
    given = np.empty((2, rows, 3 * size), np.float32)
    kept = np.empty_like(given)
    for t in range(time):
        before = h
        h, *gates = _step(w, before, (symbols[t], symbols[time - 1 - t]), given, kept)
        out[0, t], out[1, time - 1 - t] = h
        if trace is not None:
            trace.append((before, *gates, kept[:, :, 2 * size :].copy()))
    return out


def probabilities(w: Weights, seen: np.ndarray) -> np.ndarray:
    """Class probabilities (time, rows, classes) at every position."""
    logits = seen[0] @ w["out"][0]
    logits += seen[1] @ w["out"][1]
    logits += w["base"]
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def gradients(
    w: Weights, windows: np.ndarray, labels: np.ndarray, mask: np.ndarray
) -> tuple[float, Weights]:
    """Mean loss over the positions in ``mask`` and its gradients, by backpropagation through time."""
    trace: list = []
    seen = states(w, windows, trace)
    probs = probabilities(w, seen)
    rows, time = windows.shape
    size, live = seen.shape[3], mask.T.astype(np.float32)
    count = max(float(live.sum()), 1.0)
    right = probs[:, np.arange(rows), labels]
    loss = float(-(np.log(right + 1e-9) * live).sum() / count)
    error = probs.copy()
    error[:, np.arange(rows), labels] -= 1
    error *= live[:, :, None] / count
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["base"] = error.sum(axis=(0, 1))
    flat = error.reshape(-1, error.shape[2])
    for d in (0, 1):
        grad["out"][d] = seen[d].reshape(-1, size).T @ flat
    into = np.stack([error @ w["out"][d].T for d in (0, 1)])
    back = np.zeros((2, rows, size), np.float32)
    for t in range(time - 1, -1, -1):
        h, update, reset, cand, kept = trace[t]
        back = back + np.stack([into[0, t], into[1, time - 1 - t]])
        d_update = back * (h - cand) * update * (1 - update)
        d_cand = back * (1 - update) * (1 - cand * cand)
        d_reset = d_cand * kept * reset * (1 - reset)
        given = np.concatenate([d_update, d_reset, d_cand], axis=2)
        state = np.concatenate([d_update, d_reset, d_cand * reset], axis=2)
        grad["bias"] += state[:, :, 2 * size :].sum(axis=1, keepdims=True)
        grad["state"] += np.matmul(h.transpose(0, 2, 1), state)
        np.add.at(grad["embed"][0], windows[:, t], given[0])
        np.add.at(grad["embed"][1], windows[:, time - 1 - t], given[1])
        back = back * update + np.matmul(state, w["state"].transpose(0, 2, 1))
    return loss, grad


def train(
    windows: np.ndarray,
    labels: np.ndarray,
    mask: np.ndarray,
    classes: int,
    steps: int = 160,
    batch: int = 128,
    rate: float = 0.02,
    seed: int = 7,
) -> Weights:
    """Fit by Adam on batches drawn with equal chances for every class."""
    w, rng = new_weights(classes, seed=seed), np.random.default_rng(seed)
    share = np.bincount(labels, minlength=classes)[labels].astype(float)
    chance = (1 / share) / (1 / share).sum()
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        rows = rng.choice(len(windows), size=batch, p=chance)
        _, grad = gradients(w, windows[rows], labels[rows], mask[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        clip, now = min(1.0, 1.0 / (norm + 1e-9)), rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            g = g * clip
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            m, v = first[k] / (1 - 0.9**step), second[k] / (1 - 0.99**step)
            w[k] -= (now * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return w
