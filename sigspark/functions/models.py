"""Matrix and sequence models on one matrix or sequence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .dsp import TINY

EPS = 1e-16


def nndsvd(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative start from singular vectors; entries under 1e-6 take the mean."""
    u, s, t = np.linalg.svd(v, full_matrices=False)
    w, h = np.zeros((len(v), k)), np.zeros((k, v.shape[1]))
    w[:, 0], h[0] = np.sqrt(s[0]) * np.abs(u[:, 0]), np.sqrt(s[0]) * np.abs(t[0])
    for j in range(1, k):
        sides = [(np.maximum(sg * u[:, j], 0), np.maximum(sg * t[j], 0)) for sg in (1, -1)]
        sizes = [np.linalg.norm(a) * np.linalg.norm(b) for a, b in sides]
        (a, b), size = sides[int(sizes[1] > sizes[0])], max(sizes)
        if size > 0:
            w[:, j] = np.sqrt(s[j] * size) * a / np.linalg.norm(a)
            h[j] = np.sqrt(s[j] * size) * b / np.linalg.norm(b)
    w[w < 1e-6] = v.mean()
    h[h < 1e-6] = v.mean()
    return w, h


def _unit(w: np.ndarray, norm: str) -> np.ndarray:
    d = {"max": lambda: w.max(0), "l1": lambda: np.abs(w).sum(0), "l2": lambda: np.sqrt((w * w).sum(0))}[norm]()
    return w / np.where(d == 0, 1, d)


def nmf(v: np.ndarray, k: int, divergence: str = "kl", max_iter: int = 300, thresh: float = 1e-3, norm: str = "max", init="nndsvd") -> tuple[np.ndarray, np.ndarray]:
    """W, H by multiplicative updates, both from the same product; ends when neither moves by ``thresh``."""
    v = np.asarray(v, float)
    n, m = v.shape
    if not 1 <= k <= min(n, m):
        raise ValueError(f"a {n} x {m} matrix has no factors of rank {k}")
    if divergence not in ("kl", "is", "euclidean") or norm not in ("max", "l1", "l2"):
        raise ValueError(f"unknown divergence {divergence!r} or norm {norm!r}")
    if (v < 0).any():
        raise ValueError("found values below 0, which products of non-negative factors cannot give")
    if isinstance(init, tuple):
        w, h = (np.asarray(a, float).copy() for a in init)
        if w.shape != (n, k) or h.shape != (k, m) or (w < 0).any() or (h < 0).any():
            raise ValueError(f"the first factors have to be {n} x {k} and {k} x {m}, without values below 0")
    elif init == "nndsvd":
        w, h = nndsvd(v, k)
    elif init == "ramps":
        w, h = np.arange(1, n * k + 1, dtype=float).reshape(n, k), np.arange(1, k * m + 1, dtype=float).reshape(k, m)
    else:
        raise ValueError("init must be nndsvd, ramps or (W, H)")
    w = _unit(w, norm)
    for _ in range(max_iter):
        d = w @ h
        over = {"kl": lambda: v / (d + EPS), "is": lambda: v / (d * d + EPS), "euclidean": lambda: v}[divergence]()
        under = {"kl": lambda: np.ones_like(v), "is": lambda: 1 / (d + EPS), "euclidean": lambda: d}[divergence]()
        h2 = h * (w.T @ over) / (w.T @ under + EPS)
        w2 = _unit(w * (over @ h2.T) / (under @ h2.T + EPS), norm)
        moved = max(np.linalg.norm(w2 - w), np.linalg.norm(h2 - h))
        w, h = w2, h2
        if moved < thresh:
            break
    return w, h


def _distribution(p, name: str) -> np.ndarray:
    p = np.asarray(p, float)
    if (p < 0).any() or np.abs(p.sum(-1) - 1).max() > 1e-4:
        raise ValueError(f"rows of {name} must be non-negative and sum to one")
    return p


def viterbi(prob: np.ndarray, a: np.ndarray, p_init: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """The most likely path (states from 0) through states x frames probabilities, and its log; the first of equal ones."""
    prob, a = np.asarray(prob, float), _distribution(a, "A")
    s = len(prob)
    if a.shape != (s, s):
        raise ValueError("A must be states x states")
    p = np.full(s, 1 / s) if p_init is None else _distribution(p_init, "p_init")
    la, lp = np.log(a + TINY), np.log(prob + TINY)
    score = np.log(p + TINY) + lp[:, 0]
    back = np.zeros(prob.shape, int)
    for t in range(1, prob.shape[1]):
        c = score[:, None] + la
        back[:, t] = c.argmax(0)
        score = c.max(0) + lp[:, t]
    path = [int(score.argmax())]
    for t in range(prob.shape[1] - 1, 0, -1):
        path.append(int(back[path[-1], t]))
    return np.array(path[::-1]), float(score.max())


@dataclass(frozen=True)
class Hmm:
    """Initial, transition and emission probabilities; symbols and states from 0."""

    p_init: np.ndarray
    a: np.ndarray
    b: np.ndarray

    def __post_init__(self) -> None:
        for name in ("p_init", "a", "b"):
            object.__setattr__(self, name, _distribution(getattr(self, name), name))
        s = len(self.p_init)
        if self.a.shape != (s, s) or len(self.b) != s:
            raise ValueError("p_init, A and B must have the same number of states")

    def _forward(self, obs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alpha, scale = np.zeros((len(obs), len(self.p_init))), np.zeros(len(obs))
        v = self.p_init * self.b[:, obs[0]]
        for t in range(len(obs)):
            if t:
                v = (alpha[t - 1] @ self.a) * self.b[:, obs[t]]
            scale[t] = v.sum()
            alpha[t] = v / scale[t] if scale[t] > 0 else v
        return alpha, scale

    def predict(self, obs) -> float:
        """Log-likelihood of a sequence; -inf where it cannot be."""
        obs = self._checked(obs)
        with np.errstate(divide="ignore"):
            return float(np.log(self._forward(obs)[1]).sum()) if len(obs) else 0.0

    def decode(self, obs) -> tuple[np.ndarray, float]:
        obs = self._checked(obs)
        return viterbi(self.b[:, obs], self.a, self.p_init)

    def _checked(self, obs) -> np.ndarray:
        obs = np.asarray(obs, int)
        if len(obs) and (obs.min() < 0 or obs.max() >= self.b.shape[1]):
            raise ValueError("a symbol is out of range")
        return obs

    def train(self, obs, max_iter: int = 100, tol: float = 1e-3) -> Hmm:
        """Baum-Welch; states that are never visited keep their rows."""
        obs, h = self._checked(obs), self
        for _ in range(max_iter):
            alpha, scale = h._forward(obs)
            beta = np.ones_like(alpha)
            for t in range(len(obs) - 2, -1, -1):
                beta[t] = h.a @ (h.b[:, obs[t + 1]] * beta[t + 1]) / scale[t + 1]
            gamma = alpha * beta
            gamma /= gamma.sum(1, keepdims=True)
            move = h.a * np.einsum("ti,tj->ij", alpha[:-1], (h.b[:, obs[1:]].T * beta[1:]) / scale[1:, None])
            seen = np.zeros_like(h.b)
            np.add.at(seen.T, obs, gamma)
            a = np.where(move.sum(1, keepdims=True) > 0, move / np.maximum(move.sum(1, keepdims=True), TINY), h.a)
            b = np.where(seen.sum(1, keepdims=True) > 0, seen / np.maximum(seen.sum(1, keepdims=True), TINY), h.b)
            new = Hmm(gamma[0], a, b)
            moved = max(np.linalg.norm(new.p_init - h.p_init), np.linalg.norm(new.a - h.a), np.linalg.norm(new.b - h.b))
            h = new
            if moved <= tol:
                break
        return h

    def train_many(self, sequences: list, max_iter: int = 100, tol: float = 1e-3) -> list[Hmm]:
        """What ``train`` gives for each sequence. All take a step at once, longest first, so those that still have a symbol
        at a place are the first ones; a sequence that has come to rest leaves."""
        obs = [self._checked(o) for o in sequences]
        if any(not len(o) for o in obs):
            raise ValueError("a sequence has no symbols")
        found: list[Hmm | None] = [None] * len(obs)
        left = np.array(sorted(range(len(obs)), key=lambda i: -len(obs[i])), int)
        sizes = np.array([len(obs[i]) for i in left])
        k, top = self.b.shape
        symbol = np.zeros((len(left), sizes.max(initial=0)), int)
        for row, i in zip(symbol, left, strict=True):
            row[: len(obs[i])] = obs[i]
        p, a, b = (np.broadcast_to(v, (len(left), *v.shape)).copy() for v in (self.p_init, self.a, self.b))
        for _ in range(max_iter):
            if not len(left):
                break
            n, longest = len(left), sizes[0]
            live = [int(v) for v in np.searchsorted(-sizes, -np.arange(longest), "left")]  # sequences longer than t
            seen = np.take_along_axis(b, symbol[:, None, :longest], axis=2)  # sequences x states x places
            alpha, scale = np.zeros((longest, n, k)), np.ones((longest, n))
            for t in range(longest):
                m = live[t]
                v = (p if t == 0 else (alpha[t - 1, :m, :, None] * a[:m]).sum(1))[:m] * seen[:m, :, t]
                scale[t, :m] = v.sum(1)
                alpha[t, :m] = v / np.where(scale[t, :m] > 0, scale[t, :m], 1)[:, None]
            beta, move, count = np.ones((n, k)), np.zeros((n, k, k)), np.zeros((n, top, k))
            rows = np.arange(n)
            for t in range(longest - 1, -1, -1):
                m, ahead = live[t], live[t + 1] if t + 1 < longest else 0
                if ahead:
                    weighed = seen[:ahead, :, t + 1] * beta[:ahead] / scale[t + 1, :ahead, None]
                    move[:ahead] += alpha[t, :ahead, :, None] * weighed[:, None, :]
                    beta[:ahead] = (a[:ahead] * weighed[:, None, :]).sum(2)
                gamma = alpha[t, :m] * beta[:m]
                gamma /= gamma.sum(1, keepdims=True)
                count[rows[:m], symbol[:m, t]] += gamma
            move, count = a * move, count.transpose(0, 2, 1)
            a2, b2 = (np.where(c.sum(2, keepdims=True) > 0, c / np.maximum(c.sum(2, keepdims=True), TINY), old) for c, old in ((move, a), (count, b)))
            moved = np.max([np.sqrt(((x - y) ** 2).reshape(n, -1).sum(1)) for x, y in ((gamma, p), (a2, a), (b2, b))], axis=0)
            p, a, b = gamma, a2, b2
            done = moved <= tol
            for j in np.flatnonzero(done):
                found[left[j]] = Hmm(p[j], a[j], b[j])
            left, sizes, symbol, p, a, b = (v[~done] for v in (left, sizes, symbol, p, a, b))
        for j, i in enumerate(left):
            found[i] = Hmm(p[j], a[j], b[j])
        return found

    def generate(self, n: int, seed: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States and symbols drawn from the model."""
        states, symbols = self.generate_many(n, [seed])
        return states[0], symbols[0]

    def generate_many(self, n: int, seeds) -> tuple[np.ndarray, np.ndarray]:
        """A row of ``n`` states and one of symbols for each seed; all rows take a step at once."""
        u = np.array([np.random.default_rng(s).random(2 * n) for s in seeds]).reshape(len(seeds), 2, n)

        def drawn(p: np.ndarray, v: np.ndarray) -> np.ndarray:
            return np.minimum((np.cumsum(p, axis=-1) <= v[:, None]).sum(1), p.shape[-1] - 1)

        states, symbols = np.zeros((len(seeds), n), int), np.zeros((len(seeds), n), int)
        for t in range(n):
            states[:, t] = drawn(self.p_init if t == 0 else self.a[states[:, t - 1]], u[:, 0, t])
            symbols[:, t] = drawn(self.b[states[:, t]], u[:, 1, t])
        return states, symbols
