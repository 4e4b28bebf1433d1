"""Weak supervision: a generative label model over voters, and a linear scorer trained on its posteriors."""

from __future__ import annotations

import zlib

import numpy as np

#: Cells of sparse rows whose products are held at a time.
CELLS = 250_000


def excess_covariance(cov: np.ndarray, rounds: int = 200) -> np.ndarray:
    """What pairs of voters share beyond a common cause: off-diagonal covariance less a rank-one part.

    Voters that only share the hidden label have covariances v_j * v_k; v is fitted with weights that fall
    with the misfit, so a few dependent pairs don't bend it. As a share of the two standard deviations.
    """
    m, sd = len(cov), np.sqrt(np.maximum(np.diag(cov), 1e-9))
    off = cov / np.outer(sd, sd) * (1 - np.eye(m))
    if m < 3:
        return np.zeros((m, m))
    v = np.sqrt(np.maximum(np.nanmedian(np.where(np.eye(m) > 0, np.nan, off), axis=1), 1e-3))
    for _ in range(rounds):
        weight = (1 - np.eye(m)) / (np.abs(off - np.outer(v, v)) + 0.01)
        v = 0.5 * v + 0.5 * (weight * off) @ v / np.maximum(weight @ (v * v), 1e-9)
    return (off - np.outer(v, v)) * (1 - np.eye(m))


def feature(name: str, size: int) -> int:
    """Hashed feature number, stable across processes."""
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % size


class LabelModel:
    """Voters that fire or don't, given a hidden label; fitted to counts of vote patterns by EM.

    votes are bit masks of `polarity` voters: 1 fires for the label, -1 against it. Correlations
    are estimated first from covariances that no common cause explains, then, after EM, within each label
    class; each voter's evidence is divided by one plus its correlations with others, so that voters that
    repeat each other don't count twice; then EM runs again. Labels that are known enter as counts of their own (gold), believed with
    probability `trust`. With silence=False a voter that doesn't fire abstains: that is no evidence, as fits
    voters that each know one kind of a label's cases. All sums are over patterns, at most 2 ** voters of them.
    """

    def __init__(self, polarity: list[int], prior: float = 0.2, trust: float = 0.97, silence: bool = True):
        self.silence = silence
        self.polarity, self.m = np.array(polarity), len(polarity)
        self.bits = (np.arange(2**self.m)[:, None] >> np.arange(self.m)) & 1
        self.prior, self.trust = prior, trust
        self.rates = np.where(self.polarity > 0, [[0.03], [0.5]], [[0.8], [0.2]])  # P(fires | label 0), P(fires | label 1)
        self.weight, self.correlation = np.ones(self.m), np.zeros((self.m, self.m))

    def logit(self) -> np.ndarray:
        low, high = self.rates
        yes, no = np.log(high / low), np.log((1 - high) / (1 - low))
        fired = np.log(self.prior / (1 - self.prior)) + self.bits @ (self.weight * yes)
        return fired + (1 - self.bits) @ (self.weight * no) if self.silence else fired

    def posterior(self, evidence: float = 0.0) -> np.ndarray:
        """P(label 1 | votes) by bit mask; evidence is the log odds of what else is known."""
        return 1 / (1 + np.exp(-np.clip(self.logit() + evidence, -40, 40)))

    def _rounds(self, counts, rounds: int) -> None:
        trust = np.log(self.trust / (1 - self.trust))
        for _ in range(rounds):
            p = [self.posterior(e) for e in (0.0, -trust, trust)]
            one = sum(c * x for c, x in zip(counts, p))
            both = np.stack([sum(counts) - one, one])
            rates = (both @ self.bits + 0.5) / (both.sum(1, keepdims=True) + 1.0)
            prior = (one.sum() + 1) / (both.sum() + 4)
            done = np.abs(rates - self.rates).max() < 1e-6
            self.rates, self.prior = np.clip(rates, 1e-4, 1 - 1e-4), float(np.clip(prior, 1e-3, 0.999))
            if done:
                break

    def fit(self, votes: np.ndarray, gold0: np.ndarray | None = None, gold1: np.ndarray | None = None, rounds: int = 200) -> LabelModel:
        nothing = np.zeros(2**self.m)
        counts = [votes, gold0 if gold0 is not None else nothing, gold1 if gold1 is not None else nothing]
        if not sum(c.sum() for c in counts):
            return self
        mass = sum(counts)
        share = mass @ self.bits / mass.sum()
        self._discount(excess_covariance((self.bits - share).T @ ((self.bits - share) * mass[:, None]) / mass.sum()))
        self._rounds(counts, rounds)
        trust = np.log(self.trust / (1 - self.trust))
        one = sum(c * self.posterior(e) for c, e in zip(counts, (0.0, -trust, trust)))
        total = np.zeros((self.m, self.m))
        for mass in (sum(counts) - one, one):
            mean = mass @ self.bits / max(mass.sum(), 1e-9)
            off = self.bits - mean
            cov = off.T @ (off * mass[:, None]) / max(mass.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            total += cov / np.outer(sd, sd) * (mass.sum() / sum(c.sum() for c in counts))
        self._discount(total)
        self._rounds(counts, rounds)
        return self

    def _discount(self, correlation: np.ndarray) -> None:
        self.correlation = correlation
        other = np.maximum(correlation - np.diag(np.diag(correlation)), 0)
        self.weight = 1 / (1 + np.where(other > 0.1, other, 0).sum(1))

    def accuracies(self) -> np.ndarray:
        """Share of cases in which a voter's firing or not agrees with the label, by the model."""
        fires = np.where(self.polarity > 0, self.rates[1], 1 - self.rates[1])
        rests = np.where(self.polarity > 0, 1 - self.rates[0], self.rates[0])
        return self.prior * fires + (1 - self.prior) * rests


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, size: int, l1: float, rounds: int = 150, least_rows: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on sparse rows (features, values >= 0) with soft targets.

    Accelerated proximal gradient with per-feature steps from a separable bound of the curvature; an L1
    penalty and a least number of rows per feature keep chance features at zero. Same rows, same weights.
    Beside the rows it holds 8 bytes a cell, and products of about CELLS cells at a time.
    """
    n = len(rows)
    if not n:
        return np.zeros(size), 0.0
    seen = np.zeros(size, np.int64)
    for f, _ in rows:
        seen[f] += 1
    enough = seen >= least_rows
    used = np.flatnonzero(enough)
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used))
    edge = np.cumsum([0, *(int(enough[x].sum()) for x, _ in rows)])
    f, v = np.empty(edge[-1], np.int32), np.empty(edge[-1], np.float32)
    for (x, y), a, z in zip(rows, edge, edge[1:]):
        k = enough[x]
        f[a:z], v[a:z] = place[x[k]], y[k]
    cuts = [0]
    while cuts[-1] < n:
        cuts.append(min(n, max(cuts[-1] + 1, int(np.searchsorted(edge, edge[cuts[-1]] + CELLS, "right")) - 1)))

    def parts():
        """Rows, number of each cell's row among them, features and values, about CELLS cells at a time."""
        for lo, hi in zip(cuts, cuts[1:]):
            yield lo, hi, np.repeat(np.arange(hi - lo), np.diff(edge[lo : hi + 1])), f[edge[lo] : edge[hi]], v[edge[lo] : edge[hi]]

    def down(of: np.ndarray) -> np.ndarray:
        """By feature, the sum of values times their row's number."""
        return sum(np.bincount(fs, vs * of[lo:hi][row], len(used)) for lo, hi, row, fs, vs in parts())

    def across(of: np.ndarray) -> np.ndarray:
        """By row, the sum of values times their feature's number."""
        return np.concatenate([np.bincount(row, vs * of[fs], hi - lo) for lo, hi, row, fs, vs in parts()])

    mean = float(np.clip(target.mean(), 1e-3, 0.999))
    w, bias = np.zeros(len(used)), np.log(mean / (1 - mean))
    length = across(np.ones(len(used))) + 1.0
    step = 1 / (0.25 * down(length) / n + 1e-9)
    step_b = 1 / (0.25 * length.mean())
    at, at_b, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(at_b + across(at), -40, 40)))
        g = down(p - target) / n
        new = at - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b = at_b - step_b * float((p - target).mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, at_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - bias)
        w, bias, t = new, new_b, t_new
    out = np.zeros(size)
    out[used] = w
    return out, float(bias)
