"""A generative model of binary voters: accuracies, and correlations along a tree.

Given the hidden class, voters form a tree: each depends on its parent, and
the tree is the one with the largest conditional mutual information between
voters, so the strongest correlations are part of the model rather than
counted twice. With anchors, a voter that stays silent abstains: it tells
nothing of a text that others fire on, only silence of all does. Without them
nothing but silence tells how often a lone vote errs, so it counts.
Expectation maximisation runs over counts of vote patterns, of
which there are at most 2^voters whatever the number of texts.
"""

from __future__ import annotations

import numpy as np

SMOOTH = 0.5
ROUNDS = 40


def _joint(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """P(v_i = a, v_j = b), smoothed, as an array [i, j, a, b]."""
    total = weight.sum() + 4 * SMOOTH
    one = np.stack([1 - votes, votes])
    return (np.einsum("ank,bnl,n->klab", one, one, weight, optimize=True) + SMOOTH) / total


def _tree(joint: list[np.ndarray], prior: float) -> list[int]:
    """Parents (-1: root) of the spanning tree with the largest conditional mutual information."""
    k = joint[0].shape[0]
    gain = np.zeros((k, k))
    for j, p in zip(joint, (1 - prior, prior)):
        left, right = j.sum(3, keepdims=True), j.sum(2, keepdims=True)
        gain += p * (j * np.log(j / (left * right))).sum((2, 3))
    parents, inside = [-1] * k, [0]
    while len(inside) < k:
        outside = [i for i in range(k) if i not in inside]
        part = gain[np.ix_(inside, outside)]
        a, b = np.unravel_index(np.argmax(part), part.shape)
        parents[outside[b]] = inside[a]
        inside.append(outside[b])
    return parents


def _log_likelihood(votes: np.ndarray, joint: np.ndarray, parents: list[int], abstain: bool) -> np.ndarray:
    """Of all votes; or, where silence abstains, of the votes that are cast, and of all the silence where none is."""
    cast, silent = np.zeros(len(votes)), np.zeros(len(votes))
    v = votes.astype(int)
    for i, p in enumerate(parents):
        alone = joint[i, i].diagonal()
        table = np.stack([alone, alone]) if p < 0 else joint[p, i]
        table = np.log(table / table.sum(1, keepdims=True))
        before = np.zeros(len(votes), int) if p < 0 else v[:, p]
        cast += np.where(v[:, i] == 1, table[before, 1], 0.0 if abstain else table[before, 0])
        silent += table[0, 0]
    return np.where(v.any(1), cast, silent)


def fit(votes: np.ndarray, counts: np.ndarray, prior: float, known: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """P(class 1) of each pattern row, and the model.

    known: 0 or 1 where a row's class is given, -1 elsewhere. Such rows anchor
    the classes, as nothing else tells how often a voter errs that fires alone;
    all of them together weigh at least as much as the others, whatever the
    numbers. The posterior of a pattern never looks at a given class.
    The start is the share of voters that fire, so class 1 is what voters are for.
    """
    known = np.full(len(votes), -1) if known is None else known
    given, other = counts[known >= 0].sum(), counts[known < 0].sum()
    counts = counts * np.where(known >= 0, max(1.0, other / max(given, 1.0)), 1.0)
    abstain = bool((known >= 0).any())
    fresh = np.clip(votes.mean(1) * 3, 0.02, 0.98)
    parents = [-1] * votes.shape[1]
    for step in range(ROUNDS):
        y = np.where(known >= 0, known, fresh)
        joint = [_joint(votes, counts * (1 - y)), _joint(votes, counts * y)]
        if step in (2, ROUNDS // 2):
            parents = _tree(joint, prior)
        before = fresh
        odds = np.log(prior / (1 - prior)) + _log_likelihood(votes, joint[1], parents, abstain) - _log_likelihood(votes, joint[0], parents, abstain)
        fresh = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(fresh - before).max(initial=0) < 1e-4 and step > ROUNDS // 2:
            break
    return fresh, {"parents": parents, "joint": joint, "prior": prior, "abstain": abstain}


def posterior(votes: np.ndarray, model: dict) -> np.ndarray:
    joint, parents, prior, abstain = (model[k] for k in ("joint", "parents", "prior", "abstain"))
    odds = np.log(prior / (1 - prior)) + _log_likelihood(votes, joint[1], parents, abstain) - _log_likelihood(votes, joint[0], parents, abstain)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def accuracies(model: dict) -> list[tuple[float, float]]:
    """(false alarms, hits) of each voter."""
    return [tuple(float(j[i, i, 1, 1] / (j[i, i, 0, 0] + j[i, i, 1, 1])) for j in model["joint"]) for i in range(len(model["parents"]))]
