"""Weak supervision: accuracies of voters that may abstain, by expectation-maximisation over vote patterns."""

from __future__ import annotations

import numpy as np


class VoteModel:
    """Two classes, conditionally independent voters: P(right | class) of those that vote, and the prior of class 1.

    Fitted on distinct vote patterns with their numbers, so its cost doesn't grow with the rows. An
    abstention is no evidence. Rules are made to fail good texts seldom, while a bad text fails a few of
    them, not all: accuracies start at ``start`` for bad and good texts, and each estimate counts the start as
    if ``hold`` rows had shown it, whatever the number of rows, so the data outweigh it. That names the classes, as two classes
    could as well be told the other way round, and gives rules that never vote a value. No votes at all: the start.
    Ties: a posterior of exactly one half counts as good wherever a caller asks for at least one half.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, start: tuple[float, float] = (0.35, 0.98), hold: float = 100.0, rounds: int = 500, prior: float = 0.85):
        votes, n = np.asarray(patterns, dtype=int), np.asarray(counts, dtype=float)
        self.prior = prior
        self.right = np.tile(np.array(start), (votes.shape[1], 1))
        for _ in range(rounds):
            p = self(votes)
            prior2 = float(np.clip(((n * p).sum() + prior * 10) / (n.sum() + 10), 0.02, 0.98))
            right2 = np.empty_like(self.right)
            for c, w in ((0, n * (1 - p)), (1, n * p)):
                good = (w[:, None] * (votes == (1 if c else -1))).sum(axis=0)
                cast = (w[:, None] * (votes != 0)).sum(axis=0)
                right2[:, c] = (good + hold * start[c]) / (cast + hold)
            right2 = np.clip(right2, 0.02, 0.995)
            done = np.abs(right2 - self.right).max(initial=0) + abs(prior2 - self.prior) < 1e-7
            self.right, self.prior = right2, prior2
            if done:
                break

    def __call__(self, votes: np.ndarray) -> np.ndarray:
        """Posterior probability of class 1 for each row of votes."""
        votes = np.asarray(votes, dtype=int)
        bad, good = self.right[:, 0], self.right[:, 1]
        odds = np.where(votes > 0, np.log(good / (1 - bad)), np.where(votes < 0, np.log((1 - good) / bad), 0.0)).sum(axis=1)
        return 1 / (1 + np.exp(-(odds + np.log(self.prior / (1 - self.prior)))))


def pattern_code(votes: np.ndarray) -> np.ndarray:
    """One number for each row of votes, in base 3."""
    return ((np.asarray(votes, dtype=np.int64) + 1) * 3 ** np.arange(votes.shape[1], dtype=np.int64)).sum(axis=1)


def pattern_votes(codes: np.ndarray, voters: int) -> np.ndarray:
    return np.asarray(codes, dtype=np.int64)[:, None] // 3 ** np.arange(voters, dtype=np.int64) % 3 - 1
