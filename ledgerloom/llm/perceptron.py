"""A small averaged perceptron over sparse string features."""

from __future__ import annotations

import random
from collections.abc import Iterable, Sequence


class AveragedPerceptron:
    """Multi-class; weights are averaged over all steps, ties go to the class named first."""

    def __init__(self, classes: Sequence[str]) -> None:
        self.classes = list(classes)
        self.weights: dict[str, dict[str, float]] = {}

    def scores(self, features: Iterable[str]) -> dict[str, float]:
        out = dict.fromkeys(self.classes, 0.0)
        weights = self.weights
        for f in features:
            row = weights.get(f)
            if row:
                for c, w in row.items():
                    out[c] += w
        return out

    def predict(self, features: Iterable[str]) -> str:
        s = self.scores(features)
        return max(self.classes, key=s.__getitem__)

    def train(self, examples: list[tuple[list[str], str]], epochs: int = 5, seed: int = 7, margin: float = 1.0) -> AveragedPerceptron:
        """Updates wherever the true class doesn't lead by ``margin``: a tie is no success, as averages blur it."""
        rng, step = random.Random(seed), 0
        total: dict[tuple[str, str], float] = {}
        since: dict[tuple[str, str], int] = {}
        order = list(range(len(examples)))
        for _ in range(epochs):
            rng.shuffle(order)
            for k in order:
                features, truth = examples[k]
                step += 1
                scores = self.scores(features)
                guess = max((c for c in self.classes if c != truth), key=scores.__getitem__, default=truth)
                if guess == truth or scores[truth] - scores[guess] >= margin:
                    continue
                for f in features:
                    row = self.weights.setdefault(f, {})
                    for c, d in ((truth, 1.0), (guess, -1.0)):
                        old = row.get(c, 0.0)
                        total[f, c] = total.get((f, c), 0.0) + (step - since.get((f, c), 0)) * old
                        since[f, c] = step
                        row[c] = old + d
        for f, row in self.weights.items():
            for c, w in row.items():
                row[c] = (total.get((f, c), 0.0) + (step + 1 - since.get((f, c), 0)) * w) / (step + 1)
        self.weights = {f: kept for f, row in self.weights.items() if (kept := {c: w for c, w in row.items() if w})}
        return self
