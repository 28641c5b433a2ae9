"""A small character convolutional network in numpy: bytes -> embedding -> convolution -> maximum -> logit."""

import numpy as np


class CharNet:
    def __init__(self, width: int = 96, embedding: int = 8, filters: int = 24, span: int = 5, seed: int = 11):
        random = np.random.default_rng(seed)
        self.width, self.span = width, span
        scale = lambda *shape: (random.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        # Each byte also says whether it belongs to the candidate or to the text around it.
        self.p = {
            "embed": (random.standard_normal((512, embedding)) * 0.3).astype(np.float32),
            "conv": scale(span * embedding, filters), "conv_bias": np.zeros(filters, np.float32),
            "out": scale(2 * filters, 1)[:, 0], "out_bias": np.zeros(1, np.float32),
        }
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        self.slope, self.offset = 1.0, 0.0

    def _forward(self, codes: np.ndarray):
        embedded = self.p["embed"][codes]
        rows, width, size = embedded.shape
        places = width - self.span + 1
        patches = np.concatenate([embedded[:, i : i + places] for i in range(self.span)], axis=2)
        hidden = np.maximum(patches @ self.p["conv"] + self.p["conv_bias"], 0)
        best = hidden.argmax(axis=1)
        top = np.take_along_axis(hidden, best[:, None], 1)[:, 0]
        pooled = np.concatenate([top, hidden.mean(axis=1)], axis=1)
        return patches, hidden, best, pooled, pooled @ self.p["out"] + self.p["out_bias"][0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[i : i + 256])[4] for i in range(0, len(codes), 256)]
        return np.concatenate(parts) if parts else np.zeros(0, np.float32)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(codes) + self.offset)))

    def vector(self) -> np.ndarray:
        """All weights and the moments of their gradients in one row."""
        return np.concatenate([value.ravel() for part in (self.p, self.first, self.second) for value in part.values()])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for part in (self.p, self.first, self.second):
            for key, value in part.items():
                part[key] = np.array(vector[at : at + value.size], dtype=np.float32).reshape(value.shape)
                at += value.size

    def fit(
        self, codes: np.ndarray, labels: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 5, share: float | None = None, done: int = 0
    ) -> None:
        """Goes on after the epochs that are `done`. `share` is that of the positives in all rows, if these are only some of them."""
        random = np.random.default_rng(seed)
        if not done:
            self.first, self.second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        first, second = self.first, self.second
        share = labels.mean() if share is None else share
        weight = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        step = done * -(-len(codes) // 128)
        for epoch in range(done + epochs):
            order = random.permutation(len(codes))
            if epoch < done:
                continue
            for i in range(0, len(order), 128):
                rows = order[i : i + 128]
                gradient = self._gradient(codes[rows], labels[rows], weight[rows])
                step += 1
                for key, value in gradient.items():
                    first[key] += 0.1 * (value - first[key])
                    second[key] += 0.001 * (value * value - second[key])
                    move = first[key] / (1 - 0.9**step) / (np.sqrt(second[key] / (1 - 0.999**step)) + 1e-8)
                    self.p[key] -= (rate * move).astype(np.float32)

    def _gradient(self, codes, labels, weight):
        patches, hidden, best, pooled, logit = self._forward(codes)
        rows, places, filters = hidden.shape
        error = ((1 / (1 + np.exp(-logit)) - labels) * weight / rows).astype(np.float32)
        back = error[:, None] * self.p["out"]
        through = np.repeat(back[:, None, filters:] / places, places, axis=1)
        np.put_along_axis(through, best[:, None], np.take_along_axis(through, best[:, None], 1) + back[:, None, :filters], 1)
        through *= hidden > 0
        flat = through.reshape(-1, filters)
        below = (flat @ self.p["conv"].T).reshape(rows, places, self.span, -1)
        through_embed = np.zeros((rows, codes.shape[1], below.shape[3]))
        for i in range(self.span):
            through_embed[:, i : i + places] += below[:, :, i]
        flat_codes, size = codes.ravel(), below.shape[3]
        embed = np.stack(
            [np.bincount(flat_codes, through_embed[:, :, d].ravel(), len(self.p["embed"])) for d in range(size)], axis=1
        )
        return {
            "embed": embed, "conv": patches.reshape(len(flat), -1).T @ flat, "conv_bias": flat.sum(axis=0),
            "out": pooled.T @ error, "out_bias": np.array([error.sum()]),
        }

    def calibrate(self, codes: np.ndarray, labels: np.ndarray) -> None:
        """Platt scaling on rows that were not fitted."""
        self.calibrate_logits(self.logits(codes), labels, np.ones(len(labels)))

    def calibrate_logits(self, logits: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> None:
        """The same on their logits, each met `counts` times, by Newton steps that are halved while they do not help."""
        logits, positives = logits.astype(np.float64), (counts * labels).sum()
        scale = max(float(np.abs(logits).max()), 1e-6)
        target = np.where(labels == 1, (positives + 1) / (positives + 2), 1 / (counts.sum() - positives + 2))
        x = np.stack([logits / scale, np.ones_like(logits)], axis=1)

        def loss(beta):
            z = x @ beta
            return float(np.sum(counts * (np.logaddexp(0, z) - target * z))) + 0.5e-3 * float(beta @ beta)

        beta = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            hessian = (x * (counts * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(hessian, x.T @ (counts * (p - target)) + 1e-3 * beta)
            while loss(beta - step) > loss(beta) and np.abs(step).max() > 1e-9:
                step /= 2
            beta = beta - step
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.offset = float(max(beta[0] / scale, 1e-3)), float(beta[1])


def recall_threshold(probability: np.ndarray, labels: np.ndarray, recall: float, counts: np.ndarray | None = None) -> float:
    """The highest threshold that still finds the wanted share of the positives, each met `counts` times."""
    found = labels == 1
    if not found.any():
        return 1.0
    order = np.argsort(probability[found], kind="stable")
    upto = np.cumsum((np.ones(len(labels)) if counts is None else counts)[found][order])
    missed = int(np.floor((1 - recall) * upto[-1]))
    return float(probability[found][order][np.searchsorted(upto, missed, side="right")])
