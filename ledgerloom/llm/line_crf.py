"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad.  A line's potentials come from features of the line
and of its two neighbours, and a transition matrix ties neighbours' labels.
Forward-backward gives each line's marginal probability of being good; their
mean weighted by line length, through a logistic calibration, is the
document's score.

Only documents are labelled, so line labels are latent in training: all that a
document's label says is that, by length, at least SHARE of its lines have it
in expectation, so a good document may hold bad lines.  The nearest
distribution that keeps this constraint tilts a document's lines by one
multiplier (posterior regularisation), 0 where the model keeps it anyway;
training follows the expected features of the tilted chains less those of the
model's, on a bounded sample, SAMPLE documents a class with all their lines.
Long chains are cut into pieces of PIECE lines for it.
Scoring reads all lines of all documents as whole chains.

Defined cases: a null or empty text, or one of blank lines only, scores the
base rate; without labels every score is 0.5, with one label only near that
label; repeated rows score alike; other columns are kept, but for
``quality_score``, which is set; a text of one line is a chain of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frame, text_or_empty
from .labelled import sample_labels, sampled_texts
from .textscan import byte_values, mix, prefix_hash

SAMPLE = 2000
PIECE = 64
STEPS = 200
SHARE = 0.8
#: Ridge on features, and on transitions: tilting a document as a whole favours chains of one label.
RIDGE, RIDGE_TRANS = 1e-4, 3e-2
CHUNK = 4 << 20
_VALUES = byte_values(31)
_CLASSES = {
    "symbol": b"#*$%&|<>~^=+_@\\",
    "upper": bytes(range(65, 91)),
    "exclaim": b"!",
    "pipe": b"|",
    "digit": b"0123456789",
    "space": b" \t\x0b\x0c\r",
}
_LUT = {k: np.isin(np.arange(256), list(v)).astype(np.int32) for k, v in _CLASSES.items()}
_LUT["chars"] = ((np.arange(256) & 0xC0) != 0x80).astype(np.int32)
_CUTS = (
    ("symbol", (0.02, 0.08, 0.2)), ("upper", (0.15, 0.4, 0.7)), ("exclaim", (0.01, 0.05, 0.15)), ("pipe", (0.005, 0.05)),
    ("digit", (0.1, 0.3)), ("repeat", (0.05, 0.2, 0.5)), ("longword", (9.0, 14.0)), ("short", (0.5,)), ("dup", (0.5,)),
)
OWN = sum(len(c) for _, c in _CUTS)
#: A line's own cuts, those of the line before and after, first, last, constant.
WIDTH = 3 * OWN + 3


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a character other than white space, their text and their length."""
    raw = np.frombuffer(b"".join(t + b"\n" for t in texts), dtype=np.uint8)
    if not len(raw):
        return np.zeros((0, WIDTH), dtype=np.float32), np.zeros(0, dtype=np.int64), np.zeros(0)
    ends = np.flatnonzero(raw == 10)
    start = np.r_[0, ends[:-1] + 1]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(text_ends, ends, side="right")
    counts = {k: np.add.reduceat(lut[raw], start).astype(np.float64) for k, lut in _LUT.items()}
    counts["chars"] -= 1  # the line feed
    solid = counts["chars"] - counts["space"]
    prefix = prefix_hash(raw, _VALUES)
    # Words: equal to one of the two words before, in the same line.
    gap = (_LUT["space"][raw] > 0) | (raw == 10)
    first = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    last = np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
    from .textscan import substring_hash

    h = substring_hash(prefix, first, last)
    line = np.searchsorted(ends, first)
    again = np.zeros(len(h), dtype=bool)
    for back in (1, 2):
        again[back:] |= (h[back:] == h[:-back]) & (line[back:] == line[:-back])
    words = np.bincount(line, minlength=len(ends)).astype(np.float64)
    repeat = np.bincount(line, weights=again, minlength=len(ends))
    whole = mix(substring_hash(prefix, start, ends) + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(whole, kind="stable")
    dup = np.zeros(len(ends), dtype=bool)
    dup[order[1:]] = whole[order[1:]] == whole[order[:-1]]
    keep = solid > 0
    n = np.maximum(solid, 1)
    w = np.maximum(words, 1)
    value = {k: counts[k] / n for k in ("symbol", "upper", "exclaim", "pipe", "digit")}
    value |= {"repeat": repeat / w, "longword": solid / w, "short": (words < 4).astype(float), "dup": dup.astype(float)}
    own = np.stack([(value[k] >= c) for k, cuts in _CUTS for c in cuts], axis=1).astype(np.float32)[keep]
    owner, size = owner[keep], solid[keep]
    m = len(owner)
    x = np.zeros((m, WIDTH), dtype=np.float32)
    x[:, :OWN] = own
    if m:
        is_first = np.r_[True, owner[1:] != owner[:-1]]
        is_last = np.r_[is_first[1:], True]
        x[1:, OWN : 2 * OWN] = own[:-1] * ~is_first[1:, None]
        x[:-1, 2 * OWN : 3 * OWN] = own[1:] * ~is_last[:-1, None]
        x[:, -3], x[:, -2], x[:, -1] = is_first, is_last, 1
    return x, owner, size


def _by_step(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains sorted from long to short: first line and length of each, longest first."""
    if not len(owner):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    size = np.diff(np.r_[first, len(owner)])
    order = np.argsort(-size, kind="stable")
    return first[order], size[order], owner[first][order]


def forward_backward(score: np.ndarray, owner: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of good for every line, expected transitions, and the sum of log partition functions.

    ``score``: good minus bad log potential of each line.  Chains advance side
    by side, longest first, so a step works on the chains that still have lines.
    """
    first, size, _ = _by_step(owner)
    n = len(score)
    e = np.zeros((n, 2))
    e[:, 1] = score
    alpha, beta, edges = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((2, 2))
    if not n:
        return np.zeros(0), edges, 0.0
    steps = int(size[0])
    live = np.searchsorted(-size, -np.arange(steps), side="left")  # chains with more than s lines
    alpha[first] = e[first]
    for s in range(1, steps):
        at = first[: live[s]] + s
        m = alpha[at - 1][:, :, None] + trans
        alpha[at] = np.logaddexp(m[:, 0], m[:, 1]) + e[at]
    for s in range(steps - 1, 0, -1):
        at = first[: live[s]] + s
        m = trans + (e[at] + beta[at])[:, None, :]
        beta[at - 1] = np.logaddexp(m[:, :, 0], m[:, :, 1])
    last = first + size - 1
    z = np.logaddexp(alpha[last][:, 0], alpha[last][:, 1])
    zs = np.zeros(n)
    zs[np.r_[first]] = z
    chain = np.cumsum(np.r_[True, owner[1:] != owner[:-1]]) - 1
    by_chain = zs[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])][chain]
    inner = np.flatnonzero(np.r_[False, owner[1:] == owner[:-1]])
    if len(inner):
        m = alpha[inner - 1][:, :, None] + trans + (e[inner] + beta[inner])[:, None, :] - by_chain[inner][:, None, None]
        edges = np.exp(m).sum(axis=0)
    good = np.exp(alpha[:, 1] + beta[:, 1] - by_chain)
    return good, edges, float(z.sum())


class LineCrf:
    """Weights, transitions, and the document calibration."""

    def __init__(self) -> None:
        self.w = np.zeros(WIDTH)
        self.trans = np.zeros((2, 2))
        self.slope, self.offset, self.base = 1.0, 0.0, 0.5

    def fit(self, patterns: np.ndarray, line: np.ndarray, doc: np.ndarray, size: np.ndarray, label: np.ndarray, steps: int = STEPS) -> None:
        """Adam on theta, with a small ridge, and dual ascent on the documents' multipliers.

        ``patterns``: the different feature rows; ``line``, ``doc``, ``size``:
        which of them each line has, its document, its length; ``label``: of
        each document.
        """
        x = patterns.astype(np.float64)
        n, kinds = len(line), len(x)
        count = np.bincount(doc, minlength=len(label))
        at = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
        owner = doc * (int(at.max(initial=0)) // PIECE + 1) + at // PIECE
        part = size / np.bincount(doc, weights=size)[doc]
        sign = np.where(label == 1, 1.0, -1.0)
        theta, ridge = np.zeros(WIDTH + 4), np.r_[np.full(WIDTH, RIDGE), np.full(4, RIDGE_TRANS)]
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        pull = np.zeros(len(label))
        for t in range(1, steps + 1):
            score, trans = (x @ theta[:WIDTH])[line], theta[WIDTH:].reshape(2, 2)
            good, edges, _ = forward_backward(score, owner, trans)
            told, told_edges, _ = forward_backward(score + (sign * pull)[doc] * part * count[doc], owner, trans)
            share = np.bincount(doc, weights=np.where(label[doc] == 1, told, 1 - told) * part, minlength=len(label))
            pull = np.maximum(pull + 2 * (SHARE - share), 0)
            lines = np.bincount(line, weights=told - good, minlength=kinds)
            grad = np.r_[x.T @ lines, (told_edges - edges).ravel()] / max(n, 1) - ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta += 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w, self.trans = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)

    def lines(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each line's marginal probability of being good, its text and its length."""
        x, owner, size = line_features(texts)
        good, _, _ = forward_backward(x.astype(np.float64) @ self.w, owner, self.trans)
        return good, owner, size

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Length-weighted mean marginal of each text, and whether it has a line."""
        good, owner, size = self.lines(texts)
        total = np.bincount(owner, weights=size, minlength=len(texts))
        mean = np.bincount(owner, weights=size * good, minlength=len(texts)) / np.maximum(total, 1)
        return mean, total > 0

    def calibrate(self, mean: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Weighted logistic regression of the label on the mean's log odds, by Newton steps."""
        z = _logit(mean)
        a = np.stack([z, np.ones_like(z)], axis=1)
        theta = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
            g = a.T @ (weight * (y - p)) - np.array([1e-2 * (theta[0] - 1), 1e-2 * theta[1]])
            h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
            theta = theta + np.clip(np.linalg.solve(h, g), -1, 1)
        self.slope, self.offset = max(theta[0], 0.05), theta[1]

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.base)
        lo, held = 0, 0
        for i, t in enumerate(texts):
            held += len(t) + 1
            if held >= CHUNK or i == len(texts) - 1:
                mean, has = self.documents(texts[lo : i + 1])
                p = 1 / (1 + np.exp(-np.clip(self.slope * _logit(mean) + self.offset, -30, 30)))
                out[lo : i + 1] = np.where(has, p, self.base)
                lo, held = i + 1, 0
        return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", label: str = "quality") -> LineCrf:
    """A model from a bounded sample; 2 * SAMPLE texts at most reach the driver, as 16 bytes a line."""
    sample, weights = sample_labels(labels, label, train, SAMPLE)
    texts = sampled_texts(docs, sample, text)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, y, t in zip(b["doc_id"].tolist(), b["label"].tolist(), b["text"], strict=True):
                x, _, size = line_features([t.encode("utf-8", "replace")])
                bits = np.packbits(np.pad(x.astype(bool), ((0, 0), (0, 64 - WIDTH))), axis=1)
                yield frame(label=[y], bits=[bits.tobytes()], size=[size.tobytes()], key=[str(i)])

    rows = texts.mapInPandas(extract, "label int, bits binary, size binary, key string").collect()
    rows = sorted((r for r in rows if r["bits"]), key=lambda r: (r["key"], r["label"], bytes(r["bits"])))
    model = LineCrf()
    have = {r["label"] for r in rows}
    if not rows:
        return model
    total = sum(weights[r["label"]] for r in rows)
    model.base = sum(weights[r["label"]] for r in rows if r["label"]) / total
    if len(have) < 2:
        model.offset = 10.0 if have == {1} else -10.0
        return model
    codes, line = np.unique(np.concatenate([np.frombuffer(bytes(r["bits"]), dtype=">u8") for r in rows]), return_inverse=True)
    patterns = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, :WIDTH]
    n = np.array([len(r["bits"]) // 8 for r in rows])
    owner = np.repeat(np.arange(len(rows)), n)
    y = np.array([r["label"] for r in rows])
    size = np.concatenate([np.frombuffer(bytes(r["size"]), dtype=np.float64) for r in rows])
    model.fit(patterns, line, owner, size, y)
    good, _, _ = forward_backward((patterns @ model.w)[line], owner, model.trans)
    mean = np.bincount(owner, weights=size * good) / np.bincount(owner, weights=size)
    model.calibrate(mean, y, np.array([weights[k] for k in y]))
    return model


def score_lines(docs: DataFrame, model: LineCrf, text: str = "text") -> DataFrame:
    """Adds ``quality_score`` to every row; the model is a few hundred numbers at any size."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score([t.encode("utf-8", "replace") for t in texts]))

    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "quality_score"]
    return docs.select(F.struct(*rest).alias("row"), score(text_or_empty(text)).alias("quality_score")).select("row.*", "quality_score")
