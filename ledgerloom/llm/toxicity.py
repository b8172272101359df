"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Every word of the sampled examples is a term.  A vector holds (1 + log TF) *
IDF * factor, scaled to unit length: IDF counts all documents of the table, and
the factor, 1 for most words, grows with how far a word's presence among the
sampled examples departs from independence of the label, in either direction
(supervised term weighting).  The examples form an inverted index in blocks
with the largest weight of each (term, block).  A search adds up those maxima
into upper bounds, scores the blocks of the highest bounds, then all others
whose bound can still better the k-th neighbour, so the k neighbours are exact.
Their votes count by similarity and by what an example stands for in its class,
drawn to the base rate by one vote's worth; a logistic fit on the examples' own
votes, each without itself, turns the share of votes into a score between 0 and
1.  The examples are its evidence.

Bound: SAMPLE examples a class; the terms are theirs.  What reaches the driver
are those examples as packed vectors and one count for each of their terms.

Defined cases: a null or empty text, like any without a term that an example
has, scores the share of toxic rows and has no evidence; without labels the
score is 0; with one label only it is that label's rate; repeated rows score
alike; ties go to the earlier example; other columns are kept, but for
``toxicity`` and ``evidence``, which are set.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frame, release_memory, text_or_empty
from .labelled import sample_labels, sampled_texts

SAMPLE = 1000
NEIGHBOURS = 15
BLOCK = 64
#: Blocks that a search scores before it looks at the k-th neighbour.
FIRST = 4
#: Share of the examples from which on a term's postings are a full row.
COMMON = 0.25
#: Deviations of a word's association with the label that chance may bring about among many words.
CHANCE = 4.0
#: A vote counts as this power of the similarity.
POWER = 2.0
#: Examples of a class whose own votes the logistic fit looks at.
FITTED = 500
#: Every ASCII byte but letters parts words; what isn't ASCII belongs to them.
_PARTS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The lower-case words of a text in UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(_PARTS).split()


def terms_of(text: str) -> Counter:
    return Counter(words_of(text))


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end), one range after the other."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _alike(ptr: np.ndarray, terms: np.ndarray, weights: np.ndarray, block: int) -> list[int]:
    """The examples in an order that puts similar ones together: halves by the main direction of their hashed vectors."""
    n, width = len(ptr) - 1, 64
    h = terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    emb = np.zeros((n, width))
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    np.add.at(emb, (np.repeat(np.arange(n), np.diff(ptr)), ((h >> np.uint64(40)) % np.uint64(width)).astype(np.int64)), sign * weights)
    out: list[int] = []
    todo = [np.arange(n)]
    while todo:
        part = todo.pop()
        if len(part) <= block:
            out += part.tolist()
            continue
        x = emb[part] - emb[part].mean(axis=0)
        v = np.ones(width)
        for _ in range(8):
            v = x.T @ (x @ v) + 1e-12
            v /= np.sqrt(v @ v)
        part = part[np.lexsort((part, x @ v))]
        half = block * max(1, round(len(part) / 2 / block))
        todo += [part[half:], part[:half]]
    return out


class BlockMaxIndex:
    """Unit vectors in blocks, with each block's largest weight for every term.

    Postings of terms that COMMON of the examples have are kept as full rows,
    whose product with a query is cheaper than walking them.
    """

    def __init__(self, vectors: Iterable[dict[int, float]], n_terms: int, block: int = BLOCK):
        rows = [(np.fromiter(v.keys(), dtype=np.int32, count=len(v)), np.fromiter(v.values(), dtype=np.float64, count=len(v))) for v in vectors]
        self.size, self.block, self.n_blocks = len(rows), block, -(-len(rows) // block)
        ptr = np.cumsum([0, *(len(t) for t, _ in rows)])
        terms = np.concatenate([t for t, _ in rows]) if rows else np.zeros(0, dtype=np.int32)
        weights = np.concatenate([w for _, w in rows]) if rows else np.zeros(0)
        order = _alike(ptr, terms, weights, block)
        self.order = np.array(order, dtype=np.int64)
        place = np.empty(self.size, dtype=np.int64)
        place[self.order] = np.arange(self.size)
        many = np.bincount(terms, minlength=n_terms) > COMMON * max(self.size, 1)
        self.full_row = np.where(many, np.cumsum(many) - 1, -1)
        full = many[terms]
        owner = np.repeat(np.arange(self.size), np.diff(ptr))
        self.full = np.zeros((int(many.sum()), self.size))
        self.full[self.full_row[terms[full]], place[owner[full]]] = weights[full]
        starts = np.arange(0, self.size, block)
        self.full_maximum = np.maximum.reduceat(self.full, starts, axis=1) if self.size and len(self.full) else np.zeros((len(self.full), self.n_blocks))
        terms, weights, owner = terms[~full], weights[~full], owner[~full]
        where = place[owner]
        by = np.lexsort((where, terms))
        self.example, self.weight = where[by], weights[by]
        terms, blocks = terms[by], self.example // block
        # An entry for each (term, block): where its postings start, and their largest weight.
        new = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])]) if len(terms) else np.zeros(0, dtype=np.int64)
        self.start = np.r_[new, len(terms)]
        self.entry_block = blocks[new]
        self.maximum = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.of_term = np.searchsorted(terms[new], np.arange(n_terms + 1))

    def _add(self, score: np.ndarray, entries: np.ndarray, weights: np.ndarray) -> None:
        start, end = self.start[entries], self.start[entries + 1]
        at = _ranges(start, end)
        score += np.bincount(self.example[at], weights=np.repeat(weights, end - start) * self.weight[at], minlength=self.size)

    def search(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k best (similarity, example), best first, ties to the earlier example; none at 0, nor ``without``."""
        return self.nearest(np.fromiter(query, dtype=np.int64), np.fromiter(query.values(), dtype=np.float64), k, without)

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        if not len(terms) or not self.size:
            return []
        row = self.full_row[terms]
        full = row >= 0
        query = np.zeros(len(self.full))
        query[row[full]] = values[full]
        terms, values = terms[~full], values[~full]
        first, last = self.of_term[terms], self.of_term[terms + 1]
        entries = _ranges(first, last)
        weights = np.repeat(values, last - first)
        blocks = self.entry_block[entries]
        bound = query @ self.full_maximum + np.bincount(blocks, weights=weights * self.maximum[entries], minlength=self.n_blocks)
        score = query @ self.full
        of = np.arange(self.size) // self.block
        open_ = np.zeros(self.n_blocks, dtype=bool)
        open_[np.argsort(-bound, kind="stable")[:FIRST]] = True
        mask = open_[blocks]
        self._add(score, entries[mask], weights[mask])
        best = self._best(np.where(open_[of], score, 0.0), k, without)
        least = best[-1][0] - 1e-12 if len(best) == k else 0.0
        more = ~open_ & (bound > 0) & (bound >= least)
        if more.any():
            mask = more[blocks]
            self._add(score, entries[mask], weights[mask])
            best = self._best(np.where((open_ | more)[of], score, 0.0), k, without)
        return best

    def _best(self, score: np.ndarray, k: int, without: int) -> list[tuple[float, int]]:
        if len(score) > k + 1:
            least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            at = np.flatnonzero((score > 0) & (score >= least))
        else:
            at = np.flatnonzero(score > 0)
        found = sorted((-s, i) for s, i in zip(score[at].tolist(), self.order[at].tolist(), strict=True) if i != without)
        return [(-s, i) for s, i in found[:k]]


class ToxicityModel:
    """Terms with their weights, the examples' index, and the logistic fit of their votes."""

    def __init__(self, terms: list[bytes], value: np.ndarray, examples: list[tuple[int, int, dict[int, float]]], weights: dict[int, float], base: float):
        self.terms = {t: i for i, t in enumerate(terms)}
        self.value = value
        self.ids = [i for i, _, _ in examples]
        self.label = [y for _, y, _ in examples]
        self.index = BlockMaxIndex((v for _, _, v in examples), len(terms))
        self.weights, self.base = weights, base
        self.slope, self.offset = 1.0, 0.0
        self.prior = 1.0  # weight of the vote at the base rate: that of a usual neighbour

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms of a text and their weights, at unit length."""
        at = np.sort(np.array(list(map(self.terms.get, words_of(text), repeat(-1))), dtype=np.int64))
        at = at[np.searchsorted(at, 0) :]
        new = np.flatnonzero(np.diff(at, prepend=-1))
        terms = at[new]
        return terms, weighed(terms, np.diff(new, append=len(at)), self.value)

    def share(self, near: list[tuple[float, int]]) -> float:
        """Toxic share of the neighbours' votes and of one usual vote more at the base rate."""
        votes = [(s**POWER * self.weights[self.label[i]], self.label[i]) for s, i in near]
        return (sum(w for w, y in votes if y) + self.prior * self.base) / (sum(w for w, _ in votes) + self.prior)

    def calibrate(self, vectors: list[dict[int, float]], k: int) -> None:
        """Logistic fit of the label on the log odds of the share, over examples that don't see themselves."""
        at = [i for c in (0, 1) for i in [j for j, y in enumerate(self.label) if y == c][:FITTED]]
        found = [(i, near) for i in at if (near := self.index.search(vectors[i], k, without=i))]
        if len({self.label[i] for i, _ in found}) < 2:
            return
        self.prior = float(np.median([s**POWER * self.weights[self.label[j]] for _, near in found for s, j in near]))
        z = [_logit(self.share(near)) for _, near in found]
        y, w = [self.label[i] for i, _ in found], [self.weights[self.label[i]] for i, _ in found]
        a, y, w = np.stack([np.array(z), np.ones(len(z))], axis=1), np.array(y), np.array(w) / np.mean(w)
        theta = np.array([1.0, 0.0])
        for _ in range(30):  # damped Newton steps with a small ridge towards the plain share
            p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
            g = a.T @ (w * (y - p)) - np.array([theta[0] - 1, theta[1]])
            h = (a * (w * p * (1 - p))[:, None]).T @ a + np.eye(2)
            theta = theta + np.clip(np.linalg.solve(h, g), -1, 1)
        self.slope, self.offset = max(float(theta[0]), 0.05), float(theta[1])

    def score(self, text: str, k: int) -> tuple[float, str]:
        near = self.index.nearest(*self.vector(text), k)
        if not near:
            return self.base, ""
        z = self.slope * _logit(self.share(near)) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), ",".join(str(self.ids[i]) for _, i in near[:5])


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def weighed(terms: np.ndarray, counts: np.ndarray, value: np.ndarray) -> np.ndarray:
    """(1 + log TF) * value of each term, at unit length."""
    v = (1 + np.log(counts)) * value[terms]
    return v / np.sqrt(v @ v) if len(v) else v


def association(with_toxic: np.ndarray, with_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Factor of each term: 1 up to CHANCE deviations from independence (root of chi-square), and their excess more beyond."""
    a, b = with_toxic.astype(float), with_clean.astype(float)
    c, d = toxic - a, clean - b
    below = (a + b) * (c + d) * (a + c) * (b + d)
    z = np.abs(a * d - b * c) * np.sqrt(np.divide(toxic + clean, below, out=np.zeros_like(a), where=below > 0))
    return 1 + np.maximum(z - CHANCE, 0)


def fit(docs: DataFrame, labels: DataFrame, train: Column, text: str = "text", label: str = "toxic", k: int = NEIGHBOURS) -> ToxicityModel:
    """Examples from a bounded sample; document frequencies of their terms over all of ``docs``."""
    sample, weights = sample_labels(labels, label, train, SAMPLE)
    texts = sampled_texts(docs, sample, text)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [terms_of(t) for t in b["text"]]
            yield frame(doc_id=b["doc_id"], label=b["label"], words=[b" ".join(c) for c in found], counts=[np.fromiter(c.values(), dtype=np.int32).tobytes() for c in found])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInPandas(bags, f"doc_id {kind}, label int, words binary, counts binary").collect()
    rows.sort(key=lambda r: (str(r["doc_id"]), r["label"], bytes(r["words"])))
    terms = sorted({w for r in rows for w in bytes(r["words"]).split()})
    table = {t: i for i, t in enumerate(terms)}
    bag = [(np.array([table[w] for w in bytes(r["words"]).split()], dtype=np.int64), np.frombuffer(bytes(r["counts"]), dtype=np.int32)) for r in rows]
    y = np.array([r["label"] for r in rows], dtype=np.int64)
    seen = np.zeros((2, len(terms)), dtype=np.int64)
    for (t, _), label_of in zip(bag, y, strict=True):
        seen[label_of, t] += 1
    df, n = document_frequencies(docs, text, table)
    n_of = [int((y == c).sum()) for c in (0, 1)]
    value = (np.log((1 + n) / (1 + df)) + 1) * association(seen[1], seen[0], n_of[1], n_of[0])
    total = sum(weights[c] * n_of[c] for c in (0, 1))
    base = weights[1] * n_of[1] / total if total else 0.0
    vectors = []
    for t, c in bag:
        vectors.append(dict(sorted(zip(t.tolist(), weighed(t, c, value).tolist(), strict=True))))
    model = ToxicityModel(terms, value, [(r["doc_id"], r["label"], v) for r, v in zip(rows, vectors, strict=True)], weights, base)
    model.calibrate(vectors, k)
    return model


def document_frequencies(docs: DataFrame, text: str, table: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many texts each term stands, and how many texts there are; a row for each term and task is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        names, seen, n = known.keys(), Counter(), 0
        for b in batches:
            n += len(b)
            for t in b["text"]:
                seen.update(names & set(words_of(t)))
        at = np.fromiter((known[w] for w in seen), dtype=np.int32, count=len(seen))
        yield frame(term=np.r_[at, -1].astype(np.int32), n=np.r_[np.fromiter(seen.values(), dtype=np.int64, count=len(seen)), n])
        del seen
        release_memory()

    parts = docs.select(text_or_empty(text).alias("text")).mapInPandas(count, "term int, n long")
    got = parts.groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(table), dtype=np.int64)
    own = got[got["term"] >= 0]
    df[own["term"].to_numpy()] = own["n"].to_numpy()
    shared.destroy()
    return df, int(got.loc[got["term"] < 0, "n"].sum())


def score_rows(docs: DataFrame, model: ToxicityModel, text: str = "text", k: int = NEIGHBOURS) -> DataFrame:
    """(row, tox): the table's own row, and its ``toxicity`` with ``evidence`` (ids of the nearest examples)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("toxicity double, evidence string")
    def score(texts: pd.Series) -> pd.DataFrame:
        known: dict[str, tuple[float, str]] = {}  # copies within a batch are scored once
        rows = []
        for t in texts:
            if t not in known:
                known[t] = shared.value.score(t, k)
            rows.append(known[t])
        return frame(toxicity=np.array([s for s, _ in rows], dtype=np.float64), evidence=[e for _, e in rows])

    return docs.select(F.struct("*").alias("row"), score(text_or_empty(text)).alias("tox"))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", k: int = NEIGHBOURS) -> DataFrame:
    """Adds ``toxicity`` and ``evidence`` to every row."""
    scored = score_rows(docs, model, text, k)
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("toxicity", "evidence")]
    return scored.select(*rest, "tox.toxicity", "tox.evidence")
