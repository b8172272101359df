"""SentencePiece BPE by vectorised merge rounds, exact to the library.

A text is cut where a piece can't reach across (before a space mark that
follows another character, and at characters outside the vocabulary's pieces).
The distinct words of a batch become one flat numpy array of symbols.  Each
round finds the best-ranked pair of every word by a segmented minimum, merges
its leftmost occurrences at once and compacts the array; words without a pair
leave.  The sequential algorithm merges one pair at a time, best score first
and leftmost among equals; so a round stops within a word after the first
merge that forms a pair of equal or better rank than the one being merged.

Defined cases: a null or empty text has no ids and decodes to the empty text;
repeated rows are encoded row by row; other columns are kept; an empty table
stays empty; a text without spaces is one word, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordCache, text_or_empty

MARK = "▁"
NO_PAIR = np.int64(1 << 40)
#: Distinct words that a worker keeps between batches.
CACHE_WORDS = 500_000


class Vocabulary:
    """Pieces of a SentencePiece BPE model as pair tables."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        sp, n = self.library, self.library.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        piece = {sp.id_to_piece(i): i for i in plain}
        self.byte_id = {}
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(sp.id_to_piece(i)[1:-1], 16)] = i
        self.unknown = sp.unk_id()
        self.chars = {p: i for p, i in piece.items() if len(p) == 1}
        score = {i: sp.get_score(i) for i in plain}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        keys, ranks, merged = [], [], []
        for p, i in piece.items():
            for k in range(1, len(p)):
                a, b = piece.get(p[:k], -1), piece.get(p[k:], -1)
                if a >= 0 and b >= 0:
                    keys.append((a << 20) | b)
                    ranks.append(order[score[i]])
                    merged.append(i)
        self._fill(np.array(keys, dtype=np.int64), np.array(ranks, dtype=np.int64), np.array(merged, dtype=np.int64))
        self.first = np.arange(-1, -1 - 0x110000, -1, dtype=np.int64)
        for c, i in self.chars.items():
            self.first[ord(c)] = i
        # Whether a mark may stand inside a piece behind another character.
        self.inner_mark = any(MARK in p.lstrip(MARK) for p in piece)

    def _fill(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """An open-addressing table of the pairs."""
        self.bits = max(10, int(np.ceil(np.log2(max(len(keys), 1) * 16))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.ranks = np.full(size, NO_PAIR, dtype=np.int64)
        self.merged = np.zeros(size, dtype=np.int64)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[at[todo]] < 0]
            slots, which = np.unique(at[free], return_index=True)
            put = free[which]
            self.keys[slots], self.ranks[slots], self.merged[slots] = keys[put], ranks[put], merged[put]
            todo = np.setdiff1d(todo, put)
            at[todo] = (at[todo] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; NO_PAIR where it forms none."""
        key = np.where((a >= 0) & (b >= 0), (a << 20) | np.maximum(b, 0), -2)
        at = self._slot(key)
        rank = np.full(len(key), NO_PAIR)
        piece = np.zeros(len(key), dtype=np.int64)
        found = self.keys[at]
        hit = found == key
        rank[hit], piece[hit] = self.ranks[at[hit]], self.merged[at[hit]]
        todo = np.flatnonzero(~hit & (found >= 0) & (key >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            found = self.keys[at[todo]]
            good = found == key[todo]
            x = todo[good]
            rank[x], piece[x] = self.ranks[at[x]], self.merged[at[x]]
            todo = todo[~good & (found >= 0)]
        return rank, piece


def merge_rounds(vocab: Vocabulary, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges flat symbols, word by word (``word`` is sorted), until no pair remains.

    Returns the symbols and their words, sorted by word.
    """
    done_s, done_w = [], []
    pending = None
    while len(sym):
        if pending is None:
            rank = np.full(len(sym), NO_PAIR)
            piece = np.zeros(len(sym), dtype=np.int64)
            same = np.flatnonzero(word[:-1] == word[1:])
            rank[same], piece[same] = vocab.pairs(sym[same], sym[same + 1])
        else:
            rank, piece = pending
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(sym)])
        open_word = best < NO_PAIR
        if not open_word.all():  # words without a pair leave
            stay = np.repeat(open_word, sizes)
            done_s.append(sym[~stay])
            done_w.append(word[~stay])
            sym, word, rank, piece = sym[stay], word[stay], rank[stay], piece[stay]
            if not len(sym):
                break
            best, sizes = best[open_word], sizes[open_word]
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
        at = np.flatnonzero(rank == np.repeat(best, sizes))
        # Of overlapping occurrences every second one goes, from the left.
        new_run = np.r_[True, np.diff(at) > 1]
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        w = word[at]
        first = np.r_[True, w[1:] != w[:-1]]
        if not first.all():
            c = piece[at]
            left_ok = (at > 0) & (word[np.maximum(at - 1, 0)] == w)
            after_merge = np.r_[False, (np.diff(at) == 2) & ~first[1:]]
            left = np.where(after_merge, np.r_[0, c[:-1]], sym[np.maximum(at - 1, 0)])
            nxt = np.minimum(at + 2, len(sym) - 1)
            right_ok = (at + 2 < len(sym)) & (word[nxt] == w)
            r1, r2 = vocab.pairs(left, c)[0], vocab.pairs(c, sym[nxt])[0]
            mine = rank[at]
            stop = (left_ok & (r1 <= mine)) | (right_ok & (r2 <= mine))
            # Keep each word's merges up to and with the first that stops.
            group = np.cumsum(first) - 1
            before = np.cumsum(stop) - stop
            base = before[np.flatnonzero(first)][group]
            at = at[before == base]
        sym[at] = piece[at]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        changed = np.zeros(len(sym), dtype=bool)
        changed[at] = True
        changed[np.maximum(at - 1, 0)] = True
        # The neighbour on the left may itself have just gone.
        gone_left = at[(at > 1) & ~keep[np.maximum(at - 1, 0)]]
        changed[gone_left - 2] = True
        sym, word, rank, piece, changed = sym[keep], word[keep], rank[keep], piece[keep], changed[keep]
        idx = np.flatnonzero(changed)
        nxt = np.minimum(idx + 1, len(sym) - 1)
        inside = (idx + 1 < len(sym)) & (word[nxt] == word[idx])
        r, p = vocab.pairs(sym[idx], sym[nxt])
        rank[idx] = np.where(inside, r, NO_PAIR)
        piece[idx] = p
        pending = (rank, piece)
    if not done_s:
        return sym, word
    s, w = np.concatenate(done_s), np.concatenate(done_w)
    at = np.argsort(w, kind="stable")
    return s[at], w[at]


def encode_words(vocab: Vocabulary, words: list[str]) -> list[bytes]:
    """Ids of each word (marks in place of spaces), all words at once, as little-endian 32-bit integers."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sym, word = merge_rounds(vocab, vocab.first[points], np.repeat(np.arange(len(words)), sizes))
    low = np.flatnonzero(sym < 0)
    if len(low):  # characters without a piece become their bytes
        spelled = [
            [vocab.byte_id.get(b, vocab.unknown) for b in chr(-1 - x).encode("utf-8", "replace")] if vocab.byte_id else [vocab.unknown]
            for x in sym[low].tolist()
        ]
        n = np.ones(len(sym), dtype=np.int64)
        n[low] = [len(x) for x in spelled]
        start = np.cumsum(n) - n
        sym, word = np.repeat(sym, n), np.repeat(word, n)
        flat = np.concatenate([np.arange(start[k], start[k] + len(x)) for k, x in zip(low.tolist(), spelled, strict=True)])
        sym[flat] = [i for x in spelled for i in x]
    at = (4 * np.searchsorted(word, np.arange(len(words) + 1))).tolist()
    raw = sym.astype("<i4").tobytes()
    return [raw[a:b] for a, b in zip(at, at[1:])]


class Encoder:
    """Texts to ids, with the ids of words it has met."""

    def __init__(self, model_path: str):
        self.vocab = Vocabulary(model_path)
        self.cache = WordCache(lambda words: encode_words(self.vocab, words), CACHE_WORDS)

    def cut(self, text: str) -> list[str]:
        """Words whose ids join to the text's ids: before each run of marks, a cut."""
        if not text:
            return []
        if self.vocab.inner_mark:
            return [MARK + text.replace(" ", MARK)]
        text = text.replace(MARK, " ")
        parts = text.split(" ")
        if "" not in parts:
            return [MARK + p for p in parts]
        out, run = [], 0
        for p in parts:  # an empty part is one more mark of a run
            run += 1
            if p:
                out.append(MARK * run + p)
                run = 0
        if run:
            out.append(MARK * run)
        return out

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for lo in range(0, len(texts), 256):
            cut = [self.cut(t) for t in texts[lo : lo + 256]]
            known = self.cache.get(cut)
            for c in cut:
                yield np.frombuffer(b"".join(map(known, c)), dtype="<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        return self.vocab.library.decode(ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(model_path: str) -> Encoder:
    """This worker's encoder for a model file."""
    if model_path not in _ENCODERS:
        _ENCODERS[model_path] = Encoder(model_path)
    return _ENCODERS[model_path]


def encode_frame(docs: DataFrame, model_path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """ids array<int> and decoded text of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(model_path)
        for b in batches:
            ids = list(e.encode(b["text"].tolist()))
            yield pd.DataFrame({"id": b["id"], "ids": ids, "decoded": [e.decode(x) for x in ids]})

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text")).mapInPandas(
        run, f"id {kind}, ids array<int>, decoded string"
    )


def digest_frame(docs: DataFrame, model_path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of ids and decoded text, formed beside the encoder so that no ids are carried back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(model_path)
        for b in batches:
            count, left, right = [], [], []
            for ids in e.encode(b["text"].tolist()):
                count.append(len(ids))
                left.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                right.append(hashlib.sha256(e.decode(ids).encode("utf-8", "replace")).hexdigest())
            yield pd.DataFrame({"id": b["id"], "n_tokens": count, "ids_sha256": left, "decoded_sha256": right})

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text")).mapInPandas(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
