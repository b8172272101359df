"""Best-fit packing with large-item matching, over a histogram of lengths.

Only as many lengths as the capacity exist, so packing is planned on counts:
one small table at any input size.  Items above half the capacity open a bin
each; items above a third pair with them, or with one another, at most two such
items to a bin; smaller items then go best-fit into the gaps.  A plan step
stands for many equal bins at once, so the plan has a few entries for each
length, however many documents there are.

Items take their places by their rank within their length.  Ranks come from
counts for each (task, length) and the prefix sums of those, so no length,
however common, meets in one task.

Defined cases: a null text is an empty one and gives one piece with the closing
id; an empty table gives no pieces; repeated rows are packed row by row; ties
go to the longer item and the lower step.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordCache, materialize, text_or_empty

CAPACITY = 2048
#: Chunks of text whose ids a worker keeps between batches.
CACHE_CHUNKS = 700_000
#: Chunks that a tokenizer takes together.
TOGETHER = 1000
#: What characters are to a tokenizer that cuts into runs of letters, single digits and runs of anything else: 0 space, 1 letter, 2 digit, 3 else, 4 not sure.
_CLASS = np.array([0 if chr(i) in " \t\n\v\f\r" else 4 if chr(i).isspace() else {"L": 1, "N": 2, "C": 4}.get(unicodedata.category(chr(i))[0], 3) for i in range(256)], dtype=np.int8)
#: Cuts that the counting of pieces knows.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class ChunkTokenizer:
    """Ids of whole texts by a tokenizer that never reaches across white space.

    Texts are cut at spaces and line feeds; chunks met for the first time go
    through the tokenizer together.  Where the last token of every piece of a
    chunk is marked as such, counting the pieces tells chunks apart; else, and
    for chunks beyond Latin-1 or with an apostrophe, a special token parts them.
    """

    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fence_text = "<|endoftext|>"
        self.fence = self.tokenizer.token_to_id(self.fence_text)
        self.last = self._last_tokens()
        self.cache = WordCache(self._learn, limit)

    def _last_tokens(self) -> np.ndarray | None:
        """Which tokens end a piece, None where tokens don't tell or pieces aren't those that ``_learn_counted`` counts."""
        given = json.loads(self.tokenizer.to_str())
        end = given["model"].get("end_of_word_suffix")
        cuts = [x.get("pattern", {}).get("Regex") for x in (given.get("pre_tokenizer") or {}).get("pretokenizers", ())]
        if not end or cuts != [_CUTS, None]:
            return None
        out = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        out[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(end)]] = True
        return out

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, chunks: list[str]) -> list[bytes]:
        if self.last is None:
            return self._learn_fenced(chunks)
        plain, other = [], []
        for c in chunks:
            (other if not c.isascii() and max(c) > "\xff" or "'" in c or "<|" in c else plain).append(c)
        known = dict(zip(plain, self._learn_counted(plain), strict=True))
        known.update(zip(other, self._learn_fenced(other), strict=True))
        return [known[c] for c in chunks]

    def _learn_counted(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(chunks), TOGETHER):
            part = chunks[lo : lo + TOGETHER]
            joined = " ".join(part)
            kind = _CLASS[np.frombuffer(joined.encode("latin-1"), dtype=np.uint8)]
            starts = (kind == 2) | ((kind != 0) & np.r_[True, kind[1:] != kind[:-1]][: len(kind)])
            pieces = np.r_[0, np.cumsum(starts)][np.cumsum([len(c) + 1 for c in part]) - 1]
            ids = self._ids(joined)
            ends = np.r_[0, np.flatnonzero(self.last[ids]) + 1]
            if (kind == 4).any() or len(ends) != pieces[-1] + 1 or ends[-1] != len(ids):  # controls, or a piece whose last token isn't marked
                out += self._learn_fenced(part)
                continue
            raw, at = ids.tobytes(), 0
            for end in (4 * ends[pieces]).tolist():
                out.append(raw[at:end])
                at = end
        return out

    def _learn_fenced(self, chunks: list[str]) -> list[bytes]:
        odd = {c: self._ids(c).tobytes() for c in chunks if "<|" in c}  # a special token in a text is one there too
        plain = [c for c in chunks if c not in odd]
        out: list[bytes] = []
        for lo in range(0, len(plain), TOGETHER):
            part = plain[lo : lo + TOGETHER]
            ids = self._ids(f" {self.fence_text} ".join(part))
            cut = np.flatnonzero(ids == self.fence)
            assert len(cut) == len(part) - 1
            raw, at = ids.tobytes(), 0
            for end in (4 * np.r_[cut, len(ids)]).tolist():
                out.append(raw[at:end])
                at = end + 4
        known = iter(out)
        return [odd[c] if c in odd else next(known) for c in chunks]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for lo in range(0, len(texts), 256):
            cut = [t.replace("\n", " ").split(" ") for t in texts[lo : lo + 256]]
            known = self.cache.get(cut)
            for c in cut:
                yield b"".join(map(known, c))


_TOKENIZERS: dict[tuple[str, int], ChunkTokenizer] = {}


def tokenizer(path: str, limit: int = CACHE_CHUNKS) -> ChunkTokenizer:
    key = (path, limit)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = ChunkTokenizer(path, limit)
    return _TOKENIZERS[key]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """How to pack ``counts[length]`` items of every length.

    Returns entries (length, first rank, items, first bin, copies in a bin,
    offset): the items of that length with ranks from ``first rank`` on fill
    bins from ``first bin`` on, ``copies`` side by side from ``offset``.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    used = dict.fromkeys(left, 0)
    entries: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    #: Gap -> groups of equal bins (first bin, how many).
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []

    def add_gap(gap: int, first: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            heapq.heappush(gaps[gap], (first, n))

    def take(length: int, n: int, first: int, copies: int, offset: int) -> None:
        entries.append((length, used[length], n * copies, first, copies, offset))
        used[length] += n * copies
        left[length] -= n * copies

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    small = sorted((x for x in left if 3 * x <= capacity), reverse=True)
    mids = sorted(x for x in large if 2 * x <= capacity)
    # Above half the capacity: each takes the longest partner above a third that fits.
    for x in (x for x in large if 2 * x > capacity):
        while left[x]:
            k = bisect_right(mids, capacity - x) - 1
            while k >= 0 and not left[mids[k]]:
                mids.pop(k)
                k -= 1
            if k < 0:
                n = left[x]
                take(x, n, bins, 1, 0)
                add_gap(capacity - x, bins, n)
            else:
                y = mids[k]
                n = min(left[x], left[y])
                take(x, n, bins, 1, 0)
                take(y, n, bins, 1, x)
                add_gap(capacity - x - y, bins, n)
            bins += n
    # What is left between a third and a half pairs with its like, longest first.
    carry = 0
    for x in sorted((x for x in mids if left[x]), reverse=True):
        if carry:
            take(x, 1, bins - 1, 1, carry)
            add_gap(capacity - carry - x, bins - 1, 1)
            carry = 0
        n = left[x] // 2
        if n:
            take(x, n, bins, 2, 0)
            add_gap(capacity - 2 * x, bins, n)
            bins += n
        if left[x]:
            take(x, 1, bins, 1, 0)
            bins += 1
            carry = x
    if carry:
        add_gap(capacity - carry, bins - 1, 1)
    # Small items, longest first, into the tightest gap that holds them.
    for x in small:
        while left[x]:
            k = bisect_right(sizes, x - 1)
            if k == len(sizes):
                per = capacity // x
                n = max(1, left[x] // per)
                copies = min(per, left[x])
                first, bins, gap = bins, bins + n, capacity
                take(x, n, first, copies, 0)
                add_gap(gap - copies * x, first, n)
                continue
            gap = sizes[k]
            first, n = heapq.heappop(gaps[gap])
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(k)
            copies = min(gap // x, left[x])
            m = min(n, max(1, left[x] // copies))
            take(x, m, first, copies, capacity - gap)
            add_gap(gap - copies * x, first, m)
            add_gap(gap, first + m, n - m)
    return entries


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, id_column: str, text: str, capacity: int, cache: int) -> DataFrame:
    """Pieces of every document: place in it, length, checksum, and the piece's rank within its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        t = tokenizer(tokenizer_path, cache)
        step = 4 * capacity
        for b in batches:
            rows = []
            for i, ids in zip(b["id"].tolist(), t.encode(b["text"].tolist()), strict=True):
                ids += b"\0\0\0\0"
                for p, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    n = len(part) // 4
                    rows.append((i, p, at // 4, n, zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "task", "rank_in_task"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text")).mapInPandas(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank_in_task long"
    )


def pack(
    docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, cache: int = CACHE_CHUNKS
) -> DataFrame:
    """Packs every document; one row for each piece, with its sequence and offset."""
    pieces = materialize(tokenize_pieces(docs, tokenizer_path, id_column, text, capacity, cache), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # At most ``capacity`` rows at any size.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("tasks_before"))
    by_length: dict[int, list] = {}
    for length, *entry in plan(counts, capacity):
        by_length.setdefault(length, []).append(entry)
    steps = {k: np.array(sorted(v), dtype=np.int64) for k, v in by_length.items()}
    ranked = pieces.join(by_task, ["task", "length"]).withColumn("rank", F.col("rank_in_task") + F.col("tasks_before"))
    placed = place(ranked, steps)
    return placed.select(
        F.col("id").alias(id_column), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def place(ranked: DataFrame, steps: dict[int, np.ndarray]) -> DataFrame:
    """Sequence and offset of each piece, from its rank within its length.

    ``steps`` has the plan's entries by length: its size follows the capacity,
    not the input, and it goes to the tasks with the function.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seq = np.zeros(len(b), dtype=np.int64)
            off = np.zeros(len(b), dtype=np.int64)
            rank, length = b["rank"].to_numpy(), b["length"].to_numpy()
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0]) if len(b) else np.array([], dtype=int)
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(b)], strict=True):
                at = order[lo:hi]
                n = int(length[at[0]])
                t = steps[n]
                k = np.searchsorted(t[:, 0], rank[at], side="right") - 1
                d = rank[at] - t[k, 0]
                seq[at] = t[k, 2] + d // t[k, 3]
                off[at] = t[k, 4] + d % t[k, 3] * n
            yield b[["id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=seq, offset=off)

    kind = ranked.schema["id"].dataType.simpleString()
    return ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
