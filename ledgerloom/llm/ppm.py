"""Prediction by partial matching over bytes, trained on the corpus and scored per document.

The model is the trie of all byte contexts up to an order, kept as tables: one
row for each (context, next byte) and level, with counts, and a context's
totals beside them.  The longest contexts count occurrences; a shorter one
counts a symbol once for each longer context that met it (update exclusion).
Escape is estimated from the data: with d = once / (once + 2 twice), the share
of a level's counts of one and two, a context with T counts over D symbols
gives a symbol (n - d) / T and escape d D / T.  After an escape the symbols of
the longer context are excluded.  The excluded symbols' counts in the shorter
context are one sum for each context, so full exclusion is a join of a level
with the next shorter one.

Training and scoring never bring the model to one place.  Every block of
documents asks for its distinct byte strings (context and next byte) and its
distinct words; these requests, with their training counts, add up to the
model; the answers return to the block.  A block's share of the model is
bounded by the block's own text.

Texts are UTF-8 bytes with A-Z lowered; a context before the start is padded
with byte FF and the end is byte FE, neither of which UTF-8 uses.

Defined cases: a null or empty text is its end alone; without training rows
every symbol has probability 1/255 and a base token has 1; an empty table gives
an empty table; repeated rows are scored row by row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release_memory, text_or_empty

ORDER = 5
ALPHABET = 255
START, END = b"\xff", b"\xfe"
BLOCK_BYTES = 32 << 20
CHUNK = 1 << 20


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and next byte at every place of the texts, as one integer, and whose text it is."""
    raw = np.frombuffer(b"".join(START * order + t + END for t in texts), dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    if not len(texts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    g = np.zeros(len(raw) - order, dtype=np.int64)
    for j in range(order + 1):
        g <<= 8
        g |= raw[j : len(raw) - order + j]
    # Places whose next byte is padding belong to no text.
    keep = np.ones(len(g), dtype=bool)
    cut = np.cumsum(sizes + order)[:-1] - order
    for j in range(order):
        keep[cut + j] = False
    return g[keep], np.repeat(np.arange(len(texts)), sizes)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    if not len(k):
        return k, c.astype(np.int64)
    at = np.argsort(k, kind="stable")
    k, c = k[at], c[at]
    del at
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(c.astype(np.int64, copy=False), first)


class _Requests:
    """Distinct strings and words of one block, with their training counts."""

    def __init__(self, order: int) -> None:
        self.order = order
        self.grams: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.words: dict[bytes, int] = {}
        self.held: dict[bool, list[bytes]] = {True: [], False: []}
        self.size = {True: 0, False: 0}

    def add(self, text: bytes, train: bool) -> None:
        self.held[train].append(text)
        self.size[train] += len(text) + 1
        if self.size[train] >= CHUNK:
            self.flush(train)

    def flush(self, train: bool) -> None:
        texts, self.held[train], self.size[train] = self.held[train], [], 0
        if not texts:
            return
        u, c = np.unique(_grams(texts, self.order)[0], return_counts=True)
        self.grams.append(u)
        self.counts.append((c if train else np.zeros(len(u))).astype(np.int32))
        if len(self.grams) > 6:
            g, c = _merge(self.grams, self.counts)
            self.grams, self.counts = [g], [c.astype(np.int64)]
        words = self.words
        get = words.get
        for t in texts:
            if train:
                for w in t.split():
                    words[w] = get(w, 0) + 1
            else:
                for w in t.split():
                    if w not in words:
                        words[w] = 0
        words[b""] = get(b"", 0) + (len(texts) if train else 0)

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        self.flush(True)
        self.flush(False)
        names = ["block", "gram", "word", "n"]
        g, c = _merge(self.grams, self.counts)
        self.grams, self.counts = [], []
        for lo in range(0, len(g), 200_000):
            x, n = g[lo : lo + 200_000], c[lo : lo + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), block, dtype=np.int32)), pa.array(x), pa.nulls(len(x), pa.binary()), pa.array(n)], names)
        # Words answer to their place in the block's sorted list: -1, -2 and so on.
        order = sorted(self.words)
        for lo in range(0, len(order), 50_000):
            part = order[lo : lo + 50_000]
            n = np.fromiter(map(self.words.__getitem__, part), dtype=np.int64, count=len(part))
            at = -1 - np.arange(lo, lo + len(part))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block, dtype=np.int32)), pa.array(at), pa.array(part, pa.binary()), pa.array(n)], names)


def requests(blocks: DataFrame, order: int) -> DataFrame:
    """(block, gram or word, training count): what each block needs from the model and gives to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Requests] = {}
        for b in batches:
            block, train, raw = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())
            for k, y, t in zip(block, train, raw, strict=True):
                if k not in held:
                    held[k] = _Requests(order)
                held[k].add(t.as_py().lower(), y)
        for k in list(held):
            yield from held.pop(k).batches(k)
        release_memory()

    return blocks.select("block", "train", "text").mapInArrow(run, "block int, gram long, word binary, n long")


def discounts(levels: dict[int, DataFrame]) -> dict[int, float]:
    """How much of a symbol's count goes to escape at each level, from the counts of one and of two."""
    out = {}
    for k, level in levels.items():
        once, twice = (F.sum((F.col("n") == c).cast("long")) for c in (1, 2))
        a, b = level.agg(once, twice).first()
        out[k] = min(max((a or 0) / ((a or 0) + 2 * (b or 0)), 0.1), 0.95) if (a or 0) and (b or 0) else 0.5
    return out


def model(counts: DataFrame, order: int) -> DataFrame:
    """log10 probability of every (context, next byte) in ``counts`` (gram, n), by the whole trie."""
    levels = {order: counts}
    for k in range(order - 1, -1, -1):
        mask = (1 << (8 * (k + 1))) - 1
        # Written down: the discounts and the model both read it, and the next level is made of it.
        levels[k] = materialize(
            levels[k + 1]
            .groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram"))
            .agg(F.sum((F.col("n") > 0).cast("long")).alias("n")),
            f"ppm-level-{k}",
        )
    discount = discounts(levels)
    below: DataFrame | None = None
    for k in range(order + 1):
        # A context has at most 256 next bytes: a window over it is small.
        ctx = Window.partitionBy("ctx")
        cur = levels[k].withColumn("ctx", F.shiftright("gram", 8)).withColumns(
            {"T": F.sum("n").over(ctx), "D": F.sum((F.col("n") > 0).cast("long")).over(ctx)}
        )
        if below is None:
            unseen = F.greatest(F.lit(ALPHABET) - F.col("D"), F.lit(1))
            cur = cur.withColumn("C", -F.log10(unseen.cast("double"))).withColumn("shorter", F.col("C"))
        else:
            mask, d = (1 << (8 * k)) - 1, discount[k - 1]
            low = below.select(
                F.col("gram").alias("suffix"), F.col("n").alias("n1"), F.col("T").alias("T1"),
                F.col("D").alias("D1"), F.col("C").alias("C1"), F.col("A").alias("shorter"),
            )
            cur = cur.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask))).join(low, "suffix")
            gone = F.sum(F.when(F.col("n") > 0, F.col("n1")).otherwise(0)).over(ctx)
            rest = (F.col("T1") - gone).cast("double")
            kinds = F.col("D1") - F.col("D")
            after = (
                F.when(F.col("n1") > 0, F.log10(F.try_divide(F.col("n1") - d, rest)))
                .when(kinds > 0, F.log10(F.try_divide(kinds * d, rest)) + F.col("C1"))
                .otherwise(F.col("C1"))
            )
            cur = cur.withColumn("C", after)
        total, d = F.col("T").cast("double"), discount[k]
        score: Column = (
            F.when(F.col("n") > 0, F.log10(F.try_divide(F.col("n") - d, total)))
            .when(F.col("T") > 0, F.log10(F.try_divide(F.col("D") * d, total)) + F.col("C"))
            .otherwise(F.col("shorter"))
        )
        below = cur.withColumn("A", score).select("gram", "n", "T", "D", "C", "A")
    return below.select("gram", F.col("A").alias("logp"))


def score_documents(
    docs: DataFrame, train: Column, id_column: str = "doc_id", text: str = "text", order: int = ORDER, fixed_input: bool = False
) -> DataFrame:
    """Scores every row of ``docs`` by the model of the rows where ``train`` holds.

    Returns id, train, n_tokens, n_known, train_tokens, base_score and score.
    Blocks are parts of the table's own partitions.  Unless ``fixed_input``
    says that ``docs`` reads files as they are, it is written down first, so
    that both readings see the same partitions.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6")
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), text_or_empty(text).alias("text"))
    if not fixed_input:
        rows = materialize(rows, "ppm-rows")
    total = rows.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, rows.rdd.getNumPartitions())
    few = max(1, -(-2 * int(total) // BLOCK_BYTES))
    if parts > 2 * few:  # many small partitions: neighbours share a block, and what they ask for
        rows, parts = rows.coalesce(few), few
    split = max(1, -(-int(total) // (parts * BLOCK_BYTES)))
    blocks = rows.withColumn(
        "block", (F.spark_partition_id() * split + F.pmod(F.xxhash64("id", "text"), F.lit(split))).cast("int")
    )
    asked = materialize(requests(blocks, order), "ppm-requests")
    grams = materialize(asked.filter("gram >= 0").groupBy("gram").agg(F.sum("n").alias("n")), "ppm-counts")
    words = asked.filter("gram < 0").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words, "ppm-words")
    sums = words.agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v")).first()
    n_train, n_distinct = int(sums["n"] or 0), int(sums["v"] or 0)
    answers = (
        asked.filter("gram >= 0").select("block", "gram")
        .join(model(grams, order), "gram")
        # Single precision is plenty for one byte's code length, and packs better.
        .select("block", "gram", F.col("logp").cast("float").cast("double").alias("value"))
        .unionByName(
            asked.filter("gram < 0").select("block", "gram", "word")
            .join(words, "word").select("block", "gram", F.col("n").cast("double").alias("value"))
        )
    )
    kind = rows.schema["id"].dataType.simpleString()
    scale = n_train + n_distinct + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        release_memory()
        # Texts stay in their Arrow buffers; one chunk of them at a time is unpacked.
        raw = left.column("text").cast(pa.binary())
        keys, value = (right.column(c).combine_chunks().to_numpy() for c in ("gram", "value"))
        at = np.argsort(keys)
        n_words = int((keys < 0).sum())
        # Words come first, the last of them foremost.
        counts = value[at[:n_words][::-1]].astype(np.int64).tolist()
        keys, logp = keys[at[n_words:]], value[at[n_words:]]
        del at, value
        words: set[bytes] = {b""}
        for t in raw:
            words.update(t.as_py().lower().split())
        order_of = sorted(words)
        del words
        known = dict(zip(order_of, counts, strict=True))
        del order_of, counts
        end = known.get(b"", 0)
        n = len(raw)
        score, base = np.zeros(n), np.zeros(n)
        n_tokens, n_known = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

        def take(lo: int, texts: list[bytes]) -> None:
            g, who = _grams(texts, order)
            bits = max(1, int(len(texts)).bit_length())
            if 8 * (order + 1) + bits < 63:
                # Sorted by string and then text, strings and answers run side by side.
                both = np.sort((g << bits) | who)
                g, who = both >> bits, both & ((1 << bits) - 1)
                new = np.r_[True, g[1:] != g[:-1]]
                values = logp[np.searchsorted(keys, g[new])][np.cumsum(new) - 1]
            else:
                values = logp[np.searchsorted(keys, g)]
            score[lo : lo + len(texts)] = np.bincount(who, weights=values, minlength=len(texts))
            for i, t in enumerate(texts, lo):
                c = np.fromiter(map(known.__getitem__, t.split()), dtype=np.int64)
                n_tokens[i] = len(c) + 1
                n_known[i] = (c > 0).sum() + (end > 0)
                base[i] = np.log10((c + 1) / scale).sum() + np.log10((end + 1) / scale)

        part: list[bytes] = []
        held = 0
        for i, t in enumerate(raw):
            part.append(t.as_py().lower())
            held += len(part[-1]) + 1
            if held >= CHUNK or i == n - 1:
                take(i + 1 - len(part), part)
                part, held = [], 0
        return pa.table(
            {
                "id": left.column("id"), "train": left.column("train"), "n_tokens": n_tokens, "n_known": n_known,
                "train_tokens": np.full(n, n_train), "base_score": base, "score": score,
            }
        )

    # One block to a task: what a task sorts is bounded by a block.
    n_blocks = parts * split
    return (
        blocks.repartitionById(n_blocks, "block").groupBy("block").cogroup(answers.repartitionById(n_blocks, "block").groupBy("block"))
        .applyInArrow(run, f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        .withColumnRenamed("id", id_column)
    )
