"""Removal of repeated strings by suffix order, exact at any distance in the corpus.

A text is a string of symbols, either its bytes or its words (by 64-bit hashes
of them).  A symbol goes if a string of ``length`` symbols that covers it
starts elsewhere as well.  Equal strings must meet in one task without all
text meeting there:

1. Every window of ``length`` symbols has an anchor, its short string (``gram``
   symbols) of least hash, leftmost of equals.  Equal windows have equal
   anchors, and the windows of one anchor stand in a row; such a row is a
   *piece*.
2. Pieces whose anchor occurs once are unique and go no further.  Pieces that
   are equal as a whole repeat as a whole, which counting hashes shows.
3. The different pieces of an anchor meet in a shard.  There the suffix array
   of their symbols, by prefix doubling up to ``length``, brings equal windows
   together; the previous smaller position within a run of suffixes that share
   ``length`` symbols is the longest-previous-factor match, so a window without
   one is the first of its kind.
4. An anchor with more different pieces than a shard should hold is narrowed:
   its windows are cut at fixed offsets into halves, each half with the longer
   string that all its windows share as its new anchor.  A half of one window
   has equal pieces only, so this ends, and nothing is capped.

How often an anchor occurs is written down before it is joined, so that a join
by a frequent anchor has a plain shuffle on both sides, which adaptive
execution splits.

``keep="none"`` removes every copy, ``keep="first"`` leaves the first by
(id, position); rows without an id come first, rows of one id by a hash of
their texts.

``remove_passages`` does the same for passages of more than 50 words, of any
number of bytes: words below WORD bytes are filled up before the comparison,
so ends stay exact to the byte.  ``removal_digest`` only reports passages, and
finds them as strings of words, which are far fewer than bytes.

Defined cases: a null text is an empty one; texts shorter than ``length`` are
kept whole; matches never cross texts; repeated rows are copies of one another
like any two texts (with ``keep="first"``, rows of one id and one text are one
place and stay); rows that share an id, or have none, are told apart by their
texts; an empty table stays empty; other columns are kept, whatever their
names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, frame, materialize, release_memory, text_or_empty
from .textscan import byte_values, mix, prefix_of, substring_hash, word_places


class Unit(NamedTuple):
    """What texts are strings of, how long a repeat is at least, how long anchors are, and whether short words are filled up first."""

    words: bool
    length: int
    gram: int
    filled: bool = False

    @property
    def size(self) -> int:
        """Bytes of a symbol."""
        return 8 if self.words else 1


LENGTH = 400
BYTES = Unit(words=False, length=LENGTH, gram=32)
#: A passage of more than 50 words between white space.
PASSAGE_WORDS = Unit(words=True, length=51, gram=8)
#: Bytes that a word counts at least in ``remove_passages``.
WORD = 7
#: 51 words have 50 gaps and 49 words between them; the outer two may stick to other text.
PASSAGE = BYTES._replace(length=50 + 49 * WORD, filled=True)
#: Bytes that one scan works on; it takes about 130 times as many in passing.
CHUNK = 1 << 19
SHARD_BYTES = 1 << 20
#: Different pieces of one anchor that may meet in a shard.
VARIANTS = 2048
_VALUES = byte_values(23)
_PIECES = "id {}, text_key long, start long, windows int, anchor long, piece long, rel int"


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by prefix and suffix minima of blocks."""
    n = len(v) - w + 1
    size = -(-len(v) // w) * w
    x = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    x[: len(v)] = v
    blocks = x.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def symbols(given: list[str], unit: Unit) -> list[np.ndarray]:
    """The string of symbols of each text."""
    if not unit.words:
        return [np.frombuffer((fill_words(t) if unit.filled else t).encode("utf-8", "replace"), dtype=np.uint8) for t in given]
    out: list[np.ndarray] = []
    lo, held = 0, 0
    texts = [t.encode("utf-8", "replace") for t in given]
    for i, t in enumerate(texts):  # a few texts at a time
        held += len(t)
        if held >= CHUNK or i == len(texts) - 1:
            h, _, _, who = word_places(texts[lo : i + 1])
            out += np.split(h, np.searchsorted(who, np.arange(1, i + 1 - lo)))
            lo, held = i + 1, 0
    return out


def anchored_pieces(strings: list[np.ndarray], unit: Unit) -> tuple[np.ndarray, ...]:
    """(text, start, windows, anchor, piece hash, anchor's offset) of every piece of the strings."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    length, gram = unit.length, unit.gram

    def scan(parts: list[tuple[int, int, np.ndarray]]) -> None:
        raw = np.concatenate([p for _, _, p in parts])
        size = np.array([len(p) for _, _, p in parts])
        ends = np.cumsum(size)
        prefix = prefix_of(raw | np.uint64(1) if unit.words else _VALUES[raw])
        at = np.arange(len(raw) - gram + 1)
        h = substring_hash(prefix, at, at + gram)
        bits = np.uint64(max(1, int(len(raw)).bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        least = _sliding_min((h & ~low) | at.astype(np.uint64), length - gram + 1) & low
        who = np.repeat(np.arange(len(parts)), size)[: len(least)]
        ok = np.flatnonzero(np.arange(len(least)) + length <= ends[who])
        arg, who = least[ok].astype(np.int64), who[ok]
        new = np.flatnonzero(np.r_[True, (arg[1:] != arg[:-1]) | (who[1:] != who[:-1])])
        start, who, arg = ok[new], who[new], arg[new]
        n = np.diff(np.r_[new, len(ok)])
        rel = arg - start
        piece = mix(substring_hash(prefix, start, start + n - 1 + length) + rel.astype(np.uint64))
        base = np.array([b for _, b, _ in parts])
        index = np.array([i for i, _, _ in parts])
        first = ends - size
        for col, x in zip(cols, (index[who], start - first[who] + base[who], n, h[arg].view(np.int64), piece.view(np.int64), rel), strict=True):
            col.append(x)

    todo: list[tuple[int, int, np.ndarray]] = []
    held, most = 0, CHUNK // unit.size
    for i, t in enumerate(strings):
        for lo in range(0, max(0, len(t) - length + 1), most):
            part = t[lo : lo + most + length - 1]
            if held and held + len(part) > most:
                scan(todo)
                todo, held = [], 0
            todo.append((i, lo, part))
            held += len(part)
    if todo:
        scan(todo)
    return tuple(np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in cols)


def _repeated(key: np.ndarray) -> np.ndarray:
    """Rank of each key among those that occur twice or more, -1 for the others."""
    order = np.argsort(key)
    s = key[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
    n = np.diff(np.r_[first, len(s)])
    rank = np.where(n > 1, np.cumsum(n > 1) - 1, -1)
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.repeat(rank, n)
    return out


def suffix_ranks(raw: np.ndarray, ends: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of each start's ``length`` symbols in suffix order, equal for equal strings, by prefix doubling.

    ``ends``: for every symbol, where its piece ends; strings don't cross it.
    Eight bytes, or one word, are what the ranks begin with.  What holds a
    string that occurs once occurs once itself, so it is not sorted again, and
    its start comes after all that repeat, in the order given.
    """
    n = len(raw)
    key = raw
    k = 1
    if raw.dtype == np.uint8:
        padded = np.r_[raw, np.zeros(8, dtype=np.uint8)].astype(np.uint64)
        key = np.zeros(n, dtype=np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | padded[j : j + n]
        k = 8
    # A string that would cross its piece's end is one that no window uses.
    at = np.flatnonzero(np.arange(n) + k <= ends)
    rank = np.full(n, -1, dtype=np.int64)
    rank[at] = _repeated(key[at])
    # Three ranks fit in one key in a shard of usual size, so a step triples the length.
    bits = int(n).bit_length() + 1
    fold = 3 if 3 * bits <= 63 else 2

    def joined(places: np.ndarray, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of the places whose strings at all offsets repeat: which, and their ranks side by side."""
        of = np.flatnonzero(rank[places] >= 0)
        key = rank[places[of]]
        for o in offsets:
            r = rank[places[of] + o]
            ok = r >= 0
            of, key = of[ok], (key[ok] << bits) | r[ok]
        return of, key

    while fold * k <= length:
        at = at[at + fold * k <= ends[at]]
        of, key = joined(at, [j * k for j in range(1, fold)])
        at, rank = at[of], np.full(n, -1, dtype=np.int64)
        rank[at] = _repeated(key)
        k *= fold
    # Overlapping strings of k symbols cover the rest.
    left = np.arange(len(starts))
    of, rank_at = joined(starts, [])
    left = left[of]
    for o in [*range(k, length - k, k), length - k]:
        r = rank[starts[left] + o]
        ok = (r >= 0) & (rank_at >= 0)
        left, rank_at = left[ok], _repeated((rank_at[ok] << bits) | r[ok])
    out = np.arange(n, n + len(starts))
    again = rank_at >= 0
    out[left[again]] = rank_at[again]
    return out


def previous_factor(rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a window has an earlier match of full length, and whether it has any other.

    In suffix order, runs of equal rank share the full length; with ties by
    place, the previous smaller position is the neighbour before.
    """
    order = np.lexsort((place, rank))
    r = rank[order]
    same = np.r_[False, r[1:] == r[:-1]]
    earlier = np.zeros(len(rank), dtype=bool)
    other = np.zeros(len(rank), dtype=bool)
    earlier[order] = same
    other[order] = same | np.r_[same[1:], False]
    return earlier, other


def _shard(b: pd.DataFrame, unit: Unit) -> pd.DataFrame:
    """Repeated window ranges of a shard's pieces: (anchor0, piece0, lo, hi, earlier)."""
    data = b["symbols"].tolist()
    n = b["windows"].to_numpy()
    size = np.array([len(x) // unit.size for x in data])
    first = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(data), dtype=np.uint64 if unit.words else np.uint8)
    owner = np.repeat(np.arange(len(data)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rank = suffix_ranks(raw, np.repeat(first + size, size), first[owner] + off, unit.length)
    release_memory()
    # Places compare as (id, text, start), rows without an id first: ranks of pieces by place, then the offset.
    ids = b["id"]
    if ids.dtype == object:
        ids = ids.map(lambda x: "" if x is None else x)
    by_place = np.lexsort((b["start"].to_numpy(), b["text_key"].to_numpy(), ids.to_numpy(), b["id"].notna().to_numpy()))
    place = np.empty(len(data), dtype=np.int64)
    place[by_place] = np.arange(len(data))
    earlier, other = previous_factor(rank, place[owner] * (int(n.max()) + 1) + off)
    out = []
    for flag, mask in ((True, earlier), (False, other)):
        hit = np.flatnonzero(mask)
        if not len(hit):
            continue
        cut = np.r_[True, (np.diff(hit) > 1) | (owner[hit][1:] != owner[hit][:-1])]
        lo = hit[cut]
        hi = hit[np.r_[cut[1:], True]]
        o = owner[lo]
        base = b["base"].to_numpy()[o]
        out.append(
            frame(
                anchor0=b["anchor0"].to_numpy()[o], piece0=b["piece0"].to_numpy()[o],
                lo=off[lo] + base, hi=off[hi] + base, earlier=np.full(len(lo), flag),
            )
        )
    if not out:
        return frame(anchor0=[], piece0=[], lo=[], hi=[], earlier=[])
    return pd.concat(out, ignore_index=True)


_CUT = ["anchor0", "piece0", "base", "id", "text_key", "start", "windows", "rel", "anchor", "piece", "copies", "symbols"]


def _narrow(pieces: DataFrame, level: int, unit: Unit) -> DataFrame:
    """Cuts the windows of each piece at the offsets of a level and anchors each part by what its windows share."""
    length, z = unit.length, unit.size
    span = length - unit.gram + 1
    width = max(1, -(-span // (1 << level)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                # Window w of the piece has its anchor at offset rel - w.
                o_hi, o_lo = r.rel, r.rel - r.windows + 1
                for cell in range(o_lo // width, o_hi // width + 1):
                    c_lo, c_hi = cell * width, cell * width + width - 1
                    w_lo, w_hi = r.rel - min(c_hi, o_hi), r.rel - max(c_lo, o_lo)
                    part = r.symbols[z * w_lo : z * (w_hi + length)]
                    c_hi = min(c_hi, length - unit.gram)
                    common = r.symbols[z * (r.rel - c_lo) : z * (r.rel - c_hi + length)]
                    d = hashlib.blake2b(common, digest_size=8, person=b"%d" % cell).digest()
                    q = hashlib.blake2b(part + b"%d" % (r.rel - w_lo), digest_size=8).digest()
                    rows.append(
                        (r.anchor0, r.piece0, r.base + w_lo, r.id, r.text_key, r.start + w_lo, w_hi - w_lo + 1, r.rel - w_lo,
                         int.from_bytes(d, "little", signed=True), int.from_bytes(q, "little", signed=True), r.copies, part)
                    )
            yield frame(**{k: [x[i] for x in rows] for i, k in enumerate(_CUT)})

    return pieces.select(_CUT).mapInPandas(run, pieces.select(_CUT).schema)


def _with_variants(pieces: DataFrame, temps: list[DataFrame]) -> DataFrame:
    """Pieces of anchors that have several, with their number; ``pieces`` is a written table."""
    n = materialize(pieces.groupBy("anchor").agg(F.count("*").alias("variants")).filter("variants > 1"), "variants")
    temps.append(n)
    return pieces.join(n.hint("shuffle_hash"), "anchor")


def _same_parts(parts: DataFrame, temps: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Equal parts collapse to the first by place; the others, and the first if counted copies, repeat whole."""
    lead = parts.groupBy("anchor", "piece").agg(
        F.min(F.struct("id", "text_key", "start", "anchor0", "piece0", "base")).alias("m"), F.count("*").alias("n")
    )
    lead = materialize(lead, "narrow-leads")
    temps.append(lead)
    joined = parts.join(lead, ["anchor", "piece"])
    is_lead = F.struct("id", "text_key", "start", "anchor0", "piece0", "base").eqNullSafe(F.col("m"))
    again = joined.filter(F.col("n") > 1).select(
        "anchor0", "piece0", F.col("base").alias("lo"), (F.col("base") + F.col("windows") - 1).alias("hi"), (~is_lead).alias("earlier")
    )
    return joined.filter(is_lead).drop("m", "n"), again


def repeated_ranges(docs: DataFrame, unit: Unit, temps: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Pieces whose anchor repeats, and the repeated window ranges of different pieces.

    ``docs``: (id, text).  Returns (id, text_key, start, windows, anchor,
    piece, rel, copies, first) and (anchor, piece, lo, hi, earlier); ``temps``
    gets the tables written on the way.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def written(df: DataFrame, label: str) -> DataFrame:
        temps.append(materialize(df, label))
        return temps[-1]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 250):
                part = b.iloc[lo : lo + 250]
                strings = symbols(part["text"].tolist(), unit)
                who, start, n, anchor, piece, rel = anchored_pieces(strings, unit)
                yield frame(
                    id=part["id"].iloc[who], text_key=part["text_key"].iloc[who], start=start,
                    windows=n.astype(np.int32), anchor=anchor, piece=piece, rel=rel.astype(np.int32),
                )
        release_memory()

    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    found = materialize(keyed.mapInPandas(scan, _PIECES.format(kind)), "pieces", "lz4")  # mostly hashes, which don't compress
    twice = written(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "repeated-anchors")
    pieces = written(found.join(twice.hint("shuffle_hash"), "anchor"), "repeated-pieces")
    drop_tables(found)
    place = F.struct("id", "text_key", "start", "windows", "rel")
    kinds = written(pieces.groupBy("anchor", "piece").agg(F.count("*").alias("copies"), F.min(place).alias("lead")), "kinds")
    lead = _with_variants(kinds, temps).select("anchor", "piece", "copies", "lead.*")
    wanted = lead.groupBy("id", "text_key").agg(F.collect_list(F.struct("anchor", "piece", "copies", "start", "windows", "rel")).alias("cuts"))
    wanted = wanted.withColumnsRenamed({"id": "of_id", "text_key": "of_key"})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, key, text, cuts in zip(b["id"], b["text_key"], b["text"], b["cuts"], strict=True):
                t = symbols([text], unit)[0]
                for c in cuts:
                    s, w = c["start"], c["windows"]
                    rows.append((c["anchor"], c["piece"], 0, i, key, s, w, c["rel"], c["anchor"], c["piece"], c["copies"], t[s : s + w - 1 + unit.length].tobytes()))
            yield frame(**{k: [x[j] for x in rows] for j, k in enumerate(_CUT)})

    schema = f"anchor0 long, piece0 long, base int, id {kind}, text_key long, start long, windows int, rel int, anchor long, piece long, copies long, symbols binary"
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    cutter = keyed.join(wanted.hint("shuffle_hash"), same).select("id", "text_key", "text", "cuts").mapInPandas(cut, schema)
    active = written(_with_variants(written(cutter.dropDuplicates(["anchor", "piece"]), "cut-pieces"), temps), "active-pieces")
    ranges: list[DataFrame] = []
    level = 0
    while True:
        calm = active.filter(F.col("variants") <= VARIANTS)
        total = calm.agg(F.sum(F.length("symbols")).alias("n")).first()["n"] or 0
        shards = max(1, -(-int(total) // SHARD_BYTES))
        compared = (
            calm.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
            .groupBy("shard")
            .applyInPandas(lambda b: _shard(b, unit), "anchor0 long, piece0 long, lo long, hi long, earlier boolean")
        )
        ranges.append(written(compared, "ranges"))
        hot = active.filter(F.col("variants") > VARIANTS).drop("variants")
        if hot.isEmpty():
            break
        level += 1
        leads, again = _same_parts(written(_narrow(hot, level, unit), "narrowed"), temps)
        ranges.append(written(again.selectExpr("anchor0", "piece0", "cast(lo as long) lo", "cast(hi as long) hi", "earlier"), "ranges"))
        active = written(_with_variants(written(leads, "narrow-pieces"), temps), "active-pieces")
    out = ranges[0]
    for r in ranges[1:]:
        out = out.unionByName(r)
    out = out.withColumnsRenamed({"anchor0": "anchor", "piece0": "piece"})
    lead_place = kinds.select("anchor", "piece", "copies", F.struct(F.col("lead.id"), F.col("lead.text_key"), F.col("lead.start")).alias("lead"))
    is_first = F.struct("id", "text_key", "start").eqNullSafe(F.col("lead"))
    placed = pieces.join(lead_place.hint("shuffle_hash"), ["anchor", "piece"]).withColumn("first", is_first).drop("lead")
    return written(placed, "placed-pieces"), out


def repeated_spans(docs: DataFrame, unit: Unit = BYTES, keep: str = "none") -> DataFrame:
    """(id, text_key, spans) of texts with symbols to remove; spans are unmerged [start, end) in symbols."""
    if keep not in ("none", "first"):
        raise ValueError("keep must be none or first")
    temps: list[DataFrame] = []
    pieces, ranges = repeated_ranges(docs, unit, temps)
    whole = F.col("copies") > 1
    if keep == "first":
        whole = whole & ~F.col("first")
        ranges = ranges.filter("earlier")
    full = pieces.filter(whole).select("id", "text_key", "start", (F.col("start") + F.col("windows") - 1 + unit.length).alias("end"))
    part = (
        pieces.filter(~whole)
        .join(ranges.select("anchor", "piece", "lo", "hi"), ["anchor", "piece"])
        .select("id", "text_key", (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi") + unit.length).alias("end"))
    )
    spans = full.unionByName(part).groupBy("id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = materialize(spans, "spans")
    drop_tables(*temps)
    return spans


def merged(spans, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the symbols that spans cover."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], min(s["end"], size)) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _filled(word: re.Match) -> str:
    w = word[0]
    return w + "\0" * (WORD - len(w.encode("utf-8", "replace")))


def fill_words(t: str) -> str:
    """The text with zeros after every word below WORD bytes; its own zeros become ones, so the rest keeps its places."""
    return re.sub(rf"(?<!\S)\S{{1,{WORD - 1}}}(?!\S)", _filled, t.replace("\0", "\1"))


def _with_spans(docs: DataFrame, id_column: str, text: str, found: list[tuple[Unit, str]]) -> DataFrame:
    """(row, id, text, spans0, spans1, ...): the table's own row as one column, so that no name of its columns matters."""
    out = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("id"), text_or_empty(text).alias("text"))
    plain = out.select("id", "text")
    for i, (unit, keep) in enumerate(found):
        spans = repeated_spans(plain, unit, keep).select(F.col("id").alias("of_id"), F.col("text_key").alias("of_key"), F.col("spans").alias(f"spans{i}"))
        same = F.col("id").eqNullSafe(F.col("of_id")) & (F.xxhash64("text") == F.col("of_key"))
        out = out.join(spans.hint("shuffle_hash"), same, "left").drop("of_id", "of_key")
    return out


def removal_digest(docs: DataFrame, id_column: str = "doc_id", text: str = "text", unit: Unit = BYTES, keep: str = "none") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words) of every row.

    The first five are what removal by ``unit`` does.  The last two tell which
    passages of more than 50 words repeat: such a passage may be shorter than
    ``unit`` asks for, so its bytes stay, but it is reported.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, spans, again in zip(b["text"], b["spans0"], b["spans1"], strict=True):
                t = t.encode("utf-8", "replace")
                runs = merged(spans, len(t)) if spans is not None else []
                h, at = hashlib.sha256(), 0
                for x, y in runs:
                    h.update(t[at:x])
                    at = y
                h.update(t[at:])
                places = merged(again, len(t)) if again is not None else []
                rows.append((len(t), sum(y - x for x, y in runs), len(runs), h.hexdigest(), len(places), sum(y - x for x, y in places)))
            names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words")
            yield frame(id=b["id"], **{k: [r[i] for r in rows] for i, k in enumerate(names)})

    kind = docs.schema[id_column].dataType.simpleString()
    joined = _with_spans(docs.select(id_column, text), id_column, text, [(unit, keep), (PASSAGE_WORDS, keep)]).drop("row")
    out = joined.mapInPandas(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long")
    return out.withColumnRenamed("id", id_column)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", unit: Unit = BYTES, keep: str = "first") -> DataFrame:
    """The table with repeated bytes taken out of its texts; runs shrink to whole characters.

    Lengths of a filled unit are those of the texts with short words filled up.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans, strict=True):
            if not len(s):
                out.append(t)
                continue
            raw = t.encode("utf-8", "replace")
            c = symbols([t], unit)[0]
            runs = merged(s, len(c))
            if unit.filled:
                real = np.r_[0, np.cumsum(c != 0)]
                runs = [(int(real[x]), int(real[y])) for x, y in runs]
            kept, at = [], 0
            for x, y in runs:
                while x < y and x < len(raw) and raw[x] & 0xC0 == 0x80:
                    x += 1
                while y > x and y < len(raw) and raw[y] & 0xC0 == 0x80:
                    y -= 1
                kept.append(raw[at:x])
                at = y
            kept.append(raw[at:])
            out.append(b"".join(kept).decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    joined = _with_spans(docs, id_column, text, [(unit, keep)])
    spans = F.coalesce("spans0", F.array().cast(joined.schema["spans0"].dataType))
    new = F.when(F.col("spans0").isNull(), F.col("row")[text]).otherwise(cut("text", spans))
    return joined.select(F.col("row").withField(f"`{text}`", new).alias("row")).select("row.*")


def remove_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep: str = "first") -> DataFrame:
    """Takes out every repeated passage of more than 50 words between white space, or of LENGTH bytes.

    Any such passage has PASSAGE.length bytes once its words count WORD at
    least: gaps and inner words by the sum above, and LENGTH bytes less a first
    word cut short.  A passage of 40 to 50 longer words can have as many.
    """
    return remove_repeats(docs, id_column, text, PASSAGE, keep)
