"""Near duplicates on word shingles by chosen paths, exact within what is found.

Texts with the same shingles collapse first.  Every remaining set is embedded
as min-hashes; a chosen path walks down these coordinates: each node of a
repetition picks a coordinate by a hash of the path so far, and sets that
agree there stay together.  A bucket small enough is compared by brute force
on the embedded sets.  A larger one first meets a few of its own members, the
hubs: sets that resemble the same hubs are candidates already and need not
meet again, and if few others remain, each of those is compared with the whole
bucket, in parts.  Else the bucket is split on the next coordinate.  Enough
repetitions run for the recall that is asked of a pair at the threshold, at the
depth it is compared at: all sets walk the repetitions that buckets SHALLOW
levels deep need, and the sets that are split on after that level walk the
further ones that DEPTH needs, among themselves.  A pair that agrees down to
SHALLOW is compared there or is split on as a whole, so both then walk on.

What is compared and similar is joined into candidate components; within each
of those, *all* pairs are decided by the exact Jaccard similarity of their
shingles, a large component in pairs of blocks spread over tasks.  A bucket
that stays large to the end of its path (its sets agree on every coordinate
tried) becomes candidates as a whole, so no link is dropped by a cap.

Defined cases: null and empty texts have no shingles and are alone in their
class; a text below five words has one shingle, all its words; letters A-Z are
lowered; repeated rows fall into one class; rows that share an id, or have
none, are told apart by their texts; ties don't matter, since a class is named
by its least id (null if none of its rows has one); other columns are ignored,
or kept by ``keep_first``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, frame, materialize, release_memory, text_or_empty
from .components import connected_components
from .textscan import mix, word_shingles

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.999
COORDINATES = 64
DEPTH = 6
SHALLOW = 3
#: Deviations of the estimate below the threshold that still make a candidate.
SLACK = 4
BUCKET = 512
#: Members of a large bucket that all of it meets; others that may then meet all of it; rows of one such comparison.
HUBS = 8
FEW = 256
PART = 1024
#: Sets of one block of the exact comparison.
BLOCK = 256
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least_estimate(threshold: float) -> float:
    return threshold - SLACK * math.sqrt(threshold * (1 - threshold) / COORDINATES)


def missed(threshold: float, levels: int, repeats: int) -> float:
    """Share of pairs at the threshold that share no bucket ``levels`` deep, or that the estimate turns away.

    The repetitions draw from the same coordinates, so the misses are averaged
    over how many of those a pair agrees on.
    """
    out = 0.0
    for k in range(COORDINATES + 1):
        agree = k / COORDINATES
        p = math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k)
        out += p * ((1 - agree**levels) ** repeats if agree >= _least_estimate(threshold) else 1)
    return out


def repetitions(threshold: float = THRESHOLD, recall: float = RECALL, levels: int = DEPTH) -> int:
    """Repetitions for a pair at the threshold to become a candidate ``levels`` deep with the given probability."""
    for repeats in range(1, 1000):
        if missed(threshold, levels, repeats) <= 1 - recall:
            return repeats
    raise ValueError("no number of repetitions reaches this recall")


def _lowered(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "replace").lower() for t in texts]


def _text_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    h, who = word_shingles(texts, width)
    at = np.lexsort((h, who))
    h, who = h[at], who[at]
    new = np.r_[True, (h[1:] != h[:-1]) | (who[1:] != who[:-1])] if len(h) else np.zeros(0, dtype=bool)
    h, who = h[new], who[new]
    return np.split(h, np.searchsorted(who, np.arange(1, len(texts))))


def _min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES 32-bit min-hashes for each set that isn't empty."""
    h = np.concatenate(sets)
    start = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), COORDINATES), dtype=np.uint32)
    for k in range(COORDINATES):
        out[:, k] = (np.minimum.reduceat(h * _MULTIPLIERS[k], start) >> np.uint64(32)).astype(np.uint32)
    return out


def _paths(rows: np.ndarray, repeats: range, depth: int = DEPTH) -> np.ndarray:
    """Node keys [set, repetition, depth] along each set's chosen path."""
    n = len(rows)
    out = np.empty((n, len(repeats), depth), dtype=np.int64)
    for at, r in enumerate(repeats):
        node = np.full(n, np.uint64(r + 1), dtype=np.uint64)
        for d in range(depth):
            pick = (mix(node + np.uint64(d * 1_000_003)) % np.uint64(COORDINATES)).astype(np.int64)
            node = mix(node * np.uint64(31) + rows[np.arange(n), pick].astype(np.uint64) + (pick.astype(np.uint64) << np.uint64(40)))
            out[:, at, d] = node.view(np.int64)
    return out


def fingerprints(docs: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    """(id, text hash, set fingerprint, embedded set) of every row; no fingerprint without shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.iloc[lo : lo + 1000]
                sets = _text_sets(_lowered(part["text"]), width)
                full = [i for i, s in enumerate(sets) if len(s)]
                prints: list[str | None] = [None] * len(part)
                hashes: list[bytes | None] = [None] * len(part)
                if full:
                    rows = _min_hashes([sets[i] for i in full])
                    for i, r in zip(full, rows, strict=True):
                        s = sets[i]
                        prints[i] = "%016x%016x" % (int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(len(s))))))
                        hashes[i] = r.tobytes()
                yield frame(id=part["id"], text_key=part["text_key"], fp=prints, hashes=hashes)
        release_memory()

    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text")).withColumn("text_key", F.xxhash64("text"))
    return texts.mapInPandas(run, f"id {kind}, text_key long, fp string, hashes binary")


def _path_rows(sets: DataFrame, repeats: range) -> DataFrame:
    """(fp, rep, key): every set's first bucket in every repetition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                rows = np.frombuffer(b"".join(b["hashes"]), dtype=np.uint32).reshape(len(b), COORDINATES)
                keys = _paths(rows, repeats, 1)
                rep = np.tile(np.array(repeats, dtype=np.int32), len(b))
                yield frame(fp=np.repeat(b["fp"].to_numpy(dtype=object), len(repeats)), rep=rep, key=keys.ravel())

    return sets.select("fp", "hashes").mapInPandas(run, "fp string, rep int, key long")


def _next_rows(active: DataFrame, sets: DataFrame, depth: int) -> DataFrame:
    """(fp, rep, key): the buckets of depth ``depth`` of the sets and repetitions that go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            rows = np.frombuffer(b"".join(b["hashes"]), dtype=np.uint32).reshape(len(b), COORDINATES)
            rep, key = b["rep"].to_numpy(), np.empty(len(b), dtype=np.int64)
            for r in np.unique(rep):
                at = np.flatnonzero(rep == r)
                key[at] = _paths(rows[at], range(r, r + 1), depth + 1)[:, 0, depth]
            yield frame(fp=b["fp"], rep=rep, key=key)

    return active.select("fp", "rep").join(sets.select("fp", "hashes"), "fp").mapInPandas(run, "fp string, rep int, key long")


def _bucket_edges(members: DataFrame, threshold: float) -> DataFrame:
    """Edges between embedded sets of small buckets that may reach the threshold."""
    slack = _least_estimate(threshold)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(b["hashes"]), dtype=np.uint32).reshape(len(b), COORDINATES)
        fp = b["fp"].to_numpy(dtype=object)
        left, right = [], []
        root = np.arange(len(fp))
        for i in range(1, len(fp)):  # one edge to each component seen before is enough
            near = np.flatnonzero((rows[:i] == rows[i]).mean(axis=1) >= slack)
            for r in np.unique(root[near]):
                left.append(fp[r])
                right.append(fp[i])
                root[: i + 1][root[: i + 1] == r] = i
        return frame(a=left, b=right)

    return members.groupBy("key").applyInPandas(run, "a string, b string")


def _met_hubs(large: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Large buckets' members with ``home`` (the first hub) where they resemble it or a hub that does, and ``tie``, that hub.

    A bucket's hubs are its HUBS sets of least hashes; their embedded sets are
    few, one row for each bucket.
    """
    slack = _least_estimate(threshold)
    picks = [F.min(F.struct(F.xxhash64(F.lit(i), "fp").alias("h"), "fp")).getField("fp") for i in range(HUBS)]
    hubs = large.groupBy("key").agg(F.array(*picks).alias("hubs")).select("key", "hubs", F.posexplode("hubs").alias("at", "fp"))
    hubs = hubs.join(sets.select("fp", "hashes"), "fp").groupBy("key").agg(  # HUBS rows each
        F.first("hubs").alias("hubs"), F.sort_array(F.collect_list(F.struct("at", "hashes"))).getField("hashes").alias("hub_hashes")
    )
    hubs = materialize(hubs, "hubs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            rows = np.frombuffer(b"".join(b["hashes"]), dtype=np.uint32).reshape(len(b), 1, COORDINATES)
            hub = np.frombuffer(b"".join(x for h in b["hub_hashes"] for x in h), dtype=np.uint32).reshape(len(b), -1, COORDINATES)
            first = (hub == hub[:, :1]).mean(axis=2) >= slack
            near = ((hub == rows).mean(axis=2) >= slack) & first
            home = [h[0] if x.any() else None for h, x in zip(b["hubs"], near, strict=True)]
            tie = [h[int(np.argmax(x))] if x.any() else None for h, x in zip(b["hubs"], near, strict=True)]
            yield frame(key=b["key"], fp=b["fp"], rep=b["rep"], n=b["n"], home=home, tie=tie)

    rows = large.join(sets.select("fp", "hashes"), "fp").join(hubs, "key").select("key", "fp", "rep", "n", "hubs", "hashes", "hub_hashes")
    return materialize(rows.mapInPandas(run, "key long, fp string, rep int, n long, home string, tie string"), "met")


def _strangers(met: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Edges of the few members of large buckets that resemble no hub, each compared with all of its bucket in parts."""
    slack = _least_estimate(threshold)
    parts = F.ceil(F.col("n") / PART).cast("int")
    rows = met.select("key", "fp", "home", "n").join(sets.select("fp", "hashes"), "fp")
    own = rows.select("key", "fp", "home", "hashes", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"), F.lit(False).alias("odd"))
    odd = rows.filter("home is null").select(
        "key", "fp", "home", "hashes", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("odd")
    )

    def run(b: pd.DataFrame) -> pd.DataFrame:
        emb = np.frombuffer(b"".join(b["hashes"]), dtype=np.uint32).reshape(len(b), COORDINATES)
        fp, home, odd = b["fp"].to_numpy(dtype=object), b["home"].to_numpy(dtype=object), b["odd"].to_numpy(dtype=bool)
        rest = np.flatnonzero(~odd)
        out = set()
        for i in np.flatnonzero(odd):
            for j in rest[(emb[rest] == emb[i]).mean(axis=1) >= slack]:
                out.add((fp[i], fp[j] if home[j] is None else home[j]))  # all that have a home are joined to it
        return frame(a=[x for x, y in out if x != y], b=[y for x, y in out if x != y])

    return own.unionByName(odd).groupBy("key", "part").applyInPandas(run, "a string, b string")


def _walk(sets: DataFrame, threshold: float, repeats: range) -> tuple[DataFrame, DataFrame]:
    """Edges that these repetitions find, and the sets that any of them splits on after level SHALLOW.

    Hubs are met on every other level.  Small buckets and strangers of all
    levels are compared together at the end.
    """
    here = materialize(_path_rows(sets, repeats), "paths")
    deep = sets.limit(0)
    small: list[DataFrame] = []
    few: list[DataFrame] = []
    edges: list[DataFrame] = []
    for d in range(DEPTH):
        # Written down, so that a join by a frequent key has a plain shuffle on both sides.
        size = materialize(here.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
        nodes = materialize(here.join(size.hint("shuffle_hash"), "key"), "nodes")
        drop_tables(here)
        small.append(nodes.filter(F.col("n") <= BUCKET).select("key", "fp"))
        active = nodes.filter(F.col("n") > BUCKET)
        if size.filter(F.col("n") > BUCKET).isEmpty():
            break
        if d % 2:
            met = _met_hubs(active, sets, threshold)
            edges.append(met.filter("tie != fp").select(F.col("fp").alias("a"), F.col("tie").alias("b")))
            odd = materialize(met.groupBy("key").agg(F.count_if(F.col("home").isNull()).alias("odd")).filter("odd > 0"), "strangers")
            few.append(met.join(odd.filter(F.col("odd") <= FEW).select("key"), "key").select("key", "fp", "home", "n"))
            many = odd.filter(F.col("odd") > FEW).select("key")
            if many.isEmpty():
                break
            active = met.join(many, "key")
        if d + 1 == DEPTH:  # agreed on every coordinate: candidates as a whole, as a star
            star = active.select("fp", "key")
            hub = materialize(star.groupBy("key").agg(F.min("fp").alias("b")), "stars")
            edges.append(star.join(hub, "key").select(F.col("fp").alias("a"), "b").filter("a != b"))
            break
        here = materialize(_next_rows(active, sets, d + 1), "paths")
        if d + 1 == SHALLOW:
            deep = materialize(sets.join(here.select("fp").distinct(), "fp", "left_semi"), "deep-sets")
    edges.append(_bucket_edges(reduce(DataFrame.unionByName, small).join(sets.select("fp", "hashes"), "fp"), threshold))
    if few:
        edges.append(_strangers(reduce(DataFrame.unionByName, few), sets, threshold))
    return materialize(reduce(DataFrame.unionByName, edges), "candidate-edges"), deep


def candidate_edges(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Edges between sets that chosen paths bring together."""
    few, all_ = (repetitions(threshold, recall, levels) for levels in (SHALLOW, DEPTH))
    edges, deep = _walk(sets, threshold, range(few))
    if deep.isEmpty():
        return edges
    return edges.unionByName(_walk(deep, threshold, range(few, all_))[0])


def _links(sets: list[np.ndarray], other: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with Jaccard at or above the threshold, within one block or between two."""
    both = sets if other is None else sets + other
    size = np.array([len(s) for s in both])
    h = np.concatenate(both)
    u, inv = np.unique(h, return_inverse=True)
    who = np.repeat(np.arange(len(both)), size)
    common = np.bincount(inv, minlength=len(u))
    if other is None:
        shared = common[inv] > 1
    else:
        shared = np.ones(len(h), dtype=bool)
    # Dense products over slices of the shared shingles: bounded memory at any set size.
    cols = np.unique(inv[shared])
    n = len(sets)
    m = n if other is None else len(other)
    inter = np.zeros((n, m), dtype=np.float32)
    order = np.argsort(inv, kind="stable")
    inv, who = inv[order], who[order]
    for lo in range(0, len(cols), 8192):
        a, b = np.searchsorted(inv, cols[lo]), np.searchsorted(inv, cols[min(lo + 8192, len(cols)) - 1], side="right")
        part = np.zeros((len(both), min(8192, len(cols) - lo)), dtype=np.float32)
        at = np.searchsorted(cols[lo : lo + 8192], inv[a:b])
        ok = (at < part.shape[1]) & (cols[lo : lo + 8192][np.minimum(at, part.shape[1] - 1)] == inv[a:b])
        part[who[a:b][ok], at[ok]] = 1
        inter += part[:n] @ (part[:n] if other is None else part[n:]).T
    union = size[:n, None] + (size[:n] if other is None else size[n:])[None, :] - inter
    hit = inter >= threshold * union - 1e-6
    if other is None:
        hit = np.triu(hit, 1)
    return np.nonzero(hit)


def exact_links(members: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Exact comparison within candidate components.

    ``members``: (component, n, copies, fp, shingles as bytes).  Returns (fp,
    links to other sets, links counting their copies) and edges (a, b) that
    span the links.  A component of more than BLOCK sets is compared in pairs
    of blocks, each pair a group of its own.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(mine, o).alias("lo"), F.greatest(mine, o).alias("hi"))
    )
    spread = members.withColumn("mine", mine).select("component", "fp", "copies", "shingles", "mine", F.explode(pairs).alias("p"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        lo, hi = b["lo"].iloc[0], b["hi"].iloc[0]
        sets = [np.frombuffer(x, dtype=np.uint64) for x in b["shingles"]]
        fp, copies, mine = b["fp"].to_numpy(dtype=object), b["copies"].to_numpy(), b["mine"].to_numpy()
        left = np.flatnonzero(mine == lo)
        right = np.flatnonzero(mine == hi)
        if not len(left) or not len(right):
            return frame(fp=[], links=[], copy_links=[], other=[])
        if lo == hi:
            x, y = _links([sets[i] for i in left], None, threshold)
        else:
            x, y = _links([sets[i] for i in left], [sets[i] for i in right], threshold)
        x, y = left[x], right[y]
        k = len(fp)
        links = np.bincount(x, minlength=k) + np.bincount(y, minlength=k)
        weight = np.bincount(x, weights=copies[y], minlength=k) + np.bincount(y, weights=copies[x], minlength=k)
        root = np.arange(k)
        out_a, out_b = [], []
        for i, j in zip(x.tolist(), y.tolist(), strict=True):  # a forest of the links
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            while root[j] != j:
                root[j] = root[root[j]]
                j = root[j]
            if i != j:
                root[max(i, j)] = min(i, j)
                out_a.append(i)
                out_b.append(j)
        hit = np.flatnonzero(links)
        if k > BLOCK // 2:
            release_memory()
        return frame(
            fp=[*fp[hit], *(fp[i] for i in out_a)],
            links=[*links[hit].tolist(), *[0] * len(out_a)],
            copy_links=[*weight[hit].astype(np.int64).tolist(), *[0] * len(out_a)],
            other=[*[None] * len(hit), *(fp[j] for j in out_b)],
        )

    out = materialize(
        spread.select("component", "fp", "copies", "shingles", "mine", "p.lo", "p.hi")
        .groupBy("component", "lo", "hi")
        .applyInPandas(run, "fp string, links long, copy_links long, other string"),
        "links",
    )
    counts = out.filter("other is null").groupBy("fp").agg(F.sum("links").alias("links"), F.sum("copy_links").alias("copy_links"))
    return counts, out.filter("other is not null").select(F.col("fp").alias("a"), F.col("other").alias("b"))


def _classes(docs: DataFrame, id_column: str, text: str, width: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(id, text_key, fp) of every row, and (fp, class_id, class_size, copies, n_links, head) of every set.

    A class's head is its row of least (id, text hash), rows without an id last.
    """
    prints = materialize(fingerprints(docs, id_column, text, width), "fingerprints")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    sets = materialize(
        prints.filter("fp is not null").groupBy("fp").agg(F.min(place).alias("least"), F.count("*").alias("copies"), F.first("hashes").alias("hashes")),
        "sets",
    )
    parts = connected_components(candidate_edges(sets, threshold, recall))
    sizes = materialize(parts.groupBy("component").agg(F.count("*").alias("n")), "component-sizes")
    sized = parts.join(sizes, "component")
    wanted = materialize(sized.join(sets.select(F.col("fp").alias("node"), "least", "copies"), "node"), "candidates")

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets_ = _text_sets(_lowered(b["text"]), width)
            yield frame(component=b["component"], n=b["n"], fp=b["fp"], copies=b["copies"], shingles=[s.tobytes() for s in sets_])
        release_memory()

    # One text for each candidate set: that of the least row among its copies, by id and text.
    key = wanted.select(F.col("node").alias("fp"), "component", "n", "copies", F.col("least.id").alias("of_id"), F.col("least.text_key").alias("of_key"))
    texts = docs.select(F.col(id_column).alias("id"), text_or_empty(text).alias("text")).withColumn("text_key", F.xxhash64("text"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    members = texts.join(key.hint("shuffle_hash"), same).dropDuplicates(["fp"])
    members = members.select("component", "n", "fp", "copies", "text").mapInPandas(shingles, "component string, n long, fp string, copies long, shingles binary")
    counts, edges = exact_links(members, threshold)
    classes = connected_components(edges)
    named = sets.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named.drop("hashes"), "named")
    names = materialize(named.groupBy("component").agg(F.min("least").alias("head"), F.sum("copies").alias("class_size")), "names")
    per_set = named.join(names, "component").join(counts, "fp", "left")
    per_set = per_set.select("fp", F.col("head.id").alias("class_id"), "class_size", "copies", F.coalesce("copy_links", F.lit(0)).alias("n_links"), "head")
    return prints.select("id", "text_key", "fp"), materialize(per_set, "classes")


def near_duplicate_classes(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """(id, class_id, class_size, n_links, n_copies) of every row.

    A class is a connected component of links (Jaccard at or above the
    threshold) and is named by its least id.  n_links counts the rows linked
    to this one with other shingles, n_copies the other rows with the same.
    """
    prints, per_set = _classes(docs, id_column, text, width, threshold, recall)
    out = prints.select("id", "fp").join(per_set.drop("head"), "fp", "left")
    return out.select(
        F.col("id").alias(id_column),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_copies"),
    )


def keep_first(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """The table with one row of each class: that of least id, among rows of one id that of least text hash.

    Rows without shingles all stay, each being a class of its own.
    """
    prints, per_set = _classes(docs, id_column, text, width, threshold, recall)
    heads = per_set.select(F.col("head.id").alias("of_id"), F.col("head.text_key").alias("of_key")).distinct()
    heads = materialize(heads, "heads")
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("id"), text_or_empty(text).alias("text"))
    rows = rows.select("row", "id", F.xxhash64("text").alias("text_key"), F.col("text").rlike(r"[^\x20\x09-\x0D]").alias("has_words"))
    rows = rows.join(heads.withColumn("hit", F.lit(True)).hint("shuffle_hash"), same, "left").filter("hit or not has_words")
    often = prints.filter("fp is not null").join(heads, same, "left_semi").groupBy("id", "text_key").count().filter("count > 1")
    if not often.isEmpty():  # rows that repeat an id and its text
        rows = rows.filter("has_words").dropDuplicates(["id", "text_key"]).union(rows.filter("not has_words"))
    return rows.select("row.*")
