"""Settlement groups and partial claw-backs: bounded searches over Arrow batches, uniqueness by counts.

A group is several credits that together settle one set of payments.  Credits
of one merchant whose days lie within GROUP_SPAN_DAYS are tried together; their
joint pool has to have one fitting subset, and no smaller part may balance.  A
merchant with more open credits than MAX_GROUP_RESIDUE, or more sets of them
than MAX_GROUP_SETS, is granted nothing: uniqueness can't be shown there.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import params as P
from ledgerloom.operators.matching import subset_solutions


def _sums(values: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(lo, hi) of every subset, by its bit mask."""
    out = [(0, 0)]
    for lo, hi in values:
        out += [(a + lo, b + hi) for a, b in out]
    return out


def reducible(credits: list[int], items: list[tuple[int, int]]) -> bool:
    """Whether a proper part of the credits balances a proper part of the payments."""
    parts = [a for a, _ in _sums([(c, c) for c in credits])][1:-1]
    return any(max(lo - c, c - hi, 0) <= P.TOLERANCE for lo, hi in _sums(items)[1:-1] for c in parts)


def candidate_groups(credits: list[tuple[int, int, str, list[tuple[int, int, str]]]]) -> list[tuple[list[str], list[str], int]] | None:
    """Balanced, irreducible groups as (credit ids, payment ids, total); None where there are too many sets.

    ``credits`` are (day, amount, id, pool).  Sets grow from their earliest
    member, and stop growing once their joint pool is beyond MAX_POOL: a larger
    set's pool is no smaller.
    """
    rows = sorted(credits, key=lambda r: r[:3])
    reach = [sum(r[0] - a[0] <= P.GROUP_SPAN_DAYS for r in rows[i + 1 :]) for i, a in enumerate(rows)]
    if sum(comb(n, k) for n in reach for k in range(1, P.MAX_GROUP_CREDITS)) > P.MAX_GROUP_SETS:
        return None
    found = []

    def grow(members: list[int], pool: dict[str, tuple[int, int, str]], last: int) -> None:
        if len(pool) > P.MAX_POOL:
            return
        if len(members) > 1 and pool:
            total = sum(rows[i][1] for i in members)
            hits, _, _ = subset_solutions(list(pool.values()), total)
            if len(hits) == 1 and not reducible([rows[i][1] for i in members], [pool[p][:2] for p in hits[0]]):
                found.append((sorted(rows[i][2] for i in members), hits[0], total))
        if len(members) < P.MAX_GROUP_CREDITS:
            for j in range(members[-1] + 1, last):
                grow([*members, j], pool | {x[2]: x for x in rows[j][3]}, last)

    for i, n in enumerate(reach):
        grow([i], {x[2]: x for x in rows[i][3]}, i + n + 1)
    return found


def settlement_groups(residue: DataFrame, pool: DataFrame, batch: tuple[str, ...] = ("merchant_id",)) -> DataFrame:
    """(batch columns, txn_ids, payment_ids, credit, outcome): granted, ambiguous_grouping, or truncated
    for a batch, with null ids and credit.

    ``residue``: (txn_id, batch columns, txn_date, credit); ``batch`` says what
    one statement to reconcile is.  What a task holds for a batch is bounded:
    at most MAX_GROUP_RESIDUE credits, with pools of at most MAX_POOL.
    """
    by = list(batch)
    sizes = residue.groupBy(*by).agg(F.count("*").alias("n"))
    small = residue.join(sizes.filter(F.col("n") <= P.MAX_GROUP_RESIDUE), by, "left_semi")
    per_credit = pool.join(small.select("txn_id"), "txn_id", "left_semi").groupBy("txn_id").agg(F.count("*").alias("pool_size"))
    within = per_credit.filter(F.col("pool_size") <= P.MAX_POOL)
    items = pool.join(within, "txn_id", "left_semi").groupBy("txn_id").agg(F.collect_list(F.struct("lo", "hi", "payment_id")).alias("items"))
    # Credits with larger pools count as members of sets, but can't be in a group.
    lines = small.join(per_credit, "txn_id", "left").join(items, "txn_id", "left").select(
        F.struct(*by).alias("batch"),
        F.struct(
            F.datediff("txn_date", F.lit("1970-01-01").cast("date")).alias("day"), "credit", "txn_id",
            (F.coalesce("pool_size", F.lit(0)) > P.MAX_POOL).alias("large"), F.coalesce("items", F.array().cast("array<struct<lo:bigint,hi:bigint,payment_id:string>>")).alias("items"),
        ).alias("line"),
    )
    folded = lines.groupBy("batch").agg(F.collect_list("line").alias("lines")).withColumn("batch", F.to_json("batch"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, rows in zip(b["batch"], b["lines"], strict=True):
                stuffed = [(-1, -1, f"?{i}") for i in range(P.MAX_POOL + 1)]
                credits = [(r["day"], int(r["credit"]), r["txn_id"], stuffed if r["large"] else [(x["lo"], x["hi"], x["payment_id"]) for x in r["items"]]) for r in rows]
                groups = candidate_groups(credits)
                out += [(key, None, None, None)] if groups is None else [(key, t, p, c) for t, p, c in groups]
            yield pd.DataFrame(out, columns=["batch", "txn_ids", "payment_ids", "credit"])

    found = folded.mapInPandas(search, "batch string, txn_ids array<string>, payment_ids array<string>, credit long")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("txn_ids", "array<string>"), ("payment_ids", "array<string>"), ("credit", "long"))]
    cut = sizes.filter(F.col("n") > P.MAX_GROUP_RESIDUE).select(F.to_json(F.struct(*by)).alias("batch"), *none)
    rows = found.unionByName(cut).withColumn("key", F.concat_ws("+", F.col("txn_ids")))
    uses = rows.filter("credit is not null").select("key", F.explode(F.concat("txn_ids", "payment_ids")).alias("used"))
    clean = uses.withColumn("n", F.count("*").over(Window.partitionBy("used"))).groupBy("key").agg((F.max("n") == 1).alias("clean"))
    outcome = F.when(F.col("credit").isNull(), "truncated").when(F.col("clean"), "granted").otherwise("ambiguous_grouping")
    kind = ", ".join(f"{c} {residue.schema[c].dataType.simpleString()}" for c in by)
    return rows.join(clean, "key", "left").withColumn("b", F.from_json("batch", kind)).select(
        "b.*", F.array_join("txn_ids", "+").alias("txn_ids"), F.array_join("payment_ids", ",").alias("payment_ids"), "credit", outcome.alias("outcome")
    )


def partial_reversals(debits: DataFrame, posted: DataFrame) -> DataFrame:
    """Debits that take back some payments of the one larger settlement that they name.

    ``debits``: (debit_id, debit, debit_date, token), one row for each token;
    ``posted``: (txn_id, ref_no, credit, txn_date, payment_id, lo, hi), one row
    for each payment of a posted credit.  A settlement's debits go in order of
    id, and a payment reopens once.  A posted credit has at most MAX_SUBSET
    payments; its debits are folded in one group, in order.
    """
    heads = posted.select("txn_id", F.upper("ref_no").alias("token"), "credit", "txn_date").distinct()
    named = debits.join(heads, "token").filter((F.col("credit") > F.col("debit")) & (F.col("txn_date") <= F.col("debit_date"))).select("debit_id", "debit", "txn_id").distinct()
    alone = named.withColumn("n", F.count("*").over(Window.partitionBy("debit_id"))).filter("n = 1")
    takes = alone.groupBy("txn_id").agg(F.sort_array(F.collect_list(F.struct("debit_id", "debit"))).alias("takes"))
    parts = posted.join(takes.select("txn_id"), "txn_id", "left_semi").groupBy("txn_id").agg(F.collect_list(F.struct("lo", "hi", "payment_id")).alias("items"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for txn, takes_, items in zip(b["txn_id"], b["takes"], b["items"], strict=True):
                left = {x["payment_id"]: (x["lo"], x["hi"], x["payment_id"]) for x in items}
                for d in takes_:
                    hits = subset_solutions(list(left.values()), int(d["debit"]))[0] if left else []
                    if len(hits) == 1:
                        left = {k: v for k, v in left.items() if k not in hits[0]}
                    kind = "partially_reversed" if len(hits) == 1 else "ambiguous_reversal" if hits else "no_subset_fits"
                    out.append((d["debit_id"], txn, kind, ",".join(hits[0]) if len(hits) == 1 else None))
            yield pd.DataFrame(out, columns=["debit_id", "credit_id", "outcome", "payment_ids"])

    return takes.join(parts, "txn_id").mapInPandas(fold, "debit_id string, credit_id string, outcome string, payment_ids string")


def stability(runs: DataFrame, passes: int) -> DataFrame:
    """Share of the passes in which a credit got its most frequent assignment; a pass without one counts against it.

    ``runs``: (pass, txn_id, payment_ids), assigned credits only.
    """
    n = runs.groupBy("txn_id", "payment_ids").agg(F.count("*").alias("n"))
    first = F.max_by("payment_ids", F.struct(F.col("n"), F.col("payment_ids")))
    return n.groupBy("txn_id").agg(first.alias("modal"), (F.max("n") / F.lit(passes)).alias("stability"))
