"""DuckDB SQL for the derived sides and for the match; every oracle starts from it."""

from ledgerloom import params as P
from ledgerloom.functions import narration as N
from ledgerloom.plans.derive import BANKS, FAMILIES, THIRD_PARTY


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _gap(amount: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {amount} < {lo} THEN {amount} - {lo} WHEN {amount} > {hi} THEN {amount} - {hi} ELSE 0 END"


def fold(name: str) -> str:
    """SQL of ``normalise_name``."""
    words = f"string_split(trim(regexp_replace(upper({name}), '[^A-Z0-9]+', ' ', 'g')), ' ')"
    return f"array_to_string(list_filter({words}, lambda v: v <> '' AND NOT list_contains({_list(P.CORPORATE_WORDS)}, v)), ' ')"


def level(a: str, b: str) -> str:
    """SQL of ``name_level`` for two folded names."""
    agree = "p = q OR (least(length(p), length(q)) >= 3 AND (starts_with(p, q) OR starts_with(q, p)))"
    hits = f"len(list_filter(string_split({a}, ' '), lambda p: len(list_filter(string_split({b}, ' '), lambda q: {agree})) > 0))"
    half = f"{hits} / least(len(string_split({a}, ' ')), len(string_split({b}, ' '))) >= 0.5"
    return f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN NULL WHEN {a} = {b} THEN 2 WHEN {half} THEN 1 ELSE 0 END"


def _longest(parts: str) -> str:
    return f"nullif(list_reduce(list_prepend('', {parts}), lambda a, v: CASE WHEN length(v) > length(a) THEN v ELSE a END), '')"


def _payer(text: str) -> str:
    keep = (
        f"w <> '' AND NOT list_contains({_list(N.NOISE)}, upper(w)) AND NOT regexp_matches(w, '^\\d+$') AND NOT regexp_matches(upper(w), '^{N.UTR[2:-2]}$') "
        f"AND NOT regexp_matches(upper(w), '^{N.MERCHANT_REF[2:-2]}$') AND NOT regexp_matches(w, '{N.GARBLED_WORD}') AND regexp_matches(w, '[A-Za-z]{{2,}}')"
    )
    words = f"array_to_string(list_filter(regexp_split_to_array(trim(pt), '\\s+'), lambda w: {keep}), ' ')"
    return _longest(f"list_transform(regexp_split_to_array(regexp_replace(trim({text}), '{N.MARKER}', ''), '[-/]'), lambda pt: {words})")


def _recovered(text: str) -> str:
    keep = (
        f"w <> '' AND NOT list_contains({_list(N.RECOVERY_NOISE)}, upper(w)) AND NOT regexp_matches(w, '^\\d+$') "
        f"AND NOT regexp_matches(w, '{N.GARBLED_WORD}') AND regexp_matches(w, '[A-Za-z]{{2,}}')"
    )
    words = f"array_to_string(list_filter(regexp_split_to_array(trim(pt), '\\s+'), lambda w: {keep}), ' ')"
    return _longest(f"list_transform(regexp_split_to_array(trim({text}), '[/\\-:,]| {{2,}}'), lambda pt: {words})")


_STYLE = "CASE " + " ".join(f"WHEN regexp_matches(trim(narration), '{p}') THEN '{n}'" for n, p in N.STYLES) + " ELSE 'unknown' END"
_SPACED = "CASE WHEN contains(recovered0, ' ') THEN recovered0 " + " ".join(f"WHEN ends_with(recovered0, '{e}') THEN trim(left(recovered0, length(recovered0) - {len(e)}) || ' {e}')" for e in N.JAMMED_ENDINGS) + " ELSE recovered0 END"

SIDES = f"""
WITH RECURSIVE pay0 AS (
  SELECT o_orderkey AS key, 'pay_' || lpad(o_orderkey::VARCHAR, 9, '0') AS payment_id, c_nationkey::INT AS merchant_id,
    round_even(o_totalprice * 100, 0)::BIGINT AS amount, o_orderdate::DATE AS pay_date, o_orderkey % 33 <> 0 AS captured,
    {_list(FAMILIES)}[(c_custkey % {len(FAMILIES)} + 1)::INT] AS customer_name, 'order_' || lpad(o_orderkey::VARCHAR, 9, '0') AS order_id,
    'BTXN' || lpad(o_orderkey::VARCHAR, 11, '0') AS bank_transaction_id, '#RCP' || lpad(o_orderkey::VARCHAR, 9, '0') AS description,
    o_orderpriority = '5-LOW' AND o_orderkey % 5 = 0 AS fee_hidden, floor((o_orderdate::DATE - DATE '1970-01-01') / 3)::INT AS w
  FROM orders JOIN customer ON o_custkey = c_custkey),
pay1 AS (SELECT *, min(key) OVER (PARTITION BY merchant_id, w) AS first_key, row_number() OVER (PARTITION BY merchant_id, w ORDER BY key) - 1 AS place0,
    CASE WHEN key % 41 = 0 THEN amount // 10 ELSE 0 END::BIGINT AS refunded, round_even(amount * 0.022::DOUBLE, 0)::BIGINT AS fee_base FROM pay0),
pay2 AS (SELECT *, CASE WHEN key % 20 <> 0 THEN CASE WHEN place0 = 1 AND (merchant_id + w) % 5 = 0 AND first_key % 20 <> 0 THEN first_key ELSE key END END AS inv_key,
    fee_base + round_even(fee_base * 0.18::DOUBLE, 0)::BIGINT AS true_fee FROM pay1),
pay3 AS (SELECT *, CASE WHEN NOT fee_hidden THEN true_fee END AS fee, 'INV-' || (1995 + inv_key % 7)::VARCHAR || '-' || lpad(inv_key::VARCHAR, 8, '0') AS invoice_no FROM pay2),
inv0 AS (SELECT merchant_id, invoice_no, min(inv_key) AS inv_key, sum(amount)::BIGINT AS gross, min(pay_date) AS invoice_date, arg_min(customer_name, key) AS customer_name
  FROM pay3 WHERE invoice_no IS NOT NULL GROUP BY 1, 2),
inv AS (SELECT *, CASE WHEN inv_key % 11 = 0 THEN round_even(gross * 0.02::DOUBLE, 0) ELSE 0 END::BIGINT AS tds FROM inv0),
pay AS MATERIALIZED (SELECT p.*, coalesce(i.tds, 0) AS tds FROM pay3 p LEFT JOIN inv i ON i.merchant_id = p.merchant_id AND i.invoice_no = p.invoice_no),
settled AS (SELECT * FROM pay WHERE captured AND key % 47 <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY merchant_id, w ORDER BY key) - 1 AS place FROM settled),
chunked0 AS (SELECT *, (CASE WHEN (merchant_id + w) % 3 = 0 THEN place // 5 ELSE place END)::INT AS chunk FROM placed),
chunked AS (SELECT *, CASE WHEN invoice_no IS NOT NULL AND row_number() OVER (PARTITION BY merchant_id, w, chunk, invoice_no ORDER BY key) > 1 THEN 0 ELSE tds END AS withheld FROM chunked0),
cr AS (SELECT merchant_id, w, chunk, min(key) AS key, count(*)::INT AS n, sum(amount - true_fee - withheld - refunded)::BIGINT AS credit,
    arg_min(customer_name, key) AS customer, arg_min(coalesce(invoice_no, ''), key) AS inv, arg_min(amount - true_fee - tds - refunded, key) AS first_net FROM chunked GROUP BY ALL),
cr1 AS (SELECT *, CASE WHEN n = 1 AND key % 29 = 0 THEN 'BTXN' || lpad(key::VARCHAR, 11, '0') ELSE {_list(BANKS)}[(key % {len(BANKS)} + 1)::INT] || lpad(key::VARCHAR, 11, '0') END AS ref,
    CASE WHEN n = 1 AND key % 53 = 0 THEN '{THIRD_PARTY}' ELSE customer END AS name, n = 1 AND key % 59 = 0 AS split FROM cr),
lines AS (SELECT * EXCLUDE (credit), '' AS part, credit FROM cr1 WHERE NOT split
  UNION ALL SELECT * EXCLUDE (credit), 'a', credit * 4 // 10 FROM cr1 WHERE split UNION ALL SELECT * EXCLUDE (credit), 'b', credit - credit * 4 // 10 FROM cr1 WHERE split),
credits0 AS (SELECT 'bt_' || lpad(key::VARCHAR, 9, '0') || part AS txn_id, merchant_id, DATE '1970-01-01' + (3 * (w + 1) + key % 3)::INT AS txn_date,
    CASE WHEN split THEN 'GATEWAY SETTLEMENT ' || ref || ' PART ' || CASE WHEN part = 'a' THEN '1' ELSE '2' END || ' OF 2'
      WHEN n > 1 THEN 'GATEWAY SETTLEMENT ' || ref || ' ' || (n + (key % 61 = 0)::INT)::VARCHAR || ' TXNS'
      WHEN key % 31 = 0 AND inv <> '' AND key // 31 % 3 = 0 THEN 'BY CLG/' || ref || '/' || name || ' INV' || regexp_replace(inv, '[^0-9]', '', 'g')
      WHEN key % 31 = 0 AND inv <> '' AND key // 31 % 3 = 1 THEN 'INW REM ' || lpad(key::VARCHAR, 6, '0') || ' ' || name || ' ' || replace(inv, '-', '/')
      WHEN key % 31 = 0 AND inv <> '' THEN '*' || ref || '* ' || name || ' - RECD'
      WHEN key % 4 = 0 AND inv <> '' THEN 'RTGS-' || ref || '-' || name || '-' || inv
      WHEN key % 3 = 0 THEN 'NEFT-' || ref || '-' || name WHEN key % 3 = 1 THEN 'IMPS/' || ref || '/' || name || '/CR' ELSE 'UPI/' || ref || '/' || name END AS narration,
    ref AS ref_no, credit, 0::BIGINT AS debit, key, n, first_net FROM lines),
credits AS MATERIALIZED (SELECT txn_id, merchant_id, txn_date, CASE WHEN key % 17 = 0 THEN txn_date - 1 ELSE txn_date END AS value_date, narration, ref_no, credit, debit, key, n, first_net FROM credits0),
debits AS MATERIALIZED (SELECT 'bd_' || substr(txn_id, 4, 10) AS txn_id, merchant_id, txn_date + (3 + key % 7)::INT AS txn_date, txn_date + (3 + key % 7)::INT AS value_date,
    'CHARGEBACK REV ' || CASE WHEN key % 101 = 0 THEN 'EXTRN' || lpad(key::VARCHAR, 11, '9') ELSE ref_no END || ' DISPUTE' AS narration,
    'DBTRV' || lpad(key::VARCHAR, 11, '0') AS ref_no, 0::BIGINT AS credit,
    CASE WHEN n > 1 AND key % 43 = 0 AND key % 37 <> 0 AND key % 101 <> 0 THEN first_net ELSE credit END AS debit, key
  FROM credits WHERE key % 37 = 0 OR key % 101 = 0 OR (n > 1 AND key % 43 = 0)),
bank AS (SELECT * EXCLUDE (n, first_net) FROM credits UNION ALL SELECT * FROM debits),
ivl AS MATERIALIZED (SELECT *, CASE WHEN fee IS NOT NULL THEN amount - fee - 2 ELSE amount - ceil(0.025::DOUBLE * amount * 1.18::DOUBLE)::BIGINT END - tds - refunded AS lo,
    CASE WHEN fee IS NOT NULL THEN amount - fee + 2 ELSE amount - floor(0.018::DOUBLE * amount * 1.18::DOUBLE)::BIGINT END - tds - refunded AS hi,
    fee IS NOT NULL AS certain FROM pay WHERE captured),
parsed0 AS (SELECT *, {_STYLE} AS style, coalesce(nullif(regexp_extract(upper(narration), '{N.UTR}', 1), ''), nullif(regexp_extract(narration, '{N.DIGITS}', 1), '')) AS utr,
    nullif(regexp_extract(upper(narration), '{N.MERCHANT_REF}', 1), '') AS quoted, nullif(regexp_extract(narration, '{N.SETTLEMENT_ID}', 1), '') AS settlement_id,
    nullif(regexp_extract(narration, '{N.COUNT}', 1), '')::INT AS txns, {_payer("narration")} AS name0, {_recovered("narration")} AS recovered0,
    nullif(regexp_extract(trim(narration), '{N.GARBLED}', 1), '') AS garbled FROM credits),
parsed1 AS (SELECT *, CASE WHEN style <> 'settlement' AND coalesce(NOT contains(upper(name0), upper(utr)), true) AND coalesce(NOT regexp_matches(name0, '\\d{{6,}}'), true) THEN name0 END AS clean_name,
    CASE WHEN length(regexp_replace(garbled, '[^0-9]', '', 'g')) >= 6 THEN 'INV-' || left(regexp_replace(garbled, '[^0-9]', '', 'g'), 4) || '-' || substr(regexp_replace(garbled, '[^0-9]', '', 'g'), 5) ELSE upper(garbled) END AS recovered_ref,
    {_SPACED} AS recovered_name FROM parsed0),
parsed2 AS (SELECT *, style = 'unknown' OR (style IN ('neft', 'rtgs', 'imps', 'upi') AND clean_name IS NULL) AS needs_recovery FROM parsed1),
parsed AS MATERIALIZED (SELECT *, coalesce(quoted, CASE WHEN needs_recovery THEN recovered_ref END) AS merchant_ref,
    coalesce(clean_name, CASE WHEN needs_recovery THEN recovered_name END) AS payer FROM parsed2),
pool AS MATERIALIZED (SELECT c.txn_id, c.credit, c.txns, p.payment_id, p.lo, p.hi, p.certain, {_gap("c.credit", "p.lo", "p.hi")} AS residual
  FROM parsed c JOIN ivl p ON p.merchant_id = c.merchant_id AND p.pay_date BETWEEN c.txn_date - 5 AND c.txn_date),
tok_p AS (SELECT merchant_id, payment_id, unnest([upper(payment_id), upper(order_id), upper(bank_transaction_id), upper(invoice_no), upper(substr(description, 2))]) AS token FROM ivl),
tok_c AS (SELECT merchant_id, txn_id, unnest([upper(merchant_ref), upper(utr), upper(ref_no), upper(settlement_id)]) AS token FROM parsed),
ref_hits AS MATERIALIZED (SELECT DISTINCT c.txn_id, p.payment_id FROM tok_c c JOIN tok_p p ON c.merchant_id = p.merchant_id AND c.token = p.token AND c.token <> ''),
t1 AS (SELECT h.txn_id, count(*) AS hits, min(h.payment_id) AS payment_id, min({_gap("c.credit", "p.lo", "p.hi")}) AS residual
  FROM ref_hits h JOIN parsed c USING (txn_id) JOIN ivl p ON p.payment_id = h.payment_id GROUP BY 1),
t2 AS (SELECT txn_id, count(*) AS hits, min(payment_id) AS payment_id, min(residual) AS residual FROM pool WHERE abs(residual) <= 100 GROUP BY 1),
cascade AS MATERIALIZED (SELECT c.txn_id, c.merchant_id, c.credit, c.txns,
    CASE WHEN t1.hits = 1 AND abs(t1.residual) <= 100 AND coalesce(c.txns, 1) = 1 THEN 'assign'
      WHEN t1.hits > 1 THEN 'multiple_candidates' WHEN t1.hits = 1 AND abs(t1.residual) > 100 THEN 'unexplained_residual'
      WHEN t2.hits > 1 THEN 'multiple_candidates' WHEN t2.hits = 1 AND coalesce(c.txns, 1) = 1 THEN 'assign' ELSE 'open' END AS verdict,
    CASE WHEN t1.hits >= 1 AND NOT (t1.hits = 1 AND abs(t1.residual) <= 100 AND coalesce(c.txns, 1) <> 1) THEN 'tier1_reference'
      WHEN t2.hits > 1 OR (t2.hits = 1 AND coalesce(c.txns, 1) = 1) THEN 'tier2_amount_date' ELSE '' END AS tier,
    CASE WHEN t1.hits = 1 AND abs(t1.residual) <= 100 AND coalesce(c.txns, 1) = 1 THEN t1.payment_id
      WHEN coalesce(t1.hits, 0) = 0 OR (t1.hits = 1 AND abs(t1.residual) <= 100) THEN CASE WHEN t2.hits = 1 AND coalesce(c.txns, 1) = 1 THEN t2.payment_id END END AS payment_id,
    CASE WHEN t1.hits = 1 AND abs(t1.residual) <= 100 AND coalesce(c.txns, 1) = 1 THEN t1.residual
      WHEN coalesce(t1.hits, 0) = 0 OR (t1.hits = 1 AND abs(t1.residual) <= 100) THEN CASE WHEN t2.hits = 1 AND coalesce(c.txns, 1) = 1 THEN t2.residual END END AS residual
  FROM parsed c LEFT JOIN t1 USING (txn_id) LEFT JOIN t2 USING (txn_id))
"""

_FOLDED_PAYER, _FOLDED_NAME = fold("c.payer"), fold("customer_name")
#: Chance agreement of fields, and pool sizes, over whole merchants.
CHANCE = f""", folded AS MATERIALIZED (SELECT *, {_FOLDED_NAME} AS folded FROM pay),
u AS MATERIALIZED (SELECT m.merchant_id, greatest(coalesce(a.p, 1), 1e-6) AS u_name, greatest(coalesce(b.p, 1), coalesce(a.p, 1), 1e-6) AS u_partial, greatest(coalesce(c.p, 1), 1e-6) AS u_reference,
    greatest(least(1.0, {P.LOOKBACK_DAYS + 1}.0 / greatest(coalesce(d.span, 1), 1)), 1e-6) AS u_date FROM (SELECT DISTINCT merchant_id FROM pay) m
  LEFT JOIN (SELECT merchant_id, sum(n * n) / (sum(n) * sum(n)) AS p FROM (SELECT merchant_id, folded, count(*)::DOUBLE AS n FROM folded WHERE folded <> '' GROUP BY 1, 2) GROUP BY 1) a USING (merchant_id)
  LEFT JOIN (SELECT merchant_id, sum(n * n) / (sum(n) * sum(n)) AS p FROM (SELECT merchant_id, split_part(folded, ' ', 1) AS v, count(*)::DOUBLE AS n FROM folded WHERE folded <> '' GROUP BY 1, 2) GROUP BY 1) b USING (merchant_id)
  LEFT JOIN (SELECT merchant_id, sum(n * n) / (sum(n) * sum(n)) AS p FROM (SELECT merchant_id, invoice_no, count(*)::DOUBLE AS n FROM pay WHERE invoice_no IS NOT NULL GROUP BY 1, 2) GROUP BY 1) c USING (merchant_id)
  LEFT JOIN (SELECT merchant_id, max(txn_date) - min(txn_date) + 1 AS span FROM bank GROUP BY 1) d USING (merchant_id)),
sizes AS MATERIALIZED (SELECT c.txn_id, greatest(2, count(p.payment_id)) AS pool_size FROM credits c LEFT JOIN pool p USING (txn_id) GROUP BY 1)"""

_W = {
    "name": f"CASE name_level WHEN 2 THEN log2({P.M_NAME} / u_name) WHEN 1 THEN log2({P.M_NAME / 2} / least(1.0, 4 * u_partial)) WHEN 0 THEN log2({1 - P.M_NAME:.12g} / greatest(1 - u_name, 1e-9)) ELSE 0 END",
    "ref": f"CASE ref_level WHEN 2 THEN log2({P.M_REFERENCE} / u_reference) WHEN 0 THEN log2({1 - P.M_REFERENCE:.12g} / greatest(1 - u_reference, 1e-9)) ELSE 0 END",
}


def evidence_sql(source: str, name: str) -> str:
    """CTEs that weigh the proposals (txn_id, ids) of ``source`` into ``name``."""
    return f""", {name}a AS (SELECT s.txn_id, list(DISTINCT f.folded) FILTER (f.folded <> '') AS names, list(DISTINCT upper(f.invoice_no)) FILTER (f.invoice_no IS NOT NULL) AS invs
  FROM (SELECT txn_id, unnest(ids) AS payment_id FROM {source}) s JOIN folded f USING (payment_id) GROUP BY 1),
{name}b AS (SELECT a.txn_id, a.names, a.invs, c.merchant_id, {_FOLDED_PAYER} AS payer, upper(c.merchant_ref) AS ref FROM {name}a a JOIN parsed c USING (txn_id)),
{name} AS MATERIALIZED (SELECT *, name_level IS NULL AND ref_level IS NULL AS nothing, {_W["name"]} + {_W["ref"]} AS field_weight FROM (
  SELECT b.txn_id, u.u_name, u.u_partial, u.u_reference, z.pool_size, list_max(list_transform(b.names, lambda n: {level("b.payer", "n")})) AS name_level,
    CASE WHEN coalesce(b.ref, '') = '' OR coalesce(len(b.invs), 0) = 0 THEN NULL WHEN list_contains(b.invs, b.ref) THEN 2 ELSE 0 END AS ref_level
  FROM {name}b b JOIN u USING (merchant_id) JOIN sizes z USING (txn_id)))"""


def search_sql(targets: str, items: str, name: str, key: str) -> str:
    """CTEs: every subset of ``items`` (key, payment_id, lo, hi) that fits the target of ``targets`` (key, target), as ``name`` (key, ids)."""
    return f""", {name}i AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY lo, payment_id) AS pos FROM {items}),
{name}s AS (SELECT i.{key}, t.target, 1 AS k, i.pos, i.lo, i.hi, [i.payment_id] AS ids FROM {name}i i JOIN {targets} t USING ({key})
  UNION ALL SELECT s.{key}, s.target, s.k + 1, i.pos, s.lo + i.lo, s.hi + i.hi, list_append(s.ids, i.payment_id) FROM {name}s s JOIN {name}i i ON i.{key} = s.{key} AND i.pos > s.pos
  WHERE s.k < {P.MAX_SUBSET} AND s.lo + i.lo <= s.target + {P.TOLERANCE} AND NOT greatest(s.lo - s.target, s.target - s.hi, 0) <= {P.TOLERANCE}),
{name} AS MATERIALIZED (SELECT {key}, list_sort(ids) AS ids, {_gap("target", "lo", "hi")} AS residual FROM {name}s WHERE greatest(lo - target, target - hi, 0) <= {P.TOLERANCE})"""


def _round(r: int) -> str:
    was = f"done{r - 1}" if r > 1 else ""
    left = f"parsed c ANTI JOIN {was} d USING (txn_id)" if was else "parsed c"
    claimed = f" WHERE payment_id NOT IN (SELECT unnest(ids) FROM {was})" if was else ""
    return (
        f""", left{r} AS MATERIALIZED (SELECT c.* FROM {left}), free{r} AS MATERIALIZED (SELECT * FROM ivl{claimed}),
a{r} AS (SELECT h.txn_id, count(*) AS hits, min(h.payment_id) AS payment_id, min({_gap("c.credit", "p.lo", "p.hi")}) AS residual
  FROM ref_hits h JOIN left{r} c USING (txn_id) JOIN free{r} p ON p.payment_id = h.payment_id GROUP BY 1),
b{r} AS (SELECT o.txn_id, count(*) AS hits, min(o.payment_id) AS payment_id, min(o.residual) AS residual FROM pool o SEMI JOIN left{r} c USING (txn_id) SEMI JOIN free{r} p USING (payment_id)
  WHERE abs(o.residual) <= {P.TOLERANCE} GROUP BY 1),
x{r} AS MATERIALIZED (SELECT c.txn_id, c.credit, c.txns, a.hits AS h1, a.payment_id AS p1, a.residual AS r1, b.hits AS h2, b.payment_id AS p2, b.residual AS r2,
    coalesce(a.hits = 1 AND abs(a.residual) <= {P.TOLERANCE}, false) AS fit1, coalesce(c.txns, 1) = 1 AS single FROM left{r} c LEFT JOIN a{r} a USING (txn_id) LEFT JOIN b{r} b USING (txn_id)),
y{r} AS MATERIALIZED (SELECT *, CASE WHEN fit1 AND single THEN 'assign' WHEN h1 > 1 THEN 'multiple_candidates' WHEN h1 = 1 AND NOT fit1 THEN 'unexplained_residual' WHEN h2 > 1 THEN 'multiple_candidates'
    WHEN h2 = 1 AND single THEN 'assign' ELSE 'open' END AS verdict FROM x{r}),
pool{r} AS MATERIALIZED (SELECT o.txn_id, o.payment_id, o.lo, o.hi FROM pool o JOIN y{r} y USING (txn_id) SEMI JOIN free{r} p USING (payment_id) WHERE y.verdict = 'open'),
n{r} AS MATERIALIZED (SELECT txn_id, count(*) AS n FROM pool{r} GROUP BY 1),
tgt{r} AS (SELECT txn_id, credit AS target FROM y{r}), itm{r} AS (SELECT p.* FROM pool{r} p JOIN n{r} n USING (txn_id) WHERE n.n <= {P.MAX_POOL})"""
        + search_sql(f"tgt{r}", f"itm{r}", f"sol{r}", "txn_id")
        + f""", sum{r} AS (SELECT txn_id, count(*) AS n, any_value(ids) AS ids, any_value(residual) AS residual FROM sol{r} GROUP BY 1),
z{r} AS MATERIALIZED (SELECT y.txn_id, y.credit, CASE WHEN y.verdict <> 'open' THEN y.verdict WHEN n.n IS NULL AND NOT y.single AND (y.fit1 OR coalesce(y.h2 = 1, false)) THEN 'narration_count_conflict' WHEN n.n IS NULL THEN 'no_candidate'
    WHEN n.n > {P.MAX_POOL} THEN 'pool_exceeded' WHEN s.n IS NULL THEN 'no_subset_fits' WHEN s.n >= {P.MAX_SOLUTIONS} THEN 'solution_cap_reached' WHEN s.n > 1 THEN 'multiple_candidates'
    WHEN y.txns IS NOT NULL AND y.txns <> len(s.ids) THEN 'narration_count_conflict' ELSE 'assign' END AS verdict,
    CASE WHEN y.verdict = 'open' THEN CASE WHEN n.n IS NULL THEN '' ELSE 'tier3_subsetsum' END WHEN y.h1 IS NOT NULL AND NOT (y.fit1 AND NOT y.single) THEN 'tier1_reference' ELSE 'tier2_amount_date' END AS tier,
    CASE WHEN y.verdict = 'open' THEN s.ids WHEN y.fit1 AND y.single THEN [y.p1] ELSE [y.p2] END AS ids,
    CASE WHEN y.verdict = 'open' THEN s.residual WHEN y.fit1 AND y.single THEN y.r1 ELSE y.r2 END AS residual
  FROM y{r} y LEFT JOIN n{r} n USING (txn_id) LEFT JOIN sum{r} s USING (txn_id)),
prop{r} AS MATERIALIZED (SELECT * FROM z{r} WHERE verdict = 'assign')"""
        + evidence_sql(f"prop{r}", f"ev{r}")
        + f""", bid{r} AS MATERIALIZED (SELECT p.*, CASE WHEN NOT e.nothing THEN -log2(e.pool_size - 1) + e.field_weight END AS weight,
    (coalesce(e.name_level = 0, false) OR coalesce(e.ref_level = 0, false)) AND e.field_weight < 0 AS contradicts FROM prop{r} p JOIN ev{r} e USING (txn_id)),
key{r} AS (SELECT txn_id, unnest(ids) AS payment_id, (CASE tier WHEN 'tier1_reference' THEN 2 WHEN 'tier2_amount_date' THEN 1 ELSE 0 END) * 1e6 + coalesce(round(weight, 6), -5e5) AS strength FROM bid{r} WHERE NOT contradicts),
won{r} AS MATERIALIZED (SELECT txn_id, bool_and(claims = 1 OR (strength = top AND at_top = 1)) AS granted FROM (
  SELECT *, sum((strength = top)::INT) OVER (PARTITION BY payment_id) AS at_top FROM (SELECT *, count(*) OVER (PARTITION BY payment_id) AS claims, max(strength) OVER (PARTITION BY payment_id) AS top FROM key{r})) GROUP BY 1),
end{r} AS MATERIALIZED (SELECT z.txn_id, z.credit, CASE WHEN b.contradicts THEN 'amount_name_conflict' WHEN z.verdict = 'assign' AND NOT w.granted THEN 'contested_payment' ELSE z.verdict END AS verdict, z.tier, z.ids, z.residual, b.weight
  FROM z{r} z LEFT JOIN bid{r} b USING (txn_id) LEFT JOIN won{r} w USING (txn_id)),
done{r} AS MATERIALIZED ({f"SELECT * FROM {was} UNION ALL " if was else ""}SELECT txn_id, ids, tier, residual, weight FROM end{r} WHERE verdict = 'assign')"""
    )


def _match() -> str:
    last = P.MAX_ROUNDS
    out = CHANCE + "".join(_round(r) for r in range(1, last + 1))
    # Rounds after one that grants nothing repeat it, so the last round's refusals are those of the round that stopped.
    out += f""", rounds AS MATERIALIZED (SELECT c.txn_id, c.merchant_id, c.txn_date, c.credit, CASE WHEN d.txn_id IS NOT NULL THEN 'assign' ELSE e.verdict END AS verdict,
    coalesce(d.tier, e.tier) AS tier, d.ids, CASE WHEN d.txn_id IS NOT NULL THEN d.residual WHEN e.verdict IN ('amount_name_conflict', 'contested_payment') THEN e.residual END AS residual, coalesce(d.weight, e.weight) AS weight
  FROM parsed c LEFT JOIN done{last} d USING (txn_id) LEFT JOIN end{last} e USING (txn_id)),
gfree AS MATERIALIZED (SELECT * FROM ivl WHERE payment_id NOT IN (SELECT unnest(ids) FROM done{last})),
res0 AS (SELECT txn_id, merchant_id, (year(txn_date) * 12 + month(txn_date))::INT AS month, txn_date, credit FROM rounds WHERE verdict IN ('no_subset_fits', 'no_candidate')),
res AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY merchant_id, month) AS n, row_number() OVER (PARTITION BY merchant_id, month ORDER BY txn_date, credit, txn_id) AS pos FROM res0),
gset0 AS (SELECT merchant_id, month, txn_date AS d0, pos, [txn_id] AS txns, credit AS target FROM res WHERE n <= {P.MAX_GROUP_RESIDUE}
  UNION ALL SELECT s.merchant_id, s.month, s.d0, r.pos, list_append(s.txns, r.txn_id), s.target + r.credit FROM gset0 s JOIN res r ON r.merchant_id = s.merchant_id AND r.month = s.month AND r.pos > s.pos AND r.txn_date - s.d0 <= {P.GROUP_SPAN_DAYS}
  WHERE len(s.txns) < {P.MAX_GROUP_CREDITS}),
gset AS MATERIALIZED (SELECT *, array_to_string(list_sort(txns), '+') AS gid FROM gset0 WHERE len(txns) > 1),
gsmall AS (SELECT * FROM gset SEMI JOIN (SELECT merchant_id, month FROM gset GROUP BY 1, 2 HAVING count(*) <= {P.MAX_GROUP_SETS}) USING (merchant_id, month)),
gpool AS MATERIALIZED (SELECT DISTINCT g.gid, p.payment_id, p.lo, p.hi FROM (SELECT gid, unnest(txns) AS txn_id FROM gsmall) g JOIN pool o USING (txn_id) JOIN gfree p ON p.payment_id = o.payment_id),
gitm AS (SELECT p.* FROM gpool p SEMI JOIN (SELECT gid FROM gpool GROUP BY 1 HAVING count(*) <= {P.MAX_POOL}) USING (gid)),
gtgt AS (SELECT gid, target FROM gsmall)"""
    out += search_sql("gtgt", "gitm", "gsol", "gid")
    out += f""", gone AS MATERIALIZED (SELECT g.merchant_id, g.month, g.gid, g.txns, g.target, s.ids FROM gsmall g JOIN (SELECT gid, any_value(ids) AS ids FROM gsol GROUP BY 1 HAVING count(*) = 1) s USING (gid)),
gcred AS (SELECT gid, m, sum(CASE WHEN (m >> (k - 1)) & 1 = 1 THEN r.credit ELSE 0 END) AS c FROM (SELECT gid, txns, unnest(range(1, (1 << len(txns)) - 1)) AS m FROM gone) g, unnest(range(1, len(g.txns) + 1)) AS q(k), res r WHERE r.txn_id = g.txns[k] GROUP BY 1, 2),
gpay AS (SELECT gid, m, sum(CASE WHEN (m >> (k - 1)) & 1 = 1 THEN p.lo ELSE 0 END) AS lo, sum(CASE WHEN (m >> (k - 1)) & 1 = 1 THEN p.hi ELSE 0 END) AS hi
  FROM (SELECT gid, ids, unnest(range(1, (1 << len(ids)) - 1)) AS m FROM gone) g, unnest(range(1, len(g.ids) + 1)) AS q(k), ivl p WHERE p.payment_id = g.ids[k] GROUP BY 1, 2),
gok AS MATERIALIZED (SELECT * FROM gone WHERE gid NOT IN (SELECT c.gid FROM gcred c JOIN gpay p USING (gid) WHERE greatest(p.lo - c.c, c.c - p.hi, 0) <= {P.TOLERANCE})),
guse AS (SELECT gid, used, count(*) OVER (PARTITION BY used) AS n FROM (SELECT gid, unnest(list_concat(txns, ids)) AS used FROM gok)),
grp AS MATERIALIZED (SELECT g.merchant_id, g.month, g.gid AS txn_ids, array_to_string(g.ids, ',') AS payment_ids, g.target AS credit, CASE WHEN max(u.n) = 1 THEN 'granted' ELSE 'ambiguous_grouping' END AS outcome
  FROM gok g JOIN guse u USING (gid) GROUP BY ALL
  UNION ALL SELECT DISTINCT merchant_id, month, NULL, NULL, NULL, 'truncated' FROM res WHERE n > {P.MAX_GROUP_RESIDUE}
  UNION ALL SELECT merchant_id, month, NULL, NULL, NULL, 'truncated' FROM gset GROUP BY 1, 2 HAVING count(*) > {P.MAX_GROUP_SETS}),
gmem AS (SELECT txn_id, min(outcome) AS g, min(payment_ids) AS ids FROM (SELECT unnest(string_split(txn_ids, '+')) AS txn_id, outcome, payment_ids FROM grp WHERE txn_ids IS NOT NULL) GROUP BY 1),
verdicts AS MATERIALIZED (SELECT r.txn_id, r.merchant_id, r.credit, CASE WHEN m.g = 'granted' THEN 'grouped' WHEN m.g IS NOT NULL THEN 'ambiguous_grouping' ELSE r.verdict END AS verdict,
    CASE WHEN m.g IS NOT NULL THEN 'layer2b_group' ELSE r.tier END AS tier, CASE WHEN m.g = 'granted' THEN m.ids ELSE array_to_string(r.ids, ',') END AS payment_ids,
    CASE WHEN m.g IS NULL THEN r.residual END AS residual, round(r.weight, 6) AS weight FROM rounds r LEFT JOIN gmem m USING (txn_id)),
posted AS MATERIALIZED (SELECT txn_id, payment_ids, string_split(payment_ids, ',') AS ids FROM verdicts WHERE verdict IN ('assign', 'grouped')),
dtok AS MATERIALIZED (SELECT DISTINCT txn_id AS debit_id, debit, txn_date AS debit_date, unnest(regexp_extract_all(upper(ref_no || ' ' || narration), '([A-Z0-9]{{6,}})', 1)) AS token FROM debits),
dnamed AS MATERIALIZED (SELECT DISTINCT d.debit_id, d.debit, d.debit_date, c.txn_id, c.credit, c.txn_date FROM dtok d JOIN credits c ON upper(c.ref_no) = d.token),
dfull AS MATERIALIZED (SELECT debit_id, count(*) AS n, min(txn_id) AS credit_id FROM dnamed SEMI JOIN posted USING (txn_id) WHERE debit = credit AND txn_date <= debit_date GROUP BY 1),
dgone AS (SELECT unnest(p.ids) AS payment_id FROM dfull f JOIN posted p ON p.txn_id = f.credit_id WHERE f.n = 1),
dpart0 AS (SELECT debit_id, min(txn_id) AS credit_id, any_value(debit) AS target FROM dnamed SEMI JOIN posted USING (txn_id) WHERE credit > debit AND txn_date <= debit_date AND debit_id NOT IN (SELECT debit_id FROM dfull) GROUP BY 1 HAVING count(*) = 1),
dtgt AS MATERIALIZED (SELECT debit_id, target, credit_id FROM dpart0),
ditm AS (SELECT t.debit_id, p.payment_id, p.lo, p.hi FROM dtgt t JOIN posted s ON s.txn_id = t.credit_id JOIN ivl p ON list_contains(s.ids, p.payment_id) WHERE p.payment_id NOT IN (SELECT payment_id FROM dgone))"""
    out += search_sql("dtgt", "ditm", "dsol", "debit_id")
    out += """, dpart AS (SELECT debit_id, count(*) AS n, any_value(ids) AS ids FROM dsol GROUP BY 1),
dlink AS (SELECT n.debit_id, count(*) AS named, min(CASE WHEN v.verdict NOT IN ('assign', 'grouped', 'no_candidate') THEN n.txn_id END) AS depends_on FROM dnamed n JOIN verdicts v USING (txn_id) GROUP BY 1),
dshape AS (SELECT DISTINCT debit_id FROM dtok WHERE regexp_matches(token, '[A-Z]') AND regexp_matches(token, '[0-9]')),
dclass0 AS (SELECT d.txn_id AS debit_id, d.debit, CASE WHEN f.n = 1 THEN 'reversed' WHEN f.n > 1 THEN 'ambiguous_reversal' WHEN p.n = 1 THEN 'partially_reversed' WHEN p.n > 1 THEN 'ambiguous_reversal'
    WHEN l.depends_on IS NOT NULL THEN 'reverses_a_settlement_this_engine_refused' WHEN l.named IS NULL AND h.debit_id IS NOT NULL THEN 'reverses_a_settlement_outside_this_batch' ELSE 'no_settlement_named' END AS outcome,
    f.credit_id AS f_credit, t.credit_id AS p_credit, s.payment_ids AS f_ids, array_to_string(p.ids, ',') AS p_ids, l.depends_on
  FROM debits d LEFT JOIN dfull f ON f.debit_id = d.txn_id LEFT JOIN dpart p ON p.debit_id = d.txn_id LEFT JOIN dtgt t ON t.debit_id = d.txn_id LEFT JOIN dlink l ON l.debit_id = d.txn_id
    LEFT JOIN dshape h ON h.debit_id = d.txn_id LEFT JOIN posted s ON s.txn_id = f.credit_id),
debit_class AS MATERIALIZED (SELECT debit_id, debit, outcome, CASE outcome WHEN 'reversed' THEN f_credit WHEN 'partially_reversed' THEN p_credit END AS credit_id,
    CASE outcome WHEN 'reversed' THEN f_ids WHEN 'partially_reversed' THEN p_ids END AS payment_ids, CASE WHEN outcome = 'reverses_a_settlement_this_engine_refused' THEN depends_on END AS depends_on FROM dclass0)
"""
    return out


#: After SIDES: every credit's verdict, groups and debits, with the rounds written out one after the other.
MATCH = _match()
