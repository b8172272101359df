"""Frozen tolerances and bounds of the matcher; changing one changes verdicts."""

# Days, minor units and search bounds that results depend on.
SETTLEMENT_WINDOW_DAYS = 3
MAX_DRIFT_DAYS = 2
LOOKBACK_DAYS = 5
TOLERANCE = 100
KNOWN_FEE_SLACK = 2
RATE_LOW, RATE_HIGH, GST = 0.018, 0.025, 0.18
MAX_POOL, MAX_SUBSET, MAX_SOLUTIONS = 20, 6, 8
MAX_ROUNDS = 6
MATERIALITY = 500_000
EPSILON_U = 1e-6
M_NAME, M_REFERENCE, M_DATE, M_AUTHORISED = 0.90, 0.99, 0.95, 0.95
U_AUTHORISED = 0.02
FS_LOWER, FS_UPPER, FS_REVIEW_CAP = 4.0, 7.0, 0.6
CORPORATE_WORDS = ("PVT", "LTD", "LIMITED", "PRIVATE", "LLP", "INC", "CO", "COMPANY", "CORP", "AND")
GROUP_SPAN_DAYS, MAX_GROUP_CREDITS, MAX_GROUP_RESIDUE, MAX_GROUP_SETS = 2, 6, 40, 20_000
PERMUTATIONS, PERMUTATIONS_FAST, PERMUTATIONS_INVARIANCE = 8, 3, 16
SAMPLED_SHARE = 0.25
# Desk of each category, hours and kind of each desk.
DESKS = {
    "treasury_confirm": (8, False),
    "collections": (24, False),
    "investigations": (48, False),
    "config_review": (72, True),
    "engineering": (4, True),
}
DESK_OF = {
    "order_dependent_assignment": "engineering",
    "multiple_candidates": "treasury_confirm",
    "solution_cap_reached": "treasury_confirm",
    "pool_exceeded": "config_review",
    "no_subset_fits": "investigations",
    "narration_count_conflict": "treasury_confirm",
    "contested_payment": "treasury_confirm",
    "amount_name_conflict": "collections",
    "unexplained_residual": "investigations",
    "ambiguous_grouping": "treasury_confirm",
    "no_candidate": "investigations",
    "reverses_a_settlement_outside_this_batch": "treasury_confirm",
    "reverses_a_settlement_this_engine_refused": "treasury_confirm",
    "ambiguous_reversal": "treasury_confirm",
    "no_settlement_named": "investigations",
}
# Banks by the letters that their references start with, and how a bank is known.
BANK_OF_CODE = {
    "AXIS": "Axis Bank", "UTIB": "Axis Bank", "HDFC": "HDFC Bank", "ICIC": "ICICI Bank", "KKBK": "Kotak Mahindra Bank", "PUNB": "Punjab National Bank",
    "SBIN": "State Bank of India", "BARB": "Bank of Baroda", "CNRB": "Canara Bank", "IBKL": "IDBI Bank", "UBIN": "Union Bank of India", "UTBI": "United Bank of India",
    "DEUT": "Deutsche Bank", "KVBL": "Karur Vysya Bank", "YESB": "Yes Bank", "INDB": "IndusInd Bank", "IDFB": "IDFC First Bank", "FDRL": "Federal Bank",
}
BANK_DERIVED, BANK_UNKNOWN, BANK_ABSENT = "derived from the transaction reference", "unrecognised bank code", "no transaction reference on this line"
# Letters that a name cut short has at least, company forms in the order they are taken off.
ENTITY_FLOOR = 8
COMPANY_ENDINGS = (" PRIVATE LIMITED", " PVT LTD", " PVT LIMITED", " LIMITED", " LTD", " LLP", " AND CO", " CO")
# Days that evidence may be old, and may lie after the batch.
EVIDENCE_STALE_DAYS, EVIDENCE_SLACK_DAYS = 400, 10
# Evidence fields with their kind, tokens, and the tokens that name money kept back; source types; words that are verdicts.
EVIDENCE_FIELDS = {
    "authorised_payer_for": ("name", (), ()),
    "refund_status": ("token", ("none", "partial", "full"), ("partial", "full")),
    "tds_confirmed": ("token", ("withheld", "not_withheld"), ("withheld",)),
    "credit_note_confirmed": ("token", ("issued", "none"), ("issued",)),
    "settlement_date_confirmed": ("date", (), ()),
    "bank_charge_confirmed": ("token", ("levied", "none"), ("levied",)),
    "chargeback_status": ("token", ("none", "raised", "won", "lost"), ()),
    "invoice_part_payment": ("token", ("paid_in_full", "short_paid"), ("short_paid",)),
}
EVIDENCE_SOURCES = ("payer_register", "invoice_ledger", "payment_record", "bank_statement", "model_assertion")
VERDICT_WORDS = ("assign", "assigned", "refuse", "refused", "refusal", "no_candidate", "match", "matched", "unmatched", "approve", "approved", "reject", "rejected", "post", "posted", "confirm_match", "accept", "accepted")
ID_SHAPES = r"(?i)^(pay_|order_|bank_txn|setl_|cand)|^[a-z]{4}[a-z0-9]{8,}$"
BARE_NUMBER = r"^[-+]?[0-9][0-9,._]*%?$"
# Who may look into a category, in order, and the categories that nobody may.
SPECIALISTS = {
    "amount_name_conflict": ("invoice",), "unexplained_residual": ("payment", "bank"), "no_subset_fits": ("invoice", "payment"), "pool_exceeded": ("bank",),
}
NEVER_INVESTIGATED = ("multiple_candidates", "ambiguous_grouping", "contested_payment", "solution_cap_reached", "order_dependent_assignment", "narration_count_conflict", "no_candidate")
