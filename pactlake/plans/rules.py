"""Rule dimensions: fixed values that results depend on; titles and questions are our own words.

Predicates are nested tuples, e.g. ``("all_of", ("gt", field, 6), ...)``.
"""

from __future__ import annotations

# --- fixed values: vocabulary -------------------------------------------------------------------
NUMBERS = [
    "noticeDaysYouMustGive", "noticeDaysTheyMustGive", "cureDaysYouGet", "cureDaysTheyGet", "lockInMonths", "termMonths",
    "depositRefundDays", "paymentTermDays", "dataRetentionDays", "confidentialityMonths", "nonCompeteMonths", "monthlyRentInr",
    "securityDepositInr", "annualRentIncreasePercent", "annualCtcInr", "bondAmountInr", "bondMonths", "principalInr",
    "annualInterestPercent", "processingFeePercent", "prepaymentPenaltyPercent", "latePaymentPercentPerMonth", "liabilityCapInr",
]

CONSTRUCTS = [
    "unilateral_amendment_without_notice", "unilateral_arbitrator_appointment", "contractual_limitation_period", "self_help_remedy",
    "forfeiture_of_paid_amounts", "sole_discretion_on_payment", "post_employment_non_compete", "unlimited_indemnity",
    "automatic_renewal_without_notice", "assignment_of_future_ip", "class_action_waiver", "cross_default", "deposit_refund_timeline",
    "notice_period_for_you", "exit_or_termination_route", "jurisdiction_clause", "data_retention_limit", "liability_cap_in_your_favour",
    "rent_increase_cap", "grievance_officer_named",
]

CATEGORIES = [
    "payment", "termination", "lock_in", "deposit", "penalty", "liability", "dispute_resolution", "restraint_of_trade", "ip_assignment",
    "confidentiality", "data_use", "unilateral_change", "renewal", "indemnity", "jurisdiction", "other",
]

DOCUMENT_TYPES = ("rent_agreement", "employment_offer", "loan_agreement", "freelance_contract", "nda", "privacy_policy", "other")

# --- fixed values: scoring ----------------------------------------------------------------------
SATURATION = 45
TIER_CAPS = {"asymmetry": 40, "threshold": 45, "construct": 45, "absence": 40}
BANDS = ((24, "low"), (49, "moderate"), (74, "high"), (100, "severe"))

#: Integer and range bounds of the facts, for validation: field -> (integer, low, high).
BOUNDS = {
    "noticeDaysYouMustGive": (True, 0, 3650), "noticeDaysTheyMustGive": (True, 0, 3650), "cureDaysYouGet": (True, 0, 3650),
    "cureDaysTheyGet": (True, 0, 3650), "lockInMonths": (False, 0, 600), "termMonths": (False, 0, 1200),
    "depositRefundDays": (True, 0, 730), "paymentTermDays": (True, 0, 365), "dataRetentionDays": (True, 0, 36500),
    "confidentialityMonths": (False, 0, 12000), "nonCompeteMonths": (False, 0, 600), "monthlyRentInr": (False, 0, None),
    "securityDepositInr": (False, 0, None), "annualRentIncreasePercent": (False, 0, 200), "annualCtcInr": (False, 0, None),
    "bondAmountInr": (False, 0, None), "bondMonths": (False, 0, 240), "principalInr": (False, 0, None),
    "annualInterestPercent": (False, 0, 500), "processingFeePercent": (False, 0, 100), "prepaymentPenaltyPercent": (False, 0, 100),
    "latePaymentPercentPerMonth": (False, 0, 100), "liabilityCapInr": (False, 0, None),
}

_RENT, _JOB, _LOAN, _FREE, _NDA, _PRIV, _OTHER = DOCUMENT_TYPES


def _band(low, high):
    return ("all_of", low, ("not", high))


def _ratio(a, b, v):
    return ("ratio_gte", a, b, v)


def _present(c):
    return ("construct_present", c)


def _absent(c):
    return ("construct_absent", c)


_NOTICE, _CURE = ("noticeDaysYouMustGive", "noticeDaysTheyMustGive"), ("cureDaysTheyGet", "cureDaysYouGet")
_LATE = ("latePaymentPercentPerMonth", "annualInterestPercent")
_DEPOSIT, _BOND = ("multiple_gte", "securityDepositInr", "monthlyRentInr", 1), ("multiple_gte", "bondAmountInr", "annualCtcInr", 12)

# --- fixed values: rules (id, tier, severity, weight, applies to, evidence from, predicate) ------
RULES = [
    ("notice_period_asymmetry_severe", "asymmetry", "high", 18, (), "noticeDaysYouMustGive", _ratio(*_NOTICE, 2)),
    ("notice_period_asymmetry_moderate", "asymmetry", "medium", 10, (), "noticeDaysYouMustGive", _band(_ratio(*_NOTICE, 1.5), _ratio(*_NOTICE, 2))),
    ("cure_period_asymmetry_severe", "asymmetry", "high", 16, (), "cureDaysTheyGet", _ratio(*_CURE, 2)),
    ("cure_period_asymmetry_moderate", "asymmetry", "medium", 9, (), "cureDaysTheyGet", _band(_ratio(*_CURE, 1.5), _ratio(*_CURE, 2))),
    ("liability_cap_exceeds_a_year_of_pay", "asymmetry", "high", 16, (_JOB, _FREE), "liabilityCapInr", _ratio("liabilityCapInr", "annualCtcInr", 1)),
    ("liability_cap_below_one_month_of_rent", "asymmetry", "medium", 8, (_RENT,), "liabilityCapInr", ("not", _ratio("liabilityCapInr", "monthlyRentInr", 1))),
    ("default_interest_doubles_the_contract_rate", "asymmetry", "high", 16, (_LOAN, _FREE), _LATE[0], _ratio(*_LATE, 0.1667)),
    ("default_interest_exceeds_the_contract_rate", "asymmetry", "medium", 9, (_LOAN, _FREE), _LATE[0], _band(_ratio(*_LATE, 0.125), _ratio(*_LATE, 0.1667))),
    ("security_deposit_three_months_rent_or_more", "threshold", "high", 16, (_RENT,), "securityDepositInr", (*_DEPOSIT, 3)),
    ("security_deposit_two_to_three_months_rent", "threshold", "medium", 8, (_RENT,), "securityDepositInr", _band((*_DEPOSIT, 2), (*_DEPOSIT, 3))),
    ("lock_in_longer_than_six_months", "threshold", "high", 15, (_RENT, _JOB, _FREE), "lockInMonths", ("gt", "lockInMonths", 6)),
    ("lock_in_four_to_six_months", "threshold", "medium", 8, (_RENT, _JOB, _FREE), "lockInMonths", _band(("gte", "lockInMonths", 4), ("gt", "lockInMonths", 6))),
    ("rent_escalation_above_ten_percent", "threshold", "high", 14, (_RENT,), "annualRentIncreasePercent", ("gt", "annualRentIncreasePercent", 10)),
    ("employment_bond_above_six_months_ctc", "threshold", "high", 16, (_JOB,), "bondAmountInr", (*_BOND, 6)),
    ("employment_bond_three_to_six_months_ctc", "threshold", "medium", 9, (_JOB,), "bondAmountInr", _band((*_BOND, 3), (*_BOND, 6))),
    ("confidentiality_beyond_five_years_or_perpetual", "threshold", "high", 14, (_NDA, _JOB, _FREE), "confidentialityMonths", ("gt", "confidentialityMonths", 60)),
    ("payment_terms_longer_than_forty_five_days", "threshold", "high", 15, (_FREE, _OTHER), "paymentTermDays", ("gt", "paymentTermDays", 45)),
    ("loan_interest_above_thirty_six_percent", "threshold", "high", 18, (_LOAN,), "annualInterestPercent", ("gt", "annualInterestPercent", 36)),
    ("loan_interest_twenty_four_to_thirty_six_percent", "threshold", "medium", 10, (_LOAN,), "annualInterestPercent", _band(("gte", "annualInterestPercent", 24), ("gt", "annualInterestPercent", 36))),
    ("penal_charge_above_twenty_four_percent_a_year", "threshold", "high", 14, (_LOAN, _RENT, _FREE), _LATE[0], ("gt", _LATE[0], 2)),
    ("data_retention_beyond_five_years", "threshold", "high", 13, (_PRIV, _OTHER), "dataRetentionDays", ("gt", "dataRetentionDays", 1825)),
    ("post_employment_non_compete_term_stated", "threshold", "high", 12, (_JOB, _NDA, _FREE), "nonCompeteMonths", ("gt", "nonCompeteMonths", 0)),
    *(
        (f"construct_{c}", "construct", severity, weight, (), c, _present(c))
        for c, severity, weight in (
            ("unilateral_amendment_without_notice", "high", 16), ("unilateral_arbitrator_appointment", "high", 18),
            ("contractual_limitation_period", "high", 16), ("self_help_remedy", "high", 18), ("forfeiture_of_paid_amounts", "high", 16),
            ("sole_discretion_on_payment", "high", 15), ("unlimited_indemnity", "critical", 18), ("automatic_renewal_without_notice", "medium", 10),
            ("assignment_of_future_ip", "high", 15), ("class_action_waiver", "high", 14), ("cross_default", "high", 14),
        )
    ),
    *(
        (f"absent_{c}", "absence", severity, weight, applies, c, _absent(c))
        for c, severity, weight, applies in (
            ("deposit_refund_timeline", "high", 14, (_RENT,)), ("notice_period_for_you", "high", 12, ()), ("exit_or_termination_route", "high", 16, ()),
            ("jurisdiction_clause", "medium", 8, ()), ("data_retention_limit", "high", 12, (_PRIV, _OTHER)), ("liability_cap_in_your_favour", "medium", 10, ()),
            ("rent_increase_cap", "medium", 10, (_RENT,)), ("grievance_officer_named", "medium", 10, (_PRIV, _OTHER)),
        )
    ),
    ("absent_exit_route_and_notice_period", "absence", "critical", 20, (), "exit_or_termination_route", ("all_of", _absent("exit_or_termination_route"), _absent("notice_period_for_you"))),
    ("absent_deposit_timeline_and_jurisdiction", "absence", "high", 14, (_RENT,), "deposit_refund_timeline", ("all_of", _absent("deposit_refund_timeline"), _absent("jurisdiction_clause"))),
]

# --- fixed values: statute rows (construct, verdict, confidence, section, applies to) ------------
STATUTES = [
    ("unilateral_arbitrator_appointment", "likely_unenforceable_as_written", "high", "Section 12(5)", ()),
    ("unilateral_arbitrator_appointment", "cannot_oust_this_forum", "high", "Section 100", (_RENT, _LOAN, _PRIV, _OTHER)),
    ("forfeiture_of_paid_amounts", "context_dependent", "medium", "Section 2(46)(i) and 2(46)(ii)", (_RENT, _LOAN, _PRIV, _OTHER)),
    ("unilateral_amendment_without_notice", "context_dependent", "medium", "Section 2(46)(iv) and 2(46)(vi)", (_PRIV, _LOAN, _RENT, _OTHER)),
    ("class_action_waiver", "cannot_oust_this_forum", "medium", "Section 35(1)(c)", (_PRIV, _LOAN, _OTHER)),
    ("post_employment_non_compete", "likely_void", "high", "Section 27", (_JOB, _NDA, _FREE)),
    ("contractual_limitation_period", "likely_void", "high", "Section 28(b)", ()),
    ("forfeiture_of_paid_amounts", "capped_by_statute", "high", "Section 74", ()),
    ("sole_discretion_on_payment", "context_dependent", "medium", "Section 23", (_JOB, _FREE, _OTHER)),
    ("forfeiture_of_paid_amounts", "context_dependent", "low", "Section 11", (_RENT,)),
    ("self_help_remedy", "likely_unenforceable_as_written", "high", "Section 6", (_RENT,)),
]
VERDICT_WEIGHTS = {
    "likely_void": 5, "likely_unenforceable_as_written": 4, "cannot_oust_this_forum": 3, "capped_by_statute": 2,
    "enforceable_but_negotiable": 1, "context_dependent": 0,
}
CONSTRUCT_CATEGORY = {
    "post_employment_non_compete": "restraint_of_trade", "contractual_limitation_period": "dispute_resolution",
    "unilateral_arbitrator_appointment": "dispute_resolution", "forfeiture_of_paid_amounts": "penalty", "unlimited_indemnity": "indemnity",
    "unilateral_amendment_without_notice": "unilateral_change", "automatic_renewal_without_notice": "renewal",
    "assignment_of_future_ip": "ip_assignment", "self_help_remedy": "termination", "sole_discretion_on_payment": "payment",
    "class_action_waiver": "dispute_resolution", "cross_default": "termination",
}

# --- fixed values: forums (id, limitation rule, document types, triggers (kind, detail)) ----------
FORUMS = [
    ("consumer_commission", "cpa-2019-s69", (_LOAN, _PRIV, _OTHER), [
        *(("problem", p) for p in ("goods_or_services_defect", "bank_or_loan_conduct", "insurance_claim", "builder_delay_or_refund")),
        *(("construct", c) for c in ("forfeiture_of_paid_amounts", "unilateral_amendment_without_notice", "automatic_renewal_without_notice")),
        ("verdict", "cannot_oust_this_forum"), ("risk_driver", "critical")]),
    ("rera_authority", None, (), [("problem", "builder_delay_or_refund")]),
    ("labour_conciliation", "id-act-1947-s2a3", (_JOB,), [("problem", "unpaid_salary_or_termination"), ("risk_driver", "high"), ("risk_driver", "critical")]),
    ("msefc", "limitation-act-1963-art55", (_FREE,), [("problem", "unpaid_invoice"), ("construct", "sole_discretion_on_payment"), ("risk_driver", "critical")]),
    ("rbi_ombudsman", "rbi-ios-2026-c10", (_LOAN,), [("problem", "bank_or_loan_conduct"), ("construct", "self_help_remedy"), ("risk_driver", "critical")]),
    ("insurance_ombudsman", "insurance-ombudsman-rules-2017-r14", (), [("problem", "insurance_claim")]),
    ("grievance_appellate_committee", "it-rules-2021-r3a", (_PRIV,), [("problem", "platform_action_or_privacy"), ("construct", "unilateral_amendment_without_notice"), ("risk_driver", "high"), ("risk_driver", "critical")]),
    ("legal_services_authority", None, (), [("situation", "cannot_afford_lawyer"), ("universal", "legal_services_authority")]),
    ("lok_adalat", None, (), [("situation", "prefers_settlement"), ("universal", "lok_adalat")]),
]
PREREQUISITES = [  # forum, place, days to wait, what (our words)
    ("labour_conciliation", 1, 45, "conciliation officer first"),
    ("labour_conciliation", 2, None, "provident fund matters go elsewhere"),
    ("msefc", 1, None, "register as a small enterprise"),
    ("rbi_ombudsman", 1, 30, "complain to the lender first"),
    ("insurance_ombudsman", 1, 30, "write to the insurer first"),
    ("grievance_appellate_committee", 1, 15, "complain to the grievance officer first"),
]
#: id, unit, count, condonation possible
LIMITATIONS = [
    ("cpa-2019-s69", "months", 24, True), ("limitation-act-1963-art55", "months", 36, False), ("ni-act-1881-s142", "months", 1, True),
    ("id-act-1947-s2a3", "months", 36, False), ("rbi-ios-2026-c10", "days", 90, False),
    ("insurance-ombudsman-rules-2017-r14", "months", 12, True), ("it-rules-2021-r3a", "days", 30, False),
]
STAGES = [  # limitation rule, place, days, label (our words)
    ("cpa-2019-s69", 1, 45, "appeal to the state commission"),
    ("cpa-2019-s69", 2, 30, "appeal to the national commission"),
    ("ni-act-1881-s142", 1, 30, "demand notice to the drawer"),
    ("ni-act-1881-s142", 2, 15, "drawer's time to pay"),
    ("id-act-1947-s2a3", 1, 45, "wait after applying for conciliation"),
    ("it-rules-2021-r3a", 1, 1, "officer acknowledges the complaint"),
    ("it-rules-2021-r3a", 2, 15, "officer resolves the complaint"),
]
PROBLEMS = (
    "goods_or_services_defect bank_or_loan_conduct insurance_claim builder_delay_or_refund unpaid_salary_or_termination "
    "unpaid_invoice platform_action_or_privacy"
).split()


#: What a rule that fired says, in our words; ``{field}`` is filled with the document's number.
EXPLANATIONS = {
    "notice_period_asymmetry_severe": "You have to give {noticeDaysYouMustGive} days of notice, the other side {noticeDaysTheyMustGive}: at least twice as long for you.",
    "notice_period_asymmetry_moderate": "Your notice is {noticeDaysYouMustGive} days and theirs {noticeDaysTheyMustGive}, so leaving takes you noticeably longer.",
    "cure_period_asymmetry_severe": "They have {cureDaysTheyGet} days to put a breach right, you have {cureDaysYouGet}: half of it or less.",
    "cure_period_asymmetry_moderate": "They have {cureDaysTheyGet} days to put a breach right and you {cureDaysYouGet}, which is a good deal less.",
    "liability_cap_exceeds_a_year_of_pay": "What you may have to pay is limited to Rs {liabilityCapInr} only; a year of your pay is Rs {annualCtcInr}.",
    "liability_cap_below_one_month_of_rent": "They answer for no more than Rs {liabilityCapInr}, which is under one month of your rent of Rs {monthlyRentInr}.",
    "default_interest_doubles_the_contract_rate": "Late sums cost {latePaymentPercentPerMonth} percent a month, twice the yearly rate of {annualInterestPercent} percent or more.",
    "default_interest_exceeds_the_contract_rate": "Late sums cost {latePaymentPercentPerMonth} percent a month, well above the yearly rate of {annualInterestPercent} percent.",
    "security_deposit_three_months_rent_or_more": "The deposit of Rs {securityDepositInr} is three or more months of the rent of Rs {monthlyRentInr}.",
    "security_deposit_two_to_three_months_rent": "The deposit of Rs {securityDepositInr} is between two and three months of the rent of Rs {monthlyRentInr}.",
    "lock_in_longer_than_six_months": "You are bound for {lockInMonths} months before you may leave.",
    "lock_in_four_to_six_months": "For {lockInMonths} months you may not leave without paying for it.",
    "rent_escalation_above_ten_percent": "The rent goes up by {annualRentIncreasePercent} percent each year.",
    "employment_bond_above_six_months_ctc": "Leaving early costs Rs {bondAmountInr}, over half of the yearly pay of Rs {annualCtcInr}.",
    "employment_bond_three_to_six_months_ctc": "Leaving early costs Rs {bondAmountInr}, a quarter to a half of the yearly pay of Rs {annualCtcInr}.",
    "confidentiality_beyond_five_years_or_perpetual": "Your duty of silence lasts {confidentialityMonths} months.",
    "payment_terms_longer_than_forty_five_days": "Your invoices may stay open for {paymentTermDays} days.",
    "loan_interest_above_thirty_six_percent": "The loan costs {annualInterestPercent} percent a year.",
    "loan_interest_twenty_four_to_thirty_six_percent": "At {annualInterestPercent} percent a year the loan is dear.",
    "penal_charge_above_twenty_four_percent_a_year": "Being late costs {latePaymentPercentPerMonth} percent a month, over a quarter of the sum in a year.",
    "data_retention_beyond_five_years": "Your data is held for {dataRetentionDays} days.",
    "post_employment_non_compete_term_stated": "For {nonCompeteMonths} months after leaving you are to stay out of the trade.",
    "construct_unilateral_amendment_without_notice": "They may change the terms alone and need not tell you first.",
    "construct_unilateral_arbitrator_appointment": "They alone choose who decides a dispute between you.",
    "construct_contractual_limitation_period": "Claims end sooner than the law would have them end.",
    "construct_self_help_remedy": "They may act against you without going to a court.",
    "construct_forfeiture_of_paid_amounts": "Money that you have paid may be kept, whatever the harm was.",
    "construct_sole_discretion_on_payment": "Whether you are paid is left to their judgement.",
    "construct_unlimited_indemnity": "You answer for their losses without any limit.",
    "construct_automatic_renewal_without_notice": "The contract goes on by itself, and nobody reminds you.",
    "construct_assignment_of_future_ip": "What you make later, too, is theirs from the start.",
    "construct_class_action_waiver": "You give up joining others in one claim.",
    "construct_cross_default": "A default elsewhere counts as one here.",
    "absent_deposit_refund_timeline": "No date is set by which the deposit comes back.",
    "absent_notice_period_for_you": "It is not said how much notice you have to give.",
    "absent_exit_or_termination_route": "There is no way out before the term ends.",
    "absent_jurisdiction_clause": "It is not said which courts are competent.",
    "absent_data_retention_limit": "There is no end to the keeping of your data.",
    "absent_liability_cap_in_your_favour": "Nothing limits what you may have to pay.",
    "absent_rent_increase_cap": "Nothing limits how far the rent may rise.",
    "absent_grievance_officer_named": "Nobody is named who hears complaints.",
    "absent_exit_route_and_notice_period": "There is neither a way out nor a period of notice.",
    "absent_deposit_timeline_and_jurisdiction": "Neither the return of the deposit nor the courts are settled.",
}
#: What to ask about a rule that could not be decided, in our words; the others have a question made of their title.
QUESTIONS = {
    "security_deposit_three_months_rent_or_more": "How many months of rent is the deposit, and when is it paid back?",
    "lock_in_longer_than_six_months": "What do I owe if I leave during the lock-in?",
    "rent_escalation_above_ten_percent": "By how much may the rent rise in a year?",
    "employment_bond_above_six_months_ctc": "Which costs does the bond cover, and who proves them?",
    "confidentiality_beyond_five_years_or_perpetual": "When does the duty of silence end?",
    "payment_terms_longer_than_forty_five_days": "Within how many days is an invoice paid?",
    "loan_interest_above_thirty_six_percent": "What does the loan cost in a year, all charges included?",
    "data_retention_beyond_five_years": "How long is my data kept, and who deletes it?",
    "construct_unlimited_indemnity": "Is there a limit to what I answer for?",
    "construct_contractual_limitation_period": "Until when can I bring a claim?",
    "absent_exit_or_termination_route": "How can I end this contract early?",
    "absent_jurisdiction_clause": "Which courts decide if we disagree?",
}
#: Published figures that thresholds rest on, in our words; most rules have none.
BENCHMARKS = {
    "default_interest_doubles_the_contract_rate": "RBI circular of 18 August 2023: penal charges are no addition to the rate of interest",
    "security_deposit_three_months_rent_or_more": "Model Tenancy Act, 2021: two months of rent for a home",
    "security_deposit_two_to_three_months_rent": "Model Tenancy Act, 2021: two months of rent for a home",
    "employment_bond_above_six_months_ctc": "Indian Contract Act, 1872, section 74: reasonable compensation, up to the sum named",
    "employment_bond_three_to_six_months_ctc": "Indian Contract Act, 1872, section 74: reasonable compensation, up to the sum named",
    "payment_terms_longer_than_forty_five_days": "MSMED Act, 2006, section 15: forty-five days",
    "penal_charge_above_twenty_four_percent_a_year": "RBI circular of 18 August 2023: penal charges are no addition to the rate of interest",
    "data_retention_beyond_five_years": "DPDP Act, 2023, section 8(7): data go when their purpose is served",
    "post_employment_non_compete_term_stated": "Indian Contract Act, 1872, section 27: agreements in restraint of trade are void",
    "absent_deposit_refund_timeline": "Model Tenancy Act, 2021: the deposit comes back when the home is handed over",
    "absent_data_retention_limit": "DPDP Act, 2023, section 8(7): data go when their purpose is served",
}


def question(rule_id: str) -> str:
    return QUESTIONS.get(rule_id, f"The document leaves this open: {title(rule_id)}.")


def title(rule_id: str) -> str:
    return rule_id.replace("_", " ").capitalize()


def inputs(predicate: tuple) -> list[str]:
    """Names a predicate depends on, in order, repeats included."""
    op, *rest = predicate
    if op in ("all_of", "any_of", "not"):
        return [name for child in rest for name in inputs(child)]
    if op in ("ratio_gte",):
        return list(rest[:2])
    if op == "multiple_gte":
        return list(rest[:2])
    return [rest[0]]
