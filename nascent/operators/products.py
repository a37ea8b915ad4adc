"""Product names: canonical classes and display names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from nascent.functions import text

# The first rule with any fragment in the lowercase name wins.
CANONICAL_RULES = (
    (("credit reporting", "credit repair", "consumer reports"), "Credit reporting"),
    (("debt collection",), "Debt collection"),
    (("credit card",), "Credit card"),
    (("checking", "savings", "bank account"), "Bank account"),
    (("mortgage",), "Mortgage"),
    (("money transfer", "virtual currency", "money service"), "Money transfer"),
    (("vehicle", "auto"), "Vehicle loan"),
    (("student loan",), "Student loan"),
    (("payday", "personal loan", "title loan", "advance loan"), "Personal loan"),
    (("prepaid",), "Prepaid card"),
)
# Fixed value: the last rule needs both fragments.
DEBT_MANAGEMENT = ("debt", "management", "Debt management")

# Exact raw names with a display name of their own.
DISPLAY_NAMES = {
    "Credit reporting, credit repair services, or other personal consumer reports": "Credit Reporting",
    "Debt collection": "Debt Collection",
    "Credit card or prepaid card": "Credit Card",
    "Checking or savings account": "Bank Account",
    "Mortgage": "Mortgage",
    "Money transfer, virtual currency, or money service": "Money Transfer",
    "Vehicle loan or lease": "Vehicle Loan",
    "Payday loan, title loan, or personal loan": "Personal Loan",
    "Student loan": "Student Loan",
    "Prepaid card": "Prepaid Card",
    "Debt management": "Debt Management",
}


def canonical_product(product: Column) -> Column:
    """Canonical class of a raw product name; null stays null."""
    name = F.lower(product)
    chosen = None
    for fragments, label in CANONICAL_RULES:
        hit = reduce(lambda a, b: a | b, [name.contains(f) for f in fragments])
        chosen = F.when(hit, label) if chosen is None else chosen.when(hit, label)
    debt, management, label = DEBT_MANAGEMENT
    chosen = chosen.when(name.contains(debt) & name.contains(management), label)
    return chosen.otherwise(text.title_case(text.strip(product)))


def display_product(product: Column) -> Column:
    """Display name: exact map, else the part before the first comma in title case."""
    raw = F.coalesce(product, F.lit("Other"))
    pairs = [F.lit(part) for pair in DISPLAY_NAMES.items() for part in pair]
    fallback = text.title_case(text.strip(F.split_part(raw, F.lit(","), F.lit(1))))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), raw), fallback)
