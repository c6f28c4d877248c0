"""The tables of a portfolio: source file, published row count and what a row is."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SourceTable:
    name: str
    filename: str
    #: Published row count; None when none is stated.
    expected_rows: int | None
    description: str
    #: None lets the file decide, at the price of one more pass over it.
    encoding: str | None = None
    #: Whether quoted fields hold line breaks.
    multi_line: bool = False


# File names and published row counts.
MANIFEST: tuple[SourceTable, ...] = (
    SourceTable("application_train", "application_train.csv", 307_511, "Labelled loan applications"),
    SourceTable("application_test", "application_test.csv", 48_744, "Unlabelled loan applications"),
    SourceTable("bureau", "bureau.csv", 1_716_428, "Credits at other lenders"),
    SourceTable("bureau_balance", "bureau_balance.csv", 27_299_925, "Monthly status of those credits"),
    SourceTable(
        "previous_application", "previous_application.csv", 1_670_214, "Earlier applications at this lender"
    ),
    SourceTable(
        "installments_payments", "installments_payments.csv", 13_605_401, "Repayments due and repayments made"
    ),
    SourceTable("credit_card_balance", "credit_card_balance.csv", 3_840_312, "Monthly card statements"),
    SourceTable("pos_cash_balance", "POS_CASH_balance.csv", 10_001_358, "Monthly cash and point-of-sale loans"),
    SourceTable(
        "column_descriptions", "HomeCredit_columns_description.csv", None, "Glossary of all columns", multi_line=True
    ),
)

DESCRIPTIONS: dict[str, str] = {t.name: t.description for t in MANIFEST}
