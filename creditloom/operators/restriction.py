"""Cutting every history table down to a set of clients."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from creditloom.operators.application import ID

CLIENT_TABLES = (
    "bureau",
    "previous_application",
    "installments_payments",
    "credit_card_balance",
    "pos_cash_balance",
)


def restrict_to_clients(tables: Mapping[str, DataFrame], clients: DataFrame) -> dict[str, DataFrame]:
    """History tables limited to ``clients`` (a DataFrame of ids), keeping referential integrity.

    The monthly balances carry no client id; they follow the credits that were kept. The semi joins are left
    to the optimiser, which broadcasts the id set only while its measured size allows.
    """
    ids = clients.select(ID)
    kept = {name: tables[name].join(ids, ID, "left_semi") for name in CLIENT_TABLES if name in tables}
    if "bureau_balance" in tables and "bureau" in kept:
        credits = kept["bureau"].select("SK_ID_BUREAU")
        kept["bureau_balance"] = tables["bureau_balance"].join(credits, "SK_ID_BUREAU", "left_semi")
    return kept
