"""Registered queries: features, history summaries and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame

from creditloom.operators import history
from creditloom.operators.application import ID, derived_features
from creditloom.operators.feature_matrix import applicant_lookup, feature_matrix
from creditloom.plans.registry import query


@query("feature_matrix")
def _feature_matrix(t) -> DataFrame:
    return feature_matrix(t)


@query("derived_features")
def _derived_features(t) -> DataFrame:
    return derived_features(t["application_train"])


@query("agg_bureau")
def _agg_bureau(t) -> DataFrame:
    return history.summarise_bureau(t["bureau"])


@query("agg_bureau_balance")
def _agg_bureau_balance(t) -> DataFrame:
    return history.summarise_bureau_balance(t["bureau_balance"], t["bureau"])


@query("agg_previous_application")
def _agg_previous(t) -> DataFrame:
    return history.summarise_previous_applications(t["previous_application"])


@query("agg_installments")
def _agg_installments(t) -> DataFrame:
    return history.summarise_installments(t["installments_payments"])


@query("agg_credit_card")
def _agg_credit_card(t) -> DataFrame:
    return history.summarise_credit_card(t["credit_card_balance"])


@query("agg_pos_cash")
def _agg_pos_cash(t) -> DataFrame:
    return history.summarise_pos_cash(t["pos_cash_balance"])


@query("applicant_lookup")
def _applicant_lookup(t) -> DataFrame:
    """Every card holder (labelled) and every unlabelled applicant."""
    wanted = t["credit_card_balance"].select(ID).unionByName(t["application_test"].select(ID)).distinct()
    return applicant_lookup(t, wanted)
