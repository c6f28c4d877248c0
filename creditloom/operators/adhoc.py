"""The questions analysts ask directly: rates, counts, rankings and bounded listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.functions import FINE_PLACES, exact_mean, exact_sum, is_not_employed
from creditloom.operators.application import ID, LABEL
from creditloom.operators.heavy_keys import join_parents
from creditloom.operators.ordering import global_ntile
from creditloom.operators.segments import age_band, mean_days_late, rate_by_segment, tenure_band

# The row bound of a listing.
DEFAULT_ROW_BOUND = 500
MAX_ROW_BOUND = 10_000


def overall_default_rate(applications: DataFrame) -> DataFrame:
    return applications.agg(
        F.count(F.lit(1)).alias("applications"),
        F.sum(LABEL).alias("defaults"),
        F.avg(LABEL).alias("default_rate"),
    )


def rate_by_education(applications: DataFrame) -> DataFrame:
    return rate_by_segment(
        applications, F.col("NAME_EDUCATION_TYPE"), "NAME_EDUCATION_TYPE", "applications"
    ).orderBy(F.desc("default_rate"), "NAME_EDUCATION_TYPE")


def rate_by_age_band(applications: DataFrame) -> DataFrame:
    return rate_by_segment(applications, age_band(), "age_band_start", "applications").orderBy("age_band_start")


def rate_by_tenure(applications: DataFrame) -> DataFrame:
    """Three bands; applicants without employment (and without a known tenure) are left out."""
    employed = applications.filter(~is_not_employed())
    return rate_by_segment(employed, tenure_band(), "employment_band", "applications").orderBy(
        F.desc("default_rate"), "employment_band"
    )


def rate_by_credit_count(applications: DataFrame, bureau: DataFrame, cap: int = 10) -> DataFrame:
    """Rate by the number of external credits; the last group holds ``cap`` or more."""
    per_client = bureau.groupBy(ID).agg(F.count(F.lit(1)).alias("credits"))
    joined = applications.select(ID, LABEL).join(per_client, ID)
    grouped = F.least(F.col("credits"), F.lit(cap).cast("long"))
    return rate_by_segment(joined, grouped, "bureau_credits", "applications").orderBy("bureau_credits")


def clients_with_refusal(previous: DataFrame) -> DataFrame:
    refused = previous.filter(F.col("NAME_CONTRACT_STATUS") == "Refused")
    return refused.agg(F.countDistinct(ID).alias("clients_with_refusal"))


def top_by_mean(df: DataFrame, group: str, value: str, name: str, limit: int = 10) -> DataFrame:
    """The ``limit`` groups with the highest mean; unnamed groups are left out."""
    means = (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("applications"), exact_mean(value).alias(name))
    )
    return means.orderBy(F.desc(name), group).limit(limit)


def lateness_by_outcome(applications: DataFrame, installments: DataFrame) -> DataFrame:
    """Mean over clients of their average lateness, by outcome."""
    joined = applications.select(ID, LABEL).join(mean_days_late(installments), ID)
    return joined.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("clients"), exact_mean("avg_days_late", FINE_PLACES).alias("avg_days_late")
    )


def rate_by_decile(applications: DataFrame) -> DataFrame:
    scored = applications.filter(F.col("EXT_SOURCE_2").isNotNull()).select(ID, LABEL, "EXT_SOURCE_2")
    tiled = global_ntile(scored, 10, [F.col("EXT_SOURCE_2").asc(), F.col(ID).asc()], "decile")
    return rate_by_segment(tiled, F.col("decile"), "decile", "applications").orderBy("decile")


def rate_by_product(applications: DataFrame) -> DataFrame:
    return rate_by_segment(
        applications, F.col("NAME_CONTRACT_TYPE"), "NAME_CONTRACT_TYPE", "applications"
    ).orderBy(F.desc("default_rate"), "NAME_CONTRACT_TYPE")


def bounded_result(df: DataFrame, max_rows: int = DEFAULT_ROW_BOUND) -> DataFrame:
    """At most ``max_rows`` rows and, on each, whether more existed.

    One row over the bound is fetched to tell; a frame sorted before the call plans as a top-k.
    """
    if not 1 <= max_rows <= MAX_ROW_BOUND:
        raise ValueError(f"max_rows must lie between 1 and {MAX_ROW_BOUND}")
    fetched = df.limit(max_rows + 1).withColumn("_place", F.monotonically_increasing_id())
    # At most max_rows + 1 rows reach these windows.
    return (
        fetched.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > max_rows)
        .withColumn("_place", F.row_number().over(Window.orderBy("_place")))
        .filter(F.col("_place") <= max_rows)
        .drop("_place")
    )


def exposure_by_outcome(applications: DataFrame, bureau: DataFrame) -> DataFrame:
    """Mean active external credit per client, by outcome."""
    active = bureau.filter(F.col("CREDIT_ACTIVE") == "Active")
    per_client = active.groupBy(ID).agg(exact_sum("AMT_CREDIT_SUM").alias("total"))
    joined = applications.select(ID, LABEL).join(per_client, ID)
    return joined.groupBy(LABEL).agg(exact_mean("total").alias("avg_exposure"))


def credits_by_gender(applications: DataFrame, bureau: DataFrame) -> DataFrame:
    """Distinct credits per gender; a client with very many credits does not fill one task."""
    joined = join_parents(bureau.select(ID, "SK_ID_BUREAU"), applications.select(ID, "CODE_GENDER"), ID)
    return joined.groupBy("CODE_GENDER").agg(F.countDistinct("SK_ID_BUREAU").alias("credits"))


def status_distribution(balance: DataFrame, bureau: DataFrame) -> DataFrame:
    """Months per status over the credits on file.

    Months are counted per credit and status before the join, which keeps a long history from skewing it.
    """
    per_credit = balance.groupBy("SK_ID_BUREAU", "STATUS").agg(F.count(F.lit(1)).alias("months"))
    joined = per_credit.join(bureau.select("SK_ID_BUREAU"), "SK_ID_BUREAU")
    return joined.groupBy("STATUS").agg(F.sum("months").alias("months"))


def derived_table_sort(applications: DataFrame) -> DataFrame:
    return applications.select(ID, "AMT_CREDIT").orderBy(F.desc("AMT_CREDIT"), ID)


def filtered_count(applications: DataFrame, condition: Column) -> DataFrame:
    return applications.filter(condition).agg(F.count(F.lit(1)).alias("applications"))


def avg_income_defaulted(applications: DataFrame) -> DataFrame:
    defaulted = applications.filter(F.col(LABEL) == 1)
    return defaulted.agg(
        F.count(F.lit(1)).alias("defaults"), exact_mean("AMT_INCOME_TOTAL").alias("avg_income")
    )


def naive_join_fanout(applications: DataFrame, bureau: DataFrame) -> DataFrame:
    """What joining before aggregating does to a count: rows against clients, and both rates.

    The clients are counted once each, from per-client credit counts; the fanned-out figures weight each
    client by that count, which is what the naive join would have produced row by row.
    """
    per_client = bureau.groupBy(ID).agg(F.count(F.lit(1)).alias("credits"))
    joined = applications.select(ID, LABEL).join(per_client, ID)
    return joined.agg(
        F.sum("credits").alias("joined_rows"),
        F.count(F.lit(1)).alias("clients"),
        (F.sum(F.col("credits") * F.col(LABEL)) / F.sum("credits")).alias("fanned_out_rate"),
        F.avg(LABEL).alias("client_rate"),
    )


def scalar_pack(applications: DataFrame) -> DataFrame:
    """Every scalar function of the query surface on real columns."""
    from creditloom.functions import currency, humanise, percent, spread_hash, years

    label = F.col("NAME_CONTRACT_TYPE")
    return applications.select(
        ID,
        F.nullif("CNT_CHILDREN", F.lit(0)).alias("children_or_null"),
        F.coalesce("OCCUPATION_TYPE", F.lit("unknown")).alias("occupation"),
        F.least("EXT_SOURCE_2", "EXT_SOURCE_3").alias("lower_score"),
        F.greatest("EXT_SOURCE_2", "EXT_SOURCE_3").alias("higher_score"),
        F.when(F.col("DAYS_BIRTH").between(-14600, -10950), "thirties").otherwise("other").alias("age_group"),
        F.col("OCCUPATION_TYPE").isNotNull().cast("int").alias("has_occupation"),
        (~F.col("CODE_GENDER").isin("XNA")).cast("int").alias("known_gender"),
        F.col("CODE_GENDER").try_cast("int").alias("gender_number"),
        F.floor(F.col("AMT_CREDIT") / 100000).cast("long").alias("credit_step"),
        F.round("EXT_SOURCE_2", 2).alias("score_2dp"),
        F.abs("DAYS_BIRTH").alias("days_old"),
        years(F.abs("DAYS_BIRTH") * -1).alias("years_old"),
        spread_hash(ID).alias("spread"),
        (F.col(ID) % 7).alias("weekday"),
        humanise(F.upper(F.replace(label, F.lit(" "), F.lit("_")))).alias("label"),
        percent("EXT_SOURCE_2").alias("score_pct"),
        currency("AMT_CREDIT").alias("credit_text"),
    )
