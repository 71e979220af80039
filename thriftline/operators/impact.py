"""Two models that turn savings into energy, money and everyday equivalents.

``measured_*`` starts from measured kilograms, ``assumed_*`` from a fixed saving
per accepted function.  They disagree on purpose; callers name the one they want.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thriftline import fixed_values as fixed
from thriftline.functions import numbers as nm


@dataclass(frozen=True)
class MeasuredRates:
    """Assumptions of the measured model, under the names they are reported by."""

    carbon_intensity_kg_per_kwh: float = fixed.CARBON_INTENSITY_KG_PER_KWH
    electricity_price_usd_per_kwh: float = fixed.ELECTRICITY_USD_PER_KWH
    eu_ets_carbon_price_usd_per_tonne: float = fixed.EU_ETS_USD_PER_TONNE
    vcm_carbon_price_usd_per_tonne: float = fixed.VCM_USD_PER_TONNE
    annual_training_runs_assumed: int = fixed.ANNUAL_RUNS


@dataclass(frozen=True)
class AssumedRates:
    energy_per_function_kwh: float = fixed.ENERGY_PER_FUNCTION_KWH
    co2_per_kwh_kg: float = fixed.CO2_PER_KWH_KG
    electricity_eur_per_kwh: float = fixed.ELECTRICITY_EUR_PER_KWH
    annual_runs: int = fixed.ANNUAL_RUNS


def measured_run(saved: Column, rates: MeasuredRates = MeasuredRates()) -> dict[str, Column]:
    """Per benchmark run.  Energy is never negative; the credit values may be."""
    energy = F.when(nm.is_positive(saved), saved / rates.carbon_intensity_kg_per_kwh).otherwise(F.lit(0.0))
    return {
        "energy_saved_kwh": energy,
        "electricity_cost_saved_usd": energy * rates.electricity_price_usd_per_kwh,
        "eu_ets_carbon_credit_value_usd": nm.kg_to_t(saved) * rates.eu_ets_carbon_price_usd_per_tonne,
        "vcm_carbon_credit_value_usd": nm.kg_to_t(saved) * rates.vcm_carbon_price_usd_per_tonne,
    }


def measured_year(saved: Column, rates: MeasuredRates = MeasuredRates()) -> dict[str, Column]:
    """Scaled to a year of runs."""
    values = {"co2_saved_kg": saved, **measured_run(saved, rates)}
    return {name: value * rates.annual_training_runs_assumed for name, value in values.items()}


def assumptions(rates: MeasuredRates = MeasuredRates()) -> Column:
    return F.struct(*[F.lit(value).alias(name) for name, value in vars(rates).items()])


def cost_estimates(saved: Column, rates: MeasuredRates = MeasuredRates()) -> Column:
    """The nested block of the savings document."""

    def block(values: dict[str, Column]) -> Column:
        return F.struct(*[value.alias(name) for name, value in values.items()])

    return F.struct(
        F.lit(
            "Energy is measured CO2 divided by grid intensity; money is energy times price; "
            "credits are tonnes times price; a year is the assumed number of runs."
        ).alias("_methodology"),
        assumptions(rates).alias("assumptions"),
        block(measured_run(saved, rates)).alias("per_benchmark_run"),
        block(measured_year(saved, rates)).alias("annual_projection"),
    )


def with_measured_run(summary: DataFrame, rates: MeasuredRates = MeasuredRates()) -> DataFrame:
    return summary.withColumns(measured_run(F.col("total_co2_saved_kg"), rates))


def with_measured_year(summary: DataFrame, rates: MeasuredRates = MeasuredRates()) -> DataFrame:
    year = measured_year(F.col("total_co2_saved_kg"), rates)
    return summary.withColumns({f"annual_{name}": value for name, value in year.items()})


def with_assumed_run(counts: DataFrame, rates: AssumedRates = AssumedRates()) -> DataFrame:
    """Energy, carbon and cost per run from the number of accepted functions."""
    return counts.withColumn("energy_kwh", F.col("optimised_functions") * rates.energy_per_function_kwh).withColumns(
        {
            "co2_kg": F.col("energy_kwh") * rates.co2_per_kwh_kg,
            "cost_eur": F.col("energy_kwh") * rates.electricity_eur_per_kwh,
        }
    )


def with_assumed_year(per_run: DataFrame, rates: AssumedRates = AssumedRates()) -> DataFrame:
    return per_run.withColumns(
        {f"annual_{name}": F.col(name) * rates.annual_runs for name in ("energy_kwh", "co2_kg", "cost_eur")}
    )


def equivalents(annual_kg: Column) -> dict[str, Column]:
    """Everyday equivalents of a year's carbon."""
    return {
        "car_km": annual_kg * 1000 / fixed.CAR_G_PER_KM,
        "phone_charges": annual_kg / fixed.PHONE_KG_PER_CHARGE,
        "streaming_hours": annual_kg / fixed.STREAMING_KG_PER_HOUR,
        "tree_days": annual_kg / fixed.TREE_KG_PER_YEAR * fixed.DAYS_PER_YEAR,
        "trees": annual_kg / fixed.TREE_KG_PER_YEAR,
    }


def equivalent_rows(per_year: DataFrame, keys: list[str]) -> DataFrame:
    """One row per equivalent, with its display text."""
    items = [
        F.struct(F.lit(name).alias("equivalent"), value.alias("amount"))
        for name, value in equivalents(F.col("annual_co2_kg")).items()
    ]
    return per_year.select(*keys, F.inline(F.array(*items))).withColumn("display", nm.magnitude(F.col("amount"), 1))


def impact_metrics(results_counts: DataFrame, rates: AssumedRates = AssumedRates()) -> DataFrame:
    """The whole report row: counts, run, year and equivalents."""
    year = with_assumed_year(with_assumed_run(results_counts, rates), rates)
    return year.withColumns(equivalents(F.col("annual_co2_kg")))
