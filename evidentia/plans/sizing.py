"""From inputs to capacity: consumption, base, ceilings, monthly and annual scenarios."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.config import Settings
from evidentia.functions.numbers import half_up


def consumed(inputs: DataFrame) -> DataFrame:
    """``inputs`` with mean, peak and their ratio for the workload (primaries) and for the full cluster.

    A ratio without a mean is null.
    """
    c = F.col

    def both(kind: str) -> tuple[Column, Column]:
        own = c("shards") * c("ho_vcpu") * c(f"primary_{kind}")
        full = own + c("shards") * c("ho_vcpu") * c(f"ho_sec_{kind}") + c("shards") * c("dr_vcpu") * c(f"dr_{kind}")
        return own, full

    (avg, full_avg), (peak, full_peak) = both("avg"), both("peak")
    return inputs.withColumns({
        "work_avg": avg, "work_peak": peak, "work_ratio": F.try_divide(peak, avg),
        "full_avg": full_avg, "full_peak": full_peak, "full_ratio": F.try_divide(full_peak, full_avg),
    })


def base_for(peak: Column, avg: Column, n) -> Column:
    """What to provide: the peak's share or the mean, whichever is more, rounded up."""
    return F.ceil(F.greatest(peak / n, avg))


def scenarios(sized: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Two rows per row of consumed(): base, ceilings and costs; a year is twelve rounded months."""
    s, r = settings.sizing, settings.rates
    postures = F.array(
        F.struct(F.lit("conservative").alias("posture"), F.lit(s.conservative).alias("n")),
        F.struct(F.lit("aggressive").alias("posture"), F.lit(s.aggressive).alias("n")),
    )
    rows = sized.withColumn("p", F.explode(postures)).withColumn("base", base_for(F.col("work_peak"), F.col("work_avg"), F.col("p.n")))
    compute = half_up(F.col("base") * r.per_hour * r.hours_per_month)
    storage = half_up(F.col("storage_gb") * r.per_gb_month)
    rows = rows.withColumns({"monthly_compute": compute, "monthly_storage": storage})
    return rows.select(
        *[c for c in sized.columns], F.col("p.posture").alias("posture"), "base",
        *[(F.col("base") * m).alias(f"ceiling_{m}x") for m in s.multipliers],
        "monthly_compute", "monthly_storage",
        (F.col("monthly_compute") + F.col("monthly_storage")).alias("total_monthly"),
        (12 * (F.col("monthly_compute") + F.col("monthly_storage"))).alias("total_annual"),
    )


def restore_hours(terabytes: Column, settings: Settings = Settings()) -> Column:
    """Hours to restore a backup, rounded up; a negative size or none is an error."""
    s = settings.sizing
    good = (terabytes >= 0) & ~F.isnan(terabytes)
    hours = F.ceil(F.lit(s.restore_base_hours) + F.lit(s.restore_hours_per_tb) * terabytes)
    return F.when(good, hours).otherwise(F.raise_error(F.lit("a size is a number of 0 or more")).cast("bigint"))
