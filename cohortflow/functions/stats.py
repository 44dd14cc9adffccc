"""Two-proportion chi-squared test as column arithmetic.

For the 2x2 table [[a, c], [b, d]] (passed/failed x before/after) the
Yates-corrected statistic with dof = 1 is

    chi2 = N * max(0, |ad - bc| - N/2)^2 / ((a+b)(c+d)(a+c)(b+d))

(the continuity correction is capped at |O - E|, as the usual library
implementation does), and p = erfc(sqrt(chi2 / 2)).  erfc is evaluated with
the published Numerical Recipes rational approximation (relative error
< 1.2e-7); significance itself is decided on chi2 against the exact 95 %
critical value so it does not depend on the approximation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published erfc approximation coefficients (Numerical Recipes, erfcc).
ERFC_COEFFS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
               0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
CHI2_CRITICAL_95 = 3.841458820694124


def with_significance(df: DataFrame, pct_before: str, n_before: str, pct_after: str,
                      n_after: str, min_n: int = 10) -> DataFrame:
    """Adds chi2, p_value, is_significant, p_label (and drops its temporaries).

    Intermediate values are separate projections so the optimiser does not
    inline the 2x2 counts into every use (keeps generated code small)."""
    pb, nb, pa, na = (F.col(c) for c in (pct_before, n_before, pct_after, n_after))
    a, b, c, d = (F.col(x) for x in ("_a", "_b", "_c", "_d"))
    x = (df.withColumn("_a", F.bround(pb * nb, 0))
         .withColumn("_c", F.bround(pa * na, 0)))
    x = x.withColumn("_b", F.bround(nb - a, 0)).withColumn("_d", F.bround(na - c, 0))
    valid = ((nb >= min_n) & (na >= min_n) & pb.isNotNull() & pa.isNotNull()
             & (F.least(a, b, c, d) >= 0)
             & ((a + b) > 0) & ((c + d) > 0) & ((a + c) > 0) & ((b + d) > 0))
    x = x.withColumn("_n", a + b + c + d).withColumn("_valid", F.coalesce(valid, F.lit(False)))
    n = F.col("_n")
    x = x.withColumn("_ex", F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2.0))
    ex = F.col("_ex")
    x = x.withColumn("_chi2", F.when(F.col("_valid"),
                                     n * ex * ex / ((a + b) * (c + d) * (a + c) * (b + d))))
    x = x.withColumn("_z", F.sqrt(F.col("_chi2") / 2.0))
    x = x.withColumn("_t", F.lit(1.0) / (F.lit(1.0) + F.col("_z") / 2.0))
    z, t = F.col("_z"), F.col("_t")
    poly = F.lit(ERFC_COEFFS[9])
    for coef in reversed(ERFC_COEFFS[1:9]):
        poly = F.lit(coef) + t * poly
    x = x.withColumn("_p", F.when(F.col("_valid"), F.least(
        F.lit(1.0), t * F.exp(-z * z + F.lit(ERFC_COEFFS[0]) + t * poly))).otherwise(F.lit(1.0)))
    p = F.col("_p")
    label = (F.when(~F.col("_valid"), F.lit("N/A"))
             .when(p < 0.001, F.lit("p<0.001"))
             .when(p < 0.05, F.format_string("p=%.3f", p))
             .otherwise(F.format_string("p=%.2f", p)))
    x = x.select("*",
                 F.when(F.col("_valid"), F.col("_chi2")).alias("chi2"),
                 F.round(p, 9).alias("p_value"),
                 F.coalesce(F.col("_valid") & (F.col("_chi2") > CHI2_CRITICAL_95), F.lit(False))
                 .alias("is_significant"),
                 label.alias("p_label"))
    return x.drop("_a", "_b", "_c", "_d", "_n", "_valid", "_ex", "_chi2", "_z", "_t", "_p")
