"""Pass-through operators that record what a table looks like."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..core import Operator, agg_row, nn, num, numeric_candidates, operator
from ..plans.quantiles import column_quantiles


@operator("DataSnapshot", "data_snapshot")
class DataSnapshot(Operator):
    description = "First n rows as records"
    defaults = {"n_rows": 5}

    def fit(self, df, cfg):
        rows = df.limit(int(cfg["n_rows"])).collect()
        return {"rows": [{k: (v if isinstance(v, (int, float, str, bool, type(None))) else str(v))
                          for k, v in r.asDict().items()} for r in rows]}

    def apply(self, df, art):
        return df


@operator("DatasetProfile", "dataset_profile")
class DatasetProfile(Operator):
    description = "Rows, columns, types, missing counts and a numeric summary"

    def fit(self, df, cfg):
        cols, nums = df.columns, numeric_candidates(df)
        exprs = [F.count("*")] + [F.count(nn(df, c)) for c in cols]
        for c in nums:
            x = num(df, c)
            exprs += [F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)]
        row = agg_row(df, exprs)
        n = row[0]
        have = dict(zip(cols, row[1:1 + len(cols)]))
        quart = column_quantiles(df, nums, [0.25, 0.5, 0.75])
        stats = {}
        for i, c in enumerate(nums):
            mean, std, lo, hi = row[1 + len(cols) + 4 * i:5 + len(cols) + 4 * i]
            q1, q2, q3 = quart[c]
            stats[c] = {"count": have[c], "mean": mean, "std": std, "min": lo, "25%": q1,
                        "50%": q2, "75%": q3, "max": hi}
        return {"rows": n, "columns": len(cols), "dtypes": dict(df.dtypes),
                "missing": {c: n - have[c] for c in cols}, "numeric_stats": stats}

    def apply(self, df, art):
        return df
