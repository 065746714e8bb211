"""Declared constraints of the tables as a table of violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: NOT NULL columns and keys as declared --------------------
NOT_NULL = {
    "company": ("name",),
    "bar": ("company_id", "ts_ms"),
    "news": ("company_id", "headline"),
    "discussion": ("company_id", "title"),
    "finding": (
        "company_id", "created_at", "trigger", "primary_driver", "hypothesis", "evidence",
        "confidence", "needs_human_review", "iterations", "cost_usd",
    ),
}
KEYS = {
    "company": ("company_id",),
    "bar": ("company_id", "ts_ms"),
    "news": ("id",),
    "discussion": ("id",),
    "finding": ("id",),
}
# ----------------------------------------------------------------------------


def violations(df: DataFrame, table: str, columns: Sequence[str], keys: Sequence[str], companies: DataFrame | None = None) -> DataFrame:
    """Columns with NULLs, keys held by more than one row and, given ``companies``, company ids that are none: (table, rule, column, key, n).

    One scan and one aggregate for all three: each row counts towards the whole table, its key and its company, combined
    per map task before the shuffle. So a hot key or company is a row a task.
    """
    owner = ["company_id"] if companies is not None else []
    sets = [[], list(keys), *([owner] if owner and owner != list(keys) else [])]
    grouped = list(dict.fromkeys([*keys, *owner]))
    # the grouping columns are blank in the other sets, so their NULLs are counted from copies
    copies = {f"_is_{c}": F.col(c).isNull() for c in columns}
    rows = df.select(*grouped, *[v.alias(n) for n, v in copies.items()])
    level = F.grouping_id(*[F.col(c) for c in grouped])
    counts = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in grouped]).agg(
        level.alias("_level"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(n)).alias(n) for n in copies]
    )

    def number(names: Sequence[str]) -> int:
        return sum(1 << (len(grouped) - 1 - i) for i, c in enumerate(grouped) if c not in names)

    def entry(rule: str, column: str, key: Column, n: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"), key.cast("string").alias("key"), n.cast("long").alias("n"))

    nulls = F.array(*[entry("not_null", c, F.lit(None), F.col(f"_is_{c}")) for c in columns])
    whole = F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    same = entry("unique", ",".join(keys), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]), F.col("n"))
    found = F.when(F.col("_level") == number([]), F.filter(nulls, lambda e: e["n"] > 0))
    found = found.when((F.col("_level") == number(keys)) & whole & (F.col("n") > 1), F.array(same))
    if owner:
        lost = (F.col("_level") == number(owner)) & F.col("company_id").isNotNull()
        found = found.when(lost, F.array(entry("foreign_key", "company_id", F.col("company_id"), F.col("n"))))
    out = counts.select(F.explode(found).alias("e")).select(F.lit(table).alias("table"), "e.*")
    if owner:
        ids = companies.select(F.col("company_id").alias("_known"))
        out = out.join(ids, (F.col("rule") == "foreign_key") & (F.col("key") == F.col("_known")), "left_anti")
    return out


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """All violations of the given tables (company, bar, news, discussion, finding), each read once."""
    parts = []
    for name, df in tables.items():
        columns = [c for c in NOT_NULL[name] if c in df.columns]
        parts.append(violations(df, name, columns, KEYS[name], tables["company"] if name != "company" else None))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
