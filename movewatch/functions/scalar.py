"""Column helpers. All are built-in expressions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movewatch.schemas import TRIGGER

# --- fixed values: patterns that must match what the finding contract uses ---
FENCE = r"(?s)^```(?:json)?\s*\n?(.*?)\n?```\s*$"
ADVICE_WORDS = ("buy", "sell", "hold", "price target", "recommend")
# -----------------------------------------------------------------------------

_ISO_DATE = r"^\d{4}-\d{2}-\d{2}($|[T ])"
# Date and time with or without dashes and colons, down to the hour, minute or second.
_ISO_PARTS = r"^(\d{4})(-?)(\d{2})\2(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})([.]\d+)?)?)?(Z|[+-]\d{2}(?::?\d{2})?)?)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed exactly once per row.

    A projected column is copied into every later expression and pushed filter that names
    it. One-element arrays are exploded instead, which the optimizer does not copy: worth it
    for parsing and other costly expressions that are used many times.
    """
    for name, value in columns.items():
        df = df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
    return df


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL (not an error) when den is 0."""
    return num / F.nullif(den, F.lit(0.0))


def iso_to_ms(c: Column | str) -> Column:
    """ISO-8601 text to epoch milliseconds; NULL when the text is not a valid date.

    A value without an offset is read in the session zone (UTC here). Forms that Spark's own
    parser refuses (no seconds, no dashes) are completed first.
    """
    c = _col(c)
    part = lambda i: F.regexp_extract(c, _ISO_PARTS, i)
    of_time = lambda i: F.when(part(i) != "", part(i)).otherwise("00")
    day = F.concat_ws("-", part(1), part(3), part(4))
    offset = F.regexp_replace(part(9), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    offset = F.when(offset.endswith(":"), F.concat(offset, F.lit("00"))).otherwise(offset)
    full = F.concat(day, F.lit(" "), F.concat_ws(":", of_time(5), of_time(6), of_time(7)), part(8), offset)
    known = F.when(c.rlike(_ISO_DATE), F.try_to_timestamp(c))
    return F.unix_millis(F.coalesce(known, F.when(c.rlike(_ISO_PARTS), F.try_to_timestamp(full))))


def ms_to_s(c: Column | str) -> Column:
    """Epoch milliseconds to whole seconds, rounded down."""
    return F.floor(_col(c) / F.lit(1000)).cast("long")


def ms_to_ts(c: Column | str) -> Column:
    return F.timestamp_millis(_col(c))


def ts_to_ms(c: Column | str) -> Column:
    return F.unix_millis(_col(c).cast("timestamp"))


def is_market_hours(ts: Column | str) -> Column:
    """Mon-Fri, 09:30:00 to 16:00:00 New York time, both ends included; no holidays."""
    local = F.from_utc_timestamp(_col(ts).cast("timestamp"), "America/New_York")
    micros = F.pmod(F.unix_micros(local), F.lit(86_400_000_000))
    return (F.weekday(local) < 5) & micros.between(34_200_000_000, 57_600_000_000)


def norm_ticker(c: Column | str) -> Column:
    return F.upper(_col(c))


def blank_nulls(df: DataFrame, cols: tuple[str, ...] = ("summary", "source", "url")) -> DataFrame:
    """NULL becomes '' in the optional text columns."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in cols})


def recency_size(published_ms: Column | str, as_of_ms: Column | int) -> Column:
    """Marker size 20 falling to 8 over 72 hours, halves rounded up."""
    as_of = F.lit(as_of_ms) if isinstance(as_of_ms, int) else as_of_ms
    hours = (as_of - _col(published_ms)) / F.lit(3_600_000.0)
    size = F.greatest(F.lit(8.0), F.least(F.lit(20.0), F.lit(20.0) - hours * F.lit(12.0 / 72.0)))
    return F.floor(size + F.lit(0.5)).cast("long")


def age_label(ms: Column | str, as_of_ms: Column | int) -> Column:
    """'5m ago', '3h ago' or '2d ago', each unit rounded down."""
    as_of = F.lit(as_of_ms) if isinstance(as_of_ms, int) else as_of_ms
    minutes = F.floor((as_of - _col(ms)) / F.lit(60_000))
    hours = F.floor(minutes / F.lit(60))
    days = F.floor(hours / F.lit(24))
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .when(_col(ms).isNotNull(), F.concat(days.cast("string"), F.lit("d ago")))
    )


def pct_label(c: Column | str) -> Column:
    """'+1.25%' / '-0.40%'; zero counts as positive."""
    c = _col(c)
    sign = F.when(c >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, _fixed(c, "%.2f%%"))


def price_label(c: Column | str) -> Column:
    """'1,234.50': thousands separators and two decimals."""
    return F.format_number(_col(c), 2)


def _fixed(c: Column, pattern: str) -> Column:
    """printf text of a number; NULL stays NULL."""
    return F.when(c.isNotNull(), F.format_string(pattern, c))


def trigger_labels(df: DataFrame, col: str = "trigger") -> DataFrame:
    """Display texts of a trigger: signed z, volume multiple, arrow and absolute return."""
    t = F.col(col)
    z = t["z_score"]
    plus = F.when(z > 0, F.lit("z +")).otherwise(F.lit("z "))
    arrow = F.when(t["direction"] == "up", F.lit("▲ ")).otherwise(F.lit("▼ "))
    return df.withColumns({
        "z_label": F.concat(plus, _fixed(z, "%.2f")),
        "volume_label": F.concat(F.lit("vol ×"), _fixed(t["volume_ratio"], "%.1f")),
        "return_label": F.concat(arrow, _fixed(F.abs(t["latest_return_pct"]), "%.2f%%")),
    })


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_fence(c: Column | str) -> Column:
    """Trimmed text; when all of it is one code fence, what is inside the fence."""
    text = _strip(_col(c))
    return F.when(text.rlike(FENCE), _strip(F.regexp_extract(text, FENCE, 1))).otherwise(text)


def _word_pattern(words: tuple[str, ...]) -> str:
    # (?U): a word ends where a letter of any script ends, not only an ASCII one.
    return r"(?iuU)\b(" + "|".join(words) + r")\b"


def has_advice(c: Column | str, words: tuple[str, ...] = ADVICE_WORDS) -> Column:
    """True when the text has one of the words as a whole word, in any case."""
    return _col(c).rlike(_word_pattern(words))


def advice_hit(c: Column | str, words: tuple[str, ...] = ADVICE_WORDS) -> Column:
    """The first such word as written in the text, '' when there is none."""
    return F.regexp_extract(_col(c), _word_pattern(words), 1)


def evidence_entries(entries: Column | str) -> Column:
    """A JSON array, as a variant, to typed evidence entries; an entry that is no object has its text as ``ref``."""
    def entry(v: Column) -> Column:
        held = F.schema_of_variant(v).startswith("OBJECT")
        ref = F.when(held, F.try_variant_get(v, "$.ref", "string")).otherwise(F.try_variant_get(v, "$", "string"))
        return F.struct(
            F.try_variant_get(v, "$.type", "string").alias("type"), ref.alias("ref"), F.try_variant_get(v, "$.why", "string").alias("why")
        )
    return F.transform(F.try_variant_get(_col(entries), "$", "array<variant>"), entry)


def encode_finding(df: DataFrame) -> DataFrame:
    """Nested trigger and evidence to JSON text, boolean to 0/1. Texts that are there already are kept as they are."""
    def text(name: str) -> Column:
        made = F.to_json(name)
        return F.coalesce(F.col(f"{name}_json"), made) if f"{name}_json" in df.columns else made
    return df.withColumns({
        "trigger_json": text("trigger"),
        "evidence_json": text("evidence"),
        "needs_human_review": F.col("needs_human_review").cast("int"),
    }).drop("trigger", "evidence")


def decode_finding(df: DataFrame) -> DataFrame:
    """Typed trigger and evidence beside the JSON text of ``encode_finding``, which may hold more."""
    return df.withColumns({
        "trigger": F.from_json("trigger_json", TRIGGER),
        "evidence": evidence_entries(F.try_parse_json("evidence_json")),
        "needs_human_review": F.col("needs_human_review") != 0,
    })


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def to_api(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Top-level columns from snake_case to camelCase; nested field names stay."""
    renames = renames or {"ts_ms": "timestamp"}
    return df.select(*[F.col(c).alias(renames.get(c, _camel(c))) for c in df.columns])
