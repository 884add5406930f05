"""Column expressions for parsing, normalising and scoring single values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number pattern and the tokens that mean "no value".
NUMBER_PATTERN = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
NULL_TOKENS = ("<not counted>",)

# Drift tiers, most severe first.
DRIFT_TIERS = (("C", 0.8), ("B", 0.5), ("A", 0.2))

# Accepted spellings of the forecast model families. Families without a
# counterpart of their own are searched as boosted trees.
MODEL_ALIASES = {
    "ridge": "ridge",
    "xgboost": "xgboost",
    "xgb": "xgboost",
    "xgbregressor": "xgboost",
    "transformerlight1d": "transformerlight",
    "transformerlight": "transformerlight",
    "transformer": "transformerlight",
    "randomforest": "xgboost",
    "random_forest": "xgboost",
    "rf": "xgboost",
    "gradientboosting": "xgboost",
    "gbrt": "xgboost",
    "gbdt": "xgboost",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """The value, or null when it is NaN or infinite."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def to_number(c: Column | str) -> Column:
    """Value as a finite double, null when it is not a number."""
    return finite(_col(c).try_cast("double"))


def first_number(text: Column | str) -> Column:
    """First number anywhere in the text, null when there is none."""
    found = F.regexp_extract(_col(text), NUMBER_PATTERN, 0)
    return found.try_cast("double")


def clean_token(text: Column | str) -> Column:
    """Null for blank strings and for tokens that mean "no value"."""
    text = _col(text)
    trimmed = F.trim(text)
    return F.when((trimmed != "") & ~trimmed.isin(*NULL_TOKENS), text)


def _by_value(digits: Column) -> Column:
    size = F.length(digits).cast("string")
    return F.concat(F.length(size).cast("string"), size, F.lit(":"), digits)


def natural_sort_key(name: Column | str) -> Column:
    """Sortable array of lower-case text runs and digit runs, text first.

    A digit run is led by the number of its digits, itself led by its own length, so that runs of
    any length sort by value.
    """
    lowered = F.lower(_col(name))
    runs = F.regexp_extract_all(lowered, F.lit(r"(\d+|\D+)"), 1)
    padded = F.transform(
        runs,
        lambda r: F.when(
            r.rlike(r"^\d"),
            _by_value(F.regexp_replace(r, r"^0+(?=\d)", "")),
        ).otherwise(r),
    )
    return F.when(lowered.rlike(r"^\d"), F.concat(F.array(F.lit("")), padded)).otherwise(padded)


def relative_error(pred: Column | str, truth: Column | str, eps: float = 1e-8) -> Column:
    pred, truth = _col(pred), _col(truth)
    return F.abs(pred - truth) / F.greatest(F.abs(truth), F.lit(float(eps)))


def align_dim(vec: Column | str, dim: int) -> Column:
    """Array cut or right-padded with zeros to ``dim`` elements."""
    vec = _col(vec)
    missing = F.greatest(F.lit(0), F.lit(dim) - F.size(vec))
    return F.concat(F.slice(vec, 1, dim), F.array_repeat(F.lit(0.0), missing))


def feature_vector(features: Column | str, names: Sequence[str]) -> Column:
    """Array of the named map entries, 0.0 where absent."""
    features = _col(features)
    return F.array(*[F.coalesce(features[n], F.lit(0.0)) for n in names])


def pick_metric(kv: Column | str, keys: Sequence[str], default: float = 0.0) -> Column:
    """First of ``keys`` that is present in the metric map, as a double."""
    kv = _col(kv)
    return F.coalesce(*[kv[k].try_cast("double") for k in keys], F.lit(float(default)))


def accuracy_keys(threshold: float, prefix: str = "") -> list[str]:
    """Lookup order of accuracy metrics: configured threshold, 0.15, unqualified."""
    return [f"{prefix}acc@{threshold:g}", f"{prefix}acc@0.15", f"{prefix}acc"]


def parse_kv(kv: Column | str) -> Column:
    return F.from_json(_col(kv), "map<string,string>")


def canonical_model(name: Column | str, aliases: Mapping[str, str] = MODEL_ALIASES) -> Column:
    """Canonical family of a model name, null when unknown."""
    pairs = [F.lit(x) for item in aliases.items() for x in item]
    return F.create_map(*pairs)[F.lower(F.trim(_col(name)))]


def drift_tier(
    score: Column | str, tiers: Sequence[tuple[str, float]] = DRIFT_TIERS
) -> Column:
    """Most severe tier whose threshold the score reaches, null below all of them."""
    score = _col(score)
    return F.coalesce(*[F.when(score >= threshold, F.lit(name)) for name, threshold in tiers])


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, _col(ts))


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970-01-01 of a timestamp without time zone."""
    return epoch_micros(ts) / F.lit(1e6)


def is_sentinel(
    value: Column | str,
    headers: Column | str | None = None,
    run_id: str | None = None,
    header_key: str = "stream-sentinel",
    header_value: str = "1",
    eof_value: str = "__EOF__",
    json_flags: Sequence[str] = ("_sentinel",),
) -> Column:
    """End-of-stream marker by header, by raw value or by a truthy JSON flag.

    With a ``run_id`` header and JSON markers only count for that run; the raw value always
    counts. The marker strings are whatever the producer of the topic writes.
    """
    text = _col(value).cast("string")
    checks = [text == eof_value]
    for flag in json_flags:
        raised = F.get_json_object(text, f"$.{flag}")
        hit = raised.isNotNull() & ~F.lower(raised).isin("false", "0", "", "null")
        if run_id is not None:
            hit = hit & (F.get_json_object(text, "$.run_id") == run_id)
        checks.append(hit)
    if headers is not None:
        pairs = _col(headers)
        hit = F.exists(
            pairs, lambda h: (h["key"] == header_key) & (h["value"].cast("string") == header_value)
        )
        if run_id is not None:
            hit = hit & F.exists(
                pairs, lambda h: (h["key"] == "run_id") & (h["value"].cast("string") == run_id)
            )
        checks.append(hit)
    flagged = F.lit(False)
    for check in checks:
        flagged = flagged | F.coalesce(check, F.lit(False))
    return flagged
