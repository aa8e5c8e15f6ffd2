"""Small column expressions: null-safe arithmetic, text, labels, schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column) -> Column:
    """num/den, NULL for a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def log_positive(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(_col(c), digits)


def null_if_nan(c: Column | str) -> Column:
    """The engine knows one missing value, NULL."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def to_number(c: Column | str) -> Column:
    """Text to double; anything unparsable, NaN and blanks included, becomes NULL."""
    return null_if_nan(F.trim(_col(c).cast("string")).try_cast("double"))


# The characters a text split on whitespace breaks at.
WHITESPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def clean_text(c: Column | str) -> Column:
    """Collapse whitespace runs to one blank and trim; NULL becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), WHITESPACE_CLASS, " "))


def json_list(c: Column | str) -> Column:
    """JSON text list to array of cleaned, non-empty strings."""
    items = F.from_json(clean_text(c), "array<string>")
    cleaned = F.transform(items, lambda x: clean_text(x))
    return F.coalesce(F.filter(cleaned, lambda x: x != ""), F.array().cast("array<string>"))


def json_int_map(c: Column | str) -> Column:
    """JSON object of integers to a map; blank text gives an empty map."""
    return F.coalesce(F.from_json(clean_text(c), "map<string,int>"), F.create_map().cast("map<string,int>"))


def significance_stars(p: Column | str) -> Column:
    p = _col(p)
    return (
        F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")
    )


def maturity_label(months: Column | str) -> Column:
    m = _col(months)
    return F.when(m % 12 == 0, F.concat((m / 12).cast("int").cast("string"), F.lit("y"))).otherwise(
        F.concat(m.cast("string"), F.lit("m"))
    )


def score_cell(r2: Column | str, p: Column | str) -> Column:
    """R2 in percent with one decimal; stars only where R2 is positive."""
    r2 = _col(r2)
    stars = F.when(r2 > 0, significance_stars(p)).otherwise("")
    return F.concat(F.format_string("%.1f", r2 * 100), stars)


def feature_block(feature: Column | str) -> Column:
    """Block of an attribution feature path: forward, the group of fred::group::x, else the head."""
    parts = F.split(_col(feature), "::")
    head = F.get(parts, F.lit(0))
    return F.when((head == "fred") & (F.size(parts) >= 3), F.get(parts, F.lit(1))).otherwise(head)


def feature_display(feature: Column | str) -> Column:
    """Short display name of an attribution feature path."""
    f = _col(feature)
    parts = F.split(f, "::")
    head, n = F.get(parts, F.lit(0)), F.size(parts)
    last = F.get(parts, n - 1)
    return (
        F.when((head == "forward") & (n > 1), F.concat(F.lit("fwd "), last))
        .when(head == "forward", "fwd")
        .when((head == "fred") & (n >= 3), F.get(parts, F.lit(2)))
        .when(n >= 2, F.get(parts, F.lit(1)))
        .otherwise(f)
    )


def model_family(run_name: Column | str) -> Column:
    """Model family read off a run name; the first matching rule wins."""
    t = F.lower(_col(run_name))
    has = lambda s: t.contains(s)
    return (
        F.when(has("group") | has("grp"), "group_ensemble_ann")
        .when(has("macro") & has("fwd"), "macro_forward_ann")
        .when(has("fwd_ann") | t.startswith("fwd"), "forward_ann")
        .when(has("pca"), "pca")
        .when(has("pls"), "pls")
        .when(has("lasso"), "lasso")
        .otherwise("unknown")
    )


def first_present(columns: list[str], candidates: list[str]) -> str | None:
    """First candidate among the columns, exact spelling first, then any letter case."""
    exact = [c for c in candidates if c in columns]
    folded = {c.lower(): c for c in columns}
    loose = [folded[c.lower()] for c in candidates if c.lower() in folded]
    return (exact + loose + [None])[0]
