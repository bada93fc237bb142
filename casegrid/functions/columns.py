"""Column-level helpers. All return JVM-side ``Column`` expressions (no UDFs),
so they stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(c: Column | str, scale: int) -> Column:
    """Round a double to ``scale`` decimals as ``round(x * 10^s) / 10^s``.

    Spark's ``round`` on doubles rounds the shortest decimal text of the value
    (``round(1.005, 2) = 1.01``); scaling first rounds the binary value, which
    is what the SQL the reports were written in does (``1.005 -> 1.0``).
    """
    p = float(10 ** scale)
    x = _col(c).cast("double")
    r = F.round(x, 0) if scale == 0 else F.round(x * F.lit(p), 0) / F.lit(p)
    # Keep the sign of a negative value that rounds to zero (-0.004 -> -0.0),
    # as the SQL engine does; Spark's decimal-based round returns +0.0.
    return F.when((r == F.lit(0.0)) & (x < F.lit(0.0)), r * F.lit(-1.0)).otherwise(r)


def safe_div(num: Column | str, den: Column | str) -> Column:
    """``num / NULLIF(den, 0)`` in double arithmetic: NULL instead of an ANSI error."""
    return _col(num).cast("double") / F.nullif(_col(den), F.lit(0)).cast("double")


def pct(part: Column | str, whole: Column | str, scale: int | None = None) -> Column:
    """``part * 100.0 / whole`` as DOUBLE (never DECIMAL), optionally rounded."""
    v = safe_div(_col(part).cast("double") * F.lit(100.0), whole)
    return v if scale is None else round_half_away(v, scale)


def pct_change(cur: Column | str, base: Column | str, scale: int | None = None) -> Column:
    """``(cur - base) * 100.0 / NULLIF(base, 0)``."""
    return pct(_col(cur) - _col(base), base, scale)


def count_when(pred: Column) -> Column:
    """``COUNT(CASE WHEN pred THEN 1 END)``: NULL predicates do not count."""
    return F.count(F.when(pred, F.lit(1)))


def band(c: Column | str, cuts: Sequence[float], labels: Sequence[str], default: str) -> Column:
    """Searched CASE: first ``c > cut`` wins; NULL and everything below -> default."""
    if len(cuts) != len(labels):
        raise ValueError("one label per cut")
    x = _col(c)
    out = None
    for cut, label in zip(cuts, labels):
        out = (F.when(x > F.lit(cut), F.lit(label)) if out is None
               else out.when(x > F.lit(cut), F.lit(label)))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def in_regions(c: Column | str, regions: Iterable[str]) -> Column:
    """Whitelist predicate (``IS NOT NULL AND IN (...)``); pushed to Parquet as ``In``."""
    x = _col(c)
    return x.isNotNull() & x.isin(list(regions))


def since(c: Column | str, day: str) -> Column:
    """``date >= DATE 'day'``."""
    return _col(c) >= F.lit(day).cast("date")


def before(c: Column | str, day: str) -> Column:
    """``date < DATE 'day'``."""
    return _col(c) < F.lit(day).cast("date")


def month_of(c: Column | str) -> Column:
    """First day of the month as DATE."""
    return F.trunc(_col(c), "month")


def quarter_of(c: Column | str) -> Column:
    """First day of the quarter as DATE."""
    return F.trunc(_col(c), "quarter")


def asc_nl(c: Column | str) -> Column:
    """Ascending, NULLs last (the SQL engine's default for ASC)."""
    return _col(c).asc_nulls_last()


def desc_nl(c: Column | str) -> Column:
    """Descending, NULLs last."""
    return _col(c).desc_nulls_last()
