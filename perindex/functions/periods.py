"""Where an event or a visit lies relative to the index interval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_of(date: Column | str, start: Column | str, end: Column | str) -> Column:
    """``during`` inside the closed interval, else ``before`` or ``after``.

    Null when the date or the interval is missing. An interval that ends before
    it starts has no inside; dates before its start count as ``before``.
    """
    d, s, e = _col(date), _col(start), _col(end)
    return F.when((d >= s) & (d <= e), "during").when(d < s, "before").when(d > e, "after")


def period_or_during(date: Column | str, start: Column | str, end: Column | str) -> Column:
    """The lab rule: ``after`` and ``before`` are tested first, the rest is ``during``.

    Missing dates and persons without an index therefore count as ``during``.
    """
    d, s, e = _col(date), _col(start), _col(end)
    return F.when(d > e, "after").when(d < s, "before").otherwise("during")


def visit_in_period(
    visit_start: Column | str, visit_end: Column | str, start: Column | str, end: Column | str
) -> dict[str, Column]:
    """Interval rule for visits: wholly before, contained, or starting after.

    A visit across a boundary belongs to no period.
    """
    vs, s, e = _col(visit_start), _col(start), _col(end)
    ve = F.coalesce(_col(visit_end), vs)
    return {"before": ve < s, "during": (vs >= s) & (ve <= e), "after": vs > e}
