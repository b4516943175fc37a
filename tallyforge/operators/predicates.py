"""Named row predicates; where two meanings are in use both are here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States of an invoice.
APPROVED = ("APPROVED", "CONFIRMED")
HIDDEN = ("merged", "hidden")


def live(deleted_at: Column) -> Column:
    """No deletion mark: null and the empty text both mean none."""
    return F.coalesce(deleted_at.cast("string"), F.lit("")) == ""


def same_tenant(company_id: Column, tenant: str, strict: bool = True) -> Column:
    """Strict: the tenant's rows; else rows without a tenant match too."""
    own = company_id == tenant
    return own if strict else own | (F.coalesce(company_id, F.lit("")) == "")


def listable(status: Column) -> Column:
    return ~F.lower(F.coalesce(status, F.lit(""))).isin(*HIDDEN)


def approved(status: Column) -> Column:
    return F.upper(F.coalesce(status, F.lit(""))).isin(*APPROVED)


def approved_for_stats(status: Column, duplicate_status: Column) -> Column:
    """Lenient: also what is neither pending nor abnormal, but nothing merged, hidden or duplicate."""
    s, d = F.lower(F.coalesce(status, F.lit(""))), F.lower(F.coalesce(duplicate_status, F.lit("")))
    out = s.isin(*HIDDEN, "duplicate") | d.isin("duplicate", "confirmed")
    return ~out & (approved(status) | ~F.upper(s).isin("PENDING_REVIEW", "ABNORMAL"))


def pending(status: Column, duplicate_status: Column) -> Column:
    return ~approved(status) & ((F.upper(status) == "PENDING_REVIEW") | (F.lower(duplicate_status) == "possible"))


def abnormal(status: Column, difference: Column, warnings: Column) -> Column:
    return ~approved(status) & ((F.upper(status) == "ABNORMAL") | (F.abs(difference) > 0.05) | (F.coalesce(warnings, F.lit("")) != ""))


def duplicate(duplicate_status: Column, local: bool = False) -> Column:
    return duplicate_status.isin(*(("duplicate", "confirmed") if local else ("duplicate",)))


def multi_page(*notes: Column) -> Column:
    return F.upper(F.concat_ws(" ", *notes)).contains("MULTI_PAGE")


def trusted(is_discount: Column, candidate_only: Column, name_status: Column) -> Column:
    return ~is_discount & ~candidate_only & (F.coalesce(name_status, F.lit("")) != "needs_review")


def searchable(is_discount: Column, candidate_only: Column, is_free: Column) -> Column:
    return ~is_discount & ~candidate_only & ~is_free


def discount_line(name: Column, amount: Column, unit_price: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    return n.contains("discount") | n.contains("折扣") | (F.coalesce(amount, F.lit(0)) < 0) | (F.coalesce(unit_price, F.lit(0)) < 0)


#: Names of rows that are remarks, not goods.
REMARKS = r"^(total|subtotal|tax|remark|remarks|note|notes|备注|合计|小计)$"


def price_history_eligible(name: Column, quantity: Column, unit_price: Column, total: Column, is_free: Column, candidate_only: Column) -> Column:
    """Paid goods of an approved invoice whose name is no remark."""
    return ~is_free & ~candidate_only & (quantity > 0) & (unit_price > 0) & (total > 0) & ~F.lower(F.trim(name)).rlike(REMARKS)


def catalog_keep(marked: Column, handwritten: Column, amount: Column, quantity: Column) -> Column:
    """Printed catalogues: only rows that someone filled in."""
    return F.coalesce(marked, F.lit(False)) | F.coalesce(handwritten, F.lit(False)) | ((F.coalesce(amount, F.lit(0)) > 0) & (F.coalesce(quantity, F.lit(0)) > 0))
