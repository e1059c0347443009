"""Contacts: phone numbers, import, search and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smsight.operators.prefixes import CALLING_CODES

def normalize_phone(phone: Column) -> Column:
    """E.164 form, or null when the text is not an international number."""
    compact = F.regexp_replace(F.trim(phone), r"[\s().\-/]", "")
    return F.when(compact.rlike(r"^\+[1-9][0-9]{7,14}$"), compact)


def country_of(phone: Column) -> Column:
    """Country by the longest calling code that begins the number, else ``UNKNOWN``: one look-up for each length of a code."""
    codes = F.create_map(*(F.lit(x) for item in CALLING_CODES.items() for x in item))
    lengths = sorted({len(code) for code in CALLING_CODES}, reverse=True)
    found = [F.try_element_at(codes, F.substring(phone, 2, n)) for n in lengths]
    return F.when(phone.startswith("+"), F.coalesce(*found, F.lit("UNKNOWN"))).otherwise("UNKNOWN")


def import_contacts(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Outcome of every import row: ``accepted``, ``duplicate`` or ``error`` with a reason.

    Rows have ``row_number, user_id, phone, first_name, last_name, email``.  The first row of a
    number wins inside the file (found by a grouped minimum, so one number repeated in a third
    of the file stays cheap), and a number the user already has is a duplicate.  Names and mail addresses are trimmed; a row
    without any field is an error of its own.
    """
    fields = {c: F.trim(c) for c in ("first_name", "last_name", "email")}
    blank = F.coalesce(F.concat_ws("", F.trim("phone"), *fields.values()), F.lit("")) == ""
    parsed = rows.withColumns({"raw_phone": F.trim("phone"), "phone": normalize_phone(F.col("phone")), "_blank": blank, **fields})
    first = parsed.where(F.col("phone").isNotNull()).groupBy("user_id", "phone").agg(F.min("row_number").alias("_first"))
    known = existing.select("user_id", "phone").distinct().withColumn("_known", F.lit(True))
    status = first.join(known, ["user_id", "phone"], "left")
    bad = parsed.where(F.col("phone").isNull()).withColumns({
        "outcome": F.lit("error"),
        "reason": F.when(F.col("_blank"), "Empty row").otherwise(
            F.concat(F.lit("Invalid phone number format: "), F.coalesce("raw_phone", F.lit(""))))})
    good = parsed.where(F.col("phone").isNotNull()).join(status, ["user_id", "phone"]).withColumns({
        "outcome": F.when(F.col("_known") | (F.col("row_number") > F.col("_first")), "duplicate").otherwise("accepted"),
        "reason": F.lit(None).cast("string"),
    }).drop("_first", "_known")
    good = good.withColumn("outcome", F.when(F.col("outcome").isNull(), "accepted").otherwise(F.col("outcome")))
    return good.unionByName(bad).drop("_blank").withColumn("country", F.when(F.col("phone").isNotNull(), country_of(F.col("phone"))))


def import_summary(outcomes: DataFrame) -> DataFrame:
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    return outcomes.groupBy("user_id").agg(
        F.count("*").alias("total_rows"), is_("accepted").alias("success_count"),
        is_("duplicate").alias("duplicate_count"), is_("error").alias("error_count"))


def search_contacts(contacts: DataFrame, user_id, term: str) -> DataFrame:
    """Contacts of one user whose phone or name contains ``term``."""
    hit = F.col("phone").contains(term) | F.col("first_name").contains(term) | F.col("last_name").contains(term)
    return contacts.where((F.col("user_id") == user_id) & hit)


def with_any_tag(contacts: DataFrame, tags: list[str]) -> DataFrame:
    return contacts.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))


def change_tags(contacts: DataFrame, selection: DataFrame, add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """Tags of the selected contacts (``user_id, contact_id``) after adding and removing."""
    chosen = selection.select("user_id", "contact_id").distinct().withColumn("_chosen", F.lit(True))
    literals = lambda items: F.array(*[F.lit(t) for t in items]).cast("array<string>")
    changed = F.array_except(F.array_union("tags", literals(add)), literals(remove))
    return contacts.join(chosen, ["user_id", "contact_id"], "left").withColumn(
        "tags", F.when(F.col("_chosen"), changed).otherwise(F.col("tags"))).drop("_chosen")


def select_contacts(contacts: DataFrame, selection: DataFrame, keep: bool = True) -> DataFrame:
    """The contacts with (or, for deletion, without) the ids of ``selection`` (user_id, contact_id); any number of them."""
    return contacts.join(selection.select("user_id", "contact_id"), ["user_id", "contact_id"], "left_semi" if keep else "left_anti")
