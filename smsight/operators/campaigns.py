"""Campaign delivery, cost, budget, audience and eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smsight.functions import scoring, vocab as V


def delivery_counts(logs: DataFrame) -> DataFrame:
    """Messages per campaign by state, in one grouped pass."""
    state = F.col("status")
    return logs.groupBy("campaign_id").agg(
        F.count("*").alias("total_recipients"),
        F.count_if(state.isin("DELIVERED", "SENDING")).alias("sent_count"),
        F.count_if(state == "DELIVERED").alias("delivered_count"),
        F.count_if(state.isin("FAILED", "NOT_SENT")).alias("failed_count"),
        F.count_if(state.isin("PENDING_OPERATOR", "IN_PROGRESS", "NOT_PROCESSED")).alias("pending_count"),
        F.sum("pages").alias("total_pages"),
    )


def campaign_stats(campaigns: DataFrame, logs: DataFrame) -> DataFrame:
    """Delivery rate, progress and cost per campaign; campaigns without messages count 0."""
    joined = campaigns.join(delivery_counts(logs), "campaign_id", "left")
    counts = ["total_recipients", "sent_count", "delivered_count", "failed_count", "pending_count", "total_pages"]
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    return joined.select(
        "campaign_id", "group_id", "status", *[c(n).alias(n) for n in counts],
        scoring.percent(c("delivered_count"), c("total_recipients")).alias("delivery_rate"),
        scoring.percent(c("sent_count") + c("failed_count"), c("total_recipients")).alias("progress"),
        scoring.cost(c("total_pages"), F.lit(1)).alias("actual_cost"),
    )


def status_counts(campaigns: DataFrame) -> DataFrame:
    return campaigns.groupBy("status").agg(F.count("*").alias("n")).withColumn(
        "label", scoring.lookup(F.col("status"), V.CAMPAIGN_STATUS_LABELS, F.col("status")))


def with_labels(campaigns: DataFrame) -> DataFrame:
    """Display labels of state and sending window; unknown codes show themselves."""
    return campaigns.withColumns({
        "status_label": scoring.lookup(F.col("status"), V.CAMPAIGN_STATUS_LABELS, F.col("status")),
        "window_label": scoring.lookup(F.col("sending_window"), V.SENDING_WINDOW_LABELS, F.col("sending_window")),
    })


def log_status_counts(logs: DataFrame) -> DataFrame:
    """Log rows per campaign and state with the state's code and label."""
    return logs.groupBy("campaign_id", "status").agg(F.count("*").alias("n")).withColumns({
        "status_code": scoring.lookup(F.col("status"), {k: v[0] for k, v in V.SMS_STATUS.items()}),
        "status_label": scoring.lookup(F.col("status"), {k: v[1] for k, v in V.SMS_STATUS.items()}),
    })


def due_campaigns(campaigns: DataFrame, status: str, before: Column) -> DataFrame:
    return campaigns.where((F.col("status") == status) & (F.col("start_date") < before))


def campaign_actions(stats: DataFrame, role: str) -> DataFrame:
    """Which actions are open per campaign for a role, and the state a submission leads to."""
    pending = F.col("status") == "PENDING_VALIDATION"
    return stats.withColumns({
        "can_edit": F.col("status").isin("DRAFT", "PENDING_VALIDATION"),
        "can_validate": pending & F.col("test_completed") & F.lit(role in ("ADMIN", "SUPERADMIN", "SUPERVISOR")),
        "can_stop": (F.col("status") == "RUNNING") & (F.col("progress") < 90),
        "submit_status": F.lit("PENDING_VALIDATION" if role == "AGENT" else "SCHEDULED"),
        "edit_status": F.when(pending, "IN_MODIFICATION").otherwise(F.col("status")),
    })


def budget_ledger(budgets: DataFrame, stats: DataFrame, required: Column | None = None) -> DataFrame:
    """Used, remaining and percent per group; ``affordable`` tests a further amount."""
    used = stats.groupBy("group_id").agg(F.sum("actual_cost").alias("used"))
    joined = budgets.join(used, "group_id", "left")
    spent = F.coalesce(F.col("used"), F.lit(0)).cast("decimal(18,4)")
    share = F.round(spent.cast("double") * 100.0 / F.nullif(F.col("budget").cast("double"), F.lit(0.0))).cast("int")
    remaining = (F.col("budget") - spent).cast("decimal(18,4)")
    return joined.select(
        "group_id", "budget", spent.alias("used"), remaining.alias("remaining"),
        F.when(F.col("budget") == 0, 100).otherwise(F.least(F.lit(100), share)).alias("percent_used"),
        (remaining >= (F.lit(0) if required is None else required)).alias("affordable"),
    )


def estimate_recipients(campaigns: DataFrame) -> DataFrame:
    """Sender-side estimate: explicit contacts plus a flat 100 when any tag is given, and its cost."""
    listed = F.coalesce(F.size("contact_ids"), F.lit(0))
    tagged = F.when(F.coalesce(F.size("contact_tags"), F.lit(0)) > 0, V.TAG_AUDIENCE_ESTIMATE).otherwise(0)
    return campaigns.withColumn("estimated_recipients", F.greatest(listed, F.lit(0)) + tagged)


def audience(campaigns: DataFrame, contacts: DataFrame) -> DataFrame:
    """Distinct (campaign, contact) pairs: listed contacts, and those sharing a tag with it.

    Both parts are equi-joins on exploded arrays inside one user.
    """
    own = contacts.select("user_id", "contact_id")
    listed = campaigns.select("campaign_id", "user_id", F.explode(F.array_distinct("contact_ids")).alias("contact_id")).join(
        own, ["user_id", "contact_id"]).select("campaign_id", "contact_id")
    tags = contacts.select("user_id", "contact_id", F.explode("tags").alias("tag"))
    wanted = campaigns.select("campaign_id", "user_id", F.explode(F.array_distinct("contact_tags")).alias("tag"))
    tagged = wanted.join(tags, ["user_id", "tag"]).select("campaign_id", "contact_id")
    return listed.unionByName(tagged).distinct()


def audience_sizes(campaigns: DataFrame, contacts: DataFrame) -> DataFrame:
    """Audience size without listing the audience.

    Contacts of a user with the same tag set are counted together first; a campaign then meets
    one row per tag set that shares a tag with it, and listed contacts are added unless their
    tags already count.  Work follows the number of tag sets, not of contacts.
    """
    sets = contacts.withColumn("tags", F.array_sort("tags"))
    counted = sets.groupBy("user_id", "tags").agg(F.count("*").alias("n"))
    by_tag = counted.select("user_id", "tags", "n", F.explode("tags").alias("tag"))
    wanted = campaigns.select("campaign_id", "user_id", F.explode(F.array_distinct("contact_tags")).alias("tag"))
    tagged = wanted.join(by_tag, ["user_id", "tag"]).groupBy("campaign_id", "tags").agg(
        F.max("n").alias("n")).groupBy("campaign_id").agg(F.sum("n").alias("by_tag"))
    listed = campaigns.select("campaign_id", "user_id", "contact_tags", F.explode(F.array_distinct("contact_ids")).alias("contact_id"))
    extra = listed.join(contacts.select("user_id", "contact_id", "tags"), ["user_id", "contact_id"]).where(
        ~F.coalesce(F.arrays_overlap("contact_tags", "tags"), F.lit(False))
    ).groupBy("campaign_id").agg(F.count("*").alias("by_list"))
    return campaigns.select("campaign_id").join(tagged, "campaign_id", "left").join(extra, "campaign_id", "left").select(
        "campaign_id", (F.coalesce("by_tag", F.lit(0)) + F.coalesce("by_list", F.lit(0))).alias("audience_size"))


def with_organizations(roles: DataFrame, organizations: DataFrame) -> DataFrame:
    """Roles with the organisation's name, ``Unknown`` where it is missing."""
    return roles.join(organizations, "organization_id", "left").withColumn("name", F.coalesce("name", F.lit("Unknown")))


def filter_users(
    users: DataFrame, first_name: str = "", last_name: str = "", active: bool | None = None,
    group: str = "", role: str = "",
) -> DataFrame:
    """Users by name parts, state and "any role matches" (``roles`` is an array of structs)."""
    has = lambda column, part: F.lower(column).contains(part.lower())
    out = users
    if first_name:
        out = out.where(has(F.col("first_name"), first_name))
    if last_name:
        out = out.where(has(F.col("last_name"), last_name))
    if active is not None:
        out = out.where(F.col("active") == active)
    if group:
        out = out.where(F.exists("roles", lambda r: F.lower(r["group"]) == group.lower()))
    if role == "visionneur":
        out = out.where("is_viewer")
    elif role == "superadmin":
        out = out.where("is_superadmin")
    elif role:
        out = out.where(F.exists("roles", lambda r: F.lower(r["role"]) == role.lower()))
    return out


def filter_labelled(df: DataFrame, columns: list[str], text: str = "", active: bool | None = None, kind: str = "") -> DataFrame:
    """Groups or templates: text in any of ``columns``, state, and type substring."""
    if text:
        hit = F.lit(False)
        for column in columns:
            hit = hit | F.lower(F.col(column)).contains(text.lower())
        df = df.where(hit)
    if active is not None:
        df = df.where(F.col("active") == active)
    if kind:
        df = df.where(F.lower("type").contains(kind.lower()))
    return df


def templates_of_type(df: DataFrame, kind: str, known: list[str]) -> DataFrame:
    """Active templates of a type; an unknown type means all active ones."""
    active = df.where(F.col("active"))
    return active.where(F.col("type") == kind) if kind in known else active
