"""Rules and configurations as change logs with a current view.

A change row holds the key, the ``op``, the payload and ``changed_at`` and ``seq``, which
order the changes. The current view keeps the last change per key by a hash aggregation
that is combined per task, so a key with very many changes is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE_FIELDS = ["name", "description", "rule_type", "pattern", "severity", "action", "apply_to",
               "priority"]


def rules_current(changes: DataFrame) -> DataFrame:
    """Rules after all changes.

    ``save`` writes every field but ``enabled``, which starts as true and is set by
    ``toggle`` only; ``delete`` removes the rule, and a later save starts it afresh.
    A toggle of a rule that does not exist does nothing.
    """
    order = F.struct("changed_at", "seq")

    def last(condition, value):
        return F.max_by(F.when(condition, value), F.when(condition, order))

    save, delete, toggle = (F.col("op") == op for op in ("save", "delete", "toggle"))
    dropped = (changes.groupBy("rule_id")
               .agg(F.max(F.when(delete, order)).alias("_dropped")))
    # what counts is newer than the last delete, and a toggle must follow the first save
    live = (changes.join(dropped, "rule_id")
            .filter(F.col("_dropped").isNull() | (order > F.col("_dropped"))))
    born = live.groupBy("rule_id").agg(F.min(F.when(save, order)).alias("_born"))
    live = live.join(born, "rule_id").filter(order >= F.col("_born"))
    return (live.groupBy("rule_id").agg(
        last(save, F.struct(*RULE_FIELDS)).alias("_rule"),
        F.coalesce(last(toggle, F.col("enabled")), F.lit(True)).alias("enabled"),
        F.min(F.when(save, F.col("changed_at"))).alias("created_at"),
        F.max("changed_at").alias("updated_at"))
        .select("rule_id", "_rule.*", "enabled", "created_at", "updated_at"))


def list_rules(rules: DataFrame, enabled_only: bool = False,
               apply_to: str | None = None) -> DataFrame:
    if enabled_only:
        rules = rules.filter("enabled")
    if apply_to:
        rules = rules.filter(F.col("apply_to").isin(apply_to, "both"))
    return rules.orderBy(F.desc("priority"), "rule_id")


def configs_current(changes: DataFrame) -> DataFrame:
    """Configurations after all changes, with at most one active.

    ``save`` with ``activate`` and ``activate`` turn every other configuration off, even if
    the activated name does not exist; a save without ``activate`` turns its own off.
    """
    order = F.struct("changed_at", "seq")
    save, delete = F.col("op") == "save", F.col("op") == "delete"
    # changes of a name after its last delete; the others only matter for what is active
    dropped = changes.groupBy("name").agg(F.max(F.when(delete, order)).alias("_dropped"))
    live = (changes.join(dropped, "name")
            .filter(F.col("_dropped").isNull() | (order > F.col("_dropped"))))
    current = live.groupBy("name").agg(
        F.max_by(F.when(save, F.struct("config_data", "description")), F.when(save, order))
        .alias("_config"),
        F.min(F.when(save, order)).alias("_born"), F.max(F.when(save, order)).alias("_saved"),
        F.max(F.when(save, F.col("changed_at"))).alias("_saved_at"),
        F.min(F.when(save, F.col("changed_at"))).alias("created_at")
    ).filter(F.col("_config").isNotNull())
    turns_on = (F.col("op") == "activate") | (save & F.col("activate"))
    # the last change anywhere that turned one configuration on and all others off
    switch = changes.filter(turns_on).agg(
        F.max_by(F.struct(order.alias("at"), "name", "changed_at"), order)).scalar()
    out = current.withColumn("_switch", switch)
    existed = F.coalesce(F.col("_born") <= F.col("_switch.at"), F.lit(False))
    active = ((F.col("_switch.name") == F.col("name")) & existed
              & (F.col("_saved") <= F.col("_switch.at")))
    return out.select(
        "name", "_config.*", F.coalesce(active, F.lit(False)).alias("is_active"), "created_at",
        F.greatest("_saved_at", F.when(existed, F.col("_switch.changed_at")))
        .alias("updated_at"))


def list_configs(configs: DataFrame) -> DataFrame:
    return configs.orderBy(F.desc("updated_at"), "name")
