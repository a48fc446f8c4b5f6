"""Checks of rules, configurations and the audit log.

The change logs are derived from the events: an event is one change of the rule or
configuration that its user stands for.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import base as B
from checks.registry import check
from wardspark.operators import compaction
from wardspark.operators import keyed as K
from wardspark.operators import log as L
from wardspark.session import scratch_path


def _rule_changes(spark, sf):
    e = B.table(spark, sf, "events")
    u, n = F.col("user_id"), F.col("event_id")
    kind = F.col("event_type")
    op = (F.when(kind.isin("view", "purchase"), "save").when(kind == "click", "toggle")
          .when((kind == "error") & (n % 3 == 0), "delete").otherwise("toggle"))
    return e.select(
        F.concat(F.lit("rule-"), u.cast("string")).alias("rule_id"), op.alias("op"),
        F.concat(F.lit("Rule of "), u.cast("string")).alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.when(n % 2 == 0, "keyword").otherwise("regex").alias("rule_type"),
        F.concat(F.lit("word"), n.cast("string")).alias("pattern"),
        (n % 10 / 10.0).alias("severity"), F.lit("flag").alias("action"),
        F.when(n % 3 == 0, "prompt").when(n % 3 == 1, "response").otherwise("both")
        .alias("apply_to"), (n % 5).cast("int").alias("priority"),
        (n % 4 != 0).alias("enabled"), F.col("ts").cast("timestamp").alias("changed_at"),
        n.alias("seq"))


_RULES = """changes AS (SELECT 'rule-' || user_id AS rule_id, event_id AS seq, ts AS changed_at,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'save' WHEN event_type = 'click' THEN 'toggle'
    WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'delete' ELSE 'toggle' END AS op,
  CASE WHEN event_id % 2 = 0 THEN 'keyword' ELSE 'regex' END AS rule_type,
  'word' || event_id AS pattern, (event_id % 10) / 10.0::DOUBLE AS severity,
  CASE event_id % 3 WHEN 0 THEN 'prompt' WHEN 1 THEN 'response' ELSE 'both' END AS apply_to,
  event_id % 5 AS priority, event_id % 4 <> 0 AS enabled FROM events),
marked AS (SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY rule_id)
  AS dropped FROM changes),
live AS (SELECT *, min(CASE WHEN op = 'save' THEN seq END) OVER (PARTITION BY rule_id) AS born,
  max(CASE WHEN op = 'save' THEN seq END) OVER (PARTITION BY rule_id) AS saved
  FROM marked WHERE dropped IS NULL OR seq > dropped),
switched AS (SELECT rule_id, enabled FROM live WHERE op = 'toggle' AND seq > born
  QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY seq DESC) = 1),
rules AS (SELECT l.rule_id, l.rule_type, l.pattern, round(l.severity, 6) AS severity, l.apply_to,
  l.priority, coalesce(s.enabled, TRUE) AS enabled FROM live l LEFT JOIN switched s USING (rule_id)
  WHERE l.seq = l.saved)"""
_SHOWN = ["rule_id", "rule_type", "pattern", "severity", "apply_to", "priority", "enabled"]


@check("rules_current", f"WITH {_RULES} SELECT {', '.join(_SHOWN)} FROM rules")
def _(spark, sf):
    out = K.rules_current(_rule_changes(spark, sf))
    return out.withColumn("severity", B.six("severity")).select(*_SHOWN)


@check("list_rules", f"""
WITH {_RULES} SELECT {', '.join(_SHOWN)} FROM rules
WHERE enabled AND apply_to IN ('prompt', 'both') ORDER BY priority DESC, rule_id""")
def _(spark, sf):
    out = K.list_rules(K.rules_current(_rule_changes(spark, sf)), True, "prompt")
    return out.withColumn("severity", B.six("severity")).select(*_SHOWN)


def _config_changes(spark, sf, last=None):
    e = B.table(spark, sf, "events")
    u, n = F.col("user_id"), F.col("event_id")
    kind = F.col("event_type")
    op = (F.when(kind.isin("view", "purchase", "signup"), "save").when(kind == "click", "activate")
          .when((kind == "error") & (n % 4 == 0), "delete").otherwise("save"))
    return e.select(
        F.concat(F.lit("config-"), u.cast("string")).alias("name"), op.alias("op"),
        F.concat(F.lit('{"toxicity_threshold": 0.'), (n % 10).cast("string"), F.lit("}"))
        .alias("config_data"), F.lit(None).cast("string").alias("description"),
        (n % 6 == 0).alias("activate"), F.col("ts").cast("timestamp").alias("changed_at"),
        n.alias("seq"))


_CONFIGS = """changes AS (SELECT 'config-' || user_id AS name, event_id AS seq, ts,
  CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN 'save'
    WHEN event_type = 'click' THEN 'activate'
    WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'delete' ELSE 'save' END AS op,
  '{"toxicity_threshold": 0.' || (event_id % 10) || '}' AS config_data,
  event_id % 6 = 0 AS activate FROM events),
marked AS (SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY name) AS dropped
  FROM changes),
saves AS (SELECT *, min(seq) OVER (PARTITION BY name) AS born, max(seq) OVER (PARTITION BY name)
  AS saved FROM marked WHERE op = 'save' AND (dropped IS NULL OR seq > dropped)),
switch AS (SELECT name AS on_name, seq AS on_seq, ts AS on_ts FROM changes
  WHERE op = 'activate' OR (op = 'save' AND activate) ORDER BY seq DESC LIMIT 1),
configs AS (SELECT name, config_data, born <= on_seq AND saved <= on_seq AND name = on_name
  AS is_active, strftime(CASE WHEN born <= on_seq THEN greatest(ts, on_ts) ELSE ts END,
  '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM saves, switch WHERE seq = saved)"""


@check("configs_current", f"WITH {_CONFIGS} SELECT * FROM configs")
def _(spark, sf):
    out = K.list_configs(K.configs_current(_config_changes(spark, sf)))
    return out.select("name", "config_data", "is_active", B.stamp("updated_at"))


@check("active_config", f"WITH {_CONFIGS} SELECT name, config_data FROM configs WHERE is_active")
def _(spark, sf):
    out = K.configs_current(_config_changes(spark, sf))
    return out.filter("is_active").select("name", "config_data")


def _compacted(spark, changes, compact):
    """The changes in five runs, none of them in order of time; a snapshot after the third."""
    path = scratch_path(spark, "changes")
    for run in range(5):
        compaction.append_changes(changes.filter(F.col("seq") % 5 == run), path, run)
        if run == 2:
            compaction.write_snapshot(spark, path, compact, run)
    return compaction.read_changes(spark, path)


@check("rules_compacted", f"WITH {_RULES} SELECT {', '.join(_SHOWN)} FROM rules")
def _(spark, sf):
    """The current rules from a snapshot and the two runs after it."""
    out = K.rules_current(_compacted(spark, _rule_changes(spark, sf), compaction.compact_rules))
    return out.withColumn("severity", B.six("severity")).select(*_SHOWN)


@check("configs_compacted", f"WITH {_CONFIGS} SELECT * FROM configs")
def _(spark, sf):
    out = K.configs_current(_compacted(spark, _config_changes(spark, sf), compaction.compact_configs))
    return out.select("name", "config_data", "is_active", B.stamp("updated_at"))


def _audit(spark, sf):
    n = F.col("event_id")
    return B.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type"),
        F.when(n % 2 == 0, "create").otherwise("update").alias("event_action"),
        F.when(n % 3 == 0, "rule").otherwise("config").alias("resource_type"),
        F.format_string("r%09d", n).alias("resource_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.col("props").alias("new_value"), (n % 7 != 0).alias("success"))


_AUDIT_FILTER = """event_type = 'click' AND event_id % 3 = 0 AND ts >= '2024-01-03 00:00:00'
AND ts <= '2024-01-29 12:00:00'"""


@check("audit_list", f"""
SELECT printf('r%09d', event_id) AS resource_id, 'u' || user_id AS user_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, event_id % 7 <> 0 AS success,
  (SELECT count(*) FROM events WHERE {_AUDIT_FILTER}) AS total
FROM events WHERE {_AUDIT_FILTER} ORDER BY ts DESC, event_id LIMIT 50 OFFSET 10""")
def _(spark, sf):
    """The whole audit log, appended to files and listed from there."""
    path = scratch_path(spark, "audit")
    L.audit_append(_audit(spark, sf), path)
    rows, total = L.audit_list(spark.read.parquet(path), 50, 10, event_type="click",
                               resource_type="rule", start="2024-01-03 00:00:00",
                               end="2024-01-29 12:00:00")
    return rows.select("resource_id", "user_id", B.stamp("timestamp"), "success",
                       total.scalar().alias("total"))
