"""Change detection between snapshots, the guards in front of alerts, and alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelake.functions.columns import dedup_key, drop_fraction, highlight, in_stock, number
from pricelake.sources.scratch import written


def keyed(snapshot: DataFrame, key: list[str], fields: list[str], arrival: list[str]) -> DataFrame:
    """One row per key, the last to arrive; rows without a key are left out."""
    last = F.max_by(F.struct(*fields), F.struct(*arrival))
    return snapshot.where(" AND ".join(f"{k} IS NOT NULL" for k in key)).groupBy(*key).agg(last.alias("v")).select(*key, "v.*")


def diff(old: DataFrame, new: DataFrame, key: list[str], fields: list[str], arrival: list[str], item: str) -> DataFrame:
    """CHG-1, SET-4: key, field, old_value, new_value; new and removed items carry their key as value.

    Typed values are compared, text is made afterwards. One full outer join on the key.
    """
    a = keyed(old, key, fields, arrival).select(*key, F.struct(*fields).alias("o"))
    b = keyed(new, key, fields, arrival).select(*key, F.struct(*fields).alias("n"))
    text = lambda c: F.when(c.isNotNull(), c.cast("string"))
    entry = lambda f, x, y: F.struct(F.lit(f).alias("field"), x.alias("old_value"), y.alias("new_value"))
    nothing = F.lit(None).cast("string")
    both = [F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), entry(f, text(F.col(f"o.{f}")), text(F.col(f"n.{f}")))) for f in fields]
    name = F.col(item).cast("string")
    found = F.when(F.col("o").isNull(), F.array(entry("_new_item", nothing, name))).when(F.col("n").isNull(), F.array(entry("_removed_item", name, nothing))).otherwise(F.filter(F.array(*both), lambda x: x.isNotNull()))
    return a.join(b, key, "full_outer").select(*key, F.explode(found).alias("c")).select(*key, "c.*")


def plausible(changes: DataFrame, factor: float = 20.0) -> DataFrame:
    """CHG-2: price changes need a positive new price within a factor of a positive old one."""
    old, new = number("old_value"), number("new_value")
    ratio = new / old
    fine = (new > 0) & F.when(old > 0, (ratio >= 1 / factor) & (ratio <= factor)).otherwise(F.lit(True))
    return changes.where((F.col("field") != "price") | F.coalesce(fine, F.lit(False)))


def confident(changes: DataFrame, confidence: Column, least: float) -> DataFrame:
    """CHG-3: fields whose confidence is high enough; unknown fields count as certain; 0 turns it off."""
    return changes if least <= 0 else changes.where(F.coalesce(F.try_element_at(confidence, F.col("field")), F.lit(1.0)) >= least)


def quarantined(changes: DataFrame, flags: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """CHG-4: (passed, dropped) by the flags (key, outlier) of the newest values; only price changes can be dropped."""
    marked = changes.join(flags.select(*key, "outlier"), key, "left").withColumn("outlier", F.coalesce("outlier", F.lit(False)) & (F.col("field") == "price"))
    return marked.where("NOT outlier").drop("outlier"), marked.where("outlier").drop("outlier")


def triggered(trigger: Column, target: Column) -> Column:
    """CHG-5: whether a change (field, old_value, new_value) sets off a watch's trigger."""
    old, new, stock = F.col("old_value").try_cast("double"), F.col("new_value").try_cast("double"), in_stock("new_value")
    price, availability = F.col("field") == "price", F.col("field") == "availability"
    hit = (
        F.when(trigger == "any_change", True)
        .when(trigger == "price_drop", price & (new < old))
        .when(trigger == "price_below", price & (new <= target))
        .when(trigger == "price_above", price & (new >= target))
        .when(trigger == "back_in_stock", availability & stock)
        .when(trigger == "out_of_stock", availability & ~stock)
    )
    return F.coalesce(hit, F.lit(False))


def rule_action(rules: list[dict], default: str = "ignore") -> Column:
    """CHG-6: the action of the first rule that matches a change; rules hold when, amount, action."""
    old, new, stock = F.col("old_value").try_cast("double"), F.col("new_value").try_cast("double"), in_stock("new_value")
    price, availability = F.col("field") == "price", F.col("field") == "availability"

    def matches(when: str, amount: float | None) -> Column:
        limit = F.lit(amount).cast("double")
        # The names of the rules.
        tests = {
            ("any", "any_change"): F.lit(True),
            ("new_item",): F.col("field") == "_new_item",
            ("removed_item",): F.col("field") == "_removed_item",
            ("price_drops", "price_decreases", "price_drop"): price & (new < old),
            ("price_increases", "price_rises"): price & (new > old),
            ("price_drops_below", "price_below"): price & (new <= limit),
            ("price_rises_above", "price_above"): price & (new >= limit),
            ("back_in_stock",): availability & stock,
            ("out_of_stock",): availability & ~stock,
        }
        return next((F.coalesce(test, F.lit(False)) for names, test in tests.items() if when in names), F.lit(False))

    action = F.lit(default.lower())
    for rule in reversed(rules):
        action = F.when(matches(str(rule.get("when", "")).strip().lower(), rule.get("amount", rule.get("value"))), str(rule.get("action", "alert")).lower()).otherwise(action)
    return action


def throttled(changes: DataFrame, alerts: DataFrame, now: Column, minutes: int, site: str = "site_id", item: str = "item_key") -> DataFrame:
    """JOIN-7: without changes whose alert (dedup_key, created_at) went out in the last minutes; 0 turns it off."""
    if minutes <= 0:
        return changes
    recent = alerts.where(F.col("created_at") >= now - F.make_dt_interval(mins=F.lit(minutes))).select("dedup_key").distinct()
    marked = changes.withColumn("dedup_key", dedup_key(F.col(site), F.col("field"), F.col(item)))
    return marked.join(recent, "dedup_key", "left_anti").drop("dedup_key")


def next_allowed(alerts: DataFrame, key: str, at: str, number: str, minutes: int, slice_minutes: int) -> DataFrame:
    """number and follows: for each alert, the number of the first one of its key (by time, then number) at least so many minutes later.

    A key's alerts are put in order by slices of time, so a key with very many lies in many tasks; past its
    own slice an alert looks at the first one of the key's next slice with any.
    """
    width = slice_minutes * 60_000_000
    rows = alerts.select(F.col(key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col(number).alias("i"))
    seen = rows.select("k", F.floor(F.col("t") / width).alias("s"), "t", F.struct("t", "i").alias("a"), F.lit(None).cast(alerts.schema[number].dataType).alias("i"))
    later = F.col("t") + minutes * 60_000_000
    asked = rows.select("k", F.floor(later / width).alias("s"), later.alias("t"), F.lit(None).cast(seen.schema["a"].dataType).alias("a"), "i")
    # From the end of a slice to its start: the alert passed last is the first one from here on.
    back = Window.partitionBy("k", "s").orderBy(F.desc("t"), F.col("i").isNotNull(), F.desc("a.i"))
    inside = seen.unionByName(asked).withColumn("n", F.last("a", ignorenulls=True).over(back)).where("i IS NOT NULL").select("k", "s", "i", "n")
    firsts = seen.groupBy("k", "s").agg(F.min("a").alias("f"))
    slots = firsts.unionByName(inside.where("n IS NULL").select("k", "s").distinct(), allowMissingColumns=True).groupBy("k", "s").agg(F.min("f").alias("f"))
    after = Window.partitionBy("k").orderBy("s").rowsBetween(1, Window.unboundedFollowing)
    beyond = slots.withColumn("g", F.first("f", ignorenulls=True).over(after)).select("k", "s", "g")
    open_ones = inside.where("n IS NULL").join(beyond, ["k", "s"]).select("i", F.col("g.i").alias("follows"))
    return inside.where("n IS NOT NULL").select("i", F.col("n.i").alias("follows")).unionByName(open_ones).withColumnRenamed("i", "number")


def throttled_alerts(alerts: DataFrame, key: str, at: str, number: str, minutes: int, slice_minutes: int = 7 * 24 * 60) -> DataFrame:
    """JOIN-7 over all time: the alerts that are sent if each silences its key for the minutes after it.

    The first of a key is sent, and after each sent one the next that is allowed. Links to the next allowed
    alert are followed by pointer jumping: what is reached in k steps reaches as many again in one round, so
    there are as many rounds as the longest chain has binary digits. number is unique; null keys are one key.
    """
    rows = written(alerts.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))), "alerts")
    jumps = written(next_allowed(rows, "__key", at, number, minutes, slice_minutes).where("follows IS NOT NULL"), "jumps")
    sent = rows.groupBy("__key").agg(F.min(F.struct(at, number)).alias("f")).select(F.col(f"f.{number}").alias("number"))
    while True:
        reached = written(sent.join(jumps, "number").select(F.col("follows").alias("number")), "reached")
        if not reached.limit(1).count():
            break
        sent = written(sent.unionByName(reached), "sent")
        jumps = written(jumps.join(jumps.toDF("follows", "next"), "follows").select("number", F.col("next").alias("follows")), "jumps")
    return rows.join(sent.withColumnRenamed("number", number), number, "left_semi").drop("__key")


def large_drops(changes: DataFrame, least: float) -> DataFrame:
    """CHG-7: price changes need a drop of at least this fraction; 0 turns it off."""
    if least <= 0:
        return changes
    return changes.where((F.col("field") != "price") | F.coalesce(drop_fraction(F.col("old_value"), F.col("new_value")) >= least, F.lit(False)))


def alert_log(changes: DataFrame, message: Column, sinks: Column, at: Column, site: str = "site_id", item: str = "item_key") -> DataFrame:
    """SRC-4: the rows to append to the alert log."""
    return changes.select(site, item, "field", message.alias("message"), F.concat_ws(",", sinks).alias("sinks"), dedup_key(F.col(site), F.col("field"), F.col(item)).alias("dedup_key"), at.alias("created_at"))


def appended(rows: DataFrame, path: str, at: str) -> None:
    """SRC-1, SRC-3, SRC-4: rows appended to a table in a folder for each day of a time column; without rows no file of them is written.

    Rows are dealt by day first, or each task would write a file to every day; large days are split. They are made once.
    """
    rows.withColumn("day", F.to_date(at)).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def monitoring_batch(old: DataFrame, new: DataFrame, watches: DataFrame, flags: DataFrame, alerts: DataFrame, now: Column, minutes: int = 60, least_drop: float = 0.0, rules: list[dict] | None = None, confidence: Column | None = None, least_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """CHG-8: (what to append to the change log, what to alert on) of one batch over all sites.

    In order: diff, plausible, confidence, quarantine; of what is logged then: trigger or rules,
    throttle, minimum drop. Snapshots hold site_id, item_key, price, availability, arrival; watches
    hold id, alert_trigger, target_price; confidence maps fields to a share.
    """
    key = ["site_id", "item_key"]
    changes = plausible(diff(old, new, key, ["price", "availability"], ["arrival"], "item_key"))
    if confidence is not None:
        changes = confident(changes, confidence, least_confidence)
    # What is logged is also what alerts are chosen from: it is made once.
    logged = written(quarantined(changes, flags, key)[0], "logged")
    if rules is not None:
        chosen = logged.where(rule_action(rules) == "alert")
    else:
        chosen = logged.join(watches.select(F.col("id").alias("site_id"), "alert_trigger", "target_price"), "site_id").where(triggered(F.col("alert_trigger"), F.col("target_price"))).drop("alert_trigger", "target_price")
    return logged, large_drops(throttled(chosen, alerts, now, minutes), least_drop)


def recent_changes(changes: DataFrame, sites: DataFrame, limit: int, site=None, order=("changed_at",)) -> DataFrame:
    """JOIN-2: the newest changes with the url of their site."""
    j = changes.join(sites.select(F.col("id").alias("site_id"), "url"), "site_id")
    j = j if site is None else j.where(F.col("site_id") == site)
    return j.orderBy(*(F.col(c).desc() for c in order)).limit(limit)


def recent_alerts(alerts: DataFrame, limit: int, order=("created_at",)) -> DataFrame:
    """TOP-4: the newest alerts, between 1 and 500 of them."""
    return alerts.orderBy(*(F.col(c).desc() for c in order)).limit(max(1, min(limit, 500)))


def digest(changes: DataFrame, now: Column, hours: int) -> DataFrame:
    """AGG-11: changes of the last hours per site, with the total and the number of sites."""
    recent = changes.where(F.col("changed_at") >= now - F.make_dt_interval(hours=F.lit(hours)))
    per_site = recent.groupBy("site_id").agg(F.count("*").alias("changes"))
    all_sites = per_site.agg(F.sum("changes").alias("total"), F.count("*").alias("sites"))
    return per_site.crossJoin(F.broadcast(all_sites))  # one row


def digest_lines(changes: DataFrame, order: list[str], per_site: int = 15) -> DataFrame:
    """TOP-5: the first highlights of every site, and a line that counts the rest."""
    w = Window.partitionBy("site_id")
    numbered = changes.withColumn("line", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))
    text = highlight(F.col("item_key").cast("string"), F.col("field"), F.col("old_value"), F.col("new_value"))
    shown = numbered.where(F.col("line") <= per_site).select("site_id", "line", text.alias("text"))
    more = numbered.where((F.col("line") == 1) & (F.col("n") > per_site)).select("site_id", F.lit(per_site + 1).alias("line"), F.concat(F.lit("and "), (F.col("n") - per_site).cast("string"), F.lit(" more")).alias("text"))
    return shown.unionByName(more)


def dashboard(sites: DataFrame, changes: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """AGG-12: one row of key figures."""
    a = sites.agg(F.sum("active").alias("active"), F.count("*").alias("total"))
    b = changes.agg(F.count_if(F.col("changed_at") >= now - F.make_dt_interval(hours=F.lit(24))).alias("changes_24h"))
    c = runs.agg(F.floor(F.avg("confidence") * 100 + 0.5).cast("int").alias("confidence_pct"))
    return a.crossJoin(b).crossJoin(c)  # one row each

