"""Label claims from arrival to retirement: upsert, corroboration, reconcile, events, cycle reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knowledge import entity_stem

TRUSTED = ("official", "proof")
KEY = ["chain", "address", "source"]
FIELDS = ("entity", "category", "role", "confidence", "method", "source_date")


def trusted(method: Column) -> Column:
    """Methods whose claims are active on arrival."""
    return method.isin(*TRUSTED)


def upsert(stored: DataFrame, claims: DataFrame) -> DataFrame:
    """Stored and arriving claims by (chain, address, source): fields of the arriving one and the outcome.

    Outcomes: added, updated, unchanged, kept (not in this batch). Status is never touched.
    """
    new = F.struct(*FIELDS)
    a = stored.select(*KEY, "status", new.alias("old"))
    b = claims.groupBy(*KEY).agg(F.max(new).alias("new"))
    out = a.join(b, KEY, "full")
    outcome = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "kept").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    best = F.coalesce("new", "old")
    return out.select(*KEY, "status", *[best[f].alias(f) for f in FIELDS], outcome.alias("outcome"))


def arrival_status(method: Column) -> Column:
    """Active for trusted methods, else pending."""
    return F.when(trusted(method), "active").otherwise("pending")


def shape_errors(entity: Column, method: Column) -> Column:
    """Why an untrusted claim's entity is refused: length, lines, parentheses, links, emptiness."""
    rules = [(F.length(F.trim(entity)) == 0, "empty"), (F.length(entity) > 64, "long"), (entity.rlike(r"[\r\n]"), "lines"), (entity.rlike(r"[()]"), "parentheses"), (F.contains(entity, F.lit("://")), "link")]
    return F.when(trusted(method), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(c | entity.isNull(), F.lit(n)) for c, n in rules])))


def settled(upserted: DataFrame) -> DataFrame:
    """Status after an upsert: added claims by arrival, updated ones settle again, retired is final."""
    s = F.when(F.col("status") == "retired", "retired").when(F.col("outcome") == "added", arrival_status(F.col("method")))
    s = s.when((F.col("outcome") == "updated") & (F.col("status") == "active") & ~trusted(F.col("method")), "pending")
    s = s.when((F.col("outcome") == "updated") & (F.col("status") == "pending") & trusted(F.col("method")), "active").otherwise(F.col("status"))
    return upserted.withColumn("status", s)


def corroborations(labels: DataFrame) -> DataFrame:
    """(chain, address, source, by, confidence): active trusted claims of another source with the same category and stem.

    Corroborators are few an address; the join is on address, category and stem at once.
    """
    stem = labels.withColumn("stem", entity_stem(F.col("entity"))).where("stem <> ''")
    good = stem.where((F.col("status") == "active") & trusted(F.col("method"))).select("chain", "address", "category", "stem", F.col("source").alias("by"), F.col("confidence").alias("by_confidence")).distinct()
    return stem.select(*KEY, "category", "stem", "status", "method").join(good, ["chain", "address", "category", "stem"]).where("source <> by")


def reconcile(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One cycle: (labels with new status and corroborated_by, events).

    Active untrusted claims without a corroborator go back to pending; pending ones with one
    become active and cite the best by confidence, then source.
    """
    w = Window.partitionBy(*KEY).orderBy(F.desc("by_confidence"), "by")
    best = corroborations(labels).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*KEY, F.col("by").alias("corroborated_by"))
    j = labels.join(best, KEY, "left")
    weak = (F.col("status") == "active") & ~trusted(F.col("method")) & F.col("corroborated_by").isNull()
    strong = (F.col("status") == "pending") & F.col("corroborated_by").isNotNull()
    kind = F.when(weak, "demoted").when(strong, "promoted")
    out = j.withColumn("event", kind).withColumn("status", F.when(weak, "pending").when(strong, "active").otherwise(F.col("status")))
    events = out.where("event is not null").select(*KEY, F.col("event").alias("kind"), "corroborated_by")
    return out.drop("event"), events


def retire(labels: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims named by ``keys`` become retired, with an event each; what leaned on them falls in the next cycle."""
    gone = keys.select(*KEY).distinct().withColumn("_gone", F.lit(True))
    j = labels.join(gone, KEY, "left").withColumn("_hit", F.coalesce("_gone", F.lit(False)) & (F.col("status") != "retired"))
    events = j.where("_hit").select(*KEY, F.lit("retired").alias("kind"), F.lit(None).cast("string").alias("corroborated_by"))
    return j.withColumn("status", F.when(F.col("_hit"), "retired").otherwise(F.col("status"))).drop("_gone", "_hit"), events


def event_page(events: DataFrame, after: int, limit: int) -> DataFrame:
    """Events past a cursor, oldest first: a page of a log."""
    return events.where(F.col("id") > after).orderBy("id").limit(limit)


def snapshot_moved(events: DataFrame, known: int) -> DataFrame:
    """One row: the log's largest id, and whether a snapshot taken at ``known`` has to be read again."""
    return events.agg(F.max("id").alias("newest")).withColumn("moved", F.coalesce(F.col("newest") > known, F.lit(False)))


def collisions(claims: DataFrame) -> DataFrame:
    """Keys that several claims share across packs: (chain, lower address, source, n)."""
    return claims.groupBy("chain", F.lower("address").alias("address"), "source").agg(F.count("*").alias("n")).where("n > 1")


def cycle_report(outcomes: DataFrame, specs: DataFrame, today: str) -> DataFrame:
    """By expected source: added, updated, unchanged, newest date, whether nothing came, whether it is stale."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    per = outcomes.where("outcome <> 'kept'").groupBy("source").agg(count("added"), count("updated"), count("unchanged"), F.max("source_date").alias("published_at"))
    out = specs.join(per, "source", "left").na.fill(0, ["added", "updated", "unchanged"])
    age = F.datediff(F.lit(today).cast("date"), F.col("published_at"))
    return out.withColumn("not_supplied", F.col("published_at").isNull()).withColumn("age_days", age).withColumn("stale", F.coalesce(age > F.col("max_age_days"), F.lit(False)))


def exit_code(report: DataFrame) -> DataFrame:
    """One row: 1 when a source failed to come, 3 when one is stale, else 0."""
    code = F.when(F.coalesce(F.bool_or("not_supplied"), F.lit(False)), 1).when(F.coalesce(F.bool_or("stale"), F.lit(False)), 3).otherwise(0)
    return report.agg(code.alias("exit_code"))


def sync_status(runs: DataFrame, labels: DataFrame, now: str, stalled_after: int = 3600) -> DataFrame:
    """By chain: active labels, and the state of the newest run: never_run, syncing, stalled or idle."""
    newest = runs.agg(F.max(F.struct("started_at", "finished_at")).alias("r")).select(F.col("r.started_at").alias("started_at"), F.col("r.finished_at").alias("finished_at"))
    age = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    state = F.when(F.col("started_at").isNull(), "never_run").when(F.col("finished_at").isNotNull(), "idle").when(age >= stalled_after, "stalled").otherwise("syncing")
    per = labels.where("status = 'active'").groupBy("chain").agg(F.count("*").alias("active_labels"))
    one = newest.select(F.lit(1).alias("_one"), state.alias("state"))
    return per.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")


def inventory(labels: DataFrame) -> DataFrame:
    """Active labels by chain and category with all totals, and nameable entities (distinct stems)."""
    stem = F.nullif(entity_stem(F.col("entity")), F.lit(""))
    return labels.where("status = 'active'").withColumn("stem", stem).cube("chain", "category").agg(F.count("*").alias("n_labels"), F.count_distinct("stem").alias("n_entities"))
