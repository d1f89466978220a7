"""The desk of daily review: rows of the metadata workbench, queues of proposed values, counts and summaries of plans, checks before they are applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..plans import snapshots
from . import audits, tags

STATES = ("pending", "approved", "rejected")


def existing_values(accepted: DataFrame, embedded: DataFrame) -> DataFrame:
    """(file_id, field, value_key): the values that files have already, by tags or embedded fields; blank ones are none."""

    def keyed(df: DataFrame, field: str) -> DataFrame:
        rows = df.where("value IS NOT NULL AND trim(value) <> ''")
        return rows.select("file_id", values.canonical_field(F.col(field)).alias("field"), values.value_key(F.col("value")).alias("value_key"))

    return keyed(accepted, "field").unionByName(keyed(embedded, "key")).distinct()


def with_duplicates(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """The plan's additions with duplicate: the file has the value already (field names and value apart from case and blanks)."""
    adds = entries.where("action = 'add' AND value IS NOT NULL AND trim(value) <> ''")
    keyed = adds.withColumns({"_f": values.canonical_field(F.col("field")), "_v": values.value_key(F.col("value"))})
    held = existing.select("file_id", F.col("field").alias("_f"), F.col("value_key").alias("_v"), F.lit(True).alias("_held"))
    return keyed.join(held, ["file_id", "_f", "_v"], "left").withColumn("duplicate", F.col("_held").isNotNull()).drop("_f", "_v", "_held")


def duplicate_counts(entries: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: additions, those that the files lack, those they have, files that lack some."""
    return with_duplicates(entries, existing).agg(
        F.count("*").alias("add_entries"), F.count_if(~F.col("duplicate")).alias("pending_entries"), F.count_if("duplicate").alias("duplicate_entries"),
        F.count_distinct(F.when(~F.col("duplicate"), F.col("file_id"))).alias("files_with_pending"),
    )


def workbench_rows(files: DataFrame, accepted: DataFrame, embedded: DataFrame, pending: DataFrame, text: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """(id, path, filename, embedded_fields, accepted_tags, rank): a page of files, those with pending entries first, then tagged, then embedded, then others, by path.

    pending: (file_id) of open plan entries.  text: every word in name or path.  The counts
    are aggregated before they are joined; the page is a top-k, no full sort.
    """
    count = lambda df, name: df.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias(name))
    rows = files.where(audits.text_filter(text, "filename", "path")).select("id", "path", "filename")
    rows = rows.join(count(embedded, "embedded_fields"), "id", "left").join(count(accepted, "accepted_tags"), "id", "left").na.fill(0, ["embedded_fields", "accepted_tags"])
    rows = rows.join(pending.select(F.col("file_id").alias("id"), F.lit(True).alias("_open")).distinct(), "id", "left")
    rank = F.when(F.col("_open"), 0).when(F.col("accepted_tags") > 0, 1).when(F.col("embedded_fields") > 0, 2).otherwise(3)
    return rows.select("id", "path", "filename", "embedded_fields", "accepted_tags", rank.alias("rank")).orderBy("rank", "path", "id").offset(offset).limit(limit)


def review_queue(entries: DataFrame, existing: DataFrame, page: int, offset: int = 0, pending_only: bool = False, seed: int | None = None) -> DataFrame:
    """(file_id, n_candidates, n_pending, sources, candidates): a page of files with the additions they lack, open ones first.

    candidates: (status, field, value, entry_id) of a file in order.  The page is chosen by
    aggregated counts before the entries are gathered, so only its files' entries meet;
    seed: a drawn page instead of one by file.
    """
    lacking = with_duplicates(entries, existing).where("NOT duplicate")
    counts = lacking.groupBy("file_id").agg(F.count_if(F.col("status") == "pending").alias("n_pending"))
    counts = counts.where("n_pending > 0") if pending_only else counts
    order = [F.xxhash64(F.lit(seed), "file_id"), F.col("file_id")] if seed is not None else [F.col("file_id")]
    chosen = counts.orderBy(*order).offset(offset).limit(page)
    rows = lacking.join(F.broadcast(chosen), "file_id")  # a page
    one = F.struct(F.when(F.col("status") == "pending", 0).otherwise(1).alias("later"), "field", "value", "entry_id", "status")
    found = rows.groupBy("file_id", "n_pending").agg(F.count("*").alias("n_candidates"), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"), F.array_sort(F.collect_list(one)).alias("_c"))
    candidates = F.transform("_c", lambda c: F.struct(c["status"].alias("status"), c["field"].alias("field"), c["value"].alias("value"), c["entry_id"].alias("entry_id")))
    return found.select("file_id", "n_candidates", "n_pending", "sources", candidates.alias("candidates"))


def plan_values(entries: DataFrame, samples: int = 3) -> DataFrame:
    """(field, value, source, n, approved, rejected, pending, least, greatest, files): a plan by value, with its confidences and the first sample files.

    The sample files are a top-k of each group, which is pruned before it is shuffled.
    """
    keys = ["field", "value", "source"]
    sums = entries.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in STATES], F.min("confidence").alias("least"), F.max("confidence").alias("greatest"))
    named = entries.where("filename IS NOT NULL").select(*keys, "filename").distinct()
    top = named.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("filename"))).where(F.col("_at") <= samples)
    shown = top.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("filename")), ", ").alias("files")).select(*[F.col(k).alias(f"_{k}") for k in keys], "files")  # samples a group
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return sums.join(shown, same, "left").select(*keys, "n", *STATES, "least", "greatest", F.coalesce("files", F.lit("")).alias("files"))


def confidence_bucket(confidence: Column) -> Column:
    """lo below 0.5, mid below 0.8, else hi; NULL stays NULL."""
    return F.when(confidence < 0.5, "lo").when(confidence < 0.8, "mid").when(confidence.isNotNull(), "hi")


# Fields whose values are kept in capitals, in small letters, or as they are.
CAPITAL_FIELDS = ("ucs_category", "ucs_subcategory")
SMALL_FIELDS = ("keyword",)
PLAIN_FIELDS = ("take_number", "channel_position")


def clean_value(field: Column, value: Column) -> Column:
    """A proposed value as its field has it: capitals, small letters, titles or as it is; NULL if nothing is left.

    Punctuation parts words; numbers and single letters that stand for nothing fall off,
    but for fields kept as they are and in capitals.
    """
    name = values.canonical_field(field)
    blanks = lambda c: F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))
    flat = blanks(F.regexp_replace(value, r"[^\p{L}\p{M}\p{N}']+", " "))
    words = F.filter(F.split(flat, " "), lambda w: ~w.rlike(r"^\p{N}*$") & ((F.length(w) > 1) | F.upper(w).isin(*tags.ABBREVIATIONS)))
    out = F.when(name.isin(*PLAIN_FIELDS), blanks(value)).when(name.isin(*CAPITAL_FIELDS), F.upper(flat))
    out = out.when(name.isin(*SMALL_FIELDS), F.lower(F.array_join(words, " "))).otherwise(F.array_join(F.transform(words, tags.title_word), " "))
    return F.when(out != "", out)


def checked(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Approved entries with outcome: 'apply', 'skip' (nothing to add) or the reason why the file no longer fits."""
    reason = snapshots.drift(entries, files)
    skip = (F.col("action") != "add") | F.col("value").isNull() | (F.trim("value") == "")
    return reason.where("status = 'approved'").withColumn("outcome", F.when(F.col("drift").isNotNull(), F.col("drift")).when(skip, "skip").otherwise("apply")).drop("drift")


def apply_checked(accepted: DataFrame, entries: DataFrame, files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(tags after the entries that still fit, log of all entries with their outcome).  Applying again changes nothing."""
    rows = checked(entries, files)
    return tags.applied(accepted, rows.where("outcome = 'apply'").select("entry_id", "file_id", "field", "value", "action"), now), rows.select("entry_id", "file_id", "field", "value", "outcome")


def outcome_counts(log: DataFrame) -> DataFrame:
    """One row about a log: applied, skipped, failed entries."""
    o = F.col("outcome")
    return log.agg(F.count_if(o == "apply").alias("applied"), F.count_if(o == "skip").alias("skipped"), F.count_if(~o.isin("apply", "skip")).alias("failed"))


def log_rows(log: DataFrame, plan: str, tool: str, at: Column) -> DataFrame:
    """A log as rows of the append-only log table: what was applied by what, when, from which plan, entry by entry."""
    return log.select(F.lit(plan).alias("plan"), F.lit(tool).alias("tool"), at.alias("applied_at"), "entry_id", "outcome")


def review(entries: DataFrame, approve: Column, reject: Column, log: DataFrame) -> DataFrame:
    """entries with their status after a review; refused: a rejection of an entry that is applied already, which keeps its status."""
    done = log.where("outcome = 'apply'").select("entry_id", F.lit(True).alias("_done")).distinct()
    rows = entries.join(done, "entry_id", "left")
    no, yes = F.coalesce(reject, F.lit(False)), F.coalesce(approve, F.lit(False))
    refused = no & F.col("_done").isNotNull()
    return rows.withColumns({"status": F.when(refused, F.col("status")).when(no, "rejected").when(yes, "approved").otherwise(F.col("status")), "refused": refused}).drop("_done")


def approved_groups(entries: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """entries with those of the given groups approved, unless rejected."""
    told = groups.select(key).distinct().withColumn("_told", F.lit(True))
    return entries.join(told, key, "left").withColumn("status", F.when(F.col("_told") & (F.col("status") != "rejected"), "approved").otherwise(F.col("status"))).drop("_told")


def readback(plan: DataFrame, embedded: DataFrame) -> DataFrame:
    """(file_id, namespace, key, value, found, state): what a write plan wanted against what the files hold now."""
    held = embedded.groupBy("file_id", "namespace", "key").agg(F.min("value").alias("found"))
    rows = plan.where(F.col("action").isin("add", "replace", "skip_same")).join(held, ["file_id", "namespace", "key"], "left")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("value"), "match").otherwise("differs")
    return rows.select("file_id", "namespace", "key", "value", "found", state.alias("state"))


def write_preview(plan: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, n_writes, n_conflicts, state): per file whether a write plan can be carried out: 'ready', 'nothing_to_do', 'conflict' or why not."""
    per = plan.groupBy("file_id").agg(F.count_if(F.col("action").isin("add", "replace")).alias("n_writes"), F.count_if(F.col("action") == "conflict").alias("n_conflicts"))
    rows = per.join(files.select(F.col("id").alias("file_id"), "extension", "scan_error"), "file_id", "left")
    state = (
        F.when(F.col("extension").isNull(), "not_indexed").when(F.col("scan_error").isNotNull(), "unreadable").when(~F.lower("extension").isin(".wav", ".bwf", "wav", "bwf"), "unsupported")
        .when(F.col("n_conflicts") > 0, "conflict").when(F.col("n_writes") == 0, "nothing_to_do").otherwise("ready")
    )
    return rows.select("file_id", "n_writes", "n_conflicts", state.alias("state"))


def delete_plan(quarantined: DataFrame, folders: DataFrame) -> DataFrame:
    """(id, path, size_bytes, state, protected_by): files put aside earlier that may go for good; those in safe folders stay."""
    from . import duplicates

    rows = duplicates.protected(quarantined, folders, both_ways=True)
    return rows.select("id", "path", "size_bytes", F.when(F.col("protected_by").isNotNull(), "protected").otherwise("delete").alias("state"), "protected_by")


def state_summary(plan: DataFrame, state: str = "state", size: str = "size_bytes") -> DataFrame:
    """(state, n, bytes) of a plan over files."""
    return plan.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def proposal_counts(proposals: DataFrame, catalog: DataFrame) -> DataFrame:
    """(dimension, key, n): proposals by strength and by the category of their entry."""
    return snapshots.plan_counts(proposals.join(catalog.select("cat_id", "category"), "cat_id"), "strength", "category")


def job_events(jobs: DataFrame, action: str, job: Column, at: Column, status: str, error: str | None = None) -> DataFrame:
    """Events to be appended when jobs start ('running'), end ('finished', 'failed') or are found interrupted."""
    return jobs.select(job.alias("job_id"), F.lit(action).alias("action"), at.alias("at"), F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"))


def interrupted(events: DataFrame, at: Column, order: str = "event_id", error: str = "session ended before the job did") -> DataFrame:
    """An 'interrupted' event for each job whose last event says 'running'."""
    last = snapshots.latest(events, ["job_id"], [F.col("at"), F.col(order)])
    return last.where("status = 'running'").select("job_id", at.alias("at"), F.lit("interrupted").alias("status"), F.lit(error).alias("error"))


def artifact_list(artifacts: DataFrame, rows: DataFrame, text: str = "") -> DataFrame:
    """(artifact_id, path, kind, n_rows): artifacts with their number of rows, of which any word of text stands in path, kind or a row's text.

    '%' and '_' in a word are plain characters.
    """
    n = rows.groupBy("artifact_id").agg(F.count("*").alias("n_rows"))
    found = artifacts.join(n, "artifact_id", "left").na.fill(0, ["n_rows"])
    words = text.lower().split()
    if words:
        any_word = lambda *cols: F.greatest(*[F.coalesce(F.contains(F.lower(F.col(c)), F.lit(w)), F.lit(False)).cast("int") for c in cols for w in words], F.lit(0)) == 1
        told = rows.where(any_word("text")).select("artifact_id").distinct().withColumn("_in_rows", F.lit(True))
        found = found.join(told, "artifact_id", "left").where(any_word("path", "kind") | F.col("_in_rows").isNotNull()).drop("_in_rows")
    return found.select("artifact_id", "path", "kind", "n_rows")


def file_detail(files: DataFrame, accepted: DataFrame, segments: DataFrame, file_id: int) -> DataFrame:
    """(kind, key, value): one file with its tags and sound events, as rows."""
    one = files.where(F.col("id") == file_id)
    facts = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in ("path", "filename", "extension", "md5", "channels")])).alias("x"))
    rows = facts.select(F.lit("file").alias("kind"), "x.key", "x.value")
    told = accepted.where(F.col("file_id") == file_id).select(F.lit("tag").alias("kind"), F.col("field").alias("key"), "value").distinct()
    heard = segments.where(F.col("file_id") == file_id).select(F.lit("segment").alias("kind"), F.lpad(F.col("segment_index").cast("string"), 6, "0").alias("key"), F.col("method").alias("value")).distinct()
    return rows.unionByName(told).unionByName(heard)


def segments_of_files(files: DataFrame, segments: DataFrame) -> DataFrame:
    """Sound events with the path of their file; of files that are indexed and could be read."""
    readable = files.where("scan_error IS NULL").select(F.col("id").alias("file_id"), F.col("path").alias("file_path"))
    return segments.join(readable, "file_id")


def settings_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """A table of settings (key, value) with new values put in."""
    return snapshots.upsert(old, new.groupBy("key").agg(F.max("value").alias("value")), ["key"])


#: What each way of comparing sounds can do and what it needs.
BACKENDS = (("spectral", True, True, "numpy"), ("embedding", True, False, "onnxruntime"))


def backends(spark) -> DataFrame:
    """(backend, files, segments, needs): the ways of comparing sounds."""
    return spark.createDataFrame(list(BACKENDS), "backend string, files boolean, segments boolean, needs string")
