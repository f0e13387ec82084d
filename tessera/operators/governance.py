"""Coverage, quality, lint, lifecycle, feedback and job analytics. Every one is an aggregate or an equi-join; ``now`` is always given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .common import cut


def covered_paths(files: DataFrame, articles: DataFrame) -> DataFrame:
    """path of every known file that some article names (paths without anchors)."""
    named = articles.select(F.explode(F.transform("source_paths", T.path_key)).alias("path")).where("path != ''").distinct()
    return files.select(T.path_key(F.col("path")).alias("path")).distinct().join(named, "path", "left_semi")


def omitted_paths(files: DataFrame, articles: DataFrame) -> DataFrame:
    return files.select(T.path_key(F.col("path")).alias("path")).distinct().join(covered_paths(files, articles), "path", "left_anti")


def coverage(files: DataFrame, articles: DataFrame) -> DataFrame:
    """total, covered, ratio."""
    known = files.select(T.path_key(F.col("path")).alias("path")).distinct()
    marked = known.join(covered_paths(files, articles).withColumn("hit", F.lit(1)), "path", "left")
    return marked.agg(F.count("*").alias("total"), F.count("hit").alias("covered")).withColumn("ratio", F.when(F.col("total") == 0, 0.0).otherwise(F.col("covered") / F.col("total")))


def status_counts(articles: DataFrame, files: DataFrame, contributions: DataFrame, pending: DataFrame) -> DataFrame:
    one = lambda df, name, agg=F.count("*"): df.agg(agg.alias(name))
    parts = [one(files, "files"), one(contributions, "contributions"), one(pending, "pending")]
    first = articles.agg(F.count("*").alias("articles"), F.count_if(F.coalesce(F.lower("review_status"), F.lit("")) != "passed").alias("not_passed"))
    return reduce(lambda a, b: a.crossJoin(b), parts, first)  # one row each


def quality(articles: DataFrame) -> DataFrame:
    """Counts and rates (percent, two places, half up) of review states, grounded and referential articles."""
    status = lambda s: F.count_if(F.lower("review_status") == s)
    rows = articles.agg(F.count("*").alias("total"), status("passed").alias("passed"), status("pending").alias("pending"), status("needs_human_review").alias("needs_human"), F.count_if(F.size("source_paths") > 0).alias("grounded"), F.count_if(F.size("keywords") > 0).alias("referential"))
    rate = lambda c: F.when(F.col("total") == 0, 0.0).otherwise(T.half_up(F.col(c) * 100.0 / F.col("total"))).alias(f"{c}_rate")
    return rows.select("*", *(rate(c) for c in ("passed", "grounded", "referential")))


def quality_trend(history: DataFrame, now: Column, days: int) -> DataFrame:
    """metric, first, last, change over the days before now; earliest and latest by (measured_at, id)."""
    recent = history.where(F.col("measured_at") > now - F.make_interval(days=F.lit(days)))
    order = F.struct("measured_at", "id")
    rows = recent.groupBy("metric").agg(F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"))
    return rows.withColumn("change", F.round(F.col("last") - F.col("first"), 6))


def lifecycle_distribution(articles: DataFrame) -> DataFrame:
    state = F.lower(F.trim(F.coalesce("lifecycle", F.lit(""))))
    return articles.groupBy(F.when(state == "", "active").otherwise(state).alias("lifecycle")).agg(F.count("*").alias("n"))


def transition(articles: DataFrame, target: str, reason: str, ids: DataFrame) -> DataFrame:
    """The articles with those of ids (concept_id) moved to a lifecycle, and what their metadata then says."""
    hit = ids.select("concept_id").distinct().withColumn("_hit", F.lit(True))
    moved = articles.join(hit, "concept_id", "left")
    note = F.to_json(F.struct(F.lit(target).alias("lifecycle"), F.lit(reason).alias("reason"), F.col("lifecycle").alias("from")))
    return moved.withColumn("metadata", F.when(F.col("_hit"), note).otherwise(F.col("metadata"))).withColumn("lifecycle", F.when(F.col("_hit"), target).otherwise(F.col("lifecycle"))).drop("_hit")


def lint(articles: DataFrame) -> DataFrame:
    """concept_id, dimension, message, fixable of every finding."""
    twice = articles.groupBy("title").agg(F.count("*").alias("_n")).where("_n > 1").select("title", F.lit(True).alias("_twice"))
    rows = articles.select("concept_id", "title", "summary", "lifecycle", "source_paths", "keywords", "review_status").join(twice, "title", "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    # fixed values: the messages
    checks = [
        ("consistency", F.col("_twice"), "标题重复，可能存在概念重叠", True),
        ("gaps", blank("summary"), "缺少 summary", True),
        ("freshness", F.lower(F.coalesce("lifecycle", F.lit(""))) != "active", "生命周期不是 active", False),
        ("grounding", F.size("source_paths") == 0, "缺少 source_paths", False),
        ("referential", F.size("keywords") == 0, "缺少 referential_keywords", True),
        ("consistency", F.lower("review_status") == "needs_human_review", "文章仍处于 needs_human_review", False),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("message"), F.lit(x).alias("fixable"))) for d, test, m, x in checks)))
    own = rows.select("concept_id", F.explode(found).alias("i")).select("concept_id", "i.*")
    missing = articles.select("concept_id", F.explode("depends_on").alias("ref")).join(articles.select(F.col("concept_id").alias("ref")).distinct(), "ref", "left_anti")
    return own.unionByName(missing.select("concept_id", F.lit("propagation").alias("dimension"), F.concat(F.lit("依赖概念缺失: "), "ref").alias("message"), F.lit(False).alias("fixable")))


def lint_fixes(issues: DataFrame) -> DataFrame:
    """concept_id, fixable and skipped findings, their dimensions in order."""
    return issues.groupBy("concept_id").agg(F.count_if("fixable").alias("fixable"), F.count_if(~F.col("fixable")).alias("skipped"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("fixable"), F.col("dimension")))), ",").alias("dimensions"))


def duplicate_titles(articles: DataFrame) -> DataFrame:
    return articles.groupBy("title").agg(F.count("*").alias("n"), F.min("concept_id").alias("first_concept")).where("n > 1")


def active(rows: DataFrame, now: Column) -> DataFrame:
    """Rows whose expires_at isn't past."""
    return rows.where(F.col("expires_at") >= now)


def inspection(pending: DataFrame, now: Column) -> DataFrame:
    return active(pending, now).select("query_id", "question", "answer", F.lit("pending_query").alias("kind"))


def browse(articles: DataFrame, needle: str, lifecycle: str | None = None, source_id: int | None = None) -> DataFrame:
    """Articles that hold the needle, whatever its case, in a text field or a path."""
    low = needle.lower()
    fields = reduce(lambda a, b: a | b, (F.lower(F.coalesce(F.col(c), F.lit(""))).contains(low) for c in ("article_key", "concept_id", "title", "summary", "content")))
    rows = articles.where(fields | F.exists("source_paths", lambda p: F.lower(p).contains(low)))
    if lifecycle:
        rows = rows.where(F.lower("lifecycle") == lifecycle.lower())
    return rows if source_id is None else rows.where(F.col("source_id") == source_id)


def severity_rank(severity: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(severity, F.lit(""))))
    return F.when(s == "LOW", 1).when(s == "MEDIUM", 2).otherwise(3)


def review_route(reviews: DataFrame, threshold: str = "HIGH", auto_fix: bool = True, attempt: int = 0, rounds: int = 1) -> DataFrame:
    """Adds route and review_status to reviews (passed boolean, severities array<string>)."""
    fixing = F.lit(auto_fix and attempt < rounds) & (F.size("severities") > 0)
    grave = F.exists("severities", lambda s: severity_rank(s) >= severity_rank(F.lit(threshold)))
    route = F.when(F.col("passed"), "accepted").when(fixing, "fixable").when(~grave, "accepted").otherwise("needs_human_review")
    return reviews.withColumn("route", route).withColumn("review_status", F.when(route == "accepted", "passed").when(route == "fixable", "pending").otherwise("needs_human_review"))


def review_issues(article: Column, sources: Column) -> Column:
    """Codes of the rule-based review of an article against its sources."""
    a, s = F.trim(F.coalesce(article, F.lit(""))), F.trim(F.coalesce(sources, F.lit("")))
    # fixed values: severity, code
    rules = [(a == "", "HIGH:EMPTY_ARTICLE"), (~a.contains("sources:"), "HIGH:MISSING_SOURCES"), (~a.contains("review_status:"), "MEDIUM:MISSING_REVIEW_STATUS"), (a.contains("TODO") | a.contains("TBD"), "HIGH:PLACEHOLDER_CONTENT"), (~a.contains("# "), "MEDIUM:MISSING_TITLE"), (s == "", "HIGH:EMPTY_SOURCES")]
    return F.array_compact(F.array(*(F.when(t, F.lit(x)) for t, x in rules)))


def cacheable(answers: DataFrame, least_coverage: float = 0.6) -> DataFrame:
    ok = F.col("outcome").isin("SUCCESS", "PARTIAL_ANSWER") & (F.trim("answer") != "") & (F.col("evidence") > 0) & (F.col("review") == "PASSED") & (F.col("citations") > 0) & (F.col("demoted") == 0) & (F.col("unsupported") == 0) & (F.col("mismatch") == 0) & (F.col("coverage") >= least_coverage)
    return answers.withColumn("cacheable", F.coalesce(ok, F.lit(False)))


def confirm(pending: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays pending (with corrections appended) and the contributions that confirmed ones become; discarded ones go. decisions: query_id, action, correction."""
    rows = pending.join(decisions, "query_id", "left")
    correct = F.when(F.col("action") == "correct", F.concat("corrections", F.array("correction"))).otherwise(F.col("corrections"))
    stay = rows.where("action IS NULL OR action = 'correct'").withColumn("corrections", correct).select(*pending.columns)
    return stay, rows.where("action = 'confirm'").select("query_id", "question", "answer", "corrections")


def job_status(jobs: DataFrame, now: Column, stale_minutes: int = 10) -> DataFrame:
    """Adds derived_status: RUNNING with an expired lease, a stale heartbeat or stale progress is STALLED."""
    old = lambda c: F.coalesce(F.col(c) < now - F.make_interval(mins=F.lit(stale_minutes)), F.lit(False))
    stalled = F.coalesce(F.col("lease_until") < now, F.lit(False)) | old("heartbeat_at") | old("progress_at")
    return jobs.withColumn("derived_status", F.when((F.col("status") == "RUNNING") & stalled, "STALLED").otherwise(F.col("status")))


def expired_leases(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("status") == "RUNNING") & (F.col("lease_until") < now))


def next_job(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'QUEUED'").orderBy("requested_at", "job_id").limit(1)


def task_board(runs: DataFrame, jobs: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """The latest tasks of both kinds, and the status summary over all of them."""
    both = runs.select(F.lit("sync").alias("kind"), "task_id", "status", "updated_at").unionByName(jobs.select(F.lit("job").alias("kind"), "task_id", "status", "updated_at"))
    return both.orderBy(F.desc("updated_at"), "kind", "task_id").limit(limit), both.groupBy("status").agg(F.count("*").alias("n"))


def review_loop(articles: DataFrame, fix, rounds: int = 1, threshold: str = "HIGH") -> DataFrame:
    """Articles (article, sources) after at most ``rounds`` rounds of review and repair, with their route and status. ``fix`` turns the fixable rows (with ``issues``) into articles; each round works on what the one before left fixable."""
    done, open_ = None, articles
    for attempt in range(rounds + 1):
        issues = open_.withColumn("issues", review_issues(F.col("article"), F.col("sources")))
        severities = F.transform("issues", lambda i: F.substring_index(i, ":", 1))
        routed = review_route(issues.withColumn("passed", F.size("issues") == 0).withColumn("severities", severities), threshold, attempt=attempt, rounds=rounds)
        routed = cut(routed)  # else every later round would repair all of this one's rows again
        settled = routed.where("route != 'fixable'").select(*articles.columns, "route", "review_status")
        done = settled if done is None else done.unionByName(settled)
        if attempt < rounds:
            open_ = fix(routed.where("route = 'fixable'")).select(*articles.columns)
    return done


def route_runs(runs: DataFrame, now) -> DataFrame:
    """Adds status, sync_action, error to source runs (decision: as of ``decide_sources``, requested_at): unchanged bundles are skipped, doubtful ones wait for a confirmation and fail after seven days without one, new sources are created, others updated or appended to."""
    status = F.when(F.col("decision") == "SKIP", "SKIPPED_NO_CHANGE").when(F.col("decision") == "AMBIGUOUS", "WAIT_CONFIRM").otherwise("COMPILE_QUEUED")
    late = (status == "WAIT_CONFIRM") & F.col("requested_at").isNotNull() & (F.col("requested_at") + F.expr("INTERVAL 7 DAYS") <= now)
    action = F.when(F.col("decision") == "NEW_SOURCE", "CREATE").when(F.col("decision") == "EXISTING_SOURCE_UPDATE", "UPDATE").when(F.col("decision") == "EXISTING_SOURCE_APPEND", "APPEND")
    return runs.withColumn("error", F.when(late, "WAIT_CONFIRM timed out after 7 days")).withColumn("sync_action", action).withColumn("status", F.when(late, "FAILED").otherwise(status))
