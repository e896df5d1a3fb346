"""The job ledger: every operation takes a jobs table and gives a table. One writer keeps what they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses and phases.
ACTIVE = ("queued", "starting_model", "translating", "writing")
RUNNING = ("starting_model", "translating", "writing")
TERMINAL = ("completed", "failed", "cancelled")
PHASES = {"queued": ("queued",), "in_progress": RUNNING, "completed": ("completed",), "failed": ("failed",)}
PAGE, MOST, SWEEP = 50, 100, 500


def phase(status: Column) -> Column:
    """A cancelled job is in no phase."""
    out = F.lit(None).cast("string")
    for name, members in PHASES.items():
        out = F.when(status.isin(*members), name).otherwise(out)
    return out


def page(jobs: DataFrame, owner: str, limit: int = PAGE, cursor: tuple[int, str] | None = None, in_phase: str | None = None) -> DataFrame:
    """An owner's newest jobs after the cursor, one more than the page holds if there are more."""
    rows = jobs.filter(F.col("owner") == owner)
    if in_phase:
        rows = rows.filter(F.col("status").isin(*PHASES[in_phase]))
    if cursor:
        at, id_ = cursor
        rows = rows.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < id_)))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(min(max(limit, 1), MOST) + 1)


def cursor_of(created_at: Column, id_: Column) -> Column:
    return F.concat_ws(":", created_at.cast("string"), id_)


def active(jobs: DataFrame, owner: str) -> DataFrame:
    return jobs.filter((F.col("owner") == owner) & F.col("status").isin(*ACTIVE)).orderBy(F.desc("created_at"), F.desc("id"))


def counts(jobs: DataFrame) -> DataFrame:
    """owner, active, total and a count for each phase."""
    each = [F.count_if(F.col("status").isin(*m)).alias(name) for name, m in PHASES.items()]
    return jobs.groupBy("owner").agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active"), F.count("*").alias("total"), *each)


def recover(jobs: DataFrame, now: int) -> DataFrame:
    """The queue after a restart: interrupted jobs are queued again with a new time."""
    was = F.col("status").isin(*RUNNING)
    return jobs.filter(was | (F.col("status") == "queued")).withColumn("updated_at", F.when(was, now).otherwise(F.col("updated_at")).cast("long")).withColumn("status", F.lit("queued"))


def claim(jobs: DataFrame, ids: Column, now: int) -> DataFrame:
    """The ledger after claims: a queued job that `ids` picks starts its model."""
    hit = (F.col("status") == "queued") & ids
    return jobs.withColumn("error", F.when(~hit, F.col("error"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")).cast("long")).withColumn("status", F.when(hit, "starting_model").otherwise(F.col("status")))


def _admitted(wanted: DataFrame, jobs: DataFrame, limit: int, order: list[Column]) -> DataFrame:
    """owner, id of the wanted jobs for which an owner has room, taken one after the other until the limit of active ones."""
    busy = jobs.filter(F.col("status").isin(*ACTIVE)).groupBy("owner").agg(F.count("*").alias("busy"))
    turn = wanted.select("owner", "id", F.row_number().over(Window.partitionBy("owner").orderBy(*order)).alias("turn")).filter(F.col("turn") <= limit)  # no owner has room for more, so no task sorts more
    return turn.join(busy, "owner", "left").filter(F.coalesce("busy", F.lit(0)) + F.col("turn") <= limit).select("owner", "id")


def retry(requests: DataFrame, jobs: DataFrame, active_limit: int) -> DataFrame:
    """owner, id, outcome for the distinct requests(owner, id), taken by id: not_found, not_failed, at_limit or retried; each one retried counts as active for the next."""
    r = requests.select("owner", "id").distinct().join(jobs.select("owner", "id", "status"), ["owner", "id"], "left")
    done = _admitted(r.filter("status = 'failed'"), jobs, active_limit, [F.col("id")]).withColumn("done", F.lit(True))
    outcome = F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "failed", "not_failed").when(F.col("done"), "retried").otherwise("at_limit")
    return r.join(done, ["owner", "id"], "left").select("owner", "id", outcome.alias("outcome"))


def retried(jobs: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """The ledger after retries: those jobs begin anew."""
    done = outcomes.filter("outcome = 'retried'").select("owner", "id", F.lit(True).alias("__r"))
    j = jobs.join(done, ["owner", "id"], "left")
    again = F.col("__r").isNotNull()
    for c in ("total", "completed", "translated", "failed_segments"):
        j = j.withColumn(c, F.when(again, 0).otherwise(F.col(c)).cast("long"))
    j = j.withColumn("error", F.when(~again, F.col("error"))).withColumn("result_available", F.col("result_available") & ~again).withColumn("status", F.when(again, "queued").otherwise(F.col("status")))
    for c in ("created_at", "updated_at"):
        j = j.withColumn(c, F.when(again, now).otherwise(F.col(c)).cast("long"))
    return j.drop("__r")


def expired(jobs: DataFrame, cutoff: int, limit: int = SWEEP) -> DataFrame:
    """The next sweep: the longest finished jobs before the cutoff."""
    return jobs.filter(F.col("status").isin(*TERMINAL) & (F.col("updated_at") < cutoff)).orderBy("updated_at", "id").limit(limit)


def delete_terminal(jobs: DataFrame, ids: Column) -> DataFrame:
    """The ledger without the finished jobs that `ids` picks; others stay whatever is asked."""
    return jobs.filter(~(F.coalesce(ids, F.lit(False)) & F.col("status").isin(*TERMINAL)))


def insert(jobs: DataFrame, new: DataFrame, limit: int = 2000) -> DataFrame:
    """The ledger after new jobs, taken one after the other: those for which their owner has no room left are refused."""
    return jobs.unionByName(new.join(_admitted(new, jobs, limit, [F.col("created_at"), F.col("id")]), ["owner", "id"], "left_semi"))


def get(jobs: DataFrame, owner: str, id_: str) -> DataFrame:
    """An owner's job; another owner's is not found."""
    return jobs.filter((F.col("owner") == owner) & (F.col("id") == id_))


def cancel(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """owner, id, outcome for requests(owner, id): not_found, already_terminal or cancelled, whether it waits or runs."""
    status = F.col("status")
    outcome = F.when(status.isNull(), "not_found").when(status.isin(*TERMINAL), "already_terminal").otherwise("cancelled")
    return requests.select("owner", "id").distinct().join(jobs.select("owner", "id", "status"), ["owner", "id"], "left").select("owner", "id", outcome.alias("outcome"))


def cancelled(jobs: DataFrame, outcomes: DataFrame, now: int) -> DataFrame:
    """The ledger after cancellations: those jobs have ended, without an error."""
    done = outcomes.filter("outcome = 'cancelled'").select("owner", "id", F.lit(True).alias("__c"))
    j = jobs.join(done, ["owner", "id"], "left")
    hit = F.col("__c").isNotNull()
    return j.withColumn("error", F.when(~hit, F.col("error"))).withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")).cast("long")).drop("__c")


def upsert(jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """The ledger with the changed rows in place of those of the same id."""
    return jobs.join(changed.select("id").distinct(), "id", "left_anti").unionByName(changed.dropDuplicates(["id"]))


def page_info(jobs: DataFrame, owner: str, limit: int = PAGE, cursor: tuple[int, str] | None = None, in_phase: str | None = None) -> DataFrame:
    """One row: ids of the page in order, has_more, next_cursor (of the last job shown, if there are more) and the total before any cursor."""
    size = min(max(limit, 1), MOST)
    shown = page(jobs, owner, limit, cursor, in_phase).agg(F.array_sort(F.collect_list(F.struct(F.col("created_at"), F.col("id"))), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0)).alias("got"))
    mine = jobs.filter(F.col("owner") == owner)
    total = (mine.filter(F.col("status").isin(*PHASES[in_phase])) if in_phase else mine).agg(F.count("*").alias("total"))
    row = shown.join(total).withColumn("has_more", F.size("got") > size).withColumn("last", F.element_at("got", size))
    return row.select(F.transform(F.slice("got", 1, size), lambda x: x.id).alias("ids"), "has_more", F.when(F.col("has_more"), cursor_of(F.col("last.created_at"), F.col("last.id"))).alias("next_cursor"), "total")


def read_cursor(cursor: Column) -> Column:
    """struct(created_at, id) of a page's cursor; null where it isn't one: a whole number, a colon and a name of 1 to 64 letters, digits and hyphens."""
    good = cursor.rlike("^[0-9]{1,18}:[0-9A-Za-z-]{1,64}$")
    return F.when(good, F.struct(F.substring_index(cursor, ":", 1).cast("long").alias("created_at"), F.substring_index(cursor, ":", -1).alias("id")))


def downloadable(status: Column, result_available: Column) -> Column:
    return (status == "completed") | result_available
