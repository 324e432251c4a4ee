"""Product-dependency graph, product states and provenance.

``products``: pid, state, event, message, priority (+ ts, ttl, expires). ``dependencies``: downstream, upstream, role.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinelog.functions.times import instant
from brinelog.session import drop_written, written

# States, default role and the time to live that clears an expiry.
WAITING, RUNNING, AVAILABLE, COMPLETED, ERROR = "waiting", "running", "available", "completed", "error"
ANY_ROLE, FOREVER, HEARTBEAT = "any", -1, "heartbeat"


# -- simple queries ---------------------------------------------------------------------------------------------------

def product_count(products: DataFrame) -> DataFrame:
    return products.agg(F.count("*").alias("n"))


def most_recent(products: DataFrame, n: int = 25) -> DataFrame:
    return products.orderBy(F.desc("ts"), "pid").limit(n)


def younger_than(products: DataFrame, now: datetime, ago: timedelta) -> DataFrame:
    return products.where(F.col("ts") > instant(now - ago))


def older_than(products: DataFrame, now: datetime, ago: timedelta) -> DataFrame:
    return products.where(F.col("ts") < instant(now - ago))


def roots(products: DataFrame, dependencies: DataFrame) -> DataFrame:
    return products.join(dependencies.select(F.col("downstream").alias("pid")), "pid", "left_anti")


def leaves(products: DataFrame, dependencies: DataFrame) -> DataFrame:
    return products.join(dependencies.select(F.col("upstream").alias("pid")), "pid", "left_anti")


def downstream_ready(products: DataFrame, dependencies: DataFrame, roles: Sequence[str] | None = None,
                     state: str | None = None, upstream_state: str | None = None) -> DataFrame:
    """Products in ``state`` whose edges of the asked roles from products in ``upstream_state`` number exactly the roles.

    Edges with another role or state are left out first, so they do not block. Ordered by priority, then pid.
    """
    edges = dependencies
    if roles:
        edges = edges.where(F.col("role").isin(*roles))
    if upstream_state is not None:
        up = products.where(F.col("state") == upstream_state).select(F.col("pid").alias("upstream"))
        edges = edges.join(up, "upstream", "left_semi")
    distinct = sorted(set(roles or []))
    met = edges.groupBy(F.col("downstream").alias("pid")).agg(
        F.count("role").alias("_n"), *[F.bool_or(F.col("role") == role).alias(f"_{i}") for i, role in enumerate(distinct)])
    if roles:
        met = met.where(F.col("_n") == len(roles)).where(" AND ".join(f"_{i}" for i in range(len(distinct))))
    wanted = products if state is None else products.where(F.col("state") == state)
    return wanted.join(met.select("pid"), "pid", "left_semi").orderBy("priority", "pid")


def next_ready(products: DataFrame, dependencies: DataFrame, roles=(ANY_ROLE,), state: str = WAITING,
               upstream_state: str = AVAILABLE) -> DataFrame:
    return downstream_ready(products, dependencies, list(roles), state, upstream_state).limit(1)


def intermediates(products: DataFrame, dependencies: DataFrame, state: str = AVAILABLE,
                  upstream_state: str = AVAILABLE) -> DataFrame:
    """In ``state``, with something upstream and dependents that are all in ``upstream_state``."""
    down = products.select(F.col("pid").alias("downstream"), (F.col("state") != upstream_state).alias("_other"))
    dependents = dependencies.select("upstream", "downstream").join(down, "downstream").groupBy(
        F.col("upstream").alias("pid")).agg(F.max("_other").alias("_blocked")).where(~F.col("_blocked"))
    has_up = dependencies.select(F.col("downstream").alias("pid"))
    return products.where(F.col("state") == state).join(has_up, "pid", "left_semi").join(
        dependents.select("pid"), "pid", "left_semi")


# -- closure ----------------------------------------------------------------------------------------------------------

def _reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``start`` rows (``_at`` and other columns, distinct) moved along one or more ``edges`` (``_at, _next``), each result once.

    Path doubling: after round k the rows lie 1 to 2^k edges from their start, and the doubled edges join nodes that are 2^k edges apart, so the
    rounds grow with the logarithm of the longest path. The loop ends when a round finds nothing new, also on cycles. Levels are
    written and deleted once the next one stands.
    """
    carried = [c for c in start.columns if c != "_at"]
    hop = written(edges.distinct(), "edges")
    found = written(start.join(hop, "_at").select(*carried, F.col("_next").alias("_at")).distinct(), "reached")
    while True:
        further = found.join(hop, "_at").select(*carried, F.col("_next").alias("_at")).distinct()
        fresh = written(further.join(found, [*carried, "_at"], "left_anti"), "reached")
        if fresh.isEmpty():
            drop_written(hop)
            drop_written(fresh)
            return found
        longer = written(hop.join(hop.select(F.col("_at").alias("_next"), F.col("_next").alias("_far")), "_next")
                         .select("_at", F.col("_far").alias("_next")).distinct(), "edges")
        both = written(found.unionByName(fresh), "reached")
        for old in (hop, found, fresh):
            drop_written(old)
        hop, found = longer, both


def _edges(dependencies: DataFrame, up: bool) -> DataFrame:
    near, far = ("downstream", "upstream") if up else ("upstream", "downstream")
    known = dependencies.where(F.col(near).isNotNull() & F.col(far).isNotNull())
    return known.select(F.col(near).alias("_at"), F.col(far).alias("_next"))


def closure(dependencies: DataFrame, seeds: DataFrame, up: bool = True) -> DataFrame:
    """(seed, pid) of everything upstream (or downstream) of each seed, each pair once."""
    start = seeds.select(F.col("pid").alias("seed"), F.col("pid").alias("_at")).distinct()
    return _reach(_edges(dependencies, up), start).select("seed", F.col("_at").alias("pid"))


def reachable(dependencies: DataFrame, seeds: DataFrame, up: bool = True) -> DataFrame:
    """``pid`` of everything upstream (or downstream) of any seed, each once: a set of nodes, without pairs."""
    start = seeds.select(F.col("pid").alias("_at")).distinct()
    return _reach(_edges(dependencies, up), start).select(F.col("_at").alias("pid"))


def ancestors(dependencies: DataFrame, seeds: DataFrame) -> DataFrame:
    return closure(dependencies, seeds, up=True)


def descendants(dependencies: DataFrame, seeds: DataFrame) -> DataFrame:
    return closure(dependencies, seeds, up=False)


def dependency_graph(dependencies: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges into the seeds, their ancestors and their descendants."""
    nodes = seeds.select("pid").union(reachable(dependencies, seeds)).union(reachable(dependencies, seeds, up=False))
    return dependencies.join(nodes.select(F.col("pid").alias("downstream")), "downstream", "left_semi")


def delete_tree(products: DataFrame, dependencies: DataFrame, seeds: DataFrame) -> DataFrame:
    """Products without the seeds and all their ancestors."""
    return products.join(seeds.select("pid").union(reachable(dependencies, seeds)), "pid", "left_anti")


def add_dependency(products: DataFrame, dependencies: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables after adding edges (``downstream, upstream, role, priority``): an unknown upstream is made available, an
    unknown downstream waiting."""
    made = new.select(F.col("upstream").alias("pid"), F.lit(AVAILABLE).alias("state"), "priority", F.lit(0).alias("_o")).union(
        new.select(F.col("downstream").alias("pid"), F.lit(WAITING).alias("state"), "priority", F.lit(1).alias("_o")))
    one = made.groupBy("pid").agg(F.min_by(F.struct("state", "priority"), "_o").alias("s")).select("pid", "s.*")
    fresh = one.join(products.select("pid"), "pid", "left_anti")
    edges = new.select("downstream", "upstream", "role").distinct()
    added = edges.join(dependencies, ["downstream", "upstream", "role"], "left_anti")
    return (products.unionByName(fresh.withColumn("event", F.lit("created")), allowMissingColumns=True),
            dependencies.unionByName(added))


def product_deps(rows: DataFrame, pid: str = "pid") -> DataFrame:
    """Static product graph of an identifier; only its name without product and extension matters."""
    # Product, upstream product and role.
    lid = F.regexp_extract(pid, r"^([^_.]+)", 1)
    me = F.col(pid)
    edges = [("_gray", me, "color"), ("_canny", F.concat(lid, F.lit("_gray")), "gray"),
             ("_final", F.concat(lid, F.lit("_canny")), "overlay"), ("_final", me, "background")]
    made = F.array(*[F.struct(F.concat(lid, F.lit(p)).alias("product"), u.alias("upstream_product"), F.lit(r).alias("role"))
                     for p, u, r in edges])
    return rows.select(pid, F.explode(made).alias("e")).select(pid, "e.*").distinct()


# -- states -----------------------------------------------------------------------------------------------------------

def fold_events(events: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Current row of each product from its events. A null field keeps the older value; ttl -1 clears the expiry.

    A plain grouped aggregate with partial sums, so it runs on tables and on streams alike.
    """
    at = F.struct(*order)

    def last(col: str) -> Column:
        return F.max_by(col, F.when(F.col(col).isNotNull(), at)).alias(col)

    folded = events.groupBy("pid").agg(last("state"), last("event"), last("message"), last("ttl"), F.max("ts").alias("ts"))
    ttl = F.when(F.col("ttl") != FOREVER, F.col("ttl"))
    expires = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + ttl.cast("bigint") * 1000000)
    return folded.withColumns({"ttl": ttl, "expires": expires.cast("timestamp_ntz")})


def heartbeat(products: DataFrame, now: datetime, pids: DataFrame) -> DataFrame:
    """Events that renew the time to live of products."""
    return products.join(pids, "pid", "left_semi").select(
        "pid", instant(now).alias("ts"), F.lit(None).cast("string").alias("state"), F.lit(HEARTBEAT).alias("event"),
        F.lit(HEARTBEAT).alias("message"), F.lit(None).cast("int").alias("ttl"))


def expire_ttl(products: DataFrame, now: datetime, new_state: str = WAITING) -> DataFrame:
    """Rows past their expiry go to ``new_state``, whatever their state was."""
    late = F.coalesce(F.col("expires") < instant(now), F.lit(False))
    renewed = F.timestamp_micros(F.unix_micros(instant(now).cast("timestamp")) + F.col("ttl").cast("bigint") * 1000000)
    changes = {"state": F.lit(new_state), "event": F.lit("expired"), "message": F.lit(HEARTBEAT), "ts": instant(now),
               "expires": renewed.cast("timestamp_ntz")}
    return products.withColumns({c: F.when(late, v).otherwise(F.col(c)) for c, v in changes.items()})


def _event(rows: DataFrame, now: datetime, state: str, event: str, message: str | None) -> DataFrame:
    return rows.select("pid", instant(now).alias("ts"), F.lit(state).alias("state"), F.lit(event).alias("event"),
                       F.lit(message).cast("string").alias("message"))


def start_next(products: DataFrame, dependencies: DataFrame, now: datetime, roles=(ANY_ROLE,), message=None) -> DataFrame:
    """The event that claims the next ready product, to be appended to the event log."""
    return _event(next_ready(products, dependencies, roles), now, RUNNING, "start_next", message)


def conditional_update(products: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply ``pid, expected, new_state`` where the product is in the expected state; one update per product."""
    rows = products.join(updates.select("pid", "expected", "new_state"), "pid", "left")
    hit = F.coalesce(F.col("state") == F.col("expected"), F.lit(False))
    return rows.withColumns({"state": F.when(hit, F.col("new_state")).otherwise(F.col("state")),
                             "event": F.when(hit, "update_if").otherwise(F.col("event"))}).drop("expected", "new_state")


def work_outcome(jobs: DataFrame, work, message: str | None = None) -> DataFrame:
    """Outcome of every job as an event; a failed job gets state error with the text of its failure.

    ``work`` is an expression that gives this text, null where the job succeeds, or, where no expression can do the work, a
    Python function of a row that raises.
    """
    if isinstance(work, Column):
        failed = F.col("_failure").isNotNull()
        return jobs.select("pid", work.cast("string").alias("_failure")).select(
            "pid", F.when(failed, ERROR).otherwise(AVAILABLE).alias("state"), F.when(failed, "exception").otherwise(COMPLETED).alias("event"),
            F.coalesce("_failure", F.lit(message)).alias("message"))

    def run(batches):
        for pdf in batches:
            states, events, messages = [], [], []
            for row in pdf.to_dict("records"):
                try:
                    work(row)
                    states.append(AVAILABLE), events.append(COMPLETED), messages.append(message)
                except Exception as e:  # the text is the result
                    states.append(ERROR), events.append("exception"), messages.append(f"{type(e).__name__}: {e}")
            yield pdf[["pid"]].assign(state=states, event=events, message=messages)

    pid_type = jobs.schema["pid"].dataType.simpleString()
    return jobs.mapInPandas(run, f"pid {pid_type}, state string, event string, message string")


# -- provenance -------------------------------------------------------------------------------------------------------

def open_process(rows: DataFrame, now: datetime) -> dict[str, DataFrame]:
    """Rows for the four provenance tables of new processes (``process_id, algorithm, version, parameters, inputs``)."""
    at = instant(now)
    return {
        "processes": rows.select("process_id", at.alias("opened")),
        "events": rows.select("process_id", F.lit("new").alias("status"), at.alias("observed")),
        "algorithms": rows.select("process_id", "algorithm", "version", "parameters"),
        "used": rows.select("process_id", F.explode("inputs").alias("pid")),
    }


def close_process(processes: DataFrame, process_id: str, now: datetime) -> DataFrame:
    return processes.withColumn("closed", F.when(F.col("process_id") == process_id, instant(now)).otherwise(F.col("closed")))


def latest_status(events: DataFrame) -> DataFrame:
    return events.groupBy("process_id").agg(F.max_by("status", "observed").alias("status"))


def process_ids(links: DataFrame, process_id: object) -> DataFrame:
    """Input or output ids of a process."""
    return links.where(F.col("process_id") == process_id).select("pid")


def provenance_records(runs: DataFrame) -> DataFrame:
    """Two rows per run (``process_id, algorithm_id, start, stop`` and path, md5, length of both files)."""
    def side(direction: str, prefix: str) -> Column:
        return F.struct(F.lit(direction).alias("direction"), F.col(f"{prefix}_path").alias("pathname"),
                        F.col(f"{prefix}_md5").alias("fixity_md5"), F.col(f"{prefix}_length").alias("fixity_length"))
    both = F.explode(F.array(side("used", "in"), side("generated by", "out"))).alias("r")
    return runs.select("process_id", "algorithm_id", F.col("start").alias("no_earlier_than"),
                       F.col("stop").alias("no_later_than"), both).select("*", "r.*").drop("r")
