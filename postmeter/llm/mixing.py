"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled queue, as often as they may repeat. A turn of a document finishes at its source's
running token sum divided by the source's weight. All turns are range-sorted by virtual finish time over the whole cluster, and
the sorted list is truncated where the words served meet the budget. Words served at a finish are those of all turns finished
by then and of the turns still being served: a source gives weight * time until its queue is empty, so the running sums that
the list needs are those of the queues that have run empty before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmeter.llm.common import SPACE, durable

#: Weights of the sources in code point order, repeating; share of all sizes that is taken; most repeats.
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET_SHARE = 1.5
REPEATS = 2


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, source_size), one row for each source, plus weight and target (double): what its taken words are held against.

    Targets are shares of the budget by weight; what is above a source's cap is shared out again until none is above. Each
    round is one aggregate over the table of sources.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int"))
    s = durable(sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats)))
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        capped, open_ = F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))
        row = s.agg(F.sum("source_size").alias("all"), capped.alias("capped"), open_.alias("open")).first()
        budget = budget_share * (row["all"] or 0)
        if not row["open"]:
            break
        rise = (budget - (row["capped"] or 0.0)) / row["open"]
        if rise <= level * (1 + 1e-12):
            break
        level = rise
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _running(sorted_rows: DataFrame, key: str | None, sums: list[str], kept: list[str]) -> DataFrame:
    """kept columns, `part` (number of the range partition) and for each of sums `run_<name>`: the sum up to and with the row.

    sorted_rows are range-partitioned and sorted. Sums run within a partition, and within a value of key if there is one; what
    earlier partitions hold is added by `_with_earlier`. A partition is read batch by batch.
    """
    schema = sorted_rows.select(*kept).schema.add("part", "integer")
    for name in sums:
        schema = schema.add(f"run_{name}", sorted_rows.schema[name].dataType)

    def run(batches):
        part, last, carried = TaskContext.get().partitionId(), None, {n: 0 for n in sums}
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(key).to_numpy(zero_copy_only=False) if key else np.zeros(b.num_rows, np.int64)
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            goes_on = last is not None and keys[0] == last
            out = [b.column(c) for c in kept] + [pa.array(np.full(b.num_rows, part, np.int32))]
            for n in sums:
                total = np.cumsum(b.column(n).to_numpy())
                base = np.append(0, total)[starts]
                if goes_on:
                    base = base.astype(total.dtype)
                    base[0] -= carried[n]
                total = total - np.repeat(base, np.diff(np.append(starts, b.num_rows)))
                carried[n] = total[-1]
                out.append(pa.array(total))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return sorted_rows.mapInArrow(run, schema)


def _with_earlier(running: DataFrame, key: str | None, sums: list[str]) -> DataFrame:
    """Adds to every run_<name> what earlier range partitions hold. The table of partitions' last sums has a row a partition
    and key value that meets in it, fewer than partitions plus key values, so it stays small."""
    keys = ["part"] + ([key] if key else [])
    ends = durable(running.groupBy(*keys).agg(*(F.max(f"run_{n}").alias(f"end_{n}") for n in sums)))
    order = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select(*keys, *(F.coalesce(F.sum(f"end_{n}").over(order), F.lit(0)).alias(f"early_{n}") for n in sums))
    joined = running.join(earlier, keys)
    return joined.withColumns({f"run_{n}": F.col(f"run_{n}") + F.col(f"early_{n}") for n in sums}).drop(*(f"early_{n}" for n in sums))


def queued(docs: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """Every document in its source's queue: doc_id, source, size, ticket, source_size, weight, target and before, the words
    of the source that stand ahead of it in a turn of the whole queue."""
    named = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    identity = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(identity).alias("ticket"))
    sized = durable(sized.withColumn("queue", named))
    sizes = durable(sized.groupBy("queue").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")))
    targets = source_targets(sizes.select("source", "source_size"), weights, budget_share, repeats)
    targets = durable(targets.withColumn("queue", named).select("queue", "source_size", "weight", "target"))
    keys = ["queue", "ticket", "doc_id", "size"]
    shuffled = sized.repartitionByRange(_partitions(sized), *keys).sortWithinPartitions(*keys)
    running = durable(_running(shuffled, "queue", ["size"], ["queue", "doc_id", "source", "size", "ticket"]))
    placed = _with_earlier(running, "queue", ["size"]).withColumn("before", F.col("run_size") - F.col("size"))
    return durable(placed.join(targets, "queue").drop("queue", "part", "run_size"))


def _partitions(df: DataFrame) -> int:
    """Range partitions are as many as the session's shuffle partitions; the number is given, so that none are joined."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def turns(queue: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Every turn of every queued document with its virtual finish time, range-sorted over the whole cluster.

    ended_weight, ended_words: weight and words of a queue on the turn that empties it, else 0.
    """
    each = queue.withColumn("turn", F.explode(F.array(*map(F.lit, range(repeats))))).filter("source_size > 0")
    done = F.col("before") + F.col("turn") * F.col("source_size") + F.col("size")
    last = (done == F.col("source_size") * repeats) & (F.col("size") > 0)
    each = each.select(
        "doc_id",
        "turn",
        "size",
        "weight",
        "ticket",
        (done / F.col("weight")).alias("finish"),
        F.when(last, F.col("weight")).otherwise(0.0).alias("ended_weight"),
        F.when(last, done).otherwise(F.lit(0)).cast("double").alias("ended_words"),
    )
    keys = ["finish", "ticket", "doc_id", "turn"]
    return each.repartitionByRange(_partitions(queue), *keys).sortWithinPartitions(*keys)


def cut(queue: DataFrame, budget: float, repeats: int = REPEATS) -> float:
    """The virtual time at which the words served meet the budget; infinite if all turns together don't reach it.

    It is found on the range-sorted turns: the first one at whose finish the words served are the budget or more.
    """
    names = ["ended_weight", "ended_words"]
    kept = ["finish", "ticket", *names]
    listed = durable(_running(turns(queue, repeats), None, names, kept))
    weight = queue.groupBy("source").agg(F.first("weight").alias("w"), F.first("source_size").alias("n")).filter("n > 0").agg(F.sum("w")).first()[0]
    if not weight:
        return 0.0
    open_ = F.lit(weight) - (F.col("run_ended_weight") - F.col("ended_weight"))
    closed = F.col("run_ended_words") - F.col("ended_words")
    served = _with_earlier(listed, None, names).select("finish", open_.alias("open"), closed.alias("closed"))
    served = served.withColumn("served", F.col("finish") * F.col("open") + F.col("closed")).filter(F.col("served") >= budget)
    row = served.agg(F.min_by(F.struct("open", "closed"), "finish")).first()[0]
    return (budget - row["closed"]) / row["open"] if row else float("inf")


def mix(docs: DataFrame, weights=WEIGHTS, budget_share: float = BUDGET_SHARE, repeats: int = REPEATS, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and finish for every row of docs.

    taken: the words that the mix takes of the document, over all its turns: whole turns that finish before the cut, and of a turn
    that the cut finds being served the words served by then, rounded. finish: virtual finish time of the document's first turn (null
    when the source has no words). The shuffle depends on seed, doc_id and text only, so reruns agree.
    A null text has size 0; a null source is a source of its own, last; a null doc_id is shuffled by its text; repeated rows
    queue one after the other and share what their common place in the queue takes in an unspecified but total order of size.
    Other columns are not read. No documents: no rows.
    """
    queue = queued(docs, weights, budget_share, repeats, seed)
    total = queue.agg(F.sum("size")).first()[0] or 0
    until = cut(queue, budget_share * total, repeats)
    words = F.least(F.col("weight") * F.lit(until), F.col("source_size") * float(repeats))
    limit = F.floor(words + 0.5).cast("long")
    taken = F.lit(0).cast("long")
    for k in range(repeats):
        ahead = F.col("before") + F.lit(k) * F.col("source_size")
        taken = taken + F.least(F.greatest(limit - ahead, F.lit(0)), F.col("size"))
    finish = F.when(F.col("source_size") > 0, (F.col("before") + F.col("size")) / F.col("weight"))
    return queue.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), finish.alias("finish"))


def mixed_order(mixed: DataFrame) -> DataFrame:
    """The documents that the mix takes, range-partitioned and sorted by virtual finish time over the whole cluster."""
    taken = mixed.filter("taken > 0")
    return taken.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")


_WORDS = r"regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+')"
#: DuckDB's statement of mix() with its default parameters.
ORACLE_SQL = rf"""
with d as (
  select doc_id, source, coalesce(text, '') as text, len(list_filter({_WORDS}, lambda x: x <> ''))::bigint as size from documents
), t as (
  select *, md5(concat_ws('|', '17', coalesce(doc_id::varchar, ''), md5(text))) as ticket, coalesce(source, '') as named, source is null as unnamed from d
), s as (
  select unnamed, named, sum(size)::bigint as source_size,
    [5.0, 2.0, 1.0][((row_number() over (order by unnamed, named) - 1) % 3 + 1)::int]::double as weight
  from t group by unnamed, named
), c as (
  select *, 2.0::double * source_size as cap, row_number() over (order by 2.0::double * source_size / weight, unnamed, named) as k,
    1.5::double * sum(source_size) over () as budget from s
), l as (
  select *, sum(cap) over (order by k) - cap as capped, sum(weight) over () - (sum(weight) over (order by k) - weight) as open_ from c
), v as (
  select coalesce(min_by((budget - capped) / open_, k) filter (where (budget - capped) / open_ <= cap / weight), 'infinity'::double) as level from l
), q as (
  select s.*, least(2.0::double * source_size, weight * level) as target from s, v
), p as (
  select t.*, q.source_size, q.weight, q.target, floor(q.target + 0.5)::bigint as lim,
    (sum(size) over (partition by t.unnamed, t.named order by ticket, doc_id, size rows unbounded preceding) - size)::bigint as before
  from t join q on t.unnamed = q.unnamed and t.named = q.named
)
select doc_id, source, size, source_size, target,
  (least(greatest(lim - before, 0), size) + least(greatest(lim - before - source_size, 0), size))::bigint as taken,
  case when source_size > 0 then (before + size) / weight end as finish
from p
"""
