"""Retention, offboarding, status, sequences."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabloom.operators.joins import stored


def cutoff(days: int, now) -> Column:
    return F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")


def before(moment: Column, days: int) -> Column:
    """The cutoff of a retention of so many days, seen from a moment."""
    return moment - F.expr(f"interval {int(days)} days")


def sweep(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str, expired: Column) -> dict[str, DataFrame]:
    """Tables without the expired parents and the rows that hang on them."""
    gone = parents.where(expired).select(F.col(key).alias("_gone")).distinct()
    out = {"parents": parents.join(gone, F.col(key) == F.col("_gone"), "left_anti")}
    for name, (df, ref) in children.items():
        out[name] = df.join(gone, F.col(ref) == F.col("_gone"), "left_anti")
    return out


@dataclass
class Retired:
    """What a retention or offboarding takes: tables without the rows that go, and a manifest (step, table, id) of those rows, whose steps
    delete children before parents."""

    kept: dict[str, DataFrame]
    manifest: DataFrame

    def counts(self) -> dict[str, int]:
        return {r["table"]: r["n"] for r in self.manifest.groupBy("table").agg(F.count("*").alias("n")).collect()}

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.counts(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def retire(tables: dict[str, tuple[DataFrame, str]], links: list[tuple[str, str, str]], roots: dict[str, Column]) -> Retired:
    """Closure of the rows that go over a graph of foreign keys: rows of a root that meet its condition, and all rows that hang on one
    that goes. tables: name -> (frame, key); links: (child, column, parent).

    Tables are taken parents first, each once its parents are known; tables that refer to each other, or to themselves, are gone
    through again until nothing is added. Only keys are joined. A null reference hangs on nothing, a null key is never a parent,
    and a condition that is null keeps its row."""
    unknown = {n for link in links for n in (link[0], link[2])} | set(roots)
    if unknown - set(tables):
        raise ValueError(f"unknown tables: {', '.join(sorted(unknown - set(tables)))}")
    spark = next(iter(tables.values()))[0].sparkSession
    parents: dict[str, set[str]] = {n: set() for n in tables}
    for child, _, parent in links:
        if child != parent:
            parents[child].add(parent)
    try:
        order, cyclic = list(TopologicalSorter(parents).static_order()), any(c == p for c, _, p in links)
    except CycleError:
        order, cyclic = sorted(tables), True
    gone: dict[str, DataFrame] = {}
    rows = {n: -1 for n in tables}
    while True:
        before = dict(rows)
        for name in order:
            df, key = tables[name]
            hit = [df.where(roots[name])] if name in roots else []
            hit += [df.join(gone[p].select(F.col("id").alias("_gone")), F.col(f"`{c}`") == F.col("_gone"), "left_semi") for child, c, p in links if child == name and p in gone]
            if not hit:
                continue
            ids = [h.select(F.col(f"`{key}`").alias("id")) for h in hit]
            every = ids[0]
            for more in ids[1:]:
                every = every.unionByName(more)
            gone[name] = stored(every.where("id is not null").distinct(), f"gone-{name}")
            rows[name] = gone[name].count() if cyclic else 0
        if not cyclic or rows == before:
            break
    kept = {n: df.join(gone[n].select(F.col("id").alias("_gone")), F.col(f"`{key}`") == F.col("_gone"), "left_anti") if n in gone else df for n, (df, key) in tables.items()}
    manifest = spark.createDataFrame([], "step int, table string, id string")
    for step, name in enumerate(reversed([n for n in order if n in gone]), 1):
        manifest = manifest.unionByName(gone[name].select(F.lit(step).alias("step"), F.lit(name).alias("table"), F.col("id").cast("string").alias("id")))
    return Retired(kept, manifest)


def offboard(tables: dict[str, DataFrame], org: str, column: str = "org_id") -> tuple[dict[str, DataFrame], dict[str, int], str]:
    """All tables without a tenant's rows, how many went from each, and a digest of those counts."""
    if not org or not org.strip():
        raise ValueError("a tenant is required")
    counts = {n: t.where(F.col(column) == org).count() for n, t in tables.items()}
    kept = {n: t.where(~F.col(column).eqNullSafe(F.lit(org))) for n, t in tables.items()}
    return kept, counts, hashlib.sha256(json.dumps(counts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def canonical_hash(value) -> str:
    """sha256 of a tagged encoding: kinds cannot be confused, keys are sorted, 3.0 is 3, and no infinities."""

    def enc(v) -> str:
        if v is None:
            return "n"
        if isinstance(v, bool):
            return f"b:{int(v)}"
        if isinstance(v, float):
            if v != v or v in (float("inf"), float("-inf")):
                raise ValueError("not a finite number")
            if v == int(v):
                v = int(v)
            else:
                return f"f:{v!r}"
        if isinstance(v, int):
            return f"i:{v}"
        if isinstance(v, str):
            return f"s:{len(v)}:{v}"
        if isinstance(v, (list, tuple)):
            return "l:[" + ",".join(map(enc, v)) + "]"
        if isinstance(v, dict):
            return "d:{" + ",".join(f"{enc(str(k))}={enc(v[k])}" for k in sorted(v, key=str)) + "}"
        raise TypeError(type(v).__name__)

    return hashlib.sha256(enc(value).encode()).hexdigest()


def document_status(blocked: Column, review: Column, pending: Column) -> Column:
    """Worst first: blocked, changes_requested, pending_review, draft."""
    return F.when(blocked, "blocked").when(review.isin("open", "rejected"), "changes_requested").when(pending, "pending_review").otherwise("draft")


def gapless(df: DataFrame, tenant: str, order: list, start: int = 1) -> DataFrame:
    """Numbers 1, 2, ... of each tenant in order."""
    return df.withColumn("number", F.row_number().over(W.partitionBy(tenant).orderBy(*order)) + (start - 1))


def unique_names(df: DataFrame, name: str, order: list) -> DataFrame:
    """name, name (2), name (3) for repeated names."""
    n = F.row_number().over(W.partitionBy(F.lower(name)).orderBy(*order))
    return df.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))).drop("_n")


def redeem(grants: DataFrame, attempts: DataFrame, token: str, granted: str, tried: str, ttl_seconds: int, order: list) -> DataFrame:
    """Attempts with whether each is served: a grant serves the first attempt that comes before it runs out, and no other."""
    g = grants.select(F.col(token).alias("_t"), F.col(granted).alias("_g"))
    age = F.unix_micros(F.col(tried).cast("timestamp")) - F.unix_micros(F.col("_g").cast("timestamp"))
    a = attempts.join(g, F.col(token) == F.col("_t"), "left").withColumn("_ok", F.coalesce((age >= 0) & (age < ttl_seconds * 1_000_000), F.lit(False)))
    turn = F.row_number().over(W.partitionBy(token, "_ok").orderBy(*order))
    return a.withColumn("served", F.col("_ok") & (turn == 1)).drop("_t", "_g", "_ok")


#: States of an ingested file, in order.
INGEST = ("uploaded", "parsed", "indexed", "ready")


def ingest_states(events: DataFrame, key: str, state: str, order: list) -> DataFrame:
    """State of each file from its log: the furthest it reached in one step after another; a failure ends it, and a state that
    skips one does not count."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(state).alias("_s")))), lambda x: x["_s"])
    names = F.array(*[F.lit(s) for s in INGEST])
    walk = lambda a: F.aggregate(a, F.struct(F.lit(0).alias("n"), F.lit(False).alias("failed")), lambda acc, x: F.when(acc["failed"], acc).when(x == "failed", F.struct(acc["n"].alias("n"), F.lit(True).alias("failed"))).when(x == F.get(names, acc["n"]), F.struct((acc["n"] + 1).alias("n"), F.lit(False).alias("failed"))).otherwise(acc))
    g = events.groupBy(key).agg(walk(steps).alias("_w"))
    return g.select(key, F.when(F.col("_w.failed"), "failed").when(F.col("_w.n") == 0, "unknown").otherwise(F.get(names, F.col("_w.n") - 1)).alias("state"))
