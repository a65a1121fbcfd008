"""References to records that do not exist: direct reasons, and the cascade of inherited orphans.

A reference is compared without white space around it and without regard to case.  Reasons, in this
order of precedence:

``missing``  no record has the key;
``deleted``  the target's deletion is at or before the referring record's own time;
``later``    the target came after the referring record's own time.

Null and blank references are no cases.  Where the own time or the target's times are null, only
``missing`` can apply.  Repeated rows of parents count as one record (earliest creation, and deleted
only if every row of the key is); repeated child rows give one result row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoflow.functions.text import strip
from lithoflow.session import cut

FOUND = "table_name string, record_id string, ref_value string, reason string"


@dataclass(frozen=True)
class Parent:
    """A table that is referred to: its key, when its record came, when it was deleted."""

    name: str
    key: str
    created: str | None = None
    deleted: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    """``child.ref`` points to ``parent``; record and at are the child's own key and time.
    ``many``: an expression that gives an array of references, instead of ``ref``."""

    child: str
    record: str
    ref: str
    parent: Parent
    at: str | None = None
    many: Column | None = None


def norm_key(c: Column | str) -> Column:
    return F.upper(strip(F.col(c) if isinstance(c, str) else c))


def references(child: DataFrame, fk: ForeignKey) -> DataFrame:
    """(record_id, ref_value, at) of every non-blank reference, repeated rows once."""
    ref = F.explode(fk.many) if fk.many is not None else F.col(fk.ref)
    at = F.col(fk.at).cast("timestamp") if fk.at else F.lit(None).cast("timestamp")
    rows = child.select(F.col(fk.record).cast("string").alias("record_id"), ref.alias("ref"), at.alias("at"))
    return rows.select("record_id", norm_key("ref").alias("ref_value"), "at").where(F.col("ref_value") != "")


def targets(parent: DataFrame, p: Parent) -> DataFrame:
    """One row per key of the parent: (ref_value, created, deleted)."""
    when = lambda c: F.col(c).cast("timestamp") if c else F.lit(None).cast("timestamp")
    return (
        parent.select(norm_key(p.key).alias("ref_value"), when(p.created).alias("c"), when(p.deleted).alias("d"))
        .where(F.col("ref_value") != "")
        .groupBy("ref_value")
        .agg(F.min("c").alias("created"), F.when(F.count("d") == F.count(F.lit(1)), F.max("d")).alias("deleted"))
    )


def direct_orphans(child: DataFrame, parent: DataFrame, fk: ForeignKey) -> DataFrame:
    """(table_name, record_id, ref_value, reason, at): the references of one table without a target.

    One left join on the reference, the parent reduced to a row per key first.  A key that holds a
    large part of the child rows is split by the adaptive skew join, as the parent side is one row.
    """
    hit = targets(parent, fk.parent).withColumn("known", F.lit(True))
    reason = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("deleted") <= F.col("at"), "deleted")
        .when(F.col("created") > F.col("at"), "later")
    )
    return (
        references(child, fk)
        .join(hit, "ref_value", "left")
        .select(F.lit(fk.child).alias("table_name"), "record_id", "ref_value", reason.alias("reason"), "at")
        .where(F.col("reason").isNotNull())
    )


def cascade(tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey]) -> DataFrame:
    """The fixpoint: (table_name, record_id, ref_value, reason, kind, depth, at).

    Direct orphans have depth 0.  A record whose target is itself an orphan is ``inherited``, with
    reason ``orphaned target``; semi-joins go down the foreign-key graph from what the last round
    added until a round adds nothing; it ends for cycles too, since each record is entered in one round
    only.  The rows of each round are written to the shared folder, so
    the plan does not grow with the depth.  Where no table is both parent and child, there is nothing to
    inherit and no round.
    """
    done = None
    for fk in keys:
        part = direct_orphans(tables[fk.child], tables[fk.parent.name], fk)
        done = part if done is None else done.unionByName(part)
    done = done.distinct().withColumns({"kind": F.lit("direct"), "depth": F.lit(0)})
    parents = {fk.parent.name for fk in keys}
    down = [fk for fk in keys if fk.parent.name in {k.child for k in keys}]
    if not down:
        return done
    done = last = cut(done)
    for depth in count(1):
        new = None
        for fk in down:
            lost = last.where(F.col("table_name") == fk.parent.name).select(norm_key("record_id").alias("ref_value")).distinct()
            part = references(tables[fk.child], fk).join(lost, "ref_value", "left_semi").select(F.lit(fk.child).alias("table_name"), "record_id", "ref_value", F.lit("orphaned target").alias("reason"), "at")
            new = part if new is None else new.unionByName(part)
        known = done.select("table_name", "record_id").distinct()
        new = cut(new.distinct().join(known, ["table_name", "record_id"], "left_anti").withColumns({"kind": F.lit("inherited"), "depth": F.lit(depth)}))
        if new.where(F.col("table_name").isin(*parents)).isEmpty():
            done = done.unionByName(new)
            break
        done, last = done.unionByName(new), new
    return done


def found(tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey]) -> DataFrame:
    """The direct orphans of the cascade, each once: (table_name, record_id, ref_value, reason)."""
    return cascade(tables, keys).where("kind = 'direct'").select("table_name", "record_id", "ref_value", "reason").distinct()


def report(orphans: DataFrame) -> DataFrame:
    """Counts per table, month of the record's own time, kind and reason; a null time is month ''."""
    return orphans.groupBy("table_name", F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("")).alias("period"), "kind", "reason").agg(
        F.count_distinct("record_id", "ref_value").alias("n_refs"), F.count_distinct("record_id").alias("n_records")
    )
