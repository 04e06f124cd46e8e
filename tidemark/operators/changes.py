"""Applying a stream of inserts, updates and deletes by composing patches.

Every operation on a key is a function from that key's old row to its new one. A put is constant
(the new row), a delete is constant (no row), an update replaces the columns it sets and leaves the
rest. A run of such functions composes to one *patch*, and composition is associative, so runs can be
composed in any grouping:

    put_at      greatest order of a put in the run
    delete_at   greatest order of a delete in the run
    value_c     column c of the newest put
    update_at_c, update_c   newest update that sets column c

Composing two patches takes the part with the greater order, field by field; a patch therefore also
absorbs repeated and out-of-order operations. Applied to a base row, the row is there afterwards when
the newest put is no older than the newest delete (or when there is neither and the base has the row),
and column c is ``update_c`` where that update is newer than the row it changes.

The composition is a tree: Spark composes within each map task, then by (key, range of orders), so that
even one key's operations are spread over many tasks, then by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT_AT, DELETE_AT, CHUNK = "_put_at", "_delete_at", "_chunk"


def _newest(value: Column, at: Column) -> Column:
    """``value`` at the greatest ``at``; among equal orders the greatest value, nulls least."""
    return F.max_by(value, F.when(at.isNotNull(), F.struct(at, value)))


def compose_again(patches: DataFrame, by: list, values: Sequence[str], updates: bool) -> DataFrame:
    """Patches of the groups ``by``, composed of theirs."""
    aggregates = [F.max(PUT_AT).alias(PUT_AT), F.max(DELETE_AT).alias(DELETE_AT)]
    for c in values:
        aggregates.append(_newest(F.col(f"_value_{c}"), F.col(PUT_AT)).alias(f"_value_{c}"))
        if updates:
            at = F.col(f"_update_at_{c}")
            aggregates.append(_newest(F.col(f"_update_{c}"), at).alias(f"_update_{c}"))
            aggregates.append(F.max(at).alias(f"_update_at_{c}"))
    return patches.groupBy(*by).agg(*aggregates)


def compose_patches(
    changes: DataFrame,
    *,
    key: str = "user_key",
    order: str = "seq",
    op: str = "op",
    values: Sequence[str] = ("value",),
    put: int = 1,
    delete: int = 0,
    update: int | None = None,
    range_bits: int = 16,
) -> DataFrame:
    """One patch per key. Rows without key or order, or with an unknown operation, are no changes.

    ``range_bits``: orders with equal leading bits (all but so many) form one range chunk. The chunk
    level bounds what any task composes for one key to 2**range_bits orders before the last level,
    which itself composes within map tasks first.

    ``update`` names the code of partial updates, which set the columns that are not null in them;
    None (the default) means that the feed has none. Columns are addressed by name through a
    projection first, so extra columns of any name, even ``_chunk``, do no harm.
    """
    known = [put, delete] if update is None else [put, delete, update]
    at, code = F.col(order).cast("long"), F.col(op)
    columns = [
        F.col(key).alias("_key"),
        F.shiftright(at, range_bits).alias(CHUNK),
        F.when(code == put, at).alias(PUT_AT),
        F.when(code == delete, at).alias(DELETE_AT),
    ]
    for c in values:
        columns.append(F.when(code == put, F.col(c)).alias(f"_value_{c}"))
        if update is not None:
            columns.append(F.when(code == update, F.col(c)).alias(f"_update_{c}"))
            columns.append(F.when((code == update) & F.col(c).isNotNull(), at).alias(f"_update_at_{c}"))
    valid = F.col(key).isNotNull() & F.col(order).isNotNull() & code.isin(known)
    patches = changes.where(valid).select(*columns)
    for by in (["_key", CHUNK], ["_key"]):
        patches = compose_again(patches, by, values, update is not None)
    return patches


def apply_patches(
    patches: DataFrame,
    *,
    key: str = "user_key",
    order: str = "seq",
    values: Sequence[str] = ("value",),
    base: DataFrame | None = None,
) -> DataFrame:
    """The rows alive after the patches: key, order of the put that made the row, and its columns.

    ``base`` holds the rows before the first change (key, order, values, one row a key). Its orders
    take part in the comparison, so a change that the base already has is absorbed.
    """
    updates = {c for c in values if f"_update_{c}" in patches.columns}
    if base is not None:
        old = base.where(F.col(key).isNotNull()).select(
            F.col(key).alias("_base_key"), F.col(order).cast("long").alias("_base_at"), *[F.col(c).alias(f"_base_{c}") for c in values]
        )
        patches = patches.join(old, F.col("_key") == F.col("_base_key"), "full_outer")
        newer = F.col("_base_at").isNotNull() & (F.col(PUT_AT).isNull() | (F.col("_base_at") > F.col(PUT_AT)))
        merged = [
            F.coalesce("_key", "_base_key").alias("_key"),
            F.when(newer, F.col("_base_at")).otherwise(F.col(PUT_AT)).alias(PUT_AT),
            F.col(DELETE_AT),
        ]
        for c in values:
            merged.append(F.when(newer, F.col(f"_base_{c}")).otherwise(F.col(f"_value_{c}")).alias(f"_value_{c}"))
            if c in updates:
                merged += [F.col(f"_update_{c}"), F.col(f"_update_at_{c}")]
        patches = patches.select(*merged)
    alive = F.col(PUT_AT).isNotNull() & (F.col(DELETE_AT).isNull() | (F.col(PUT_AT) >= F.col(DELETE_AT)))
    out = [F.col("_key").alias(key), F.col(PUT_AT).alias(order)]
    for c in values:
        value = F.col(f"_value_{c}")
        if c in updates:
            value = F.when(F.col(f"_update_at_{c}") > F.col(PUT_AT), F.col(f"_update_{c}")).otherwise(value)
        out.append(value.alias(c))
    return patches.where(alive).select(*out)


def current_state(changes: DataFrame, *, base: DataFrame | None = None, key: str = "user_key", order: str = "seq", op: str = "op", values: Sequence[str] = ("value",), **options) -> DataFrame:
    """Each live key once, with the order and values of its newest put.

    Nulls: a change without key, order or known operation is ignored; null values are values. Empty
    key: a key. Ties: equal orders with different operations resolve to the put, with different values
    to the greater value. Repeated rows: absorbed. Empty feed: the base, or no rows.
    """
    patches = compose_patches(changes, key=key, order=order, op=op, values=values, **options)
    return apply_patches(patches, key=key, order=order, values=values, base=base)
