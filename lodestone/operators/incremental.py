"""Cache keys, fingerprints, and upkeep of tables by differences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys; nulls stand as null."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def key(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical(fields), 256)


def stable_params(params: Column) -> Column:
    """A map without private keys and nonces, as sorted entries."""
    return F.array_sort(F.map_entries(F.map_filter(params, lambda k, v: ~k.startswith("_") & (k != "client_nonce"))))


def hash_sums(digest: Column) -> list[Column]:
    """Sums of a hex SHA-256 in four lanes of 64 bits: a fingerprint of a bag of hashes that any number of tasks can add up in any order."""
    return [F.sum(F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)]


def summed() -> Column:
    """The hash of the number of entries and of their hash_sums."""
    return F.sha2(F.concat_ws("|", "entries", *(F.col(f"s{i}").cast("string") for i in range(4))), 256)


def fingerprint(rows: DataFrame, group: list[str], order: str, fields: list[str]) -> DataFrame:
    """A hash of the hashes of a group's rows, in order. A group's rows pass through a task in that order, which keeps a hash and no row.

    A row with a null field counts as an entry and has no hash; a group without any hash has no fingerprint.
    """
    row = F.sha2(reduce(lambda a, b: F.concat(a, F.lit("\x1f"), b), (F.col(f).cast("string") for f in fields)), 256)
    hashed = rows.select(*group, F.col(order).alias("_order"), row.alias("_hash")).repartition(*group).sortWithinPartitions(*group, "_order", "_hash")
    names = [*group, "entries", "fingerprint"]
    schema = T.StructType([*(rows.schema[g] for g in group), T.StructField("entries", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, now, state, entries, hashes = None, None, None, 0, 0

        def row_of() -> pa.RecordBatch:
            values = [*now, entries, state.hexdigest() if hashes else None]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            kinds = [*batch.schema.types[: len(group)], pa.int64(), pa.string()]
            keys = zip(*(batch.column(i).to_pylist() for i in range(len(group))))
            for key_, h in zip(keys, batch.column(len(group) + 1).to_pylist()):
                if state is None or key_ != now:
                    if state is not None:
                        yield row_of()
                    now, state, entries, hashes = key_, hashlib.sha256(), 0, 0
                entries += 1
                if h is not None:
                    state.update(h.encode())
                    hashes += 1
        if state is not None:
            yield row_of()

    return hashed.mapInArrow(folded, schema)


def diff(old: DataFrame, new: DataFrame, id_: str, signature: str) -> DataFrame:
    """added, changed, removed and same rows by id."""
    a, b = old.select(F.col(id_).alias("old_id"), F.col(signature).alias("old_signature")), new.select(F.col(id_).alias("new_id"), F.col(signature).alias("new_signature"))
    rows = a.join(b, F.col("old_id") == F.col("new_id"), "full_outer")
    change = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed").when(~F.col("old_signature").eqNullSafe(F.col("new_signature")), "changed").otherwise("same")
    return rows.select(F.coalesce("new_id", "old_id").alias(id_), change.alias("change"))


def apply(old: DataFrame, new: DataFrame, changes: DataFrame, id_: str) -> DataFrame:
    """old without what changed or went, and the new rows of what came or changed."""
    gone = changes.where("change IN ('changed', 'removed')").select(id_)
    come = changes.where("change IN ('added', 'changed')").select(id_)
    return old.join(gone, id_, "left_anti").unionByName(new.join(come, id_, "left_semi"))


def unchanged_writes(new: DataFrame, stored: DataFrame, path: str, content: str) -> DataFrame:
    """Only rows whose content differs from what is stored under their path."""
    digest = F.sha2(F.col(content), 256)
    return new.withColumn("_h", digest).join(stored.select(path, digest.alias("_h")), [path, "_h"], "left_anti").drop("_h")


def newest(entries: DataFrame, group: list[str], order: str, keep: int) -> DataFrame:
    """The entries of each group that a cache of keep entries holds."""
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(order)))).where(F.col("_n") <= keep).drop("_n")


def parent(path: Column) -> Column:
    """The directory of a path; "" is the root's name, and the root has none."""
    return F.when(path == "", F.lit(None).cast("string")).when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def tree_fingerprints(files: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """files (path, hex sha256) -> (path, level, entries, fingerprint) of every directory, the root's path being "".

    A directory's fingerprint is the hash of how many entries it has and of the sums of their hashes in four lanes of 64
    bits. Sums are combined before a shuffle and don't depend on order, so a directory of any size costs no group; a
    change of a file changes its directories up to the root and no other. It tells whether work is still valid; it is
    no proof against somebody who builds collisions of sums. A turn does one level of directories, from the deepest
    up; turns are as many as a path is deep.
    """
    from lodestone.sources.scratch import Scratch

    scratch = Scratch(files.sparkSession, "tree")
    depth = lambda p: F.when(p == "", 0).otherwise(F.size(F.split(p, "/")))
    entry = lambda name, h: F.sha2(F.concat_ws("\x00", F.substring_index(name, "/", -1), h), 256)
    leaf = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.coalesce(F.col(digest), F.lit("")).alias("h"))
    leaf = scratch.write(leaf.select(parent(F.col("path")).alias("directory"), entry(F.col("path"), F.col("h")).alias("e")), "leaves")
    deepest = leaf.agg(F.max(depth(F.col("directory")))).first()[0]
    out, below = [], None
    for level in range(-1 if deepest is None else deepest, -1, -1):
        rows = leaf.where(depth(F.col("directory")) == level)
        if below is not None:
            rows = rows.unionByName(below.select(parent(F.col("path")).alias("directory"), entry(F.col("path"), F.col("fingerprint")).alias("e")))
        sums = rows.groupBy("directory").agg(F.count(F.lit(1)).alias("entries"), *hash_sums(F.col("e")))
        below = scratch.write(sums.select(F.col("directory").alias("path"), F.lit(level).alias("level"), "entries", summed().alias("fingerprint")), f"level{level}")
        out.append(below)
    if not out:
        return files.sparkSession.createDataFrame([], "path string, level int, entries long, fingerprint string")
    return reduce(lambda a, b: a.unionByName(b), out)
