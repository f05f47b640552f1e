"""Copies that differ in formatting only, by bottom-up hashing of nested records (problem 5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crowdsignal.functions.text import letters_and_digits
from crowdsignal.operators.skew import join_per_key
from crowdsignal.session import staged

NESTED = (T.StructType, T.ArrayType, T.MapType)
#: Sets that share a digest with other records are dealt to so many tasks each.
SALTS = 32


def _combined(children: Column, ordered: bool) -> Column:
    """The node of an array of child nodes (digest, size, form): its digest is over the children's digests, sorted unless ``ordered``.

    The form, which only confirms, holds each child's with its length, so that different trees never give one form.
    """
    nodes = children if ordered else F.array_sort(children)
    return F.struct(
        F.md5(F.array_join(F.transform(nodes, lambda x: x["digest"]), "")).alias("digest"),
        F.aggregate(nodes, F.lit(0), lambda total, x: total + x["size"]).alias("size"),
        F.array_join(F.transform(nodes, lambda x: F.concat(F.length(x["form"]).cast("string"), F.lit(":"), x["form"])), "").alias("form"),
    )


def merkle_node(value: Column, kind: T.DataType, ordered: bool = False) -> Column:
    """(digest, size, form) of a value from its leaves up.

    A leaf is its letters and digits in lower case (null: none), its size their number. Children of an unordered node are sorted by
    digest; of a map's entries, key and value keep their order. A null node counts as one without children, or of null fields.
    """
    if isinstance(kind, T.StructType):
        return _combined(F.array(*(merkle_node(value[f.name], f.dataType, ordered) for f in kind.fields)), ordered)
    if isinstance(kind, T.ArrayType):
        return _combined(F.transform(F.coalesce(value, F.array().cast(kind)), lambda x: merkle_node(x, kind.elementType, ordered)), ordered)
    if isinstance(kind, T.MapType):
        entry = lambda x: _combined(F.array(merkle_node(x["key"], kind.keyType, ordered), merkle_node(x["value"], kind.valueType, ordered)), True)
        return _combined(F.transform(F.map_entries(F.coalesce(value, F.create_map().cast(kind))), entry), False)
    leaf = letters_and_digits(value.cast("string"))
    return F.struct(F.md5(leaf).alias("digest"), F.length(leaf).alias("size"), leaf.alias("form"))


def _normalised(raw: DataFrame, kinds: Sequence[T.DataType], ordered: bool, keep: Sequence[str] = ()) -> tuple[DataFrame, list[tuple[Column, Column, Column]]]:
    """Of (id, *keep, v0, v1, ...): id, the kept columns and one column per field, a leaf's text or a nested field's node; and the
    (digest, size, form) of each field.

    Leaves are columns of their own, so that each text is normalised once.
    """
    nested = [isinstance(kind, NESTED) for kind in kinds]
    columns = [merkle_node(F.col(f"v{k}"), kind, ordered) if deep else letters_and_digits(F.col(f"v{k}").cast("string")) for k, (kind, deep) in enumerate(zip(kinds, nested, strict=True))]
    named = [F.col(f"f{k}") for k in range(len(kinds))]
    nodes = [(x["digest"], x["size"], x["form"]) if deep else (F.md5(x), F.length(x), x) for x, deep in zip(named, nested, strict=True)]
    return raw.select("id", *keep, *(c.alias(f"f{k}") for k, c in enumerate(columns))), nodes


def copies(records: DataFrame, id_: str, fields: Sequence[str], least: int = 20, ordered: bool = False) -> DataFrame:
    """(keep_id, id): each id of a set of copies except the smallest, which is its keep_id.

    Records are copies if their fields agree as an unordered (or, on request, ordered) collection of normalised leaves,
    with ``least`` letters and digits in all. Rows of one id count as one record; rows without an id are left out. Empty
    tables and records of nothing but signs give no copies.

    Two passes. The first digests every record from the leaves up, children sorted by their digests, and groups by root digest, in
    which a set of copies shrinks to one row per task; what it writes is an id and sixteen bytes. The second compares the full forms of
    records whose digest occurs twice: the least and the greatest form of a digest are the same unless it is shared
    by different records, and such digests are grouped again by the form itself, if there are any. Sets that hold a large part
    of all rows are joined by broadcast (see ``join_per_key``).
    """
    kinds = [records.schema[c].dataType for c in fields]
    raw = records.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), *(F.col(c).alias(f"v{k}") for k, c in enumerate(fields)))
    source, nodes = _normalised(raw, kinds, ordered)
    digests = F.array(*(d for d, _, _ in nodes))
    root = F.unhex(F.md5(F.array_join(digests if ordered else F.array_sort(digests), "")))
    size = sum((s for _, s, _ in nodes), F.lit(0))
    # that a record is too short is asked of the written table: Spark would push the question below, and normalise every text twice
    hashed = staged(source.select("id", F.when(size >= least, root).alias("digest")), "digests").where("digest IS NOT NULL")
    sets = hashed.groupBy("digest").agg(F.min("id").alias("keep_id"), F.max("id").alias("_max"), F.count(F.lit(1)).alias("_size"))
    shared = staged(join_per_key(hashed, sets.where("keep_id <> _max").drop("_max"), ["digest"], "_size").distinct(), "shared")
    forms = F.array(*(F.struct(d.alias("digest"), f.alias("form")) for d, _, f in nodes))
    form = F.array_join(F.transform(forms if ordered else F.array_sort(forms), lambda x: F.concat(F.length(x["form"]).cast("string"), F.lit(":"), x["form"])), "")
    again, _ = _normalised(raw.join(shared.select("id", "digest"), "id"), kinds, ordered, ["digest"])
    members = again.select("id", "digest", form.alias("form"))
    split = staged(members.groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("greatest")).where("least <> greatest").select("digest"), "split")
    if split.isEmpty():
        return shared.where("id <> keep_id").select("keep_id", "id")
    same = shared.join(split, "digest", "left_anti").select("keep_id", "id")
    by_form = members.join(split, "digest", "left_semi").select("form", "id").distinct()
    kept = by_form.groupBy("form").agg(F.min("id").alias("keep_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parted = by_form.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(kept, ["form", "salt"])
    return same.unionByName(parted.select("keep_id", "id")).where("id <> keep_id")


def collapsed(records: DataFrame, id_: str, fields: Sequence[str], least: int = 20, ordered: bool = False) -> DataFrame:
    """(keep_id, n_copies) of each set of copies, the kept record counted."""
    return copies(records, id_, fields, least, ordered).groupBy("keep_id").agg((F.count(F.lit(1)) + 1).alias("n_copies"))
