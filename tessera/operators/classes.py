"""Class/method tables: signatures, sibling lists, overlap checks, dedup, inventory.

Inputs are the flat member table (one row per method, ``class_id`` key) that a
parser emits. Per-class windows and ``collect_list`` run over one class
(bounded by the class's size); everything across classes is a partial
aggregate or a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _listed(prefix: str, items: Column | None, separator: str = ", ", suffix: str = "") -> Column:
    """``prefix``, the items and ``suffix``; nothing without items."""
    if items is None:
        return F.lit("")
    text = F.concat(F.lit(prefix), F.array_join(items, separator), F.lit(suffix))
    return F.when(F.size(items) > 0, text).otherwise(F.lit(""))


def _head(modifiers: Column, annotations: Column | None = None) -> Column:
    """Annotations, one a line, then the modifiers."""
    return F.concat(_listed("", annotations, "\n", "\n"), _listed("", modifiers, " ", " "))


def signature(modifiers: Column, return_type: Column, name: Column, params: Column,
              annotations: Column | None = None, throws: Column | None = None) -> Column:
    """F28, method: ``<modifiers> <return or void> <name>(<params>)throws <types>;``."""
    return F.concat(_head(modifiers, annotations), F.coalesce(return_type, F.lit("void")), F.lit(" "), name, F.lit("("),
                    F.array_join(params, ", "), F.lit(")"), _listed("throws ", throws), F.lit(";"))


def constructor_signature(modifiers: Column, name: Column, params: Column,
                          annotations: Column | None = None) -> Column:
    """F28, constructor: ``<modifiers> <name>(<params>);``."""
    return F.concat(_head(modifiers, annotations), name, F.lit("("), F.array_join(params, ", "), F.lit(");"))


def field_signature(modifiers: Column, type_: Column, names: Column, annotations: Column | None = None) -> Column:
    """F28, field: ``<modifiers> <type> <names>;``."""
    return F.concat(_head(modifiers, annotations), type_, F.lit(" "), F.array_join(names, ", "), F.lit(";"))


def enum_signature(modifiers: Column, name: Column, constants: Column) -> Column:
    """F28, enum: ``<modifiers> enum <name>{<constants>}``."""
    return F.concat(_head(modifiers), F.lit("enum "), name, F.lit("{"), F.array_join(constants, ", "), F.lit("}"))


def class_signature(modifiers: Column, name: Column, extends: Column, implements: Column, members: Column) -> Column:
    """F28, class: the header line, then its members' signatures, each indented by four and without line breaks."""
    base = F.coalesce(F.concat(F.lit(" extends "), extends), F.lit(""))
    body = F.array_join(F.transform(members, lambda m: F.concat(F.lit("    "), m)), "")
    return F.concat(_head(modifiers), F.lit("class "), name, base, _listed(" implements ", implements),
                    F.lit(" {\n"), body, F.lit("}"))


def array_type(name: Column, dimensions: Column | int) -> Column:
    """F28, type name with its array brackets."""
    return F.concat(name, F.repeat(F.lit("[]"), dimensions))


def with_siblings(members: DataFrame, cls: str, sig: str, order: str) -> DataFrame:
    """Each method gets the signatures of the other methods of its class
    (in ``order``), itself excluded."""
    w = Window.partitionBy(cls)
    allsigs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(sig).alias("s"))).over(w))
    me = F.col(order)
    return members.withColumn("siblings", F.transform(
        F.filter(allsigs, lambda x: x["o"] != me), lambda x: x["s"]))


def with_fields(members: DataFrame, fields: DataFrame | None, cls: str, declaration: str, order: str,
                name: str = "fields") -> DataFrame:
    """each row gets its class's field declarations (in ``order``), an empty list without any.

    Without ``fields`` the members' own rows hold the declarations (null: none),
    and no second frame is made and joined.
    """
    if fields is None:
        own = F.when(F.col(declaration).isNotNull(), F.struct(F.col(order).alias("o"), F.col(declaration).alias("d")))
        listed = F.sort_array(F.collect_list(own).over(Window.partitionBy(cls)))
        return members.withColumn(name, F.when(F.col(cls).isNull(), F.array().cast("array<string>")).otherwise(
            F.transform(listed, lambda x: x["d"])))
    listed = fields.groupBy(cls).agg(F.sort_array(F.collect_list(
        F.struct(F.col(order).alias("o"), F.col(declaration).alias("d")))).alias("_f"))
    names = F.transform("_f", lambda x: x["d"])
    return members.join(listed, cls, "left").withColumn(
        name, F.coalesce(names, F.array().cast("array<string>"))).drop("_f")


def assemble_source(class_name: Column, body: Column, siblings: Column, fields: Column) -> Column:
    """``Class { body  sibling signatures  fields }`` (normalise with F1)."""
    return F.concat(class_name, F.lit(" { "), body, F.lit("  "), F.array_join(siblings, "  "),
                    F.lit("  "), F.array_join(fields, "  "), F.lit(" }"))


def overlaps(members: DataFrame, cls: str, start: str, end: str) -> DataFrame:
    """A method overlaps when it starts before the previous one (by start)
    ends; touching spans are fine."""
    w = Window.partitionBy(cls).orderBy(start)
    return members.withColumn("overlap", F.coalesce(F.col(start) < F.lag(end).over(w), F.lit(False)))


def row_ids(members: DataFrame, cls: str, order: Sequence[str]) -> DataFrame:
    """0-based id per class in the given order."""
    w = Window.partitionBy(cls).orderBy(*order)
    return members.withColumn("id", (F.row_number().over(w) - 1).cast("long"))


def dedup_keep_last(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key: the last row's values, at the position of the first."""
    k = F.to_json(F.struct(*[F.col(c) for c in key]))
    rest = [c for c in df.columns if c not in key and c != order]
    g = df.groupBy(k.alias("_key")).agg(
        F.min(order).alias("first_pos"),
        F.max_by(F.struct(*[F.col(c) for c in list(key) + rest]), F.col(order)).alias("_last"))
    return g.select("first_pos", "_last.*")


# Line ends as Python's ``str.splitlines`` has them.
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def file_lines(text: Column) -> Column:
    """Lines of a text: every line end closes one, and what follows the last is one more if it is not empty."""
    open_end = (F.length(text) > 0) & ~text.rlike(f"(?:{LINE_END})\\z")
    return F.regexp_count(text, F.lit(LINE_END)) + open_end.cast("int")


def inventory(members: DataFrame, files: DataFrame, project: str, cls: str, modifiers: str,
              path: str = "path", text: str = "text") -> DataFrame:
    """Classes, public methods and lines of the classes' files per project.

    Lines are counted once per file, where the text is; only the counts travel
    to the classes, each of which adds the lines of its file (a class without
    one adds none).
    """
    lines = files.select(path, file_lines(F.col(text)).cast("long").alias("_lines")).groupBy(path).agg(
        F.max("_lines").alias("_lines"))
    classes = members.groupBy(project, cls).agg(F.min(path).alias(path), F.count_if(
        F.array_contains(modifiers, "public")).alias("_public"))
    return classes.join(lines, path, "left").groupBy(project).agg(
        F.count(F.lit(1)).alias("classes"), F.sum("_public").alias("public_methods"),
        F.coalesce(F.sum("_lines"), F.lit(0)).alias("lines"))


def invocations(calls: DataFrame, keys: Sequence[str], call: str) -> DataFrame:
    """distinct called names per method, sorted."""
    return calls.groupBy(*keys).agg(F.array_sort(F.collect_set(call)).alias("invocations"))


def class_info(members: DataFrame, cls: str, start: str) -> DataFrame:
    """One record per class with its methods sorted by start."""
    cols = [c for c in members.columns if c != cls]
    return members.groupBy(cls).agg(F.array_sort(F.collect_list(
        F.struct(F.col(start).alias("_s"), *[F.col(c) for c in cols]))).alias("methods"))
