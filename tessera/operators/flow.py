"""Data-flow and syntax-subtree matching (CodeBLEU components) over edge tables.

Inputs are tables a parser emits: data-flow edges
``(item, side, ord, name, pos, rel, parents array<string>, parent_pos array<int>)``
(``ord`` is the order in which the parser emitted the edges of an item's side)
and syntax subtrees ``(item, side, subtree, depth)``; ``side`` is ``ref`` or
``cand``. ``subtrees`` makes the latter from a node table.
All steps are shuffles, windows and aggregates keyed by item, or run inside a
task on whole items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.operators.batches import dense, numbered, pieces, whole_items
from tessera.operators.batches import starts as _starts

K = ["item", "side"]


def dataflow_match(edges: DataFrame, partitions: int | None = None, together: bool = False) -> DataFrame:
    """Matched normalised reference edges (each candidate edge used once)
    over all reference edges; 0 when there are no reference edges.

    W11: edges of one position become one, with the parents of all and the name
    and relation of the last by ``ord``. W12: a position without parents that is
    nobody's parent goes. W8: variables become numbers by first appearance in
    edge order, parents before the edge's own name.

    Spark deals the edges by item and sorts each partition; a task then reads
    whole items, a batch at a time, as columns, and returns two sums per batch.
    ``together`` says that each item's edges lie one behind the other in one
    partition, as they do behind a parser that got its texts dealt by item; then
    no edge is moved or sorted by Spark. Only one item's edges have to be in
    memory together.
    """
    from tessera.operators.textmetrics import _parallelism
    e = edges.select("item", F.col("side") == "ref", "pos", "name", "rel", "parents", "parent_pos", "ord")
    e = e.toDF(*_EDGE, "ord")
    if not together:
        n = partitions or _parallelism(edges)
        e = e.repartition(n, F.xxhash64("item")).sortWithinPartitions("item", "ref", "pos", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_items(batches):
            matched, total = _match_batch(_in_order(whole))
            yield pa.RecordBatch.from_arrays([pa.array([matched]), pa.array([total])], names=["m", "t"])

    tot = e.mapInArrow(run, "m long, t long").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"),
                                                  F.coalesce(F.sum("t"), F.lit(0)).alias("t"))
    return tot.select(F.when(F.col("t") > 0, F.col("m") / F.col("t")).otherwise(F.lit(0.0)).alias("dataflow_match"),
                      F.col("m").alias("matched"), F.col("t").alias("total"))


_EDGE = ("item", "ref", "pos", "name", "rel", "parents", "parent_pos")


def _in_order(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The edges of whole items by item, side, position and order; mostly they come so."""
    item = np.cumsum(_starts(numbered(batch.column("item"))))
    side, pos, order = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ref", "pos", "ord"))
    rising = order[1:] >= order[:-1]
    for c in (pos, side, item):
        rising = (c[1:] > c[:-1]) | ((c[1:] == c[:-1]) & rising)
    return batch if rising.all() else batch.take(pa.array(np.lexsort((order, pos, side, item))))


def _codes(values: pa.Array) -> tuple[np.ndarray, int]:
    """Numbers of strings in their (UTF-8) order, -1 for null, and how many there are."""
    encoded = values.dictionary_encode()
    size = len(encoded.dictionary)
    rank = pc.rank(encoded.dictionary, tiebreaker="dense").to_numpy().astype(np.int64) - 1 if size else np.empty(0, np.int64)
    codes = encoded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(codes >= 0, rank[np.maximum(codes, 0)] if size else -1, -1), size


def _match_batch(batch: pa.RecordBatch) -> tuple[int, int]:
    """(matched, reference edges) of whole items, their edges sorted by side, position and order."""
    item = np.cumsum(_starts(batch.column("item").dictionary_encode().indices.to_numpy(zero_copy_only=False))) - 1
    ref = batch.column("ref").to_numpy(zero_copy_only=False)
    pos = batch.column("pos").to_numpy(zero_copy_only=False).astype(np.int64)
    parents, parent_pos = batch.column("parents"), batch.column("parent_pos")
    names, size = _codes(pa.concat_arrays([batch.column("name"), parents.flatten()]))
    name, parent = names[: len(pos)], names[len(pos) :]
    rel, n_rel = _codes(batch.column("rel"))
    n_parents = pc.fill_null(pc.list_value_length(parents), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    n_links = pc.fill_null(pc.list_value_length(parent_pos), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    side = 2 * item + ref  # one code tree
    # Rows of one position are an edge; its name and relation are the last row's.
    head = _starts(side, pos)
    edge = np.cumsum(head) - 1
    last = np.append(np.flatnonzero(head)[1:], len(pos)) - 1
    # An edge stays if it has parents or is one.
    low, width = int(pos.min(initial=0)), int(pos.max(initial=0) - pos.min(initial=0)) + 1
    to = pc.fill_null(parent_pos.flatten().cast(pa.int64()), low - 1).to_numpy(zero_copy_only=False) - low
    here = (to >= 0) & (to < width)
    links = np.repeat(side, n_links)[here] * width + to[here]
    linked = np.bincount(edge, n_links, len(last)) > 0
    linked |= np.isin(side[last] * width + pos[last] - low, links)
    linked &= name[last] >= 0
    # The distinct parents in order, then the edge's own name; numbers by first appearance on a side.
    size = max(size, 1)
    of = np.unique(np.repeat(edge, n_parents) * size + parent)
    of = of[linked[of // size]]
    own = np.flatnonzero(linked)
    owner = np.concatenate([of // size, own])
    code = np.concatenate([of % size, name[last[own]]])
    order = np.argsort(owner, kind="stable")  # a name comes behind its edge's parents
    owner, code = owner[order], code[order]
    tree = side[last[owner]]
    _, first, which = np.unique(tree * size + code, return_index=True, return_inverse=True)
    place = np.argsort(np.argsort(first))
    lowest = np.full(int(tree.max(initial=0)) + 1, len(first))
    np.minimum.at(lowest, tree[first], place)
    variable = place[which] - lowest[tree]
    # An edge's normal form, numbered: relation and length, then one variable after the other.
    count = np.bincount(owner, minlength=len(last))[own]
    begin = np.cumsum(count) - count
    form = (rel[last[own]] + 1) * (int(count.max(initial=0)) + 1) + count
    span = int(variable.max(initial=0)) + 2
    for k in range(int(count.max(initial=0))):
        has = count > k
        step = np.zeros(len(own), np.int64)
        step[has] = variable[begin[has] + k] + 1
        form = np.unique(form * span + step, return_inverse=True)[1]
    whose = item[last[own]] * (int(form.max(initial=0)) + 1) + form
    _, which = np.unique(whose, return_inverse=True)
    of_ref = ref[last[own]].astype(bool)
    r, c = (np.bincount(which[x], minlength=len(whose)) for x in (of_ref, ~of_ref))
    return int(np.minimum(r, c).sum()), int(r.sum())


# Fixed primes below 2**31, so that products of two remainders fit 64 bits; a base for each.
_MODULI = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 392_875_441))
_DIGIT_BITS = 10


def _power(base: int, exponent: Column, modulus: int) -> Column:
    """base ** exponent modulo a prime for exponents below 2**30: the product of three tabled powers."""
    out = None
    for k in range(3):
        step = pow(base, 1 << (_DIGIT_BITS * k), modulus)
        powers = ",".join(str(pow(step, d, modulus)) for d in range(1 << _DIGIT_BITS))
        table = F.split(F.lit(powers), ",").cast("array<bigint>")
        digit = F.shiftright(exponent, _DIGIT_BITS * k).bitwiseAND(F.lit((1 << _DIGIT_BITS) - 1)).cast("int")
        factor = F.get(table, digit)
        out = factor if out is None else (out * factor) % modulus
    return out


def subtrees(nodes: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(item, side, pos, depth, subtree)``: what hangs below every node, as a string that equal
    subtrees share.

    ``nodes`` is ``(item, side, pos, depth, label)`` in document order, ``pos``
    counting from 0 and ``depth`` growing by one at most from a node to the
    next. A subtree is the stretch of nodes from its root to the next node that
    is not deeper; labels and steps of depth inside it tell its nesting. Its
    digest is the difference of two prefix sums of ``hash(label, step) *
    base ** pos``, shifted back to its root, modulo two primes; with it go the
    root's label and the number of nodes. Everything is windows over an item's
    own nodes after one shuffle, and the work is linear in the nodes at any depth.
    """
    from tessera.operators.textmetrics import _parallelism
    e = nodes.repartition(partitions or _parallelism(nodes), "item")
    in_order = Window.partitionBy(*K).orderBy("pos")
    e = e.withColumn("_last", F.coalesce(F.lag("depth").over(in_order), F.col("depth")))
    pos = F.col("pos").cast("long")
    step = F.xxhash64("label", F.col("depth") - F.col("_last"))
    e = e.withColumns({f"_t{m}": (F.pmod(step, F.lit(m)) * _power(x, pos, m)) % m for m, x in _MODULI}
                      | {f"_i{m}": _power(pow(x, -1, m), pos, m) for m, x in _MODULI})
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumns({f"_p{m}": F.sum(f"_t{m}").over(upto) for m, _ in _MODULI} | {"_n": F.row_number().over(in_order)})
    # A node ends the subtrees of all levels from its own down to the one before it.
    ends = e.select("*", F.explode(F.sequence("depth", F.greatest("depth", "_last"))).alias("_level"))
    level = Window.partitionBy(*K, "_level").orderBy("pos")
    whole = Window.partitionBy(*K)

    def at_end(column, before):
        return F.coalesce(F.lead(before).over(level), F.max(column).over(whole))

    ends = ends.withColumns({f"_e{m}": at_end(F.col(f"_p{m}"), F.col(f"_p{m}") - F.col(f"_t{m}")) for m, _ in _MODULI})
    digests = [(((F.col(f"_e{m}") - F.col(f"_p{m}")) % m) * F.col(f"_i{m}")) % m for m, _ in _MODULI]
    ends = ends.withColumn("_size", at_end(F.col("_n"), F.col("_n") - 1) - F.col("_n") + 1)
    own = ends.filter(F.col("_level") == F.col("depth"))
    return own.select(*K, "pos", "depth", F.concat_ws(":", "label", F.col("_size").cast("string"),
                                                      *[d.cast("string") for d in digests]).alias("subtree"))


def syntax_match(subtrees: DataFrame) -> DataFrame:
    """Reference subtrees found anywhere among the item's candidate
    subtrees (no consumption), over all reference subtrees."""
    of_ref, of_cand = F.col("side") == "ref", F.col("side") == "cand"
    met = subtrees.groupBy("item", "subtree").agg(F.count_if(of_ref).alias("r"), F.bool_or(of_cand).alias("hit"))
    tot = met.agg(F.coalesce(F.sum(F.when(F.col("hit"), F.col("r")).otherwise(0)), F.lit(0)).alias("m"),
                  F.coalesce(F.sum("r"), F.lit(0)).alias("t"))
    return tot.select(F.try_divide(F.col("m"), F.col("t")).alias("syntax_match"),
                      F.col("m").cast("long").alias("matched"), F.col("t").cast("long").alias("total"))


def reaching_definitions(tokens: DataFrame, together: bool = False) -> DataFrame:
    """Each use links to the latest earlier definition of the same name.
    Input ``(item, side, pos, name, is_def)``; adds ``def_pos`` (NULL if none).

    ``together`` says that each item's tokens lie one behind the other in one
    partition, as they do behind a tokeniser that got its texts dealt by item;
    then a task links whole items, some at a time, and no token is moved.
    """
    if not together:
        w = Window.partitionBy(*K, "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        return tokens.withColumn("def_pos", F.last(F.when(F.col("is_def"), F.col("pos")), ignorenulls=True).over(w))
    most = TOKENS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_items(batches):
            for some in pieces(whole, np.ones(whole.num_rows, np.int64), most):
                yield pa.RecordBatch.from_arrays([*some.columns, _definitions(some)], names=[*some.schema.names, "def_pos"])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField("def_pos", tokens.schema["pos"].dataType)]))


TOKENS_AT_ONCE = 1 << 18  # a task links about as many tokens together


def _definitions(batch: pa.RecordBatch) -> pa.Array:
    """For every token the latest definition of its name before it, on its side of its item."""
    group = numbered(batch.column("item"))
    for c in ("side", "name"):
        code = numbered(batch.column(c))
        group = dense(group * (int(code.max(initial=0)) + 1) + code)[0]
    known = pc.is_valid(batch.column("pos")).to_numpy(zero_copy_only=False)
    pos = pc.fill_null(batch.column("pos"), 0).to_numpy(zero_copy_only=False)
    is_def = pc.fill_null(batch.column("is_def"), False).to_numpy(zero_copy_only=False) & known
    order = np.lexsort((pos, known, group))  # null positions first
    at = np.arange(len(order))
    last = np.maximum.accumulate(np.where(is_def[order], at, -1))
    last = np.concatenate([[-1], last[:-1]])  # of the tokens before
    begin = np.maximum.accumulate(np.where(_starts(group[order]), at, 0))
    found = np.empty(len(order), np.int64)
    found[order] = np.where(last >= begin, order[last], -1)
    return pa.array(pos[found], type=batch.column("pos").type, mask=found < 0)


def tag_tokens(html: Column) -> Column:
    """Open/close tag tokens of a page, e.g. ``<p``, ``</p``."""
    return F.regexp_extract_all(html, F.lit("</?[a-z0-9]+"), 0)


# One token per comment, string literal, or run of other text. Possessive runs and the
# lazy comment body are matched in a loop, so long comments and literals need no stack.
COMMENT_LEX = (r"""(?s)//[^\n]*+|/\*.*?\*/|"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"""
               r"""|[^/"']++|.""")


def comment_strip(code: Column) -> Column:
    """C-family comments become one space; string and char literals are
    left alone; blank lines are dropped; an unterminated comment is kept."""
    lex = COMMENT_LEX
    parts = F.regexp_extract_all(code, F.lit(lex), 0)
    kept = F.transform(parts, lambda p: F.when(p.startswith("//") | (p.startswith("/*") & p.endswith("*/")
                                                                      & (F.length(p) >= 4)), F.lit(" ")).otherwise(p))
    lines = F.split(F.array_join(kept, ""), "\n")
    return F.array_join(F.filter(lines, lambda ln: F.length(F.regexp_replace(ln, r"\s", "")) > 0), "\n")


def block_comment_strip(code: Column) -> Column:
    """remove ``/*`` or ``/**`` comments followed by whitespace."""
    return F.regexp_replace(code, r"(?s)/\*\*?\s.*?\*/", "")
