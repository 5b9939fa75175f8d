"""Bindings V1-V10: the operators' native inputs derived from the driver tables.

Each binding is a pure function ``(spark, sf_dir) -> DataFrame`` so that the
registered queries read the whole tables and their work grows with them.
The DuckDB twins live in ``tessera.plans.sqlbind`` and must stay in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import ASCII_WS, tokens
from tessera.operators.curate import CurationParams
from tessera.session import table

# Parameters for V1 at the driver's scale (the reference's own values are the
# ``CurationParams`` defaults: prefix "@Test public void test", ``(`` ``)``
# ``{`` at +2, repos kept at 50..200).
V1_PARAMS = CurationParams(prefix="", open_=",", close=".", follow=" ", offset=1,
                           token_pattern=ASCII_WS, lower=12, upper=18, cap=18)


def ws_tokens(col: Column | str) -> Column:
    return tokens(col, ASCII_WS)


def v1_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated pairs: the whole document is the source, its lead paragraph the target.

    A repo is one source's share of a thousand ids, so repos grow in number with
    the table and keep their size.
    """
    d = table(spark, sf_dir, "documents")
    repo = F.concat(F.col("source"), F.lit("_"), F.floor(F.col("doc_id") / 1000).cast("string"))
    return d.select(
        F.col("doc_id").alias("id"),
        repo.alias("repo"),
        F.concat(repo, F.lit("/"),
                 F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".json")).alias("path"),
        # some sources are blank or missing, as in collected corpora
        F.when(F.col("doc_id") % 53 == 7, F.lit("")).when(F.col("doc_id") % 59 != 11, F.col("text")).alias("src"),
        F.element_at(F.split(F.col("text"), "\n"), 1).alias("target"),
    )


def v2_pairs(spark: SparkSession, sf_dir: str, second_ref: bool = False) -> DataFrame:
    """Gold/prediction pairs over whole documents.

    ``label`` is the text; ``predict`` by ``doc_id % 4``: 0 same, 1 first five
    tokens dropped, 2 the text of document ``doc_id - 1`` (empty if none),
    3 ``the`` -> ``of``. ``ref2``, only with ``second_ref``, is the text of
    document ``doc_id + 1`` (empty if none). Neighbours come from equi-joins, not
    from a global window, so nothing is funnelled through one task; the previous
    side holds only the documents that a row of remainder 2 asks for.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    prev = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("_prev")).filter("doc_id % 4 = 2")
    if not second_ref:  # only the rows that ask for a neighbour have to meet it: the other texts stay where they are
        asks = F.coalesce(F.col("doc_id") % 4 == 2, F.lit(False))
        j = d.filter(asks).join(prev, "doc_id", "left").unionByName(d.filter(~asks).withColumn("_prev", F.lit(None).cast("string")))
    else:
        j = d.join(prev, "doc_id", "left")
        nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("_next"))
        j = j.join(nxt, "doc_id", "left")
    toks = ws_tokens("text")
    pred = (F.when(F.col("doc_id") % 4 == 0, F.col("text"))
            .when(F.col("doc_id") % 4 == 1, F.array_join(F.slice(toks, 6, 2147483647), " "))
            .when(F.col("doc_id") % 4 == 2, F.coalesce(F.col("_prev"), F.lit("")))
            .otherwise(F.replace(F.col("text"), F.lit("the"), F.lit("of"))))
    return j.select(
        F.col("doc_id").alias("idx"),
        F.col("doc_id").alias("id"),
        F.concat(F.col("source"), F.lit("_"), (F.col("doc_id") % 7).cast("string")).alias("revision"),
        F.col("text").alias("label"),
        pred.alias("predict"),
        *([F.coalesce(F.col("_next"), F.lit("")).alias("ref2")] if second_ref else []),
    )


# The five evaluated projects (dimension of the per-project report).
PROJECTS = ("chart", "cli", "csv", "gson", "lang")

# event type -> run outcome used by V3
EVENT_RESULT = (("purchase", "CORRECT"), ("view", "PASS"), ("click", "TE"),
                ("signup", "CE"), ("error", "SE"))


def _project_of(user_id: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PROJECTS]), (user_id % 5 + 1).cast("int"))


def v3_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run results: one row per (model, item, method run).

    ``revision`` is ``<project>_<n>``; every 97th event has a revision without
    ``_`` and every 89th an unknown project, to exercise those rules.
    ``run`` is ``fixed`` for even event ids, ``buggy`` for odd ones. ``n`` counts
    stretches of 400 events, so revisions grow in number with the table.
    """
    e = table(spark, sf_dir, "events")
    bug = F.floor(F.col("event_id") / 400).cast("string")
    res = F.lit(None).cast("string")
    for et, r in reversed(EVENT_RESULT):
        res = F.when(F.col("event_type") == et, F.lit(r)).otherwise(res)
    rev = (F.when(F.col("event_id") % 97 == 0, F.lit("unknown"))
           .when(F.col("event_id") % 89 == 0, F.concat(F.lit("math_"), bug))
           .otherwise(F.concat(_project_of(F.col("user_id")), F.lit("_"), bug)))
    return e.select(
        F.col("event_id"), F.col("ts"),
        F.concat(F.lit("m"), (F.col("user_id") % 6).cast("string")).alias("model"),
        rev.alias("revision"),
        F.when(F.col("event_id") % 2 == 0, F.lit("fixed")).otherwise(F.lit("buggy")).alias("run"),
        res.alias("result"))


def v8_tool_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool output per run: exit code and stdout of the test run and of the coverage run, and the
    generated code."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object(F.col("props"), "$.k")
    return e.select(
        F.col("event_id"),
        F.when(F.col("event_type") == "signup", F.lit(1)).otherwise(F.lit(0)).alias("exit_code"),
        F.concat(F.lit("Running tests...\nFailing tests: "), (F.col("event_id") % 3).cast("string"),
                 F.lit("\n")).alias("stdout"),
        # the coverage run is a call of its own; one in eleven fails, one in thirteen prints no count
        F.when(F.col("event_id") % 11 == 3, F.lit(1)).otherwise(F.lit(0)).alias("coverage_exit"),
        F.when(F.col("event_id") % 13 == 6, F.lit("")).otherwise(
            F.concat(F.lit("Lines covered: "), F.coalesce(k, F.lit("0")), F.lit("\n"))).alias("coverage_stdout"),
        F.when(F.col("event_type") == "error", F.lit("class T { Syntax Error }"))
        .otherwise(F.lit("class T { void t() {} }")).alias("code"))


def v5_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training logs: twenty runs (``user_id % 20``) for each stretch of 10,000
    events, steps in time order, every 4th event an ``eval_loss`` point, the rest
    ``loss``."""
    e = table(spark, sf_dir, "events")
    run = F.col("user_id") % 20 + F.floor(F.col("event_id") / 10000) * 20
    w = Window.partitionBy(run).orderBy("ts", "event_id")
    return e.select(
        run.alias("run"), F.row_number().over(w).cast("long").alias("step"),
        F.when(F.col("event_id") % 4 == 0, F.lit("eval_loss")).otherwise(F.lit("loss")).alias("metric"),
        F.col("value"))


EOS_ID, PAD_ID = 2, 0


def v7_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id arrays: id = length*31 + code point of the first character."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.transform(ws_tokens("text"), lambda t: F.length(t) * 31 + F.ascii(t))
    x = d.select(F.col("doc_id").alias("idx"), ids.alias("ids"))
    n = F.size("ids")
    k = F.floor(n / 3).cast("int")
    return x.select(
        "idx", "ids",
        F.slice("ids", F.lit(1), k).alias("p1"),
        F.slice("ids", k + 1, k).alias("p2"),
        F.slice("ids", 2 * k + 1, n - 2 * k).alias("p3"),
        F.floor(F.col("idx") / 16).cast("long").alias("batch"),
        F.concat(F.array_repeat(F.lit(PAD_ID), (F.col("idx") % 3).cast("int")), F.col("ids")).alias("padded_pred"),
    )


def rotate(ids: Column, b: Column | int) -> Column:
    bb = F.lit(b) if isinstance(b, int) else b
    return F.concat(F.slice(ids, bb + 1, F.greatest(F.size(ids) - bb, F.lit(0))),
                    F.slice(ids, F.lit(1), F.least(bb, F.size(ids))))


def v7_beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beams 0-3 per sample (ids rotated by the beam number); the label is the
    rotation by ``idx % 5``, so it equals a beam unless ``idx % 5 = 4``."""
    a = v7_arrays(spark, sf_dir).select("idx", "ids")
    b = a.select("idx", "ids", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("beam"))
    return b.select(F.col("idx").alias("sample"), "beam",
                    rotate(F.col("ids"), F.col("beam")).alias("tokens"),
                    rotate(F.col("ids"), (F.col("idx") % 5).cast("int")).alias("label"))


def v8_chat_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant replies; wrapped in a java fence when ``conv_id % 3 <> 0``."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    wrapped = F.concat(F.lit("Here is the test:\n```java\n"), F.col("text"), F.lit("\n```\nDone."))
    return c.select("conv_id", "turn", F.when(F.col("conv_id") % 3 != 0, wrapped)
                    .otherwise(F.col("text")).alias("reply"))


def v2_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction rows for V2 keys: ``nothing`` for ``doc_id % 11 = 0``; a second,
    later row (``ord = 2``) for ``doc_id % 5 = 0``; list-shaped predictions
    (``items``) for ``doc_id % 6 = 5``."""
    v2 = v2_pairs(spark, sf_dir)
    first = v2.select("id", "revision", "label", F.lit(1).alias("ord"),
                      F.when(F.col("id") % 11 == 0, F.lit("nothing")).otherwise(F.col("predict")).alias("p"))
    second = v2.filter(F.col("id") % 5 == 0).select(
        "id", "revision", "label", F.lit(2).alias("ord"),
        F.concat(F.col("predict"), F.lit(" (retry)")).alias("p"))
    u = first.unionByName(second)
    is_list = F.col("id") % 6 == 5
    return u.select("id", "revision", "label", "ord",
                    F.when(~is_list, F.col("p")).alias("predict"),
                    F.when(is_list, F.split(F.col("p"), " ")).alias("items"))


def v6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class members: class = order, method n = line rank inside the order."""
    li = table(spark, sf_dir, "lineitem")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    # the window is over the name that the members keep, so later steps by class find them dealt
    w = Window.partitionBy("class_id").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    j = li.join(pt, li.l_partkey == pt.p_partkey).withColumn("class_id", F.col("l_orderkey"))
    n = F.row_number().over(w)
    mods = (F.when(F.col("l_returnflag") == "A", F.array(F.lit("public")))
            .when(F.col("l_returnflag") == "N", F.array(F.lit("public"), F.lit("static")))
            .otherwise(F.array(F.lit("private"))))
    x = j.select(
        "class_id",
        n.cast("long").alias("n"),
        F.col("l_quantity"), F.col("l_linenumber"),
        mods.alias("modifiers"),
        F.col("p_name").alias("body"),
        F.array(F.col("p_type")).alias("params"),
        F.when(F.col("l_linestatus") == "F", F.lit(None).cast("string")).otherwise(F.lit("int")).alias("return_type"),
        F.array(F.col("p_brand"), F.col("p_type"), F.lit("org.junit.Test")).alias("import_list"))
    return x.select(
        "class_id", "n", F.concat(F.lit("m"), F.col("n").cast("string")).alias("name"),
        (F.col("n") * 10).alias("start"),
        (F.col("n") * 10 + F.floor(F.col("l_quantity") / 4)).cast("long").alias("end"),
        "modifiers", "body", "params", "return_type", "import_list", "l_linenumber",
        F.concat(F.lit("proj"), (F.col("class_id") % 7).cast("string")).alias("project"),
        F.concat(F.lit("org.example.p"), (F.col("class_id") % 3).cast("string")).alias("package_info"))


def v6_files(members: DataFrame) -> DataFrame:
    """The files of the classes ``(path, text)``: their methods' bodies one after the other, with
    line ends of four kinds; every other file has a last line without one."""
    end = F.element_at(F.array(*[F.lit(x) for x in ("\n", "\r\n", "\r ", "\f")]), (F.col("n") % 4 + 1).cast("int"))
    lines = F.array_sort(F.collect_list(F.struct("class_id", "n", F.concat("body", end).alias("line"))))
    last = F.when(F.max("class_id") % 2 == 0, "}").otherwise("")
    return members.groupBy("path").agg(F.concat(F.array_join(lines["line"], ""), last).alias("text"))


def v10_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-flow edges over whole V2 texts: one edge per token position whose
    parent is the previous token; every third position is a definition. The
    texts are dealt and sorted by item before they become edges, so the edges of
    an item lie together."""
    from tessera.operators.batches import dealt
    from tessera.operators.textmetrics import _parallelism
    v2 = v2_pairs(spark, sf_dir).select("idx", "label", "predict")
    v2 = dealt(v2, "idx", _parallelism(v2))
    sides = v2.select(F.col("idx").alias("item"), F.inline(F.array(
        F.struct(F.lit("ref").alias("side"), ws_tokens("label").alias("t")),
        F.struct(F.lit("cand").alias("side"), ws_tokens("predict").alias("t")))))
    # pair each token with its predecessor inside the row, so the generator
    # does not copy the whole token array into every output row
    pairs = F.arrays_zip(F.col("t").alias("name"),
                         F.slice(F.concat(F.array(F.lit(None).cast("string")), F.col("t")),
                                 1, F.size("t")).alias("prev"))
    e = sides.select("item", "side", F.posexplode(pairs).alias("pos", "z")) \
        .select("item", "side", "pos", F.col("z.name").alias("name"), F.col("z.prev").alias("prev_tok"))
    prev = F.when(F.col("pos") > 0, F.array(F.col("prev_tok"))).otherwise(F.array().cast("array<string>"))
    ppos = F.when(F.col("pos") > 0, F.array(F.col("pos") - 1)).otherwise(F.array().cast("array<int>"))
    return e.select("item", "side", "name", F.col("pos").cast("int").alias("pos"),
                    F.when(F.col("pos") % 3 == 0, F.lit("computedFrom")).otherwise(F.lit("comesFrom")).alias("rel"),
                    prev.alias("parents"), ppos.alias("parent_pos"),
                    (F.col("pos") % 3 == 0).alias("is_def"))


def v10_repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V10 edges in parser order (``ord``); every fifth position has a second edge, with another
    relation and no parents, as branches of a program give."""
    e = v10_edges(spark, sf_dir).drop("is_def")
    one = F.struct((F.col("pos") * 2).alias("ord"), "rel", "parents", "parent_pos")
    two = F.struct((F.col("pos") * 2 + 1).alias("ord"), F.lit("mergedFrom").alias("rel"),
                   F.array().cast("array<string>").alias("parents"), F.array().cast("array<int>").alias("parent_pos"))
    both = F.when(F.col("pos") % 5 == 4, F.array(one, two)).otherwise(F.array(one))
    return e.select("item", "side", "name", "pos", F.inline(both))


def v9_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag trees of pages as nodes ``(item, side, pos, depth, label)``: one node for every opening
    tag, depth being the running open/close balance. The candidate side is the
    page with ``<b>`` rewritten as ``<strong>``."""
    from tessera.operators.flow import tag_tokens
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    sides = p.select(F.col("page_id").alias("item"), F.inline(F.array(
        F.struct(F.lit("ref").alias("side"), tag_tokens(F.col("html")).alias("tags")),
        F.struct(F.lit("cand").alias("side"), tag_tokens(
            F.regexp_replace(F.regexp_replace("html", "<b>", "<strong>"), "</b>", "</strong>")).alias("tags")))))
    # depth = running open/close balance over the page's tags (one page per window)
    ex = sides.select("item", "side", F.posexplode("tags").alias("at", "tag"))
    w = Window.partitionBy("item", "side").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    opens = ~F.col("tag").startswith("</")
    ex = ex.withColumn("depth", F.sum(F.when(opens, 1).otherwise(-1)).over(w))
    ex = ex.withColumn("pos", F.sum(F.when(opens, 1).otherwise(0)).over(w) - 1)
    return ex.filter(opens).select("item", "side", F.col("pos").cast("int").alias("pos"),
                                   F.col("depth").cast("int").alias("depth"), F.expr("substring(tag, 2)").alias("label"))


def v9_code_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code-like text per page: a line comment, block comments and a string literal holding ``//``
    (from the URL), then the page's whole html, once as it is and once inside a comment."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    host = F.regexp_extract("url", "//([^/]+)", 1)
    return p.select("page_id", F.concat(
        F.lit('u="'), F.col("url"), F.lit('"; // '), host, F.lit("\n/* ad */ y();\n\n/** doc */ z();\n"),
        F.col("html"), F.lit("\n/** "), F.col("html"), F.lit(" */\nend();\n")).alias("code"))


def v4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as ``source`` with the following turns as targets; the
    signature is the first five tokens of the source."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = c.select("conv_id", "turn", "role", "text",
                 F.lead("text", 1).over(w).alias("next1"), F.lead("text", 2).over(w).alias("next2"))
    u = x.filter(F.col("role") == "user")
    return u.select("conv_id", "turn", F.col("text").alias("source"), F.col("next1").alias("target"),
                    F.array_join(F.slice(ws_tokens("text"), 1, 5), " ").alias("signature"),
                    F.col("text").alias("focal_src"), F.col("next1").alias("focal_tgt"),
                    F.col("next2").alias("test_src"))


def v9_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source tree listing derived from pages: package ``org.site.<lang>``,
    class ``Page<id>``; the root folder rotates over four layouts and every
    tenth page contributes a ``package-info.java``."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    lang = F.regexp_extract("url", r"\.[a-z]+/([a-z]{2})/", 1)
    pkg = F.concat(F.lit("org.site."), F.when(lang == "", F.lit("xx")).otherwise(lang))
    root = F.element_at(F.array(*[F.lit(r) for r in ("src/main/java", "src/java", "source/org/jfree",
                                                       "src/test/java")]), (F.col("page_id") % 4 + 1).cast("int"))
    fname = F.when(F.col("page_id") % 10 == 0, F.lit("package-info.java")) \
        .otherwise(F.concat(F.lit("Page"), F.col("page_id").cast("string"), F.lit(".java")))
    return p.select("page_id", pkg.alias("package"), F.concat(F.lit("Page"), F.col("page_id").cast("string")).alias("class_name"),
                    F.concat(root, F.lit("/"), F.replace(pkg, F.lit("."), F.lit("/")), F.lit("/"), fname).alias("path"),
                    F.col("html").contains("<footer").alias("changed"))
