"""SQL text rebuilt from published facts: one row per scope, rounds from the innermost scope outwards.

A scope's text is put together from sorted arrays of its parts; a derived relation waits until its scope is
rendered, a set operation or CTE until its members are. What cannot be told for certain is an error on its row,
never a guess: no single FROM, a join without a condition, an unknown join type, a generator whose place among
joins is not published, a cycle. Nested set operations are put in parentheses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, digest

#: fixed values: join types that may be rendered
JOIN_TYPES = ("LEFT", "RIGHT", "INNER", "FULL", "CROSS", "LEFT OUTER", "RIGHT OUTER", "FULL OUTER", "SEMI", "ANTI", "LEFT SEMI", "LEFT ANTI")
#: fixed values: clauses after FROM, in order
CLAUSES = {
    "where_predicate": "WHERE", "group_by_clause": "GROUP BY", "having_predicate": "HAVING", "qualify_predicate": "QUALIFY", "order_by_clause": "ORDER BY",
    "sort_by_clause": "SORT BY", "distribute_by_clause": "DISTRIBUTE BY", "cluster_by_clause": "CLUSTER BY", "limit_clause": "LIMIT", "offset_clause": "OFFSET",
}
SET_OPERATORS = ("UNION", "EXCEPT", "INTERSECT")
KEY = ["query_id", "node_id"]


def discover_queries(statements: DataFrame, folder: str = "sql/targets/") -> DataFrame:
    """file -> query_id and status: a file must hold exactly one query."""
    s = statements.where(clean("file").contains(folder) & clean("file").endswith(".sql"))
    by = s.groupBy("file").agg(F.min("query_id").alias("query_id"), F.count_distinct("query_id").alias("n"))
    return by.select("file", F.when(F.col("n") == 1, F.col("query_id")).alias("query_id"), F.when(F.col("n") == 1, "found").otherwise("unresolved").alias("status"))


def clause(scope: DataFrame, name: str, keyword: str) -> Column:
    if name not in scope.columns:
        return F.lit("")
    raw = clean(name)
    return F.when(raw == "", "").when(F.startswith(F.upper(raw), F.lit(keyword + " ")), F.concat(F.lit("\n"), raw)).otherwise(F.concat(F.lit(f"\n{keyword} "), raw))


def relation_texts(relations: DataFrame, done: DataFrame) -> DataFrame:
    """relations with text, waiting and error. done: query_id, node_id, text, error."""
    inner = done.select("query_id", F.col("node_id").alias("inner_id"), F.col("text").alias("inner_text"), F.col("error").alias("inner_error"))
    r = relations.withColumn("inner_id", F.when(clean("relation_kind") == "derived", F.try_element_at("source_scope_ids", F.lit(1)))).join(inner, ["query_id", "inner_id"], "left")
    derived, alias = clean("relation_kind") == "derived", clean("alias")
    name = F.when(alias != "", alias).otherwise(clean("relation_name"))
    plain = F.when((alias != "") & (alias != clean("relation_name")), F.concat_ws(" AS ", clean("relation_name"), alias)).otherwise(clean("relation_name"))
    error = F.when(derived & (F.coalesce(F.size("source_scope_ids"), F.lit(0)) != 1), "derived relation without one scope").when(derived & (name == ""), "derived relation without a name").when(derived, F.col("inner_error"))
    text = F.when(derived, F.concat(F.lit("("), F.col("inner_text"), F.lit(") AS "), name)).otherwise(plain)
    return r.withColumn("relation_error", error).withColumn("waiting", derived & F.col("inner_text").isNull() & F.col("relation_error").isNull()).withColumn("relation_text", text)


def render_scopes(scopes: DataFrame, projections: DataFrame, relations: DataFrame, joins: DataFrame, done: DataFrame) -> DataFrame:
    """query_id, node_id, text, error of scopes whose inner scopes are done."""
    p = projections.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("projection_ordinal", clean("expression").alias("e")))).alias("ps"))
    rel = relation_texts(relations, done)
    by_rel = rel.groupBy(*KEY).agg(
        F.max("waiting").alias("waiting"), F.max("relation_error").alias("relation_error"), F.collect_list(F.when((F.col("usage_role") == "from") & (F.col("relation_kind") != "generated"), F.col("relation_text"))).alias("froms"),
        F.collect_set(F.when((F.col("usage_role") == "join") & (F.col("relation_kind") != "generated"), F.col("sql_relation_id"))).alias("join_ids"),
        F.array_sort(F.collect_list(F.when(F.col("relation_kind") == "generated", F.struct("sql_relation_id", clean("generator_expression").alias("g"), clean("generator_wrapper_alias").alias("a"), clean("relation_name").alias("n"))))).alias("gens"),
    )
    right = rel.select(*KEY, F.col("sql_relation_id").alias("right_relation_id"), F.col("relation_text").alias("right_text"))
    j = joins.join(right, [*KEY, "right_relation_id"], "left")
    kind = F.upper(clean("join_type"))
    kind = F.when(kind.isin("", "JOIN"), "INNER").otherwise(kind)
    predicate, using = clean("predicate"), F.coalesce("using_columns", F.array().cast("array<string>"))
    condition = F.when(predicate != "", F.concat(F.lit(" ON "), predicate)).when(F.size(using) > 0, F.concat(F.lit(" USING ("), F.array_join(using, ", "), F.lit(")"))).when(kind == "CROSS", "")
    j = j.select(*KEY, "join_ordinal", "right_relation_id", F.when(F.col("right_text").isNull(), "join without its relation").when(~kind.isin(*JOIN_TYPES), "unknown join type").when(condition.isNull(), "join without a condition").alias("e"), F.concat(F.lit("\n"), kind, F.lit(" JOIN "), F.col("right_text"), condition).alias("t"))
    by_join = j.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("join_ordinal", "t"))).alias("js"), F.max("e").alias("join_error"), F.collect_set("right_relation_id").alias("joined"))
    s = scopes.join(p, KEY, "left").join(by_rel, KEY, "left").join(by_join, KEY, "left")
    none = F.array().cast("array<string>")
    gens, ps = F.coalesce("gens", F.array().cast("array<struct<sql_relation_id:string,g:string,a:string,n:string>>")), F.coalesce("ps", F.array().cast("array<struct<projection_ordinal:int,e:string>>"))
    many = F.size(F.array_distinct(F.transform(gens, lambda g: F.struct(g["g"], g["a"])))) > 1
    error = (
        F.when((F.size(ps) == 0) | F.exists(ps, lambda x: x["e"] == ""), "projection expressions are missing").when(F.col("projection_count").isNotNull() & (F.size(ps) != F.col("projection_count")), "projections are incomplete")
        .when(F.coalesce(F.size("froms"), F.lit(0)) != 1, "not exactly one FROM relation").when(F.size(F.array_except(F.coalesce("join_ids", none), F.coalesce("joined", none))) > 0, "joined relation without a join")
        .when((F.size(gens) > 0) & ((F.coalesce(F.size("js"), F.lit(0)) > 0) | many), "the place of a generator is not published").when(F.exists(gens, lambda g: (g["g"] == "") | (g["a"] == "") | (g["n"] == "")), "a generator is incomplete")
    )
    error = F.coalesce(F.col("relation_error"), F.col("join_error"), error)
    head = F.concat(F.lit("SELECT "), F.when(clean("distinct_clause") != "", "DISTINCT ").otherwise(""), F.array_join(F.transform(ps, lambda x: x["e"]), ", "), F.lit("\nFROM "), F.element_at("froms", 1))
    body = F.array_join(F.transform(F.coalesce("js", F.array().cast("array<struct<join_ordinal:int,t:string>>")), lambda x: x["t"]), "")
    lateral = F.when(F.size(gens) > 0, F.concat(F.lit("\nLATERAL VIEW "), F.element_at(gens, 1)["g"], F.lit(" "), F.element_at(gens, 1)["a"], F.lit(" AS "), F.array_join(F.transform(gens, lambda g: g["n"]), ", "))).otherwise("")
    tail = [clause(scopes, c, k) for c, k in CLAUSES.items()]
    out = s.where(~F.coalesce("waiting", F.lit(False)) | F.col("relation_error").isNotNull()).withColumn("error", error)
    return out.select(*KEY, F.when(F.col("error").isNull(), F.concat(head, body, lateral, *tail)).otherwise("").alias("text"), "error")


def render_set_operations(ops: DataFrame, done: DataFrame) -> DataFrame:
    """ops: query_id, node_id, operator, distinct, left_id, right_id."""
    side = lambda s: done.select("query_id", F.col("node_id").alias(f"{s}_id"), F.col("text").alias(f"{s}_text"), F.col("error").alias(f"{s}_error"), F.col("is_set").alias(f"{s}_set"))
    o = ops.join(side("left"), ["query_id", "left_id"]).join(side("right"), ["query_id", "right_id"])
    wrap = lambda s: F.when(F.col(f"{s}_set"), F.concat(F.lit("("), F.col(f"{s}_text"), F.lit(")"))).otherwise(F.col(f"{s}_text"))
    op = F.upper(clean("operator"))
    error = F.coalesce(F.when(~op.isin(*SET_OPERATORS), "unknown set operator"), F.col("left_error"), F.col("right_error"))
    text = F.concat(wrap("left"), F.lit("\n"), op, F.when(F.col("distinct"), "").otherwise(" ALL"), F.lit("\n"), wrap("right"))
    return o.select(*KEY, F.when(error.isNull(), text).otherwise("").alias("text"), error.alias("error"))


def render_queries(queries: DataFrame, scopes: DataFrame, projections: DataFrame, relations: DataFrame, joins: DataFrame, set_operations: DataFrame, ctes: DataFrame) -> DataFrame:
    """queries (query_id, root_id) -> query_id, sql, status (restored, unresolved), error. ctes: query_id, cte_ordinal,
    cte_name, node_id, column_aliases, recursive. Rounds go on until one renders
    nothing new, so nesting has no limit but cycles; each is checkpointed (the session needs a checkpoint folder)."""
    spark = queries.sparkSession
    done = spark.createDataFrame([], "query_id string, node_id string, text string, error string, is_set boolean")
    while True:
        open_scopes = scopes.join(done.select(*KEY), KEY, "left_anti")
        open_sets = set_operations.join(done.select(*KEY), KEY, "left_anti")
        new = render_scopes(open_scopes, projections, relations, joins, done).withColumn("is_set", F.lit(False)).unionByName(render_set_operations(open_sets, done).withColumn("is_set", F.lit(True))).checkpoint()
        if new.isEmpty():
            break
        done = done.unionByName(new).checkpoint()
    c = ctes.join(done, KEY, "left")
    cols = F.coalesce("column_aliases", F.array().cast("array<string>"))
    label = F.concat(clean("cte_name"), F.when(F.size(cols) > 0, F.concat(F.lit("("), F.array_join(cols, ", "), F.lit(")"))).otherwise(""))
    body = F.concat(label, F.lit(" AS (\n"), F.col("text"), F.lit("\n)"))
    by = c.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("cte_ordinal", body.alias("t")))).alias("cs"), F.max("recursive").alias("recursive"), F.max(F.when(F.col("text").isNull(), "a CTE could not be rendered").otherwise(F.col("error"))).alias("cte_error"))
    q = queries.join(done.select("query_id", F.col("node_id").alias("root_id"), "text", "error"), ["query_id", "root_id"], "left").join(by, "query_id", "left")
    error = F.coalesce(F.when(F.col("text").isNull(), "the root was not rendered (a cycle, or too deep)"), F.col("error"), F.col("cte_error"))
    lead = F.when(F.size("cs") > 0, F.concat(F.when(F.coalesce("recursive", F.lit(False)), "WITH RECURSIVE ").otherwise("WITH "), F.array_join(F.transform("cs", lambda x: x["t"]), ",\n"), F.lit("\n"))).otherwise("")
    return q.select("query_id", F.when(error.isNull(), F.concat(F.coalesce(lead, F.lit("")), F.col("text"), F.lit("\n"))).alias("sql"), F.when(error.isNull(), "restored").otherwise("unresolved").alias("status"), error.alias("error"))


def check_parse(spark: SparkSession, sql: str) -> str | None:
    """Why Catalyst's parser refuses the text, or null."""
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        return None
    except Exception as e:
        return str(e).strip().splitlines()[0][:300]


def report(rendered: DataFrame) -> DataFrame:
    """Per query its status, size and sha256."""
    return rendered.select("query_id", "status", "error", F.octet_length("sql").alias("bytes"), digest(F.col("sql")).alias("sha256"))
