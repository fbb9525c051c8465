"""Semantic evidence of an interaction: projections of observed paths, external origins, continuation into callees.

Flat tables. nodes: repo_id, value_node_id, node_kind, display_ref, operation, occurrence_id, occurrence_kind, object_occurrence_id,
object_declared_type, projected_field_tail, property_name, symbol, declared_type, method_id, callee_method_id, method_name,
resolution_status (`catalogue` adds those that a source lacks). flows: src, dst, the value-flow edges of a fine confidence.
Nothing is guessed: what is not the only one is left out, and no edge is made between repositories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, first_filled
from .graph import MOST_PATHS, closure, shortest_paths
from .interaction import FINE
from .keys import dealt

NODE_COLUMNS = (
    "repo_id", "value_node_id", "node_kind", "display_ref", "operation", "occurrence_id", "occurrence_kind", "object_occurrence_id", "object_declared_type",
    "projected_field_tail", "property_name", "symbol", "declared_type", "method_id", "callee_method_id", "method_name", "resolution_status",
)
#: fixed values: declared types that hold many
COLLECTION_TYPES = (
    "ArrayDeque", "ArrayList", "Collection", "ConcurrentHashMap", "CopyOnWriteArrayList", "Deque", "Entry", "HashMap", "HashSet", "Iterable", "LinkedHashMap",
    "LinkedHashSet", "LinkedList", "List", "Map", "Optional", "Queue", "Set", "Stream", "TreeMap", "TreeSet",
)
#: fixed values: kinds of occurrence that own a property, and kinds of node that a source projection shows
OWNER_KINDS = ("local_variable", "method_parameter", "field", "object_field")
SHOWN_KINDS = ("field", "derivation", "wire_field")


def catalogue(nodes: DataFrame) -> DataFrame:
    """nodes with every column of NODE_COLUMNS as clean text, absent ones empty."""
    return nodes.select(*[(clean(c) if c in nodes.columns else F.lit("")).alias(c) for c in NODE_COLUMNS])


def plain_path(ref: Column) -> Column:
    """Dotted names only: no call, no condition, no construction."""
    return (ref != "") & ~ref.startswith("new ") & ~ref.rlike(r"[()\n\r?: ]|^\.|\.\.|\.$")


def semantic_parts(ref: Column) -> Column:
    """Parts of a reference with small initials and without collection marks."""
    parts = F.filter(F.transform(F.split(ref, r"\."), clean), lambda p: p != "")
    bare = F.transform(parts, lambda p: F.regexp_replace(p, r"\[\]$", ""))
    return F.transform(bare, lambda p: F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1)))


def projected_property() -> Column:
    return first_filled("property_name", F.substring_index("display_ref", ".", -1))


def sole(df: DataFrame, keys: list[str], *columns: Column) -> DataFrame:
    """keys and columns (aggregates) of the keys that have one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("__n"), *columns).where("__n = 1").drop("__n")


# ---- target projection


def semantic_refs(nodes: DataFrame) -> DataFrame:
    """repo_id, value_node_id, display_ref, ref, typed, collection, shape of the field nodes that have a semantic reference: their property after the declared type of their object, where that object is the only typed node of its occurrence."""
    nodes = catalogue(nodes)
    typed = sole(nodes.where("occurrence_id != '' and declared_type != ''"), ["repo_id", "occurrence_id"], F.min("display_ref").alias("object_display"), F.min("declared_type").alias("node_type"))
    f = nodes.where("node_kind = 'field' and display_ref != ''").select("repo_id", "object_occurrence_id", "value_node_id", "display_ref", "object_declared_type", first_filled("projected_field_tail", "property_name").alias("tail"))
    # fields without an object ask for none, and are not sent to one task by their empty key
    alone = f.where("object_occurrence_id = ''").select("*", *[F.lit(None).cast("string").alias(c) for c in ("object_display", "node_type")])
    f = f.where("object_occurrence_id != ''").join(typed.withColumnRenamed("occurrence_id", "object_occurrence_id"), ["repo_id", "object_occurrence_id"], "left").unionByName(alone)
    f = f.withColumn("object_type", first_filled("object_declared_type", "node_type"))
    simple = F.substring_index(clean(F.substring_index("object_type", "<", 1)), ".", -1)
    display, kind, owner = F.col("display_ref"), F.col("object_type"), clean("object_display")
    rest = F.substring(display, F.char_length(owner) + 2, F.char_length(display))
    f = f.withColumn("collection", simple.isin(*COLLECTION_TYPES))
    ref = (
        F.when((kind != "") & (owner != "") & display.startswith(F.concat(owner, F.lit("."))), F.when(F.col("collection"), F.concat(owner, F.lit("[]."), rest)).otherwise(F.concat(kind, F.lit("."), rest)))
        .when((kind != "") & display.startswith(F.concat(F.lit("new "), kind, F.lit("."))), F.substring(display, F.lit(5), F.char_length(display)))
        .when((kind != "") & (F.col("tail") != "") & ~display.contains("."), F.concat(kind, F.lit("."), F.col("tail")))
        .when(plain_path(display), display)
    )
    # made by a generator, so that the filter does not repeat the whole expression
    f = f.select("repo_id", "value_node_id", "display_ref", "object_type", "collection", F.explode(F.array(ref)).alias("ref")).where(plain_path(F.replace("ref", F.lit("[]"), F.lit(""))))
    return f.select("repo_id", "value_node_id", "display_ref", "ref", (kind != "").alias("typed"), "collection", F.array_join(semantic_parts(F.col("ref")), ".").alias("shape"))


def depth_of(shape: Column) -> Column:
    """Number of a shape's parts."""
    return F.char_length(shape) - F.char_length(F.replace(shape, F.lit("."))) + 1


def suffixes() -> Column:
    """Dotted suffixes of shape, itself included."""
    parts = F.split("shape", r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def climb(front: DataFrame, refs: DataFrame) -> DataFrame:
    """journey_id, rung (from 0), ref, shape, n: from front up to ever longer references that end with the rung before.

    front: a row per journey; refs: journey_id, ref, shape, n, preference, ident. A rung takes the shortest reference that ends with it,
    by the least preference among those; two of another ident end the climb. A journey's references are gathered once, as one row,
    and climbed there: no round moves them again. It ends by itself, as references only grow."""
    gathered = refs.groupBy("journey_id").agg(F.collect_list(F.struct("n", "preference", "ref", "shape", "ident")).alias("all"))
    rows = front.select("journey_id", F.array(F.struct("ref", "shape", "n")).alias("first")).join(gathered, "journey_id", "left")

    def higher(at: Column, _: Column) -> Column:
        """One rung more, or the same chain, closed."""
        below = F.concat(F.lit("."), F.element_at(at["chain"], -1)["shape"])
        bind = lambda value, use: F.transform(F.array(value), use)[0]
        tied = lambda r, b: (r["n"] == b["n"]) & (r["preference"] == b["preference"]) & (r["ident"] != b["ident"])
        closed = F.struct(F.lit(False).alias("open"), at["chain"].alias("chain"))
        grown = lambda b: F.struct(F.lit(True).alias("open"), F.concat(at["chain"], F.array(F.struct(b["ref"].alias("ref"), b["shape"].alias("shape"), b["n"].alias("n")))).alias("chain"))
        step = bind(F.filter("all", lambda r: r["shape"].endswith(below)), lambda met: bind(F.array_min(met), lambda b: F.when(b.isNull() | F.exists(met, lambda r: tied(r, b)), closed).otherwise(grown(b))))
        return F.when(at["open"], step).otherwise(at)

    chain = F.aggregate("all", F.struct(F.lit(True).alias("open"), F.col("first").alias("chain")), higher)["chain"]
    out = rows.select("journey_id", F.posexplode(F.coalesce(chain, F.col("first"))).alias("rung", "r"))
    return out.select("journey_id", "rung", "r.ref", "r.shape", "r.n").checkpoint()


def observed_refs(journeys: DataFrame, path_nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """The semantic references on each path of the resolved journeys, each once, at its first position: journey_id, path_id, ref,
    position, repo_id, typed, collection, shape, anchor (it is the journey's anchor). Dealt by journey."""
    live = journeys.where(clean("anchor_status") == "resolved").select("journey_id", "repo_id", clean("anchor_ref").alias("anchor_ref"))
    on = path_nodes.select("journey_id", "path_id", "position", "value_node_id").join(live, "journey_id").join(refs, ["repo_id", "value_node_id"])
    anchor = (F.col("display_ref") == F.col("anchor_ref")) | (F.col("ref") == F.col("anchor_ref"))
    on = dealt(on.select("journey_id", "path_id", "ref", "position", "repo_id", "value_node_id", anchor.alias("anchor"), "typed", "collection", "shape"), "journey_id", rows=refs.count())
    first = on.groupBy("journey_id", "path_id", "ref").agg(F.min(F.struct("position", "repo_id", "value_node_id", "anchor", "typed", "collection", "shape")).alias("f"))
    return first.select("journey_id", "path_id", "ref", "f.*").drop("value_node_id")


def target_projection(journeys: DataFrame, path_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """journey_id, entry_ref, consumer_ref, chain: the nesting that a journey's published target paths prove.

    The entry is the first typed field of each path that is no collection and not the anchor, if all paths agree on it. From there
    the ladder climbs by suffixes (`climb`; typed references and shorter ones first), then come the one typed reference of the same
    tail under another head, and the nearest collection around the last rung; where several collections tie, the one typed field of
    the repository whose shape is what they end with in common. A chain of one reference is none.

    journeys: journey_id, repo_id, anchor_status, anchor_ref; path_nodes: journey_id, path_id, position, value_node_id."""
    refs = semantic_refs(nodes).checkpoint()
    seen = observed_refs(journeys, path_nodes, refs).checkpoint()
    of = depth_of(F.col("shape")).alias("n")
    entry = seen.where(~F.col("anchor") & F.col("typed") & ~F.col("collection"))
    entry = entry.groupBy("journey_id", "path_id").agg(F.min_by(F.struct("ref", "shape"), "position").alias("e"))
    entry = entry.groupBy("journey_id").agg(F.count_distinct("e.ref").alias("k"), F.min("e").alias("e")).where("k = 1").select("journey_id", "e.*").select("journey_id", "ref", "shape", of).checkpoint()
    found = seen.groupBy("journey_id", "ref").agg(F.min_by(F.struct("repo_id", "typed", "collection", "shape"), F.struct(~F.col("typed"), "path_id", "position")).alias("f"))
    found = found.select("journey_id", "ref", "f.*").join(entry.select("journey_id"), "journey_id", "left_semi").select("*", of).checkpoint()
    plain = found.where(~F.col("collection"))
    rungs = climb(entry, plain.withColumn("preference", F.struct((~F.col("typed")).alias("untyped"), F.char_length("ref").alias("length"))).withColumn("ident", F.col("ref")))

    last = rungs.groupBy("journey_id").agg(F.max_by(F.struct("ref", "shape", "n"), "rung").alias("d")).select("journey_id", F.col("d.shape").alias("deepest"), F.col("d.n").alias("depth")).where("depth >= 2")
    tail = lambda shape: F.regexp_replace(shape, r"^[^.]*\.", "")
    last = last.withColumn("tail", tail(F.col("deepest"))).checkpoint()
    same = found.withColumn("tail", tail(F.col("shape"))).withColumnRenamed("n", "depth").join(last, ["journey_id", "tail", "depth"])
    head = lambda c: F.substring_index(c, ".", 1)
    other = same.where(~F.col("collection") & F.col("typed") & (head("shape") != head("deepest"))).groupBy("journey_id").agg(F.count_distinct("ref").alias("k"), F.min("ref").alias("ref")).where("k = 1")

    around = found.where("collection").join(last.drop("tail"), "journey_id").where(F.col("shape").endswith(F.concat(F.lit("."), "deepest")))
    around = around.select("journey_id", "repo_id", "ref", "shape", "n", "deepest", "depth").union(same.where("collection").select("journey_id", "repo_id", "ref", "shape", F.col("depth").alias("n"), "deepest", "depth"))
    near = around.groupBy("journey_id", "n").agg(F.count_distinct("ref").alias("k"), F.min("ref").alias("ref")).groupBy("journey_id").agg(F.min(F.struct("n", "k", "ref")).alias("c")).select("journey_id", "c.*").checkpoint()
    tied = around.join(near.where("k > 1").select("journey_id", "n", "k"), ["journey_id", "n"])
    ends = tied.select("journey_id", "repo_id", "ref", "k", "deepest", "depth", F.explode(suffixes()).alias("shape")).groupBy("journey_id", "repo_id", "k", "deepest", "depth", "shape").agg(F.count_distinct("ref").alias("met"))
    length = F.size(F.split("shape", r"\."))
    common = ends.where("met = k").groupBy("journey_id", "repo_id", "deepest", "depth").agg(F.max(F.struct(length.alias("n"), "shape")).alias("c")).select("journey_id", "repo_id", "deepest", "depth", "c.*")
    common = common.where((F.col("n") > F.col("depth")) & F.col("shape").endswith(F.concat(F.lit("."), F.col("deepest"))))
    wanted = refs.where(~F.col("collection") & F.col("typed")).select("repo_id", "shape", "ref").distinct()
    payload = common.join(wanted, ["repo_id", "shape"]).groupBy("journey_id").agg(F.count_distinct("ref").alias("k"), F.min("ref").alias("ref")).where("k = 1")

    at = lambda df, place, rung="0": df.select("journey_id", "ref", F.struct(F.lit(place).alias("place"), F.expr(rung).cast("int").alias("rung")).alias("at"))
    chain = at(rungs, 0, "rung").union(at(other, 1)).union(at(near.where("k = 1"), 2)).union(at(payload, 2))
    chain = chain.groupBy("journey_id", "ref").agg(F.min("at").alias("at")).groupBy("journey_id").agg(F.array_sort(F.collect_list(F.struct("at", "ref")))["ref"].alias("chain"))
    return chain.where(F.size("chain") > 1).select("journey_id", F.element_at("chain", 1).alias("entry_ref"), F.element_at("chain", -1).alias("consumer_ref"), "chain")


# ---- external origins


def external_origin_gaps(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends of reverse paths that are a projected field of a typed invocation that is external or unresolved, the only node of its
    occurrence: journey_id, terminal_id, parent_id, parent_type, property, relative (array), reason. ends: journey_id, repo_id,
    value_node_id. relative is the terminal's path below its parent's reference, else the property alone."""
    nodes = catalogue(nodes)
    own = nodes.where("occurrence_kind = 'projected_object_field' and object_occurrence_id != ''").select("repo_id", "value_node_id", "object_occurrence_id", "display_ref", projected_property().alias("property"))
    picked = [F.min(c).alias(c) for c in ("occurrence_kind", "resolution_status", "declared_type", "display_ref")]
    up = sole(nodes.where("occurrence_id != ''"), ["repo_id", "occurrence_id"], *picked).where("occurrence_kind = 'method_invocation' and resolution_status = 'external_or_unresolved' and declared_type != ''")
    up = up.select("repo_id", F.col("occurrence_id").alias("object_occurrence_id"), F.col("declared_type").alias("parent_type"), F.col("display_ref").alias("parent_ref"))
    j = ends.select("journey_id", "repo_id", "value_node_id").distinct().join(own, ["repo_id", "value_node_id"]).join(up, ["repo_id", "object_occurrence_id"])
    below = (F.col("parent_ref") != "") & F.col("display_ref").startswith(F.concat(F.col("parent_ref"), F.lit(".")))
    parts = F.filter(F.split(F.substring(F.col("display_ref"), F.char_length("parent_ref") + 2, F.char_length("display_ref")), r"\."), lambda p: p != "")
    alone = F.when(F.col("property") != "", F.array("property")).otherwise(F.array().cast("array<string>"))
    return j.select(
        "journey_id", F.col("value_node_id").alias("terminal_id"), F.col("object_occurrence_id").alias("parent_id"), "parent_type", "property",
        F.when(below & (F.size(parts) > 0), parts).otherwise(alone).alias("relative"), F.lit("source_external_origin_unresolved").alias("reason"),
    ).distinct()


def node_symbol() -> Column:
    """The published symbol, else a reference that is a bare name."""
    return first_filled("symbol", F.when(~F.col("display_ref").rlike(r"[.(\[]"), F.col("display_ref")))


def property_owners(nodes: DataFrame, symbol: Column) -> DataFrame:
    """Fields with what owns them: repo_id, value_node_id, property, operation, owner_type, owners, all_owners. A row per declared
    type that the field's root symbol has in its operation; owners counts the nodes of that type, all_owners those of any."""
    typed = nodes.where((F.col("declared_type") != "") & F.col("occurrence_kind").isin(*OWNER_KINDS)).select("repo_id", "operation", "method_id", symbol.alias("root"), F.col("declared_type").alias("owner_type"))
    fields = nodes.where((F.col("node_kind") == "field") & F.col("display_ref").contains(".") & (F.col("operation") != "") & (F.col("value_node_id") != ""))
    fields = fields.select("repo_id", "operation", F.substring_index("display_ref", ".", 1).alias("root"), "value_node_id", F.col("property_name").alias("property"), F.col("method_id").alias("field_method"), "display_ref").where("property != ''")
    per_type = typed.groupBy("repo_id", "operation", "root", "owner_type").agg(F.count("*").alias("owners"))
    total = per_type.groupBy("repo_id", "operation", "root").agg(F.sum("owners").alias("all_owners"))
    return fields.join(per_type, ["repo_id", "operation", "root"]).join(total, ["repo_id", "operation", "root"])


def fine_origins(paths: DataFrame) -> DataFrame:
    """value_node_id, origin_id: ends of reverse paths of one hop or more and a fine confidence; fields, where any is one.
    paths: value_node_id, hop_count, confidence, end_id, end_kind."""
    good = paths.where((F.col("hop_count") > 0) & F.col("confidence").isin(*FINE) & (clean("end_id") != "") & (F.col("end_id") != F.col("value_node_id")))
    good = good.select("value_node_id", F.col("end_id").alias("origin_id"), (clean("end_kind") == "field").alias("is_field")).distinct().checkpoint()
    any_field = good.groupBy("value_node_id").agg(F.max("is_field").alias("any_field"))
    return good.join(any_field, "value_node_id").where("is_field or not any_field").select("value_node_id", "origin_id").distinct()


def covering_fields(gaps: DataFrame, scopes: DataFrame, nodes: DataFrame, origins: DataFrame) -> DataFrame:
    """journey_id, terminal_id, repo_id, value_node_id, root_type, owner_type, property, relative, depth: the fields that cover the
    required terminals of each journey whose terminals are all covered; as external_segments, which adds their origins.

    No row is repeated for an origin, and none for a field of a journey that cannot be covered: whether a direct terminal has any
    field is asked of distinct (repository, property, type), and a nested one without a direct property at its head has none.
    origins: value_node_id, origin_id."""
    owned = property_owners(catalogue(nodes), F.col("symbol")).join(origins.select("value_node_id").distinct(), "value_node_id", "left_semi")
    fields = owned.select("repo_id", "value_node_id", "property", "owner_type", "owners", "all_owners").checkpoint()
    g = gaps.select("journey_id", "terminal_id", F.col("parent_type").alias("root_type"), "property", "relative", F.try_element_at("relative", F.lit(1)).alias("head"), (F.size("relative") - 1).alias("depth")).distinct()
    asked = g.where("root_type != '' and property != '' and depth >= 0").join(scopes.select("journey_id", "repo_id").distinct(), "journey_id").checkpoint()
    typed = fields.where("owners = 1").withColumn("root_type", F.col("owner_type"))
    direct = asked.where("depth = 0").join(typed.select("repo_id", "property", "root_type").distinct(), ["repo_id", "property", "root_type"], "left_semi").checkpoint()
    nested = asked.where("depth > 0").join(direct.select("journey_id", F.col("property").alias("head")).distinct(), ["journey_id", "head"], "left_semi").checkpoint()
    need = gaps.where(clean("terminal_id") != "").groupBy("journey_id").agg(F.count_distinct("terminal_id").alias("need"))
    covered = lambda rows, enough: need.join(rows.groupBy("journey_id").agg(F.count_distinct("terminal_id").alias("have")), "journey_id").where(enough).select("journey_id")
    open_ = covered(direct.select("journey_id", "terminal_id").union(nested.select("journey_id", "terminal_id")), "have >= need").checkpoint()
    direct = direct.join(open_, "journey_id", "left_semi").join(typed, ["repo_id", "property", "root_type"]).checkpoint()
    nested = nested.join(open_, "journey_id", "left_semi").join(fields.where("all_owners = 1"), ["repo_id", "property"]).checkpoint()
    heads = nested.select("journey_id", "head").distinct()
    known = direct.select("journey_id", F.col("property").alias("head"), "value_node_id").distinct().join(heads, ["journey_id", "head"], "left_semi").join(origins, "value_node_id").select("journey_id", "head", "origin_id").distinct()
    shared = nested.select("journey_id", "head", "value_node_id").distinct().join(origins, "value_node_id").join(known, ["journey_id", "head", "origin_id"], "left_semi").select("journey_id", "head", "value_node_id").distinct()
    columns = ["journey_id", "terminal_id", "repo_id", "value_node_id", "root_type", "owner_type", "property", "relative", "depth"]
    found = direct.select(columns).union(nested.join(shared, ["journey_id", "head", "value_node_id"], "left_semi").select(columns)).checkpoint()
    return found.join(covered(found, "have = need"), "journey_id", "left_semi")


def external_segments(gaps: DataFrame, scopes: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """journey_id, terminal_id, repo_id, value_node_id, root_type, owner_type, property, relative, depth, origin_id: the external
    segments of each journey whose required terminals are all covered.

    A direct property counts where exactly one owner of the parent's declared type stands in the field's operation and a fine
    reverse path leaves it; a nested one where it has exactly one typed owner and shares an origin with the direct property at the
    head of its path. Coverage is a relational division, by counts. scopes: journey_id, repo_id of the catalogues to ask (complete
    ones other than the journey's own); gaps: as external_origin_gaps."""
    origins = fine_origins(paths).checkpoint()
    return covering_fields(gaps, scopes, nodes, origins).join(origins, "value_node_id").select("journey_id", "terminal_id", "repo_id", "value_node_id", "root_type", "owner_type", "property", "relative", "depth", "origin_id")


def with_coverage(gaps: DataFrame, segments: DataFrame) -> DataFrame:
    """gaps with covered, and the reason that only the link is unproven where the journey is covered."""
    done = segments.select("journey_id").distinct().withColumn("covered", F.lit(True))
    out = gaps.join(done, "journey_id", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    return out.withColumn("reason", F.when(F.col("covered"), "source_external_origin_link_unproven").otherwise(F.col("reason")))


# ---- continuation into resolved callees


def local_requirements(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """journey_id, local_id, owner_type, property, local_path: fields at the ends of a journey's reverse paths whose root symbol is
    one typed value of their operation. ends: journey_id, repo_id, value_node_id."""
    nodes = catalogue(nodes)
    f = property_owners(nodes.withColumn("property_name", projected_property()), node_symbol()).where("all_owners = 1")
    f = f.where(F.substring_index("display_ref", ".", -1) == F.col("property"))
    path = F.filter(F.split(F.regexp_replace("display_ref", r"^[^.]*\.", ""), r"\."), lambda p: p != "")
    return ends.join(f, ["repo_id", "value_node_id"]).select("journey_id", F.col("value_node_id").alias("local_id"), "owner_type", "property", path.alias("local_path")).distinct()


def scalar_continuations(segments: DataFrame, transformations: DataFrame, requirements: DataFrame, scopes: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """journey_id, parent_id, local_id, repo_id, value_node_id, callee_method_id, owner_type, property, origin_id, composed_ref:
    scalars of an object that an exactly resolved callee makes, where the journey's own code consumes that type's property.

    The field stands in that callee, under its one owner of the type; against the flows it reaches the same property of one of
    the callee's parameters. Reached pairs are a semi-naive closure from all such fields at once, over as many hops as there are;
    a walk ends where nothing flows in. The parent's one origin then lends its reference. segments: journey_id, value_node_id,
    origin_id, origin_ref of direct segments; transformations: value_node_id (the segment's), callee_method_id, result_type,
    resolution_status; requirements: as local_requirements; flows: src, dst."""
    nodes = catalogue(nodes)
    one = sole(segments.select("journey_id", "value_node_id", "origin_id", "origin_ref").distinct(), ["journey_id", "value_node_id"], F.min("origin_ref").alias("parent_ref")).where(clean("parent_ref") != "")
    called = transformations.where((clean("callee_method_id") != "") & (clean("result_type") != "") & (F.col("resolution_status") == "resolved")).select("value_node_id", "callee_method_id", F.col("result_type").alias("owner_type")).distinct()
    asked = one.join(called, "value_node_id").join(requirements.select("journey_id", "local_id", "owner_type", "property").distinct(), ["journey_id", "owner_type"]).withColumnRenamed("value_node_id", "parent_id")
    asked = asked.join(scopes.select("journey_id", "repo_id").distinct(), "journey_id")
    in_method = nodes.where("method_id != ''").withColumn("root", node_symbol())
    owners = sole(in_method.where((F.col("declared_type") != "") & F.col("occurrence_kind").isin(*OWNER_KINDS)), ["repo_id", "operation", "method_id", "root", "declared_type"]).withColumnRenamed("declared_type", "owner_type")
    fields = in_method.where("node_kind = 'field' and operation != '' and value_node_id != ''").where(F.col("display_ref").contains(".")).withColumn("root", F.substring_index("display_ref", ".", 1))
    targets = fields.join(owners, ["repo_id", "operation", "method_id", "root"]).select("repo_id", "value_node_id", F.col("method_id").alias("callee_method_id"), F.col("property_name").alias("property"), "owner_type", "operation")
    hit = asked.join(targets, ["repo_id", "callee_method_id", "owner_type", "property"]).checkpoint()

    back = flows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reached = closure(back, hit.select(F.col("value_node_id").alias("node")).distinct()).where("hops > 0")
    reached = reached.join(back.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select(F.col("seed").alias("value_node_id"), F.col("node").alias("origin_id"))
    parameters = in_method.where("occurrence_kind = 'method_parameter' and root != ''").select("repo_id", "method_id", "operation", "root").distinct()
    ends = fields.join(parameters, ["repo_id", "method_id", "operation", "root"]).select("repo_id", F.col("method_id").alias("callee_method_id"), F.col("property_name").alias("property"), F.col("value_node_id").alias("origin_id"), F.regexp_replace("display_ref", r"^[^.]*\.", "").alias("rest"))
    out = hit.join(reached, "value_node_id").join(ends, ["repo_id", "callee_method_id", "property", "origin_id"])
    return out.select(
        "journey_id", "parent_id", "local_id", "repo_id", "value_node_id", "callee_method_id", "owner_type", "property", "origin_id", F.concat_ws(".", "parent_ref", "rest").alias("composed_ref")
    ).distinct()


def unresolved_callee_evidence(calls: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """repo_id, method_name, method_id, origin_id, target_id, invocations for calls (repo_id, method_name) that are not resolved: the
    repository's one method of that name, if the shortest way from a parameter to its one return value is the only one and passes an
    invocation. That the call is of this method stays unsaid."""
    nodes = catalogue(nodes)
    methods = nodes.where("operation != '' and method_id != ''").withColumn("method_name", F.substring_index("operation", ".", -1)).join(calls.select("repo_id", "method_name").distinct(), ["repo_id", "method_name"], "left_semi")
    one = methods.select("repo_id", "method_name", "operation", "method_id").distinct()
    one = sole(one, ["repo_id", "method_name"], F.min("operation").alias("operation"), F.min("method_id").alias("method_id"))
    inside = methods.join(one, ["repo_id", "method_name", "operation", "method_id"], "left_semi").checkpoint()
    returns = sole(inside.where("node_kind = 'return_value' and occurrence_kind = 'method_return' and value_node_id != ''"), ["repo_id", "method_name", "method_id"], F.min("value_node_id").alias("start"))
    ends = inside.where("occurrence_kind = 'method_parameter' and value_node_id != ''").select("repo_id", "method_name", F.col("value_node_id").alias("end")).distinct()
    found = shortest_paths(flows.select(F.col("dst").alias("src"), F.col("src").alias("dst")), returns.select(F.col("start").alias("node")).distinct())
    ways = returns.join(found, "start").join(ends, ["repo_id", "method_name", "end"])
    least = ways.groupBy("repo_id", "method_name", "method_id", "start", "hops").agg(F.sum("path_count").alias("k"), F.min(F.struct("end", "path")).alias("w")).groupBy("repo_id", "method_name", "method_id", "start").agg(F.min(F.struct("hops", "k", "w")).alias("b")).where("b.k = 1")
    steps = least.select("repo_id", "method_name", "method_id", F.col("start").alias("target_id"), F.col("b.w.end").alias("origin_id"), F.posexplode("b.w.path").alias("position", "value_node_id"))
    invoked = inside.where("occurrence_kind = 'method_invocation' and display_ref != ''").select("repo_id", "value_node_id", "display_ref")
    shown = steps.join(invoked, ["repo_id", "value_node_id"])
    return shown.groupBy("repo_id", "method_name", "method_id", "origin_id", "target_id").agg(F.array_sort(F.collect_list(F.struct(F.col("value_node_id"), F.col("display_ref"))))["display_ref"].alias("invocations"))


# ---- source projection


def source_projection(journeys: DataFrame, segments: DataFrame, nodes: DataFrame, flows: DataFrame) -> DataFrame:
    """journey_id, local_id, chain: the references on the one shortest reverse path from a journey's anchor to the local node that
    its deepest segments consume, if they consume just one. journeys: journey_id, anchor_id; segments: journey_id, depth, local_id.

    The ways are sought along the flow, from the local nodes: they are the same ones, and most of what flows into an anchor comes
    from nodes that no journey asks for."""
    place = F.struct(F.col("depth").isNull(), -F.col("depth"), "local_id")
    deep = segments.where(clean("local_id") != "").groupBy("journey_id").agg(F.max(F.struct("depth", "local_id"))["local_id"].alias("local_id"), F.min(place)["local_id"].alias("least"))
    wanted = journeys.join(deep.where("local_id = least").drop("least"), "journey_id").checkpoint()
    found = shortest_paths(flows, wanted.select(F.col("local_id").alias("node")))
    only = wanted.join(found.where("path_count = 1"), (F.col("local_id") == F.col("start")) & (F.col("anchor_id") == F.col("end")))
    steps = only.select("journey_id", "local_id", F.posexplode("path").alias("position", "value_node_id"))
    shown = steps.join(catalogue(nodes).where(F.col("node_kind").isin(*SHOWN_KINDS) & (F.col("display_ref") != "")).select("value_node_id", "display_ref"), "value_node_id")
    met = F.array_sort(F.collect_set(F.struct("position", "display_ref")))
    chain = shown.groupBy("journey_id", "local_id").agg(F.array_distinct(met["display_ref"]).alias("chain"))
    return chain.where(F.size("chain") > 1)


def source_projection_in_rows(graphs: DataFrame) -> DataFrame:
    """`source_projection` of journeys whose flows and nodes are their own and few: each is walked in its row, and nothing is sent or
    written for it. graphs: journey_id, anchor_id, local_id (what its deepest segments consume, if just one), flows array<struct<src,
    dst>>, nodes array<struct<value_node_id, node_kind, display_ref>>. A round's work grows with the nodes of two rounds and the flows:
    a row of more than some hundreds belongs to `source_projection`."""
    g = graphs.where("local_id is not null and anchor_id is not null and local_id != anchor_id")
    start = F.struct(F.col("local_id").alias("node"), F.lit(1).cast("long").alias("n"), F.array("local_id").alias("path"))

    def grown(front: Column, seen: Column) -> Column:
        # flows that repeat or lack an end change nothing: ends are made distinct, and ways are counted by the nodes they come from
        ends = F.array_distinct(F.flatten(F.transform(front, lambda v: F.transform(F.filter("flows", lambda f: (f["src"] == v["node"]) & ~F.array_contains(seen, f["dst"])), lambda f: f["dst"]))))

        def met(end: Column) -> Column:
            ways = F.filter(front, lambda v: F.exists("flows", lambda f: (f["dst"] == end) & (f["src"] == v["node"])))
            # each way's number and path are gathered at once, so that ways are found once
            return F.aggregate(
                ways, F.struct(end.alias("node"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("path")),
                lambda s, v: F.struct(s["node"].alias("node"), F.least(s["n"] + v["n"], F.lit(MOST_PATHS)).alias("n"), F.concat(v["path"], F.array(s["node"])).alias("path")),
            )

        return F.transform(ends, met)

    def step(state: Column, _: Column) -> Column:
        front = state["front"]
        over = (F.size(front) == 0) | F.exists(front, lambda v: v["node"] == F.col("anchor_id"))
        seen = F.concat(state["seen"], F.transform(front, lambda v: v["node"]))
        return F.when(over, state).otherwise(F.struct(grown(front, seen).alias("front"), seen.alias("seen")))

    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("flows"), F.lit(1))), F.struct(F.array(start).alias("front"), F.array().cast("array<string>").alias("seen")), step)
    only = F.filter(walked["front"], lambda v: (v["node"] == F.col("anchor_id")) & (v["n"] == 1))
    # made by generators, so that what follows does not repeat the walk
    g = g.select("journey_id", "local_id", F.explode(F.transform(only, lambda v: v["path"])).alias("path"), "nodes")
    met = F.filter("nodes", lambda x: F.array_contains("path", clean(x["value_node_id"])) & clean(x["node_kind"]).isin(*SHOWN_KINDS))
    shown = F.transform(met, lambda x: F.struct(clean(x["value_node_id"]).alias("id"), clean(x["display_ref"]).alias("ref")))
    g = g.select("journey_id", "local_id", "path", F.explode(F.array(shown)).alias("shown"))
    refs = lambda v: F.array_sort(F.transform(F.filter("shown", lambda x: (x["id"] == v) & (x["ref"] != "")), lambda x: x["ref"]))
    g = g.select("journey_id", "local_id", F.explode(F.array(F.array_distinct(F.flatten(F.transform("path", refs))))).alias("chain"))
    return g.where(F.size("chain") > 1)
