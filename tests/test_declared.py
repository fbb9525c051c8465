import pytest

from plumbline.operators import declared


def model(spark, types, inheritance, fields):
    return (
        spark.createDataFrame([(t,) for t in types], "type_id string"), spark.createDataFrame(inheritance, "subtype_id string, supertype_id string"),
        spark.createDataFrame(fields, "field_id string, type_id string, field_name string"),
    )


def effective(spark, *m):
    return {(r["type_id"], r["field_name"]): (r["field_id"], r["distance"], r["status"], r["complete"]) for r in declared.effective_fields(*model(spark, *m)).collect()}


def test_nearest_declaration_wins(spark):
    got = effective(spark, ["a", "b", "c"], [("b", "a"), ("c", "b")], [("1", "a", "x"), ("2", "b", "x"), ("3", "a", "y")])
    assert got[("c", "x")] == ("2", 1, "confirmed", True) and got[("c", "y")] == ("3", 2, "confirmed", True) and got[("a", "x")] == ("1", 0, "confirmed", True)


def test_diamonds_count_once_and_ties_are_refused(spark):
    diamond = [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")]
    got = effective(spark, "abcd", diamond, [("1", "a", "x"), ("2", "b", "y"), ("3", "c", "y")])
    assert got[("d", "x")] == ("1", 2, "confirmed", True) and got[("d", "y")] == (None, 1, "ambiguous", True)


def test_cycles_end_and_open_supertypes_show(spark):
    got = effective(spark, "abc", [("a", "b"), ("b", "a"), ("c", "a"), ("b", None), ("c", "")], [("1", "a", "x"), ("1", "a", "x"), (None, "a", "z"), ("2", "b", None)])
    assert got == {("a", "x"): ("1", 0, "confirmed", False), ("b", "x"): ("1", 1, "confirmed", False), ("c", "x"): ("1", 1, "confirmed", False)}


def test_empty_model(spark):
    assert effective(spark, [], [], []) == {}


def test_counts_of_two_languages_in_one_model(spark):
    """Three types of each: one inherited field; equal names in both stay apart."""
    types = [f"{lang}.{n}" for lang in ("code", "schema") for n in ("Base", "Customer", "Profile")]
    own = [(f"{t}.{i}", t, f"f{i}") for t, n in zip(types, (1, 2, 1, 2, 3, 2), strict=True) for i in range(10 * len(t), 10 * len(t) + n)]
    t, i, f = model(spark, types, [("code.Customer", "code.Base")], own)
    found = declared.model_counts(t, f, declared.effective_fields(t, i, f), i.union(i).union(i), i).first()
    assert tuple(found) == (6, 11, 12, 3, 1)


@pytest.mark.parametrize(
    ("ref", "target", "gap"),
    [("#/components/schemas/P", "p1", None), ("#/components/schemas/Q", None, declared.LOCAL_GAP), ("https://x#/components/schemas/P", None, declared.EXTERNAL_GAP), ("#/a~1b", "p3", None), ("#/two", None, "ambiguous"), (None, None, declared.EXTERNAL_GAP)],
)
def test_references(spark, ref, target, gap):
    schemas = spark.createDataFrame([("d", "/components/schemas/P", "p1"), ("e", "/components/schemas/Q", "p2"), ("d", "/a~1b", "p3"), ("d", "/two", "p4"), ("d", "/two", "p5")], "path string, locator string, schema_id string")
    refs = spark.createDataFrame([("d", ref)], "path string, literal_ref string")
    found = declared.schema_references(refs, schemas)
    assert tuple(found.first()) == ("d", ref, target, "resolved" if gap is None else "unresolved", gap)
    docs = spark.createDataFrame([("d", True, True), ("n", False, True), ("f", True, False), ("g", True, True)], "path string, structured boolean, parsed boolean")
    coverage = {r["path"]: r["coverage"] for r in declared.schema_coverage(docs, found).collect()}
    assert coverage == {"d": "complete" if gap is None else "partial", "n": "not_applicable", "f": "partial", "g": "complete"}


def test_required_and_nullable_are_apart(spark):
    rows = spark.createDataFrame([("a", ["a"], None, None), ("b", ["a"], ["string", "null"], False), ("c", None, [], True)], "field_name string, owner_required array<string>, type_variants array<string>, nullable_flag boolean")
    assert [(r["required"], r["nullable"]) for r in declared.property_flags(rows).orderBy("field_name").collect()] == [(True, False), (False, True), (False, True)]


def test_a_name_goes_down_once(spark):
    """in a chain whose types all declare a name, rows are types, not pairs of types; an id of two types is one declaration."""
    chain = [(f"t{i}", f"t{i - 1}") for i in range(1, 20)]
    up = spark.createDataFrame(chain, "dst string, src string")
    own = spark.createDataFrame([(f"t{i}", "x", f"d{i}") for i in range(20)], "owner string, field_name string, field_id string")
    assert declared.nearest_declarations(up, own).count() == 20
    got = effective(spark, "abcde", [("d", "b"), ("d", "c"), ("e", "d")], [("1", "b", "x"), ("1", "c", "x"), ("2", "b", "y"), ("2", "c", "y"), ("3", "c", "y"), ("4", "b", "z"), ("5", "b", "z")])
    assert got["d", "x"] == ("1", 1, "confirmed", True) and got["e", "y"] == (None, 2, "ambiguous", True) and got["e", "z"] == (None, 2, "ambiguous", True)
