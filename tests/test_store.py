import json

import pytest

from quern.__main__ import main
from quern.operators import doctor
from quern.operators.annotate import AnnotationError, invalidation_id, record, register_scheme
from quern.plans.spec import Property, TypeSpec
from quern.sources.records import StoreError, integrity_faults
from quern.store import Store

SPEC = TypeSpec("Review done", (Property("verdict", "enum", True, ("ok", "bad")), Property("n", "integer")))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.define(SPEC)
    rows = [(f"e{k}", f"2024-01-{k + 1:02d}T00:00:00.000Z", json.dumps({"verdict": "ok" if k % 3 else "bad", **({"n": k} if k % 2 else {})}), "[]", f"the reviewer saw item {k}") for k in range(9)]
    s.record("review_done", spark.createDataFrame(rows, "id string, recorded_at string, properties_json string, na_json string, evidence_text string"))
    return s


def test_a_store_is_read_again(store, spark):
    again = Store(spark, store.path)
    assert again.registry.versions["review_done"][-1].properties == SPEC.properties
    assert again.query("select count(*) as n from v_review_done_v1 where verdict = 'ok'").head().n == 6
    assert {(r.value, r.n) for r in again.explore("review_done", group_by=["verdict"]).collect()} == {("ok", 6), ("bad", 3)}
    assert again.explore("review_done", "n > 2", ["verdict", "n"]).count() == 3


def test_pages_follow_cursors(store):
    seen, cursor = [], None
    while True:
        rows, cursor = store.page("review_done", 4, cursor)
        seen += [r.id for r in rows]
        if not cursor:
            break
    assert seen == [f"e{k}" for k in range(9)]


def test_batches_are_all_or_none(store, spark):
    schema = "id string, recorded_at string, properties_json string, na_json string"
    for rows in ([("x", "t", '{"verdict":"no"}', "[]")], [("e1", "t", '{"verdict":"ok"}', "[]")], [("x", "t", '{"verdict":"ok"}', "[]")] * 2, [("x", "t", '{"verdict":"ok"}', "[]"), ("y", "t", "{}", "[]")]):
        with pytest.raises(StoreError):
            store.record("review_done", spark.createDataFrame(rows, schema))
    assert store.record("review_done", spark.createDataFrame([("x", "t", '{"verdict":"ok"}', "[]")], schema), dry_run=True).count() == 1
    assert store.entries.count() == 9


def test_invalidation_is_an_annotation(store):
    store.invalidate("e1", "wrong_value", "typed wrong", "2024-02-01T00:00:00.000Z")
    store.invalidate("e1", "wrong_value", "typed wrong", "2024-02-01T00:00:00.000Z")
    assert store.annotations.count() == 1 and store.annotations.head().id == invalidation_id("e1", "wrong_value", "typed wrong")
    assert {r.id: r.invalidated for r in store.view("review_done").df.collect()}["e1"] == "wrong_value"
    for bad in (("e1", "odd", "r"), ("e1", "duplicate", " "), ("e1", "superseded", "r")):
        with pytest.raises(AnnotationError):
            store.invalidate(*bad, "2024-02-01T00:00:00.000Z")


def test_rules_and_search(store):
    rules = [{"label": "first", "kind": "sql", "query": "id in ('e1', 'e2')"}, {"label": "item", "kind": "fts", "query": "item"}]
    found = {r.entry_id: r.label for r in store.annotate("s", rules, "2024-03-01T00:00:00.000Z").collect()}
    assert found["e1"] == "first" and found["e3"] == "item" and len(found) == 9
    assert store.search("reviewer").count() == 9 and store.search("zz").count() == 0


def test_schemes_keep_their_version_until_they_change():
    one, new = register_scheme([], "s", ["b", "a", "a"], [])
    assert new and one["labels"] == ["a", "b"] and register_scheme([one], "s", ["a", "b"], []) == (one, False)
    assert register_scheme([one], "s", ["a"], [])[0]["version"] == 2


def test_a_pass_is_checked(store, spark):
    empty = store.annotations
    ok = spark.createDataFrame([("e1", "a", 0.5)], "entry_id string, label string, confidence double")
    assert record(empty, store.entries, ok, ["a"]).count() == 1
    for rows in ([("nope", "a", 0.5)], [("e1", "z", 0.5)], [("e1", "a", 2.0)], [("e1", "a", 0.5), ("e1", "a", 0.5)]):
        with pytest.raises(AnnotationError):
            record(empty, store.entries, spark.createDataFrame(rows, "entry_id string, label string, confidence double"), ["a"])


def test_doctor(store, spark):
    store.define(TypeSpec("review_started", (Property("a", "string"),)))
    assert [r.type_name for r in doctor.dead_types(store.entries, store.registry).collect()] == ["review_started"]
    assert doctor.name_pairs(store.registry) == [("review_done", "review_started", ("review",))]
    assert doctor.version_drift(store.entries).head().n == 9
    assert doctor.silent_properties(store.view("review_done")).count() == 0
    types = spark.createDataFrame([("review_done", 1, store.entries.head().type_hash)], "type_name string, type_version int, type_hash string")
    assert integrity_faults(store.entries, types).count() == 0
    assert integrity_faults(store.entries, types.limit(0)).count() == 9


def test_command_line(store, capsys):
    main(["--store", store.path, "query", "select count(*) as n from v_review_done_v1"])
    main(["--store", store.path, "page", "review_done", "--size", "2"])
    out = capsys.readouterr().out.splitlines()
    assert json.loads(out[0]) == {"n": 9} and json.loads(out[1])["next_cursor"].startswith("asc1:")


WRITING = [
    "with x as (select 7 as a) insert into guarded select a from x",
    "from guarded insert into guarded select a + 1 insert into guarded select a + 2",
    "insert overwrite guarded values (9)",
    "select * from (select reflect('java.lang.System', 'getProperty', 'user.home') as x)",
    "select java_method('java.lang.System', 'nanoTime')",
    "select 1 where exists (select TRY_REFLECT('java.lang.System', 'nanoTime'))",
    "with x as (select `reflect`('java.lang.System', 'nanoTime') as a) select * from x",
    "select a from guarded order by system.builtin.reflect('java.lang.System', 'nanoTime')",
    "select transform(a) using 'cat' as (b) from guarded",
    "create table guarded2 as select 1 as a", "drop table guarded", "cache table guarded", "set x = 1",
]
READ = [
    "with x as (select a from guarded) select count(*) as n from x where a in (select a from guarded)",
    "select g.a, (select max(a) from guarded) as m, row_number() over (order by g.a) as r from guarded g left join guarded h on g.a = h.a",
    "select a, count(*) as n from guarded group by a having n > 0 order by a limit 3",
    "select * from guarded, lateral (select guarded.a + 1 as b)",
    "select * from range(3) union all select a from guarded", "values (1), (2)", "select explode(array(1, 2)) as x",
    "with recursive t(n) as (select 1 union all select n + 1 from t where n < 3) select * from t",
    "select * from guarded tablesample (50 percent)",
]


def test_only_reading_statements_run(spark):
    from quern.sql import QueryError, query

    spark.sql("drop table if exists guarded")
    spark.sql("create table guarded using parquet as select 1 as a")
    try:
        for statement in WRITING:
            with pytest.raises(QueryError):
                query(spark, statement)
        assert spark.table("guarded").count() == 1
        for statement in READ:
            query(spark, statement).collect()
    finally:
        spark.sql("drop table if exists guarded")
