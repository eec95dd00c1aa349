from quern.operators import explore
from quern.plans.entries import project, select_states, validate
from quern.plans.spec import Property, TypeSpec

V1 = TypeSpec("t", (Property("outcome", "enum", enum_values=("approved", "rejected")), Property("findings", "integer"), Property("flag", "boolean")), version=1)
V2 = TypeSpec("t", (*V1.properties, Property("late", "string")), version=2)


def entries(spark):
    rows = [
        ("a", "t", 1, "2024-01-01T00:00:00.000Z", '{"outcome":"approved","findings":0,"flag":true}', "[]"),
        ("b", "t", 1, "2024-01-02T00:00:00.000Z", '{"outcome":null}', '["findings"]'),
        ("c", "t", 2, "2024-01-03T00:00:00.000Z", '{"late":"x","outcome":"approved"}', "[]"),
        ("d", "t", 2, "2024-01-03T00:00:00.000Z", '{"outcome":"rejected"}', "[]"),
        ("e", "other", 1, "2024-01-03T00:00:00.000Z", "{}", "[]"),
    ]
    return spark.createDataFrame(rows, "id string, type_name string, type_version int, recorded_at string, properties_json string, na_json string")


def test_four_states(spark):
    view = project(entries(spark), [V1, V2])
    states = {r.id: (r.outcome_state, r.findings_state, r.findings, r.flag, r.late_state) for r in view.df.collect()}
    assert states == {
        "a": ("measured", "measured", 0, True, "not_declared"), "b": ("measured", "not_applicable", None, None, "not_declared"),
        "c": ("measured", "not_measured", None, None, "measured"), "d": ("measured", "not_measured", None, None, "not_measured"),
    }


def test_states_are_counted_with_zeros(spark):
    counts = {(r.property, r.state): r.n for r in explore.profile_states(project(entries(spark), [V1, V2])).collect()}
    assert len(counts) == 16 and counts["late", "not_declared"] == 2 and counts["findings", "not_applicable"] == 1 and counts["flag", "not_applicable"] == 0


def test_groups_put_states_last_among_equals(spark):
    found = explore.group_one(project(entries(spark), [V1, V2]), "findings").collect()
    assert [(r.value, r.state, r.n) for r in sorted(found, key=lambda r: r.place)] == [(None, "not_measured", 2), ("0", None, 1), (None, "not_applicable", 1)]


def test_every_entry_is_in_one_cell(spark):
    cells = explore.crosstab(project(entries(spark), [V1, V2]), "outcome", "flag").collect()
    assert sum(r.n for r in cells) == 4


def test_pages_cover_everything_once(spark):
    view, after, seen = project(entries(spark), [V1, V2]), None, []
    while True:
        rows = explore.page(view, 1, after).collect()
        seen.append(rows[0].id)
        if len(rows) == 1:
            break
        after = (rows[0].recorded_at, rows[0].id)
    assert seen == ["a", "b", "c", "d"]


def test_select_shows_values_or_states(spark):
    rows = {r.id: (r.flag, r.late) for r in select_states(project(entries(spark), [V1, V2]), ["flag", "late"]).collect()}
    assert rows["a"] == ("true", "not_declared") and rows["c"] == ("not_measured", "x")


def test_filters_take_one_expression(spark):
    import pytest
    from pyspark.errors import ParseException

    view = project(entries(spark), [V1, V2])
    assert view.where("outcome = 'approved'").df.count() == 2
    with pytest.raises(ParseException):
        view.where("1 = 1; drop table x")


def test_validation(spark):
    spec = TypeSpec("t", (Property("o", "enum", True, ("x",)), Property("n", "integer"), Property("at", "timestamp"), Property("d", "duration"), Property("j", "json"), Property("r", "ref")))
    rows = [
        ("ok", '{"o":"x","n":3,"at":"2024-01-01T00:00:00Z","d":0,"j":[1],"r":"q"}', "[]"), ("na", "{}", '["o"]'), ("both", '{"o":"x"}', '["o"]'), ("missing", "{}", "[]"),
        ("types", '{"o":"y","n":1.5,"at":"yesterday","d":-1,"j":3,"r":""}', "[]"), ("odd", '{"o":"x","zzz":1}', '["n","n"]'), ("bad", "[1]", "[]"),
    ]
    found = {r.id: (len(r.errors), len(r.warnings)) for r in validate(spark.createDataFrame(rows, "id string, properties_json string, na_json string"), spec).collect()}
    assert found["ok"] == (0, 0) and found["na"] == (0, 1) and found["both"][0] == 1 and found["missing"][0] == 1 and found["types"][0] == 6 and found["odd"] == (0, 2) and found["bad"][0] >= 1
