import pytest

from quern.plans.spec import Property, Registry, SpecError, TypeSpec, canonical_json, canonical_name, check_spec, confusable_names, diff_specs, step_of, type_hash


@pytest.mark.parametrize(("text", "name"), [("HTTPServer name", "http_server_name"), ("findingCount", "finding_count"), ("  a--b ", "a_b"), ("É", "é"), ("a1B", "a1_b")])
def test_canonical_names(text, name):
    assert canonical_name(text) == name


def test_canonical_json_is_one_form():
    assert canonical_json({"b": 1.0, "a": [True, None, "é", 0.5]}) == '{"a":[true,null,"é",0.5],"b":1}'
    with pytest.raises(SpecError):
        canonical_json(float("nan"))


def test_identity_leaves_prose_out():
    a, b = TypeSpec("t", (Property("p", "string", description="x"),)), TypeSpec("t", (Property("p", "string", description="y"),), "other")
    assert type_hash(a) == type_hash(b) != type_hash(TypeSpec("t", (Property("p", "text"),)))


@pytest.mark.parametrize(
    ("old", "new", "step"),
    [
        ([], [Property("a", "string")], "minor"), ([], [Property("a", "string", True)], "major"), ([Property("a", "string")], [], "major"), ([Property("a", "string")], [Property("a", "text")], "major"),
        ([Property("a", "enum", enum_values=("x",))], [Property("a", "enum", enum_values=("x", "y"))], "minor"), ([Property("a", "enum", enum_values=("x", "y"))], [Property("a", "enum", enum_values=("x",))], "major"),
        ([Property("a", "number", unit="s")], [Property("a", "number", unit="ms")], "major"), ([Property("a", "string", True)], [Property("a", "string")], "minor"), ([Property("a", "string")], [Property("a", "string", description="d")], "none"),
    ],
)
def test_version_steps(old, new, step):
    assert step_of(diff_specs(TypeSpec("t", tuple(old)), TypeSpec("t", tuple(new)))) == step


def test_registry_numbers_versions():
    r = Registry()
    assert r.register(TypeSpec("My Type", (Property("a", "string"),)))[1] == "created"
    assert r.register(TypeSpec("my_type", (Property("a", "string"), Property("b", "string"))))[1] == "minor"
    made, what = r.register(TypeSpec("my_type", (Property("b", "string"),)))
    assert (made.version, made.major, what) == (3, 2, "major")
    assert r.register(TypeSpec("my_type", (Property("a", "string"),)))[1] == "unchanged"
    assert [v.version for v in r.family("my_type", 1)] == [1, 2]


@pytest.mark.parametrize("p", [Property("id", "string"), Property("x_state", "string"), Property("", "string"), Property("a", "what"), Property("a", "enum"), Property("a", "string", unit="s"), Property("9", "string")])
def test_bad_properties_are_refused(p):
    with pytest.raises(SpecError):
        check_spec(TypeSpec("t", (p,)))


def test_confusable_names():
    assert confusable_names(["review_done", "done_review", "other"]) == [("done_review", "review_done", ("done", "review"))]
