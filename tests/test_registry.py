"""Loading, validation and precedence of patterns."""

import pytest

from lexward.plans import registry as R

GOOD = "category: house\ndefault_severity: LOW\npatterns:\n  - {id: HS001, name: one, pattern: 'abc'}\n  - {id: HS002, name: two, pattern: 'ABC', severity: HIGH, case_sensitive: true, tags: [x]}\n"


def test_embedded():
    categories = R.load_embedded()
    assert [c.category for c in categories] == ["role_override", "instruction_injection", "exfiltration", "jailbreak", "encoding"]
    assert [c.default_severity for c in categories] == ["CRITICAL", "HIGH", "CRITICAL", "HIGH", "HIGH"]
    known = {p.id: p.severity for p in R.embedded()}
    assert len(known) == 30
    assert [known[i] for i in ("PI003", "PI011", "PI025", "PI035", "PI042")] == ["HIGH", "CRITICAL", "HIGH", "CRITICAL", "CRITICAL"]
    assert all(p.message and p.remediation for p in R.embedded())


def test_defaults():
    c = R.parse_category(GOOD, "x")
    a, b = R.compile_strict([c])
    assert (a.severity, a.case_sensitive, a.message, a.tags) == ("LOW", False, "", ())
    assert (b.severity, b.case_sensitive, b.tags) == ("HIGH", True, ("x",))


@pytest.mark.parametrize(
    "text",
    [
        GOOD + "metadata: {}\n",
        GOOD.replace("name: one", "name: one, note: x"),
        GOOD.replace("LOW", "low"),
        GOOD.replace("HIGH", "SEVERE"),
        GOOD.replace("name: one, ", ""),
        GOOD.replace("default_severity: LOW\n", ""),
        GOOD.replace("case_sensitive: true", "case_sensitive: 'yes'"),
        GOOD.replace("tags: [x]", "tags: [1]"),
        "category: [",
        "- a",
        "",
    ],
)
def test_closed_schema(text):
    with pytest.raises(R.PatternError) as e:
        R.parse_category(text, "x")
    assert e.value.kind == "ParseError"


def test_external_folder(tmp_path):
    assert R.load_external(tmp_path / "none").categories == []
    (tmp_path / "b.yml").write_text(GOOD)
    (tmp_path / "a.yaml").write_text("category: x\nextra: 1\n")
    (tmp_path / "c.yaml").write_bytes(b"\xff\xfe")
    (tmp_path / "d.txt").write_text("no")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.yaml").write_text(GOOD)
    loaded = R.load_all(tmp_path)
    assert len(loaded.categories) == 6 and len(loaded.errors) == 2


def test_first_claim_wins_even_when_invalid():
    first = R.Category("a", "LOW", (R.Pattern("X1", "bad", "[invalid("), R.Pattern("X2", "fine", "b")))
    second = R.Category("b", "LOW", (R.Pattern("X1", "late", "c"), R.Pattern("X2", "late", "d"), R.Pattern("X3", "own", "e")))
    accepted, errors = R.compile_lenient([first, second])
    assert [(p.ord, p.id, p.pattern) for p in accepted] == [(0, "X2", "b"), (1, "X3", "e")]
    assert [(e.kind, e.id) for e in errors] == [("InvalidRegex", "X1"), ("DuplicateId", "X1"), ("DuplicateId", "X2")]
    assert (errors[1].first_category, errors[1].second_category) == ("a", "b") and "X1" in str(errors[1])
    with pytest.raises(R.PatternError) as e:
        R.compile_strict([first, second])
    assert e.value.kind == "InvalidRegex"


def test_tables(spark):
    assert R.registry(spark).count() == 30
    assert R.errors_table(spark, [R.PatternError("DuplicateId", "", "a", "b", "c")]).first()["id"] == "a"
