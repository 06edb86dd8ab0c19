import json

import pytest
from listwright.rules import default_rules, load_rules


def write(root, name, rows):
    (root / name).mkdir(parents=True)
    (root / name / "part.json").write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")


def test_rules_from_tables(spark, tmp_path):
    base = default_rules()
    phrases = [
        {"kind": "negative", "rule": "negative", "term": "barista", "ord": 1},
        {"kind": "negative", "rule": "negative", "term": "driver", "ord": 0},
        {"kind": "skills", "rule": "languages", "term": "french", "ord": 0},
    ]
    weights = [{"component": c, "weight": w} for c, w in base.weights.items()]
    write(tmp_path, "phrases", phrases)
    write(tmp_path, "weights", weights)
    rules = load_rules(spark, str(tmp_path))
    assert rules.negative == ("driver", "barista") and rules.skills == {"languages": ("french",)}
    assert rules.categories == base.categories and dict(rules.weights) == dict(base.weights)


def test_bad_rule_tables_are_refused(spark, tmp_path):
    row = {"kind": "negative", "rule": "negative", "term": " Driver", "ord": 0}
    write(tmp_path, "phrases", [row, {**row, "term": "driver "}, {**row, "term": " "}, {**row, "kind": "colours"}])
    write(tmp_path, "weights", [{"component": "recency", "weight": 90}])
    with pytest.raises(ValueError) as error:
        load_rules(spark, str(tmp_path))
    for problem in ("unknown kind", "blank phrase", "repeated phrase", "weights"):
        assert problem in str(error.value)
