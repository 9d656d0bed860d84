import json

import pytest

from patchloom.functions.languages import KNOWN
from patchloom.sources import config, rules, yaml_subset
from patchloom.sources.rules import RuleError


def test_yaml_blocks_flows_and_scalars():
    got = yaml_subset.load(
        '---\na: 1\nb: [x, "y, z", {k: v}]\nc:\n  - one # note\n  - k: 1\n    l: yes\n  -\n    - nested\non: added\ntext: |\n  line 1\n    line 2\n\nfold: >-\n  a\n  b\n\n  c\nq: \'it\'\'s\'\nn: 1.5\nz: ~\nu: http://x/y#z\n'
    )
    assert got == {
        "a": 1, "b": ["x", "y, z", {"k": "v"}], "c": ["one", {"k": 1, "l": True}, ["nested"]], "on": "added", "text": "line 1\n  line 2\n", "fold": "a b\nc", "q": "it's", "n": 1.5, "z": None, "u": "http://x/y#z",
    }


@pytest.mark.parametrize("bad", ["a: &x 1", "a: *x", "a: !t 1", "a: 1\n---\nb: 2", "a: 1\na: 2", "a:\n\tb: 1", "a: [1, 2", "a: 'x"])
def test_yaml_rejects(bad):
    with pytest.raises(yaml_subset.YamlError, match="line"):
        yaml_subset.load(bad)


GOOD = {"id": "a.b", "title": "t", "severity": "high", "category": "tampering", "question": "q?", "patterns": ["x"]}


@pytest.mark.parametrize(
    "change",
    [
        {"id": ""}, {"id": "A.b"}, {"title": ""}, {"severity": "bad"}, {"confidence": "bad"}, {"category": "bad"}, {"on": "bad"}, {"question": ""}, {"patterns": []}, {"patterns": [], "paths": ["x"], "on": "added"},
        {"patterns": ["("]}, {"patterns": ["(?=x)"]}, {"near": {}}, {"near": {"absent": ["x"], "scope": "bad"}}, {"languages": ["klingon"]}, {"file_events": ["bad"]}, {"paths": ["{x"]}, {"nonsense": 1}, {"exclude_patterns": [""]},
    ],
)
def test_invalid_rules(change):
    with pytest.raises(RuleError):
        rules.validate(rules.from_dict(GOOD | change))


def test_builtin_packs():
    found = rules.default()
    assert len(found) == 88 and {r.category for r in found.rules} == set(rules.CATEGORIES) and set(sum((list(r.languages) for r in found.rules), [])) <= set(KNOWN)
    assert [rules.SEVERITIES[r.severity] for r in found.rules] == sorted((rules.SEVERITIES[r.severity] for r in found.rules), reverse=True)


def test_later_packs_override(tmp_path):
    (tmp_path / "own.yaml").write_text("rules:\n  - id: audit.error-swallowed\n    title: t\n    severity: high\n    category: repudiation\n    question: q\n    patterns: [x]\n  - {id: own.off, title: t, severity: low, category: secrets, question: q, patterns: [x], enabled: false}\n")
    found = rules.default([str(tmp_path)])
    assert len(found) == 88 and found.by_id["audit.error-swallowed"].title == "t" and not found.by_id["own.off"].enabled
    assert [r.id for r in found.selected(only=("audit.error-swallowed", "own.off"), severity={"audit.error-swallowed": "info"})] == ["audit.error-swallowed"]
    with pytest.raises(RuleError):
        found.selected(severity={"no.such": "high"})
    assert "ci.pipeline-modified" in {r.id for r in found.selected(disable=("ci.pipeline-modified",), enable=("ci.pipeline-modified",))}


def test_empty_packs_and_folders(tmp_path):
    with pytest.raises(RuleError):
        rules.load_path(str(tmp_path))
    (tmp_path / "x.json").write_text(json.dumps({"rules": []}))
    with pytest.raises(RuleError):
        rules.load_path(str(tmp_path))


def test_config(tmp_path):
    assert config.load(root=str(tmp_path)) == config.Config()
    (tmp_path / ".patchloom.yaml").write_text("version: 1\nfail_on: High\nentropy: {enabled: no, min_length: 0}\nscoring: {saturation: 0}\nreview:\n  routes:\n    - name: x\n      rules: [crypto.*]\n      reviewers: ['@a']\n")
    got = config.load(root=str(tmp_path))
    assert got.gate.fail_on == "high" and not got.entropy.enabled and got.entropy.min_length == 20 and got.weights.get("saturation") == 70 and got.router.routes[0].reviewers == ("@a",)
    for bad in ({"version": 2}, {"nope": 1}, {"rules": {"nope": 1}}, {"exclude_paths": "x"}, {"fail_score": "x"}):
        with pytest.raises(config.ConfigError):
            config.from_dict(bad)


def test_slow_patterns_are_told():
    pack = "rules:\n  - {id: t.x, title: x, category: tampering, severity: low, on: added, patterns: ['(a+)+b'], question: q}\n"
    assert rules.compile_set([rules.parse_pack(pack, "t")]).warnings and not rules.default().warnings


def test_git_sources(tmp_path):
    import subprocess

    from patchloom.sources import patches

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for k in range(2):
        (tmp_path / "f").write_text(f"{k}\n")
        run("add", "f")
        run("commit", "-q", "-m", str(k))
    (tmp_path / "sub").mkdir()
    assert patches.base_ref(str(tmp_path)) == "main" and patches.repo_root(str(tmp_path / "sub")).endswith(tmp_path.name)
    assert patches.described(str(tmp_path), "HEAD~1").startswith("HEAD~1 (") and patches.described(staged=True) == "staged changes" and patches.described() == "changes of the work tree"
