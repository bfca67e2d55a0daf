"""The parser, project detection, configuration, stores."""

from __future__ import annotations

import json

import pytest

from lattica.functions import globs, text, version
from lattica.sources import project
from lattica.sources.lexer import Positions
from lattica.sources.parser import parse_source

from .projects import BROKEN, VAULT


def unit(files, name):
    return parse_source(name, files[name])


def by_name(u, name, kind=None):
    return [s for s in u["symbols"] if s["name"] == name and (kind is None or s["kind"] == kind)]


def test_declarations_are_counted():
    units = [parse_source(f, t) for f, t in VAULT.items()]
    every = [s for u in units for s in u["symbols"]]
    count = lambda **w: sum(all(s.get(k) == v for k, v in w.items()) for s in every)
    assert [count(contract_kind=k) for k in ("contract", "interface", "library", "abstract")] == [3, 1, 1, 1]
    assert count(kind="StateVariable") == 8 and count(kind="Event") == 2 and count(kind="Error") == 1 and count(kind="Struct") == 1 and count(kind="Enum") == 1
    assert count(subkind="modifier") == 1 and count(subkind="constructor") == 4 and count(subkind="fallback") == 1 and count(subkind="function") == 15
    assert not any(u["recovered"] for u in units)


def test_ids_and_attributes():
    u = unit(VAULT, "src/Vault.sol")
    deposit = by_name(u, "deposit")[0]
    assert deposit["id"] == "src/Vault.sol:Vault.deposit(uint256)" and deposit["scope"] == "src/Vault.sol:Vault"
    assert deposit["state_mutability"] == "payable" and deposit["modifier_names"] == ["nonReentrant"] and deposit["visibility"] == "external"
    assert by_name(u, "Deposited")[0]["id"] == "src/Vault.sol:Vault^Deposited(address,uint256)"
    assert by_name(u, "State")[0]["id"] == "src/Vault.sol:Vault~State"
    assert by_name(u, "start")[0]["is_immutable"] and by_name(u, "entries")[0]["is_mapping"]
    owned = unit(VAULT, "src/Owned.sol")
    assert by_name(owned, "onlyOwner")[0]["id"] == "src/Owned.sol:Owned#onlyOwner()" and by_name(owned, "onlyOwner")[0]["flags"]["checksSender"]
    assert by_name(owned, "NotOwner")[0]["id"] == "src/Owned.sol:!NotOwner(address)"
    assert by_name(unit(VAULT, "src/Token.sol"), "Token")[0]["natspec"] == "/// A token."
    assert by_name(unit(VAULT, "src/Math.sol"), "helper")[0]["id"] == "src/Math.sol:helper(uint256)"


def test_bodies():
    u = unit(VAULT, "src/Vault.sol")
    deposit, close = by_name(u, "deposit")[0], by_name(u, "close")[0]
    shapes = [(c["shape"], c["name"], c["receiver"], c["arg_count"]) for c in deposit["calls"]]
    assert ("member", "half", "amount", 0) in shapes and ("member", "twice", "Math", 1) in shapes and ("member", "mint", "token", 2) in shapes and ("bare", "helper", None, 1) in shapes
    assert [c for c in deposit["calls"] if c["name"] == "call"][0]["has_value"] and deposit["flags"]["sendsValue"] and deposit["flags"]["hasLowLevelCall"] and deposit["flags"]["hasUnchecked"]
    writes = {x["name"] for x in deposit["uses"] if x["write"]}
    assert writes == {"total", "entries"}
    assert {x["name"] for x in close["uses"] if x["write"]} == {"entries"} and close["flags"]["hasDelegatecall"] and close["flags"]["hasCreate"]
    shapes = {(c["shape"], c["name"]) for c in close["calls"]}
    assert {("cast", "balanceOf"), ("this", "deposit"), ("member", "helper"), ("bare", "missing"), ("member", "delegatecall"), ("expression", "mint"), ("new", "Token2")} <= shapes
    fallback = by_name(u, "fallback")[0]
    assert fallback["flags"]["hasAssembly"] and fallback["flags"]["writesState"] and fallback["metrics"]["cyclomatic"] == 2
    hook = [s for s in u["symbols"] if s["name"] == "_hook"][1]
    assert [(c["shape"], c["name"]) for c in hook["calls"]] == [("super", "_hook")]
    token = unit(VAULT, "src/Token.sol")
    mint = by_name(token, "mint")[0]
    assert {x["name"] for x in mint["uses"] if x["write"]} == {"balances", "history"} and mint["refs"][0]["name"] == "Moved"


def test_write_kinds():
    src = "contract C { uint a; uint b; uint[] c; function f() public { a = 1; b += a; c[0]++; (a, b) = (b, a); delete c; uint d = a; d = 2; c.pop(); } }"
    f = by_name(parse_source("x.sol", src), "f")[0]
    assert [(x["name"], x["write"]) for x in f["uses"] if x["write"]] == [("a", True), ("b", True), ("c", True), ("a", True), ("b", True), ("c", True), ("d", True), ("c", True)]
    assert {x["name"] for x in f["locals"]} == {"d"}
    reads = [x["name"] for x in f["uses"] if not x["write"]]
    assert "b" in reads and "a" in reads and "c" in reads


def test_metrics():
    src = "contract C {\n function f(uint x) public {\n  if (x > 0 && x < 9 || x == 3) {\n   for (uint i = 0; i < x; i++) { g(); }\n  }\n  x > 1 ? g() : g();\n  try this.g() { } catch { }\n }\n function g() public {}\n}"
    f = by_name(parse_source("x.sol", src), "f")[0]
    assert f["metrics"] == {"sloc": 7, "cyclomatic": 7, "maxDepth": 3}
    assert f["flags"]["hasTryCatch"]


def test_broken_files_keep_their_declarations():
    u = unit(BROKEN, "src/Broken.sol")
    assert u["recovered"] and u["version_support"] == "unsupported" and u["diagnostics"]
    assert [s["name"] for s in u["symbols"] if s["kind"] == "Contract"] == ["First", "Second", "Third"]
    assert by_name(u, "h") and by_name(u, "b") and by_name(u, "k")
    assert {x["name"] for x in by_name(u, "k")[0]["uses"] if x["write"]} == {"s"}
    for cut in range(0, len(VAULT["src/Vault.sol"]), 7):
        parse_source("cut.sol", VAULT["src/Vault.sol"][:cut])
        parse_source("cut.sol", VAULT["src/Vault.sol"][cut:])
    assert parse_source("empty.sol", "")["symbols"] == []


def test_positions_are_bytes_and_utf16_columns():
    p = Positions("// é🙂\r\nab")
    assert p.ref(3, 5) == {"offset": 3, "length": 6, "line": 1, "column": 3}
    at = p.text.index("ab")
    assert p.ref(at, at + 2) == {"offset": len(p.text[:at].encode()), "length": 2, "line": 2, "column": 0}
    assert text.utf16_index("é🙂x", 6) == 3 and text.line_and_column("é\n🙂x", 7) == (2, 2)


def test_pragmas():
    for pragma, want in {"^0.8.20": "supported", ">=0.4.0": "supported", "<0.8.0": "best-effort", "^0.5.3": "best-effort", "0.4.24": "unsupported", ">=0.6.0 <0.9.0": "supported", "<0.8.5": "supported", "abicoder v2": "unknown", ">= 0.5.0<0.7.0": "best-effort", "^0.4.0 || ^0.8.0": "unsupported", "<=0.8": "supported", "~0.6.2": "best-effort", "<1.0.0": "supported", "=0.7.6": "best-effort", "^1.2.0": "supported"}.items():
        assert version.support_of(pragma) == want, pragma
    assert version.support_of(None) == "unknown"


def test_globs():
    match = lambda g, p: globs.path_matches(p, [g], None)
    assert match("src/**", "src/a/b.sol") and match("src/**", "src") and not match("src/*", "src/a/b.sol")
    assert match("**/*.t.sol", "x.t.sol") and match("**/*.{a,b}", "d/x.b") and match("a?c", "abc") and not match("a?c", "a/c")
    assert not globs.path_matches("src/a.sol", ["src/**"], ["**/a.sol"])


def test_projects(tmp_path):
    (tmp_path / "foundry.toml").write_text('[profile.default]\nsrc = "contracts"\nremappings = ["x/=lib/other/", "long/prefix/=y/"]\n')
    (tmp_path / "lib/dep/src").mkdir(parents=True)
    (tmp_path / "contracts/out").mkdir(parents=True)
    (tmp_path / "contracts/A.sol").write_text("")
    (tmp_path / "contracts/out/B.sol").write_text("")
    p = project.detect_project(str(tmp_path))
    assert p.kind == "foundry" and p.sources == ["contracts"] and p.remappings == ["long/prefix/=y/", "dep/=lib/dep/src/", "x/=lib/other/"]
    assert project.list_sources(p) == ["contracts/A.sol"]
    bare = tmp_path / "bare"
    bare.mkdir()
    (bare / "hardhat.config.ts").write_text('export default { paths: { sources: "./code", artifacts: "./build" } }')
    assert project.detect_project(str(bare)).sources == ["code"] and project.detect_project(str(tmp_path / "none")).kind == "bare"


def test_configuration(tmp_path):
    config, notes = project.parse_config({"include": ["src/**"], "renderCap": 10, "trustBoundaries": {"external": ["lib/**"]}, "other": 1})
    assert config.include == ["src/**"] and notes == ['unknown key "other"']
    for bad in ({"include": "x"}, {"renderCap": 0}, {"renderCap": True}, {"entrypoints": [1]}, {"trustBoundaries": {"external": "x"}}):
        with pytest.raises(project.ConfigError):
            project.parse_config(bad)
    with pytest.raises(project.ConfigError):
        project.load_config(str(tmp_path), str(tmp_path / "absent.json"))
    assert project.load_config(str(tmp_path)) == (project.Config(), [])
    (tmp_path / project.CONFIG_FILE).write_text("[1]")
    with pytest.raises(project.ConfigError):
        project.load_config(str(tmp_path))
    assert json.loads(project.canonical_settings(config))["renderCap"] == 10
    first, second = project.managed_dir(str(tmp_path)), project.managed_dir(str(tmp_path))
    assert first == second and (first / ".gitignore").exists()
    artifact = tmp_path / "g"
    assert not project.is_fresh(str(artifact), 0, "a", "a")
    artifact.write_text("x")
    assert project.is_fresh(str(artifact), 0, "a", "a") and not project.is_fresh(str(artifact), 0, "a", "b") and not project.is_fresh(str(artifact), 4e9, "a", "a") and project.is_fresh(str(artifact), 4e9, "a", "a", True)
