"""Projects on disk: what kind they are, their settings and their source files."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tempfile
import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path

from ..functions.globs import path_matches

# Folders that never hold sources of the project itself.
SKIPPED = ("node_modules", ".git", "out", "artifacts", "cache", "broadcast", "typechain", "typechain-types", "coverage", ".lattica")
OUTPUT_DIR = ".lattica"
CONFIG_FILE = "lattica.config.json"


@dataclass
class Project:
    root: str
    kind: str
    sources: list[str] = field(default_factory=list)
    libs: list[str] = field(default_factory=list)
    out: str = "out"
    remappings: list[str] = field(default_factory=list)
    diagnostics: list[str] = field(default_factory=list)


def parse_toml(text: str) -> tuple[dict, list[str]]:
    """A TOML document; one that cannot be read is empty with a diagnostic."""
    try:
        return tomllib.loads(text), []
    except tomllib.TOMLDecodeError as e:
        return {}, [f"configuration cannot be read: {e}"]


def parse_remappings(lines: list[str]) -> list[str]:
    """Well-formed remappings, longest prefix first, then longest context."""
    from ..operators.resolve import Remappings

    return [f"{c + ':' if c else ''}{p}={t}" for c, p, t in Remappings.parse(lines).rules]


def foundry_config(root: str, profile: str = "default") -> Project:
    """Settings of ``foundry.toml``, ``remappings.txt``, and a remapping for each library folder."""
    path = Path(root)
    text = (path / "foundry.toml").read_text() if (path / "foundry.toml").exists() else ""
    table, notes = parse_toml(text)
    own = table.get("profile", {}).get("default", {}) | table.get("profile", {}).get(profile, {})
    libs = list(own.get("libs", ["lib"]))
    lines = list(own.get("remappings", []))
    if (path / "remappings.txt").exists():
        lines += (path / "remappings.txt").read_text().splitlines()
    named = {line.partition("=")[0].rpartition(":")[2] for line in lines}
    for lib in libs:
        folder = path / lib
        for one in sorted(p for p in folder.iterdir() if p.is_dir()) if folder.is_dir() else []:
            prefix, inner = f"{one.name}/", one / "src"
            if prefix not in named:
                lines.append(f"{prefix}={lib}/{one.name}/{'src/' if inner.is_dir() else ''}")
    return Project(root, "foundry", [own.get("src", "src")], libs, own.get("out", "out"), parse_remappings(lines), notes)


def hardhat_config(root: str) -> Project:
    """``paths`` of a Hardhat configuration, found by pattern; the file is never run."""
    path = Path(root)
    text = next((p.read_text() for n in ("hardhat.config.ts", "hardhat.config.js", "hardhat.config.cjs") if (p := path / n).exists()), "")
    block = re.search(r"paths\s*:\s*\{([^}]*)\}", text)
    found = dict(re.findall(r"(\w+)\s*:\s*[\"'`]([^\"'`]+)[\"'`]", block[1] if block else ""))
    clean = lambda p: re.sub(r"^\./", "", p).rstrip("/")
    return Project(root, "hardhat", [clean(found.get("sources", "contracts"))], ["node_modules"], clean(found.get("artifacts", "artifacts")))


def detect_project(root: str) -> Project:
    """Foundry, Hardhat or bare; never fails."""
    path = Path(root)
    if (path / "foundry.toml").exists():
        return foundry_config(root)
    if any((path / f"hardhat.config.{x}").exists() for x in ("ts", "js", "cjs")):
        return hardhat_config(root)
    lines = (path / "remappings.txt").read_text().splitlines() if (path / "remappings.txt").exists() else []
    notes = [] if path.is_dir() else [f"{root} is not a folder"]
    sources = [n for n in ("src", "contracts") if (path / n).is_dir()] or ["."]
    return Project(root, "bare", sources, [n for n in ("lib", "node_modules") if (path / n).is_dir()], "out", parse_remappings(lines), notes)


def list_sources(project: Project, include: list[str] | None = None, exclude: list[str] | None = None, skip: tuple[str, ...] = SKIPPED) -> list[str]:
    """Source files by path relative to the root, sorted."""
    found, skipped = [], {*skip, project.out.split("/")[0]}
    for folder, folders, names in os.walk(project.root):
        folders[:] = sorted(d for d in folders if d not in skipped)
        rel = os.path.relpath(folder, project.root)
        found += [n if rel == "." else f"{rel.replace(os.sep, '/')}/{n}" for n in names if n.endswith(".sol")]
    return sorted(f for f in found if path_matches(f, include, exclude))


# Configuration


@dataclass
class Config:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    entrypoints: list[str] = field(default_factory=list)
    accessControlModifiers: list[str] | None = None  # noqa: N815
    reentrancyGuards: list[str] | None = None  # noqa: N815
    trustBoundaries: dict = field(default_factory=dict)  # noqa: N815
    renderCap: int | None = None  # noqa: N815
    layout: str | None = None


class ConfigError(ValueError):
    pass


def parse_config(data: dict) -> tuple[Config, list[str]]:
    """A configuration and warnings: an unknown key is a warning, a value of a wrong type an error."""
    out, notes = Config(), []
    for key, value in data.items():
        if not hasattr(out, key):
            notes.append(f'unknown key "{key}"')
            continue
        kind = {"trustBoundaries": dict, "renderCap": int, "layout": str}.get(key, list)
        good = isinstance(value, kind) and not isinstance(value, bool) and (kind is not list or all(isinstance(x, str) for x in value)) and (key != "renderCap" or value > 0)
        if key == "trustBoundaries" and good:
            outside = value.get("external", [])
            good = isinstance(outside, list) and all(isinstance(x, str) for x in outside)
            notes += [f'unknown key "trustBoundaries.{k}"' for k in value if k != "external"]
        if not good:
            raise ConfigError(f'"{key}" has a wrong type')
        setattr(out, key, value)
    return out, notes


def load_config(root: str, path: str | None = None) -> tuple[Config, list[str]]:
    """The configuration of a project; a file named explicitly has to exist."""
    file = Path(path) if path else Path(root) / CONFIG_FILE
    if not file.exists():
        if path:
            raise ConfigError(f"{path} does not exist")
        return Config(), []
    try:
        data = json.loads(file.read_text())
    except json.JSONDecodeError as e:
        raise ConfigError(f"{file}: {e}") from e
    if not isinstance(data, dict):
        raise ConfigError(f"{file} does not hold an object")
    return parse_config(data)


def canonical_settings(config: Config) -> str:
    return json.dumps(asdict(config), sort_keys=True, separators=(",", ":"))


# Managed folder, freshness, revisions


def managed_dir(root: str) -> Path:
    """The output folder, with an ignore file for its own contents; repeating this changes nothing."""
    path = Path(root) / OUTPUT_DIR
    path.mkdir(parents=True, exist_ok=True)
    ignore = path / ".gitignore"
    if not ignore.exists():
        ignore.write_text("graph/\ncache/\n")
    return path


def newest_input(project: Project, include: list[str] | None = None, exclude: list[str] | None = None) -> float:
    """Latest modification among sources and configuration files."""
    names = [*list_sources(project, include, exclude), CONFIG_FILE, "foundry.toml", "remappings.txt", "hardhat.config.ts", "hardhat.config.js"]
    times = [os.stat(p).st_mtime for n in names if os.path.exists(p := os.path.join(project.root, n))]
    return max(times, default=0.0)


def is_fresh(artifact: str, newest: float, settings: str, stored_settings: str, stale: bool = False) -> bool:
    """Whether a stored graph may stand for a build: it has the same settings and no input is newer, unless ``stale`` is allowed."""
    if not os.path.exists(artifact) or settings != stored_settings:
        return False
    return stale or os.stat(artifact).st_mtime >= newest


def resolve_revision(reference: str, repository: str = ".") -> tuple[str, bool]:
    """(folder, temporary): a folder as it is, else a detached worktree of a revision."""
    if os.path.isdir(reference):
        return reference, False
    target = tempfile.mkdtemp(prefix="lattica-rev-")
    done = subprocess.run(["git", "-C", repository, "worktree", "add", "--detach", target, reference], capture_output=True, text=True)
    if done.returncode:
        raise ConfigError(f'"{reference}" is neither a folder nor a revision: {done.stderr.strip()}')
    return target, True
