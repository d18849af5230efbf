"""Rules: their table, their YAML files, and where these are looked for."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from rulequarry.functions.patterns import module_glob, path_glob

CONFIG_NAME = ".rulequarry.yml"
RULES = (
    "rule_id int, type string, paths array<string>, pattern string, uses_module string, forbidden_modules array<string>, "
    "required_modules array<string>, allowed_functions array<string>, recursive boolean, mode string, max_lines int, path_regexes array<string>, module_regex string"
)


class ConfigError(Exception):
    """A rule file that is missing or can't be read as rules."""


@dataclass
class Rule:
    type: str
    paths: list[str] = field(default_factory=list)
    pattern: str | None = None
    uses_module: str | None = None
    forbidden_modules: list[str] = field(default_factory=list)
    required_modules: list[str] = field(default_factory=list)
    allowed_functions: list[str] = field(default_factory=list)
    recursive: bool = False
    mode: str | None = None
    max_lines: int | None = None


def rule_from(raw: dict, *, compat: bool = False) -> Rule:
    """Known keys only, with defaults. ``compat`` drops mode and max_lines, as the original loader does."""
    if not isinstance(raw, dict):
        raise ConfigError(f"a rule is a mapping, not {raw!r}")
    lists = {k: [str(x) for x in raw.get(k) or []] for k in ("paths", "forbidden_modules", "required_modules", "allowed_functions")}
    most = raw.get("max_lines")
    if most is not None and not compat and int(most) <= 0:
        raise ConfigError("max_lines is a positive number")
    mode = raw.get("mode")
    if mode is not None and not compat and mode not in ("all", "public_only", "separate"):
        raise ConfigError(f"unknown mode {mode!r}")
    extra = {} if compat else {"mode": mode, "max_lines": None if most is None else int(most)}
    return Rule(str(raw.get("type") or ""), pattern=raw.get("pattern"), uses_module=raw.get("uses_module"), recursive=bool(raw.get("recursive")), **lists, **extra)


def parse_rules(text: str, *, compat: bool = False) -> list[Rule]:
    """The rules of a YAML text; an empty text has none."""
    import yaml

    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"config load failed: {e}") from None
    if data is None:
        return []
    if not isinstance(data, dict):
        raise ConfigError("config load failed: no mapping at the top")
    return [rule_from(r, compat=compat) for r in data.get("rules") or []]


def load_rules(path: str, spark: SparkSession | None = None, *, compat: bool = False) -> list[Rule]:
    """Rules of one file; with a session, from any store that Spark reads."""
    try:
        text = spark.read.text(path, wholetext=True).first().value if spark else Path(path).read_text()
    except Exception as e:
        raise ConfigError(f"config load failed: {type(e).__name__}: {path}") from None
    return parse_rules(text, compat=compat)


def candidate_paths(cwd: str, name: str = CONFIG_NAME) -> list[Path]:
    """The folder's own file; in an umbrella of apps, the one two folders up as well."""
    here = Path(cwd)
    found = [here / name] + ([here / ".." / ".." / name] if (here / "apps").exists() else [])
    return list(dict.fromkeys(found))


def discover(cwd: str, name: str = CONFIG_NAME, *, compat: bool = False) -> list[Rule]:
    """The rules of the first candidate that exists; none without one."""
    path = next((p for p in candidate_paths(cwd, name) if p.exists()), None)
    return load_rules(str(path), compat=compat) if path else []


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """One row per rule, patterns compiled once on the driver."""
    rows = [
        (i, r.type, r.paths, r.pattern, r.uses_module, r.forbidden_modules, r.required_modules, r.allowed_functions, r.recursive, r.mode, r.max_lines,
         [path_glob(p, r.recursive) for p in r.paths], module_glob(r.pattern) if r.pattern is not None else None)
        for i, r in enumerate(rules)
    ]
    return spark.createDataFrame(rows, RULES)
