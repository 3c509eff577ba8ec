"""Settings in layers and the table of corpus roots: strict readers on the driver, with frames for joins."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: A file of settings or roots that is larger isn't read.
MOST_BYTES = 1 << 20


class BadSettings(ValueError):
    """What's wrong with a file or a variable, by its place; values aren't repeated, they might be secrets."""


def strict_json(raw: bytes, name: str) -> dict[str, Any]:
    """An object, in UTF-8; a key that comes twice anywhere in it is refused."""

    def whole(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        found = dict(pairs)
        if len(found) < len(pairs):
            twice = next(k for k, _ in pairs if sum(k == other for other, _ in pairs) > 1)
            raise BadSettings(f"{name}: {twice!r} comes twice")
        return found

    if len(raw) > MOST_BYTES:
        raise BadSettings(f"{name}: too large")
    try:
        data = json.loads(raw.decode("utf-8-sig"), object_pairs_hook=whole)
    except json.JSONDecodeError as error:
        raise BadSettings(f"{name}: not JSON at line {error.lineno}, column {error.colno}") from None
    except (UnicodeDecodeError, RecursionError):
        raise BadSettings(f"{name}: can't be read") from None
    if not isinstance(data, dict):
        raise BadSettings(f"{name}: not an object")
    return data


@dataclass(frozen=True)
class Setting:
    """One setting: bool, int, float, str or list (of str), with a default and the range of numbers."""

    kind: type
    default: Any
    low: float | None = None
    high: float | None = None

    def checked(self, value: Any, where: str) -> Any:
        if self.kind is float and type(value) is int:
            value = float(value)
        right = type(value) is self.kind and (self.kind is not list or all(isinstance(x, str) for x in value))
        if not right:
            raise BadSettings(f"{where}: {self.kind.__name__} expected")
        if self.kind in (int, float) and not ((self.low is None or value >= self.low) and (self.high is None or value <= self.high)):
            raise BadSettings(f"{where}: {self.low} to {self.high} expected")
        return value

    def from_text(self, text: str, where: str) -> Any:
        if self.kind is bool:
            words = {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}
            if text.strip().lower() not in words:
                raise BadSettings(f"{where}: bool expected")
            return words[text.strip().lower()]
        if self.kind is list:
            return [x.strip() for x in text.split(os.pathsep) if x.strip()]
        try:
            return self.checked(self.kind(text.strip()), where)
        except ValueError as error:
            raise error if isinstance(error, BadSettings) else BadSettings(f"{where}: {self.kind.__name__} expected") from None


#: The engine's own settings.
SETTINGS = {
    "search_half_life_days": Setting(int, 540, 1, 100_000), "search_probes": Setting(int, 400, 1, 4096), "search_results": Setting(int, 10, 1, 20),
    "intake_quiet_seconds": Setting(int, 30, 0, 86_400), "cache_days": Setting(int, 7, 1, 365), "vision_pages": Setting(int, 60, 1, 10_000),
    "accept_score": Setting(float, 20.0, 0, 1000), "describe_pictures": Setting(bool, False), "mail_roots": Setting(list, []), "archive_name": Setting(str, ""),
}


def layered(schema: Mapping[str, Setting], file: bytes | None, env: Mapping[str, str], prefix: str) -> tuple[dict[str, Any], dict[str, str]]:
    """(values, where each is from): an environment variable before the file before the default; what the schema lacks is refused."""
    values = {k: s.default for k, s in schema.items()}
    origin = dict.fromkeys(schema, "default")
    for key, value in (strict_json(file, "settings file") if file is not None else {}).items():
        if key not in schema:
            raise BadSettings(f"settings file: {key!r} is unknown")
        values[key], origin[key] = schema[key].checked(value, key), "file"
    for key, setting in schema.items():
        name = prefix + key.upper()
        if name in env:
            values[key], origin[key] = setting.from_text(env[name], name), "env"
    return values, origin


def unused_names(schema: Mapping[str, Setting], env: Mapping[str, str], prefix: str) -> list[str]:
    """Variables of the prefix that no setting reads, sorted."""
    return sorted(n for n in env if n.startswith(prefix) and n.removeprefix(prefix).lower() not in schema)


KINDS = ("mail", "pages", "files")


@dataclass(frozen=True)
class Root:
    """One folder of the corpus. Rules give a base by the first that fits: words in the path, or a prefix of it."""

    kind: str
    source: str
    attachments: str = ""
    title: str = ""
    include: str | None = None
    exclude: str | None = None
    rules: tuple[tuple[tuple[str, ...], str, str], ...] = ()


@dataclass(frozen=True)
class Roots:
    roots: dict[str, Root] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)

    def bases(self, intake: str = "intake") -> list[str]:
        """Configured bases in the order they first appear, the intake's last."""
        seen = [b for r in self.roots.values() for b in (r.source, r.attachments, *(rule[2] for rule in r.rules)) if b]
        return [b for b in dict.fromkeys(seen) if b != intake] + [intake]

    def frame(self, spark: SparkSession) -> DataFrame:
        """root, kind, source, attachments, include, exclude, rank: a small table to join path components with."""
        rows = [(n, r.kind, r.source, r.attachments or r.source, r.include, r.exclude, k) for k, (n, r) in enumerate(self.roots.items())]
        return spark.createDataFrame(rows, "root string, kind string, source string, attachments string, include string, exclude string, rank int")


def parse_roots(raw: bytes | None) -> Roots:
    """The table of roots from its file; no file, no roots."""
    data = strict_json(raw, "roots file") if raw is not None else {}

    def table(value: Any, where: str) -> dict[str, Any]:
        if not isinstance(value, dict):
            raise BadSettings(f"{where}: not an object")
        return value

    def text(value: Any, where: str) -> str:
        if not isinstance(value, str) or not value.strip() or any(ord(c) < 32 for c in value):
            raise BadSettings(f"{where}: text expected")
        return value

    def known(entry: dict[str, Any], keys: set[str], where: str) -> dict[str, Any]:
        for key in entry.keys() - keys:
            raise BadSettings(f"{where}: {key!r} is unknown")
        return entry

    def rule(entry: Any, where: str) -> tuple[tuple[str, ...], str, str]:
        entry = known(table(entry, where), {"contains", "prefix", "source"}, where)
        if ("contains" in entry) == ("prefix" in entry):
            raise BadSettings(f"{where}: contains or prefix expected")
        words = entry.get("contains", [])
        if not isinstance(words, list) or "contains" in entry and not words:
            raise BadSettings(f"{where}: a list of words expected")
        return tuple(text(w, where) for w in words), entry.get("prefix", ""), text(entry.get("source"), where)

    known(data, {"roots", "labels", "aliases"}, "roots file")
    roots = {}
    for name, entry in table(data.get("roots", {}), "roots").items():
        entry = known(table(entry, name), {"kind", "source", "attachments", "title", "include", "exclude", "rules"}, name)
        if entry.get("kind") not in KINDS:
            raise BadSettings(f"{name}: kind is one of {', '.join(KINDS)}")
        if "/" in name or "\\" in name or name in ("", ".", ".."):
            raise BadSettings(f"{name}: not a folder's name")
        optional = {k: text(entry[k], f"{name}.{k}") for k in ("attachments", "title", "include", "exclude") if k in entry}
        rules = entry.get("rules", [])
        if not isinstance(rules, list):
            raise BadSettings(f"{name}.rules: a list expected")
        roots[name] = Root(entry["kind"], text(entry.get("source"), f"{name}.source"), rules=tuple(rule(r, f"{name}.rules") for r in rules), **optional)
    labels = {k: text(v, f"labels.{k}") for k, v in table(data.get("labels", {}), "labels").items()}
    aliases = {k: text(v, f"aliases.{k}") for k, v in table(data.get("aliases", {}), "aliases").items()}
    for old, new in aliases.items():
        if old in roots or new not in roots:
            raise BadSettings(f"aliases.{old}: an old name of a root expected")
    return Roots(roots, labels, aliases)
