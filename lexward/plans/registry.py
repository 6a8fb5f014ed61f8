"""The pattern library: loading, validation, and compilation into what a scan needs."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lexward.functions.dialect import DialectError, expand_phrase, to_java

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
RANK = {s: i for i, s in enumerate(SEVERITIES)}

EMBEDDED = Path(__file__).parent.parent / "data"


@dataclass(frozen=True)
class Pattern:
    id: str
    name: str
    pattern: str
    severity: str | None = None
    case_sensitive: bool | None = None
    description: str = ""
    remediation: str = ""
    tags: tuple[str, ...] = ()


@dataclass(frozen=True)
class Category:
    category: str
    default_severity: str
    patterns: tuple[Pattern, ...] = ()


@dataclass(frozen=True)
class Compiled:
    """An accepted pattern with what follows from it: the order, the resolved severity and Spark's regular expression."""

    ord: int
    id: str
    name: str
    category: str
    severity: str
    case_sensitive: bool
    pattern: str
    java: str
    message: str
    remediation: str
    tags: tuple[str, ...]


class PatternError(Exception):
    """kind is ParseError, InvalidRegex or DuplicateId."""

    def __init__(self, kind: str, detail: str, id: str = "", first: str = "", second: str = ""):
        super().__init__(kind, detail, id, first, second)
        self.kind, self.detail, self.id, self.first_category, self.second_category = kind, detail, id, first, second

    def __str__(self) -> str:
        if self.kind == "DuplicateId":
            return f"pattern id {self.id} of category {self.second_category} is taken by category {self.first_category}"
        if self.kind == "InvalidRegex":
            return f"pattern {self.id} has an invalid regular expression: {self.detail}"
        return f"patterns can't be read: {self.detail}"


@dataclass
class Loaded:
    categories: list[Category] = field(default_factory=list)
    errors: list[PatternError] = field(default_factory=list)


_FIELDS = {"id": str, "name": str, "pattern": str, "severity": str, "case_sensitive": bool, "description": str, "remediation": str, "tags": list}


def _closed(node, allowed, required, where: str) -> dict:
    if not isinstance(node, dict):
        raise PatternError("ParseError", f"{where} is no mapping")
    for key in node:
        if key not in allowed:
            raise PatternError("ParseError", f"{where} has the unknown field {key!r}")
    for key in required:
        if node.get(key) is None:
            raise PatternError("ParseError", f"{where} lacks {key!r}")
    return node


def _severity(value, where: str) -> str:
    if value not in RANK:
        raise PatternError("ParseError", f"{where} has the unknown severity {value!r}")
    return value


def parse_category(text: str, where: str, phrases: bool = False) -> Category:
    """A category of a YAML document with a closed schema; phrases: the embedded files' own notation."""
    try:
        node = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise PatternError("ParseError", f"{where}: {' '.join(str(e).split())}") from e
    listed, body = ("phrases", "phrase") if phrases else ("patterns", "pattern")
    _closed(node, {"category", "default_severity", listed}, ("category", "default_severity", listed), where)
    if not isinstance(node["category"], str) or not isinstance(node[listed], list):
        raise PatternError("ParseError", f"{where}: a field has the wrong type")
    patterns = []
    for i, item in enumerate(node[listed]):
        here = f"{where}: pattern {i + 1}"
        _closed(item, {*_FIELDS, body} - ({"pattern"} if phrases else set()), ("id", "name", body), here)
        item = {("pattern" if k == body else k): v for k, v in item.items()}
        for key, value in item.items():
            optional = key in ("severity", "case_sensitive")
            if not (isinstance(value, _FIELDS[key]) or value is None and optional):
                raise PatternError("ParseError", f"{here}: {key!r} has the wrong type")
        if any(not isinstance(t, str) for t in item.get("tags", [])):
            raise PatternError("ParseError", f"{here}: a tag is no string")
        if item.get("severity") is not None:
            _severity(item["severity"], here)
        if phrases:
            item["pattern"] = expand_phrase(item["pattern"])
        patterns.append(Pattern(**{**item, "tags": tuple(item.get("tags", ()))}))
    return Category(node["category"], _severity(node["default_severity"], where), tuple(patterns))


@functools.cache
def load_embedded() -> tuple[Category, ...]:
    return tuple(parse_category(p.read_text(encoding="utf-8"), p.name, phrases=True) for p in sorted(EMBEDDED.glob("*.yaml")))


def load_external(folder: str | Path | None) -> Loaded:
    """Categories of a folder's own .yaml and .yml files by name; a file that can't be read is an error of its own.

    A folder that isn't there has none.
    """
    out = Loaded()
    folder = Path(folder) if folder is not None else None
    if folder is None or not folder.exists():
        return out
    try:
        files = sorted(p for p in folder.iterdir() if p.suffix in (".yaml", ".yml"))
    except OSError as e:
        out.errors.append(PatternError("ParseError", f"{folder}: {e.strerror}"))
        return out
    for path in files:
        try:
            out.categories.append(parse_category(path.read_text(encoding="utf-8"), str(path)))
        except PatternError as e:
            out.errors.append(e)
        except (OSError, UnicodeDecodeError) as e:
            out.errors.append(PatternError("ParseError", f"{path}: {getattr(e, 'strerror', None) or 'not UTF-8'}"))
    return out


def load_all(folder: str | Path | None = None) -> Loaded:
    """The embedded categories, then the external ones."""
    external = load_external(folder)
    return Loaded([*load_embedded(), *external.categories], external.errors)


def compile_lenient(categories) -> tuple[list[Compiled], list[PatternError]]:
    """Accepted patterns in order, and an error for each that isn't. The first to claim an id keeps it, valid or not."""
    accepted: list[Compiled] = []
    errors: list[PatternError] = []
    claimed: dict[str, str] = {}
    for category in categories:
        for p in category.patterns:
            if p.id in claimed:
                errors.append(PatternError("DuplicateId", "", p.id, claimed[p.id], category.category))
                continue
            claimed[p.id] = category.category
            sensitive = bool(p.case_sensitive)
            try:
                java = to_java(p.pattern, sensitive)
            except (DialectError, RecursionError) as e:
                errors.append(PatternError("InvalidRegex", str(e), p.id))
                continue
            accepted.append(Compiled(len(accepted), p.id, p.name, category.category, p.severity or category.default_severity, sensitive, p.pattern, java, p.description, p.remediation, p.tags))
    return accepted, errors


def compile_strict(categories) -> list[Compiled]:
    """Accepted patterns; the first error is raised."""
    accepted, errors = compile_lenient(categories)
    if errors:
        raise errors[0]
    return accepted


@functools.cache
def embedded() -> tuple[Compiled, ...]:
    return tuple(compile_strict(load_embedded()))


_ROW = T.StructType(
    [
        T.StructField("ord", T.IntegerType(), False),
        *[T.StructField(c, T.StringType(), c in ("severity",)) for c in ("category", "default_severity", "id", "name", "pattern", "severity")],
        T.StructField("case_sensitive", T.BooleanType(), True),
        *[T.StructField(c, T.StringType(), False) for c in ("description", "remediation")],
        T.StructField("tags", T.ArrayType(T.StringType(), False), False),
    ]
)

_ERROR = T.StructType([T.StructField(c, T.StringType(), False) for c in ("error_kind", "id", "detail", "first_category", "second_category")])


def registry(spark: SparkSession, categories=None) -> DataFrame:
    """One row a pattern as declared, in order; severity and case_sensitive are null where left to the defaults."""
    rows = [
        (c.category, c.default_severity, p.id, p.name, p.pattern, p.severity, p.case_sensitive, p.description, p.remediation, list(p.tags))
        for c in (load_embedded() if categories is None else categories)
        for p in c.patterns
    ]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], _ROW)


def errors_table(spark: SparkSession, errors) -> DataFrame:
    return spark.createDataFrame([(e.kind, e.id, e.detail, e.first_category, e.second_category) for e in errors], _ERROR)
