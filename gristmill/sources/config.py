"""Thresholds and gates: defaults, and TOML files over them, later ones winning."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

LANGUAGES = ("python", "php", "javascript", "typescript", "go")

#: Metric -> thresholds for LANGUAGES in order; None: not applicable.
DEFAULTS: dict[str, tuple[int | None, ...]] = {
    "imported_names_per_file": (20, 20, 20, 20, 20),
    "statements_per_file": (400, 400, 400, 400, 400),
    "functions_per_file": (30, 30, 30, 30, 30),
    "interface_types_per_file": (3, 3, 3, 5, 5),
    "concrete_types_per_file": (10, 10, 10, 10, 10),
    "statements_per_function": (35, 35, 35, 35, 35),
    "arguments_per_function": (7, 7, 7, 7, 7),
    "arguments_positional": (5, None, None, None, None),
    "arguments_keyword_only": (6, None, None, None, None),
    "max_indentation_depth": (4, 4, 4, 4, 4),
    "branches_per_function": (10, 10, 10, 10, 10),
    "local_variables_per_function": (20, 20, 20, 20, 20),
    "methods_per_class": (20, 20, 20, 20, 20),
    "returns_per_function": (5, 5, 5, 5, 5),
    "return_values_per_function": (3, None, None, None, 5),
    "nested_function_depth": (2, 2, 2, 2, None),
    "statements_per_try_block": (5, 5, 5, 5, None),
    "boolean_parameters": (1, 2, 2, 2, 2),
    "annotations_per_function": (3, 4, None, 4, None),
    "calls_per_function": (50, 50, 50, 50, 50),
    "cycle_size": (3, 3, 3, 3, 3),
    "indirect_dependencies": (100, 100, 100, 100, 100),
    "dependency_depth": (7, 7, 7, 7, 7),
}

#: Other names that files may use for a metric.
ALIASES = {
    "positional_args": "arguments_positional",
    "keyword_only_args": "arguments_keyword_only",
    "max_indentation": "max_indentation_depth",
    "local_variables": "local_variables_per_function",
    "decorators_per_function": "annotations_per_function",
    "attributes_per_function": "annotations_per_function",
    "arguments": "arguments_per_function",
    "classes_per_file": "concrete_types_per_file",
    "types_per_file": "concrete_types_per_file",
}
#: Keys that the shared section may have, and names that the thresholds section takes besides the metrics.
SHARED_KEYS = (
    "statements_per_file", "functions_per_file", "interface_types_per_file", "concrete_types_per_file", "types_per_file", "imported_names_per_file",
    "cycle_size", "indirect_dependencies", "dependency_depth",
)
THRESHOLD_ALIASES = ("classes_per_file",)
_SECTIONS = {"shared", "thresholds", "gate", *LANGUAGES}


@dataclass(frozen=True)
class Gate:
    coverage: int = 90
    min_similarity: float = 0.7
    duplication_enabled: bool = True
    orphan_module_enabled: bool = True


def _parsed(path: Path) -> dict:
    """{} for a file that is missing or isn't TOML."""
    try:
        return tomllib.loads(path.read_text("utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError):
        return {}


def _settings(section: object, keys: tuple[str, ...] | None = None) -> dict[str, int]:
    """Known metrics, of `keys` if given, with whole numbers from 0 on; all else is passed over."""
    found = {}
    for key, value in section.items() if isinstance(section, dict) else ():
        name = ALIASES.get(key, key)
        if (keys is None or key in keys) and name in DEFAULTS and isinstance(value, int) and value >= 0:
            found[name] = int(value)
    return found


def config_files(target: str | Path | None = None, explicit: str | Path | None = None, name: str = ".gristmill.toml") -> list[Path]:
    """Home, working directory, target, then the one asked for; each once."""
    files = [Path.home() / name, Path.cwd() / name]
    if target is not None and (own := Path(target) / name).resolve() != files[1].resolve():
        files.append(own)
    return files + ([Path(explicit)] if explicit is not None else [])


def load_thresholds(files: list[Path], languages: tuple[str, ...] = LANGUAGES) -> dict[str, dict[str, int | None]]:
    """lang -> metric -> threshold. In a file, shared goes before thresholds, and both before the language's own
    section; a file with an unknown section is left out as a whole. A language's section takes all metrics and aliases,
    the others their own keys."""
    out = {lang: {m: v[LANGUAGES.index(lang)] for m, v in DEFAULTS.items()} for lang in languages}
    for data in map(_parsed, files):
        if not set(data) <= _SECTIONS:
            continue
        for lang in languages:
            for section, keys in (("shared", SHARED_KEYS), ("thresholds", (*DEFAULTS, *THRESHOLD_ALIASES)), (lang, None)):
                out[lang] |= _settings(data.get(section), keys)
    return out


def load_gate(files: list[Path]) -> Gate:
    """The gate sections, unknown keys and values out of range passed over. Other sections may be unknown here."""
    gate = Gate()
    for data in map(_parsed, files):
        section = data.get("gate")
        for key, value in section.items() if isinstance(section, dict) else ():
            if key in ("coverage", "test_coverage_threshold") and isinstance(value, int) and not isinstance(value, bool) and 0 <= value <= 100:
                gate = replace(gate, coverage=value)
            elif key == "min_similarity" and isinstance(value, int | float) and not isinstance(value, bool) and 0 <= value <= 1:
                gate = replace(gate, min_similarity=float(value))
            elif key in ("duplication_enabled", "orphan_module_enabled") and isinstance(value, bool):
                gate = replace(gate, **{key: value})
    return gate


def threshold_table(spark: SparkSession, loaded: dict[str, dict[str, int | None]] | None = None) -> DataFrame:
    """thresholds(lang, metric, threshold): null where a metric doesn't apply; at most languages x metrics rows."""
    loaded = load_thresholds([]) if loaded is None else loaded
    rows = [(lang, m, v) for lang, metrics in loaded.items() for m, v in metrics.items()]
    return spark.createDataFrame(rows, "lang string, metric string, threshold bigint")


#: What rules say. {} is the language; the operator is < but for the gates'.
DEFINITIONS = (
    "DEFINITION: [file] A source file included in analysis.",
    "DEFINITION: [code_unit] A named unit of code within a file (module, class/type, function, or method) that metrics/violations attach to.",
    "DEFINITION: [statement] A statement inside a function/method body (not an import or a class/function signature).",
    "DEFINITION: [graph_node] A module (file) in the dependency graph.",
    "DEFINITION: [graph_edge] A dependency between two modules (file A depends on file B via imports/uses/mod declarations).",
)
RULES = {
    "statements_per_function": ("statements_per_function", "the maximum number of statements in a {} function/method body."),
    "positional_args": ("arguments_positional", "the maximum number of positional parameters in a {} function definition."),
    "keyword_only_args": ("arguments_keyword_only", "the maximum number of keyword-only parameters in a {} function definition."),
    "arguments_per_function": ("arguments_per_function", "the maximum number of parameters in a {} function."),
    "max_indentation_depth": ("max_indentation_depth", "the maximum indentation depth within a {} function/method body."),
    "branches_per_function": ("branches_per_function", "the number of branch statements in a {} function."),
    "local_variables_per_function": ("local_variables_per_function", "the number of distinct local variables in a {} function."),
    "returns_per_function": ("returns_per_function", "the number of return statements in a {} function."),
    "nested_function_depth": ("nested_function_depth", "the maximum nesting depth of function definitions inside a {} function."),
    "boolean_parameters": ("boolean_parameters", "the maximum number of boolean default parameters in a {} function."),
    "calls_per_function": ("calls_per_function", "the maximum number of function/method calls in a {} function."),
    "methods_per_class": ("methods_per_class", "the maximum number of methods defined on a {} class."),
    "statements_per_file": ("statements_per_file", "the maximum number of statements inside function/method bodies in a {} file."),
    "functions_per_file": ("functions_per_file", "the maximum number of functions/methods defined in a {} file."),
    "interface_types_per_file": ("interface_types_per_file", "the maximum number of interface types defined in a {} file."),
    "concrete_types_per_file": ("concrete_types_per_file", "the maximum number of concrete types defined in a {} file."),
    "imported_names_per_file": ("imported_names_per_file", "the maximum number of imported names in a {} file."),
    "cycle_size": ("cycle_size", "the maximum allowed number of modules participating in an import cycle."),
    "indirect_dependencies": ("indirect_dependencies", "the number of modules reachable only through other modules."),
    "dependency_depth": ("dependency_depth", "the maximum length of an import chain in the dependency graph."),
    "test_coverage_threshold": ("coverage", "the minimum percent of code units whose names must appear in a test file."),
    "min_similarity": ("min_similarity", "the minimum similarity required to report duplicate code."),
    "return_values_per_function": ("return_values_per_function", "the maximum number of values returned by a single return in a {} function."),
    "statements_per_try_block": ("statements_per_try_block", "the maximum number of statements inside any try block in a {} function."),
    "decorators_per_function": ("annotations_per_function", "the maximum number of decorators applied to a {} function."),
}
PYTHON_RULES = ("positional_args", "keyword_only_args", "return_values_per_function", "statements_per_try_block", "decorators_per_function")


def rules(loaded: dict[str, dict[str, int | None]], lang: str, gate: Gate = Gate()) -> list[str]:
    """One line for each rule of a language: Python has its own ones, and PHP, JavaScript and TypeScript count all arguments."""
    out, name = [], lang.capitalize()
    for rule, (metric, text) in RULES.items():
        if rule in PYTHON_RULES and lang != "python" or rule == "arguments_per_function" and lang in ("python", "go"):
            continue
        value = getattr(gate, metric) if hasattr(gate, metric) else loaded[lang][metric]
        if value is None:
            continue
        shown = f"{value:.2f}" if isinstance(value, float) else str(value)
        spoken = "JavaScript" if rule == "arguments_per_function" and lang == "javascript" else name
        out.append(f"RULE: [{name}] [{rule} {'>=' if hasattr(gate, metric) else '<'} {shown}] {rule} is {text.format(spoken)}")
    return out


def to_toml(values: dict[str, int], section: str = "thresholds") -> str:
    return "\n".join([f"[{section}]", *(f"{k} = {v}" for k, v in values.items())]) + "\n"
