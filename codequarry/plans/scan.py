"""The whole scan: rules, then filters, as one declarative plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from codequarry.operators import block_rules, declarations, file_rules, flow_rules, issue_filters, line_rules, parsed_rules, projects, symbols


@dataclass(frozen=True)
class Options:
    only: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    strict: bool = False
    least_confidence: str = "low"
    ignore_paths: tuple[str, ...] = ()
    #: Whether unused-declaration judges every kind of declaration, or only Python's plain imports.
    every_declaration: bool = False


FILE_RULES = {
    "resource-leak": file_rules.resource_leaks,
    "package-hallucination": file_rules.unknown_packages,
    "unused-declaration": file_rules.unused_imports,
    "weak-validation": block_rules.weak_validation,
    "narrative-comments": block_rules.narrative_comments,
    "dead-code": symbols.dead_code,
    "swallowed-error": flow_rules.swallowed_errors,
}


def issues(files: DataFrame, options: Options = Options(), declared: DataFrame | None = None, listing: DataFrame | None = None) -> DataFrame:
    """Only the branches of enabled rules are planned.

    ``declared`` has what manifests declare: path, language, name. ``listing`` has every file of the projects: project,
    path, source; with it, or where only ``structure`` is asked for (then the files are all), the projects' gaps are found.
    """
    enabled = lambda r: r in options.only if options.only else r not in options.skip
    rules = FILE_RULES | ({"unused-declaration": declarations.unused_declarations} if options.every_declaration else {})
    parts = [f(files, declared) if r == "package-hallucination" else f(files) for r, f in rules.items() if enabled(r)]
    parts += parsed_rules.issues(files, {r for r in parsed_rules.BY_SCOPES | parsed_rules.BY_TREE if enabled(r)})
    if any(enabled(r.rule) for r in line_rules.RULES):
        parts.append(line_rules.line_issues(files, options.only, options.skip))
    if enabled("structure") and (listing is not None or options.only == ("structure",)):
        parts.append(projects.structure(files if listing is None else listing))
    if not parts:
        raise ValueError("no rule is enabled")
    out = parts[0].select(*line_rules.ISSUE)
    for p in parts[1:]:
        out = out.unionByName(p.select(*line_rules.ISSUE))
    out = issue_filters.ignore_paths(issue_filters.min_confidence(out, options.least_confidence), list(options.ignore_paths))
    return issue_filters.strict(out) if options.strict else out
