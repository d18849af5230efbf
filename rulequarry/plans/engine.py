"""Rules over a corpus: which rule holds for which file, all checks, one table of issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulequarry.operators.checks import ISSUES, NEEDS, REGISTRY, Compat
from rulequarry.operators.facts import Facts
from rulequarry.session import Scratch, ship
from rulequarry.sources.config import ConfigError, Rule, discover, rules_table

#: Rules are configuration; beyond this number their table is joined without a broadcast. Up to the other number their patterns are literals of one
#: projection, compiled once; more would make a plan too large, and are told by a join. The result is the same.
BROADCAST_RULES = 10_000
LITERAL_RULES = 256


def _holding(df: DataFrame, small: DataFrame, n_rules: int, column: str, pattern: str) -> DataFrame:
    """Rows of ``df`` beside the rules of which a pattern (an array or one) holds for ``column``."""
    if n_rules > LITERAL_RULES:
        return df.join(small, F.expr(f"exists({pattern}, r -> {column} rlike r)" if pattern == "path_regexes" else f"{column} rlike {pattern}"))
    own = [(r.rule_id, x if isinstance(x, list) else [x]) for r in small.select("rule_id", F.col(pattern).alias("x")).collect() if (x := r.x)]
    marks = [F.when(reduce(Column.__or__, [F.col(column).rlike(x) for x in regexes]), F.lit(i)) for i, regexes in own]
    held = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<int>")
    return df.withColumn("rule_id", F.explode(held)).join(small, "rule_id").select(*df.columns, *small.columns)


def match_rules(rules: DataFrame, facts: Facts, n_rules: int, compat: Compat = Compat()) -> DataFrame:
    """Rules beside the files that they hold for: by path patterns; without paths by module name, and else by a used module.

    With ``compat.selectors`` a rule without paths holds for no file.
    """
    small = F.broadcast(rules) if n_rules <= BROADCAST_RULES else rules
    files = facts.files.select("path")
    by_path = _holding(files, small, n_rules, "path", "path_regexes")
    if compat.selectors:
        return by_path
    rest = small.where(F.size("paths") == 0)
    asked = rest.agg(F.count("module_regex").alias("by_module"), F.count_if(F.col("module_regex").isNull()).alias("by_use")).first()
    found = by_path
    if asked["by_module"]:  # else no file need be parsed for this
        found = found.unionByName(_holding(facts.modules.select("path", "module"), rest.where("module_regex is not null"), n_rules, "module", "module_regex").drop("module"))
    if asked["by_use"]:
        found = found.unionByName(facts.uses.join(rest.where("module_regex is null"), F.col("used") == F.col("uses_module")).drop("used"))
    return found


def run_checks(files: DataFrame, rules: list[Rule], *, compat: Compat = Compat(), checks: dict | None = None, tree: DataFrame | None = None, matched_by_path: bool = True) -> DataFrame:
    """All issues of ``files(path, source[, file_ord])`` under the rules. ``checks``: by rule type, all known ones by default; further checks may be added.

    Files are parsed once into a written table, if a rule or check asks for their trees, and the issues of each check are written before the next. ``matched_by_path=False`` skips rule selection and holds every rule against every file. A null source
    is an empty text; a file that can't be parsed gets only issues of text checks; unknown rule types have none.
    """
    spark = files.sparkSession
    ship(spark)
    scratch = Scratch(spark, "checks")
    known = REGISTRY if checks is None else checks
    files = files.withColumn("source", F.coalesce("source", F.lit("")))
    files = scratch.keep(files)  # several checks read the texts, which may be costly to make
    wanted = [t for t in known if any(r.type == t for r in rules)]
    if tree is None and wanted and all(known[t] in NEEDS for t in wanted) and (not matched_by_path or all(r.paths for r in rules)):
        facts = Facts.written(files, scratch, " or ".join(NEEDS[known[t]] for t in wanted))
        facts.scratch = scratch
    else:
        facts = Facts(files, tree, scratch)
    table = rules_table(spark, rules)
    matched = match_rules(table, facts, len(rules), compat) if matched_by_path else files.select("path").crossJoin(F.broadcast(table))
    matched = scratch.keep(matched).hint("merge")  # as many rows as files and rules, which compress well
    found = []
    for t in wanted:  # one after the other: a plan of all checks takes much of the driver's memory
        found.append(scratch.keep(known[t](facts, matched.where(F.col("type") == t), scratch, compat).select(*ISSUES)))
        scratch.tidy()
    if not found:
        return spark.createDataFrame([], "check string, rule_id int, category string, path string, line_no int, trigger string, message string")
    return reduce(DataFrame.unionByName, found)


def run_project(files: DataFrame, cwd: str, *, on_config_error: str = "raise", **how) -> DataFrame:
    """The rules found from a folder, over the files. ``on_config_error='skip'``: rules that can't be read are none."""
    try:
        rules = discover(cwd)
    except ConfigError:
        if on_config_error != "skip":
            raise
        rules = []
    return run_checks(files, rules, **how)
