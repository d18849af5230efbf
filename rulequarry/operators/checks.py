"""The checks: each is a plan from facts and the rule-file pairs ``matched`` to issues.

``matched`` has ``rule_id, path`` and the rule's columns. Issues have ``check, rule_id, category, path, line_no, trigger, message``. Checks that are told
once for a file have a null ``rule_id``. Joins are on the file's path, with tree intervals as a residual, so work is split by file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulequarry.functions.patterns import is_code_line
from rulequarry.operators.facts import Facts, below, children, with_child
from rulequarry.operators.graph import chain_text, first_paths
from rulequarry.session import Scratch

ISSUES = ["check", "rule_id", "category", "path", "line_no", "trigger", "message"]
#: Forms that count as control flow besides pipe chains, comparison operators, modes, and the default size limit.
CONTROL = ("cond", "with", "case", "if", "unless", "for", "receive")
COMPARISONS = ("==", "!=", "===", "!==", "<", ">", "<=", ">=")
MAX_LINES = 400


@dataclass(frozen=True)
class Compat:
    """Where the original behaves otherwise than it documents, True takes its behaviour.

    selectors: rules without paths match no file; guards: a guarded head is named ``when``; underscore: names other than variables may
    discard; blank_head: a text head's line is where its pattern begins, blank lines included.
    """

    selectors: bool = False
    guards: bool = False
    underscore: bool = False
    blank_head: bool = False


def issue(df: DataFrame, check: str, category: str, line: Column | str, trigger: Column | str, message: Column, rule: bool = True) -> DataFrame:
    number = F.col("rule_id") if rule else F.lit(None).cast("int")
    line = F.col(line) if isinstance(line, str) else line
    trigger = F.col(trigger) if isinstance(trigger, str) else trigger
    return df.select(F.lit(check).alias("check"), number.alias("rule_id"), F.lit(category).alias("category"), "path", line.cast("int").alias("line_no"), trigger.alias("trigger"), message.alias("message"))


def told(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def within(outer: DataFrame, inner: DataFrame, first: str, last: str, place: str, how: str = "inner") -> DataFrame:
    """Rows of one path whose ``place`` lies in [first, last]."""
    inner = inner.withColumnRenamed("path", "_path")
    return outer.join(inner, (F.col("path") == F.col("_path")) & F.col(place).between(F.col(first), F.col(last)), how).drop("_path")


# set membership


def forbidden_direct(deps: DataFrame, matched: DataFrame) -> DataFrame:
    """Each forbidden module among a file's direct dependencies, with the line of its last reference."""
    wanted = matched.select("rule_id", "path", F.explode("forbidden_modules").alias("dep"))
    return wanted.join(deps, ["path", "dep"]).select("rule_id", "path", "dep", "last_line")


def no_direct_dependency(facts: Facts, matched: DataFrame, scratch: Scratch, compat: Compat) -> DataFrame:
    found = forbidden_direct(facts.deps, matched)
    return issue(found, "no_direct_dependency", "design", "last_line", "dep", told("Module has forbidden direct dependency on ", F.col("dep")))


def missing_uses(uses: DataFrame, matched: DataFrame) -> DataFrame:
    wanted = matched.select("rule_id", "path", F.explode("required_modules").alias("used"))
    return wanted.join(uses, ["path", "used"], "left_anti")


def must_use_module(facts: Facts, matched: DataFrame, scratch: Scratch, compat: Compat) -> DataFrame:
    """A file that can't be parsed has no issue: nothing is known of it."""
    known = matched.join(facts.status.where("parse_status = 'ok'").select("path"), "path", "left_semi")
    return issue(missing_uses(facts.uses, known), "must_use_module", "design", F.lit(1), "used", told("Module must use ", F.col("used")))


def disallowed_names(names: DataFrame, matched: DataFrame) -> DataFrame:
    """``names(path, name, line, pre)``: each distinct name that the rule doesn't allow, with the line of its last definition."""
    last = names.groupBy("path", "name").agg(F.max_by("line", "pre").alias("line"))
    return last.join(matched.select("rule_id", "path", "allowed_functions"), "path").where(~F.array_contains("allowed_functions", F.col("name"))).select("rule_id", "path", "name", "line")


def module_pattern_restrictions(facts: Facts, matched: DataFrame, scratch: Scratch, compat: Compat) -> DataFrame:
    name = F.col("raw_name" if compat.guards else "name").alias("name")
    found = disallowed_names(facts.defs.where("kind in ('def', 'defp')").select("path", name, "line", "pre"), matched.withColumn("allowed_functions", F.coalesce("allowed_functions", F.array().cast("array<string>"))))
    return issue(found, "module_pattern_restrictions", "design", "line", "name", told("Module defines non-allowed function: ", F.col("name")))


# the graph of modules


def no_transitive_dependency(facts: Facts, matched: DataFrame, scratch: Scratch, compat: Compat) -> DataFrame:
    edges = scratch.keep(facts.edges)
    wanted = matched.join(facts.modules.select("path", "module"), "path").select("rule_id", "path", F.col("module").alias("start"), F.explode("forbidden_modules").alias("target"))
    wanted = scratch.keep(wanted.where("start <> target"))
    paths = scratch.keep(first_paths(edges, wanted.select("start", "target"), scratch)).withColumnRenamed("path", "chain")
    found = wanted.join(paths, ["start", "target"]).withColumn("dep", F.element_at("chain", 2)).join(facts.deps, ["path", "dep"], "left")
    return issue(found, "no_transitive_dependency", "design", "last_line", "target", told("Module has transitive dependency on forbidden module ", F.col("target"), chain_text(F.col("chain"))))


# trees


def control_flow_counts(clauses: DataFrame, tree: DataFrame) -> DataFrame:
    """Clauses beside the number of control structures below their bodies; a chain of pipes counts once."""
    marked = tree.where(F.col("form").isin(*CONTROL, "|>") & (F.col("kind") != "literal")).select("path", "pre", "form")
    left = children(tree.where("form = '|>' and kind = 'call'"), "left", 0).select("path", F.col("left_parent").alias("pre"))
    marked = marked.where("form <> '|>'").union(marked.where("form = '|>'").join(left, ["path", "pre"], "left_anti"))
    inside = within(clauses, marked.select("path", F.col("pre").alias("at")), "body_pre", "body_last", "at")
    return inside.groupBy("path", "pre", "name", "line").agg(F.count("*").alias("n"))


def single_control_flow(facts: Facts, matched: DataFrame, scratch: Scratch, compat: Compat) -> DataFrame:
    name = F.col("raw_name" if compat.guards else "name").alias("name")
    counts = control_flow_counts(facts.clauses.select("path", "pre", name, "line", "body_pre", "body_last"), facts.tree).where("n > 1")
    found = matched.select("rule_id", "path").join(counts, "path")
    text = told(
        "Function clause `", F.col("name"), "` contains ", F.col("n").cast("string"), " control-flow structures (maximum allowed: 1). Control-flow structures include: pipe chains (|>), cond, with, case, if, unless, for, "
        "and receive. Favor extracting pipe chains to helpers before extracting other structures.",
    )
    return issue(found, "single_control_flow", "design", "line", "name", text)


def bare_cases(clauses: DataFrame, bare_args: DataFrame, cases: DataFrame) -> DataFrame:
    """``cases(path, at, line, arg)``: those in the body of a clause that has ``arg`` as a plain parameter."""
    owners = clauses.join(bare_args.withColumnRenamed("def_pre", "pre"), ["path", "pre"])
    cases = cases.select(F.col("path").alias("_path"), "at", F.col("line").alias("case_line"), F.col("arg").alias("_arg"))
    return owners.join(cases, (F.col("path") == F.col("_path")) & (F.col("arg") == F.col("_arg")) & F.col("at").between(F.col("body_pre"), F.col("body_last"))).select("path", "name", "arg", "case_line")


def case_on_bare_arg(facts: Facts, matched: DataFrame, scratch: Scratch, compat: Compat) -> DataFrame:
    cases = with_child(facts.tree.where("form = 'case' and kind = 'call' and arg_count = 2").select("path", "pre", "line"), facts.tree, "subject", 0, where="up_form = 'case'")
    cases = cases.where("subject_kind = 'var'").select("path", F.col("pre").alias("at"), "line", F.col("subject_form").alias("arg"))
    found = bare_cases(facts.clauses.select("path", "pre", "name", "body_pre", "body_last"), facts.bare_args, cases)
    found = found.join(matched.select("path").distinct(), "path", "left_semi")
    text = told("Case statement operates on bare argument `", F.col("arg"), "` in function `", F.col("name"), "`. Consider using function head pattern matching instead.")
    return issue(found, "case_on_bare_arg", "design", "case_line", F.lit("case"), text, rule=False)


def no_comparison_in_if(facts: Facts, matched: DataFrame, scratch: Scratch, compat: Compat) -> DataFrame:
    tests = with_child(facts.tree.where("form = 'if' and kind = 'call' and arg_count = 2").select("path", "pre", "line"), facts.tree, "test", 0, where="up_form = 'if'")
    compared = facts.tree.where(F.col("form").isin(*COMPARISONS) & (F.col("arg_count") == 2)).select("path", F.col("pre").alias("at"))
    hit = within(tests, compared, "test_pre", "test_last", "at", "left_semi")
    found = matched.select("rule_id", "path").join(hit.select("path", "line"), "path")
    text = F.lit("Avoid direct comparisons in `if` statements. Extract the comparison to a function in the appropriate module with a descriptive name.")
    return issue(found, "no_comparison_in_if", "readability", "line", F.lit("if"), text)


def _behind_guards(tree: DataFrame, found: DataFrame) -> DataFrame:
    """``path, pattern_pre, plain``: what stands before any number of nested guards. A node's first child has the next number, so of a guard it is the
    next node that isn't one itself."""
    guard = F.coalesce((F.col("form") == "when") & (F.col("kind") == "call"), F.lit(False))
    paths = found.where("pattern_form = 'when' and pattern_kind = 'call'").select("path").distinct()
    plain = F.last(F.when(~guard, F.struct("form", "kind")), ignorenulls=True).over(Window.partitionBy("path").orderBy(F.desc("pre")))
    return below(tree, "(form = 'when' and kind = 'call') or (up_form = 'when' and ord = 0)").join(paths, "path", "left_semi").withColumn("plain", plain).where(guard).select("path", F.col("pre").alias("pattern_pre"), "plain")


def no_discarding_arrow_in_with(facts: Facts, matched: DataFrame, scratch: Scratch, compat: Compat) -> DataFrame:
    tree = facts.tree
    withs = tree.where("form = 'with' and kind = 'call' and arg_count >= 2").select("path", "pre")
    lists = below(tree, "kind = 'list' and up_form = 'with'").where("kind = 'list'")
    first = with_child(lists.select("path", "pre", F.col("parent").alias("with_pre"), F.col("ord").alias("do_ord")), tree, "pair", 0, where="up2_form = 'with'").where("pair_kind = 'pair'")
    first = with_child(first, tree, "key", 0, "pair_pre", where="lit_type = 'atom' and lit = 'do'").where("key_lit_type = 'atom' and key_lit = 'do'")
    dos = first.groupBy("path", F.col("with_pre").alias("pre")).agg(F.min("do_ord").alias("do_ord"))
    arrow = children(tree.where("form = '<-' and kind = 'call' and arg_count = 2"), "arrow").withColumnRenamed("arrow_parent", "pre")
    found = withs.join(dos, ["path", "pre"]).join(arrow, ["path", "pre"]).where("arrow_ord < do_ord")
    found = with_child(found, tree, "pattern", 0, "arrow_pre", where="up_form = '<-'")
    found = found.join(_behind_guards(tree, found), ["path", "pattern_pre"], "left")
    found = found.withColumns({f"pattern_{c}": F.when(F.col("plain").isNotNull(), F.col(f"plain.{c}")).otherwise(F.col(f"pattern_{c}")) for c in ("form", "kind")})
    kinds = ("var", "call") if compat.underscore else ("var",)
    found = found.where(F.col("pattern_kind").isin(*kinds) & F.col("pattern_form").startswith("_"))
    found = found.join(matched.select("path").distinct(), "path", "left_semi")
    text = told("Unnecessary arrow (<-) in with clause. Pattern `", F.col("pattern_form"), "` only discards the value. Remove the arrow and pattern to simplify")
    return issue(found, "no_discarding_arrow_in_with", "refactoring", "arrow_line", "pattern_form", text, rule=False)


def _only_do(nodes: DataFrame, tree: DataFrame, prefix: str, forms: str, where: str) -> DataFrame:
    """Nodes whose second argument is a list of nothing but a do part, beside that part. ``forms``: what the nodes' own may be; ``where``: what holds of the parts asked for."""
    lists = with_child(nodes, tree, "list", 1, where=f"kind = 'list' and arg_count = 1 and up_form in {forms}").where("list_kind = 'list' and list_arg_count = 1")
    pairs = with_child(lists, tree, "pair", 0, "list_pre", where=f"kind = 'pair' and up2_form in {forms}").where("pair_kind = 'pair'")
    keyed = with_child(pairs, tree, "key", 0, "pair_pre", where="lit_type = 'atom' and lit = 'do'").where("key_lit_type = 'atom' and key_lit = 'do'")
    part = with_child(keyed, tree, prefix, 1, "pair_pre", where=where)
    return part.select(*nodes.columns, *(c for c in part.columns if c.startswith(f"{prefix}_")))


def struct_getter_convention(facts: Facts, matched: DataFrame, scratch: Scratch, compat: Compat) -> DataFrame:
    tree = facts.tree
    bodies = _only_do(tree.where("pre = 0 and form = 'defmodule' and arg_count = 2").select("path", "pre"), tree, "body", "('defmodule')", "depth = 3")
    block = (F.col("body_form") == "__block__") & (F.col("body_kind") == "call")
    inner = children(tree.where("depth in (3, 4)"), "top").withColumnRenamed("path", "_path")  # the part of a module, or the statements of its block
    tops = bodies.join(inner, (F.col("path") == F.col("_path")) & F.when(block, F.col("top_parent") == F.col("body_pre")).otherwise(F.col("top_pre") == F.col("body_pre")))
    tops = tops.select("path", F.col("top_pre").alias("pre"), F.col("top_form").alias("form"), F.col("top_kind").alias("kind"), F.col("top_arg_count").alias("arg_count"), F.col("top_line").alias("line"))
    structs = with_child(tops.where("form = 'defstruct' and kind = 'call' and arg_count = 1"), tree, "fields", 0, where="up_form = 'defstruct'").where("fields_kind = 'list'")
    structs = structs.groupBy("path").agg(F.min_by("fields_pre", "pre").alias("fields_pre"))
    entry = children(below(tree, "up2_form = 'defstruct'"), "entry").withColumnRenamed("entry_parent", "fields_pre")
    name = children(tree.where("lit_type = 'atom' and depth in (6, 7)"), "field", 0).select("path", F.col("field_parent").alias("entry_pre"), "field_lit_type")
    entries = structs.join(entry, ["path", "fields_pre"]).join(name, ["path", "entry_pre"], "left")
    named = entries.where("(entry_kind = 'literal' and entry_lit_type = 'atom') or (entry_kind = 'pair' and field_lit_type = 'atom')").select("path").distinct()

    functions = tops.where("form in ('def', 'defp') and arg_count = 2").join(named, "path", "left_semi")
    heads = with_child(functions.select("path", "pre", "line"), tree, "head", 0, where="up_form in ('def', 'defp')").where("head_kind = 'call' and head_arg_count = 1 and head_form not in ('.()', '()()')").select("path", "pre", "line", "head_pre", "head_form")
    heads = _only_do(heads, tree, "result", "('def', 'defp')", "kind = 'var'").where("result_kind = 'var'").select("path", "pre", "line", "head_pre", "head_form", "result_form")
    heads = with_child(heads, tree, "arg", 0, "head_pre", where="form = '%'").where("arg_form = '%' and arg_kind = 'call'").select("path", "pre", "line", "head_form", "result_form", "arg_pre")
    heads = with_child(heads, tree, "module", 0, "arg_pre", where="form = '__MODULE__'").where("module_form = '__MODULE__'")
    heads = with_child(heads, tree, "map", 1, "arg_pre", where="form = '%{}'").where("map_form = '%{}'").select("path", "pre", "line", "head_form", "result_form", "map_pre")
    pairs = children(below(tree, "kind = 'pair' and up_form = '%{}'").where("kind = 'pair'"), "pair").withColumnRenamed("pair_parent", "map_pre")
    bound = with_child(heads.join(pairs, ["path", "map_pre"]), tree, "value", 1, "pair_pre", where="kind = 'var' and up2_form = '%{}'").where("value_kind = 'var' and value_form = result_form")
    bound = with_child(bound, tree, "key", 0, "pair_pre", where="up2_form = '%{}'")
    first = bound.groupBy("path", "pre", "line", "head_form").agg(F.min_by("key_lit", "pair_ord").alias("field"))
    found = first.where("head_form <> field").join(matched.select("path").distinct(), "path", "left_semi")
    text = told("Getter function `", F.col("head_form"), "` should be named `", F.col("field"), "` to match the field it extracts")
    return issue(found, "struct_getter_convention", "consistency", "line", "head_form", text, rule=False)


# text and order


def tuple_heads(heads: DataFrame) -> DataFrame:
    """Heads with an :ok or :error tuple as a direct argument and none inside a list or map."""
    a = F.col("args")
    return heads.where(a.rlike(r"(^|,)\s*\{:(ok|error)\s*,") & ~a.rlike(r"[\[%][^,\]]*\{:(ok|error)\s*,"))


def no_tuple_match_in_head(facts: Facts, matched: DataFrame, scratch: Scratch, compat: Compat) -> DataFrame:
    found = matched.select("rule_id", "path").join(tuple_heads(facts.text_heads), "path")
    seen = F.when(F.col("kind") == "def", "public").otherwise("private")
    text = told("Function `", F.col("name"), "` pattern matches on :ok/:error tuple in its ", seen, " function head. Consider having the calling function use a case statement on the value instead.")
    return issue(found, "no_tuple_match_in_head", "design", "start_line" if compat.blank_head else "line", "name", text)


def order_issues(functions: DataFrame, partition: list[str]) -> DataFrame:
    """Functions ``(path, name, arity, line, pre)`` whose place by line is not their place by (lower name, arity), beside the one before in that order.

    Equal records (same name, arity and line) share the place of the first."""
    actual = Window.partitionBy(*partition).orderBy("line", "pre")
    wanted = Window.partitionBy(*partition).orderBy(F.lower("name"), "arity", "line", "pre")
    same = Window.partitionBy(*partition, "name", "arity", "line")
    ranked = functions.withColumn("actual", F.row_number().over(actual)).withColumn("own", F.row_number().over(wanted))
    ranked = ranked.withColumn("before", F.lag(F.concat_ws("/", "name", "arity")).over(wanted)).withColumn("place", F.min("own").over(same))
    ranked = ranked.withColumn("before", F.min_by("before", "own").over(same))
    return ranked.where("actual <> place").withColumn("after", F.coalesce("before", F.lit("the beginning")))


def early_private(functions: DataFrame, partition: list[str]) -> DataFrame:
    """Private functions before the last public one."""
    last = F.max(F.when(F.col("visibility") == "public", F.col("line"))).over(Window.partitionBy(*partition))
    return functions.withColumn("last_public", last).where("visibility = 'private' and line < last_public")


def alphabetized_functions(facts: Facts, matched: DataFrame, scratch: Scratch, compat: Compat) -> DataFrame:
    functions = facts.defs.where("has_args_list and has_body").select("path", "name", "arity", "line", "pre", "visibility")
    rules = matched.select("rule_id", "path", F.coalesce("mode", F.lit("separate")).alias("mode"))
    rows = rules.join(functions, "path")
    shown = F.concat_ws("/", "name", "arity")

    def ordered(df: DataFrame, mark: Column, *partition: str) -> DataFrame:
        found = order_issues(df, ["rule_id", "path", *partition])
        return issue(found, "alphabetized_functions", "readability", "line", shown, told(mark, "function `", shown, "` is not in alphabetical order. It should appear after ", F.col("after"), "."))

    out = ordered(rows.where("mode = 'all'"), F.lit(""))
    out = out.union(ordered(rows.where("mode = 'public_only' and visibility = 'public'"), F.lit("public ")))
    out = out.union(ordered(rows.where("mode = 'separate'"), told(F.col("visibility"), " "), "visibility"))
    early = early_private(rows.where("mode = 'separate'"), ["rule_id", "path"])
    text = told("private function `", shown, "` appears before public functions. In :separate mode, all public functions must come before private functions.")
    return out.union(issue(early, "alphabetized_functions", "readability", "line", shown, text))


def code_line_counts(lines: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """``path, n_lines`` of lines that are neither blank nor comments nor in one of the ranges."""
    code = lines.where(is_code_line(F.col("text")))
    if ranges is not None:
        ranges = ranges.withColumnRenamed("path", "_path")
        code = code.join(ranges, (F.col("path") == F.col("_path")) & F.col("line_no").between(F.col("start_line"), F.col("end_line")), "left_anti")
    return code.groupBy("path").agg(F.count("*").alias("n_lines"))


def max_file_length(facts: Facts, matched: DataFrame, scratch: Scratch, compat: Compat) -> DataFrame:
    found = matched.select("rule_id", "path", F.coalesce("max_lines", F.lit(MAX_LINES)).alias("most")).join(code_line_counts(facts.lines, facts.doc_ranges), "path").where("n_lines > most")
    text = told("File contains ", F.col("n_lines").cast("string"), " lines of code (maximum allowed: ", F.col("most").cast("string"), "). Consider breaking this file into smaller, more focused modules.")
    return issue(found, "max_file_length", "readability", F.lit(1), "path", text)


#: All checks by rule type; the first seven are those that the original registers.
REGISTRY = {
    f.__name__: f
    for f in (
        no_direct_dependency, no_transitive_dependency, must_use_module, module_pattern_restrictions, single_control_flow, no_tuple_match_in_head, case_on_bare_arg,
        alphabetized_functions, max_file_length, no_comparison_in_if, no_discarding_arrow_in_with, struct_getter_convention,
    )
}
#: Tree rows that a check needs, where that is much less than all.
NEEDS = {no_discarding_arrow_in_with: "form in ('with', '<-', 'when') or up_form in ('with', '<-', 'when') or up2_form = 'with' or lit = 'do'"}
REGISTERED = tuple(REGISTRY)[:7]
