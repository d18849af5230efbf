"""Facts about files, read from tree rows."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulequarry.session import Scratch
from rulequarry.sources import files as source

DEFINERS = ("def", "defp", "defmacro", "defmacrop")
_DEFINERS = "('def', 'defp', 'defmacro', 'defmacrop')"
#: Tree rows that a fact needs, for tables of less than the whole tree.
MODULE_ROWS = "parent <= 0"
USE_ROWS = "form = 'use' or up_form = 'use'"
DEF_ROWS = f"form in {_DEFINERS} or up_form in {_DEFINERS} or up_form = 'when'"
ARG_ROWS = f"{DEF_ROWS} or up2_form in {_DEFINERS} or up2_form = 'when'"
DOC_ROWS = "form = '@' or up_form = '@' or up2_form = '@'"


def children(tree: DataFrame, prefix: str, order: int | None = None) -> DataFrame:
    """Rows of the tree as children: ``path``, ``{prefix}_parent`` and the other columns with the prefix."""
    rows = tree if order is None else tree.where(F.col("ord") == order)
    return rows.select("path", *(F.col(c).alias(f"{prefix}_{c}") for c in rows.columns if c != "path"))


def below(tree: DataFrame, where: str) -> DataFrame:
    """The rows of the tree for which ``where`` holds; all of them, if it speaks of forms above that a tree made elsewhere hasn't. Only for rows that a
    join would leave out later."""
    return tree if "up" in where and "up_form" not in tree.columns else tree.where(where)


def with_child(nodes: DataFrame, tree: DataFrame, prefix: str, order: int, parent: str = "pre", how: str = "inner", where: str = "true") -> DataFrame:
    """Each node beside its argument number ``order``, by an equi-join on path and parent. ``where``: what holds of all arguments that are asked for."""
    child = children(below(tree, where), prefix, order).withColumnRenamed(f"{prefix}_parent", "_parent")
    return nodes.join(child.withColumnRenamed("_parent", parent + "_up").withColumnRenamed("path", "_path"), (F.col("path") == F.col("_path")) & (F.col(parent) == F.col(parent + "_up")), how).drop("_path", parent + "_up")


class Facts:
    """Fact tables of a corpus. ``files``: ``path``, ``source`` and, if later files shall win over others than by path, ``file_ord``.

    ``tree`` may be a table of tree rows that was written before; parsing is the costly part, so do write it for a corpus of size (``written``).
    Its joins are never broadcast: a tree takes many times the size that its files, or what it was parsed from, let one expect. With ``scratch`` the
    facts that several checks ask for are written when the first does, and so is the tree, if there is none yet: who asks for texts only parses nothing.
    """

    def __init__(self, files: DataFrame, tree: DataFrame | None = None, scratch: Scratch | None = None):
        self.files, self.scratch, self._tree = files, scratch, tree

    @cached_property
    def tree(self) -> DataFrame:
        return self._kept(source.tree_rows(self.files)).hint("merge") if self._tree is None else self._tree.hint("merge")

    @classmethod
    def written(cls, files: DataFrame, scratch: Scratch, where: str = "true") -> Facts:
        """Facts of files that are parsed once, into a table of those tree rows for which ``where`` holds."""
        return cls(files, scratch.keep(source.tree_rows(files).where(where)))

    def _kept(self, fact: DataFrame) -> DataFrame:
        return fact if self.scratch is None else self.scratch.keep(fact).hint("merge")

    @cached_property
    def lines(self) -> DataFrame:
        return source.lines(self.files)

    @cached_property
    def status(self) -> DataFrame:
        """``path, parse_status, parse_error``"""
        root = self.tree.where("parent = -1")
        bad = F.col("kind") == "error"
        return root.select("path", F.when(bad, "error").otherwise("ok").alias("parse_status"), F.when(bad, F.col("lit")).alias("parse_error"))

    @cached_property
    def references(self) -> DataFrame:
        """``path, dep, line, pre`` of every module name in a file, its own among them. Aliases are not resolved."""
        return self.tree.where("form = '__aliases__' and lit is not null").select("path", F.col("lit").alias("dep"), "line", "pre")

    @cached_property
    def modules(self) -> DataFrame:
        """``path, file_ord, module``: files whose only top statement defines a module."""
        root = with_child(self.tree.where("pre = 0 and form = 'defmodule'").select("path", "pre"), self.tree, "name", 0, where="parent = 0")
        named = root.where("name_form = '__aliases__' and name_lit is not null").select("path", F.col("name_lit").alias("module"))
        order = F.col("file_ord") if "file_ord" in self.files.columns else F.col("path")
        return self._kept(named.join(self.files.select("path", order.alias("file_ord")).hint("merge"), "path"))

    @cached_property
    def deps(self) -> DataFrame:
        """``path, dep, last_line``: direct dependencies with the line of the last reference."""
        return self._kept(self.references.groupBy("path", "dep").agg(F.max_by("line", "pre").alias("last_line")))

    @cached_property
    def uses(self) -> DataFrame:
        calls = with_child(self.tree.where("form = 'use' and kind = 'call'").select("path", "pre"), self.tree, "what", 0, where="up_form = 'use'")
        return calls.where("what_form = '__aliases__' and what_lit is not null").select("path", F.col("what_lit").alias("used")).distinct()

    @cached_property
    def edges(self) -> DataFrame:
        """``src, dst`` of the module graph; of files that define the same module the last wins."""
        last = self.modules.groupBy("module").agg(F.max_by("path", "file_ord").alias("path"))
        return last.join(self.deps, "path").select(F.col("module").alias("src"), F.col("dep").alias("dst"))

    @cached_property
    def defs(self) -> DataFrame:
        """Definitions: ``path, pre, kind, name, raw_name, arity, has_args_list, has_guard, has_body, line, head_pre, body_pre, body_last, visibility``."""
        own = self.tree.where(F.col("form").isin(*DEFINERS) & (F.col("kind") == "call") & (F.col("arg_count") >= 1)).select("path", "pre", F.col("form").alias("definer"), "arg_count", "line")
        own = with_child(own, self.tree, "head", 0, where=f"up_form in {_DEFINERS}")
        own = with_child(own, self.tree, "inner", 0, "head_pre", "left", "up_form = 'when'")  # read of guards only
        own = with_child(own, self.tree, "body", 1, "pre", "left", f"up_form in {_DEFINERS}")
        guard = (F.col("head_form") == "when") & (F.col("head_kind") == "call")
        real = lambda c: F.when(guard, F.col(f"inner_{c}")).otherwise(F.col(f"head_{c}"))
        named = real("form").isNotNull() & real("kind").isin("call", "var") & ~real("form").isin(".()", "()()")
        return self._kept(own.where(named).select(
            "path", "pre", F.col("definer").alias("kind"), real("form").alias("name"), F.when(guard, F.lit("when")).otherwise(F.col("head_form")).alias("raw_name"),
            F.coalesce(real("arg_count"), F.lit(0)).alias("arity"), (real("kind") == "call").alias("has_args_list"), guard.alias("has_guard"), (F.col("arg_count") == 2).alias("has_body"),
            "line", real("pre").alias("head_pre"), "body_pre", "body_last", F.when(F.col("definer").isin("defp", "defmacrop"), "private").otherwise("public").alias("visibility"),
        ))

    @cached_property
    def clauses(self) -> DataFrame:
        """Functions, macros left out, with a list of arguments and a body."""
        return self.defs.where("kind in ('def', 'defp') and has_args_list and has_body")

    @cached_property
    def bare_args(self) -> DataFrame:
        """``path, def_pre, arg``: parameters that are plain variables."""
        arg = children(below(self.tree.where("kind = 'var'"), f"up2_form in {_DEFINERS} or up2_form = 'when'"), "arg").where("arg_ord >= 0").select("path", F.col("arg_parent").alias("head_pre"), F.col("arg_form").alias("arg"))
        return self.clauses.select("path", F.col("pre").alias("def_pre"), "head_pre").join(arg, ["path", "head_pre"]).select("path", "def_pre", "arg").distinct()

    @cached_property
    def doc_ranges(self) -> DataFrame:
        """``path, start_line, end_line`` of documentation. A text of several lines ends one line after its closing mark."""
        at = with_child(self.tree.where("form = '@' and kind = 'call' and arg_count = 1").select("path", "pre", "line"), self.tree, "doc", 0, where="up_form = '@'")
        at = at.where(F.col("doc_form").isin("moduledoc", "doc", "typedoc") & (F.col("doc_arg_count") == 1))
        at = with_child(at, self.tree, "text", 0, "doc_pre", where="up2_form = '@'").where("text_kind = 'literal' and (text_lit_type = 'string' or text_lit = 'false')")
        parts = F.when(F.col("text_lit_type") == "string", F.size(F.split("text_lit", "\n", -1))).otherwise(1)
        return at.select("path", F.col("line").alias("start_line"), (F.col("line") + F.when(parts > 1, parts + 1).otherwise(0)).alias("end_line"))

    @cached_property
    def text_heads(self) -> DataFrame:
        return source.text_heads(self.files)
