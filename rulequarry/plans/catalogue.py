"""Queries over the driver's tables that exercise each operator, beside SQL that gives the same rows.

The tables hold no source code, so each query views some table as the fact table that an operator reads; the operator is the one that the engine runs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulequarry.functions.patterns import line_of_offset, module_glob, path_glob
from rulequarry.operators import checks, graph
from rulequarry.session import Scratch, ship
from rulequarry.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("source"))
    return files.lines(docs)


_CODE = r"""l AS (SELECT doc_id AS path, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
    c AS (SELECT path, n, regexp_replace(t, '^[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*', '') AS t FROM l)"""


@query(f"WITH {_CODE} SELECT path, count(*) AS n_lines FROM c WHERE t <> '' AND t NOT LIKE '#%' GROUP BY path")
def lines_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that count."""
    return checks.code_line_counts(_lines(spark, sf_dir))


@query(f"""WITH {_CODE}, n AS (SELECT path, count(*) AS k FROM c WHERE t <> '' AND t NOT LIKE '#%' GROUP BY path)
    SELECT path, 1::BIGINT AS line_no, 'File contains ' || k || ' lines of code (maximum allowed: 20). Consider breaking this file into smaller, more focused modules.' AS message FROM n WHERE k > 20""")
def max_file_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of more than 20 lines."""
    found = checks.code_line_counts(_lines(spark, sf_dir)).where("n_lines > 20")
    text = F.format_string("File contains %d lines of code (maximum allowed: 20). Consider breaking this file into smaller, more focused modules.", "n_lines")
    return found.select("path", F.lit(1).cast("long").alias("line_no"), text.alias("message"))


@query(f"""WITH {_CODE}, r AS (SELECT doc_id AS path, doc_id % 7 + 1 AS a, doc_id % 7 + 1 + doc_id % 5 AS b FROM labels)
    SELECT path, count(*) AS n_lines FROM c WHERE t <> '' AND t NOT LIKE '#%' AND NOT EXISTS (SELECT 1 FROM r WHERE r.path = c.path AND n BETWEEN a AND b) GROUP BY path""")
def doc_range_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines outside ranges; a range of some lines for each labelled document."""
    start = F.col("doc_id") % 7 + 1
    ranges = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), start.alias("start_line"), (start + F.col("doc_id") % 5).alias("end_line"))
    return checks.code_line_counts(_lines(spark, sf_dir), ranges)


def _glob(spark, sf_dir, globs):
    regexes = F.array(*(F.lit(g) for g in globs))
    return _read(spark, sf_dir, "pages").where(F.exists(regexes, lambda r: F.regexp_like("url", r))).select("page_id", "url")


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^http.*://(.*/)?en/[^/]*$') OR regexp_matches(url, '^https://blog.*(/.*)?$')")
def rule_path_glob_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9, R14"""
    return _glob(spark, sf_dir, [path_glob("http**://**/en/*", True), path_glob("https://blog**/**", True)])


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^http://[^/]*\.example\.com/en/[^/]*$') OR regexp_matches(url, '^https://[^/]*/[^/]*[^/]*/[^/]*3$')")
def rule_path_glob_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R9, R13"""
    return _glob(spark, sf_dir, [path_glob("http://*.example.com/en/*"), path_glob("https://*/**/*3")])


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^.*A.*$')")
def rule_module_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R10, R15"""
    return _read(spark, sf_dir, "part").where(F.col("p_type").rlike(module_glob("*A*"))).select("p_partkey", "p_type")


@query("SELECT DISTINCT conv_id FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system')")
def rule_uses_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that use a system turn."""
    turns = _read(spark, sf_dir, "conversations")
    return turns.select("conv_id").distinct().join(turns.where("role = 'system'").select("conv_id"), "conv_id", "left_semi")


@query("""WITH p AS (SELECT DISTINCT conv_id FROM conversations), w AS (SELECT conv_id, unnest(['system', 'user', 'tool']) AS used FROM p)
    SELECT conv_id AS path, used FROM w WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = w.conv_id AND c.role = w.used)""")
def must_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without a turn of a role that they must have."""
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("role").alias("used")).distinct()
    wanted = turns.select("path").distinct().select("path", F.lit(0).alias("rule_id"), F.array(*map(F.lit, ("system", "user", "tool"))).alias("required_modules"))
    return checks.missing_uses(turns, wanted).select("path", "used")


@query(r"""WITH h AS (SELECT page_id AS path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dep, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1)::BIGINT AS n FROM pages)
    SELECT path, dep, max(n) AS last_line FROM h WHERE dep IN ('/The', '/the', '/of', '/de') GROUP BY path, dep""")
def no_direct_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages to forbidden places, with the last link of each."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    refs = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.posexplode(links).alias("i", "dep"))
    deps = refs.groupBy("path", "dep").agg(F.max_by((F.col("i") + 1).cast("long"), "i").alias("last_line"))
    rule = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.lit(0).alias("rule_id"), F.array(*map(F.lit, ("/The", "/the", "/of", "/de"))).alias("forbidden_modules"))
    return checks.forbidden_direct(deps, rule).select("path", "dep", "last_line")


def _part_graph(spark, sf_dir):
    n = 1000
    key = F.col("p_partkey")
    parts = _read(spark, sf_dir, "part").where(key < n)
    return parts.select(key.alias("src"), F.explode(F.array((3 * key + 1) % n, (7 * key) % n)).alias("dst")).distinct()


_PART_EDGES = "e AS (SELECT DISTINCT p_partkey AS src, unnest([(3 * p_partkey + 1) % 1000, (7 * p_partkey) % 1000]) AS dst FROM part WHERE p_partkey < 1000)"


@query(f"""WITH RECURSIVE {_PART_EDGES}, r AS (SELECT p_partkey AS start, p_partkey AS node FROM part WHERE p_partkey IN (1, 10, 500, 5000000)
    UNION SELECT r.start, e.dst FROM r JOIN e ON e.src = r.node) SELECT start, node FROM r""")
def transitive_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts that some parts lead to, over edges made of their keys."""
    starts = _read(spark, sf_dir, "part").where("p_partkey IN (1, 10, 500, 5000000)").select(F.col("p_partkey").alias("start"))
    return graph.transitive_closure(_part_graph(spark, sf_dir), starts, Scratch(spark, "closure"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS src, unnest([(2 * n_nationkey + 1) % 13, (n_nationkey * n_nationkey + 3) % 13]) AS dst FROM nation WHERE n_nationkey < 13),
    w AS (SELECT n_nationkey AS start, [n_nationkey] AS path FROM nation WHERE n_nationkey IN (0, 5) UNION ALL
          SELECT w.start, list_append(w.path, e.dst) FROM w JOIN e ON e.src = w.path[-1] WHERE NOT list_contains(w.path, e.dst)),
    f AS (SELECT start, path[-1] AS target, min(path) AS path FROM w WHERE path[-1] IN (2, 7, 12) AND path[-1] <> start GROUP BY ALL)
    SELECT start::BIGINT AS start, target::BIGINT AS target,
           CASE WHEN len(path) > 2 THEN ' (dependency chain: ' || array_to_string(path, ' -> ') || ')' ELSE '' END AS chain FROM f""")
def dependency_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first simple path between nations, over edges made of their keys."""
    key = F.col("n_nationkey")
    edges = _read(spark, sf_dir, "nation").where(key < 13).select(key.alias("src"), F.explode(F.array((2 * key + 1) % 13, (key * key + 3) % 13)).alias("dst"))
    pairs = _read(spark, sf_dir, "nation").where(key.isin(0, 5)).select(key.alias("start"), F.explode(F.array(F.lit(2), F.lit(7), F.lit(12))).alias("target")).where("start <> target")
    paths = graph.first_paths(edges, pairs, Scratch(spark, "paths"))
    return paths.select(F.col("start").cast("long").alias("start"), F.col("target").cast("long").alias("target"), graph.chain_text(F.col("path").cast("array<string>")).alias("chain"))


# transitive_closure and dependency_path are cut to 1,000 parts and 13 nations as their SQL is; these three take every row and have no SQL


def whole(f):
    QUERIES[f.__name__] = f
    return f


def _all_parts(spark, sf_dir):
    """Edges between all parts, made of their keys and the table's size, and that size."""
    parts = _read(spark, sf_dir, "part").where("p_partkey is not null").select(F.col("p_partkey").cast("long").alias("src"))
    n = parts.count()
    size = F.lit(max(n, 1))
    return parts.select("src", F.explode(F.array((3 * F.col("src") + 1) % size, (7 * F.col("src")) % size)).alias("dst")).distinct(), parts, max(n, 1)


@whole
def transitive_closure_all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts that every n/4-th part leads to."""
    edges, parts, n = _all_parts(spark, sf_dir)
    starts = parts.where(F.col("src") % max(n // 4, 1) == 1 % max(n // 4, 1)).select(F.col("src").alias("start"))
    return graph.transitive_closure(edges, starts, Scratch(spark, "closure"))


def _chains(spark, edges, pairs):
    ship(spark)
    paths = graph.first_paths(edges, pairs.where("start <> target"), Scratch(spark, "paths"))
    return paths.select("start", "target", graph.chain_text(F.col("path").cast("array<string>")).alias("chain"))


@whole
def dependency_path_all_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first simple path from every n/4-th part to every n/3-rd."""
    edges, parts, n = _all_parts(spark, sf_dir)
    starts = parts.where(F.col("src") % max(n // 4, 1) == 1 % max(n // 4, 1)).select(F.col("src").alias("start"))
    targets = parts.where(F.col("src") % max(n // 3, 1) == 2 % max(n // 3, 1)).select(F.col("src").alias("target"))
    return _chains(spark, edges, starts.crossJoin(F.broadcast(targets)))


@whole
def dependency_path_all_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first simple path between any two nations."""
    keys = _read(spark, sf_dir, "nation").where("n_nationkey is not null").select(F.col("n_nationkey").cast("long").alias("src"))
    n, key = max(keys.count(), 1), F.col("src")
    edges = keys.select("src", F.explode(F.array((2 * key + 1) % n, (key * key + 3) % n)).alias("dst"))
    return _chains(spark, edges, keys.select(key.alias("start")).crossJoin(keys.select(key.alias("target"))))


@query("SELECT o_custkey AS module, arg_max(o_orderstatus, o_orderkey) AS kept FROM orders GROUP BY o_custkey")
def duplicate_module_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows of one key the last wins."""
    return _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("module")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("kept"))


_NAMES = "f AS (SELECT DISTINCT l_orderkey AS path, p_name AS name, l_linenumber AS line, l_quantity::BIGINT % 3 AS arity, l_returnflag = 'R' AS private, l_partkey AS pre FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _functions(spark, sf_dir):
    items, parts = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    private = F.when(F.col("l_returnflag") == "R", "private").otherwise("public")
    return items.join(parts, "l_partkey").select(F.col("l_orderkey").alias("path"), "name", F.col("l_linenumber").alias("line"), (F.col("l_quantity").cast("long") % 3).alias("arity"), private.alias("visibility"), F.col("l_partkey").alias("pre")).distinct()


@query(f"""WITH {_NAMES} SELECT path, name, max(line)::BIGINT AS line FROM f WHERE name NOT IN (SELECT p_name FROM part WHERE p_partkey < 50) GROUP BY path, name""")
def pattern_restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of an order's parts that are not allowed, with the last line of each."""
    names = _functions(spark, sf_dir).select("path", "name", "line", F.col("line").alias("pre"))
    allowed = _read(spark, sf_dir, "part").where("p_partkey < 50").agg(F.collect_set("p_name").alias("allowed_functions"))
    rules = names.select("path").distinct().withColumn("rule_id", F.lit(0)).join(F.broadcast(allowed))
    return checks.disallowed_names(names, rules).select("path", "name", F.col("line").cast("long").alias("line"))


def _order_sql(where: str, keys: str) -> str:
    return f"""WITH {_NAMES}, k AS (SELECT *, lower(name) AS low FROM f {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY line, pre, name, arity, private) AS actual, row_number() OVER (PARTITION BY {keys} ORDER BY low, arity, line, pre, private) AS own,
                 lag(name || '/' || arity) OVER (PARTITION BY {keys} ORDER BY low, arity, line, pre, private) AS before FROM k),
    m AS (SELECT *, min(own) OVER (PARTITION BY {keys}, name, arity, line) AS place, first_value(before) OVER (PARTITION BY {keys}, name, arity, line ORDER BY own) AS first FROM r)
    SELECT path, name || '/' || arity AS trigger, line::BIGINT AS line_no, coalesce(first, 'the beginning') AS after FROM m WHERE actual <> place"""


def _ordered(df: DataFrame, partition: list[str]) -> DataFrame:
    df = df.withColumn("pre", F.struct("pre", "name", "arity", F.col("visibility") != "private"))
    return checks.order_issues(df, partition).select("path", F.concat_ws("/", "name", "arity").alias("trigger"), F.col("line").cast("long").alias("line_no"), "after")


# the tables' pre is not unique beside visibility; the private flag sorts last in both engines
@query(_order_sql("", "path").replace("private", "(NOT private)").replace("'R' AS (NOT private)", "'R' AS private"))
def alphabetized_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8, X20, X21"""
    return _ordered(_functions(spark, sf_dir), ["path"])


@query(_order_sql("WHERE NOT private", "path"))
def alphabetized_public_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8, mode public_only"""
    return _ordered(_functions(spark, sf_dir).where("visibility = 'public'"), ["path"])


@query(_order_sql("", "path, private"))
def alphabetized_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8, mode separate"""
    return _ordered(_functions(spark, sf_dir), ["path", "visibility"])


@query(f"""WITH {_NAMES}, l AS (SELECT *, max(line) FILTER (NOT private) OVER (PARTITION BY path) AS last FROM f)
    SELECT path, name || '/' || arity AS trigger, line::BIGINT AS line_no FROM l WHERE private AND line < last""")
def alphabetized_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8, X22"""
    found = checks.early_private(_functions(spark, sf_dir), ["path"])
    return found.select("path", F.concat_ws("/", "name", "arity").alias("trigger"), F.col("line").cast("long").alias("line_no"))


# trees: a customer is a file, its orders are nodes in order of key, and each part of three nodes is a subtree

_TREE = """t AS (SELECT o_custkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pre, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
    n AS (SELECT path, pre, CASE status WHEN 'O' THEN '|>' WHEN 'F' THEN 'case' ELSE '==' END AS form, (pre - 1) % 3 AS ord, pre - 1 - (pre - 1) % 3 AS parent FROM t)"""


def _tree(spark, sf_dir):
    from pyspark.sql import Window

    pre = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    form = F.when(F.col("o_orderstatus") == "O", "|>").when(F.col("o_orderstatus") == "F", "case").otherwise("==")
    rows = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), pre.alias("pre"), form.alias("form"))
    order = (F.col("pre") - 1) % 3
    return rows.select("path", "pre", F.col("pre").alias("last"), (F.col("pre") - 1 - order).alias("parent"), order.alias("ord"), F.lit("call").alias("kind"), "form")


@query(f"""WITH {_TREE}, m AS (SELECT n.* FROM n LEFT JOIN n c ON c.path = n.path AND c.parent = n.pre AND c.ord = 0 AND c.form = '|>' WHERE n.form = 'case' OR (n.form = '|>' AND c.path IS NULL))
    SELECT c_custkey AS path, count(*) AS n FROM customer JOIN m ON m.path = c_custkey AND m.pre BETWEEN 2 AND 2 + c_custkey % 9 GROUP BY c_custkey HAVING count(*) > 1""")
def single_control_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control structures in an interval of a file's nodes."""
    clauses = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.lit(0).alias("pre"), F.col("c_name").alias("name"), F.lit(1).alias("line"), F.lit(2).alias("body_pre"), (2 + F.col("c_custkey") % 9).alias("body_last"))
    return checks.control_flow_counts(clauses, _tree(spark, sf_dir)).where("n > 1").select("path", "n")


@query(f"""WITH {_TREE} SELECT c_custkey AS path FROM customer WHERE EXISTS (SELECT 1 FROM n WHERE n.path = c_custkey AND form = '==' AND pre BETWEEN 1 + c_custkey % 4 AND 3 + c_custkey % 7)""")
def comparison_in_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a comparison in an interval."""
    tests = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), (1 + F.col("c_custkey") % 4).alias("a"), (3 + F.col("c_custkey") % 7).alias("b"))
    compared = _tree(spark, sf_dir).where(F.col("form").isin(*checks.COMPARISONS)).select("path", F.col("pre").alias("at"))
    return checks.within(tests, compared, "a", "b", "at", "left_semi").select("path")


@query(f"""WITH {_TREE}, c AS (SELECT path, pre, pre % 4 AS arg FROM n WHERE form = 'case')
    SELECT c_custkey AS path, arg, pre AS case_line FROM customer JOIN c ON c.path = c_custkey AND c.pre BETWEEN 2 AND 30 AND (c.arg = c_custkey % 3 OR c.arg = 3)""")
def case_on_bare_arg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases in an interval whose subject is one of the owner's names."""
    owners = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    clauses = owners.select("path", F.lit(0).alias("pre"), F.lit("f").alias("name"), F.lit(2).alias("body_pre"), F.lit(30).alias("body_last"))
    bare = owners.select("path", F.lit(0).alias("def_pre"), F.explode(F.array(F.col("path") % 3, F.lit(3).cast("long"))).alias("arg"))
    cases = _tree(spark, sf_dir).where("form = 'case'").select("path", F.col("pre").alias("at"), F.col("pre").cast("long").alias("line"), (F.col("pre") % 4).cast("long").alias("arg"))
    return checks.bare_cases(clauses, bare, cases).select("path", "arg", "case_line")


@query(r"""WITH h AS (SELECT p_partkey AS path, CASE p_partkey % 4 WHEN 0 THEN '{:ok, ' || p_name || '}' WHEN 1 THEN p_name || ', {:error , e}' WHEN 2 THEN '[{:ok, ' || p_name || '}], {:ok, 1}' ELSE p_name END AS args FROM part)
    SELECT path FROM h WHERE regexp_matches(args, '(^|,)\s*\{:(ok|error)\s*,') AND NOT regexp_matches(args, '[\[%][^,\]]*\{:(ok|error)\s*,')""")
def tuple_match_in_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads made of part names."""
    key, name = F.col("p_partkey"), F.col("p_name")
    args = F.when(key % 4 == 0, F.concat(F.lit("{:ok, "), name, F.lit("}"))).when(key % 4 == 1, F.concat(name, F.lit(", {:error , e}"))).when(key % 4 == 2, F.concat(F.lit("[{:ok, "), name, F.lit("}], {:ok, 1}"))).otherwise(name)
    return checks.tuple_heads(_read(spark, sf_dir, "part").select(key.alias("path"), args.alias("args"))).select("path")


@query("SELECT doc_id, len(string_split(substr(text, 1, n_chars // 2), chr(10)))::BIGINT AS line FROM documents WHERE text IS NOT NULL")
def line_of_text_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of the middle of a text."""
    docs = _read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", line_of_offset(F.col("text"), F.expr("n_chars div 2")).cast("long").alias("line"))


@query(f"""WITH {_CODE}, a AS (SELECT 'lines' AS "check", path FROM c WHERE t <> '' AND t NOT LIKE '#%' GROUP BY path HAVING count(*) > 20),
    b AS (SELECT 'roles' AS "check", conv_id AS path FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'system') = 0)
    SELECT "check", count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY "check" """)
def issue_union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of two checks in one table."""
    long = max_file_length(spark, sf_dir).select(F.lit("lines").alias("check"), "path")
    bare = must_use(spark, sf_dir).where("used = 'system'").select(F.lit("roles").alias("check"), "path")
    return long.unionByName(bare).groupBy("check").agg(F.count("*").alias("n"))


#: Forms that a line of a text is turned into; {i} is the line's number, {w} its text in a string, {a} a name of its letters, {n} the number of its words.
_FORMS = (
    "  def {a}_{i}(a) do\n    case a do\n      {n} -> {w}\n    end\n  end\n",
    "  def {a}_{i}({:ok, a}), do: Doc{n}.x(a, {w})\n",
    "  def {a}_{i}(a, b) do\n    if a == {n} do\n      b |> f({w})\n    end\n    for x <- b, do: x\n  end\n",
    "  def {a}_{i}(a) do\n    with {:ok, b} <- f(a),\n         _ <- g({w}) do\n      b\n    end\n  end\n",
    "  def get_{a}(%__MODULE__{{a}: a}), do: a\n  defp {a}_{i}, do: {w}\n",
)


def _module(doc: Column) -> Column:
    """The source of a module made of a whole text: a definition for each line, which holds the line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")

    def clause(line, i):
        name = F.concat(F.lit("f"), F.substring(F.regexp_replace(F.lower(line), "[^a-z]+", "_"), 1, 12))
        safe = F.regexp_replace(F.regexp_replace(line, r'["\\\\#]', "'"), r"[\p{Cntrl}\x{2028}\x{2029}]", " ")
        count = F.when(F.trim(line) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(line), r"\s+")))
        parts = {"{i}": i.cast("string"), "{n}": count.cast("string"), "{a}": name, "{w}": F.concat(F.lit('"'), safe, F.lit('"'))}
        return F.element_at(F.array(*(_filled(x, parts) for x in _FORMS)), (i % len(_FORMS) + 1).cast("int"))

    head = F.concat(F.lit("defmodule Doc"), doc, F.lit(" do\n  use Base"), F.length(text).cast("long") % 3, F.lit("\n  defstruct [:id]\n"))
    return F.concat(head, F.array_join(F.transform(lines, clause), ""), F.lit("end\n"))


def _filled(form: str, parts: dict[str, Column]) -> Column:
    return F.concat(*(parts.get(x, F.lit(x)) for x in re.split(r"(\{[inaw]\})", form) if x))


def parsed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L0 and all twelve checks: source files made of whole documents, a definition a line, parsed and checked; SQL has no parser, the goldens are in the tests.

    A document without doc_id is the file lib/none.ex and the module DocNone; rows that share an id share a path, like files of one name.
    """
    from rulequarry.plans.engine import run_checks

    ship(spark)
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))
    sources = _read(spark, sf_dir, "documents").select(F.concat(F.lit("lib/"), F.lower(doc), F.lit(".ex")).alias("path"), _module(doc).alias("source"))
    return run_checks(sources, _rules())


def _rules():
    from rulequarry.sources.config import Rule

    options = {
        "no_direct_dependency": {"forbidden_modules": ["Doc5"]}, "no_transitive_dependency": {"forbidden_modules": ["Doc5", "Doc7"]}, "must_use_module": {"required_modules": ["Base0"]},
        "max_file_length": {"max_lines": 20},
    }
    rules = [Rule(t, paths=["lib/*.ex"], **options.get(t, {})) for t in checks.REGISTRY if t != "module_pattern_restrictions"]
    return [*rules, Rule("module_pattern_restrictions", pattern="Doc1*")]


QUERIES["parsed_sources"] = parsed_sources


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from rulequarry.plans import source_queries  # noqa: E402, F401  it adds its queries to these
