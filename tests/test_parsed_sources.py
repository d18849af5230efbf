from rulequarry.operators.checks import REGISTRY
from rulequarry.plans import catalogue
from rulequarry.sources import files


def test_whole_texts_and_all_checks(spark, tmp_path):
    odd = "\n".join(['say "x" \\ #{y}', "", "\t", "Ünï 1", "# no", "a,b;c", "end do", "'q'", "{:ok, z}", "x\r"])
    rows = [(i, "\n".join(" ".join([f"text{i} line{k}", *["w"] * (i - 3)]) for k in range(i))) for i in range(12)] + [(None, odd), (50, None), (51, odd * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    made = df.select("doc_id", catalogue._module(catalogue.F.coalesce(catalogue.F.col("doc_id").cast("string"), catalogue.F.lit("None"))).alias("source"))
    sources = made.collect()
    for r in sources:
        text = dict(rows)[r.doc_id] or ""
        assert sum(x.strip().startswith(("def ", "defp ")) for x in r.source.split("\n")) >= len(text.split("\n"))
    assert "text11 line10 w" in next(r.source for r in sources if r.doc_id == 11)
    tree = files.tree_rows(made.selectExpr("coalesce(doc_id, -1) || '' as path", "source"))
    assert tree.where("kind = 'error'").count() == 0
    got = catalogue.queries()["parsed_sources"](spark, str(tmp_path)).collect()
    assert {r.check for r in got} == set(REGISTRY)
    assert any(r.path == "lib/none.ex" for r in got) and len({r.path for r in got}) == 15
    cases = [r for r in got if r.check == "case_on_bare_arg" and r.path == "lib/11.ex"]
    assert len(cases) == 3  # lines 0, 5 and 10 of eleven
