"""Queries on tables as larger inputs have them: folders of part files, rare texts, rows in bulk."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant import registry
from tests.oracle import actual, expected


def put(spark, sf, folder, *names: str) -> str:
    """The named tables of sf as folders of two part files."""
    for name in names:
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_streams_read_tables_of_several_files(spark, sf, tmp_path):
    folder = put(spark, sf, tmp_path, "documents", "events")
    for name in ("r7_stream_template_warnings", "r1_stream_events"):
        assert actual(registry.QUERIES[name](spark, folder)) == expected(sf, registry.SQL[name])


def test_claims_of_a_text_that_is_part_of_a_hint(spark, sf, tmp_path):
    """The texts "a" and "the" are part of the hints, but do not hold them: the refinements leave them where they are."""
    kept = spark.read.parquet(f"{sf}/documents.parquet").limit(20).withColumn("text", F.repeat(F.lit("a\nThe\nof that\n"), 40))
    kept.coalesce(1).write.parquet(str(tmp_path / "rows"))
    (part,) = (tmp_path / "rows").glob("part-*.parquet")
    part.rename(tmp_path / "documents.parquet")
    assert actual(registry.QUERIES["p1_sibling_claims"](spark, str(tmp_path))) == expected(str(tmp_path), registry.SQL["p1_sibling_claims"])


def test_contracts_are_walked_once(spark, sf):
    """Every check reads the same written rows: none has the walk over the JSON texts in its plan."""
    df = registry.QUERIES["v16_contract_problems"](spark, sf)
    assert "MapInPandas" not in df._jdf.queryExecution().toString()


def test_contract_checks_take_few_passes(spark, sf):
    """A driver holds the plans of all checks: they share scans, and only fields of operations, keys and problems are moved."""
    plan = registry.QUERIES["v16_contract_problems"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 4 and plan.count("Exchange hashpartitioning") <= 3


def test_contract_checks_of_members_and_operations(spark):
    """A member whose name holds a dot is no member of an object below; fields count for the operation that holds them."""
    from foliant.operators import contract as ct

    texts = {
        "dot": '{"template_meta":{},"template_meta.id":"t"}',
        "ops": '{"patch_blocks":[{"operations":[{"type":"set_attr"},{"type":"set_text","name":"a"},{"type":"set_attr","name":""},{"type":"set_paragraph_style"}]}]}',
        "old": '{"semantic_blocks":[{"key":"a"},{"key":"b"}],"operation_blocks":[{"semantic_key":"a"},{"semantic_key":"lost"}]}',
    }
    got = ct.contract_problems(ct.contract_rows(spark.createDataFrame(list(texts.items()), "template_id STRING, contract STRING"))).collect()
    of = lambda template, under: {(r.path, r.problem) for r in got if r.template_id == template and r.path.startswith(under)}
    assert ("template_meta.id", "missing") in of("dot", "template_meta")
    at = "patch_blocks[0].operations"
    assert of("ops", at) == {(f"{at}[0].name", "missing"), (f"{at}[2].name", "wrong text"), (f"{at}[3].paragraph_style", "missing")}
    assert of("old", "operation_blocks.") == {("operation_blocks.b", "block_count")} and ("operation_blocks[1].semantic_key", "undeclared") in of("old", "")


def test_documents_meet_templates_without_rows_for_both(spark, sf):
    """The best template of a document comes from its counts by kind: no join or aggregation by document and template."""
    plan = registry.QUERIES["c5_best_templates"](spark, sf)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan


def test_templates_classify_in_one_pass_over_the_paragraphs(spark, sf):
    """A paragraph's text is compared with hints where its facts are found: the paragraphs are not joined once more."""
    plan = registry.QUERIES["c17_classify_by_templates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1


def test_transcripts_are_cut_into_blocks_once(spark, sf):
    """The pattern of blocks, which goes over a whole transcript, stands once in what is computed for it."""
    for name in ("f3_assistant_output", "f4_transcript_markdown"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 1, name


def test_language_split_has_one_pattern_and_no_arrays_beside_it(spark, sf):
    """Stretches come out of one pattern: no expression that works through the pieces of a text once more."""
    plan = registry.QUERIES["w8_split_language"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "transform(" not in plan


def test_language_split_of_mixed_punctuation(spark):
    """Punctuation goes with what follows its block, else with what precedes it; next to blanks only, with neither."""
    from foliant.operators import write

    texts = {"a,中": ["en:a", "zh:,中"], "中, a": ["zh:中,", "unknown: ", "en:a"], ",. ": ["unknown:,. "], "。a,b。": ["en:。a,b。"], " -中-文- ": ["unknown: ", "zh:-中-文-", "unknown: "]}
    rows = write.split_language(spark.createDataFrame(list(texts), "string").selectExpr("value AS text", "value AS run_id")).collect()
    got = {t: [f"{r.language}:{r.text}" for r in sorted(rows, key=lambda r: r.seg) if r.run_id == t] for t in texts}
    assert got == texts


def test_paragraphs_and_runs_take_one_shuffle(spark, sf):
    """Beside the one that makes the packages: nodes go to their document once, no join meets them and no table is written."""
    for name in ("s1_read_paragraphs", "s1_read_runs"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan and "table-" not in plan, name


def test_states_cut_texts_once(spark, sf):
    """Snapshots, log, versions and rollbacks all read the runs that were written once, without their texts."""
    plan = registry.QUERIES["w17_states_as_of"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "text#" not in plan


def test_texts_stay_where_only_their_blankness_is_asked_for(spark, sf):
    """Rows that go to their document for counts and places carry no text, unless the caller asks for one of its own."""
    from foliant.operators import templates
    from foliant.plans import template_queries as tq

    def below_window(df):
        plan = df._jdf.queryExecution().optimizedPlan()
        while plan.nodeName() != "Window":
            plan = plan.children().head()
        return plan.children().head().output().mkString(" ")

    x = tq.context(spark, sf)
    assert "blank" in below_window(templates.paragraph_facts(x)) and "text" not in below_window(templates.paragraph_facts(x))
    assert "low" in below_window(templates.paragraph_facts(x, F.lower("text").alias("low")))
