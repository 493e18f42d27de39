"""Contract checks as data: a template's JSON as rows (path, kind, value), held against a catalogue of what each path must be."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the contract format asks of each path: rule, whether it must be there, and the values allowed.
# object, array; text: not blank; texts: an array with one at least; any_texts: may be empty; key: a declared semantic;
# boolean; confidence: 0 to 1; ordinal: an integer from 0; choice: one of the values.
CATALOGUE = (
    ("template_meta", "object", True, ""), ("template_meta.schema_version", "choice", True, "2.0"), ("template_meta.id", "text", True, ""), ("template_meta.name", "text", True, ""), ("template_meta.version", "text", True, ""),
    ("semantic_blocks", "array", True, ""), ("semantic_blocks[]", "object", False, ""), ("semantic_blocks[].key", "text", True, ""), ("semantic_blocks[].label", "text", True, ""),
    ("semantic_blocks[].description", "text", True, ""), ("semantic_blocks[].examples", "texts", True, ""), ("semantic_blocks[].examples[]", "text", False, ""),
    ("semantic_blocks[].required", "boolean", True, ""), ("semantic_blocks[].multiple", "boolean", True, ""),
    ("derived_semantics", "array", False, ""), ("derived_semantics[]", "object", False, ""), ("derived_semantics[].key", "text", True, ""), ("derived_semantics[].label", "text", True, ""),
    ("derived_semantics[].mode", "choice", False, "aggregate|refine"), ("derived_semantics[].inherits_from", "texts", True, ""), ("derived_semantics[].inherits_from[]", "key", False, ""),
    ("derived_semantics[].examples", "texts", True, ""), ("derived_semantics[].examples[]", "text", False, ""), ("derived_semantics[].negative_examples", "texts", False, ""),
    ("derived_semantics[].negative_examples[]", "text", False, ""), ("derived_semantics[].text_hints", "texts", False, ""), ("derived_semantics[].text_hints[]", "text", False, ""),
    ("derived_semantics[].operation", "object", True, ""), ("derived_semantics[].operation.text_style", "object", True, ""), ("derived_semantics[].operation.paragraph_style", "object", True, ""),
    ("layout_rules", "object", True, ""), ("layout_rules.global_rules", "object", True, ""), ("layout_rules.global_rules.document_scope", "choice", False, "full_document"),
    ("layout_rules.global_rules.ordering", "texts", False, ""), ("layout_rules.global_rules.ordering[]", "key", False, ""), ("layout_rules.semantic_rules", "array", True, ""),
    ("layout_rules.semantic_rules[]", "object", False, ""), ("layout_rules.semantic_rules[].semantic_key", "key", True, ""), ("layout_rules.semantic_rules[].numbering_patterns", "texts", False, ""),
    ("layout_rules.semantic_rules[].numbering_patterns[]", "text", False, ""),
    ("patch_blocks[]", "object", False, ""), ("patch_blocks[].semantic_key", "text", True, ""), ("patch_blocks[].selector", "object", True, ""),
    ("patch_blocks[].selector.part", "choice", True, "document|header|footer|styles|numbering|settings|by_part_path"),
    ("patch_blocks[].selector.scope", "choice", True, "paragraph|run|table|row|cell|section|style|numbering_level|settings_node"), ("patch_blocks[].selector.match", "object", False, ""),
    ("patch_blocks[].selector.match.paragraph_ids", "texts", False, ""), ("patch_blocks[].selector.match.paragraph_ids[]", "text", False, ""), ("patch_blocks[].selector.match.block_ids", "texts", False, ""),
    ("patch_blocks[].selector.match.block_ids[]", "text", False, ""), ("patch_blocks[].selector.match.style_id", "text", False, ""), ("patch_blocks[].selector.match.num_id", "text", False, ""),
    ("patch_blocks[].selector.match.ilvl", "ordinal", False, ""), ("patch_blocks[].selector.match.section_index", "ordinal", False, ""), ("patch_blocks[].selector.match.part_path", "text", False, ""),
    ("patch_blocks[].selector.match.xml_path", "text", False, ""), ("patch_blocks[].operations", "filled", True, ""), ("patch_blocks[].operations[]", "object", False, ""),
    ("patch_blocks[].operations[].type", "choice", True, "set_attr|remove_attr|set_text|remove_node|ensure_node|replace_node_xml|set_run_style|set_paragraph_style|set_section_layout|set_table_style|set_table_cell_style|set_style_definition|set_numbering_level|set_settings_flag"),
    ("operation_blocks[]", "object", False, ""), ("operation_blocks[].semantic_key", "key", True, ""), ("operation_blocks[].text_style", "object", True, ""), ("operation_blocks[].paragraph_style", "object", True, ""),
    ("classification_contract", "object", True, ""), ("classification_contract.scope", "choice", True, "paragraph"), ("classification_contract.matches", "array", False, ""),
    ("classification_contract.matches[]", "object", False, ""), ("classification_contract.matches[].semantic_key", "key", True, ""), ("classification_contract.matches[].paragraph_ids", "texts", True, ""),
    ("classification_contract.matches[].paragraph_ids[]", "text", False, ""), ("classification_contract.matches[].confidence", "confidence", False, ""), ("classification_contract.matches[].reason", "text", False, ""),
    ("classification_contract.unmatched_paragraph_ids", "any_texts", False, ""), ("classification_contract.unmatched_paragraph_ids[]", "text", False, ""), ("classification_contract.conflicts", "array", False, ""),
    ("classification_contract.conflicts[]", "object", False, ""), ("classification_contract.conflicts[].paragraph_id", "text", True, ""), ("classification_contract.conflicts[].candidate_semantic_keys", "texts", True, ""),
    ("classification_contract.conflicts[].candidate_semantic_keys[]", "key", False, ""), ("classification_contract.conflicts[].reason", "text", False, ""),
    ("classification_contract.overall_confidence", "confidence", False, ""), ("validation_policy", "object", True, ""), ("validation_policy.min_confidence", "confidence", False, ""),
    ("validation_policy.enforce_validation", "boolean", False, ""), ("validation_policy.require_all_required_semantics", "boolean", False, ""), ("validation_policy.reject_conflicting_matches", "boolean", False, ""),
    ("validation_policy.reject_order_violations", "boolean", False, ""), ("validation_policy.reject_style_violations", "boolean", False, ""), ("validation_policy.reject_unmatched_when_required", "boolean", False, ""),
    *[(f"{at}.language_font_overrides{rest}", rule, needed, "") for at in ("derived_semantics[].operation", "operation_blocks[]") for rest, rule, needed in (("", "object", False), (".zh", "object", False), (".en", "object", False),
        (".zh.font_name", "text", True), (".en.font_name", "text", True))],
)
# The field that an operation of a type must have, and its rule.
OPERATION_FIELDS = (
    ("set_attr", "name", "text"), ("remove_attr", "name", "text"), ("ensure_node", "xml_tag", "text"), ("replace_node_xml", "node_xml", "text"), ("set_run_style", "text_style", "object"),
    ("set_section_layout", "section_layout", "object"), ("set_table_style", "table_style", "object"), ("set_table_cell_style", "cell_style", "object"), ("set_style_definition", "style_definition", "object"),
    ("set_numbering_level", "numbering_level", "object"), ("set_settings_flag", "settings", "object"),
)
OPEN_OBJECTS = (".language_font_overrides", ("zh", "en")), (".language_font_overrides.zh", ("font_name",)), (".language_font_overrides.en", ("font_name",))
BATCH_ROWS = 20_000
ROWS = "template_id string, path string, pattern string, parent string, name string, kind string, value string, members array<string>, blocks string"
# What the operation of a type must have: a field, its rule, and a field that does as well.
NEEDED_FIELDS = (*[(of, field, rule, field) for of, field, rule in OPERATION_FIELDS], ("set_paragraph_style", "paragraph_style", "", "style_id"))


def contract_rows(contracts: DataFrame) -> DataFrame:
    """(template_id, path, pattern, parent, name, kind, value, members, blocks) of every value of JSON texts (template_id, contract).

    The pattern is the path without places in arrays; an array or object has its number of members as value, an object
    their names as members. Blocks names the array of blocks that counts in the whole contract: operation_blocks only
    without patch_blocks, blank without both. A text that is no JSON is one row of kind broken.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        kinds = {dict: "object", list: "array", str: "text", bool: "boolean", int: "number", float: "number", type(None): "null"}
        rows: list[tuple] = []
        for pdf in frames:
            for template, text in zip(pdf["template_id"], pdf["contract"]):
                if len(rows) >= BATCH_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
                try:
                    whole = json.loads(text or "")
                    stack = [("", "", None, "", whole)]
                    arrays = [k for k in ("patch_blocks", "operation_blocks") if isinstance(whole, dict) and isinstance(whole.get(k), list) and whole[k]]
                    blocks = arrays[0] if arrays else ""
                except ValueError:
                    stack = []
                    rows.append((template, "", "", None, "", "broken", None, None, ""))
                while stack:
                    path, pattern, parent, name, v = stack.pop()
                    kind = kinds[type(v)]
                    shown = str(len(v)) if isinstance(v, (dict, list)) else json.dumps(v) if not isinstance(v, str) else v
                    rows.append((template, path, pattern, parent, name, kind, None if v is None else shown, list(v) if isinstance(v, dict) else None, blocks))
                    if isinstance(v, dict):
                        dot = "." if path else ""
                        stack += [(f"{path}{dot}{k}", f"{pattern}{dot}{k}", path, k, x) for k, x in v.items()]
                    elif isinstance(v, list):
                        stack += [(f"{path}[{i}]", f"{pattern}[]", path, f"[{i}]", x) for i, x in enumerate(v)]
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return contracts.select(F.col("template_id").cast("string").alias("template_id"), "contract").mapInPandas(walk, ROWS)


def _fails(rule: Column, kind: Column, value: Column, allowed: Column) -> Column:
    """Whether a kind and value break a rule."""
    blank = (kind != "text") | (F.trim(value) == "")
    number = F.when(kind == "number", value.try_cast("double"))
    return (
        F.when(rule == "object", kind != "object").when(rule.isin("array", "any_texts"), kind != "array").when(rule.isin("texts", "filled"), (kind != "array") | (value == "0"))
        .when(rule.isin("text", "key"), blank).when(rule == "boolean", kind != "boolean").when(rule == "confidence", number.isNull() | (number < 0) | (number > 1))
        .when(rule == "ordinal", number.isNull() | (number < 0) | (number != F.floor(number))).when(rule == "choice", (kind != "text") | ~F.array_contains(F.split(allowed, "\\|"), value))
    )


def contract_problems(rows: DataFrame, catalogue: tuple = CATALOGUE) -> DataFrame:
    """(template_id, path, problem) of contract_rows: missing, wrong (by its rule), undeclared, duplicate, no_blocks,
    block_count, unsupported, broken. All problems of a contract come out, not the first alone.

    The catalogue is a small broadcast table. What a row shows by itself, or an object by the names of its members, is
    checked where it is read; fields of operations and semantic keys are few rows and take one aggregation each, so the
    plan stays small and only these rows move. The rows are read four times: give them as a written table.
    """
    spark = rows.sparkSession
    path, pattern, name, kind, value = (F.col(c) for c in ("path", "pattern", "name", "kind", "value"))
    problem = lambda at, what: F.struct(at.alias("path"), (F.lit(what) if isinstance(what, str) else what).alias("problem"))
    found = lambda checks: F.array_compact(F.array(*[F.when(when, problem(at, what)) for when, at, what in checks]))
    says = lambda df, problems: df.select("template_id", F.inline(problems))
    wrong = F.concat(F.lit("wrong "), "rule")
    live = rows.filter(~path.startswith("operation_blocks") | (F.col("blocks") != "patch_blocks"))

    needed: dict[str, list[str]] = {p: [] for p, *_ in catalogue}
    for p, _, must, _ in catalogue:
        over, _, field = p.rpartition(".")
        needed.setdefault(over, []).extend([field] if must else [])
    rules = [(p, r, a, needed[p]) for p, r, _, a in catalogue] + [(p, None, None, needed[p]) for p in needed.keys() - {p for p, *_ in catalogue}]
    cat = F.broadcast(spark.createDataFrame(rules, "pattern STRING, rule STRING, allowed STRING, needed ARRAY<STRING>"))
    typed = live.join(cat, "pattern", "left")
    above = F.regexp_replace("pattern", "\\.[^.]*$", "")
    checks = [
        (kind == "broken", path, "broken"),
        (_fails(F.col("rule"), kind, value, F.col("allowed")), path, wrong),
        (F.col("parent").isNull() & (kind != "broken") & (F.col("blocks") == ""), F.lit("patch_blocks"), "no_blocks"),
        *[(above.endswith(end) & ~name.isin(*names), path, "unsupported") for end, names in OPEN_OBJECTS],
    ]
    out = says(typed.filter(reduce(Column.__or__, [when for when, *_ in checks])), found(checks))
    lost = typed.filter(kind == "object").select("template_id", "path", F.explode(F.array_except("needed", "members")).alias("field"))
    out = out.unionByName(lost.select("template_id", F.concat(path, F.when(path == "", "").otherwise("."), "field").alias("path"), F.lit("missing").alias("problem")))

    fields = live.filter((pattern == F.concat(F.lit("patch_blocks[].operations[]."), name)) & name.isin("type", *{x for _, field, _, other in NEEDED_FIELDS for x in (field, other)}))
    operations = fields.groupBy("template_id", "parent").agg(F.max(F.when(name == "type", value)).alias("type"), F.collect_list(F.struct("name", "kind", "value")).alias("members"))
    kinds = F.broadcast(spark.createDataFrame(list(NEEDED_FIELDS), "type STRING, field STRING, rule STRING, other STRING"))
    asked = operations.join(kinds, "type").withColumn("given", F.filter("members", lambda x: x["name"].isin(F.col("field"), F.col("other"))))
    at = F.concat("parent", F.lit("."), "field")
    out = out.unionByName(says(asked, found([(F.size("given") == 0, at, "missing"), (F.exists("given", lambda x: _fails(F.col("rule"), x["kind"], x["value"], F.lit(""))), at, wrong)])))

    semantic, derived = ((pattern == p) & (kind == "text") for p in ("semantic_blocks[].key", "derived_semantics[].key"))
    block = pattern == "operation_blocks[].semantic_key"
    refers = pattern.isin([p for p, r, *_ in catalogue if r == "key"]) & (kind == "text") & (F.trim(value) != "")
    counts = [F.count_if(x).alias(n) for x, n in ((semantic, "declared"), (derived, "derived"), (block, "n"))]
    keys = live.filter(semantic | derived | block | refers).groupBy("template_id", "value").agg(*counts, F.max("blocks").alias("blocks"), F.collect_list(F.when(refers, path)).alias("paths"))
    checks = [
        (F.col("declared") > 1, F.concat(F.lit("semantic_blocks."), value), "duplicate"),
        ((F.col("derived") > 1) | ((F.col("derived") > 0) & (F.col("declared") > 0)), F.concat(F.lit("derived_semantics."), value), "duplicate"),
        ((F.col("declared") > 0) & (F.col("blocks") == "operation_blocks") & (F.col("n") != 1), F.concat(F.lit("operation_blocks."), value), "block_count"),
    ]
    undeclared = F.transform(F.filter("paths", lambda _: F.col("declared") == 0), lambda p: problem(p, "undeclared"))
    return out.unionByName(says(keys, F.concat(found(checks), undeclared))).distinct()
