"""Template classification over a predictions table: batches, cleaning, aggregation, refinement, derived semantics.

Rule tables are small by nature (a template has tens of semantics) and are given as Python tuples, so they reach the
plan as literal relations, which Spark broadcasts under its own size check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Bucket order, the fallback semantic and the image aliases.
BUCKET_ORDER = ("heading", "title", "subtitle", "body", "list_item", "table_text", "unknown")
FALLBACK = "blank_or_unknown"
COVER_IMAGE = "cover_image"
IMAGE_ALIASES = ("image", "cover_picture", "picture", "cover_image")


def exact_mean(total: Column, n: Column) -> Column:
    """total / n to six decimals; total is a sum of decimals, so the order of rows doesn't matter."""
    return F.round((total.cast("double") / n).cast("decimal(38,12)"), 6).cast("double")


def _decimal(c: str) -> Column:
    return F.col(c).cast("decimal(18,6)")


def classification_batches(context: DataFrame, n: int = 12) -> DataFrame:
    """Batches of at most n paragraphs of one bucket; batch numbers follow the bucket order."""
    rank = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(i)) for i, b in enumerate(BUCKET_ORDER)], F.lit(len(BUCKET_ORDER)))
    place = F.row_number().over(Window.partitionBy("doc_id", "bucket").orderBy("paragraph_index")) - 1
    out = context.select("doc_id", "paragraph_id", "bucket", rank.alias("rank"), F.floor(place / n).alias("in_bucket"))
    return out.withColumn("batch_id", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("rank", "in_bucket")) - 1).drop("rank", "in_bucket")


def byte_batches(context: DataFrame, n: int = 12, most: int = 16_000) -> DataFrame:
    """classification_batches, with batches of more than most bytes of text halved until they fit or hold one paragraph.

    The first half is the longer one. A batch of n paragraphs needs log2(n) rounds of halving at most; all rounds are
    windows of one document, so they share its shuffle.
    """
    whole = Window.partitionBy("doc_id", "bucket", "in_bucket", "half")
    place = F.row_number().over(Window.partitionBy("doc_id", "bucket").orderBy("paragraph_index")) - 1
    out = context.select("doc_id", "paragraph_id", "paragraph_index", "bucket", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.floor(place / n).alias("in_bucket"), F.lit("").alias("half"))
    for _ in range(max(0, n - 1).bit_length()):
        at = F.row_number().over(whole.orderBy("paragraph_index"))
        count, size = F.count("*").over(whole), F.sum("size").over(whole)
        cut = F.when((size > most) & (count > 1), F.when(at <= F.ceil(count / 2), "0").otherwise("1")).otherwise("")
        out = out.withColumn("half", F.concat("half", cut))
    order = Window.partitionBy("doc_id", "bucket").orderBy("in_bucket", "half")
    return out.select("doc_id", "bucket", "paragraph_id", (F.dense_rank().over(order) - 1).alias("batch"))


def semantic_alias(c: Column | str, has_cover: bool = True) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return F.when(F.lower(x).isin(*IMAGE_ALIASES), COVER_IMAGE).otherwise(x) if has_cover else x


def coerce_predictions(predictions: DataFrame, paragraphs: DataFrame, semantics: tuple[str, ...]) -> DataFrame:
    """Predictions with what is wrong with them (note); confidence only where it is in [0, 1]; repeats of a semantic
    and paragraph become one with the mean confidence."""
    confidence = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    known = paragraphs.select("doc_id", "paragraph_id").withColumn("_here", F.lit(True))
    rows = predictions.withColumn("semantic_key", semantic_alias("semantic_key")).join(known, ["doc_id", "paragraph_id"], "left")
    note = F.when(~F.col("semantic_key").isin(*semantics), "unknown_semantic").when(F.col("_here").isNull(), "out_of_scope")
    rows = rows.select("doc_id", "paragraph_id", "semantic_key", confidence.alias("confidence"), note.alias("note"))
    return rows.groupBy("doc_id", "paragraph_id", "semantic_key", "note").agg(exact_mean(F.sum(_decimal("confidence")), F.count("confidence")).alias("confidence"), F.count("*").alias("n"))


def aggregate_predictions(predictions: DataFrame) -> DataFrame:
    """Per semantic: distinct paragraphs in document order, mean of all confidences (repeats count), 6 decimals, and,
    where predictions give them, the distinct reasons in alphabetic order."""
    reasons = ["reason"] if "reason" in predictions.columns else []
    per = predictions.groupBy("doc_id", "semantic_key", "paragraph_id", "paragraph_index").agg(
        F.sum(_decimal("confidence")).alias("s"), F.count("confidence").alias("n"), *[F.collect_set(c).alias(c) for c in reasons]
    )
    rows = F.array_sort(F.collect_list(F.struct("paragraph_index", "paragraph_id")))
    joined = [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), "; ").alias("reasons") for c in reasons]
    return per.groupBy("doc_id", "semantic_key").agg(F.transform(rows, lambda x: x["paragraph_id"]).alias("paragraph_ids"), exact_mean(F.sum("s"), F.sum("n")).alias("confidence"), *joined)


def unmatched_paragraphs(paragraphs: DataFrame, predictions: DataFrame, reported: DataFrame) -> DataFrame:
    """Reported as unmatched, or never matched; a reported one stays even where it is matched."""
    never = paragraphs.select("doc_id", "paragraph_id").join(predictions, ["doc_id", "paragraph_id"], "left_anti")
    return never.unionByName(reported.select("doc_id", "paragraph_id")).distinct()


def overall_confidence(matches: DataFrame) -> DataFrame:
    n = F.size("paragraph_ids")
    return matches.filter("confidence IS NOT NULL").groupBy("doc_id").agg(exact_mean(F.sum(_decimal("confidence") * n), F.sum(n)).alias("overall"))


def aggregate_conflicts(conflicts: DataFrame, semantics: tuple[str, ...]) -> DataFrame:
    """Per paragraph the candidate semantics in template order and the distinct reasons."""
    rank = F.coalesce(*[F.when(F.col("semantic_key") == s, F.lit(i)) for i, s in enumerate(semantics)], F.lit(len(semantics)))
    rows = F.array_sort(F.collect_set(F.struct(rank.alias("rank"), "semantic_key")))
    out = conflicts.groupBy("doc_id", "paragraph_id").agg(F.transform(rows, lambda x: x["semantic_key"]).alias("candidates"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return out


def rules_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A template's rows as a local relation of the plan, whose size Spark knows. schema: "name TYPE, ..."."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "r'" + v + "'" if "'" not in v else '"' + v.replace("\\", "\\\\") + '"'
        return str(v).lower() if isinstance(v, bool) else repr(v)

    columns = [c.split() for c in schema.split(",")]
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in columns)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({', '.join(n for n, _ in columns)})")


def _placed(context: DataFrame) -> DataFrame:
    """context with the number of its document's paragraphs (n) and the first one that is not blank (first_text).

    The rows go to their document with all their columns: a context that has blank needs no text for it.
    """
    whole = Window.partitionBy("doc_id")
    blank = F.col("blank") if "blank" in context.columns else F.trim("text") == ""
    first = F.min(F.when(~blank, F.col("paragraph_index"))).over(whole)
    return context.withColumn("n", F.count("*").over(whole)).withColumn("first_text", first)


def _position_holds(hint: str) -> Column:
    near = F.col("paragraph_index") < F.greatest(F.lit(2), F.floor(F.col("n") * 0.2))
    return (
        F.when(F.col(hint) == "near_top", near).when(F.col(hint) == "first_paragraph", F.col("paragraph_index") == 0)
        .when(F.col(hint) == "first_non_blank", F.coalesce(F.col("paragraph_index") == F.col("first_text"), F.lit(True))).otherwise(True)
    )


def position_ok(context: DataFrame, rules: DataFrame) -> DataFrame:
    """Paragraph x rule pairs whose position hint holds: near_top, first_paragraph, first_non_blank or none."""
    hints = F.broadcast(rules.select("semantic_key", F.col("position_hint").alias("position")))
    return _placed(context).join(hints, _position_holds("position")).drop("n", "first_text")


def compatible_semantics(context: DataFrame, rules: DataFrame) -> DataFrame:
    """Paragraph x semantic pairs that a rule accepts: image, blank text, table, role, bucket (where rules have one),
    heading level and position. A theta join with a template's few rules."""
    bucket = F.col("bucket") if "bucket" in rules.columns else F.lit(None).cast("string")
    r = rules.select(
        "semantic_key", F.col("role").alias("want_role"), F.col("in_table").alias("want_table"), F.col("require_image").alias("want_image"), F.col("allow_empty").alias("may_be_empty"),
        F.col("heading_level").alias("want_level"), bucket.alias("want_bucket"), F.col("position_hint").alias("want_place"),
    )
    c = _placed(context.select("doc_id", "paragraph_id", "paragraph_index", (F.trim("text") == "").alias("blank"), "role", "bucket", "in_table", "has_image", "heading_level"))
    ok = (
        (F.col("want_role").isNull() | (F.col("want_role") == F.col("role"))) & (F.col("want_table").isNull() | (F.col("want_table") == F.col("in_table")))
        & (F.col("want_bucket").isNull() | (F.col("want_bucket") == F.col("bucket")))
        & (~F.col("want_image") | F.col("has_image")) & (F.col("may_be_empty") | ~F.col("blank"))
        & (F.col("want_level").isNull() | F.coalesce(F.col("want_level") == F.col("heading_level"), F.lit(False))) & _position_holds("want_place")
    )
    return c.join(F.broadcast(r), ok).select("doc_id", "paragraph_id", "semantic_key")


def refinement_targets(predictions: DataFrame, conflicts: DataFrame, compatible: DataFrame, least: float) -> DataFrame:
    """Paragraphs of weak matches and conflicts, one row each with all candidates; the conflict source wins."""
    weak = predictions.filter(F.col("confidence") < least).select("doc_id", "paragraph_id", "semantic_key", F.lit("low_confidence").alias("source"), "confidence")
    torn = conflicts.select("doc_id", "paragraph_id", "semantic_key", F.lit("conflict").alias("source"), F.lit(None).cast("double").alias("confidence"))
    both = weak.unionByName(torn)
    head = both.groupBy("doc_id", "paragraph_id").agg(F.min("source").alias("source"), F.min("confidence").alias("confidence"))
    more = compatible.join(head.select("doc_id", "paragraph_id"), ["doc_id", "paragraph_id"], "left_semi").select("doc_id", "paragraph_id", "semantic_key")
    cands = both.select("doc_id", "paragraph_id", "semantic_key").unionByName(more).groupBy("doc_id", "paragraph_id")
    cands = cands.agg(F.array_sort(F.array_union(F.collect_set("semantic_key"), F.array(F.lit(FALLBACK)))).alias("candidates"))
    return head.join(cands, ["doc_id", "paragraph_id"])


def refinement_outcome(targets: DataFrame, decisions: DataFrame, least: float) -> DataFrame:
    """One of seven outcomes of a second decision. decisions: semantic_key, confidence, n_candidates, unmatched."""
    d = targets.join(decisions.withColumn("_decided", F.lit(True)), ["doc_id", "paragraph_id"], "left")
    named = F.col("semantic_key").isNotNull()
    return d.withColumn(
        "outcome",
        F.when(F.col("_decided").isNull(), "rejected_invalid")
        .when(named & ~F.array_contains("candidates", F.col("semantic_key")), "rejected_invalid")
        .when(named & (F.col("semantic_key") == FALLBACK), "accepted_blank_or_unknown")
        .when(named & (F.col("second_confidence") < least), "rejected_low_confidence")
        .when(named & F.col("second_confidence").isNotNull(), "accepted").when(named, "accepted_without_confidence")
        .when(F.col("n_candidates") > 0, "rejected_conflict").when(F.col("unmatched"), "rejected_unmatched").otherwise("rejected_invalid"),
    ).drop("_decided")


def apply_refinement(predictions: DataFrame, accepted: DataFrame) -> DataFrame:
    """First-pass rows of accepted paragraphs leave, the accepted decisions come in, and all is aggregated again."""
    kept = predictions.join(accepted.select("doc_id", "paragraph_id"), ["doc_id", "paragraph_id"], "left_anti")
    cols = ["doc_id", "paragraph_id", "paragraph_index", "semantic_key", "confidence"]
    return aggregate_predictions(kept.select(*cols).unionByName(accepted.select(*cols)))


def blank_fallback(unmatched: DataFrame, context: DataFrame, rules: DataFrame) -> DataFrame:
    """Unmatched paragraphs without image that are blank or of unknown bucket, as matches of the fallback semantic.

    Only where the template defines that semantic and lets its text be empty.
    """
    defined = rules.filter((F.col("semantic_key") == FALLBACK) & F.col("allow_empty")).select("semantic_key").distinct()
    c = context.filter(~F.col("has_image") & ((F.trim("text") == "") | (F.col("bucket") == "unknown")))
    hit = unmatched.join(c.select("doc_id", "paragraph_id", "paragraph_index"), ["doc_id", "paragraph_id"]).withColumn("semantic_key", F.lit(FALLBACK))
    hit = hit.join(F.broadcast(defined), "semantic_key", "left_semi")
    return hit.select("doc_id", "paragraph_id", "paragraph_index", "semantic_key", F.lit(None).cast("double").alias("confidence"))


def normalize_predictions(predictions: DataFrame, context: DataFrame, semantics: tuple[str, ...], rules: DataFrame, derived: list[dict] = ()) -> DataFrame:
    """Cleaned predictions, the blank fallback of what is left unmatched, and the derived semantics, aggregated."""
    clean = coerce_predictions(predictions, context, semantics).filter("note IS NULL").join(context.select("doc_id", "paragraph_id", "paragraph_index"), ["doc_id", "paragraph_id"])
    clean = clean.select("doc_id", "paragraph_id", "paragraph_index", "semantic_key", "confidence")
    none = context.select("doc_id", "paragraph_id").join(clean, ["doc_id", "paragraph_id"], "left_anti")
    rows = clean.unionByName(blank_fallback(none, context, rules))
    for part in derived_rows(rows, context, derived):
        rows = rows.unionByName(part)
    return aggregate_predictions(rows)


def derived_rows(predictions: DataFrame, context: DataFrame, derived: list[dict], parts: bool = True) -> list[DataFrame]:
    """The rows of each derived semantic. aggregate: all paragraphs of the parents; refine: those whose text holds (or,
    with parts, is part of) an example or hint and holds no negative one. The derived semantics are few: a filter each."""
    p = predictions.join(context.select("doc_id", "paragraph_id", F.lower("text").alias("low")), ["doc_id", "paragraph_id"])
    out = []
    for d in derived:
        rows = p.filter(F.col("semantic_key").isin(*d["parents"]))
        if d["mode"] == "refine":
            good, bad = F.lit(False), F.lit(False)
            for hint in d["hints"]:
                good = good | F.col("low").contains(hint.lower())
                if parts:
                    good = good | ((F.trim("low") != "") & F.lit(hint.lower()).contains(F.col("low")))
            for hint in d.get("negative", ()):
                bad = bad | F.col("low").contains(hint.lower())
            rows = rows.filter(good & ~bad)
        out.append(rows.withColumn("semantic_key", F.lit(d["key"])).drop("low"))
    return out


def derive_semantics(predictions: DataFrame, context: DataFrame, derived: list[dict]) -> DataFrame:
    """Paragraphs and mean confidence of each derived semantic."""
    out = None
    for rows in derived_rows(predictions, context, derived):
        part = rows.groupBy("doc_id", "semantic_key").agg(F.countDistinct("paragraph_id").alias("n_paragraphs"), exact_mean(F.sum(_decimal("confidence")), F.count("confidence")).alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out


def unmatched_diagnostics(unmatched: DataFrame, context: DataFrame, conflicts: DataFrame) -> DataFrame:
    torn = conflicts.groupBy("doc_id", "paragraph_id").agg(F.array_sort(F.collect_set("semantic_key")).alias("candidates"))
    out = unmatched.join(context.select("doc_id", "paragraph_id", "role", "bucket", "paragraph_index", "text"), ["doc_id", "paragraph_id"]).join(torn, ["doc_id", "paragraph_id"], "left")
    from foliant.functions.text import truncate_text

    reason = F.when(F.col("candidates").isNull(), "no_candidate").otherwise("conflict_excluded")
    return out.select("doc_id", "paragraph_id", "role", "bucket", "paragraph_index", truncate_text("text", 120).alias("excerpt"), reason.alias("reason"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def unknown_semantics(predictions: DataFrame, semantics: tuple[str, ...]) -> DataFrame:
    return predictions.filter(~F.col("semantic_key").isin(*semantics)).groupBy("doc_id", "semantic_key").agg(F.countDistinct("paragraph_id").alias("n_paragraphs"))


def local_context(context: DataFrame, targets: DataFrame, radius: int = 1) -> DataFrame:
    """Neighbours of each target within radius: each target names its neighbours' positions, an equi-join finds them."""
    t = targets.join(context.select("doc_id", "paragraph_id", "paragraph_index"), ["doc_id", "paragraph_id"])
    spots = t.select("doc_id", F.col("paragraph_id").alias("target_id"), F.col("paragraph_index").alias("at"), F.explode(F.sequence(F.col("paragraph_index") - radius,
        F.col("paragraph_index") + radius)).alias("paragraph_index")).filter("at <> paragraph_index")
    return spots.join(context.select("doc_id", "paragraph_index", "paragraph_id"), ["doc_id", "paragraph_index"]).select("doc_id", "target_id", "paragraph_id", (F.col("paragraph_index") - F.col("at")).alias("offset"))


def classify(context: DataFrame, rules: DataFrame, fn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The user's classifier, or the default: the first semantic by rank that accepts the paragraph, a hint first."""
    if fn is not None:
        return fn(context)
    ok = compatible_semantics(context, rules).join(F.broadcast(rules.select("semantic_key", "rank", "hint")), "semantic_key")
    ok = ok.join(context.select("doc_id", "paragraph_id", "text"), ["doc_id", "paragraph_id"])
    hit = (F.col("hint") != "") & F.lower("text").contains(F.lower("hint"))
    best = ok.groupBy("doc_id", "paragraph_id").agg(F.min_by("semantic_key", F.struct(~hit, "rank")).alias("semantic_key"), F.max(hit).alias("by_hint"))
    return best.select("doc_id", "paragraph_id", "semantic_key", F.when(F.col("by_hint"), 0.9).otherwise(0.6).alias("confidence"))
