"""Recommendations for failed extractions, their order and a plan of action for each document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import FAILURES, OCR, pick

#: What is done about each kind of failure, in order: kind, type of action, action, priority, probability of success, effort, tools, prerequisites.
TEMPLATES = (
    ("encoding_error", "reprocess", "Detect correct encoding and reprocess document", "high", 0.85, "low", ("chardet", "ftfy"), ("chardet library available",)),
    ("encoding_error", "postprocessing", "Apply text correction algorithms", "medium", 0.60, "low", ("ftfy", "unidecode"), ()),
    ("ocr_failure", "tool_change", "Use alternative OCR engine with preprocessing", "medium", 0.70, "medium", ("tesseract", "easyocr", "pillow"), ("Alternative OCR tool available", "Original document images")),
    ("ocr_failure", "preprocessing", "Enhance image quality before OCR", "medium", 0.50, "low", ("pillow", "opencv"), ()),
    ("structure_loss", "manual_fix", "Manually reconstruct document structure", "high", 0.60, "high", ("text_editor", "regex_tools", "structure_templates"), ("Domain expertise", "Original document access")),
    ("content_gaps", "reprocess", "Compare multiple extraction methods", "medium", 0.75, "medium", ("multiple_extractors", "diff_tools"), ("Alternative extraction tools",)),
    ("table_corruption", "tool_change", "Use specialized table extraction tools", "medium", 0.65, "medium", ("tabula", "camelot", "pandas"), ("Table extraction libraries",)),
    ("incomplete_extraction", "tool_change", "Try alternative extraction approach", "high", 0.40, "high", ("alternative_extractors", "file_converters"), ("Alternative tools available", "Original file access")),
)
#: The check that follows each kind's actions.
VALIDATION = ("validation", "Validate fix for ", "low", 0.90, "low", ("validation_scripts",), ("Fix implementation completed",))
#: Orders of severities, of types of action and of priorities.
SEVERITIES = ("critical", "high", "medium", "low")
ACTIONS = ("preprocessing", "reprocess", "tool_change", "parameter_adjust", "postprocessing", "manual_fix", "validation")
PRIORITIES = ("urgent", "high", "medium", "low", "optional")
#: Weights of priorities, of probability, penalties and hours of effort.
WEIGHTS, CHANCE = {"urgent": 100, "high": 75, "medium": 50, "low": 25, "optional": 10}, 30
PENALTIES, HOURS = {"low": 0, "medium": 10, "high": 25, "expert": 40}, {"low": 2, "medium": 8, "high": 24, "expert": 40}
#: Phases by type of action, in order; hours of a day, and over which a plan is of medium and high complexity.
PHASES = (("Quick Fixes", ("postprocessing", "parameter_adjust")), ("Tool Changes", ("reprocess", "tool_change", "preprocessing")), ("Manual Interventions", ("manual_fix",)), ("Validation", ("validation",)))
DAY, MEDIUM_OVER, HIGH_OVER = 8, 16, 40
EARLY = 1000  # position up to which a high failure makes its advice high
#: Patterns in the order in which detectors find them.
DETECTED = (*(n for k, n, *_ in FAILURES if k == "encoding_error"), *(n for _, n, *_ in OCR), "short_section", "large_whitespace_gap", "insufficient_sections", "corrupted_table", "severely_incomplete", "potentially_incomplete")
ROW = "kind string, nth int, action_type string, action string, own_priority string, chance double, effort string, tools array<string>, prerequisites array<string>"


def templates() -> list[tuple]:
    """(kind, nth, ...) of every action, the validation being the last of its kind."""
    rows, count = [], {}
    for kind, *rest in TEMPLATES:
        count[kind] = count.get(kind, -1) + 1
        rows.append((kind, count[kind], *rest))
    action_type, action, *rest = VALIDATION
    return [*rows, *((kind, n + 1, action_type, action + kind, *rest) for kind, n in count.items())]


def place(value: Column, order: tuple) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), value)


def phase(action_type: Column) -> Column:
    return F.coalesce(*(F.when(action_type.isin(*kinds), name) for name, kinds in PHASES))


def recommendations(issues: DataFrame) -> DataFrame:
    """(document_id, place, kind, action_type, action, priority, probability, effort, phase, score, tools, prerequisites), each action once a document.

    Of a document's failures of one kind the first decides priority and probability: the most severe, then in the order of
    detection. Actions are ordered by type, priority and the failure they are for; `score` is what fixes are ranked by.
    """
    first = F.struct(place(F.col("severity"), SEVERITIES).alias("s"), place(F.col("pattern"), DETECTED).alias("p"), "position", "confidence", "severity")
    kinds = issues.groupBy("document_id", "kind").agg(F.min(first).alias("f"))
    actions = issues.sparkSession.createDataFrame(templates(), ROW)
    made = kinds.join(actions, "kind")  # a few rows of templates
    checks = F.col("action_type") == "validation"
    priority = F.when(checks, F.col("own_priority")).when(F.col("f.severity") == "critical", "urgent").when((F.col("f.severity") == "high") & (F.col("f.position") < EARLY), "high").otherwise(F.col("own_priority"))
    probability = F.when(checks, F.col("chance")).otherwise(F.least(F.lit(0.95), F.col("chance") * (0.5 + F.col("f.confidence") * 0.5)))
    made = made.withColumn("priority", priority).withColumn("probability", F.round(probability, 6))
    score = pick(F.col("priority"), WEIGHTS, 50) + F.col("probability") * CHANCE - pick(F.col("effort"), PENALTIES, 15)
    order = Window.partitionBy("document_id").orderBy(place(F.col("action_type"), ACTIONS), place(F.col("priority"), PRIORITIES), "f", "nth")  # of the few actions there are
    return made.select(
        "document_id", F.row_number().over(order).alias("place"), "kind", "action_type", "action", "priority", "probability", "effort", phase(F.col("action_type")).alias("phase"), F.round(score, 6).alias("score"), "tools", "prerequisites"
    )


def action_plans(advice: DataFrame) -> DataFrame:
    """(document_id, recommendations, phases, hours, days, complexity, tools, prerequisites): one plan for each document.

    phases: the names of those that have actions, each with the places of its actions by falling score.
    """
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "place", "phase")))
    sums = advice.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("recommendations"), ranked.alias("ranked"), F.sum(pick(F.col("effort"), HOURS, 8)).alias("hours"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tools")))).alias("tools"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("prerequisites")))).alias("prerequisites"),
    )
    one = lambda name: F.transform(F.filter("ranked", lambda r: r["phase"] == name), lambda r: r["place"].cast("string"))
    phases = F.array_join(F.array_compact(F.array(*(F.when(F.size(one(name)) > 0, F.concat(F.lit(f"{name}: "), F.array_join(one(name), ","))) for name, _ in PHASES))), "; ")
    complexity = F.when(F.col("hours") > HIGH_OVER, "high").when(F.col("hours") > MEDIUM_OVER, "medium").otherwise("low")
    return sums.select("document_id", "recommendations", phases.alias("phases"), "hours", F.greatest(F.lit(1).cast("long"), F.floor(F.col("hours") / DAY)).alias("days"), complexity.alias("complexity"), "tools", "prerequisites")


def joined(columns: DataFrame, *names: str) -> DataFrame:
    return reduce(lambda df, n: df.withColumn(n, F.array_join(n, ", ")), names, columns)
