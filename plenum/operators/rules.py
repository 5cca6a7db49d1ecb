"""Rule-based classification of messages into issues, and its validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions import fixed
from plenum.functions.text import _col, any_of, issue_key, let, strip
from plenum.operators.ranking import computed

ISSUE_TYPE = (
    "array<struct<primary_category:string,secondary_category:string,stance:string,"
    "specific_concern:string,is_root_cause:boolean>>"
)
FINDING_TYPE = "array<struct<severity:string,issue_type:string,description:string>>"


def _issue(issue: fixed.Issue) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in issue._asdict().items()])


def _no_issues() -> Column:
    return F.array().cast(ISSUE_TYPE)


def _triggered(text: Column, patterns: list[str]) -> Column:
    return text.rlike(any_of(patterns))


def uncategorised_reason(c: Column | str) -> Column:
    """Why a message is no local issue; the first of five ordered groups wins."""
    text = strip(F.lower(_col(c)))
    hits = [F.when(_triggered(text, patterns), F.lit(reason)) for reason, patterns in fixed.UNCATEGORIZED_RULES]
    return F.coalesce(*hits)


def required_issues(c: Column | str) -> Column:
    """Issues that the text demands, in rule order."""
    text = F.lower(_col(c))
    parts = [
        F.when(_triggered(text, rule["triggers"]), F.array(*[_issue(i) for i in rule["required"]])).otherwise(
            _no_issues()
        )
        for rule in fixed.CATEGORY_RULES
    ]
    return F.concat(*parts)


def avoided_categories(c: Column | str) -> Column:
    """Category keys that the text rules out."""
    text = F.lower(_col(c))
    parts = [
        F.when(_triggered(text, rule["triggers"]), F.array(*[F.lit(k) for k in rule["avoid"]])).otherwise(
            F.array().cast("array<string>")
        )
        for rule in fixed.CATEGORY_RULES
        if rule["avoid"]
    ]
    return F.concat(*parts)


def mentions_ebike(c: Column | str) -> Column:
    return _triggered(F.lower(_col(c)), fixed.EBIKE_TRIGGERS)


def mentions_enforcement(c: Column | str) -> Column:
    return _triggered(F.lower(_col(c)), fixed.ENFORCEMENT_WORDS)


def refine_issues(issues: Column | str, c: Column | str) -> Column:
    """Business permits bring zoning in as a root cause."""
    permit = F.lower(_col(c)).rlike(f"(?d){fixed.BUSINESS_PERMIT_PATTERN}")
    extra = F.array(_issue(fixed.BUSINESS_PERMIT_ISSUE)).cast(ISSUE_TYPE)

    def refined(listed: Column) -> Column:
        business = F.exists(
            listed,
            lambda i: i["primary_category"].contains("economic_development") | i["secondary_category"].contains("business"),
        )
        zoning = F.exists(listed, lambda i: i["secondary_category"].contains("zoning_and_permits"))
        return F.when(permit & business & ~zoning, F.concat(listed, extra)).otherwise(listed)

    return let(_col(issues), refined)


def apply_rules(issues: Column | str, c: Column | str, strict_parity: bool = False) -> Column:
    """Add required issues that are missing, drop avoided ones, then the police rule."""
    facts = F.struct(
        F.coalesce(_col(issues), _no_issues()).alias("given"),
        required_issues(c).alias("required"),
        avoided_categories(c).alias("avoided"),
        (mentions_ebike(c) & ~mentions_enforcement(c)).alias("no_police"),
    )

    def combined(f: Column) -> Column:
        present = F.transform(f["given"], lambda i: F.lower(issue_key(i)))
        missing = F.filter(f["required"], lambda i: ~F.array_contains(present, F.lower(issue_key(i))))
        kept = F.filter(
            F.concat(f["given"], missing), lambda i: ~F.array_contains(f["avoided"], F.lower(issue_key(i)))
        )
        if strict_parity:
            return kept
        return F.filter(kept, lambda i: ~(i["secondary_category"].contains("police") & f["no_police"]))

    return let(facts, combined)


def overall_sentiment(issues: Column | str) -> Column:
    listed = _col(issues)
    positive = F.exists(listed, lambda i: i["stance"] == "positive")
    negative = F.exists(listed, lambda i: i["stance"] == "negative")
    angry = F.exists(listed, lambda i: F.lower(i["specific_concern"]).contains("angry"))
    return (
        F.when(F.size(listed) == 0, "other")
        .when(positive & negative, "constructive_detailed")
        .when(positive, "appreciative_positive")
        .when(F.coalesce(angry, F.lit(False)), "angry_confrontational")
        .otherwise("frustrated_urgent")
    )


def message_quality(issues: Column | str, c: Column | str) -> Column:
    length = F.length(strip(_col(c)))
    found = F.size(_col(issues))
    return F.when((length < 20) | (found == 0), "minimal_response").otherwise("substantive")


def content_type(issues: Column | str, c: Column | str) -> Column:
    listed = _col(issues)
    positive = F.exists(listed, lambda i: i["stance"] == "positive")
    requesting = F.exists(listed, lambda i: i["stance"] == "requesting")
    substantive = message_quality(listed, c) == "substantive"
    return (
        F.when(positive, "support_appreciation")
        .when(requesting & _col(c).contains("?"), "question_request")
        .when(requesting, "policy_feedback")
        .when((F.size(listed) > 0) & substantive, "policy_feedback")
        .otherwise("general_complaint")
    )


def confidence(issues: Column | str, c: Column | str) -> Column:
    length = F.length(strip(_col(c)))
    raw = F.lit(0.7) + F.size(_col(issues)) * 0.1 + F.least(length, F.lit(200)) / 1000
    return F.least(F.lit(0.95), raw)


def classify(
    df: DataFrame, text: str = "message_text", issues: str | None = None, strict_parity: bool = False
) -> DataFrame:
    """Classify messages; ``issues`` may name a column with issues found by other means.

    An uncategorised message gets no issues.
    """
    start = F.col(issues) if issues else _no_issues()
    df = computed(df, uncategorized_reason=uncategorised_reason(text))
    df = df.withColumn("should_be_uncategorized", F.col("uncategorized_reason").isNotNull())
    found = refine_issues(apply_rules(start, text, strict_parity), text)
    df = computed(df, issues=F.when(F.col("should_be_uncategorized"), _no_issues()).otherwise(found))
    return (
        df.withColumn("overall_sentiment", overall_sentiment("issues"))
        .withColumn("message_quality", message_quality("issues", text))
        .withColumn("content_type", content_type("issues", text))
        .withColumn("confidence_score", confidence("issues", text))
    )


def rule_violations(issues: Column | str, c: Column | str) -> Column:
    text, listed = F.lower(_col(c)), _col(issues)

    def has(part: str) -> Column:
        return F.exists(listed, lambda i: i["secondary_category"].contains(part))

    general_tax = text.rlike(r"property\s+tax") & has("budget_and_taxes") & ~has("taxes_and_assessments")
    police = mentions_ebike(text) & has("police") & ~mentions_enforcement(text)
    return F.array_compact(
        F.array(
            F.when(general_tax, F.lit("Property tax misclassified as general budget/taxes")),
            F.when(
                police,
                F.lit("E-bike/scooter incorrectly categorized as police issue without enforcement context"),
            ),
        )
    )


def _finding(severity: str, kind: str, description: Column) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(kind).alias("issue_type"), description.alias("description")
    )


def findings(c: Column | str, issues: Column | str, is_uncategorised: Column | str) -> Column:
    """All validation findings of one classified message."""
    text, listed, flagged = _col(c), _col(issues), _col(is_uncategorised)
    reason = uncategorised_reason(text)
    present = F.transform(listed, issue_key)
    none = F.array().cast(FINDING_TYPE)

    violations = F.transform(
        rule_violations(listed, text), lambda v: _finding("error", "classification_rule_violation", v)
    )
    missed = F.when(
        reason.isNotNull() & ~flagged,
        F.array(_finding("error", "missed_uncategorized", F.concat(F.lit("Message should be uncategorized: "), reason))),
    ).otherwise(none)
    contradictory = F.when(
        flagged & (F.size(listed) > 0),
        F.array(
            _finding("warning", "uncategorized_with_issues",
                     F.lit("Message marked uncategorized but has identified issues"))
        ),
    ).otherwise(none)
    missing = F.transform(
        F.filter(required_issues(text), lambda i: ~F.array_contains(present, issue_key(i))),
        lambda i: _finding("error", "missing_required_category",
                           F.concat(F.lit("Missing required category: "), issue_key(i))),
    )
    avoided = avoided_categories(text)
    used = let(
        avoided,
        lambda keys: F.transform(
            F.filter(listed, lambda i: F.array_contains(keys, issue_key(i))),
            lambda i: _finding("warning", "avoided_category_used",
                               F.concat(F.lit("Used category that should be avoided: "), issue_key(i))),
        ),
    )
    zoning_cause = F.exists(
        listed, lambda i: i["is_root_cause"] & F.lower(i["secondary_category"]).contains("zoning")
    )
    truck = F.when(
        F.lower(text).rlike("|".join(fixed.TRUCK_WORDS)) & ~F.coalesce(zoning_cause, F.lit(False)),
        F.array(
            _finding("suggestion", "missing_root_cause",
                     F.lit("Truck/warehouse complaint should include zoning as root cause"))
        ),
    ).otherwise(none)

    def clash(stance: str, words: list[str], label: str) -> Column:
        clashing = F.filter(
            listed,
            lambda i: (i["stance"] == stance) & F.lower(i["specific_concern"]).rlike("|".join(words)),
        )
        return F.transform(
            clashing,
            lambda i: _finding("warning", "stance_concern_mismatch", F.concat(F.lit(label), i["specific_concern"])),
        )

    return F.concat(
        violations, missed, contradictory, missing, used, truck,
        clash("positive", fixed.NEGATIVE_CONCERN_WORDS, "Positive stance but negative concern: "),
        clash("negative", fixed.POSITIVE_CONCERN_WORDS, "Negative stance but positive concern: "),
    )


def validate(df: DataFrame, text: str = "message_text") -> DataFrame:
    """Add findings, validity and the confidence they suggest."""
    df = computed(df, findings=findings(text, "issues", "should_be_uncategorized"))
    errors = F.size(F.filter("findings", lambda f: f["severity"] == "error"))
    warned = F.exists("findings", lambda f: f["severity"] == "warning")
    adjusted = F.when(errors > 0, F.greatest(F.lit(0.1), F.col("confidence_score") - errors * 0.2)).when(
        warned, F.greatest(F.lit(0.3), F.col("confidence_score") - 0.1)
    )
    return df.withColumn("is_valid", errors == 0).withColumn("confidence_adjustment", adjusted)


def taxonomy(spark: SparkSession) -> DataFrame:
    """The fixed category tree as rows."""
    rows = [
        (primary, secondary, f"{primary}/{secondary}", description)
        for primary, children in fixed.TAXONOMY.items()
        for secondary, description in children.items()
    ]
    return spark.createDataFrame(
        rows, "primary_category string, secondary_category string, category string, description string"
    )


def in_taxonomy(category: Column | str) -> Column:
    """Membership as an expression: the tree is fixed and small, no join is needed."""
    known = [f"{p}/{s}" for p, children in fixed.TAXONOMY.items() for s in children]
    return _col(category).isin(known)


def unknown_categories(df: DataFrame, issues: str = "issues") -> DataFrame:
    """Categories in use that the tree does not have, with their frequency."""
    keys = df.select(F.explode(issues).alias("i")).select(issue_key(F.col("i")).alias("category"))
    return keys.where(~in_taxonomy("category")).groupBy("category").agg(F.count("*").alias("mentions"))
