"""Checks of external results and requests: rules over columns, errors as codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark import vocab


def _issues(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of the rules that are broken; an unknown test counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def in_unit(value: Column) -> Column:
    return value.between(0.0, 1.0)


def filled(value: Column) -> Column:
    return value.isNotNull() & (F.length(value) > 0)


def bounded_list(values: Column, most: int, length: int | None = None, least: int = 0) -> Column:
    ok = values.isNotNull() & F.size(values).between(least, most)
    return ok if length is None else ok & F.forall(values, lambda v: F.length(v) <= length)


def field_issues(results: DataFrame) -> DataFrame:
    """Add ``issues`` to understanding results: texts, confidences, lists and nested entries.

    ``results(summary, entities<type,value,confidence>, candidates<title,confidence>, proposed_title,
    proposed_confidence, descriptors, notes)``.
    """
    c = F.col
    entity_ok = F.forall("entities", lambda e: filled(e["type"]) & filled(e["value"]) & in_unit(e["confidence"]))
    candidate_ok = F.forall("candidates", lambda e: filled(e["title"]) & in_unit(e["confidence"]))
    return results.withColumn("issues", _issues([
        ("summary_missing", c("summary").isNotNull()), ("entity_invalid", entity_ok), ("candidate_invalid", candidate_ok),
        ("proposal_invalid", c("proposed_title").isNull() | (filled(c("proposed_title")) & in_unit(c("proposed_confidence")))),
        ("descriptors_too_long", bounded_list(c("descriptors"), 12, 80)), ("notes_too_long", bounded_list(c("notes"), 8, 200))]))


def batch_issue(expected: Column, returned: Column, shared: Column, unresolved: Column) -> Column:
    """First broken rule of a batch result, as text, else NULL.  ``returned`` keeps repeats."""
    known = lambda ids: F.size(F.array_except(F.coalesce(ids, F.array().cast("array<string>")), returned)) == 0
    both = F.arrays_overlap(F.coalesce(shared, F.array().cast("array<string>")), F.coalesce(unresolved, F.array().cast("array<string>")))
    return (
        F.when(F.size(F.array_except(expected, returned)) > 0, "missing members")
        .when(F.size(returned) != F.size(expected), "member count mismatch")
        .when(~known(shared), "shared context names an unknown id").when(~known(unresolved), "unresolved names an unknown id")
        .when(both, "id is shared and unresolved"))


def banned_text(text: Column) -> Column:
    return text.rlike(vocab.BANNED_TEXT)


def forbidden_keys(json: Column, keys: Sequence[str] = vocab.FORBIDDEN_KEYS) -> Column:
    """Top-level keys of a JSON object that must not occur."""
    return F.array_intersect(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in keys]))


GROUP_RESULT = (
    "belongsTogether string, confidence double, sharedContextSummary string, supportingEvidence array<string>, "
    "conflictingEvidence array<string>, memberAssessments array<struct<localId string, role string, notes array<string>>>, "
    "outlierLocalIds array<string>, insufficientEvidence boolean, outerInnerNotes array<string>")


def group_issue(json: Column, expected: Column) -> Column:
    """Error code of one group result (JSON text) against the expected member ids, or NULL when it is good."""
    r = F.from_json(json, GROUP_RESULT)
    members = F.transform(r["memberAssessments"], lambda m: m["localId"])
    notes = F.flatten(F.transform(r["memberAssessments"], lambda m: F.coalesce(m["notes"], F.array().cast("array<string>"))))
    shape = (
        r["belongsTogether"].isin("yes", "no", "uncertain") & in_unit(r["confidence"])
        & (r["sharedContextSummary"].isNull() | (F.length(r["sharedContextSummary"]) <= 400))
        & bounded_list(r["supportingEvidence"], 12, 120) & bounded_list(r["conflictingEvidence"], 12, 120)
        & bounded_list(r["memberAssessments"], 8, least=1)
        & F.forall(r["memberAssessments"], lambda m: filled(m["localId"]) & m["role"].isin("core", "supporting", "outlier", "uncertain")
                   & (m["notes"].isNull() | bounded_list(m["notes"], 8, 200)))
        & F.coalesce(bounded_list(r["outlierLocalIds"], 8), F.lit(False)) & F.forall(r["outlierLocalIds"], filled)
        & r["insufficientEvidence"].isNotNull() & bounded_list(r["outerInnerNotes"], 8, 200))
    texts = F.concat_ws("\n", r["sharedContextSummary"], F.array_join(r["supportingEvidence"], "\n"), F.array_join(r["conflictingEvidence"], "\n"),
                        F.array_join(r["outerInnerNotes"], "\n"), F.array_join(notes, "\n"))
    is_object = F.json_object_keys(json).isNotNull()
    return (
        F.when(~F.coalesce(is_object, F.lit(False)), "MODEL_OUTPUT_INVALID")
        .when(F.size(forbidden_keys(json)) > 0, "FORBIDDEN_COLLECTION_FIELDS")
        .when(~F.coalesce(shape, F.lit(False)), "MODEL_OUTPUT_INVALID")
        .when((r["belongsTogether"] == "yes") & r["insufficientEvidence"], "INCONSISTENT_YES_INSUFFICIENT")
        .when(F.size(F.array_except(members, expected)) > 0, "UNKNOWN_MEMBER_ID")
        .when(F.size(F.array_except(expected, members)) > 0, "MISSING_MEMBER_ASSESSMENT")
        .when(F.size(F.array_except(r["outlierLocalIds"], expected)) > 0, "UNKNOWN_MEMBER_ID")
        .when(banned_text(texts), "FORBIDDEN_COLLECTION_FIELDS"))


def request_issue(
    schema_version: Column, member_ids: Column, allow_visual: Column, has_image: Column, text: Column,
    expected_version: str, max_batch: int = vocab.GROUP_SIZE, min_batch: int = 1,
) -> Column:
    """Error code of a request before it is sent, or NULL.  A request about a group needs ``min_batch`` 2."""
    given = schema_version.isNotNull() & (schema_version != "")
    return (
        F.when(given & (schema_version != expected_version), "SCHEMA_VERSION_MISMATCH")
        .when(F.size(member_ids) > max_batch, "BATCH_TOO_LARGE")
        .when((F.size(F.array_distinct(member_ids)) != F.size(member_ids)) | (F.size(member_ids) < min_batch), "REQUEST_INVALID")
        .when(allow_visual & ~has_image & (F.coalesce(F.length(F.trim(text)), F.lit(0)) == 0), "VISUAL_REQUIRED"))


def failure_category(code: Column, path: Column, http_status: Column) -> Column:
    """Category of a failed call from its transport code, network path note or HTTP status."""
    note = F.lower(F.coalesce(path, F.lit("")))
    unsatisfied = F.contains(note, F.lit("unsatisfied"))
    transport = (
        F.when(F.contains(note, F.lit("local network")), "localNetworkPermission")
        .when(code == "appTransportSecurityRequiresSecureConnection", "atsRejected")
        .when(code.isin("badURL", "unsupportedURL"), "invalidURL").when(code == "timedOut", "timeout")
        .when(code.isin("cannotConnectToHost", "cannotFindHost") & unsatisfied, "localNetworkPermission")
        .when(code.isin("cannotConnectToHost", "cannotFindHost", "networkConnectionLost"), "connectionRefused")
        .when(code.isin("notConnectedToInternet", "dataNotAllowed"), "offline")
        .when(unsatisfied, "localNetworkPermission").otherwise("unknownNetwork"))
    answered = F.when(http_status.between(200, 299), None).when(http_status.between(500, 599), "providerError").otherwise("gatewayHTTP")
    return F.when(http_status.isNotNull(), answered).when(code.isNotNull() | path.isNotNull(), transport)


def is_retryable(http_status: Column) -> Column:
    return http_status.isin(408, 429) | http_status.between(500, 599)
