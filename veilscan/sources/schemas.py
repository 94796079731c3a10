"""Schemas of the structured inputs."""

FIXTURE_SCHEMA = (
    "id string, category string, description string, input string, expect struct<"
    "summary: struct<total:int, critical:int, high:int, medium:int, low:int>,"
    "includesRuleIds: array<string>, excludesRuleIds: array<string>,"
    "policy: struct<action:string, severity:string, canSendRaw:boolean, requiresSanitization:boolean>,"
    "generalizedIncludes: array<string>, generalizedExcludes: array<string>,"
    "maskedIncludes: array<string>, maskedExcludes: array<string>>"
)
