"""From a rule to a column of findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .fixed import DEFAULT_RULE_CONFIDENCE, RISK_MESSAGE, RISK_RANK, RULE_BY_ID, RULE_CONFIDENCE, RULE_IDS, RULES
from .lets import either, literal_array
from .spans import FINDINGS_TYPE, OPEN, empty, find_spans, marked, pieces_of, spans_of_pieces


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_valid(digits: Column) -> Column:
    """Luhn checksum; a number made of zeros only does not count."""
    return F.call_function("luhn_check", digits) & F.rlike(digits, F.lit("[1-9]"))


RULE_SPANS_TYPE = "array<struct<rule:int,span:struct<start:int,end:int,text:string>>>"

# What a hit must also satisfy, by the name a detector gives its check.
_CHECKS: dict[str, Callable[[Column], Column]] = {
    "phone": lambda t: F.length(_digits(t)).between(10, 11),
    "card": lambda t: F.length(_digits(t)).between(13, 19) & luhn_valid(_digits(t)),
    "marker": lambda t: F.rlike(t, F.lit(P.INTERNAL_MARKER)),
    "host": lambda t: F.length(t) >= 4,
}


def _passes(check: Column, text: Column) -> Column:
    out = F.lit(True)
    for name, test in _CHECKS.items():
        out = either(check == name, test(text), out)
    return either(check == "", True, out)


def id_numbers(text: Column) -> Column:
    """Twelve digits, but only on a line that names the ID scheme."""

    def in_line(line: Column) -> Column:
        return F.transform(
            find_spans(line["text"], P.MY_NUMBER),
            lambda s: F.struct(
                (line["start"] + s["start"]).alias("start"),
                (line["start"] + s["end"]).alias("end"),
                s["text"].alias("text"),
            ),
        )

    return F.flatten(F.transform(find_spans(text, P.ID_SCHEME_LINE), in_line))


def _has(*needles: str) -> Callable[[Column], Column]:
    """Byte search for text a hit cannot do without."""

    def test(text: Column) -> Column:
        out = F.contains(text, F.lit(needles[0]))
        for needle in needles[1:]:
            out = out | F.contains(text, F.lit(needle))
        return out

    return test


def _all(*tests: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def test(text: Column) -> Column:
        out = tests[0](text)
        for other in tests[1:]:
            out = out & other(text)
        return out

    return test


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.rlike(text, F.lit(pattern))


# rule id -> (test a text must pass for any hit at all, [(pattern, check)])
_DETECTORS: dict[str, tuple[Callable[[Column], Column], list[tuple[str, str]]]] = {
    "email": (_has("@"), [(P.EMAIL, "")]),
    "phone": (_has("0"), [(P.PHONE, "phone")]),
    "jwt": (_all(_has("."), _like("\\.[A-Za-z0-9_-]{10,}+\\.")), [(P.JWT, "")]),
    "aws_access_key": (_has("AKIA", "ASIA"), [(P.AWS_ACCESS_KEY, "")]),
    "github_token": (_has("gh"), [(P.GITHUB_TOKEN, "")]),
    "slack_token": (_has("xox"), [(P.SLACK_TOKEN, "")]),
    "stripe_secret_key": (_has("k_live_", "k_test_"), [(P.STRIPE_KEY, "")]),
    "openai_api_key": (_has("sk-"), [(P.OPENAI_KEY, "")]),
    "npm_token": (_has("npm_"), [(P.NPM_TOKEN, "")]),
    "oauth_client_secret": (_like("(?i)client_?secret"), [(P.OAUTH_SECRET, "")]),
    "webhook_url": (_has("https://hooks.", "/webhooks/"), [(P.WEBHOOK, "")]),
    "private_key": (_has("-----BEGIN "), [(P.PRIVATE_KEY, "")]),
    "env_secret": (
        _all(_has("="), _has("SECRET", "TOKEN", "_KEY", "PASSWORD", "DATABASE_URL")),
        [(P.ENV_SECRET, "")],
    ),
    "basic_auth_url": (_all(_has("@"), _has("://")), [(P.BASIC_AUTH_URL, "")]),
    "database_url": (_all(_has("@"), _has("://")), [(P.DATABASE_URL, "")]),
    "credit_card": (_like("[0-9][0-9 -]{12}"), [(P.CREDIT_CARD, "card")]),
    "my_number": (_has(*P.ID_SCHEME_WORDS.split("|")), []),  # see id_numbers
    "url": (_has("://"), [(P.URL, "")]),
    "ip_address": (_all(_has("."), _like("[0-9]\\.[0-9]")), [(P.IP_ADDRESS, "")]),
    "amount": (_has("円", "¥", "￥"), [(P.AMOUNT, "")]),
    "confidential_text": (_like(P.any_word(P.CONFIDENTIAL_WORDS.split("|"))), [(P.CONFIDENTIAL_LINE, "")]),
    # Addresses with a marker, and bare hosts; overlaps are settled later.
    "internal_url": (
        _like(P.any_word(P.INTERNAL_MARKERS.split("|"))),
        [(P.URL, "marker"), (P.INTERNAL_HOST, "host")],
    ),
    "date": (_like("[0-9](?:月|[/. -][0-9]{1,2}[/. -])[0-9]"), [(P.DATE, "")]),
    "postal_code": (_all(_has("-"), _like("[0-9]-[0-9]")), [(P.POSTAL_CODE, "")]),
    "long_id": (_like("[A-Za-z0-9]{16}"), [(P.LONG_ID, "")]),
}


@dataclass(frozen=True)
class TextRule:
    """A rule as data: bundled rules and delivered rules look the same here."""

    id: str
    label: str
    risk_level: str
    prefix: str
    message: str
    confidence: float
    category: str | None = None
    pattern: str | None = None
    id_source: str = "rule"
    enabled: bool = True

    def marks(self, text: Column) -> list[tuple[Column, Column, str]]:
        """Whether the text can hold a hit, the text with marks around the hits of this rule, and the check a hit must pass."""
        if self.pattern is not None:
            return [(F.lit(True), marked(text, self.pattern), "")]
        guard, patterns = _DETECTORS[self.id]
        return [(guard(text), marked(text, pattern), check) for pattern, check in patterns]


def all_findings(text: Column, rules: list[TextRule]) -> Column:
    """Findings of all rules, unsettled.

    Per rule the plan holds a guard and one regex pass; offsets, checks and the
    finding's fields are spelled once for all rules. A bundled finding carries no
    category of its own.
    """
    entries = []
    for number, rule in enumerate(rules, start=1):
        for possible, marked_text, check in rule.marks(text):
            entry = F.struct(F.lit(number).alias("rule"), F.lit(check).alias("check"), marked_text.alias("marked"))
            entries.append(either(possible, entry))
    stems = [f"{r.id_source}:{r.id.removeprefix(r.id_source + ':')}" for r in rules]

    def field(number: Column, values: list) -> Column:
        return F.element_at(literal_array(values), number)

    def finding(span: Column, number: Column) -> Column:
        return F.struct(
            span["start"].alias("start"),
            span["end"].alias("end"),
            field(number, [r.id for r in rules]).alias("rule_id"),
            F.lit("rule").alias("source"),
            field(number, [r.label for r in rules]).alias("label"),
            field(number, [r.risk_level for r in rules]).alias("risk_level"),
            field(number, [r.category for r in rules]).alias("category"),
            span["text"].alias("text"),
            field(number, [f"[{r.prefix}_1]" for r in rules]).alias("placeholder"),
            field(number, [r.message for r in rules]).alias("message"),
            field(number, [float(r.confidence) for r in rules]).alias("confidence"),
            F.concat_ws(
                ":", field(number, stems), span["start"].cast("string"), span["end"].cast("string")
            ).alias("id"),
        )

    def of_rule(spans: Column, number: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(number.alias("rule"), s.alias("span")))

    # What a step returns is copied, so spans go through the steps and become findings at the end.
    parts = []
    if entries:
        found = F.filter(F.array(*entries), lambda e: F.contains(e["marked"], F.lit(OPEN)))
        parts.append(
            F.flatten(
                F.transform(
                    found,
                    lambda e: of_rule(
                        F.filter(spans_of_pieces(pieces_of(e["marked"])), lambda s: _passes(e["check"], s["text"])), e["rule"]
                    ),
                )
            )
        )
    for number, rule in enumerate(rules, start=1):
        if rule.id == "my_number" and rule.pattern is None:
            numbers = of_rule(id_numbers(text), F.lit(number))
            parts.append(either(_DETECTORS["my_number"][0](text), numbers, empty(RULE_SPANS_TYPE)))
    return F.transform(F.concat(*parts), lambda r: finding(r["span"], r["rule"])).cast(FINDINGS_TYPE)


def _bundled(rule_id: str) -> TextRule:
    rule = RULE_BY_ID[rule_id]
    return TextRule(
        id=rule.id,
        label=rule.label,
        risk_level=rule.risk_level,
        prefix=rule.prefix,
        message=RISK_MESSAGE[rule.risk_level],
        confidence=RULE_CONFIDENCE.get(rule.id, DEFAULT_RULE_CONFIDENCE),
    )


def check_registry() -> None:
    """Each catalogue id is unique and has exactly one detector."""
    if len(set(RULE_IDS)) != len(RULE_IDS):
        raise ValueError("rule catalogue holds an id twice")
    if set(RULE_IDS) != set(_DETECTORS):
        raise ValueError(f"catalogue and detectors differ: {set(RULE_IDS) ^ set(_DETECTORS)}")


check_registry()
BUNDLED_RULES = [_bundled(rule.id) for rule in RULES]


def select_rules(
    enabled_ids: list[str] | None = None,
    disabled_ids: list[str] | None = None,
    min_risk: str | None = None,
    include_low: bool = True,
    extra_rules: list[TextRule] | None = None,
) -> list[TextRule]:
    """Rules that take part in a scan. Unselected rules never enter the plan."""
    chosen = []
    for rule in [*BUNDLED_RULES, *(extra_rules or [])]:
        if not rule.enabled:
            continue
        if enabled_ids is not None and rule.id not in enabled_ids:
            continue
        if disabled_ids and rule.id in disabled_ids:
            continue
        if rule.risk_level == "low" and not include_low:
            continue
        if min_risk is not None and RISK_RANK[rule.risk_level] < RISK_RANK[min_risk]:
            continue
        chosen.append(rule)
    return chosen
