"""SQL building blocks: corpus, hits of each rule, settled findings, policy.

The SQL works on rows and windows where the Spark code works on arrays, and
uses the engine's own regular expressions (RE2, no look-around).
"""

from __future__ import annotations

from veilscan.functions import fixed as X
from veilscan.plans.corpus import MEMO_SQL

MEMOS = f"SELECT o_orderkey, o_custkey, {MEMO_SQL} AS text FROM orders"
CORPUS = f"""
SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS key, text FROM documents
UNION ALL SELECT 'page:' || CAST(page_id AS VARCHAR), html FROM pages
UNION ALL SELECT 'turn:' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR), text FROM conversations
UNION ALL SELECT 'memo:' || CAST(o_orderkey AS VARCHAR), text FROM ({MEMOS})
"""

SP = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
BODY = f"[^{SP}<>\"'）)]"
MARKERS = "localhost|intranet|internal|corp|staging|dev|test|local"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

PATTERNS = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "jwt": r"\b[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\b(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{20,}\b",
    "slack_token": r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    "stripe_secret_key": r"\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}\b",
    "openai_api_key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "npm_token": r"\bnpm_[A-Za-z0-9]{16,}\b",
    "oauth_client_secret": r"(?i)\bclient_?secret[\"']?[ \t]*[:=][ \t]*[\"']?[A-Z0-9._~+/-]{8,}[\"']?",
    "webhook_url": (
        r"\bhttps://(?:hooks\.slack\.com/services/[A-Za-z0-9/_-]+"
        r"|(?:(?:ptb|canary)\.)?discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+)"
    ),
    "private_key": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----",
    "env_secret": (
        r"\b[A-Z0-9_]*(?:SECRET|TOKEN|API_KEY|ACCESS_KEY|PRIVATE_KEY|PASSWORD|DATABASE_URL)[A-Z0-9_]*[ \t]*=[ \t]*"
        rf"(?:\"[^\"\r\n]+\"|'[^'\r\n]+'|[^{SP}\"'<>]+)"
    ),
    "basic_auth_url": rf"(?i)\bhttps?://[^{SP}/:@<>\"'）)]+:[^{SP}/@<>\"'）)]+@{BODY}+",
    "database_url": (
        r"(?i)\b(?:postgres|postgresql|mysql|mariadb|mongodb|mongodb\+srv|redis|rediss|mssql|sqlserver)"
        rf"://[^{SP}/:@<>\"'）)]+:[^{SP}@<>\"'）)]+@{BODY}+"
    ),
    "credit_card": r"\b(?:[0-9][ -]?){13,19}\b",
    "url": rf"(?i)\bhttps?://{BODY}+",
    "ip_address": rf"\b(?:{OCTET}\.){{3}}{OCTET}\b",
    "amount": (
        rf"(?:月額[{SP}]*)?(?:¥|￥)[{SP}]?[0-9]{{1,3}}(?:,[0-9]{{3}})*(?:\.[0-9]+)?"
        rf"|(?:月額[{SP}]*)?[0-9]{{1,3}}(?:,[0-9]{{3}})*(?:万円|円)|(?:月額[{SP}]*)?[0-9]+(?:\.[0-9]+)?万円"
    ),
    "confidential_text": (
        r"(?i)[^\r\n]*(?:社外秘|秘密|confidential|取扱注意|関係者限り|NDA|未公開|口外禁止)[^\r\n]*"
    ),
    "internal_url": rf"(?i)\bhttps?://{BODY}+",
    "internal_host": (
        r"(?i)\b(?:localhost|[a-z0-9.-]*(?:intranet|internal|corp|staging|dev|test|local)[a-z0-9.-]*"
        rf"(?::[0-9]+)?(?:/[^{SP}<>\"'）)]*)?)"
    ),
    "date": r"\b[0-9]{4}[/. -][0-9]{1,2}[/. -][0-9]{1,2}\b|(?:[0-9]{4}年)?[0-9]{1,2}月[0-9]{1,2}日",
    "postal_code": r"\b[0-9]{3}-[0-9]{4}\b",
    "long_id": r"\b[A-Za-z0-9]{16,}\b",
}
# What a raw hit must also satisfy; ``t`` is the hit's text.
DIGITS = "regexp_replace(t, '[^0-9]', '', 'g')"
LUHN = (
    f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: "
    f"CASE WHEN i % 2 = 1 THEN CAST({DIGITS}[length({DIGITS}) - i + 1] AS INT) "
    f"ELSE (CAST({DIGITS}[length({DIGITS}) - i + 1] AS INT) * 2) // 10 "
    f"+ (CAST({DIGITS}[length({DIGITS}) - i + 1] AS INT) * 2) % 10 END))"
)
FILTERS = {
    "credit_card": f"length({DIGITS}) BETWEEN 13 AND 19 AND {LUHN} > 0 AND {LUHN} % 10 = 0",
    "internal_url": f"regexp_matches(t, '(?i){MARKERS}')",
    "internal_host": f"length(t) >= 4 AND regexp_matches(t, '(?i){MARKERS}')",
    "long_id": "regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]')",
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(table: dict, column: str, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(str(k))} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {column} {whens} ELSE {default} END"


def plain_hits(rule: str, source: str = "corpus") -> str:
    """Rows of key, rule, start, end and text of one pattern."""
    name = "internal_url" if rule == "internal_host" else rule
    pattern = q(f"({PATTERNS[rule]})")
    extra = f" AND {FILTERS[rule]}" if rule in FILTERS else ""
    return f"""
SELECT key, {q(name)} AS rule_id, s, s + length(t) AS e, t FROM (
  SELECT key, split_part(piece, chr(2), 1) AS t, i,
         COALESCE(SUM(length(piece) - CASE WHEN i = 1 THEN 0 ELSE 1 END) OVER (
           PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT key, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
          SELECT key, string_split(regexp_replace(text, {pattern}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p
          FROM {source} WHERE regexp_matches(text, {pattern}))))
WHERE i > 1 AND t <> ''{extra}"""


def numbered_hits(rule: str, source: str = "corpus") -> str:
    """Phone and ID numbers: try every digit run start, then drop overlapping tries."""
    if rule == "phone":
        head, shape, need = "0", f"0[0-9]{{1,4}}[-{SP}]?[0-9]{{1,4}}[-{SP}]?[0-9]{{3,4}}", "true"
        keep = f"length({DIGITS}) BETWEEN 10 AND 11"
        line = "true"
    else:
        head, shape = "[0-9]{4}", f"[0-9]{{4}}[-{SP}]?[0-9]{{4}}[-{SP}]?[0-9]{{4}}"
        need = "regexp_matches(text, 'マイナンバー|個人番号')"
        keep = "true"
        line = (
            "regexp_matches(regexp_extract(substr(text, 1, s), '[^\\r\\n]*$') || "
            "regexp_extract(substr(text, s + 1), '^[^\\r\\n]*'), 'マイナンバー|個人番号')"
        )
    window = "substr(text, s + 1, 24)" if rule == "phone" else "regexp_extract(substr(text, s + 1, 24), '^[^\\r\\n]*')"
    return f"""
SELECT key, {q(rule)} AS rule_id, m.s AS s, m.s + length(m.t) AS e, m.t AS t FROM (
  SELECT key, unnest(list_reduce(
           list([{{'s': s, 't': t}}] ORDER BY s),
           lambda a, b: CASE WHEN a[len(a)].s + length(a[len(a)].t) <= b[1].s THEN list_concat(a, b) ELSE a END)) AS m
  FROM (
    SELECT key, s, regexp_extract({window}, {q(f'^({shape})(?:[^0-9]|$)')}, 1) AS t
    FROM (SELECT key, text, i, CAST(COALESCE(SUM(length(piece)) OVER (
                   PARTITION BY key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
          FROM (SELECT key, text, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
            SELECT key, text, string_split(
              regexp_replace(text, '(^|[^0-9])({head})', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p
            FROM {source} WHERE {need} AND regexp_matches(text, '(^|[^0-9]){head}'))))
    WHERE i > 1 AND {line})
  WHERE t <> '' GROUP BY key)
WHERE {keep.replace(DIGITS, DIGITS.replace('(t,', '(m.t,'))}"""


def hits(rules: list[str], source: str = "corpus") -> str:
    parts = []
    for rule in rules:
        parts.append(numbered_hits(rule, source) if rule in ("phone", "my_number") else plain_hits(rule, source))
        if rule == "internal_url":
            parts.append(plain_hits("internal_host", source))
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


RISK = {r.id: r.risk_level for r in X.RULES}
PREFIX = {r.id: r.prefix for r in X.RULES}
LABEL = {r.id: r.label for r in X.RULES}


def settle(source: str = "hits") -> str:
    """CTEs from hits (key, rule_id, s, e, t) to ``found`` with placeholders."""
    rank = case({r.id: X.RISK_RANK[r.risk_level] for r in X.RULES}, "rule_id")
    return f"""
ranked AS (SELECT *, {rank} AS rank FROM {source}),
folded AS (
  SELECT key, list_reduce(
    list([{{'s': s, 'e': e, 'r': rule_id, 't': t, 'k': rank}}] ORDER BY rank DESC, e - s DESC, s, rule_id),
    lambda a, b: CASE WHEN len(list_filter(a, lambda x: x.s < b[1].e AND b[1].s < x.e)) > 0 THEN a
                      ELSE list_concat(a, b) END) AS kept
  FROM ranked GROUP BY key),
spread AS (SELECT key, unnest(kept) AS f FROM folded),
found AS (
  SELECT key, f.r AS rule_id, f.s AS s, f.e AS e, f.t AS t, f.k AS rank,
         {case(PREFIX, 'f.r')} AS prefix,
         {case(RISK, 'f.r')} AS risk_level,
         {case(LABEL, 'f.r')} AS label,
         {case({r.id: r.category for r in X.RULES}, 'f.r')} AS category,
         'rule:' || f.r || ':' || CAST(f.s AS VARCHAR) || ':' || CAST(f.e AS VARCHAR) AS id,
         '[' || {case(PREFIX, 'f.r')} || '_' || CAST(row_number() OVER (
            PARTITION BY key, {case(PREFIX, 'f.r')} ORDER BY f.s) AS VARCHAR) || ']' AS placeholder
  FROM spread)"""


def found_ctes(rules: list[str] | None = None, source: str = CORPUS) -> str:
    rules = X.RULE_IDS if rules is None else rules
    return f"corpus AS ({source}),\nhits AS ({hits(rules)}),{settle()}"


POLICY_CTES = f"""
scored AS (
  SELECT key, SUM({case(X.CATEGORY_WEIGHT, 'category')}) AS raw_score,
         MAX(rank) AS top_rank, COUNT(*) AS n,
         bool_or(category = 'secret' OR rule_id IN ('my_number', 'credit_card')) AS guard,
         bool_or(risk_level IN ('critical', 'high') OR category = 'secret') AS has_must
  FROM found GROUP BY key),
risk AS (
  SELECT c.key, CAST(LEAST(COALESCE(raw_score, 0), 100) AS INT) AS score, COALESCE(top_rank, 0) AS top_rank,
         CAST(COALESCE(n, 0) AS INT) AS n, COALESCE(guard, false) AS guard, COALESCE(has_must, false) AS has_must
  FROM corpus c LEFT JOIN scored s ON c.key = s.key),
leveled AS (
  SELECT *, CASE WHEN score <= 0 THEN 'safe' WHEN score < 20 THEN 'low' WHEN score < 50 THEN 'medium'
                 WHEN score < 80 THEN 'high' ELSE 'critical' END AS level,
         CASE WHEN score <= 0 THEN 0 WHEN score < 20 THEN 1 WHEN score < 50 THEN 2
              WHEN score < 80 THEN 3 ELSE 4 END AS level_rank
  FROM risk),
policy AS (
  SELECT *, guard OR level_rank >= 3 AS blocked,
         CASE WHEN guard OR level_rank >= 3 OR has_must THEN 'sanitize_required'
              WHEN level = 'medium' THEN 'confirm' ELSE 'allow' END AS action,
         (['none', 'low', 'medium', 'high', 'critical'])[GREATEST(level_rank, top_rank) + 1] AS severity
  FROM leveled)"""


def rewritten(label: str) -> str:
    """CTE ``rewritten`` (key, text) with ``label`` in place of each finding."""
    return f"""
cuts AS (
  SELECT f.key, f.s, f.e, {label} AS put,
         LAG(f.e, 1, 0) OVER (PARTITION BY f.key ORDER BY f.s) AS prev_e FROM found f),
pieces AS (
  SELECT c.key, c.text, string_agg(substr(c.text, CAST(prev_e AS BIGINT) + 1, CAST(s - prev_e AS BIGINT)) || put, '' ORDER BY s) AS head,
         MAX(e) AS last_e
  FROM cuts JOIN corpus c ON c.key = cuts.key GROUP BY c.key, c.text),
rewritten AS (
  SELECT c.key, CASE WHEN p.key IS NULL THEN c.text ELSE head || substr(c.text, CAST(last_e AS BIGINT) + 1) END AS text
  FROM corpus c LEFT JOIN pieces p ON c.key = p.key)"""
