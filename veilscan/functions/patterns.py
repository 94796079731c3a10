"""Detector patterns, written for the Java regex engine.

Word boundaries and character classes are spelled out in ASCII: on the JVM a
plain ``\\b`` treats Han and kana as word characters, and ``\\s`` leaves out the
ideographic and no-break spaces that have to count here.
"""

from __future__ import annotations

# Body of a character class with every character that counts as white space.
SPACE = (
    "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
)
# The range goes first: letters beyond it are not compared with one after another.
SP = f"[\\u0000-\\u3000\\uFEFF&&[{SPACE}]]"
WORD = "[A-Za-z0-9_]"
NOT_AFTER_WORD = f"(?<!{WORD})"
NOT_BEFORE_WORD = f"(?!{WORD})"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# Characters that may follow the scheme of an address: everything but white
# space, quotes and closing brackets (half and full width).
URL_BODY = f"[^{SPACE}<>\"'）)]"

# --- fixed values: keyword lists inside patterns ---------------------------

CONFIDENTIAL_WORDS = "社外秘|秘密|confidential|取扱注意|関係者限り|NDA|未公開|口外禁止"
INTERNAL_MARKERS = "localhost|intranet|internal|corp|staging|dev|test|local"
ID_SCHEME_WORDS = "マイナンバー|個人番号"

# --- fixed values: detector patterns ---------------------------------------

# Where a pattern starts with a look behind or a choice, a test of the first character of any hit stands before it: at most
# characters of a text that is all that runs.

# All starts inside one run of local-part characters share its end, so only the first word edge of a run is tried, or the
# end of the hit before.
EMAIL = (
    "(?i)(?=[A-Z0-9._%+-])(?:(?<![A-Z0-9._%+-])([.%+-]*+)|\\G(?<=[A-Z]))"
    f"([A-Z0-9._%+-]++@[A-Z0-9.-]+\\.[A-Z]{{2,}}{NOT_BEFORE_WORD})"
)
PHONE = f"(?=0)(?<![0-9])0[0-9]{{1,4}}[-{SPACE}]?[0-9]{{1,4}}[-{SPACE}]?[0-9]{{3,4}}(?![0-9])"
CREDIT_CARD = f"(?=[0-9]){NOT_AFTER_WORD}(?:[0-9][ -]?){{13,19}}{EDGE}"
MY_NUMBER = f"(?<![0-9])[0-9]{{4}}[-{SPACE}]?[0-9]{{4}}[-{SPACE}]?[0-9]{{4}}(?![0-9])"
POSTAL_CODE = f"(?=[0-9]){NOT_AFTER_WORD}[0-9]{{3}}-[0-9]{{4}}{NOT_BEFORE_WORD}"
URL = f"(?i)(?=h){NOT_AFTER_WORD}https?://{URL_BODY}++"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_ADDRESS = f"(?=[0-9]){NOT_AFTER_WORD}(?:{_OCTET}\\.){{3}}{_OCTET}{NOT_BEFORE_WORD}"
DATE = (
    f"(?=[0-9])(?:{NOT_AFTER_WORD}[0-9]{{4}}[/. -][0-9]{{1,2}}[/. -][0-9]{{1,2}}{NOT_BEFORE_WORD}"
    "|(?:[0-9]{4}年)?[0-9]{1,2}月[0-9]{1,2}日)"
)
LONG_ID = (
    f"(?=[A-Za-z0-9]){NOT_AFTER_WORD}(?=[A-Za-z0-9]{{16}})(?=[A-Za-z0-9]*[A-Za-z])(?=[A-Za-z0-9]*[0-9])[A-Za-z0-9]{{16,}}+{NOT_BEFORE_WORD}"
)
# A start inside a digit run is tried only where it can differ from the ones before it, or where the hit before has ended: at most
# three digits before the unit or a comma, and not inside a group of three that follows a comma (the group before has the
# same rest); whole numbers before 万円 only at their first digit.
_INNER_GROUP = "(?<=[0-9],)[0-9]{3}(?![0-9])|(?<=[0-9],[0-9])[0-9]{2}(?![0-9])|(?<=[0-9],[0-9]{2})[0-9](?![0-9])"
AMOUNT = (
    f"(?=[月¥￥0-9])(?:(?:月額{SP}*+)?(?:¥|￥){SP}?[0-9]{{1,3}}(?:,[0-9]{{3}})*(?:\\.[0-9]+)?"
    f"|(?:月額{SP}*+)?(?:\\G|(?<=\\G,)|(?!{_INNER_GROUP}))[0-9]{{1,3}}+(?![0-9])(?:,[0-9]{{3}}(?![0-9]))*+(?:万円|円)"
    f"|(?:月額{SP}*+)?(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++)?+万円)"
)
# A whole line that holds a keyword. Anchoring at the line start and looking
# ahead once keeps this linear in the length of the line.
LINE_START = "(?<![^\\r\\n])"
# Latin words are spelled per letter and the others stand behind one range
# test, so that a character of running text costs three checks, not eight.
def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" for c in word)


def _confidential_test(words: list[str]) -> str:
    latin = "|".join(_any_case(w) for w in words if w.isascii())
    other = "|".join(w for w in words if not w.isascii())
    return f"(?:{latin}|(?=[\\u3000-\\uFFFF])(?:{other}))"


def one_of(chars: set[str]) -> str:
    """One of the letters; those beyond ASCII stand behind ranges, halved down to a few, as letters are compared one by one."""

    def ranged(letters: list[str]) -> str:
        half = len(letters) // 2
        inner = "".join(letters) if len(letters) <= 3 else ranged(letters[:half]) + ranged(letters[half:])
        return f"[{letters[0]}-{letters[-1]}&&[{inner}]]" if letters else ""

    latin, other = (sorted(c for c in chars if c.isascii() == ascii_) for ascii_ in (True, False))
    return f"[{''.join(latin)}{ranged(other)}]"


def any_word(words: list[str]) -> str:
    """One of the words in any case of its ASCII letters, for a search: the first letters come as one class."""
    return f"(?={one_of({c for w in words for c in (w[0].upper(), w[0].lower())})})(?i:{'|'.join(words)})"


_CONFIDENTIAL_TEST = _confidential_test(CONFIDENTIAL_WORDS.split("|"))
CONFIDENTIAL_LINE = f"{LINE_START}(?=[^\\r\\n]*?{_CONFIDENTIAL_TEST})[^\\r\\n]++"
ID_SCHEME_LINE = f"{LINE_START}(?=[^\\r\\n]*?(?:{ID_SCHEME_WORDS}))[^\\r\\n]++"
# A host with a marker. If any marker follows in the run, the whole rest of the run belongs to the hit; if none does, no
# later start in the run can match. So one start is tried per run: its first word edge, or the first one after a hit that
# ends inside a run (a bare ``localhost``, or a port).
INTERNAL_HOST = (
    "(?i)(?=[A-Z0-9.-])((?<![A-Z0-9_.-])[.-]*+|(?<=_)[A-Z0-9]*+|\\G(?<=[A-Z0-9])[A-Z0-9]*+)"
    f"(localhost|(?=[A-Z0-9.-]*?{any_word(INTERNAL_MARKERS.split('|'))})[A-Z0-9.-]++(?::[0-9]+)?(?:/[^{SPACE}<>\"'）)]*+)?)"
)
INTERNAL_MARKER = f"(?i){INTERNAL_MARKERS}"

# Secret shapes. These are this project's own definitions.
# A run is entered at its first word edge, or where the hit before has ended.
JWT = (
    f"(?=[A-Za-z0-9_-])(?:(?<![A-Za-z0-9_-])(-*+)|\\G(?<={WORD}))"
    f"([A-Za-z0-9_-]{{10,}}+\\.[A-Za-z0-9_-]{{10,}}+\\.[A-Za-z0-9_-]{{10,}}(?<={WORD}){NOT_BEFORE_WORD})"
)
AWS_ACCESS_KEY = f"{NOT_AFTER_WORD}(?:AKIA|ASIA)[0-9A-Z]{{16}}{NOT_BEFORE_WORD}"
GITHUB_TOKEN = f"{NOT_AFTER_WORD}(?:gh[pousr]_|github_pat_)[A-Za-z0-9_]{{20,}}{NOT_BEFORE_WORD}"
SLACK_TOKEN = f"{NOT_AFTER_WORD}xox[baprs]-[A-Za-z0-9-]{{10,}}{EDGE}"
STRIPE_KEY = f"{NOT_AFTER_WORD}(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{{16,}}{NOT_BEFORE_WORD}"
OPENAI_KEY = f"{NOT_AFTER_WORD}sk-[A-Za-z0-9_-]{{20,}}{EDGE}"
NPM_TOKEN = f"{NOT_AFTER_WORD}npm_[A-Za-z0-9]{{16,}}{NOT_BEFORE_WORD}"
OAUTH_SECRET = (
    f"(?i)(?=c){NOT_AFTER_WORD}client_?secret[\"']?[ \\t]*[:=][ \\t]*[\"']?[A-Z0-9._~+/-]{{8,}}[\"']?"
)
WEBHOOK = (
    f"{NOT_AFTER_WORD}https://(?:hooks\\.slack\\.com/services/[A-Za-z0-9/_-]+"
    "|(?:(?:ptb|canary)\\.)?discord(?:app)?\\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+)"
)
# Words of capitals and digits with single spaces between them, taken by one class loop: a repeated group recurses.
_KEY_NAME = "(?! )(?![A-Z0-9 ]*?  )[A-Z0-9 ]*+(?<= PRIVATE KEY)-----"
PRIVATE_KEY_END = f"-----END {_KEY_NAME}"
PRIVATE_KEY = f"-----BEGIN {_KEY_NAME}[\\s\\S]*?{PRIVATE_KEY_END}"
ENV_SECRET = (
    f"(?=[A-Z0-9_]){NOT_AFTER_WORD}(?=[A-Z0-9_]*?(?:SECRET|TOKEN|API_KEY|ACCESS_KEY|PRIVATE_KEY|PASSWORD|DATABASE_URL))"
    f"[A-Z0-9_]++[ \\t]*+=[ \\t]*(?:\"[^\"\\r\\n]+\"|'[^'\\r\\n]+'|[^{SPACE}\"'<>]+)"
)
BASIC_AUTH_URL = (
    f"(?i)(?=h){NOT_AFTER_WORD}https?://[^{SPACE}/:@<>\"'）)]+:[^{SPACE}/@<>\"'）)]+@{URL_BODY}+"
)
# Searched only in runs that end at an ``@`` with an address after it: then the first scheme with a user and a password hits.
_UP_TO_AT = f"[^{SPACE}@<>\"'）)]"
DATABASE_URL = (
    f"(?i)(?<!{_UP_TO_AT})(?={_UP_TO_AT}++@{URL_BODY})({_UP_TO_AT}*?)"
    f"({NOT_AFTER_WORD}(?:postgres|postgresql|mysql|mariadb|mongodb|mongodb\\+srv|redis|rediss|mssql|sqlserver)"
    f"://[^{SPACE}/:@<>\"'）)]+:{_UP_TO_AT}+@{URL_BODY}+)"
)

#: Patterns whose hit is the second group; the first is text passed over.
WITH_LEAD = {EMAIL, JWT, INTERNAL_HOST, DATABASE_URL}
#: Patterns that cannot hit beyond the last hit of another.
CLOSED_BY = {PRIVATE_KEY: PRIVATE_KEY_END}
