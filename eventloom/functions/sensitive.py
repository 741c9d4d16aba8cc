"""Patterns that find sensitive member names and secret values in JSON text."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from eventloom.functions.jsontext import SPACES, STRING, value

MASK = "[REDACTED]"

# Fixed value: what counts as a secret in a string (case-insensitive).
SECRET = r"(?iu)(bearer[\t\n\f\r ]+[a-z0-9._~+/=-]{12,}|sk-[a-z0-9]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)"

# The same inside compact JSON text, where the whitespace characters are written as escapes.
_SECRET_ESCAPED = (
    r"(?iu:bearer(?: |\\[tnfr])+[a-z0-9._~+/=-]{12,}|sk-[a-z0-9]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)"
)

# Other characters whose lower-case form is an ASCII letter.
_EXTRA_CAPITALS = {"k": "K", "i": "İ"}

_PADDING = r"(?:[" + "".join(c for c in SPACES if c == " " or ord(c) > 127) + r"]|\\[tnfr]|\\u000[bB])*+"


def secret_match(text: Column) -> Column:
    return text.rlike(SECRET)


def normal_key(key: Column) -> Column:
    """Member name as compared with a blocklist: trimmed, lower case, ``-`` and ``.`` as ``_``."""
    return F.translate(F.lower(F.btrim(key, F.lit(SPACES))), "-.", "__")


def normal_name(name: str) -> str:
    """``normal_key`` of a configured name."""
    return name.strip().lower().replace("-", "_").replace(".", "_")


def _letter(ch: str) -> str:
    capitals = {ch.upper(), ch, _EXTRA_CAPITALS.get(ch, ch)}
    return "[" + "".join(re.escape(c) for c in sorted(capitals) if len(c) == 1) + "]"


def _json_escaped(ch: str) -> str:
    return re.escape({'"': r"\"", "\\": r"\\"}.get(ch, ch))


def _loose(name: str) -> str:
    """Any spelling whose normal form is the normal form of ``name``."""
    return "".join("[-._]" if c == "_" else _letter(c) if c.isalpha() else _json_escaped(c) for c in normal_name(name))


def _caseless(name: str) -> str:
    return "".join(_letter(c) if c.isalpha() else _json_escaped(c) for c in name.lower())


def blocked_key_token(blocklist: tuple[str, ...]) -> str | None:
    """Pattern of a key token that a blocklist hides, compared in normal form."""
    names = [_loose(n) for n in blocklist]
    return f'"{_PADDING}(?:{"|".join(names)}){_PADDING}"' if names else None


def named_key_token(names: tuple[str, ...]) -> str | None:
    """Pattern of a key token whose name, or last dotted part, equals one of ``names`` in any case."""
    if not names:
        return None
    dotted = r"(?:(?:[^\"\\.]|\\.)*+\.)*+"
    return f'"{dotted}(?:{"|".join(_caseless(n) for n in names)})"'


def raw_text_pattern(key_token: str | None, scan_secrets: bool, secret: str = SECRET) -> str:
    """Matches a raw event that holds a key token to hide or a secret, if no escape is in the way."""
    parts = [key_token] if key_token else []
    if scan_secrets:
        parts.append(scoped(secret))
    return "|".join(parts) or "(?!)"


def scoped(pattern: str) -> str:
    """A pattern with leading flags, usable inside an alternation."""
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    return f"(?{flags[1]}:{pattern[flags.end():]})" if flags else pattern


def tell_tale_words(names: tuple[str, ...]) -> list[str]:
    """The longest plain word of each name; any spelling of the name holds it, in lower case."""
    words = {max(re.split(r"[^a-z0-9]+", n.lower()), key=len) for n in names}
    return sorted(w for w in words if not any(o != w and o in w for o in words))


# Words without which no text is a secret.
_SECRET_WORDS = ["bearer", "sk-", "private key-----"]


def raw_text_hint(raw: Column, names: tuple[str, ...], key_token: str | None, scan_secrets: bool) -> Column:
    """FALSE only where a raw event cannot hold anything to hide.

    A backslash may hide a letter of a key, so it always counts.  Else plain substring searches come
    first, as they cost a fraction of a regular expression; they cover ASCII texts and names.
    """
    words = tell_tale_words(names) + (_SECRET_WORDS if scan_secrets else [])
    if "" in words or not all(w.isascii() for w in [*words, *names]):
        suspect = F.lit(True)
    else:
        # The lambda names the lower-case text, so that it is made once for all words.
        told = F.exists(F.array(F.lower(raw)), lambda low: reduce(or_, (F.contains(low, F.lit(w)) for w in words)))
        suspect = (F.octet_length(raw) != F.length(raw)) | told if words else F.lit(False)
    pattern = raw_text_pattern(key_token, scan_secrets)
    return F.contains(raw, F.lit("\\")) | (suspect & raw.rlike(pattern))


def mask_pattern(key_token: str | None, scan_secrets: bool, levels: int) -> str:
    """Pattern that finds, token by token from the left, the members to hide.

    Groups 1-3 hold what stays: the text before the member, and its key.  ``\\G`` ties every match
    to the end of the one before, so a match can never start inside a string.
    """
    hidden, looked_for = [], []
    if key_token:
        looked_for.append(f"{key_token}:{value(levels)}")
        hidden.append(f"({key_token}:){value(levels)}")
    if scan_secrets:
        before = rf'"(?:(?!{_SECRET_ESCAPED})(?:[^"\\]|\\.))*+'
        secret_text = rf'{before}{_SECRET_ESCAPED}[^"\\]*+(?:\\.[^"\\]*+)*+"'
        looked_for.append(f"{STRING}:{secret_text}")
        hidden.append(f"({STRING}:){secret_text}")
    return rf'\G((?:[^"]++|(?!{"|".join(looked_for)}){STRING})*+)(?:{"|".join(hidden)})'


def mask_replacement(key_token: str | None, scan_secrets: bool) -> str:
    kept = 1 + (key_token is not None) + scan_secrets
    return "".join(f"${i}" for i in range(1, kept + 1)) + f'"{MASK}"'
