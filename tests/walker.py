"""A plain walk over parsed JSON: what the column expressions are compared with."""

import json
import re

SECRET = re.compile(r"(?i)(bearer[\t\n\f\r ]+[a-z0-9._~+/=-]{12,}|sk-[a-z0-9]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)")


def normal(key):
    return key.strip().lower().replace("-", "_").replace(".", "_")


def count(value):
    if isinstance(value, dict):
        return len(value) + sum(map(count, value.values()))
    return sum(map(count, value)) if isinstance(value, list) else 0


def depth(value):
    children = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return 1 + max(map(depth, children), default=0)


def nodes(value, path="", found=None):
    found = [] if found is None else found
    found.append((path, value))
    if isinstance(value, dict):
        for key, child in value.items():
            nodes(child, f"{path}.{key}" if path else key, found)
    elif isinstance(value, list):
        for i, child in enumerate(value):
            nodes(child, f"{path}[{i}]", found)
    return found


def masked(value, blocked, scan):
    if isinstance(value, dict):
        return {
            k: "[REDACTED]" if normal(k) in blocked or (scan and isinstance(v, str) and SECRET.search(v))
            else masked(v, blocked, scan)
            for k, v in value.items()
        }
    return [masked(v, blocked, scan) for v in value] if isinstance(value, list) else value


def dumps(value, ascii_only=False):
    return json.dumps(value, ensure_ascii=ascii_only)
