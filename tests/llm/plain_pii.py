"""The contract's base expressions, run plainly."""

import re

KINDS = ("email", "ip", "card", "phone")
EXPRESSIONS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
               r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    """(start, place of the kind, kind, end) in order."""
    out = []
    for no, (kind, expression) in enumerate(zip(KINDS, EXPRESSIONS)):
        out += [(m.start(), no, kind, m.end()) for m in re.finditer(expression, text) if holds(kind, m.group())]
    return sorted(out)
