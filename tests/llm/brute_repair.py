"""Damage, faults and the cheapest repair of conversations by plain recursion over whole audits."""

import hashlib
import re
import zlib
from collections import defaultdict
from functools import cache

BLANK = re.compile(r"[^\x20\x09-\x0D]")


def after_damage(rows):
    """{conv_id: [(turn, role, text)]} of every original conversation."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kept = out[conv]
        name = lambda v: " " if v is None else str(v)
        role, text = name(role), name(text)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def fault_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        full = BLANK.findall(text)
        fault = "blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows, faults):
    """(cost, audit): the least cost, then the least audit of all edit sequences that read (s?(ua)+)?."""

    @cache
    def best(i, last, inserted):
        """``last``: initial of the turn before, or none; at most two inserts in a row can be of use."""
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, ""))
        follow = "a" if last == "u" else "u"
        if inserted < 3:
            cost, audit = best(i, follow, inserted + 1)
            options.append((cost + 3, "I" + audit))
        if i < len(rows):
            cost, audit = best(i + 1, last, 0)
            options.append((cost + 4, "D" + audit))
            if faults[i] not in ("blank", "duplicate"):
                extra, first = 3 * (faults[i] == "truncated"), rows[i][1][:1]
                cost, audit = best(i + 1, follow, 0)
                options.append((cost + 3 + extra, "R" + audit))
                if first == follow or (first == "s" and last == ""):
                    cost, audit = best(i + 1, first, 0)
                    options.append((cost + extra, "K" + audit))
        return min(options, default=(10**9, ""))

    return best(0, "", 0)


def rebuilt(rows, audit):
    todo, last, out = iter(rows), "", []
    for letter in audit:
        follow = "assistant" if last == "u" else "user"
        if letter == "I":
            role, text = follow, ""
        else:
            _, role, text = next(todo)
            if letter == "D":
                continue
            role = follow if letter == "R" else role
        out.append(f"{role}:{text}")
        last = role[0]
    return out


def repairs(rows):
    """{conv_id: the query's other columns}"""
    out = {}
    for conv, left in after_damage(rows).items():
        found, turns = fault_of(left), [r[0] for r in left if r[0] is not None]
        cost, audit = cheapest(left, found)
        pairs = zip([r[1][:1] for r in left], [r[1][:1] for r in left][1:], strict=False)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(rebuilt(left, audit)).encode()).hexdigest(),
        )
    return out
