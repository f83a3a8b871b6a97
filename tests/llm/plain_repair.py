"""Conversation repair, one conversation at a time: audits as whole strings, and by trying all edits."""

import hashlib
import itertools
import re
import zlib

SPACE = " \t\n\v\f\r"


def damaged(rows):
    """{conv_id: [(turn, role, text)]} in order, from (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        said = lambda x: " " if x is None else str(x)
        what = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        own += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    tie = lambda r: hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie(r)))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _walk(row, fault, said, so_far, edit):
    """(cost, initials) after one edit, or None; said is a row's role initial."""
    if edit == "D":
        return 2, so_far
    if edit == "I":
        return 5, so_far + ("u" if so_far in ("", "s") or so_far.endswith("a") else "a")
    if fault in ("blank", "duplicate"):
        return None
    more = 5 if fault == "truncated" else 0
    follows = "a" if so_far.endswith("u") else "u"
    if edit == "R":
        return 1 + more, so_far + follows
    if said == "s" and so_far == "" or said == follows:
        return more, so_far + said
    return None


def cheapest(rows, found):
    """(cost, audit) by whole strings: the best of each ending so far."""
    short = lambda s: s if s in ("", "s") else s[-1]
    best = {"": (0, "")}
    for (_, role, _), fault in zip(rows, found, strict=True):
        later = {}
        for before, (cost, audit) in best.items():
            for n, edit in itertools.product(range(4), "DKR"):
                state, price = before, cost
                for _ in range(n):
                    more, state = _walk(role, fault, None, state, "I")
                    price, state = price + more, short(state)
                if (step := _walk(role, fault, role[:1], state, edit)) is None:
                    continue
                end, came = short(step[1]), (price + step[0], audit + "I" * n + edit)
                later[end] = min(later.get(end, came), came)
        best = later
    ends = {"": "", "a": "", "u": "I", "s": "II"}
    return min((cost + 5 * len(ends[s]), audit + ends[s]) for s, (cost, audit) in best.items())


def exhaustive(rows, found, most=2):
    """The same by trying every string of edits with up to most insertions before each row and at the end."""
    out = []
    for runs in itertools.product(range(most + 1), repeat=len(rows) + 1):
        for edits in itertools.product("DKR", repeat=len(rows)):
            cost, said = 0, ""
            for n, edit, (_, role, _), fault in zip(runs, edits, rows, found, strict=False):
                for step in "I" * n + edit:
                    walked = _walk(role, fault, role[:1], said, step)
                    if walked is None:
                        break
                    cost, said = cost + walked[0], walked[1]
                else:
                    continue
                break
            else:
                for _ in range(runs[-1]):
                    more, said = _walk(None, None, None, said, "I")
                    cost += more
                if re.fullmatch("(s?(ua)+)?", said):
                    out.append((cost, "".join("I" * n + e for n, e in zip(runs, edits, strict=False)) + "I" * runs[-1]))
    return min(out)


def applied(rows, audit):
    out, rest = [], iter(rows)
    for edit in audit:
        follows = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit == "I":
            out.append((follows, ""))
            continue
        _, role, text = next(rest)
        if edit == "K":
            out.append((role, text))
        elif edit == "R":
            out.append((follows, text))
    return out


def report(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = cheapest(rows, found)
    said = "\n".join(f"{r}:{t}" for r, t in applied(rows, audit))
    return (gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
