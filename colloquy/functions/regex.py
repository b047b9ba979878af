"""Rule regexes in Java syntax, and the first-match classifier column.

A rule's keywords are matched case-insensitively (Unicode case folding) as
*prefixes of words*: a keyword must start where a word starts, i.e. not right
after a letter, digit or underscore (every keyword begins with a letter). Java
has no start-of-word anchor, so it is spelled as a lookbehind. An optional
negation guard is a bounded lookbehind: the keyword does not count when the
text directly before it matches the guard. ``.`` matches line breaks too
(DOTALL), as in the source dialect of the rules.

Rewrites that keep the meaning and cut the backtracking work of Java's engine:
a lookahead on the set of possible first characters of the alternatives (one
class test rejects most positions before any alternative is tried); the guard
lookbehind is evaluated only after a keyword is known to start there; the
case-insensitive flag is scoped to the keyword part; and a first-match chain
starts with one pass of the union of its rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_START = r"(?<![\p{L}\p{N}_])"
FLAGS_GLOBAL = "(?s)"


def _top_level_alternatives(rx: str) -> list[str] | None:
    """Split ``rx`` on top-level ``|``; None if it is not well-formed enough."""
    parts, depth, cls, esc, cur = [], 0, False, False, []
    for ch in rx:
        if esc:
            cur.append(ch)
            esc = False
            continue
        if ch == "\\":
            esc = True
        elif cls:
            cls = ch != "]"
        elif ch == "[":
            cls = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            parts.append("".join(cur))
            cur = []
            continue
        cur.append(ch)
    if depth != 0 or cls or esc:
        return None
    parts.append("".join(cur))
    return parts


def _first_atoms(rx: str) -> list[str] | None:
    """Class bodies covering the first character of every match of ``rx``."""
    alts = _top_level_alternatives(rx)
    if not alts:
        return None
    members: list[str] = []
    for a in alts:
        if not a:
            return None
        if a[0] == "[":
            end = a.find("]", 2)
            if end < 0 or a[1] == "^" or "\\" in a[1:end] or "[" in a[1:end]:
                return None
            sub, rest = [a[1:end]], a[end + 1:]
        elif a[0] == "(":
            depth, i = 0, 0
            for i, ch in enumerate(a):
                depth += (ch == "(") - (ch == ")")
                if depth == 0:
                    break
            inner = a[1:i]
            if inner.startswith("?"):
                if not inner.startswith("?:"):
                    return None
                inner = inner[2:]
            sub, rest = _first_atoms(inner), a[i + 1:]
            if sub is None:
                return None
        elif a[0] in "\\.|*+?{}^$)]":
            return None
        else:
            ch = a[0]
            sub, rest = [("\\" + ch) if ch in "-^[]&" else ch], a[1:]
        if rest[:1] in ("*", "?", "{"):
            return None
        members.extend(sub)
    return members


def _split_first_atom(alt: str):
    """(first atom, rest) of an alternative when its first atom is a plain
    literal character or a simple bracket class that is not quantified."""
    if not alt:
        return None
    if alt[0] == "[":
        end = alt.find("]", 2)
        if end < 0 or alt[1] == "^" or "\\" in alt[1:end] or "[" in alt[1:end]:
            return None
        atom, rest = alt[:end + 1], alt[end + 1:]
    elif alt[0] in "\\().|*+?{}^$)]":
        return None
    else:
        atom, rest = alt[0], alt[1:]
    if rest[:1] in ("*", "+", "?", "{"):
        return None
    return atom, rest


def factor_by_first_atom(keywords: str) -> str:
    """Regroup a top-level alternation by first atom: ``ab|ac|d`` becomes
    ``a(?:b|c)|d``. It matches at exactly the same positions (alternation order
    only decides *which* alternative wins, never *whether* one matches), and
    Java then compares each position against one atom per group instead of one
    per alternative. Only used for existence tests (``rlike``)."""
    alts = _top_level_alternatives(keywords)
    if not alts or len(alts) < 2:
        return keywords
    groups: dict[str, list[str]] = {}
    order: list[str] = []
    for a in alts:
        split = _split_first_atom(a)
        key = split[0] if split else "\0" + a  # exact atom text: no case mapping of the pattern
        if key not in groups:
            groups[key] = []
            order.append(key)
        groups[key].append(a if split is None else split[1])
    out = []
    for key in order:
        members = groups[key]
        if key.startswith("\0"):
            out.append(members[0])
        elif len(members) == 1:
            out.append(key + members[0])
        else:
            out.append(key + "(?:" + "|".join(members) + ")")
    return "|".join(out)


def first_char_class(keywords: str) -> str | None:
    """A character class (a Java class union) holding every possible first
    character of a match of ``keywords``, or None when that cannot be read off
    simply (an alternative starting with an escape, dot, lookaround or an
    optional atom)."""
    members = _first_atoms(keywords)
    if not members:
        return None
    return "[" + "".join("[" + m + "]" for m in dict.fromkeys(members)) + "]"


def _body(keywords: str, guard: str | None, word_start: bool) -> str:
    """Pattern of one rule without global flags. Case-insensitivity is scoped to
    the keyword part (the word-start class is case-blind anyway), which spares
    Java a case fold per position in the lookbehind."""
    parts = [WORD_START] if word_start else []
    first = first_char_class(keywords)
    inner = f"(?={first})" if first else ""
    kw = factor_by_first_atom(keywords)
    if guard:
        inner += f"(?=(?:{kw}))(?<!(?:{guard}))"
    else:
        inner += f"(?:{kw})"
    parts.append(f"(?iu:{inner})")
    return "".join(parts)


def java_regex(keywords: str, guard: str | None = None, word_start: bool = True) -> str:
    return FLAGS_GLOBAL + _body(keywords, guard, word_start)


def any_rule_regex(rules) -> str:
    """One pattern that matches iff at least one of ``rules`` matches; the
    word-start test and a union of the first-character classes are factored out
    of the word-start rules so each position pays them once."""
    anchored = [r for r in rules if r.word_start]
    loose = [r for r in rules if not r.word_start]
    alts = []
    if anchored:
        firsts = [first_char_class(r.keywords) for r in anchored]
        gate = f"(?iu:(?=[{''.join(firsts)}]))" if all(firsts) else ""
        alts.append(WORD_START + gate + "(?:" + "|".join(_body(r.keywords, r.guard, False) for r in anchored) + ")")
    alts.extend(_body(r.keywords, r.guard, False) for r in loose)
    return FLAGS_GLOBAL + "(?:" + "|".join(alts) + ")"


def matches(text: Column, keywords: str, guard: str | None = None, word_start: bool = True) -> Column:
    return text.rlike(java_regex(keywords, guard, word_start))


def first_match_index(text: Column, rules) -> Column:
    """1-based index of the first rule whose regex matches ``text``;
    ``len(rules) + 1`` when none does. One ``CASE`` evaluated in order, so
    later regexes run only on rows the earlier ones missed. A single pass of
    the union of all rules goes first: most texts match no rule, and for them
    that one scan replaces one scan per rule."""
    default = F.lit(len(rules) + 1)
    if not rules:
        return default
    out = F.when(~text.rlike(any_rule_regex(rules)), default) if len(rules) > 1 else None
    for i, rule in enumerate(rules, start=1):
        cond = matches(text, rule.keywords, rule.guard, rule.word_start)
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out.otherwise(default)
