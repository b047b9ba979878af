"""Patterns that are accepted match joined texts exactly as they match their messages; others are refused."""

import random

import pytest
import regex

from colloquy.functions.pattern import Pattern, UnsafePattern, can_end_in_space, check_rule
from colloquy.functions.regex import WORD_START
from colloquy.plans.rules import REFERENCE_PACK, Rule, RulePack

REFUSED = ["a.*b", "a[^x]{0,9}b", r"a\W+b", r"\sfoo", "[ ]foo", " foo", "a...b", r"a\D{3}b", "a(.|x){3,}", "a*", "", "(b|)", "a||b", r"\|", r"\| a", r"a \|", "a[ -~]{3}b",
           "^a", "a$", r"\Aa", "a(?=b)", "(?i)a", "(?<!a)b", "a++", r"(a)\1", r"\p{Z}a", "a)", "(a", "a{x}", "[a", "*a", "a[[b]]", "a[b&&c]"]
ACCEPTED = ["a", "a|b", "a.?b", "a..b", r"a\S", "bem.?vind", "a[^|]{0,30}b", "a |b", "(a|b )c?", "x{2,}y", r"\ba\w+", r"a\s?b", r"a\|", "a[^\\s|]b", r"n[ãa]o (é |t[áa] )?", "a+?b", "[]a]b", "[a-z]{2,28}(c|d)", "👉"]


@pytest.mark.parametrize("p", REFUSED)
def test_refused(p):
    with pytest.raises(UnsafePattern):
        check_rule(p)


@pytest.mark.parametrize("p", ACCEPTED)
def test_accepted(p):
    check_rule(p)


def test_guards_and_packs():
    for guard in ("não |a.*b ", " ", " x", "a*", "| x"):
        with pytest.raises(UnsafePattern):
            check_rule("a", guard)
    with pytest.raises(UnsafePattern):
        RulePack((Rule("t", r"a\W+b"),), "other", "x", "y", "z")
    with pytest.raises(UnsafePattern):
        RulePack((Rule("t", "a"),), "other", "x ", "y", "z")
    assert REFERENCE_PACK.joint_rules == (11,)


@pytest.mark.parametrize("p, ends", [("a ", True), ("a( b| )?", True), ("a", False), (r"a\s", True), ("a.", True), ("a[^ ]", False), ("a {0,2}b", False), ("(a|b ){2}", True)])
def test_ends_in_space(p, ends):
    assert can_end_in_space(p) is ends


def random_pattern(rnd, depth=0):
    atoms = ["a", "b", "c", " ", ".", "[ab]", "[^a]", "[^|]", "[^ ]", "[^| ]", r"\s", r"\S", r"\w", r"\W", r"\|", r"\d", "[a-c ]", r"[\s|]"]
    out = ""
    for _ in range(rnd.randint(1, 3)):
        x = rnd.choice(atoms) if depth > 1 or rnd.random() < 0.8 else "(" + random_pattern(rnd, depth + 1) + ")"
        out += x + rnd.choice(["", "", "", "", "?", "*", "+", "{2}", "{1,3}", "{0,9}", "{5}"])
    return out + ("|" + random_pattern(rnd, depth + 1) if depth < 2 and rnd.random() < 0.25 else "")


def matches(keywords, text, guard=None, word_start=True):
    pre = WORD_START if word_start else ""
    body = f"(?=(?:{keywords}))(?<!(?:{guard}))" if guard else f"(?:{keywords})"
    return regex.search(f"(?s){pre}(?i:{body})", text) is not None


def test_accepted_patterns_see_messages_as_the_joined_text():
    rnd, accepted, differ = random.Random(7), 0, 0
    text = lambda: "".join(rnd.choice("aabbc  |1.") for _ in range(rnd.randint(1, 9)))
    guards = [None, None, "a ", "b|c ", "a[^|]{0,3} "]
    for _ in range(6000):
        p, guard, start = random_pattern(rnd), rnd.choice(guards), rnd.random() < 0.7
        try:
            check_rule(p, guard)
            ok = True
        except UnsafePattern:
            ok = False
        space = ok and can_end_in_space(p)
        for _ in range(12 if ok else 4):
            messages = [text() for _ in range(rnd.randint(1, 4))]
            whole = matches(p, " | ".join(messages), guard, start)
            last = len(messages) - 1
            apart = any(matches(p, m + (" " if space and i < last else ""), guard, start) or matches(p, m, guard, start) for i, m in enumerate(messages))
            assert not ok or whole == apart, (p, guard, start, messages)
            differ += not ok and whole != apart
        accepted += ok
    assert accepted > 800 and differ > 20  # some are accepted, and some of the others would have been wrong


def test_kinds_are_never_too_few():
    """What a pattern matches, it is taken to match."""
    rnd = random.Random(8)
    for _ in range(3000):
        p = random_pattern(rnd)
        q = Pattern(p)
        for _ in range(6):
            m = regex.search(f"(?s)(?:{p})", "".join(rnd.choice("ab c|  1") for _ in range(12)))
            if m and m.group().endswith(" "):
                assert q.can_end_in_space(), p
            if m and not m.group():
                assert q.can_be_empty(), p
            if m and (" | " in m.group() or m.group().startswith(" ")):
                assert q.can_take_joint(), p
