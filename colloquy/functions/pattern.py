"""What a rule pattern can match at the joints of a joined text.

Texts of a conversation are joined with ``' | '``. Rules are tested message by message, which equals testing the joined text only
if no match can take part of a joint but the space right after a message. ``Pattern`` decides that for a pattern: it reads the
regex syntax that rules may use (letters, classes, groups, alternation, quantifiers, ``\\s \\d \\w`` and their
opposites, ``\\b``) and refuses everything else, and follows all ways through it over three kinds of characters: space, bar and
any other. What it takes for possible may be more than what is possible, never less.
"""

from __future__ import annotations

from dataclasses import dataclass, field

SPACE, BAR, OTHER = 1, 2, 4
ANY = SPACE | BAR | OTHER
#: Kinds of characters behind an escaped letter.
ESCAPES = {"s": SPACE | OTHER, "S": BAR | OTHER, "d": OTHER, "D": ANY, "w": OTHER, "W": ANY, "h": SPACE | OTHER, "n": OTHER, "t": OTHER, "r": OTHER}
#: More repetitions than these are followed as any number.
MOST = 4


class UnsafePattern(ValueError):
    """A pattern that rules can't use, or whose syntax is not read here."""


def _kind(ch: str) -> int:
    return SPACE if ch == " " else BAR if ch == "|" else OTHER


@dataclass
class Pattern:
    """The ways through a pattern: ``steps[state]`` holds (kinds, next state); kinds 0 is a step without a character."""

    text: str
    steps: list[list[tuple[int, int]]] = field(default_factory=list)

    def __post_init__(self):
        self._at = 0
        self.start, self.end = self._alternation()
        if self._at < len(self.text):
            self._refuse("unbalanced )")

    def _refuse(self, why: str):
        raise UnsafePattern(f"pattern {self.text!r}: {why}")

    # -- reading ------------------------------------------------------------------------------------------------------

    def _state(self) -> int:
        self.steps.append([])
        return len(self.steps) - 1

    def _peek(self) -> str:
        return self.text[self._at : self._at + 1]

    def _take(self) -> str:
        ch = self._peek()
        if not ch:
            self._refuse("ends too early")
        self._at += 1
        return ch

    def _alternation(self) -> tuple[int, int]:
        start, end = self._state(), self._state()
        while True:
            a, b = self._sequence()
            self.steps[start].append((0, a))
            self.steps[b].append((0, end))
            if self._peek() != "|":
                return start, end
            self._at += 1

    def _sequence(self) -> tuple[int, int]:
        start = end = self._state()
        while self._peek() not in ("", "|", ")"):
            begin = self._at
            a, b = self._atom()
            a, b = self._repeated(begin, a, b)
            self.steps[end].append((0, a))
            end = b
        return start, end

    def _atom(self) -> tuple[int, int]:
        ch = self._take()
        if ch == "(":
            if self._peek() == "?":
                if self.text[self._at : self._at + 2] != "?:":
                    self._refuse("only (?: groups may begin with ?")
                self._at += 2
            inside = self._alternation()
            if self._take() != ")":
                self._refuse("unbalanced (")
            return inside
        if ch in "^$*+?{}":
            self._refuse(f"{ch} can't stand here")
        if ch == "\\":
            kinds = self._escape()
        else:
            kinds = self._class() if ch == "[" else ANY if ch == "." else _kind(ch)
        a, b = self._state(), self._state()
        self.steps[a].append((kinds, b))
        return a, b

    def _escape(self) -> int:
        ch = self._take()
        if ch == "b":
            return 0  # looks the same at a joint as at the end of a text
        if ch in ESCAPES:
            return ESCAPES[ch]
        if ch.isalnum():
            self._refuse(f"\\{ch} is not read")
        return _kind(ch)

    def _class(self) -> int:
        not_ = self._peek() == "^"
        self._at += not_
        kinds, whole, first = 0, 0, True
        while (ch := self._take()) != "]" or first:
            first = False
            if ch == "[" or ch == "&" and self._peek() == "&":
                self._refuse("nested classes are not read")
            if ch == "\\":
                e = self._take()
                if e.isalnum() and e not in ESCAPES:
                    self._refuse(f"\\{e} is not read")
                kinds |= ESCAPES.get(e, _kind(e))
                # what an opposite would leave out for sure
                whole |= {"s": SPACE, "S": BAR, "h": SPACE, "D": SPACE | BAR, "W": SPACE | BAR}.get(e, 0 if e.isalnum() else _kind(e) & ~OTHER)
            elif self._peek() == "-" and self.text[self._at + 1 : self._at + 2] not in ("]", ""):
                self._at += 1
                to = self._take()
                if to == "\\":
                    to = self._take()
                    if to.isalnum():
                        self._refuse("a range ends in a class")
                inside = sum(k for c, k in ((" ", SPACE), ("|", BAR)) if ch <= c <= to)
                kinds |= inside | OTHER
                whole |= inside
            else:
                kinds |= _kind(ch)
                whole |= _kind(ch) & ~OTHER
        return ANY & ~whole if not_ else kinds

    def _repeated(self, begin: int, a: int, b: int) -> tuple[int, int]:
        ch = self._peek()
        if not ch or ch not in "?*+{":
            return a, b
        self._at += 1
        low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(ch, (0, 0))
        if ch == "{":
            close = self.text.find("}", self._at)
            bounds = self.text[self._at : close].split(",") if close >= 0 else []
            if len(bounds) not in (1, 2) or not bounds[0].isdigit() or len(bounds) == 2 and bounds[1] and not bounds[1].isdigit():
                self._refuse("a quantifier that is not read")
            self._at = close + 1
            low = int(bounds[0])
            high = low if len(bounds) == 1 else int(bounds[1]) if bounds[1] else None
        after = self._at
        if self._peek() == "+":
            self._refuse("possessive quantifiers are not read")
        if self._peek() == "?":  # lazy: the same texts match
            after += 1
        # as many copies as are followed one by one, then any number
        body = (begin, after)
        low, high = min(low, MOST), None if high is None or high > MOST else high
        start = end = self._state()
        for i in range(low if high is None else high):
            if i:
                a, b = self._copy(body)
            self.steps[end].append((0, a))
            if i >= low:
                skip = self._state()
                self.steps[end].append((0, skip))
                self.steps[b].append((0, skip))
                end = skip
            else:
                end = b
        if high is None:
            if low:
                a, b = self._copy(body)
            loop = self._state()
            self.steps[end].append((0, loop))
            self.steps[loop].append((0, a))
            self.steps[b].append((0, loop))
            end = loop
        self._at = after
        return start, end

    def _copy(self, body: tuple[int, int]) -> tuple[int, int]:
        self._at = body[0]
        return self._atom()

    # -- questions ----------------------------------------------------------------------------------------------------

    def _some(self, first, move, accept) -> bool:
        """Whether some match leads an automaton (``first``; ``move(state, kind)``) to a state that it accepts."""
        todo, seen = [(self.start, first)], {(self.start, first)}
        while todo:
            s, q = todo.pop()
            if s == self.end and accept(q):
                return True
            for kinds, to in self.steps[s]:
                nexts = [q] if not kinds else [move(q, k) for k in (SPACE, BAR, OTHER) if kinds & k]
                for n in nexts:
                    if (to, n) not in seen:
                        seen.add((to, n))
                        todo.append((to, n))
        return False

    def can_be_empty(self) -> bool:
        return self._some(True, lambda q, k: False, lambda q: q)

    def can_end_in_space(self) -> bool:
        return self._some(0, lambda q, k: k, lambda q: q == SPACE)

    def can_take_joint(self) -> bool:
        """Whether a match in a joined text can hold a joint, or begin or end inside one (but for its first space):
        it holds ' | ', begins with a space or with '| ', ends in ' |', or is the bar."""

        def move(q, k):
            head, tail, bad = q
            tail = (*tail, k)[-3:]
            return ((*head, k)[:2], tail, bad or tail == (SPACE, BAR, SPACE))

        def accept(q):
            head, tail, bad = q
            return bad or head[:1] == (SPACE,) or head == (BAR, SPACE) or tail[-2:] == (SPACE, BAR) or tail == (BAR,)

        return self._some(((), (), False), move, accept)


def check_rule(keywords: str, guard: str | None = None) -> None:
    """Raises UnsafePattern for a rule whose matches in a joined text are not those in its messages."""
    p = Pattern(keywords)
    if p.can_be_empty():
        raise UnsafePattern(f"pattern {keywords!r} matches the empty text")
    if p.can_take_joint():
        raise UnsafePattern(f"pattern {keywords!r} could match across messages")
    if guard is not None:
        g = Pattern(guard)
        if g.can_be_empty():
            raise UnsafePattern(f"guard {guard!r} matches the empty text")
        if g.can_take_joint():
            raise UnsafePattern(f"guard {guard!r} could match across messages")


def can_end_in_space(keywords: str) -> bool:
    return Pattern(keywords).can_end_in_space()
