"""What a rule's pattern demands and what it may cost, read off its syntax tree.

``required_literals``: texts one of which must occur wherever the pattern is found,
so that a plain search can rule most records out before the regex runs.

``never_ends``: whether repetitions inside repetitions give the same text more than
one reading, so that a failing search may take time exponential in the text.

``simplified``: the same yes-or-no search without repetitions that add nothing to
it (at either end of the pattern) and with loops that a backtracking engine can run
without a stack.

All three take patterns as the rules hold them for Java and give nothing (None, False
or None) where the tree holds what they don't know.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as K
from re import _parser

MAXREPEAT = K.MAXREPEAT
_GROUP_NAME = re.compile(r"\(\?<(?![=!])")
#: Java reads these otherwise than Python's parser does.
_FOREIGN = re.compile(r"\\b\{|\\0|&&|\[[^\]]*\[")
_REPEATED_GROUP = re.compile(r"\)(?:[*+]|\{\d*,\})")
#: More places than this in a pattern are not examined for ambiguity.
MOST_PLACES = 400


@lru_cache(maxsize=1024)
def tree(pattern: str):
    """Syntax tree of a pattern, or None."""
    if _FOREIGN.search(pattern):
        return None
    try:
        return _parser.parse(_GROUP_NAME.sub("(?P<", pattern).replace(r"\z", r"\Z"))
    except (re.error, OverflowError, RecursionError):
        return None


# ----------------------------------------------------- required literals --

#: So many literals at most, each so long at least, are worth a search.
MOST_LITERALS, LEAST_LETTERS = 24, 2


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    """The set whose shortest literal is longer, then the smaller set."""
    if a is None or b is None:
        return a if b is None else b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _required(items) -> frozenset | None:
    """Literals one of which every text that ``items`` match in a row holds."""
    best, run = None, ""

    def close():
        nonlocal best, run
        if run:
            best = _better(best, frozenset([run]))
        run = ""

    for op, arg in items:
        if op is K.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if op is K.AT:  # takes no text, so the run goes on behind it
            continue
        if op is K.SUBPATTERN and not arg[1] and not arg[2] and all(o is K.LITERAL and a < 128 for o, a in arg[3]):
            run += "".join(chr(a).lower() for _, a in arg[3])
            continue
        close()
        if op is K.SUBPATTERN and not arg[1] and not arg[2]:
            best = _better(best, _required(arg[3]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] > 0:
            best = _better(best, _required(arg[2]))
        elif op is K.ATOMIC_GROUP:
            best = _better(best, _required(arg))
        elif op is K.BRANCH:
            sides = [_required(b) for b in arg[1]]
            if all(sides):
                best = _better(best, frozenset().union(*sides))
    close()
    return best


def required_literals(patterns: list[str]) -> list[str] | None:
    """Lower-case ASCII texts one of which occurs in any ASCII text, put into lower
    case, where one of ``patterns`` is found ignoring case. None if there is no such
    short list. A literal that holds another one is left out."""
    found: set[str] = set()
    for p in patterns:
        parsed = tree(p) if p.isascii() else None
        if parsed is None or parsed.state.flags & ~(re.IGNORECASE | re.UNICODE | re.DOTALL | re.MULTILINE):
            return None
        some = _required(parsed)
        if some is None:
            return None
        found |= some
    few = sorted(f for f in found if not any(g != f and g in f for g in found))
    return few if few and len(few) <= MOST_LITERALS and min(map(len, few)) >= LEAST_LETTERS else None


# ------------------------------------------------------------- ambiguity --

# characters as bits: ASCII one by one, all others in four kinds
_OTHER_DIGIT, _OTHER_WORD, _OTHER_SPACE, _OTHER_REST = (1 << b for b in range(128, 132))
_BEYOND = _OTHER_DIGIT | _OTHER_WORD | _OTHER_SPACE | _OTHER_REST
_ALL = (1 << 132) - 1


def _ascii(test) -> int:
    return sum(1 << i for i in range(128) if test(chr(i)))


_DIGIT = _ascii(str.isdigit) | _OTHER_DIGIT
_SPACE = _ascii(lambda c: c in " \t\n\r\f\v\x1c\x1d\x1e\x1f") | _OTHER_SPACE
_WORD = _ascii(lambda c: c.isalnum() or c == "_") | _OTHER_DIGIT | _OTHER_WORD
_CATEGORY = {K.CATEGORY_DIGIT: _DIGIT, K.CATEGORY_NOT_DIGIT: _ALL & ~_DIGIT, K.CATEGORY_SPACE: _SPACE,
             K.CATEGORY_NOT_SPACE: _ALL & ~_SPACE, K.CATEGORY_WORD: _WORD, K.CATEGORY_NOT_WORD: _ALL & ~_WORD}


def _one(c: int) -> int:
    """A character, ignoring case; beyond ASCII its whole kind."""
    out = 0
    for ch in {chr(c), *chr(c).lower(), *chr(c).upper()}:
        out |= (1 << ord(ch) if ord(ch) < 128 else _OTHER_DIGIT if ch.isdigit() else _OTHER_WORD if ch.isalnum()
                else _OTHER_SPACE if ch.isspace() else _OTHER_REST)
    return out


def _set(op, arg) -> int | None:
    """Characters that a one-character item matches, at least; None for other items."""
    if op is K.LITERAL:
        return _one(arg)
    if op is K.NOT_LITERAL:
        return _ALL & ~(_one(arg) & ~_BEYOND)
    if op is K.ANY:
        return _ALL
    if op is K.IN:
        some, whole, negate = 0, 0, False
        for o, a in arg:
            if o is K.NEGATE:
                negate = True
            elif o is K.LITERAL:
                some |= _one(a)
            elif o is K.RANGE:
                for c in range(a[0], min(a[1], 127) + 1):
                    some |= _one(c)
                some |= _BEYOND if a[1] > 127 else 0
            elif o is K.CATEGORY:
                whole |= _CATEGORY[a]
            else:
                return None
        return _ALL & ~(whole | some & ~_BEYOND) if negate else some | whole
    return None


class _Unknown(Exception):
    """Something whose matches are not examined."""


class _Places:
    """Positions of a pattern (after Glushkov): the characters of each, and which
    may follow which. ``twice``: some step can be taken in two ways, by a loop and by
    another inside it, or by alternatives that match nothing."""

    def __init__(self):
        self.chars: list[int] = []
        self.follow: list[set[int]] = []
        self.twice = False

    def add(self, items, looped: bool = False) -> tuple[set[int], set[int], bool]:
        """(first places, last places, whether it may match nothing) of a row."""
        first, last, empty = set(), set(), True
        for op, arg in items:
            f, l, e = self._item(op, arg, looped)
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            last = last | l if e else l
            empty = empty and e
        return first, last, empty

    def _item(self, op, arg, looped):
        chars = _set(op, arg)
        if chars is not None:
            if len(self.chars) >= MOST_PLACES:
                raise _Unknown
            self.chars.append(chars)
            self.follow.append(set())
            return {len(self.chars) - 1}, {len(self.chars) - 1}, False
        if op is K.SUBPATTERN:
            return self.add(arg[3], looped)
        if op is K.BRANCH:
            parts = [self.add(b, looped) for b in arg[1]]
            self.twice |= looped and sum(p[2] for p in parts) > 1
            return set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)), any(p[2] for p in parts)
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, body = arg
            endless = high is MAXREPEAT
            first, last, empty = self.add(body, looped or endless)
            if high > 1:
                for p in last:
                    self.twice |= endless and bool(self.follow[p] & first)
                    self.follow[p] |= first
            return first, last, empty or low == 0
        if op is K.AT or op in (K.ASSERT, K.ASSERT_NOT):
            return set(), set(), True
        raise _Unknown


def never_ends(pattern: str) -> bool:
    """True where a text may be read in a number of ways that doubles with its
    length: a repetition directly inside another, or two ways round a loop over the
    same characters. Patterns that aren't understood count as ending."""
    parsed = tree(pattern)
    return parsed is not None and _ambiguous(parsed)


def _ambiguous(items) -> bool:
    places = _Places()
    try:
        places.add(items)
    except _Unknown:
        return False
    if places.twice:
        return True
    # two readings of one text that part at a place and come together there again
    for p in range(len(places.chars)):
        apart = [s for s in _pairs(places, {(p, p)}) if s[0] != s[1]]
        if apart and (p, p) in _pairs(places, set(apart)):
            return True
    return False


def _pairs(places: _Places, start: set[tuple[int, int]]) -> set[tuple[int, int]]:
    """Pairs of places that two readings of one text reach from ``start``."""
    seen, todo = set(), list(start)
    while todo:
        a, b = todo.pop()
        for x in places.follow[a]:
            for y in places.follow[b]:
                if (x, y) not in seen and places.chars[x] & places.chars[y]:
                    seen.add((x, y))
                    todo.append((x, y))
    return seen


# -------------------------------------------------------- simplification --

_AT = {K.AT_BEGINNING: "^", K.AT_END: "$", K.AT_BOUNDARY: r"\b", K.AT_NON_BOUNDARY: r"\B", K.AT_BEGINNING_STRING: r"\A",
       K.AT_END_STRING: r"\z"}
_ESCAPE = {K.CATEGORY_DIGIT: r"\d", K.CATEGORY_NOT_DIGIT: r"\D", K.CATEGORY_SPACE: r"\s", K.CATEGORY_NOT_SPACE: r"\S",
           K.CATEGORY_WORD: r"\w", K.CATEGORY_NOT_WORD: r"\W"}


def _letter(c: int) -> str:
    ch = chr(c)
    if ch.isalnum() or ch == "_" or c >= 128:
        return ch
    return "\\" + ch if ch.isprintable() and ch != " " else f"\\x{c:02x}"


def _class(arg) -> str:
    out = ""
    for o, a in arg:
        if o is K.NEGATE:
            out = "^"
        elif o is K.LITERAL:
            out += _letter(a)
        elif o is K.RANGE:
            out += f"{_letter(a[0])}-{_letter(a[1])}"
        elif o is K.CATEGORY:
            out += _ESCAPE[a]
        else:
            raise _Unknown
    return f"[{out}]"


def _written(items) -> str:
    """A Java pattern that searches for the row; groups hold nothing back."""
    out = ""
    for op, arg in items:
        if op is K.LITERAL:
            out += _letter(arg)
        elif op is K.NOT_LITERAL:
            out += f"[^{_letter(arg)}]"
        elif op is K.ANY:
            out += "."
        elif op is K.IN:
            out += _class(arg)
        elif op is K.AT and arg in _AT:
            out += _AT[arg]
        elif op is K.BRANCH:
            out += "(?:" + "|".join(_written(b) for b in arg[1]) + ")"
        elif op is K.SUBPATTERN and not arg[1] and not arg[2]:
            out += f"(?:{_written(arg[3])})"
        elif op in (K.ASSERT, K.ASSERT_NOT):
            out += f"(?{'<' if arg[0] < 0 else ''}{'=' if op is K.ASSERT else '!'}{_written(arg[1])})"
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, body = arg
            many = "{%d,%s}" % (low, "" if high is MAXREPEAT else high)
            inner = _written(body) if not _needs_stack(body) and body[0][0] is not K.SUBPATTERN else f"(?:{_written(body)})"
            out += inner + many + ("?" if op is K.MIN_REPEAT else "+" if _settled(items, op, arg) else "")
        else:
            raise _Unknown
    return out


def _needs_stack(body) -> bool:
    """Whether a repetition of this is run by recursion: all but single characters."""
    body = list(body)
    while len(body) == 1 and body[0][0] is K.SUBPATTERN:
        body = list(body[0][1][3])
    return not (len(body) == 1 and _set(*body[0]) is not None)


def _settled(items, op, arg) -> bool:
    """Whether a greedy loop over several characters can keep what it took: at each
    character only one step fits, into the body, round the loop or on behind it."""
    low, high, body = arg
    if op is not K.MAX_REPEAT or high is not MAXREPEAT or not _needs_stack(body) or not _plain(body):
        return False
    at = next(i for i, x in enumerate(items) if x[1] is arg)
    places = _Places()
    try:
        first, last, empty = places.add(body)
        rest, _, rest_empty = places.add(list(items)[at + 1:])
    except _Unknown:
        return False
    if empty or rest_empty:
        return False
    inside = range(max(first | last) + 1)
    steps = [first | rest] + [places.follow[p] | (first | rest if p in last else set()) for p in inside]
    return all(sum(places.chars[q].bit_count() for q in s) == _union([places.chars[q] for q in s]).bit_count()
               for s in steps)


def _plain(body) -> bool:
    """Rows and alternatives of single characters only: no loops, no lookaround."""
    return all(_plain(arg[3]) if op is K.SUBPATTERN else all(_plain(b) for b in arg[1]) if op is K.BRANCH
               else _set(op, arg) is not None for op, arg in body)


def _union(sets: list[int]) -> int:
    out = 0
    for s in sets:
        out |= s
    return out


def _trimmed(items) -> list:
    """A row without what a yes-or-no search can spare at its ends: of a repetition
    there, all but the fewest rounds."""
    items = list(items)
    for end in (0, -1):
        while items:
            op, arg = items[end]
            if op is K.SUBPATTERN and not arg[1] and not arg[2]:
                items[slice(0, 1) if end == 0 else slice(len(items) - 1, None)] = list(arg[3])
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] < arg[1] and arg[0] <= 1:
                items[slice(0, 1) if end == 0 else slice(len(items) - 1, None)] = list(arg[2]) if arg[0] else []
            elif op is K.BRANCH and len(items) == 1:
                return [(op, (arg[0], [_trimmed(b) for b in arg[1]]))]
            else:
                break
    return items


def _refers(items) -> bool:
    """Whether anything depends on what a group held, or keeps what it took."""
    for op, arg in items:
        if op in (K.GROUPREF, K.GROUPREF_EXISTS, K.GROUPREF_IGNORE, K.ATOMIC_GROUP, K.POSSESSIVE_REPEAT):
            return True
        inner = [arg[3]] if op is K.SUBPATTERN else arg[1] if op is K.BRANCH else \
            [arg[2]] if op in (K.MAX_REPEAT, K.MIN_REPEAT) else [arg[1]] if op in (K.ASSERT, K.ASSERT_NOT) else []
        if any(_refers(i) for i in inner):
            return True
    return False


def _has_stack_loop(items) -> bool:
    for op, arg in items:
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            if arg[1] is MAXREPEAT and _needs_stack(arg[2]) or _has_stack_loop(arg[2]):
                return True
        elif op is K.SUBPATTERN and _has_stack_loop(arg[3]):
            return True
        elif op is K.BRANCH and any(_has_stack_loop(b) for b in arg[1]):
            return True
    return False


def needs_stack(pattern: str) -> bool:
    """Whether a loop over several characters may give back what it took."""
    parsed = tree(pattern)
    return parsed is not None and _has_stack_loop(parsed)


def needs_care(pattern: str) -> bool:
    """Whether a pattern may not end, or may need a stack as deep as its text. The
    tree reads alternatives of single characters as a class, so any repeated group
    beside a ``|`` counts."""
    parsed = tree(pattern)
    return parsed is not None and (_has_stack_loop(parsed) or _ambiguous(parsed)
                                   or "|" in pattern and _REPEATED_GROUP.search(pattern) is not None)


def simplified(pattern: str) -> str | None:
    """A Java pattern found in the same texts, for a pattern that needs care: without
    its optional ends, and with loops that keep what they took where that changes
    nothing. None if what is left may still not end, or isn't understood."""
    parsed = tree(pattern)
    if parsed is None or _refers(parsed) or parsed.state.flags & ~(re.IGNORECASE | re.UNICODE):
        return None
    items = _trimmed(parsed)
    if _ambiguous(items):
        return None
    try:
        return _written(items)
    except _Unknown:
        return None


# ------------------------------------------------------- first characters --

def _begin(items) -> tuple[int, bool]:
    """ASCII characters, as bits, that a text matched by ``items`` in a row may begin
    with, and whether that text may be empty."""
    some = 0
    for op, arg in items:
        if op is K.AT:
            continue
        if op is K.LITERAL or op is K.IN and not any(o is K.NEGATE or o is K.CATEGORY and a not in _PLAIN for o, a in arg):
            chars = _set(op, arg)
            if chars is None:
                raise _Unknown
            return some | chars, False
        least = 1
        if op is K.SUBPATTERN and not arg[1] and not arg[2]:
            parts = [arg[3]]
        elif op is K.BRANCH:
            parts = arg[1]
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            least, parts = arg[0], [arg[2]]
        elif op is K.ATOMIC_GROUP:
            parts = [arg]
        else:
            raise _Unknown
        found = [_begin(p) for p in parts]
        for chars, _ in found:
            some |= chars
        if least > 0 and not any(empty for _, empty in found):
            return some, False
    return some, True


_PLAIN = (K.CATEGORY_DIGIT, K.CATEGORY_SPACE, K.CATEGORY_WORD)
#: With more characters to begin with, few places of a text are ruled out.
MOST_FIRST = 70


def first_chars(patterns: list[str]) -> str | None:
    """A Java class of the characters that any match of one of ``patterns`` in an ASCII
    text, ignoring case, begins with. None if a match may be empty or isn't understood."""
    some = 0
    for p in patterns:
        parsed = tree(p) if p.isascii() else None
        if parsed is None or parsed.state.flags & ~(re.IGNORECASE | re.UNICODE | re.DOTALL | re.MULTILINE):
            return None
        try:
            chars, empty = _begin(parsed)
        except _Unknown:
            return None
        if empty:
            return None
        some |= chars
    ascii_chars = [i for i in range(128) if some >> i & 1]
    return f"[{''.join(f'\\x{i:02x}' for i in ascii_chars)}]" if 0 < len(ascii_chars) <= MOST_FIRST else None
