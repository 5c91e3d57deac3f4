"""Regular expressions as RE2 reads them, written for Java's engine.

What RE2 lacks is refused: look-around, back-references, possessive and atomic groups. What both have with different
meanings is rewritten: ``.``, ``^`` and ``$`` know only the line feed (Java's ``(?d)``), ``$`` without ``(?m)`` is the very end,
``\\s`` has no vertical tab, ``\\v`` is one, inside a class ``[`` and ``&&`` are characters and ``[:alpha:]`` a class. Time isn't rewritten: Java tries
alternatives one by one, so that a pattern like ``(a+)+b`` may take long on long values.
"""

from __future__ import annotations

import re

#: Escapes of letters that RE2 has; those of marks stand for the marks.
_LETTERS = "dDsSwWbBAzaftnrvxpPQ01234567"
_SPACES = r"\t\n\f\r "
_POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "upper": "Upper", "xdigit": "XDigit"}
_GROUP = re.compile(r"\(\?(?:P?<([A-Za-z_][A-Za-z0-9_]*)>|([ims]*(?:-[ims]+)?)(:|\)))")
_REPEAT = re.compile(r"[*+?]|\{[0-9]+(?:,[0-9]*)?\}")
_ESCAPE = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|x\{[0-9A-Fa-f]+\}|[pP](?:[A-Z]|\{\^?[A-Za-z_]+\})|[0-7]{3}|0[0-7]{0,2}|[^0-9])", re.S)


def java_pattern(pattern: str) -> str:
    """The pattern for Java; a ValueError if RE2 wouldn't take it."""
    out, at, after = ["(?d)"], 0, False  # after: a repetition has just ended

    def refuse(what: str) -> ValueError:
        return ValueError(f"not an RE2 pattern: {what} at {at} in {pattern!r}")

    multi = "(?m" in pattern or bool(re.search(r"\(\?[is]+m", pattern))
    while at < len(pattern):
        c = pattern[at]
        if m := _REPEAT.match(pattern, at):
            if after and not (m[0] == "?" and after != "lazy"):
                raise refuse("a repeated repetition")
            out.append(m[0])
            at, after = m.end(), "lazy" if after else True
            continue
        after = False
        if c == "\\":
            if pattern.startswith("\\Q", at):
                end = pattern.find("\\E", at)
                end = len(pattern) if end < 0 else end
                out.append("".join("\\" + x if x in r"\.[]{}()*+-?^$|&#" else x for x in pattern[at + 2 : end]))
                at = end + 2
                continue
            text, at = _escape(pattern, at, refuse, False)
            out.append(text)
        elif c == "[":
            text, at = _class(pattern, at, refuse)
            out.append(text)
        elif c == "(":
            if not pattern.startswith("(?", at):
                out.append("(")
                at += 1
            elif m := _GROUP.match(pattern, at):
                out.append(f"(?<g{len(out)}>" if m[1] else f"(?{m[2]}{m[3]}")  # Java's names have no underscore
                at = m.end()
            else:
                raise refuse("a group")
        else:
            out.append("\\z" if c == "$" and not multi else "\\{" if c == "{" else "\\}" if c == "}" else c)
            at += 1
    made = "".join(out)
    _balanced(made, refuse)
    return made


def _escape(pattern: str, at: int, refuse, inside: bool) -> tuple[str, int]:
    m = _ESCAPE.match(pattern, at)
    if not m or (m[0][1].isascii() and m[0][1].isalpha() and m[0][1] not in _LETTERS):
        raise refuse("an escape")
    text = m[0]
    if text in ("\\v", "\\s", "\\S"):
        text = {"\\v": r"\x0B", "\\s": _SPACES if inside else f"[{_SPACES}]", "\\S": f"[^{_SPACES}]"}[text]
    elif text[1] in "01234567":
        text = "\\0" + text[1:].lstrip("0").rjust(1, "0")
    elif text[1] in "pP" and text[2:4] == "{^":
        text = "\\" + ("P" if text[1] == "p" else "p") + "{" + text[4:]
    if text[1] in "pP" and len(text) > 4 and len(text.strip("\\pP{}")) > 2:
        text = f"{text[:2]}{{Is{text[3:]}"
    return text, m.end()


def _class(pattern: str, at: int, refuse) -> tuple[str, int]:
    out, at = ["["], at + 1
    if pattern.startswith("^", at):
        out.append("^")
        at += 1
    first = True
    while at < len(pattern) and (first or pattern[at] != "]"):
        c, first = pattern[at], False
        if m := re.compile(r"\[:(\^?)([a-z]+):\]").match(pattern, at):
            if m[2] not in (*_POSIX, "word"):
                raise refuse("a class name")
            name = r"\w" if m[2] == "word" else rf"\p{{{_POSIX[m[2]]}}}"
            out.append(name.replace("p", "P", 1).replace("w", "W", 1) if m[1] else name)
            at = m.end()
        elif c == "\\":
            text, at = _escape(pattern, at, refuse, True)
            out.append(text)
        else:
            out.append("\\" + c if c in "[&]#^~" else c)
            at += 1
    if at >= len(pattern):
        raise refuse("a class without an end")
    return "".join([*out, "]"]), at + 1


def _balanced(made: str, refuse) -> None:
    depth = 0
    for x in re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|[()]", made, re.S):
        depth += (x == "(") - (x == ")")
        if depth < 0:
            break
    if depth:
        raise refuse("a parenthesis without its other")
