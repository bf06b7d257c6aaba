"""Permission rules as column expressions: ``Tool``, ``Tool(argument)`` or ``mcp__server`` against recorded calls.

A rule is read once. It names a tool, or a server and with it all its tools, and says by its argument which calls of that tool it
means: a host (``domain:``), a command or the beginning of one (``:*``), or files by a glob. Each kind of argument has a
predicate of its own; a call whose kind has none under this rule is undecided (null), never taken for a no.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = set(string.ascii_letters + string.digits + "_-")


def parsed(rule: str) -> tuple[str, str | None] | None:
    """(name, argument or None) of a rule; None for what is not shaped like one."""
    head, bracket, rest = (rule or "").strip().partition("(")
    name = head.rstrip() if bracket else head
    if not name or not set(name) <= _NAME or name[0] in string.digits + "-" or bracket and not rest.endswith(")"):
        return None
    return name, rest[:-1].strip() if bracket else None


def glob(spec: str) -> str:
    """The regular expression of a file glob, segment by segment.

    ``**`` goes across folders and takes the slash behind it along; ``*`` and ``?`` stay in a folder. A glob that
    begins with ``//`` is the path from its start, any other the end of it from some folder on. One without wildcards
    means what lies below it, too."""
    spec = spec.replace("\\", "/").strip()
    rooted = spec.startswith("//")
    if rooted:
        drive = len(spec) > 3 and spec[2] in string.ascii_letters and spec[3] == ":"
        spec = spec[2:] if drive else spec[1:]
    elif spec.startswith("~/"):
        spec = spec[1:]
    out = ""
    segments = spec.split("/")
    for k, segment in enumerate(segments):
        out += ".*".join(_within(part) for part in segment.split("**"))
        if k + 1 < len(segments) and not segment.endswith("**"):
            out += "/"
    plain = not set(spec) & set("*?") and not spec.endswith("/")
    return f"(?iu){'^' if rooted else '(?:^|/)'}{out}{'(?:/.*)?' if plain else ''}\\z"


def _within(part: str) -> str:
    """A piece of a glob without ``**``."""
    wild = {"*": "[^/]*", "?": "[^/]"}
    return "".join(wild.get(c) or ("\\" + c if c in r".+^${}()|[]\&~-#" else c) for c in part)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _host(wanted: str) -> Callable[[Column, Column], Column]:
    wanted = wanted.strip().lower()
    wanted = wanted[2:] if wanted.startswith("*.") else wanted

    def test(url: Column, clipped: Column) -> Column:
        host = F.lower(F.try_parse_url(url, F.lit("HOST")))
        return F.when(host.isNotNull(), ((host == wanted) | host.endswith("." + wanted)) if wanted else F.lit(False))

    return test


def _command(spec: str) -> Callable[[Column, Column], Column] | None:
    """Commands that are chained in one line count each, and the line as a whole; quotes are not looked at, so that a rule's reach is not understated."""

    def lines(text: Column) -> Column:
        whole = _strip(text)
        return F.array_distinct(F.concat(F.array(whole), F.filter(F.transform(F.split(whole, r"&&|\|\||;"), _strip), lambda c: c != "")))

    if spec.endswith(":*"):
        begin = spec[:-2].strip().lower()
        return lambda text, clipped: F.exists(lines(text), lambda c: F.lower(c).startswith(begin))
    if "*" in spec:
        return None

    def exact(text: Column, clipped: Column) -> Column:
        found = lines(text)
        # Of a clipped command only the beginning is known: the rule may be what it goes on to be.
        open_end = clipped & F.lit(spec).startswith(F.element_at(found, -1))
        return F.when(F.array_contains(found, spec), True).when(~open_end, False)

    return exact


def covers(rule: str, tool: Column, kind: Column, argument: Column, clipped: Column | bool = False) -> Column:
    """Whether a rule covers a call of a tool whose argument is a command, a path or a url; null where its form does not decide."""
    undecided = F.lit(None).cast("boolean")
    read = parsed(rule)
    if read is None:
        return undecided
    name, spec = read
    tool, argument = F.coalesce(tool, F.lit("")), F.coalesce(argument, F.lit(""))
    clipped = F.lit(clipped) if isinstance(clipped, bool) else F.coalesce(clipped, F.lit(False))
    mine = tool == name
    if name.startswith("mcp__") and "__" not in name[5:]:
        mine = mine | tool.startswith(name + "__")
    if spec is None or spec == "*":
        return mine
    if spec[:7].lower() == "domain:":
        tests = {"url": _host(spec[7:])}
    else:
        tests = {"command": _command(spec), "path": lambda path, clipped: F.replace(path, F.lit("\\"), F.lit("/")).rlike(glob(spec))}
    by_kind = undecided
    for k, test in tests.items():
        if test is not None:
            by_kind = F.when(kind == k, test(argument, clipped)).otherwise(by_kind)
    return F.when(~mine, False).otherwise(by_kind)
