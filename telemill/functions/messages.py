"""Error messages and stack traces reduced to what stays the same: normalised text, frames, fingerprint."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# What varies in a message, in the order of replacement, in a syntax common to Java and Python.
RULES = (
    # possessive: a quoted string of any length neither recurses nor backtracks
    (r"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|`[^`]*+`", "<str>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"(?i)\b[a-z][a-z0-9+.-]*://[^\s'\"<>()]+", "<url>"),
    (r"(?<=^|[\s(\[{=,:;])(?:~?/[^\s'\"()\[\]{},;:]+|[A-Za-z]:[\\/][^\s'\"()\[\]{},;:]*|\\\\[^\s'\"()\[\]{},;:]+)", "<path>"),
    (r"(?i)\b0x[0-9a-f]+\b|\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}\b", "<hex>"),
    (r"\b\d+(?:[.:]\d+)*(?:ns|us|ms|s|m|h|b|kb|mb|gb|k)?\b", "<n>"),
    (r"\s+", " "),
)
FRAMES, DIGITS, VERSION = 5, 16, "v1"


def normalised(message: Column) -> Column:
    """The message with its variable parts replaced and its white space collapsed."""
    out = F.coalesce(message, F.lit(""))
    for pattern, to in RULES:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def _python_rules() -> list[tuple[re.Pattern, str]]:
    # Python's look-behind takes one width: the start of the text is a case of its own
    return [(re.compile(p.replace(r"(?<=^|[\s(\[{=,:;])", r"(?:(?<=[\s(\[{=,:;])|^)"), re.ASCII), to) for p, to in RULES]


def _plain(text: str, rules: list[tuple[re.Pattern, str]]) -> str:
    for pattern, to in rules:
        text = pattern.sub(to, text)
    return text.strip()


# How runtimes print a place and a frame, which equal fingerprints depend on.
_PLACE = r"(?P<dir>[^\s()'\"]*?)(?P<file>[^\s()'\"/\\]+\.[A-Za-z0-9]+):\d+(?::\d+)?"
#: Shapes of a frame on one line: the function and the file, either of which may be missing.
SHAPES = tuple(
    re.compile(p)
    for p in (
        r"^File \"(?:[^\"]*[/\\])?(?P<file>[^\"/\\]*)\", line \d+(?:, in (?P<fn>.+))?$",
        r"^at (?P<fn>.*) in (?:.*[/\\])?(?P<file>[^/\\]+):line \d+$",
        rf"^{_PLACE}:in [`'](?P<fn>[^`']+)'",
        rf"^(?:at )?(?P<fn>.*?)\s*[(@]?\s*{_PLACE}",
        r"^at (?P<fn>.*?)\((?P<file>[^\s()]+?):\d+:\d+\)$",
        r"^at (?P<fn>.+)$",
    )
)
_LOCATION, _TRACEBACK = re.compile(_PLACE), "Traceback (most recent call last)"
_CALL = re.compile(r"^(?:created by )?(?P<fn>.+?)(?:\([^()]*\))?(?:\s+in goroutine \d+)?$")
_OFFSET = re.compile(r"\s*\+0x[0-9a-fA-F]+$")


def frames(stack: str) -> list[str]:
    """The innermost frames of a trace, innermost first, as "function file"."""
    rules, found, held = _python_rules(), [], None

    def add(fn: str | None, file: str | None) -> None:
        name = _plain(_OFFSET.sub("", (fn or "").strip().rstrip("(@").strip()), rules)
        found.append(f"{name} {_plain(file or '', rules)}".strip())

    lines = stack.replace("\r\n", "\n").split("\n")
    for raw, following in zip(lines, [*lines[1:], ""]):
        line = raw.strip()
        if held is not None:  # the location that belongs to the call above
            add(held, _LOCATION.match(line)["file"])
            held = None
        elif line and not line.startswith(_TRACEBACK):
            place = _LOCATION.match(following.strip())
            if following[:1] == "\t" or following[:2] == "  ":
                if place and not _LOCATION.search(line) and not SHAPES[0].match(line):
                    held = _CALL.match(line)["fn"]
                    continue
            m = next((m for m in (s.match(line) for s in SHAPES) if m), None)
            if m:
                add(m["fn"], m.groupdict().get("file"))
    if any(x.strip().startswith(_TRACEBACK) for x in lines):
        found.reverse()
    return found[:FRAMES]


@F.pandas_udf(ArrayType(StringType()))
def frames_of(stacks: pd.Series) -> pd.Series:
    return stacks.map(lambda s: frames(s) if s else [])


def _hash(source: str, lines: Column) -> Column:
    text = F.concat(F.lit(f"{VERSION}\n{source}\n"), lines)
    return F.substring(F.sha2(text.cast("binary"), 256), 1, DIGITS)


def fingerprint(message: Column, stack_frames: Column) -> Column:
    """By the stack's frames, else by the message, else null."""
    plain = normalised(message)
    by_stack = F.when(F.coalesce(F.size(stack_frames), F.lit(0)) > 0, _hash("stack", F.array_join(stack_frames, "\n")))
    return F.coalesce(by_stack, F.when(plain != "", _hash("message", plain)))


def shortened(text: Column, most: int) -> Column:
    """At most that many characters, a cut marked by an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))
