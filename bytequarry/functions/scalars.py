"""Scalar functions as Column builders."""

from __future__ import annotations

import datetime as dt
import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import VERSION_PATTERN

#: Codes of broken invariants.
PHYSICAL, PHYSICAL_ORPHAN, PHYSICAL_COUNT, PHYSICAL_NEGATIVE = "PHYSICAL_GRAPH_INTEGRITY", "PHYSICAL_GRAPH_ORPHAN", "PHYSICAL_GRAPH_REFCOUNT_MISMATCH", "PHYSICAL_GRAPH_NEGATIVE_REFCOUNT"
SNAPSHOT, SNAPSHOT_ORPHAN, SNAPSHOT_LIFECYCLE = "SNAPSHOT_GRAPH_INTEGRITY", "SNAPSHOT_GRAPH_ORPHAN_LOGICAL_REF", "SNAPSHOT_GRAPH_INVALID_LIFECYCLE"
GC_REFUSED, REPAIR_REFUSED, RETAINED = "GC_REFUSED_INTEGRITY", "REPAIR_REFUSED_ORPHAN_ROWS", "SNAPSHOT_RETAINED_DELETE_BLOCKED"
#: What to do about them, in this engine's words.
ACTIONS = (
    dict.fromkeys((PHYSICAL, PHYSICAL_ORPHAN, PHYSICAL_COUNT, PHYSICAL_NEGATIVE, GC_REFUSED), "repair the reference counts, then verify again")
    | dict.fromkeys((SNAPSHOT, SNAPSHOT_ORPHAN, SNAPSHOT_LIFECYCLE), "look into the snapshots concerned, remove or recreate them, then verify again")
    | {REPAIR_REFUSED: "resolve the physical rows without a file first; counts can't be repaired before", RETAINED: "delete the snapshots that hold the file first"}
)


class InvariantError(AssertionError):
    """A broken invariant with its code and what to do."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.action = code, ACTIONS.get(code, "")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob whose * and ? don't cross a slash. ValueError if it's malformed."""
    out, i = ["^"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i >= len(pattern):
                raise ValueError("glob ends with an escape")
            out.append(re.escape(pattern[i]))
        elif c == "[":
            end = i + 1 + (pattern[i + 1 : i + 2] == "^")
            start = end
            while end < len(pattern) and (pattern[end] != "]" or end == start):
                end += 2 if pattern[end] == "\\" else 1
            if end >= len(pattern) or end == start:
                raise ValueError("glob has an open class")
            body = re.sub(r"([\[&])", r"\\\1", pattern[start:end])
            out.append(f"[{'^' * (pattern[i + 1] == '^')}{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out) + r"\z"


def matches_glob(path: Column, pattern: str) -> Column:
    """A malformed pattern matches nothing."""
    try:
        return path.rlike(glob_regex(pattern))
    except ValueError:
        return F.lit(False)


def safe_regex(pattern: str) -> str:
    """RE2 syntax to Java's; look-around and back references don't exist in RE2."""
    if re.search(r"\(\?(?:<?[=!])|\\[1-9]", pattern):
        raise ValueError("look-around and back references aren't supported")
    return pattern.replace("(?P<", "(?<")


def normalized_path(path: Column) -> Column:
    """A snapshot path, or null if it isn't valid: no outer white space, no leading slash; ./ and // go."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./+)+", "")
    p = F.regexp_replace(p, "/{2,}", "/")
    bad = (path == "") | path.rlike(r"^\s|\s\z|^[/\\]") | (p == "")
    return F.when(~bad, p)


def source_path(path: Column) -> Column:
    return normalized_path(F.regexp_replace(path, r"^/+", ""))


def physical_path(path: str) -> str:
    return os.path.realpath(path)


def well_formed_version(version: Column) -> Column:
    return F.trim(version).rlike(VERSION_PATTERN)


def version_bucket(version: Column) -> Column:
    return F.when(well_formed_version(version), F.trim(version)).otherwise("unknown")


def version_state(version: Column, known: tuple[str, ...]) -> Column:
    """empty, malformed, unknown (well formed, but of no chunker here: fine for a restore) or known."""
    v = F.trim(F.coalesce(version, F.lit("")))
    return F.when(v == "", "empty").when(~v.rlike(VERSION_PATTERN), "malformed").when(~v.isin(*known), "unknown").otherwise("known")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def readable(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with two places."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((10, "KB"), (20, "MB"), (30, "GB")):
        out = F.when(size >= 1 << power, F.concat(F.format_number(size / (1 << power), 2), F.lit(f" {unit}"))).otherwise(out)
    return out


def ratio(part: Column, whole: Column, scale: float = 1.0) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double") * scale).otherwise(0.0)


def restore_target(path: Column, mode: str = "original", to: str = "") -> Column:
    """Where a file is restored: its own place, below a prefix, or at one given path."""
    if mode not in ("original", "prefix", "override"):
        raise ValueError(f"unknown mode {mode}")
    if (mode == "original") != (not to.strip()):
        raise ValueError("a destination goes with the modes prefix and override")
    if mode == "original":
        return path
    if mode == "prefix":
        return F.concat(F.lit(to.strip().rstrip("/") + "/"), F.regexp_replace(path, r"^[/\\]+", ""))
    return F.lit(os.path.normpath(to.strip()))


def parse_bound(value: str, upper: bool = False) -> int:
    """Seconds of an RFC 3339 time or a date; as an upper bound a date means its end, so the next day's begin is exclusive."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        day = dt.datetime.fromisoformat(value).replace(tzinfo=dt.UTC)
        return int((day + dt.timedelta(days=1)).timestamp()) - 1 if upper else int(day.timestamp())
    return int(dt.datetime.fromisoformat(value.replace("Z", "+00:00")).timestamp())
