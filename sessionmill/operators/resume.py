"""How to resume a session from its log file's name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def session_id(harness: Column, filename: Column) -> Column:
    """Id a harness knows a session by, from the stem of the file name."""
    # A path's last element, trailing slashes aside; the extension starts at the last dot.
    base = F.substring_index(F.regexp_replace(filename, "/+$", ""), "/", -1)
    base = F.when(filename == "", ".").when(F.rlike(filename, F.lit("^/+$")), "/").otherwise(base)
    extension = F.regexp_extract(filename, r"\.[^./]*$", 0)
    stem = F.when(
        (extension != "") & F.endswith(base, extension),
        F.substr(base, F.lit(1), F.length(base) - F.length(extension)),
    ).otherwise(base)
    after = F.substring_index(stem, "_", -1)
    last_five = F.substring_index(stem, "-", -5)
    return (
        F.when((harness == "pi") & stem.contains("_") & (after != ""), after)
        .when(harness == "codex", last_five)
        .when((harness == "gemini") & stem.startswith("session-"), F.substr(stem, F.lit(len("session-") + 1)))
        .otherwise(stem)
    )


def resume_command(harness: Column, filename: Column, cwd: Column) -> Column:
    """Shell command that reopens the session; '' for an unknown harness."""
    name = _quoted(session_id(harness, filename))
    folder = F.coalesce(cwd, F.lit(""))
    return (
        F.when(harness == "pi", F.concat(F.lit("pi --session "), name))
        .when((harness == "opencode") & (folder != ""),
              F.concat(F.lit("opencode "), _quoted(folder), F.lit(" --session "), name))
        .when(harness == "opencode", F.concat(F.lit("opencode --session "), name))
        .when(harness == "codex", F.concat(F.lit("codex resume "), name))
        .when(harness == "gemini", F.concat(F.lit("gemini --resume "), name))
        .when(harness == "claude", F.concat(F.lit("claude --resume "), name))
        .otherwise("")
    )


def resume_label(harness: Column) -> Column:
    # Button texts.
    labels = {"pi": "Pi", "opencode": "OpenCode", "codex": "Codex", "gemini": "Gemini", "claude": "Claude"}
    text = F.lit(None)
    for key, label in labels.items():
        text = F.when(harness == key, f"Resume in {label}").otherwise(text)
    return F.coalesce(text, F.lit("Copy resume command"))


def _quoted(text: Column) -> Column:
    """Double-quoted text with backslash, quote and common control characters escaped."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))
