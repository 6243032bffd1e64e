"""Column functions on paths, lines, times and searches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column, cwd: Column) -> Column:
    """Slashes for backslashes, and relative to cwd where it lies below; null stays null."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    prefix = F.concat(F.regexp_replace(cwd, "/+\\z", ""), F.lit("/"))
    return F.when(cwd.isNotNull() & F.startswith(slashed, prefix), F.substr(slashed, F.length(prefix) + 1)).otherwise(slashed)


def bash_target(command: Column) -> Column:
    """The last word of a command that looks like a path, without redirection marks and quotes; null where there is none."""
    words = F.filter(F.split(command, r"\s+"), lambda w: F.contains(w, F.lit("/")) | F.endswith(w, F.lit(".rs")) | F.endswith(w, F.lit(".ts")))
    last = F.btrim(F.try_element_at(words, F.lit(-1)), F.lit(">\"'"))
    return F.nullif(last, F.lit(""))


def lines(text: Column) -> Column:
    """The lines of a text: ended by \\n or \\r\\n, no empty line after the last end; an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\r?\n\\z", ""), "\r?\n", -1))


def line_delta(before: Column, after: Column) -> Column:
    """The set of lines that are in after and not in before."""
    return F.array_except(lines(after), lines(before))


def effect_present(before: Column, after: Column, final: Column) -> Column:
    """Whether all added lines are in final and no removed one is; true where nothing changed."""
    kept = F.size(F.array_except(line_delta(before, after), lines(final))) == 0
    return kept & ~F.arrays_overlap(line_delta(after, before), lines(final))


def partial_effect(before: Column, after: Column, final: Column) -> Column:
    """Whether some but not all added lines are in final."""
    added = line_delta(before, after)
    there = F.size(F.array_intersect(added, lines(final)))
    return (there > 0) & (there < F.size(added))


def literal_contains(column: Column, needle: str) -> Column:
    """Case-insensitive search of a literal: no character of the needle is a wildcard; null holds nothing."""
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lower(F.lit(needle)))


def is_uuid(column: Column) -> Column:
    return column.rlike(r"\A[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z")


def is_file_modifying(tool: Column) -> Column:
    return tool.isin("Edit", "Write", "NotebookEdit", "Bash") | F.startswith(tool, F.lit("mcp_"))


def epoch_ms(value: Column) -> Column:
    """Numbers of at least ten digits are milliseconds already, smaller ones seconds."""
    return F.when(F.abs(value) >= 1e10, value).otherwise(value * 1000).cast("long")


def epoch_iso(ms: Column) -> Column:
    """ISO text in UTC with milliseconds; needs a session in UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def preview(payload: Column, read_bytes: int = 4096, shown: int = 280) -> Column:
    """The first characters of a binary payload, read as UTF-8 with broken bytes replaced."""
    return F.substring(F.make_valid_utf8(F.substring(payload, 1, read_bytes).cast("string")), 1, shown)


def html_escaped(value: Column) -> Column:
    """A text as it may stand in a page."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(mark), F.lit(name))
    return value


def url_encoded(value: Column) -> Column:
    """A text as a part of an address: all but letters, digits and - _ . ~ by the bytes of UTF-8."""
    value = F.url_encode(value)
    for mark, name in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        value = F.replace(value, F.lit(mark), F.lit(name))
    return value


def percent_decoded(value: Column) -> Column:
    """The text of a part of an address: + is a space, a percent sign without two digits stays, broken UTF-8 is replaced."""
    plain = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    parts = F.split(F.replace(plain, F.lit("+"), F.lit(" ")), "(?=%)")
    coded = F.transform(parts, lambda x: F.when(F.startswith(x, F.lit("%")), F.concat(F.substring(x, 2, 2), F.hex(F.substring(x, 4, 1 << 30)))).otherwise(F.hex(x)))
    return F.make_valid_utf8(F.unhex(F.array_join(coded, "")).cast("string"))


def query_values(target: Column) -> Column:
    """The names and values of an address' query, decoded; of repeated names the last counts."""
    pairs = F.when(F.contains(target, F.lit("?")), F.split(F.regexp_replace(target, r"\A[^?]*\?", ""), "&")).otherwise(F.array().cast("array<string>"))
    value = lambda x: percent_decoded(F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, r"\A[^=]*=", "")).otherwise(""))
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), value(x).alias("value")))
    last = F.filter(entries, lambda x, i: ~F.exists(F.filter(entries, lambda y, j: j > i), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def base_confidence(tool: Column) -> Column:
    return F.when(tool.isin("Edit", "Write", "NotebookEdit"), 1.0).when((tool == "Bash") | F.startswith(tool, F.lit("mcp_")), 0.6).otherwise(0.3)


def evidence_kind(tool: Column) -> Column:
    return (
        F.when(tool.isin("Edit", "NotebookEdit"), "direct_edit")
        .when(tool == "Write", "direct_write")
        .when(tool == "Bash", "bash_correlation")
        .when(F.startswith(tool, F.lit("mcp_")), "mcp_correlation")
        .otherwise("missing_final_state")
    )


def classify(tool: Column, path: Column, denied: Column, executed: Column, tracked: Column, before: Column, post: Column, final: Column) -> Column:
    """(outcome, confidence, evidence_kind) of a proposal, the first row that holds:

    denied; no path; file not tracked (accepted only for a Write with a result); no final state; no state after it; all of its
    effect in the final state; part of it; none of it. before, post and final are the file's contents."""
    base, kind = base_confidence(tool), evidence_kind(tool)
    before = F.coalesce(before, F.lit(""))
    row = lambda outcome, confidence, evidence: F.struct(F.lit(outcome).alias("outcome"), confidence.alias("confidence"), evidence.alias("evidence_kind"))
    fixed = lambda outcome, confidence, evidence="missing_final_state": row(outcome, F.lit(confidence), F.lit(evidence))
    return (
        F.when(denied, fixed("rejected", 1.0, "permission_denial"))
        .when(path.isNull(), fixed("rejected", 0.2))
        .when(~tracked & (tool == "Write") & executed, fixed("accepted", 0.4))
        .when(~tracked, fixed("rejected", 0.3))
        .when(final.isNull(), fixed("rejected", 0.3))
        .when(post.isNull(), row("rejected", base, kind))
        .when(effect_present(before, post, final), row("accepted", base, kind))
        .when(partial_effect(before, post, final), row("edited", F.greatest(base * 0.5, F.lit(0.2)), kind))
        .otherwise(row("rejected", base, kind))
    )
