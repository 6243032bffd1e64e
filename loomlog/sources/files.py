"""Listing the session files of the agent tools, and the ids that their paths give.

The files are listed by Spark's binary file source: path, size and time, no contents. Roots that don't exist list nothing.
Ids that stand in a file's header are resolved later (see contents); until then id_kind names the rule.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UUID = "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
COLUMNS = "source string, source_session_id string, id_kind string, parent_source_session_id string, metadata_path string, format string, path string, size long, mtime long, side_mtime long"


@dataclass(frozen=True)
class Rule:
    """Where a tool keeps its files below a home: folders, a name pattern, and what the whole path must look like."""

    source: str
    folders: tuple[str, ...]
    glob: str
    shape: str
    format: str = "jsonl"


#: Where the tools keep their sessions: fixed values.
RULES = [
    Rule("claude_cli", (".claude", ".claude-code", ".claude-local", ".claude-m2", ".claude-zai"), "*.jsonl", rf"/\.claude[^/]*/(?:projects/.*|{UUID})\.jsonl$"),
    Rule("claude_local_agent", ("Library/Application Support/Claude/local-agent-mode-sessions",), "audit.jsonl", r"/local_[^/]*/audit\.jsonl$"),
    Rule("codex_cli", (".codex", ".codex-local"), "*.jsonl", r"/sessions/.*\.jsonl$|/archived_sessions/[^/]*\.jsonl$"),
    Rule("pi_agent", (".pi/agent/sessions",), "*.jsonl", r"\.jsonl$"),
    Rule("gemini_cli", (".gemini/tmp",), "*.json", r"/[^/]+/chats/[^/]*\.json$", "json"),
    Rule("factory", (".factory",), "*.jsonl", r"/sessions/.*\.jsonl$"),
]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _listed(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    there = [r for r in roots if exists(spark, r)]
    if not there:
        return spark.createDataFrame([], "path string, size long, mtime long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(there)
    path = F.url_decode(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit("+"), F.lit("%2B")))
    return files.select(path.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))


def _group(path: Column, pattern: str, k: int = 1) -> Column:
    return F.nullif(F.regexp_extract(path, pattern, k), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def claude_ids(path: Column) -> tuple[Column, Column]:
    """(id, parent): side chains and files deeper below `subagents` are qualified by the session that owns the folder."""
    below = rf"^(?:.*?/)?({UUID})/subagents/((?:[^/]+/)+[^/]+)$|^.*/({UUID})/subagents/(agent-[^/]*)$"
    parent = F.coalesce(_group(path, below, 1), _group(path, below, 3))
    rest = F.coalesce(_group(path, below, 2), _group(path, below, 4))
    qualified = F.concat(parent, F.lit("/subagents/"), F.regexp_replace(rest, r"\.[^./]*$", ""))
    return F.coalesce(qualified, stem(path)), parent


def pi_ids(path: Column) -> tuple[Column, Column, Column]:
    """(id, kind, parent): runs nested below a session are named by their header, all others by the end of their name."""
    nested = rf"/([^/]*_({UUID}))/([^/]+)/(run-[0-9]+)/session\.[^/.]*$"
    parent = _group(path, nested, 2)
    placeholder = F.concat_ws("/", _group(path, nested, 1), _group(path, nested, 3), _group(path, nested, 4))
    return (
        F.when(parent.isNotNull(), placeholder).otherwise(F.substring_index(stem(path), "_", -1)),
        F.when(parent.isNotNull(), "pi_header").otherwise("known"),
        parent,
    )


def discover(spark: SparkSession, home: str) -> DataFrame:
    """All session files below a home (COLUMNS), each once, by path."""
    parts = []
    for rule in RULES:
        files = _listed(spark, [os.path.join(home, f) for f in rule.folders], rule.glob).where(F.col("path").rlike(rule.shape))
        path = F.col("path")
        none = F.lit(None).cast("string")
        metadata = none
        if rule.source == "claude_cli":
            (own, parent), kind = claude_ids(path), F.lit("known")
        elif rule.source == "pi_agent":
            own, kind, parent = pi_ids(path)
        elif rule.source == "claude_local_agent":
            files = files.where(~F.col("path").rlike(r"/local_[^/]*/.*/local_[^/]*/audit\.jsonl$"))  # the first local_ folder ends the way down
            own, kind, parent = F.regexp_extract(path, r"/local_([^/]*)/audit\.jsonl$", 1), F.lit("local_agent_header"), none
            metadata = F.regexp_replace(path, r"/audit\.jsonl$", ".json")
        elif rule.source == "codex_cli":
            own, kind, parent = stem(path), F.lit("codex_header"), none
        elif rule.source == "factory":
            own, kind, parent, metadata = stem(path), F.lit("factory_header"), none, F.regexp_replace(path, r"\.jsonl$", ".settings.json")
            side = _listed(spark, [os.path.join(home, f) for f in rule.folders], "*.settings.json").select(F.regexp_replace("path", r"\.settings\.json$", ".jsonl").alias("path"), F.col("mtime").alias("side_mtime"))
            files = files.join(side, "path", "left")
        else:
            own, kind, parent = stem(path), F.lit("gemini_chat"), none
        files = files if "side_mtime" in files.columns else files.withColumn("side_mtime", F.lit(None).cast("long"))
        parts.append(files.select(F.lit(rule.source).alias("source"), own.alias("source_session_id"), kind.alias("id_kind"), parent.alias("parent_source_session_id"), metadata.alias("metadata_path"), F.lit(rule.format).alias("format"), "path", "size", "mtime", "side_mtime"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.dropDuplicates(["source", "path"])
