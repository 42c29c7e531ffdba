"""Schemas of the records that the operators exchange."""

from __future__ import annotations

from dataclasses import dataclass

BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean,source:string>"
#: seq is the place of a message in its session; kind and turn are tags that compaction sets.
MESSAGE = f"session_id string, seq long, role string, blocks array<{BLOCK}>, kind string, turn long, archive_key string, label string, summary string"
TOUCH = "session_id string, turn long, seq long, path string, kind string, evidence string"
ENTITY = "node_id string, kind string, file string, name string, span_start int, span_end int, code_hash string, signature string, bases array<string>, calls array<string>"
EDGE = "src string, dst string, type string"
CONCEPT_MEMBER = "concept_id string, node_id string"
ROLES = ("system", "user", "assistant", "tool")
BLOCK_TYPES = ("text", "thinking", "tool_use", "tool_result", "image")


@dataclass(frozen=True)
class CompactionConfig:
    """window_size full turns are kept; older ones become summaries."""

    window_size: int = 2
    most_pinned: int = 4
    extra_write_tools: tuple[str, ...] = ()
    extra_read_tools: tuple[str, ...] = ()
    extra_shell_tools: tuple[str, ...] = ()
    extra_path_keys: tuple[str, ...] = ()

    def __post_init__(self):
        if self.window_size < 0:
            raise ValueError("window_size must not be negative")


@dataclass(frozen=True)
class GraphConfig:
    structural_weight: float = 1.0
    similarity_weight: float = 1.0
    similarity_threshold: float = 0.75
    neighbours: int = 8
    jaccard_threshold: float = 0.5
    top_concepts: int = 5
    hops: int = 2
    skip_methods: bool = False
    max_file_kb: int = 512
