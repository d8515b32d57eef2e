"""Settings of an index, with their defaults, checks and derived budgets."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = 2
BASE_SCHEMA = ("file", "doc_type", "doc_group", "topics", "date_added")


class EngineError(Exception):
    """A refusal with a stable code."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


@dataclass(frozen=True)
class Config:
    """All settings. Nested settings of the JSON form are flat here: their names don't clash."""

    ingestion_directory: str = "."
    vault_type: str = "generic"
    schema_version: int = SCHEMA_VERSION
    doc_type_path_mappings: Mapping[str, str | list[str]] = field(default_factory=dict)
    docling_used: bool = False
    page_numbers_present: bool = False
    page_numbers_in_citations: bool = False
    base_schema: tuple[str, ...] = BASE_SCHEMA
    schemas: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    cross_type_join_fields: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    doc_groups: Mapping[str, str] = field(default_factory=dict)
    fallback_chunk_size_lines: int = 150
    max_section_size_lines: int = 200
    placeholder_word_threshold: int = 20
    redirect_max_prose_words: int = 40
    navigation_min_links: int = 5
    navigation_max_non_link_words: int = 30
    sibling_summary_similarity_max: float = 0.85
    root_summary_similarity_max: float = 0.9
    semantic_retry_limit: int = 2
    max_nodes_per_semantic_batch: int = 12
    max_content_characters_per_semantic_batch: int = 30000
    node_summary_min_words: int = 15
    node_summary_max_words: int = 60
    root_summary_min_words: int = 30
    root_summary_max_words: int = 100
    hierarchy_fields: tuple[str, ...] = ("doc_type",)
    max_nodes: int = 15
    max_depth_per_branch: int = 4
    max_nodes_per_query: int = 25
    aggregation_multiplier: int = 3
    output_format: str = "json"

    #: Sections of the JSON form.
    SECTIONS = ("vault", "source", "doc_types", "chunking", "ingestion_quality", "doc_summary_index", "query")

    @classmethod
    def load(cls, raw: Mapping[str, Any]) -> Config:
        """From the JSON form. A version from the future or a missing directory is refused; what isn't a number where one is due takes the default."""
        version = raw.get("schema_version")
        version = version if isinstance(version, int) and not isinstance(version, bool) else 0
        if version > SCHEMA_VERSION:
            raise EngineError("future_schema", f"schema_version {version} is newer than {SCHEMA_VERSION}")
        flat: dict[str, Any] = {}
        for section in cls.SECTIONS:
            flat.update(raw.get(section) or {})
        if "type" in (raw.get("vault") or {}):
            flat["vault_type"] = flat.pop("type")
        if not flat.get("ingestion_directory"):
            raise EngineError("bad_config", "vault.ingestion_directory is missing")
        known = {f.name: f for f in dataclasses.fields(cls)}
        values: dict[str, Any] = {"schema_version": version}
        for name, value in flat.items():
            if name not in known:
                continue
            default = known[name].default
            if isinstance(default, (int, float)) and not isinstance(default, bool):
                if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
                    continue
            values[name] = tuple(value) if isinstance(value, list) else value
        made = cls(**values)
        made.validate()
        return made

    def validate(self) -> None:
        if not self.hierarchy_fields:
            raise EngineError("bad_config", "hierarchy_fields needs one field at least")
        if self.fallback_chunk_size_lines < 1:
            raise EngineError("bad_config", "fallback_chunk_size_lines must be positive")

    def with_(self, **changes: Any) -> Config:
        made = dataclasses.replace(self, **changes)
        made.validate()
        return made

    # ---- columns ------------------------------------------------------------------------------------------------

    def doc_type(self, file: Column) -> Column:
        """The type whose path prefix is the longest that holds the file; null if none does. A table of prefixes is part
        of the settings, so it becomes one expression and needs no join."""
        best: Column = F.lit(None).cast("string")
        given = [(t, p) for t, ps in self.doc_type_path_mappings.items() for p in ([ps] if isinstance(ps, str) else ps)]
        cleaned = [(t, p.replace("\\", "/").removeprefix("./").rstrip("/")) for t, p in given]
        # a mapping may name one prefix or several
        for kind, prefix in sorted(cleaned, key=lambda x: len(x[1])):  # the longest is the outermost test
            best = F.when((file == prefix) | file.startswith(f"{prefix}/"), F.lit(kind)).otherwise(best)
        return best

    def doc_group(self, doc_type: Column) -> Column:
        group: Column = F.lit(None).cast("string")
        for kind, name in self.doc_groups.items():
            group = F.when(doc_type == kind, F.lit(name or None)).otherwise(group)
        return group

    def schema_fields(self, doc_type: Column) -> Column:
        """The further fields of a document's type, as an array."""
        fields = F.array().cast("array<string>")
        for kind, names in self.schemas.items():
            fields = F.when(doc_type == kind, F.array(*[F.lit(n) for n in names]).cast("array<string>")).otherwise(fields)
        return fields

    # ---- budgets and changes ----------------------------------------------------------------------------------------

    def budgets(self, mode: str = "single", deep: bool = False) -> dict[str, int]:
        """Nodes of the routing index, nodes of trees and depth that a question may use."""
        nodes = self.max_nodes_per_query * (self.aggregation_multiplier if mode in ("aggregation", "cross_type") else 1)
        times = 2 if deep else 1
        return {
            "routing_nodes": self.max_nodes * times,
            "tree_nodes": nodes * times,
            "depth": self.max_depth_per_branch * times,
        }


#: What a changed setting asks for: 2 migrate leaves, 3 ingest again, 4 rebuild the routing; all others: 1, nothing.
TIERS = {
    "schemas": 2,
    "base_schema": 2,
    "doc_groups": 2,
    "cross_type_join_fields": 2,
    "vault_type": 2,
    "docling_used": 3,
    "page_numbers_present": 3,
    "ingestion_directory": 3,
    "doc_type_path_mappings": 3,
    "hierarchy_fields": 4,
}


def impact(old: Config, new: Config) -> list[dict[str, Any]]:
    """The settings that differ, each with its tier, the gravest first."""
    out = []
    for f in dataclasses.fields(Config):
        before, after = getattr(old, f.name), getattr(new, f.name)
        if before != after:
            out.append({"setting": f.name, "old": before, "new": after, "tier": TIERS.get(f.name, 1)})
    return sorted(out, key=lambda x: (-x["tier"], x["setting"]))
