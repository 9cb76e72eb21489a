"""Declared schemas and configuration of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructType, TimestampType

ROLES = ("user", "assistant", "system")


def _struct(**fields) -> StructType:
    out = StructType()
    for name, kind in fields.items():
        out = out.add(name, kind)
    return out


TURNS = _struct(conv_id=LongType(), turn=LongType(), turn_id=StringType(), role=StringType(), text=StringType(), created_at=TimestampType())
CHUNKS = _struct(
    chunk_id=StringType(), turn_id=StringType(), conv_id=LongType(), turn=LongType(), pos=IntegerType(), text=StringType(),
    start_char=IntegerType(), end_char=IntegerType(), token_count=IntegerType(),
    embedding=ArrayType(FloatType()), lexical_weights=MapType(StringType(), DoubleType()),
)


@dataclass(frozen=True)
class ChunkerConfig:
    """min_tokens cannot change chunks: a chunk ends only when the next sentence would not fit, so a short rest never fits either."""

    min_tokens: int = 120
    max_tokens: int = 250


@dataclass(frozen=True)
class RetrievalConfig:
    """ef_search matters to approximate search alone."""

    k: int = 10
    ef_search: int = 50


@dataclass(frozen=True)
class EvalConfig:
    chunker: ChunkerConfig = field(default_factory=ChunkerConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    conversation_dir: str = ""
    results_dir: str = "results"
    responder_model: str = "extractive"
    judge_model: str = "overlap"
    max_conversations: int | None = None
    recent_window: int = 4
