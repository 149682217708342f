"""Chunk frames, and pipelines that are written as text or built in code."""

from millrace.plans.frame import ChunkFrame
from millrace.plans.pipeline import Pipeline, load_pipeline

__all__ = ["ChunkFrame", "Pipeline", "load_pipeline"]
