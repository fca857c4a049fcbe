"""Scalar functions by group, and the registry that holds them by name."""

from tessella.functions import arrays, control, dates, json_text, numbers, text, vectors
from tessella.functions.registry import Registry, function_call, registry

__all__ = ["Registry", "arrays", "control", "dates", "function_call", "json_text", "numbers", "registry", "text", "vectors"]
