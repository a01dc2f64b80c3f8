"""Operators for training data; nothing else in the library imports this subpackage."""

from evidentia.llm import groups, lookalikes, names, oversized, packing, reading, scans, sentences, tokens

MODULES = [groups, names, sentences, scans, oversized, lookalikes, tokens, packing, reading]
