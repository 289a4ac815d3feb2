"""All registries of the operators for training text."""

from __future__ import annotations

from siftline.llm import q_canonical, q_language, q_leaks, q_linkage, q_mixing, q_near, q_personal, q_stuffing, q_terms

REGISTRIES = [q_canonical.REG, q_language.REG, q_leaks.REG, q_linkage.REG, q_mixing.REG, q_near.REG, q_personal.REG, q_stuffing.REG, q_terms.REG]
