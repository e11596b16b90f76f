"""Composite graphs that index word lists."""

from __future__ import annotations

from ..operators.collections import group, sort
from ..operators.mapping import anchor, extract_fields, reverse_chars, to_lowercase
from ..stream import Stream


def build_rev_table(stream: Stream, token_field: str, reference_field: str) -> tuple[Stream, Stream]:
    """(the stream, its reversed tokens with their references, sorted)."""
    same, taken = extract_fields(stream, [token_field, reference_field])
    return same, sort(reverse_chars(taken, [token_field]), [token_field])


def build_ci_table(stream: Stream, token_field: str, reference_field: str, refs_field: str) -> tuple[Stream, Stream]:
    """(the stream, its lower-cased tokens with the references of each)."""
    same, taken = extract_fields(stream, [token_field, reference_field])
    lowered = sort(to_lowercase(taken, [token_field]), [token_field, reference_field])
    return same, group(lowered, [token_field], refs_field)


def build_word_list(stream: Stream, token_field: str, anchor_field: str, ci_anchor_field: str, ci_refs_field: str) -> tuple[Stream, Stream, Stream, Stream]:
    """(words, reversed words, case-insensitive words, reversed case-insensitive words) of anchored words."""
    same, ci = build_ci_table(stream, token_field, anchor_field, ci_refs_field)
    same, rev = build_rev_table(same, token_field, anchor_field)
    ci, rev_ci = build_rev_table(anchor(ci, ci_anchor_field), token_field, ci_anchor_field)
    return same, rev, ci, rev_ci
