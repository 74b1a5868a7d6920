"""Column functions over text: ASCII folding, snippets, prefixes, line numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, as the body of a regular expression's class (Java's own classes are ASCII only).
WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"

#: What each embedding family wants before a query and before a passage.
PREFIXES = {
    "e5": ("query: ", "passage: "),
    "ruri-v3": ("検索クエリ: ", "検索文書: "),
    "qwen3": ("Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery:", ""),
    "bge-m3": ("", ""),
    "sarashina-v2": ("task: 質問を与えるので、その質問に答えるのに役立つ関連文書を検索してください。\nquery: ", "text: "),
    "plamo": ("", ""),
}


def ascii_fold(text: Column) -> Column:
    """A to Z as a to z and nothing else: the folding of the substring fallback."""
    return F.translate(text, _UPPER, _LOWER)


def contains_ascii(text: Column, needle: str) -> Column:
    """Substring test with ASCII folding; no character of ``needle`` is special."""
    return F.contains(ascii_fold(text), F.lit(needle.translate(str.maketrans(_UPPER, _LOWER))))


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(f"[^{WHITE}]"))


def snippet(text: Column, width: int = 160) -> Column:
    """White space collapsed; what is longer than ``width`` ends in three dots."""
    flat = F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


#: The models of each family, by the head of their name, and those that are a family by themselves.
FAMILIES = {"cl-nagoya/ruri-v3-": "ruri-v3", "Qwen/Qwen3-Embedding-": "qwen3", "sbintuitions/sarashina-embedding-v2-": "sarashina-v2"}
MODELS = {"BAAI/bge-m3": "bge-m3", "pfnet/plamo-embedding-1b": "plamo"}


def prefix_policy(model: str) -> str:
    """Family whose prefixes a model takes; unknown models are of the e5 family."""
    return MODELS.get(model) or next((family for head, family in FAMILIES.items() if model.startswith(head)), "e5")


def with_prefix(text: Column, policy: str, query: bool = False) -> Column:
    return F.concat(F.lit(PREFIXES[policy][0 if query else 1]), text)


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes."""
    return F.sha2(content, 256)
