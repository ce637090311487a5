"""Column functions: tokens, numbers, stems."""

from .stemming import porter2, stem
from .text import alphanumeric_tokens, parse_u64, whitespace_tokens

__all__ = ["alphanumeric_tokens", "parse_u64", "porter2", "stem", "whitespace_tokens"]
