"""Text-analysis stages: maps, filters and flat maps over a stream of tokens.

A token stream is a DataFrame with a ``token`` column, a ``pos`` column (an array that orders the tokens of a text, one
number per tokenizer that they went through) and any others, which stages pass on. Stages are declarative; none runs a job.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stemming import stem

#: Token types: text as read, text as made by a stage, and numbers.
STR, STRING, U64, USIZE = "str", "String", "u64", "usize"


class PipelineTypeError(TypeError):
    """Stages that don't fit: what one emits isn't what the next one takes."""


@dataclass(frozen=True)
class Stage:
    """The extension point: subclass it and define ``transform``; with ``queryable`` it also serves in queries.

    ``takes`` are the token types accepted, ``emits`` the one produced. ``branch`` is for stages that send some tokens to
    another field instead: its result is that field's stream.
    """

    takes: ClassVar[tuple[str, ...]] = (STR,)
    emits: ClassVar[str] = STR
    branch_emits: ClassVar[str | None] = None
    queryable: ClassVar[bool] = True

    def transform(self, tokens: DataFrame) -> DataFrame:
        raise NotImplementedError

    def branch(self, tokens: DataFrame) -> DataFrame:
        raise PipelineTypeError(f"{type(self).__name__} has no branch")


class _Tokenizer(Stage):
    def split(self, token: Column) -> Column:
        raise NotImplementedError

    def transform(self, tokens: DataFrame) -> DataFrame:
        rest = [c for c in tokens.columns if c not in ("token", "pos")]
        out = tokens.select(*rest, "pos", F.posexplode(self.split(F.col("token"))).alias("__n", "token"))
        return out.where("token <> ''").select(*rest, F.concat("pos", F.array("__n")).alias("pos"), "token")


class WhitespaceTokenizer(_Tokenizer):
    """Splits at Unicode white space."""

    def split(self, token: Column) -> Column:
        return T.whitespace_tokens(token)


class AlphaNumericTokenizer(_Tokenizer):
    """Splits at all that is neither letter nor number."""

    def split(self, token: Column) -> Column:
        return T.alphanumeric_tokens(token)


class LowercaseFilter(Stage):
    """Lower-cases by Unicode's full mapping."""

    emits = STRING

    def transform(self, tokens: DataFrame) -> DataFrame:
        return tokens.withColumn("token", F.lower("token"))


@dataclass(frozen=True)
class Stemmer(Stage):
    """Snowball stems; doesn't lower-case."""

    takes = (STR, STRING)
    emits = STRING
    algorithm: str = "English"

    def __post_init__(self) -> None:
        if self.algorithm.rpartition("::")[2] != "English":
            raise ValueError(f"no such stemming algorithm: {self.algorithm}")

    def transform(self, tokens: DataFrame) -> DataFrame:
        return tokens.withColumn("token", stem(F.col("token")))


@dataclass(frozen=True)
class StopwordFilter(Stage):
    """Drops listed tokens; case matters, the order of the list doesn't."""

    takes = (STRING,)
    emits = STRING
    words: tuple[str, ...] = field(default=())

    def __init__(self, *words: str):
        flat = [w for x in words for w in ([x] if isinstance(x, str) else x)]
        object.__setattr__(self, "words", tuple(sorted(set(flat))))

    def transform(self, tokens: DataFrame) -> DataFrame:
        return tokens.where(~F.col("token").isin(*self.words)) if self.words else tokens


class NumberFilter(Stage):
    """Sends unsigned 64-bit numbers to the branch and all else onward; a token takes exactly one of the ways."""

    branch_emits = U64

    def transform(self, tokens: DataFrame) -> DataFrame:
        return tokens.where(T.parse_u64(F.col("token")).isNull())

    def branch(self, tokens: DataFrame) -> DataFrame:
        return tokens.withColumn("token", T.parse_u64(F.col("token"))).where("token IS NOT NULL")


class ToUsize(Stage):
    """Parses unsigned 64-bit numbers and drops all else."""

    emits = USIZE

    def transform(self, tokens: DataFrame) -> DataFrame:
        return tokens.withColumn("token", T.parse_u64(F.col("token"))).where("token IS NOT NULL")


@dataclass(frozen=True)
class Debugger(Stage):
    """Passes tokens on; with a name, their number shows in the Observation of that name when a job runs."""

    takes = (STR, STRING, U64, USIZE)
    emits = "same"
    name: str | None = None

    def transform(self, tokens: DataFrame) -> DataFrame:
        return tokens.observe(self.name, F.count("*").alias("tokens")) if self.name else tokens


STAGES: dict[str, type[Stage]] = {
    c.__name__: c for c in (WhitespaceTokenizer, AlphaNumericTokenizer, LowercaseFilter, Stemmer, StopwordFilter, NumberFilter, ToUsize, Debugger)
}


def register_stage(stage: type[Stage]) -> type[Stage]:
    """Makes a stage of one's own known to the pipeline language; usable as a decorator."""
    STAGES[stage.__name__] = stage
    return stage
