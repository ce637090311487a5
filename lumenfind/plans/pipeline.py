"""Pipelines: a small language for chains of stages, type-checked when built, compiled to DataFrame plans.

    text WhitespaceTokenizer > NumberFilter | [number] > LowercaseFilter > Stemmer(English)
    WhitespaceTokenizer > NumberFilter | [Any in number] > LowercaseFilter > [All in text]

The first line is an indexing pipeline: it names its field, and branches name theirs. The second is a query
pipeline: its targets are ``[All in field]`` or ``[Any in field]``, the last of which is mandatory; All and Any are
accepted and mean the same. The ``>`` between stages may be left out. A target may be a field or a field group.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stages import STAGES, STR, STRING, U64, USIZE, PipelineTypeError, Stage


class Combinator(Enum):
    """Accepted in targets; both have the same meaning."""

    ALL = "All"
    ANY = "Any"


@dataclass(frozen=True)
class Step:
    stage: Stage
    branch: str | None = None


_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_][\w:]*)|(?P<text>\"[^\"]*\"|'[^']*')|(?P<number>\d+)|(?P<sign>[>|\[\](),]))")


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        if not (m := _TOKEN.match(source, at)):
            raise SyntaxError(f"can't read the pipeline at {source[at:]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class _Parser:
    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, kind: str, value: str | None = None) -> str:
        k, v = self.peek()
        if k != kind or value is not None and v != value:
            raise SyntaxError(f"expected {value or kind}, found {v or 'the end'}")
        self.at += 1
        return v

    def target(self, query: bool) -> str:
        self.take("sign", "[")
        if query:
            Combinator(self.take("name"))
            self.take("name", "in")
        name = self.take("name")
        self.take("sign", "]")
        return name

    def steps(self, query: bool) -> tuple[list[Step], str | None]:
        steps: list[Step] = []
        last = None
        while self.peek()[0] != "end":
            if self.peek() == ("sign", ">"):
                self.take("sign", ">")
            if self.peek() == ("sign", "["):
                if not query:
                    raise SyntaxError("only query pipelines end in a target")
                last = self.target(True)
                if self.peek()[0] != "end":
                    raise SyntaxError("nothing may follow the last target")
                break
            name = self.take("name")
            if name not in STAGES:
                raise SyntaxError(f"no such stage: {name}")
            args = []
            if self.peek() == ("sign", "("):
                self.take("sign", "(")
                while self.peek() != ("sign", ")"):
                    kind, value = self.peek()
                    if kind == "end":
                        raise SyntaxError("expected ), found the end")
                    self.at += 1
                    if kind != "sign":
                        args.append(value.strip("\"'") if kind == "text" else value)
                self.take("sign", ")")
            branch = None
            if self.peek() == ("sign", "|"):
                self.take("sign", "|")
                branch = self.target(query)
            steps.append(Step(STAGES[name](*args), branch))
        return steps, last


def check_types(steps: list[Step], targets: dict[str, str], final: str) -> None:
    """Raises PipelineTypeError unless each stage takes what comes to it and each target the type it gets.

    ``targets`` has the term type of each field or group (String, u64 or usize).
    """
    kind = STR
    for step in steps:
        name = type(step.stage).__name__
        if kind not in step.stage.takes:
            raise PipelineTypeError(f"{name} takes {' or '.join(step.stage.takes)}, not {kind}")
        if step.branch is not None:
            if step.stage.branch_emits is None:
                raise PipelineTypeError(f"{name} has no branch")
            _check_target(step.branch, step.stage.branch_emits, targets)
        elif step.stage.branch_emits is not None:
            raise PipelineTypeError(f"{name} needs a branch")
        kind = kind if step.stage.emits == "same" else step.stage.emits
    _check_target(final, kind, targets)


def _check_target(name: str, kind: str, targets: dict[str, str]) -> None:
    if name not in targets:
        raise PipelineTypeError(f"no such field: {name}")
    if targets[name] != kind and {targets[name], kind} != {U64, USIZE}:
        raise PipelineTypeError(f"field {name} holds {targets[name]}, not {kind}")


def run_steps(steps: list[Step], final: str, texts: DataFrame) -> list[tuple[str, DataFrame]]:
    """``(target, token stream)`` of each branch in order, the final target last.

    ``texts`` has a ``token`` column with whole texts; null texts have no tokens.
    """
    stream = texts.where("token IS NOT NULL").withColumn("pos", F.array().cast("array<int>"))
    out = []
    for step in steps:
        if step.branch is not None:
            out.append((step.branch, step.stage.branch(stream)))
        stream = step.stage.transform(stream)
    return [*out, (final, stream)]


@dataclass(frozen=True)
class Pipeline:
    """An indexing pipeline. ``apply`` takes ``(doc_id, token)`` rows and gives ``(field, term, term_num, doc_id)`` rows."""

    field: str
    steps: tuple[Step, ...]

    @classmethod
    def parse(cls, source: str) -> Pipeline:
        p = _Parser(source)
        field = p.take("name")
        return cls(field, tuple(p.steps(False)[0]))

    def check(self, targets: dict[str, str]) -> Pipeline:
        check_types(list(self.steps), targets, self.field)
        return self

    def apply(self, texts: DataFrame) -> DataFrame:
        parts = [terms(stream).select(F.lit(target).alias("field"), "term", "term_num", "doc_id") for target, stream in run_steps(list(self.steps), self.field, texts)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


@dataclass(frozen=True)
class QueryPipeline:
    """A query pipeline. ``apply`` takes ``(query_id, token)`` rows and gives their terms with target, branch and position."""

    final: str
    steps: tuple[Step, ...]

    @classmethod
    def parse(cls, source: str) -> QueryPipeline:
        steps, final = _Parser(source).steps(True)
        if final is None:
            raise SyntaxError("a query pipeline ends in [All in field] or [Any in field]")
        return cls(final, tuple(steps))

    def check(self, targets: dict[str, str]) -> QueryPipeline:
        check_types(list(self.steps), targets, self.final)
        if bad := [type(s.stage).__name__ for s in self.steps if not s.stage.queryable]:
            raise PipelineTypeError(f"{bad[0]} can't be used in queries")
        return self

    def apply(self, queries: DataFrame) -> DataFrame:
        """``(query_id, target, branch, pos, term, term_num)``; branches count from 0 in the order of their targets, the final last."""
        out: DataFrame | None = None
        for n, (target, stream) in enumerate(run_steps(list(self.steps), self.final, queries)):
            part = terms(stream).select("query_id", F.lit(target).alias("target"), F.lit(n).alias("branch"), "pos", "term", "term_num")
            out = part if out is None else out.unionByName(part)
        return out


def terms(stream: DataFrame) -> DataFrame:
    """A stream's tokens as ``term_num`` (unsigned numbers) or ``term`` (all else, as text); the other is null."""
    number = dict(stream.dtypes)["token"] == "decimal(20,0)"
    text, num = (F.lit(None).cast("string"), F.col("token")) if number else (F.col("token").cast("string"), F.lit(None).cast("decimal(20,0)"))
    return stream.withColumn("term", text).withColumn("term_num", num)


class Bucket:
    """Where token streams end: subclass it and define ``put``, which gets ``(doc_id, term, term_num)`` rows."""

    def put(self, stream: DataFrame) -> None:
        raise NotImplementedError


class Collected(Bucket):
    """A sink that holds its streams, for tests and tables of one's own."""

    def __init__(self) -> None:
        self.streams: list[DataFrame] = []

    def put(self, stream: DataFrame) -> None:
        self.streams.append(stream)


def run_into(pipeline: Pipeline, texts: DataFrame, bucket: Callable[[str], Bucket]) -> None:
    """Runs a pipeline over ``(doc_id, token)`` rows; each target's stream goes to the sink that ``bucket`` gives for its name."""
    for target, stream in run_steps(list(pipeline.steps), pipeline.field, texts):
        bucket(target).put(terms(stream).select("doc_id", "term", "term_num"))


#: Whole pipelines may also be plain functions of DataFrames.
IndexPipeline = Pipeline | Callable[[DataFrame], DataFrame]
__all__ = ["STRING", "U64", "USIZE", "Bucket", "Collected", "Combinator", "IndexPipeline", "Pipeline", "PipelineTypeError", "QueryPipeline", "Step", "check_types", "run_into", "run_steps", "terms"]
