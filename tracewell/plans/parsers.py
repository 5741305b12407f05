"""Parsers that callers add: a fact's name, the sections it is made of, its schema, and lines to facts.

A parser is checked when it is registered, against no lines, so that a wrong one fails there and not within an ingest.
Its facts are ingested, stored, counted and read like the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sections import WANTED

LINES = "capture_id long, section string, line_no long, line string"


@dataclass(frozen=True)
class Parser:
    name: str
    sections: tuple[str, ...]
    schema: T.StructType
    parse: Callable[[DataFrame], DataFrame]

    def facts(self, lines: DataFrame) -> DataFrame:
        """The facts in the columns of the schema; no row goes without its capture."""
        return self.parse(lines).select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).where("capture_id IS NOT NULL")


PARSERS: dict[str, Parser] = {}


def register(spark: SparkSession, name: str, sections: tuple[str, ...], schema: str, parse: Callable[[DataFrame], DataFrame]) -> Parser:
    """Add a parser; raises ``ValueError`` where it does not give what it says.

    schema: DDL with ``capture_id`` and ``ord``, the place in parse order.  parse: lines of its sections, ``capture_id, section,
    line_no, line``, to facts, by DataFrame operations; byte formats take an Arrow function with a declared schema there.
    """
    kind = T.StructType.fromDDL(schema)
    missing = {"capture_id", "ord"} - set(kind.fieldNames())
    if missing or not name.isidentifier() or not sections:
        raise ValueError(f"parser {name}: " + (f"its schema lacks {', '.join(sorted(missing))}" if missing else "it needs a plain name and sections"))
    if name in PARSERS:
        raise ValueError(f"parser {name}: there is one of this name")
    given = parse(spark.createDataFrame([], LINES)).schema
    wrong = [f.name for f in kind if f.name not in given.fieldNames() or given[f.name].dataType != f.dataType]
    if wrong:
        raise ValueError(f"parser {name}: it does not give {', '.join(wrong)} as its schema says")
    PARSERS[name] = Parser(name, tuple(sections), kind, parse)
    return PARSERS[name]


def unregister(name: str) -> None:
    PARSERS.pop(name, None)


def sections() -> tuple[str, ...]:
    """Sections that any parser wants."""
    return tuple(dict.fromkeys([*WANTED, *(s for p in PARSERS.values() for s in p.sections)]))
