"""A game's text as a table of its moves: a table function, used beside each row of games.

    games.lateralJoin(annotated_moves(F.col("text").outer(), F.lit("clk,eval")))
    SELECT g.game_id, m.* FROM games g, LATERAL annotated_moves(g.text, 'clk,eval') m

The second argument names the annotations (``[%name value]`` in a move's comments); each is a
column of the result, so the function's schema is told by its call.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

_TOKEN = re.compile(
    r"""
    (?P<comment> \{ [^}]* (?: \} | \Z ) | ; [^\n]* )   # to the brace or the line's end
    | (?P<open> \( ) | (?P<close> \) )                 # variations
    | (?P<skip> \$\d+ | \d+ \.+ | 1-0 | 0-1 | 1/2-1/2 | \* )
    | (?P<san> (?: [KQRBN]? [a-h]? [1-8]? x? [a-h] [1-8] (?: = [QRBN] )? | O-O-O | O-O ) [+#]? ) (?P<mark> [!?]* ) (?= [\s{};()$] | \Z )
    | (?P<other> [^\s{};()]+ )
    """,
    re.VERBOSE,
)
_TAG_LINE = re.compile(r'^\[\w+ "(?:[^"\\]|\\.)*"\][ \t\r]*$|^%.*$', re.MULTILINE)


def main_line(text: str) -> Iterator[tuple[int, str, str, str, str]]:
    """(ply, colour, san, mark, comments) of the moves outside of variations, however deep these are.
    What is no move is passed over, as are comments before the first move."""
    at = 0
    while tag := _TAG_LINE.match(text, at):  # the tags before the moves
        at = tag.end() + len(text[tag.end() :]) - len(text[tag.end() :].lstrip())
    deep, ply, move, said = 0, 0, None, []
    for found in _TOKEN.finditer(text, at):
        kind = found.lastgroup if found.lastgroup != "mark" else "san"
        if kind == "open":
            deep += 1
        elif kind == "close":
            deep = max(0, deep - 1)
        elif deep == 0 and kind == "comment":
            said.append(found["comment"].strip("{};").strip())
        elif deep == 0 and kind == "san":
            if move:
                yield (*move, " ".join(said))
            move, said = (ply, "black" if ply % 2 else "white", found["san"], found["mark"]), []
            ply += 1
    if move:
        yield (*move, " ".join(said))


def _asked(names: str | None) -> list[str]:
    asked = [n.strip() for n in (names or "").split(",") if n.strip()]
    if bad := [n for n in asked if not n.isidentifier()]:
        raise ValueError(f"no names of annotations: {bad}")
    return asked


class _Moves:
    @staticmethod
    def analyze(text: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("the first argument is a game's text")
        if not names.isConstantExpression:
            raise ValueError("the annotations' names are constant")
        fixed = [StructField("ply", IntegerType())] + [StructField(n, StringType()) for n in ("colour", "san", "mark", "comment")]
        return AnalyzeResult(StructType(fixed + [StructField(n, StringType()) for n in _asked(names.value)]))

    def __init__(self) -> None:
        self.patterns: dict[str, list[re.Pattern]] = {}

    def eval(self, text: str | None, names: str | None) -> Iterator[tuple]:
        """No rows for a null, an empty text or one without moves; an annotation that a move hasn't is null."""
        key = names or ""
        if key not in self.patterns:
            self.patterns[key] = [re.compile(rf"\[%{n}\s+([^\]]*?)\s*\]") for n in _asked(names)]
        for ply, colour, san, mark, said in main_line(text or ""):
            hits = [p.search(said) for p in self.patterns[key]]
            yield (ply, colour, san, mark, said, *(h[1] if h else None for h in hits))


annotated_moves = udtf(_Moves, useArrow=True)


def register(spark: SparkSession) -> None:
    """Makes ``annotated_moves`` known to SQL."""
    spark.udtf.register("annotated_moves", annotated_moves)
