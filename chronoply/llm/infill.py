"""Fill-in-the-middle texts.

The tokenizers library's Split pre-tokenizer, with the matches of a pattern isolated, tells
the offsets of a text's units in code points; no model and no training is needed. The number
of offsets is the text's length in units, and two offsets ranked by a digest of the document's
id are the places where it is cut. Slices, forms, outputs and the way back are DataFrame
functions; the texts don't come back from Python.
"""

from __future__ import annotations

import re
from functools import cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: A unit is a word with the white space before it; white space at the end is one of its own.
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that are split at once; a longer text is taken in pieces that end with a word.
CHUNK = 1 << 20
_WORD_END = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")


@cache
def _splitter(pattern: str) -> Any:
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(pattern), "isolated")


def unit_ends(text: str, chunk: int = CHUNK) -> np.ndarray:
    """Where each unit ends, in code points. A unit never reaches over a word's end, so pieces
    of a very long text have the units of the whole."""
    split, found, at = _splitter(UNITS).pre_tokenize_str, [np.zeros(0, np.int64)], 0
    while at < len(text):
        end = _WORD_END.search(text, at + chunk) if len(text) - at > chunk else None
        stop = end.start() if end else len(text)
        found.append(np.fromiter((e for _, (_, e) in split(text[at:stop])), np.int64) + at)
        at = stop
    return np.concatenate(found)


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("n", "first", "second")]))
def _cuts(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The text's units, and the code points before the smaller and the larger cut."""
    out = []
    for t, x, y in zip(text, a, b, strict=True):
        ends = unit_ends(t)
        low, high = sorted((int(x) % (len(ends) + 1), int(y) % (len(ends) + 1)))
        out.append((len(ends), int(ends[low - 1]) if low else 0, int(ends[high - 1]) if high else 0))
    return pd.DataFrame(out, columns=["n", "first", "second"])


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of 8 digits of a hexadecimal digest, as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, *, seed: int = 42, percent: int = 50, suffix_first: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n, form, prefix_chars, middle_chars and output of every row.

    ``percent`` of the documents are cut, ``suffix_first`` percent of those as spm, the others
    as psm. Null text is the empty one, which stays plain, as does a text that holds a mark;
    plain rows have null counts of characters and their text as output. A null id draws like
    an empty one. Repeated rows, and rows of one id and text, get one and the same output;
    rows of one id and other texts share their draws. Other columns of ``docs``, whatever
    their names, are dropped. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest.alias("digest"))
    rows = rows.withColumn("cuts", _cuts("text", _draw(F.col("digest"), 1), _draw(F.col("digest"), 2)))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (_draw(F.col("digest"), 3) % 100 >= percent)
    form = F.when(plain, "plain").when(_draw(F.col("digest"), 4) % 100 < suffix_first, "spm").otherwise("psm")
    first, second = F.col("cuts.first"), F.col("cuts.second")
    rows = rows.select("doc_id", "text", F.col("cuts.n").alias("n"), form.alias("form"), first.alias("first"), second.alias("second"))
    prefix, middle = F.expr("substring(text, 1, cast(first as int))"), F.expr("substring(text, cast(first as int) + 1, cast(second - first as int))")
    suffix = F.expr("substring(text, cast(second as int) + 1)")
    output = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col("text"))
    cut = F.col("form") != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cut, F.col("first")).alias("prefix_chars"), F.when(cut, F.col("second") - F.col("first")).alias("middle_chars"), output.alias("output"))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from. No mark is inside a part, and none can arise where
    a part and a mark meet, as marks begin and end with characters that are nowhere else in them."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda k: F.element_at(parts, k)
    return F.when(form == "psm", F.concat(at(2), at(4), at(3))).when(form == "spm", F.concat(at(3), at(4), at(2))).otherwise(output)
