"""Quality rules, line first: bad lines go, then documents that lost too much.

Rules look at one line at a time: closing punctuation, navigation, boilerplate,
symbols, shouting and words said over and over. Lines that fail any are removed. A document fails
when the lines left hold too small a share of its words, or by the base rules
on the whole text. Arrow batches; one text at a time, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.schemas import extended

#: Marks that close a sentence, and phrases of boilerplate lines.
CLOSING = tuple(".!?…\"'”’»:;)]")
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "lorem ipsum",
    "enable javascript",
    "javascript is disabled",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "click here to",
)
#: Window of the repetition rule, in words.
WINDOW = 8

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_NAV = re.compile(r"\s[|»›>/•·]\s")
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)), re.IGNORECASE)


def repeated_words(words: list[str], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words which occurs twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # name windows by doubling: equal numbers for equal stretches of 1, 2, 4, ... words
    span = 1
    while span < size:
        step = min(span, size - span)
        x = np.unique(x[:-step] * (len(words) + 1) + x[step:], return_inverse=True)[1]
        span += step
    twice = np.bincount(x)[x] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def line_failure(line: str, words: list[str]) -> str | None:
    """The first rule that a line with words fails, or None."""
    n = len(words)
    chars = sum(map(len, words))
    if len(_SYMBOL.findall(line)) > 0.1 * chars:
        return "symbols"
    if len(_NAV.findall(line)) >= max(2, n // 6):
        return "navigation"
    if _BOILER.search(line) and n <= 30:
        return "boilerplate"
    letters = sum(map(str.isalpha, line))
    if 2 * letters < chars:
        return "letters"
    if n >= 5 and 2 * sum(map(str.isupper, line)) > letters:
        return "shouting"
    if n >= 20 and 5 * len(set(words)) < n:
        return "repetition"
    if n >= 4 and not line.rstrip().endswith(CLOSING):
        return "punctuation"
    return None


def clean(text: str, least_kept: float) -> tuple[dict, str]:
    """Figures of a text, and the text without the lines that fail."""
    words, kept, seen = [], [], set()
    out = {"n_words": 0, "word_chars": 0, "n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "kept_words": 0}
    for line in text.split("\n"):
        of_line = _WORD.findall(line)
        if not of_line:
            kept.append(line)
            continue
        words += of_line
        out["n_dup_lines"] += line in seen
        seen.add(line)
        if line_failure(line, of_line) is None:
            kept.append(line)
            out["kept_words"] += len(of_line)
    n = out["n_words"] = len(words)
    out["word_chars"] = sum(map(len, words))
    out["n_symbols"] = len(_SYMBOL.findall(text))
    out["n_repeat_words"] = repeated_words(words)
    out["base_failed"] = n < 20 or 100 * out["n_repeat_words"] > 30 * n
    out["kept"] = not out["base_failed"] and out["kept_words"] >= least_kept * n
    return out, "\n".join(kept)


def quality_rules(docs: DataFrame, text_col: str = "text", least_kept: float = 0.5) -> DataFrame:
    """``docs`` with the figures, the verdict ``kept`` and ``clean_text``.

    Figures: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``
    (words in windows of 8 words found twice or more), ``kept_words`` (of the
    lines left), all long; ``base_failed`` for fewer than 20 words or more than
    30 % repeated ones; ``kept`` is false for those, and when the lines left hold
    less than ``least_kept`` of the words.

    Null texts have no words and fail. Lines without words are left alone. Every
    row is returned; columns of the new names are replaced, all others stay.
    """
    new = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "kept_words": "long", "base_failed": "boolean", "kept": "boolean"}
    keep = [c for c in docs.columns if c not in {*new, "clean_text"}]
    schema = extended(docs.select(*keep), ", ".join(f"{k} {v}" for k, v in new.items()) + ", clean_text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            rows = [clean(t.as_py() or "", least_kept) for t in batch.column(at)]
            figures = [pa.array([r[0][k] for r in rows], pa.bool_() if v == "boolean" else pa.int64()) for k, v in new.items()]
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, *figures, pa.array([r[1] for r in rows], pa.string())], [*keep, *new, "clean_text"])

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
